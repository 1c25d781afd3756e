"""Incremental linkage of newly arriving records."""
