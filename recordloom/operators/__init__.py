"""Blocking, matching, metrics and validation over record DataFrames."""
