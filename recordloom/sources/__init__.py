"""Readers and writers of record, truth and id-list files."""
