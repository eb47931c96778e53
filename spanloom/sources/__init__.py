"""Readers and writers for files of records."""
