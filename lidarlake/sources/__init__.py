"""Readers and writers of map tables, streams and reports."""
