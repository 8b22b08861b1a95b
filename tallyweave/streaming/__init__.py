"""Incremental runs over arriving files and results."""
