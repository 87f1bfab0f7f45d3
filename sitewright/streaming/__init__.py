"""Incremental counts over appended files."""
