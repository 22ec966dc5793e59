"""Incremental forms of the log operators."""
