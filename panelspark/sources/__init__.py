"""Readers, sinks and the views bound to the given tables."""
