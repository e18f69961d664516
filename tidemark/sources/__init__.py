"""Scans of feed formats and keyed sinks."""
