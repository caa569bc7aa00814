"""Incremental sources and windows on streams."""
