"""Incremental sources."""
