"""Corpora, streams, connectors and the plug-in surface."""
