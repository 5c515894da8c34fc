"""Streaming of querent."""
