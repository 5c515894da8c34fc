"""Operators of querent."""
