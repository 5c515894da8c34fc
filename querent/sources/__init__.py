"""Sources of querent."""
