"""Plans of querent."""
