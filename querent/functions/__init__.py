"""Functions of querent."""
