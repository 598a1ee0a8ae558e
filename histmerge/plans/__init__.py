"""The composed three-table merge."""
