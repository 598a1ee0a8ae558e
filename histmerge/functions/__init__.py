"""Expression builders: every one a composition of built-in functions."""
