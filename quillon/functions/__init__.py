"""Column functions and named Python functions."""
