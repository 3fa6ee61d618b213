"""Column functions and pure-Python text functions."""
