"""Whole plans: building an index, keeping it in a folder, searching it."""
