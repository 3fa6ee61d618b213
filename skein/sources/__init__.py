"""Readers: bytes to text, and the example tables to index rows."""
