"""Symbols and edges from source texts."""
