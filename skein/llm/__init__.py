"""Operators on natural-language text; nothing outside this package imports it."""
