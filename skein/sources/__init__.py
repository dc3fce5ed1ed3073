"""Readers and writers of the index tables."""
