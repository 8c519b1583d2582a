"""Readers, writers and adapters onto the given tables."""
