"""Readers, writers and the derived market tables."""
