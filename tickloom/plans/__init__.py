"""Queries made of the library's operators."""
