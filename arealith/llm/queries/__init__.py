"""Thin queries: an operator over its table, digest columns from its output."""
