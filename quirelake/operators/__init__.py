"""Queries over PDF tables."""
