"""Operators for large text, URL, vector and media tables used in training-data work.

Nothing else in the package imports this subpackage.
"""
