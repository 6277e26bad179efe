"""Operators: pure DataFrame transformations."""
