"""Patterns, word lists and lookup tables. Operators take them as arguments."""
