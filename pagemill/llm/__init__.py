"""Operators for preparing training text: scoring, filtering, tokenising, near-duplicates and mixing.

Nothing else in the library imports this package.
"""
