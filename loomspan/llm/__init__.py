"""Operators for preparing language-model training data.

Nothing outside this package imports it; the rest of the library works without it.
"""
