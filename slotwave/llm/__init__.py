"""Operators for preparing language-model training data.

Self-contained: nothing outside this package imports it, and it imports nothing
from the rest of the library.
"""
