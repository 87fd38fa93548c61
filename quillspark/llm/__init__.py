"""Operators for building language-model training corpora.

Nothing outside this folder imports it; it may be removed without touching the rest of the library.
"""
