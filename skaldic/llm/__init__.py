"""Operators for building training corpora.

Nothing outside this subpackage imports it; ``catalog`` registers its queries.
"""
