"""Operators for large text corpora used as model training data.

Nothing outside this subpackage imports it; see ``registry`` for its queries.
"""
