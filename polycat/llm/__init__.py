"""Operators that prepare text corpora for training: one module each, and their queries.

Nothing else in the library imports this subpackage.
"""
