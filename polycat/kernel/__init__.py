"""Exact lattice geometry on numpy arrays and Python integers; nothing here knows Spark."""
