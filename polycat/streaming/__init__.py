"""Catalogues that grow with a stream of weight files."""
