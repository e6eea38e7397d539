"""A Spark engine for catalogues of five-dimensional lattice polytopes."""
