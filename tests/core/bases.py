"""Other bases and numberings, for tests of invariance."""

import numpy as np


def moved(vertices, rng):
    """The same polytope in another basis of the lattice, its vertices in another order: by a lower and an upper unit triangle and a signed permutation."""
    n = vertices.shape[1]
    lower, upper = (np.eye(n, dtype=np.int64) + k(rng.integers(-1, 2, (n, n)), d) for k, d in ((np.tril, -1), (np.triu, 1)))
    signed = np.eye(n, dtype=np.int64)[rng.permutation(n)] * rng.choice([-1, 1], n)
    return rng.permutation(vertices) @ (lower @ signed @ upper)
