"""Lattice points of any polytope, polar duals, and the Hodge numbers of Calabi-Yau fourfolds."""

from __future__ import annotations

from collections import Counter

import numpy as np

from polycat.kernel.batch import FULL, hulls
from polycat.kernel.polytope import DIM, Polytope, hull


def points_in(vertices: np.ndarray) -> np.ndarray:
    """All lattice points of the hull of integer points that span their space."""
    return points_in_all([vertices])[0]


def points_in_all(sets: list[np.ndarray]) -> list[np.ndarray]:
    """All lattice points of the hulls of sets of integer points, each of which spans its space.

    Points are built a coordinate at a time: the projection to the first
    coordinates has facets of its own, which bound the next one.  The projections of
    all sets are made together.
    """
    out = [np.arange(v[:, 0].min(), v[:, 0].max() + 1)[:, None] for v in sets]
    owner = np.repeat(np.arange(len(sets)), [len(v) for v in sets])
    for k in range(1, sets[0].shape[1] if sets else 1):
        h = hulls(np.concatenate([v[:, : k + 1] for v in sets]), owner, len(sets))
        for j, v in enumerate(sets):
            facets = h.facets[j, : h.nf[j]]
            if h.kind[j] != FULL:
                shadow = hull(np.unique(v[:, : k + 1], axis=0))
                facets = np.concatenate([shadow.normals, shadow.distances[:, None]], 1)
            out[j] = _raised(out[j], facets, k)
    return out


def _raised(points: np.ndarray, facets: np.ndarray, k: int) -> np.ndarray:
    """Points of k coordinates with each next coordinate that the facets allow."""
    rest = points @ facets[:, :k].T + facets[:, -1]
    slope = facets[:, k]
    up, down = slope > 0, slope < 0
    low = (-(rest[:, up] // slope[up])).max(1)
    high = (rest[:, down] // -slope[down]).min(1)
    n = np.maximum(high - low + 1, 0)
    value = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - low, n)
    return np.concatenate([np.repeat(points, n, axis=0), value[:, None]], 1)


def dual(p: Polytope) -> Polytope:
    """The polar dual of a reflexive polytope: its vertices are the normals, its normals the vertices."""
    if not p.reflexive:
        raise ValueError("only a reflexive polytope's dual is a lattice polytope")
    return Polytope(p.normals, p.vertices, np.ones(len(p.vertices), np.int64))


def _by_face(points: np.ndarray, p: Polytope) -> Counter:
    """How many points are inside each face, a face being the facets that it lies on."""
    tight = points @ p.normals.T + p.distances == 0
    packed, first, count = np.unique(np.packbits(tight, axis=1), axis=0, return_index=True, return_counts=True)
    return Counter({frozenset(np.flatnonzero(tight[k]).tolist()): int(n) for k, n in zip(first, count, strict=True)})


def hodge_numbers(p: Polytope) -> dict[str, int]:
    """The Hodge numbers of one polytope; see ``hodge_numbers_of``."""
    return hodge_numbers_of([p])[0]


def hodge_numbers_of(polytopes: list[Polytope]) -> list[dict[str, int]]:
    """h11, h12, h13, h22 and the Euler number of the fourfolds of reflexive polytopes, and both point counts."""
    if any(p.vertices.shape[1] != DIM for p in polytopes):
        raise ValueError("fourfolds come from five dimensions")
    duals = [dual(p) for p in polytopes]
    points = points_in_all([q.vertices for q in (*polytopes, *duals)])
    return [_numbers(p, q, mine, theirs) for p, q, mine, theirs in zip(polytopes, duals, points, points[len(polytopes) :], strict=False)]


def _numbers(p: Polytope, other: Polytope, mine: np.ndarray, theirs: np.ndarray) -> dict[str, int]:
    """The numbers of a polytope and its dual from the lattice points of both: 

    A face is named by its vertices and by its facets; its dual face has these the
    other way round.  The sums run over faces with interior points on both sides.
    """
    inside, dual_inside = _by_face(mine, p), _by_face(theirs, other)
    zero = p.pairing == 0
    on_facet = sum(n for f, n in inside.items() if len(f) == 1)
    on_dual_facet = sum(n for v, n in dual_inside.items() if len(v) == 1)
    products = Counter()
    for facets, n in inside.items():
        if facets:
            vertices = frozenset(np.flatnonzero(zero[:, sorted(facets)].all(1)).tolist())
            m = dual_inside.get(vertices, 0)
            if m:
                corner = p.vertices[sorted(vertices)]
                products[int(np.linalg.matrix_rank(corner - corner[0]))] += n * m
    h11 = len(theirs) - DIM - 1 - on_dual_facet + products[1]
    h13 = len(mine) - DIM - 1 - on_facet + products[3]
    h12 = products[2]
    h22 = 44 + 4 * h11 - 2 * h12 + 4 * h13
    return {"point_count": len(mine), "dual_point_count": len(theirs), "h11": h11, "h12": h12, "h13": h13, "h22": h22, "chi": 48 + 6 * (h11 + h13 - h12)}
