"""Lattice points, convex hull, and what follows from the vertices and facets of a polytope."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from math import gcd

import numpy as np

from polycat.kernel.exact import determinants, inverse_unimodular, primitive, unimodular_with_gcd

DIM = 5


def exponents(weights: list[int], degree: int) -> np.ndarray:
    """All x >= 0 with weights . x = degree, a row each.

    Coordinates are added from the largest weight down; a partial sum is given up
    when the smaller weights' greatest common divisor doesn't divide the rest.
    """
    order = sorted(range(len(weights)), key=lambda k: -weights[k])
    w = [int(weights[k]) for k in order]
    rest, chosen = np.array([int(degree)], np.int64), []
    for k, x in enumerate(w[:-1]):
        n = rest // x + 1
        first = np.cumsum(n) - n
        value = np.arange(int(n.sum())) - np.repeat(first, n)
        rest = np.repeat(rest, n) - value * x
        below = 0
        for y in w[k + 1 :]:
            below = gcd(below, y)
        good = rest % below == 0
        chosen = [np.repeat(c, n)[good] for c in chosen] + [value[good]]
        rest = rest[good]
    chosen.append(rest // w[-1])
    out = np.empty((len(rest), len(w)), np.int64)
    for k, c in zip(order, chosen, strict=True):
        out[:, k] = c
    return out


def lattice_points(rows: list[list[int]], degrees: list[int]) -> np.ndarray:
    """The polytope's lattice points in coordinates of the lattice, for one weight system or a combined one.

    They are the y = x - 1 with x >= 0 in all coordinates that satisfy every row's
    equation; coordinates belong to a basis of the lattice that the rows leave.
    """
    width = len(rows[0])
    if len(rows) == 1:
        y = exponents(rows[0], degrees[0]) - 1
        u = unimodular_with_gcd(rows[0])
        return (y @ inverse_unimodular(u)[1:].T.astype(np.int64)).astype(np.int64)
    points = np.zeros((1, width), np.int64)
    free = np.ones(width, bool)
    for row, degree in zip(rows, degrees, strict=True):
        row = np.array(row, np.int64)
        new = np.flatnonzero((row > 0) & free)
        rest = degree - points @ row
        grown = []
        for value in np.unique(rest).tolist():
            have = points[rest == value]
            more = exponents(row[new].tolist(), value) if len(new) and value >= 0 else np.zeros((int(value == 0), 0), np.int64)
            both = np.repeat(have, len(more), 0)
            both[:, new] = np.tile(more, (len(have), 1))
            grown.append(both)
        points = np.concatenate(grown) if grown else points[:0]
        free[new] = False
    return (points - 1) @ kernel_coordinates(rows).T


def kernel_coordinates(rows: list[list[int]]) -> np.ndarray:
    """Integer matrix C such that C y are lattice coordinates of the y that all rows are orthogonal to."""
    c = np.array([[int(i == j) for j in range(len(rows[0]))] for i in range(len(rows[0]))], dtype=object)
    basis = c.copy()  # columns span what is left
    for row in rows:
        image = [int(x) for x in np.array(row, dtype=object) @ basis]
        if not any(image):
            continue
        u = unimodular_with_gcd(image)
        basis = (basis @ u)[:, 1:]
        c = (inverse_unimodular(u) @ c)[1:]
    return c.astype(np.int64)


@dataclass
class Polytope:
    """A full-dimensional lattice polytope: vertices, and facets as normal . x + distance >= 0 in lowest terms."""

    vertices: np.ndarray
    normals: np.ndarray
    distances: np.ndarray

    @cached_property
    def pairing(self) -> np.ndarray:
        """Lattice distance of each vertex (row) from each facet."""
        return self.vertices @ self.normals.T + self.distances

    @property
    def interior(self) -> bool:
        """Whether the origin is strictly inside."""
        return bool((self.distances > 0).all())

    @property
    def reflexive(self) -> bool:
        return bool((self.distances == 1).all())

    @cached_property
    def incidence(self) -> list[frozenset]:
        """The vertices on each facet."""
        return [frozenset(np.flatnonzero(c == 0).tolist()) for c in self.pairing.T]

    @cached_property
    def volume(self) -> int:
        """The volume in units of the smallest lattice simplex, by a pulling triangulation."""
        simplices: list[tuple] = []

        def pull(face: frozenset, dim: int, apexes: tuple) -> None:
            low = min(face)
            if dim == 0:
                simplices.append((*apexes, low))
                return
            parts = {face & g for g in self.incidence if not face <= g}
            for part in parts:
                if low not in part and part and not any(part < other for other in parts):
                    pull(part, dim - 1, (*apexes, low))

        pull(frozenset(range(len(self.vertices))), self.vertices.shape[1], ())
        corners = self.vertices[np.array(simplices)]
        return int(np.abs(determinants(corners[:, 1:] - corners[:, :1])).sum())


def _extreme(points: np.ndarray, values: np.ndarray) -> int:
    """The point with the least value; of several the lexicographically first, so that it is a vertex."""
    low = np.flatnonzero(values == values.min())
    return int(low[np.lexsort(points[low].T[::-1])[0]]) if len(low) > 1 else int(low[0])


def _orthogonal(rows: list[list[int]], width: int) -> list[int] | None:
    """An integer vector orthogonal to all rows, or None where only 0 is."""
    m, pivots = [list(map(int, r)) for r in rows], []
    for col in range(width):
        k = len(pivots)
        at = next((i for i in range(k, len(m)) if m[i][col]), None)
        if at is None:
            continue
        m[k], m[at] = m[at], m[k]
        for i in range(len(m)):
            if i != k and m[i][col]:
                a, b = m[k][col], m[i][col]
                m[i] = list(primitive([a * x - b * y for x, y in zip(m[i], m[k], strict=True)]))
        pivots.append(col)
    free = next((c for c in range(width) if c not in pivots), None)
    if free is None:
        return None
    scale = 1
    for k, c in enumerate(pivots):
        scale = scale * m[k][c] // gcd(scale, m[k][c])
    out = [0] * width
    out[free] = scale
    for k, c in enumerate(pivots):
        out[c] = -scale * m[k][free] // m[k][c]
    return list(primitive(out))


def _first_simplex(points: np.ndarray) -> list[int] | None:
    dim = points.shape[1]
    chosen = [_extreme(points, points[:, 0])]
    tried: list[list[int]] = []
    while len(chosen) <= dim:
        base = points[chosen[0]]
        normal = _orthogonal([(points[k] - base).tolist() for k in chosen[1:]] + tried, dim)
        if normal is None:
            return None
        values = (points - base) @ np.array(normal, np.int64)
        if not values.any():
            tried.append(normal)  # all points have one value: the polytope is flat in this direction
            return None
        chosen.append(_extreme(points, values if values.min() < 0 else -values))
    return chosen


def hull(points: np.ndarray) -> Polytope | None:
    """The convex hull of integer points, or None if it isn't full-dimensional.

    Facets of a growing hull are kept with the vertices on them.  The point that
    violates a facet most (a vertex of the whole) comes next: facets it sees go,
    and each pair of a seen and an unseen facet that meet in a ridge gives a new
    one, an integer combination of the two.
    """
    if len(points) <= points.shape[1]:
        return None
    first = _first_simplex(points)
    if first is None:
        return None
    dim = points.shape[1]
    homogeneous = np.concatenate([points, np.ones((len(points), 1), np.int64)], 1)
    chosen = list(first)
    facets: list[tuple] = []
    on: list[int] = []  # bits of the chosen points on each facet
    for k in range(dim + 1):
        others = [points[j] for i, j in enumerate(first) if i != k]
        normal = _orthogonal([(x - others[0]).tolist() for x in others[1:]], dim)
        distance = -int(np.dot(others[0], normal))
        if int(np.dot(points[first[k]], normal)) + distance < 0:
            normal, distance = [-x for x in normal], -distance
        facets.append(primitive((*normal, distance)))
        on.append(((1 << (dim + 1)) - 1) ^ (1 << k))
    worst = _worst(points, homogeneous, facets)
    while True:
        at = min(range(len(facets)), key=lambda k: worst[k][0])
        if worst[at][0] >= 0:
            break
        new = worst[at][1]
        bit = 1 << len(chosen)
        chosen.append(new)
        values = [int(v) for v in np.array(facets, dtype=np.int64) @ homogeneous[new]]
        seen = [k for k, v in enumerate(values) if v < 0]
        unseen = [k for k, v in enumerate(values) if v > 0]
        fresh: dict[tuple, int] = {}
        for a in seen:
            for b in unseen:
                ridge = on[a] & on[b]
                if ridge.bit_count() < dim - 1:
                    continue
                if any(ridge & ~on[c] == 0 for c in range(len(facets)) if c != a and c != b):
                    continue
                row = primitive([values[b] * x - values[a] * y for x, y in zip(facets[a], facets[b], strict=True)])
                fresh[row] = fresh.get(row, 0) | ridge | bit
        keep = [k for k, v in enumerate(values) if v >= 0]
        on = [on[k] | (bit if values[k] == 0 else 0) for k in keep] + list(fresh.values())
        facets, worst = [facets[k] for k in keep], [worst[k] for k in keep]
        if fresh:
            worst += _worst(points, homogeneous, list(fresh))
            facets += list(fresh)
    table = np.array(facets, dtype=np.int64)
    return Polytope(points[chosen], table[:, :-1], table[:, -1])


def _worst(points: np.ndarray, homogeneous: np.ndarray, facets: list[tuple]) -> list[tuple[int, int]]:
    """For each facet the least value of any point, and a vertex that has it."""
    table = np.array(facets, dtype=object)
    bound = int(np.abs(homogeneous).max()) * int(np.abs(table).max()) * homogeneous.shape[1]
    if bound < 2**52:
        values = homogeneous.astype(np.float64) @ table.astype(np.float64).T
    elif bound < 2**62:
        values = homogeneous @ table.astype(np.int64).T
    else:
        raise OverflowError("facets need more than 62 bits")
    return [(int(v.min()), _extreme(points, v)) if v.min() < 0 else (0, -1) for v in values.T]
