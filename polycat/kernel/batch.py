"""The kernel on many weight systems at once: whole arrays of systems instead of one after the other.

Results are those of the exact kernel.  Arithmetic is on 64-bit integers whose
size is checked before each step; a system whose numbers might not fit, or that
has too many vertices for a machine word, goes to the exact kernel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from polycat.kernel import colours

DIM = 5
WIDTH = DIM + 1
#: A product or sum below this in floating point fits 64-bit integers.
FITS = 2.0**61
MOST_VERTICES = 64


def _ragged(counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... (counts[k] of them) for each k."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts - first, counts)


def _inverses(a: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.array([pow(x, -1, y) if y > 1 else 0 for x, y in zip(a.tolist(), m.tolist(), strict=True)], np.int64)


def corner_points(w: np.ndarray, degree: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For coprime weights in descending order: the number of x >= 0 with w . x = degree, and (system, x) of those that may be vertices.

    A coordinate takes only values after which the others can still make the
    rest.  Between the ends of a run of the last two no point is a vertex,
    and none from which a step along two coordinates can be taken both ways.
    """
    n = len(w)
    g = w.copy()
    for k in range(WIDTH - 2, -1, -1):
        g[:, k] = np.gcd(w[:, k], g[:, k + 1])
    owner, rest = np.arange(n), degree.astype(np.int64)
    chosen: list[np.ndarray] = []
    for k in range(DIM):
        step = (g[:, k + 1] // g[:, k])[owner]
        inverse = _inverses(w[:, k] // g[:, k], g[:, k + 1] // g[:, k])[owner]
        first = rest // g[owner, k] % step * inverse % step
        top = rest // w[owner, k]
        count = np.where(top >= first, (top - first) // step + 1, 0)
        if k == DIM - 1:
            break
        value = np.repeat(first, count) + _ragged(count, np.zeros(len(count), np.int64)) * np.repeat(step, count)
        at = np.repeat(np.arange(len(owner)), count)
        rest = rest[at] - value * w[owner[at], k]
        chosen = [c[at] for c in chosen] + [value]
        owner = owner[at]
    total = np.bincount(owner, count, n).astype(np.int64)
    jump = {(i, j): w[:, j] // np.gcd(w[:, i], w[:, j]) for i in range(WIDTH) for j in range(WIDTH) if i != j}
    keep = count > 0
    for i in range(DIM - 1):
        for j in range(i):
            keep &= (chosen[i] < jump[i, j][owner]) | (chosen[j] < jump[j, i][owner])
    keep = np.flatnonzero(keep)
    both = np.concatenate([keep, keep[count[keep] > 1]])
    last = np.concatenate([first[keep], (first + (count - 1) * step)[keep[count[keep] > 1]]])
    x = np.empty((len(both), WIDTH), np.int64)
    for k, c in enumerate(chosen):
        x[:, k] = c[both]
    owner = owner[both]
    x[:, DIM - 1] = last
    x[:, DIM] = (rest[both] - last * w[owner, DIM - 1]) // w[owner, DIM]
    keep = np.ones(len(x), bool)
    for i in (DIM - 1, DIM):
        for j in range(i):
            keep &= (x[:, i] < jump[i, j][owner]) | (x[:, j] < jump[j, i][owner])
    return total, owner[keep], x[keep]


def coordinates(w: np.ndarray) -> np.ndarray:
    """For coprime weights: matrices that take the y with w . y = 0 to coordinates of that lattice (system, DIM, WIDTH)."""
    n = len(w)
    a, rows = w.copy(), np.arange(n)
    v = np.broadcast_to(np.eye(WIDTH, dtype=np.int64), (n, WIDTH, WIDTH)).copy()
    while ((a != 0).sum(1) > 1).any():
        low = np.where(a != 0, a, np.iinfo(np.int64).max).argmin(1)
        head = a[rows, low]
        q = a // head[:, None]
        q[rows, low] = 0
        a -= q * head[:, None]
        v[rows, low] += (q[:, :, None] * v).sum(1)
    # The one that is left takes y to w . y.
    others = np.nonzero(a == 0)[1].reshape(n, DIM)
    return np.take_along_axis(v, others[:, :, None], 1)


@dataclass
class Hulls:
    """Hulls of point sets: ``kind`` FULL, FLAT or UNKNOWN of each, and of the full ones padded vertices and facets."""

    kind: np.ndarray
    nv: np.ndarray
    nf: np.ndarray
    vertices: np.ndarray
    facets: np.ndarray


FULL, FLAT, UNKNOWN = 0, 1, 2


def _first_at(hit: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The first marked place of each owner (which are sorted, and each has one)."""
    at = np.flatnonzero(hit)
    return at[np.searchsorted(owner[at], np.arange(n))]


def _simplices(points: np.ndarray, owner: np.ndarray, start: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Places of vertices of each set that span its space; ``kind`` is set where there are none or numbers are too large."""
    n, dim = len(start), points.shape[1]
    out = np.empty((n, dim + 1), np.int64)
    out[:, 0] = start
    rest = points - points[start][owner]
    last = np.ones(n, np.int64)
    for k in range(dim):
        some = np.logical_or.reduceat(rest != 0, start)
        kind[(kind == FULL) & ~some.any(1)] = FLAT
        f = rest[np.arange(len(owner)), some.argmax(1)[owner]]
        f = np.where((np.minimum.reduceat(f, start) < 0)[owner], f, -f)
        out[:, k + 1] = _first_at(f == np.minimum.reduceat(f, start)[owner], owner, n)
        pivot, row = f[out[:, k + 1]], rest[out[:, k + 1]]
        large = np.maximum.reduceat(np.abs(rest).max(1), start).astype(np.float64)
        kind[(kind == FULL) & (2 * large * large > FITS)] = UNKNOWN
        ok = kind == FULL
        pivot, row = np.where(ok, pivot, 0), np.where(ok[:, None], row, 0)
        rest = (rest * pivot[owner][:, None] - f[:, None] * row[owner]) // last[owner][:, None]
        rest[~ok[owner]] = 0
        last = np.where(ok, pivot, 1)
    return out


def _reduced(rows: np.ndarray) -> np.ndarray:
    return rows // np.maximum(np.gcd.reduce(rows, axis=1), 1)[:, None]


def hulls(points: np.ndarray, owner: np.ndarray, n: int) -> Hulls:
    """The hulls of ``n`` sets of integer points of any one dimension; each has one at least, and every point belongs to its ``owner``.

    All hulls grow together.  In a round each takes the point that violates
    one of its facets most; facets that see it go, and each pair of a seen and an
    unseen facet that meet in a ridge gives a new one, an integer combination of
    the two.
    """
    dim = points.shape[1]
    width = dim + 1
    order = np.lexsort((*points.T[::-1], owner))
    points, owner = points[order], owner[order]
    start = np.searchsorted(owner, np.arange(n))
    size = np.diff(np.append(start, len(owner)))
    kind = np.where(size > dim, FULL, FLAT)
    simplex = _simplices(points, owner, start, kind)
    h = np.concatenate([points, np.ones((len(points), 1), np.int64)], 1)
    reach = np.maximum.reduceat(np.abs(h).max(1), start).astype(np.float64)
    chosen = np.zeros((n, MOST_VERTICES), np.int64)
    chosen[:, :width] = simplex
    have = np.full(n, width)

    # Facets of the simplices, by inverses that are checked in integers.
    live = np.flatnonzero(kind == FULL)
    m = h[simplex[live]]
    det = np.rint(np.linalg.det(m.astype(np.float64))) if len(live) else np.zeros(0)
    with np.errstate(all="ignore"):
        near = np.linalg.inv(np.where((det != 0)[:, None, None], m, np.eye(width))) * det[:, None, None]
    near = np.rint(near)
    fine = (np.abs(det) > 0) & (np.abs(near).max((1, 2), initial=0) * reach[live] * width < 2.0**52)
    adjugate = np.where(fine[:, None, None], near, 0).astype(np.int64)
    whole = np.where(fine, det, 1).astype(np.int64)
    fine &= (m @ adjugate == whole[:, None, None] * np.eye(width, dtype=np.int64)).all((1, 2))
    kind[live[~fine]] = UNKNOWN
    live, adjugate, whole = live[fine], adjugate[fine], whole[fine]
    rows = _reduced((adjugate * np.sign(whole)[:, None, None]).transpose(0, 2, 1).reshape(-1, width))
    of = np.repeat(live, width)
    on = np.tile(np.uint64((1 << width) - 1) ^ (np.uint64(1) << np.arange(width, dtype=np.uint64)), len(live))

    def worst(of: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least value of any point for each facet, and the first point that has it."""
        many = size[of]
        at = _ragged(many, start[of])
        value = np.einsum("ij,ij->i", np.repeat(rows, many, axis=0), h[at])
        least = np.minimum.reduceat(value, np.cumsum(many) - many) if len(of) else np.zeros(0, np.int64)
        facet = np.repeat(np.arange(len(of)), many)
        return least, at[_first_at(value == least[facet], facet, len(of))]

    done: list[tuple] = []
    least, at = worst(of, rows)
    while len(of):
        # Facets are sorted by owner: where each one's begin.
        new = np.flatnonzero(np.diff(of, prepend=-1))
        who = of[new]
        low = np.minimum.reduceat(least, new)
        local = np.repeat(np.arange(len(who)), np.diff(np.append(new, len(of))))
        over = low >= 0
        full = ~over & (have[who] >= MOST_VERTICES)
        kind[who[full]] = UNKNOWN
        if (over | full).any():
            gone = over[local]
            done.append((of[gone], rows[gone]))
            stay = ~(over | full)[local]
            of, rows, on, least, at = of[stay], rows[stay], on[stay], least[stay], at[stay]
            if not len(of):
                break
            new = np.flatnonzero(np.diff(of, prepend=-1))
            who = of[new]
            low = np.minimum.reduceat(least, new)
            local = np.repeat(np.arange(len(who)), np.diff(np.append(new, len(of))))
        point = at[_first_at(least == low[local], local, len(who))]
        bit = np.uint64(1) << have[who].astype(np.uint64)
        chosen[who, have[who]] = point
        have[who] += 1
        value = np.einsum("ij,ij->i", rows, h[point][local])
        on = np.where(value == 0, on | bit[local], on)
        seen, unseen = np.flatnonzero(value < 0), np.flatnonzero(value > 0)
        first = np.searchsorted(local[unseen], np.arange(len(who) + 1))
        many = np.diff(first)[local[seen]]
        a, b = np.repeat(seen, many), unseen[_ragged(many, first[:-1][local[seen]])]
        ridge = on[a] & on[b]
        some = np.bitwise_count(ridge) >= dim - 1
        a, b, ridge = a[some], b[some], ridge[some]
        # A ridge is on two facets and no more.
        count = np.diff(np.append(new, len(of)))[local[a]]
        other = _ragged(count, new[local[a]])
        inside = np.repeat(ridge, count) & ~on[other] == 0
        some = np.add.reduceat(inside, np.cumsum(count) - count) == 2 if len(a) else np.zeros(0, bool)
        a, b, ridge = a[some], b[some], ridge[some]
        size_a, size_b = (np.abs(rows[x]).max(1, initial=0).astype(np.float64) for x in (a, b))
        risky = np.abs(value[b]) * size_a + np.abs(value[a]) * size_b > FITS
        fresh = _reduced(value[b][:, None] * rows[a] - value[a][:, None] * rows[b])
        risky |= np.abs(fresh).max(1, initial=0) * reach[of[a]] * width > FITS
        # Pairs that give the same facet are one.
        key = (fresh.astype(np.uint64) * colours.mixed(np.arange(width))).sum(1, dtype=np.uint64)
        order = np.lexsort((key, local[a]))
        fresh, key, ridge, mine, risky = fresh[order], key[order], ridge[order], local[a][order], risky[order]
        same = np.zeros(len(fresh), bool)
        same[1:] = (mine[1:] == mine[:-1]) & (key[1:] == key[:-1])
        unlike = np.zeros(len(fresh), bool)
        unlike[1:] = same[1:] & (fresh[1:] != fresh[:-1]).any(1)
        head = np.flatnonzero(~same)
        bad = np.bincount(mine, risky | unlike, len(who)) > 0
        ridge = np.bitwise_or.reduceat(ridge, head) if len(head) else ridge
        fresh, mine = fresh[head], mine[head]
        if bad.any():
            kind[who[bad]] = UNKNOWN
            stay = ~bad[mine]
            fresh, mine, ridge = fresh[stay], mine[stay], ridge[stay]
        keep = (value >= 0) & ~bad[local]
        more, where = worst(who[mine], fresh)
        of = np.concatenate([of[keep], who[mine]])
        order = np.argsort(of, kind="stable")
        of = of[order]
        rows = np.concatenate([rows[keep], fresh])[order]
        on = np.concatenate([on[keep], ridge | bit[mine]])[order]
        least, at = np.concatenate([least[keep], more])[order], np.concatenate([at[keep], where])[order]

    of = np.concatenate([np.zeros(0, np.int64), *(d[0] for d in done)])
    rows = np.concatenate([np.zeros((0, width), np.int64), *(d[1] for d in done)])
    order = np.argsort(of, kind="stable")
    of, rows = of[order], rows[order]
    full = kind == FULL
    nf = np.where(full, np.bincount(of, minlength=n), 0)
    facets = np.zeros((n, int(nf.max(initial=0)), width), np.int64)
    facets[of, _ragged(nf, np.zeros(n, np.int64))] = rows
    nv = np.where(full, have, 0)
    vertices = points[chosen[:, : int(nv.max(initial=0))]]
    return Hulls(kind, nv, nf, vertices, facets)


def hermite_forms(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row Hermite normal forms of a stack of matrices of full row rank, and which of them may be wrong since numbers grew too large."""
    m = m.copy()
    n, height, width = m.shape
    top, wide, jobs = np.zeros(n, np.int64), np.zeros(n, bool), np.arange(n)
    line = np.arange(height)
    for col in range(width):
        going = jobs[top < height]
        if not len(going):
            break
        pivots = []
        while len(going):
            t = top[going]
            a = np.where(line >= t[:, None], m[going, :, col], 0)
            size = np.abs(a)
            nonzero = size != 0
            some = nonzero.any(1)
            going, t, a, size, nonzero = going[some], t[some], a[some], size[some], nonzero[some]
            if not len(going):
                break
            low = np.where(nonzero, size, np.iinfo(np.int64).max).argmin(1)
            head, there = m[going, low], m[going, t]
            sign = np.sign(head[:, col])
            m[going, low], m[going, t] = there, head * sign[:, None]
            one = nonzero.sum(1) == 1
            pivots.append(going[one])
            going, t = going[~one], t[~one]
            if not len(going):
                break
            block, head = m[going], m[going, t]
            q = np.where(line > t[:, None], block[:, :, col] // head[:, None, col], 0)
            wide[going] |= (np.abs(q).max(1).astype(np.float64) + 1) * np.abs(block).max((1, 2)) > FITS
            block = np.where(wide[going][:, None, None], 0, block - q[:, :, None] * head[:, None, :])
            m[going] = block
        done = np.concatenate([np.zeros(0, np.int64), *pivots])
        if len(done):
            t = top[done]
            block, head = m[done], m[done, t]
            q = np.where(line < t[:, None], block[:, :, col] // head[:, None, col], 0)
            wide[done] |= (np.abs(q).max(1).astype(np.float64) + 1) * np.abs(block).max((1, 2)) > FITS
            m[done] = np.where(wide[done][:, None, None], 0, block - q[:, :, None] * head[:, None, :])
            top[done] += 1
    return m, wide


def normal_forms(h: Hulls, which: np.ndarray, most: int) -> list[np.ndarray | None]:
    """The normal forms of some hulls; None where numbers grew too large."""
    n, width = h.nv[which], int(h.nv[which].max(initial=1))
    vertices, facets = h.vertices[which][:, :width], h.facets[which][:, : int(h.nf[which].max(initial=1))]
    pairing = vertices @ facets[:, :, :DIM].transpose(0, 2, 1) + facets[:, None, :, DIM]
    who, order = colours.leaves(colours.coded(pairing, n, h.nf[which]), n, most)
    best: list[tuple[bytes, np.ndarray] | None] = [None] * len(which)
    lost = np.zeros(len(which), bool)
    for lo in range(0, len(who), 4096):
        w, o = who[lo : lo + 4096], order[lo : lo + 4096]
        m = np.take_along_axis(vertices[w], o[:, :, None], 1).transpose(0, 2, 1)
        forms, wide = hermite_forms(np.where((np.arange(width) < n[w][:, None])[:, None, :], m, 0))
        lost[w[wide]] = True
        # Bytes that order as the numbers do.
        keys = (forms.astype(np.uint64) ^ np.uint64(1 << 63)).astype(">u8")
        for k, job in enumerate(w.tolist()):
            key = keys[k, :, : n[job]].tobytes()
            if best[job] is None or key < best[job][0]:
                best[job] = key, forms[k, :, : n[job]]
    return [None if lost[k] else b[1] for k, b in enumerate(best)]


#: Systems, and points expected, that are worked on together.
MOST_SYSTEMS, MOST_POINTS = 1024, 1 << 20


def _chunks(w: np.ndarray) -> list[slice]:
    """Consecutive systems whose polytopes have some million points together."""
    expected = w.sum(1).astype(np.float64) ** DIM / (120 * w.astype(np.float64).prod(1)) + 200
    before, out, at = np.cumsum(expected), [], 0
    while at < len(w):
        limit = (before[at - 1] if at else 0.0) + MOST_POINTS
        to = min(max(int(np.searchsorted(before, limit, "right")), at + 1), at + MOST_SYSTEMS, len(w))
        out.append(slice(at, to))
        at = to
    return out


@dataclass
class Shapes:
    """A chunk of systems: their places, lattice points, hulls, and whether the origin is strictly inside (never where the hull is UNKNOWN)."""

    who: np.ndarray
    points: np.ndarray
    hulls: Hulls
    inside: np.ndarray


def shapes(w: np.ndarray) -> Iterator[Shapes]:
    """Hulls of rows of positive weights, a chunk at a time; rows whose degree is too large for it are left out."""
    w = -np.sort(-w.astype(np.int64), axis=1)
    w //= np.maximum(np.gcd.reduce(w, axis=1), 1)[:, None]
    small = np.flatnonzero(w.astype(np.float64).sum(1) < 2**31)
    for part in _chunks(w[small]):
        who = small[part]
        some = w[who]
        total, owner, x = corner_points(some, some.sum(1))
        h = hulls(np.einsum("pij,pj->pi", coordinates(some)[owner], x - 1), owner, len(some))
        inside = (h.kind == FULL) & ((h.facets[:, :, DIM] > 0) | (np.arange(h.facets.shape[1]) >= h.nf[:, None])).all(1)
        yield Shapes(who, total, h, inside)


def classified(w: np.ndarray, most: int) -> list[tuple | None | bool]:
    """(vertices, facets, points, normal form as a flat list) of each row of positive weights; None where the origin isn't strictly inside, False where the exact kernel must say."""
    out: list = [False] * len(w)
    for s in shapes(w):
        which = np.flatnonzero(s.inside)
        forms = dict(zip(which.tolist(), normal_forms(s.hulls, which, most) if len(which) else (), strict=True))
        for k, at in enumerate(s.who.tolist()):
            if k in forms:
                out[at] = False if forms[k] is None else (int(s.hulls.nv[k]), int(s.hulls.nf[k]), int(s.points[k]), forms[k].ravel().tolist())
            elif s.hulls.kind[k] != UNKNOWN:
                out[at] = None
    return out
