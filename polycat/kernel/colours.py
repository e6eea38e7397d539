"""Colour refinement of the vertices of many polytopes at once.

A colour is the rank of a 64-bit number among those of a polytope's vertices.  The
numbers are sums over the facets that a vertex meets at some distance, so they
don't depend on how vertices and facets are numbered; where two of them are equal
by chance, colours are coarser and no less canonical.
"""

from __future__ import annotations

import numpy as np

PAD = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers whose output bits depend on all input bits."""
    x = np.asarray(x).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def coded(pairing: np.ndarray, vertices: np.ndarray, facets: np.ndarray) -> np.ndarray:
    """Numbers for the distances of a stack of pairings (polytope, vertex, facet); 0 beyond the polytope's own vertices and facets."""
    out = mixed(pairing) | np.uint64(1)
    live = (np.arange(pairing.shape[1]) < vertices[:, None])[:, :, None] & (np.arange(pairing.shape[2]) < facets[:, None])[:, None, :]
    return np.where(live, out, np.uint64(0))


def ranked(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each of the first ``n`` keys of a row among the distinct ones, and how many these are; the others come last."""
    keys = np.where(np.arange(keys.shape[1]) < n[:, None], keys, PAD)
    order = np.argsort(keys, axis=1, kind="stable")
    ascending = np.take_along_axis(keys, order, 1)
    rank = np.zeros(keys.shape, np.int64)
    np.cumsum(ascending[:, 1:] != ascending[:, :-1], axis=1, out=rank[:, 1:])
    out = np.empty_like(rank)
    np.put_along_axis(out, order, rank, 1)
    return out, rank[np.arange(len(n)), n - 1] + 1


def refined(codes: np.ndarray, colours: np.ndarray, n: np.ndarray, rounds: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Colours (polytope, vertex) refined until none splits, or for some rounds; and the number of colours."""
    colours, count = ranked(colours.astype(np.uint64), n)
    going, step = np.arange(len(n)), 0
    while len(going) and (rounds is None or step < rounds):
        step += 1
        some, c = codes[going], mixed(colours[going])
        facet = mixed(np.einsum("jvf,jv->jf", some, c))
        new, many = ranked(np.einsum("jvf,jf->jv", some, facet) * np.uint64(3) + c, n[going])
        more = many > count[going]
        colours[going[more]], count[going[more]] = new[more], many[more]
        going = going[more & (many < n[going])]
    return colours, count


def leaves(codes: np.ndarray, n: np.ndarray, most: int, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Polytope and vertex order of all ends of the search by refinement and individualisation.

    The set of orders of a polytope is the same, whatever the numbering.  A polytope
    with more than ``most`` of them is an error.
    """
    width = codes.shape[1]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    seen = np.zeros(len(n), np.int64)
    stack = [(np.arange(len(n))[k : k + step], np.zeros((len(n[k : k + step]), width), np.int64)) for k in range(0, len(n), step)]
    while stack:
        who, colours = stack.pop()
        colours, count = refined(codes[who], colours, n[who])
        done = count == n[who]
        found.append((who[done], np.argsort(colours[done], axis=1, kind="stable")))
        seen += np.bincount(who[done], minlength=len(n))
        if seen.max(initial=0) > most:
            raise ValueError("a polytope has too many symmetric vertex orders")
        who, colours = who[~done], colours[~done]
        if not len(who):
            continue
        # The first colour that several vertices have; each of them in turn goes before the others.
        ascending = np.sort(colours, axis=1)
        again = (ascending[:, 1:] == ascending[:, :-1]) & (np.arange(1, width) < n[who][:, None])
        cell = ascending[np.arange(len(who)), again.argmax(1)]
        job, vertex = np.nonzero((colours == cell[:, None]) & (np.arange(width) < n[who][:, None]))
        child = colours[job] * 2 + 1
        child[np.arange(len(job)), vertex] = 2 * cell[job]
        stack += [(who[job[k : k + step]], child[k : k + step]) for k in range(0, len(job), step)]
    return np.concatenate([w for w, _ in found]), np.concatenate([o for _, o in found])
