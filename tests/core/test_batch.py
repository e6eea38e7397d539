import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from polycat.kernel import batch, canonical, colours
from polycat.kernel.exact import hermite
from polycat.kernel.polytope import hull, lattice_points
from polycat.operators import classify

weights = st.lists(st.integers(1, 30), min_size=6, max_size=6).map(tuple)


@settings(max_examples=40, deadline=None)
@given(st.lists(weights, min_size=1, max_size=12))
def test_both_kernels_say_the_same(systems):
    asked = [((w,), (sum(w),)) for w in systems]
    assert classify.array_batch(asked) == classify.exact_batch(asked)


@settings(max_examples=60, deadline=None)
@given(weights)
def test_corner_points(w):
    down = -np.sort(-np.array([w], np.int64))
    down //= np.gcd.reduce(down, axis=1)[:, None]
    total, _, x = batch.corner_points(down, down.sum(1))
    assert ((x >= 0).all(1) & (x @ down[0] == down.sum())).all()
    points = lattice_points(down.tolist(), down.sum(1).tolist())
    assert total.tolist() == [len(points)]
    c = batch.coordinates(down)[0]
    both = hull((x - 1) @ c.T), hull(points)
    assert (both[0] is None) == (both[1] is None)
    if both[0] is not None:
        assert (canonical.normal_form(both[0]) == canonical.normal_form(both[1])).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(*[st.integers(-4, 4)] * 5), min_size=1, max_size=25), min_size=1, max_size=6))
def test_hulls_of_any_points(sets):
    points = [np.array(sorted(set(s)), np.int64) for s in sets]
    h = batch.hulls(np.concatenate(points), np.repeat(np.arange(len(points)), [len(p) for p in points]), len(points))
    for k, p in enumerate(points):
        want = hull(p)
        assert (h.kind[k] == batch.FULL) == (want is not None)
        if want is not None:
            assert sorted(map(tuple, h.vertices[k, : h.nv[k]].tolist())) == sorted(map(tuple, want.vertices.tolist()))
            assert sorted(map(tuple, h.facets[k, : h.nf[k]].tolist())) == sorted((*n, d) for n, d in zip(want.normals.tolist(), want.distances.tolist(), strict=True))


def test_what_is_too_large_goes_to_the_exact_kernel(monkeypatch):
    systems = [((w,), (sum(w),)) for w in [(1, 1, 1, 3, 4, 4), (1, 3, 9, 27, 77, 117), (45, 56, 60, 70, 84, 105)]]
    want = classify.exact_batch(systems)
    assert classify.array_batch(systems) == want
    for name, value in (("MOST_VERTICES", 8), ("FITS", 2.0**10), ("MOST_POINTS", 1)):
        with monkeypatch.context() as m:
            m.setattr(batch, name, value)
            assert classify.array_batch(systems) == want
    # Sizes at which the array kernel itself gives up.
    assert batch.classified(np.array([[2**40, 2**40, 1, 1, 1, 1]]), 100) == [False]
    rng = np.random.default_rng(2)
    far = rng.integers(-(2**40), 2**40, (40, 5))
    assert batch.hulls(far, np.zeros(40, np.int64), 1).kind.tolist() == [batch.UNKNOWN]
    assert classify.array_batch([((), ()), (((1, 1, 1, 1, 1, 1),), (7,)), (((0, 1, 1, 1, 1, 1),), (5,))]) == [None] * 3
    combined = (((1, 1, 1, 0, 0, 0, 0), (0, 0, 0, 1, 1, 1, 1)), (3, 4))
    assert classify.array_batch([combined]) == classify.exact_batch([combined])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.lists(st.integers(-6, 6), min_size=4, max_size=4), min_size=3, max_size=3), min_size=1, max_size=5))
def test_hermite_forms(stack):
    m = np.array([x for x in stack if np.linalg.matrix_rank(np.array(x)) == 3] or [np.eye(3, 4)], np.int64)
    forms, wide = batch.hermite_forms(m)
    assert not wide.any() and all((f == hermite(x)).all() for f, x in zip(forms, m, strict=True))


def test_colours_dont_depend_on_numbering():
    rng = np.random.default_rng(3)
    p = hull(lattice_points([[1, 1, 2, 2, 2, 4]], [12]))
    first = canonical.refined(p.pairing, canonical.first_colours(p.pairing))
    for _ in range(5):
        rows, columns = rng.permutation(len(p.pairing)), rng.permutation(p.pairing.shape[1])
        other = p.pairing[rows][:, columns]
        assert (canonical.refined(other, canonical.first_colours(other)) == first[rows]).all()
    padded = np.zeros((2, 9, 8), np.int64)
    padded[0, :6, :6] = padded[1, :6, :6] = p.pairing
    who, order = colours.leaves(colours.coded(padded, np.array([6, 6]), np.array([6, 6])), np.array([6, 6]), 1000, 5)
    each = [sorted(tuple(o[:6]) for o in order[who == k]) for k in (0, 1)]
    assert each[0] == each[1] == sorted(map(tuple, canonical.orders(p.pairing)))
    with pytest.raises(ValueError, match="too many"):
        colours.leaves(colours.coded(padded, np.array([6, 6]), np.array([6, 6])), np.array([6, 6]), 3)


def test_corpus_of_many_kinds():
    r = random.Random(6)
    systems = [((tuple(r.choice([1, 2, 3, 5, 8, 13, 40, 90]) for _ in range(6)),), ()) for _ in range(150)]
    assert classify.array_batch(systems) == classify.exact_batch(systems)
