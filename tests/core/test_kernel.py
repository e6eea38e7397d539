import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from polycat.kernel import canonical as C
from polycat.kernel import exact as E
from polycat.kernel.hodge import dual, hodge_numbers, points_in
from polycat.kernel.polytope import hull, kernel_coordinates, lattice_points
from tests.core.bases import moved

# weights: points, vertices, facets, reflexive
FACTS = {
    (1, 1, 1, 1, 1, 1): (462, 6, 6, True),
    (1, 1, 2, 2, 2, 4): (462, 6, 6, True),
    (1, 1, 1, 3, 4, 4): (651, 14, 8, True),
    (1, 1, 2, 2, 2, 6): (651, 10, 7, True),
    (1, 1, 1, 1, 1, 2): (496, 10, 7, False),
    (1, 1, 1, 1, 2, 3): (575, 10, 7, False),
    (1, 1, 1, 2, 2, 3): (489, 10, 7, False),
    (1, 1, 1, 1, 2, 5): (918, 13, 8, False),
    (1, 3, 9, 27, 77, 117): (5901, 9, 8, True),
    (45, 56, 60, 70, 84, 105): (21, 8, 8, True),
}


def made(w):
    return hull(lattice_points([list(w)], [sum(w)]))


@pytest.mark.parametrize("w", FACTS)
def test_known_polytopes(w):
    points = lattice_points([list(w)], [sum(w)])
    p = hull(points)
    assert (len(points), len(p.vertices), len(p.normals), p.reflexive) == FACTS[w]
    assert p.interior
    values = points @ p.normals.T + p.distances
    assert (values >= 0).all() and (p.pairing >= 0).all()
    # Each facet is spanned by its vertices, each vertex cut out by its facets.
    assert all(np.linalg.matrix_rank(p.vertices[sorted(f)] - p.vertices[min(f)]) == 4 for f in p.incidence)
    assert all(np.linalg.matrix_rank(p.normals[row == 0]) == 5 for row in p.pairing)


def test_volumes_of_the_two_simplices():
    one, two = made((1, 1, 1, 1, 1, 1)), made((1, 1, 2, 2, 2, 4))
    assert one.volume == two.volume == 7776
    assert C.normal_form(one).tolist() != C.normal_form(two).tolist()
    assert C.isomorphism(one, two) == C.INEQUIVALENT


@pytest.mark.parametrize("w", [w for w in FACTS if w != (1, 1, 1, 1, 1, 1)])
def test_invariant_under_maps_and_renumbering(w):
    rng = np.random.default_rng(sum(w))
    p = made(w)
    form, keys = C.normal_form(p), C.layers(p)
    for _ in range(5):
        q = hull(moved(p.vertices, rng))
        assert (C.normal_form(q) == form).all()
        assert C.layers(q) == keys
        assert C.isomorphism(p, q) == C.EQUIVALENT
    assert len(C.normal_form_bytes(form)) == 8 * 5 * len(p.vertices)
    again = hull(np.array(form.tolist()).T)
    assert (C.normal_form(again) == form).all()


def test_large_coordinates_stay_exact():
    rng = np.random.default_rng(3)
    p = made((1, 1, 1, 3, 4, 4))
    far = p.vertices
    for _ in range(5):
        far = moved(far, rng)
    assert np.abs(far).max() > 100
    assert C.layers(hull(far)) == C.layers(p)


def test_order_and_factor_of_weights_dont_matter():
    assert (C.normal_form(made((1, 1, 1, 1, 2, 2))) == C.normal_form(made((1, 1, 2, 2, 1, 1)))).all()
    assert (C.normal_form(made((2, 2, 2, 2, 4, 4))) == C.normal_form(made((1, 1, 1, 1, 2, 2)))).all()


def test_no_polytope_without_interior_or_dimension():
    assert made((1, 1, 1, 1, 1, 6)) is None or not made((1, 1, 1, 1, 1, 6)).interior
    assert hull(np.zeros((9, 5), np.int64)) is None
    flat = np.zeros((40, 5), np.int64)
    flat[:, :4] = np.random.default_rng(0).integers(-3, 4, (40, 4))
    assert hull(flat) is None


def test_a_combined_system_is_a_product():
    # Two rows of three coordinates each leave 4 dimensions, as P2 x P2; one of 3 and one of 4 leave 5.
    rows = [[1, 1, 1, 0, 0, 0, 0], [0, 0, 0, 1, 1, 1, 1]]
    points = lattice_points(rows, [3, 4])
    assert points.shape == (10 * 35, 5)
    p = hull(points)
    assert (len(p.vertices), len(p.normals), p.reflexive) == (12, 7, True)
    shared = [[1, 1, 1, 1, 0, 0, 0], [0, 0, 0, 1, 1, 1, 1]]
    got = lattice_points(shared, [4, 4])
    brute = [x for x in np.ndindex(*[5] * 7) if sum(x[:4]) == 4 and sum(x[3:]) == 4]
    assert len(got) == len(brute) == len({tuple(r) for r in got.tolist()})
    assert len(kernel_coordinates(shared)) == 5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-9, 9), min_size=4, max_size=4), min_size=4, max_size=4))
def test_exact_algebra(rows):
    d = E.determinant(rows)
    assert d == round(np.linalg.det(np.array(rows, float)))
    assert E.determinants(np.array([rows, rows[::-1]])).tolist() == [d, d]
    h = E.hermite(np.array(rows))
    assert abs(E.determinant(h.tolist())) == abs(d)
    factors = E.smith_factors(rows)
    assert all(b % a == 0 for a, b in zip(factors, factors[1:], strict=False))
    if d:
        assert int(np.prod([int(f) for f in factors])) == abs(d)
        assert (E.hermite(h) == h).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 200), min_size=2, max_size=6))
def test_unimodular_completion(w):
    u = E.unimodular_with_gcd(w)
    image = [sum(a * int(u[i, j]) for i, a in enumerate(w)) for j in range(len(w))]
    assert image == [int(np.gcd.reduce(w))] + [0] * (len(w) - 1)
    assert (E.inverse_unimodular(u) @ u == np.eye(len(w), dtype=object)).all()


def test_candidate_counts():
    from itertools import combinations_with_replacement

    want = {6: (1, 1, 1), 7: (1, 1, 0), 8: (2, 2, 2), 9: (3, 3, 2), 10: (5, 5, 4), 11: (6, 5, 2), 12: (9, 9, 9), 13: (12, 10, 6)}
    for degree, counts in want.items():
        some = [w for w in combinations_with_replacement(range(1, degree), 6) if sum(w) == degree and 2 * w[-1] <= degree and np.gcd.reduce(w) == 1]
        made_ = [p for p in map(made, some) if p is not None and p.interior]
        assert (len(some), len(made_), sum(p.reflexive for p in made_)) == counts


@pytest.mark.parametrize("w, h", [((1, 1, 1, 1, 1, 1), (1, 0, 426, 1752, 2610)), ((1, 1, 1, 1, 8, 12), (2, 0, 3878, 15564, 23328)), ((45, 56, 60, 70, 84, 105), (34, 18, 24, 240, 288))])
def test_hodge_numbers(w, h):
    p = made(w)
    got = hodge_numbers(p)
    assert tuple(got[k] for k in ("h11", "h12", "h13", "h22", "chi")) == h
    assert got["point_count"] == len(lattice_points([list(w)], [sum(w)]))
    mirror = hodge_numbers(dual(p))
    assert (mirror["h11"], mirror["h12"], mirror["h13"]) == (h[2], h[1], h[0])
    with pytest.raises(ValueError):
        dual(made((1, 1, 1, 1, 1, 2)))


def test_points_of_a_hull():
    rng = np.random.default_rng(4)
    for _ in range(5):
        p = hull(rng.integers(-2, 3, (9, 4)))
        if p is None:
            continue
        box = np.array(list(np.ndindex(*[7] * 4))) - 3
        inside = box[((box @ p.normals.T + p.distances) >= 0).all(1)]
        assert sorted(map(tuple, points_in(p.vertices).tolist())) == sorted(map(tuple, inside.tolist()))


def test_more_layers_are_invariant():
    rng = np.random.default_rng(7)
    for w in [(1, 1, 1, 1, 1, 1), (1, 1, 1, 1, 1, 2), (1, 1, 1, 3, 4, 4)]:
        p = made(w)
        q = hull(moved(p.vertices, rng))
        assert C.layers(p, ("Lcc",)) == C.layers(q, ("Lcc",))
    one, two = made((1, 1, 1, 1, 1, 2)), made((1, 1, 1, 1, 2, 3))
    assert C.layers(one, ("Lcc",)) != C.layers(two, ("Lcc",))
    # The reference of cocircuits, a subset at a time.
    p = made((1, 1, 2, 2, 2, 6))
    from collections import Counter
    from itertools import combinations

    seen, counts = C.first_colours(p.pairing).tolist(), Counter()
    h, kinds = [[1, *v] for v in p.vertices.tolist()], sorted(set(seen))
    for b in combinations(range(len(h)), 5):
        side = {j: np.sign(E.determinant([h[i] for i in b] + [h[j]])) for j in range(len(h)) if j not in b}
        if any(side.values()):
            inside, *sides = ([sum(1 for j, s in side.items() if seen[j] == c and s == k) for c in kinds] for k in (0, 1, -1))
            counts[json.dumps([inside, *sorted(sides)])] += 1

    assert sum(counts.values()) > 0
    assert C.cocircuit_digest(p) == C.digest([[seen.count(c) for c in kinds], sorted([json.loads(k), n] for k, n in counts.items())])


def test_chirotope_counts():
    for w in [(1, 1, 1, 1, 1, 1), (1, 1, 2, 2, 2, 6)]:
        p = made(w)
        from itertools import combinations

        v = sorted(p.vertices.tolist())
        signs = [np.sign(E.determinant([[1, *v[i]] for i in b])) for b in combinations(range(len(v)), 6)]
        assert C.chirotope_counts(p.vertices) == (signs.count(1), signs.count(-1), signs.count(0))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-9, 9), min_size=5, max_size=5), min_size=1, max_size=4))
def test_integer_kernel(rows):
    k = E.integer_kernel(rows)
    m = np.array(rows, dtype=object)
    assert len(k) == 5 - len(E.smith_factors(rows))
    assert all((m @ v == 0).all() and np.gcd.reduce(v.astype(np.int64)) == 1 for v in k)
    assert len(E.smith_factors(k.tolist())) == len(k)


#: What the normal forms were when this was written: a change would make kept catalogues and new ones differ.
PINNED = {
    (1, 1, 1, 1, 1, 1): "3d4e13224c519611",
    (1, 1, 2, 2, 2, 4): "ab328824334fa403",
    (1, 1, 1, 3, 4, 4): "be217000e1ec5e2a",
    (1, 1, 2, 2, 2, 6): "17c99b9ac70b06af",
    (1, 1, 1, 1, 1, 2): "fbb52f555a60e0f8",
    (1, 1, 1, 1, 2, 3): "8d9ec3c8b70ab7ea",
    (1, 1, 1, 2, 2, 3): "0098107e311875a2",
    (1, 1, 1, 1, 2, 5): "183ebf2ac369bdcc",
    (1, 3, 9, 27, 77, 117): "6b6d39462004e9cc",
    (45, 56, 60, 70, 84, 105): "873710ec3f6adb4b",
}


def test_normal_forms_stay_what_they_were():
    import hashlib

    for w, digest in PINNED.items():
        assert hashlib.sha256(C.normal_form_bytes(C.normal_form(made(w)))).hexdigest().startswith(digest), w


def test_isomorphism_agrees_with_normal_forms():
    """The search by vertices against the canonical form, over many pairs: same colours, other lattices and all."""
    rng = np.random.default_rng(11)
    forms = {}
    for w in [*FACTS, (1, 1, 1, 1, 2, 4), (1, 1, 1, 2, 2, 2), (1, 1, 1, 1, 3, 5), (1, 2, 2, 2, 3, 5)]:
        p = made(w)
        if p is not None and p.interior and len(p.vertices) <= 16:
            forms[w] = p, C.normal_form(p)
    for a, (p, one) in forms.items():
        for b, (q, two) in forms.items():
            same = one.shape == two.shape and (one == two).all()
            assert C.isomorphism(p, hull(moved(q.vertices, rng))) == (C.EQUIVALENT if same else C.INEQUIVALENT), (a, b)
    p = forms[1, 1, 1, 1, 1, 1][0]
    assert C.isomorphism(p, hull(moved(p.vertices, rng)), cap=2) == C.TOO_BIG
