"""Column functions on weight arrays (``array<bigint>``): no Python runs on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(weights: Column) -> Column:
    """The degree: the sum of the weights."""
    return F.aggregate(weights, F.lit(0).cast("bigint"), lambda a, x: a + x)


def common_divisor(weights: Column) -> Column:
    """The greatest common divisor, by Euclid's steps.

    The steps end after at most 4.8 decimal digits' worth of the smaller number and
    two; most rows are done with the first weights, since a divisor of 1 stays.
    """

    def pair(a: Column, b: Column) -> Column:
        start = F.struct(a.alias("a"), b.alias("b"))
        step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.when(s["b"] != 0, s["a"] % s["b"]).alias("b")))
        steps = F.ceil(4.8 * F.log10(F.greatest(F.least(a, b), F.lit(1)).cast("double"))).cast("int") + 2
        return F.aggregate(F.sequence(F.lit(1), steps), start, step)["a"]

    return F.when(F.exists(weights, lambda x: x == 1), F.lit(1).cast("bigint")).otherwise(F.aggregate(weights, F.lit(0).cast("bigint"), lambda a, x: F.when(a == 1, a).otherwise(pair(x, a))))


def _each_with(weights: Column, value: Column, f) -> Column:
    """f(weight, value) of each weight; the value is computed once, not in a lambda for each."""
    return F.zip_with(weights, F.array_repeat(value, F.size(weights)), f)


def reduced(weights: Column) -> Column:
    """The weights over their greatest common divisor."""
    return _each_with(weights, common_divisor(weights), lambda x, g: F.call_function("div", x, g).cast("bigint"))


def canonical(weights: Column) -> Column:
    """Sorted and reduced: equal for weight systems that differ by order or a factor."""
    return F.array_sort(reduced(weights))


def shown(weights: Column) -> Column:
    """The weights as text, for keys that SQL can compare."""
    return F.array_join(F.transform(weights, lambda x: x.cast("string")), " ")


def ones(weights: Column) -> Column:
    return F.size(F.filter(weights, lambda x: x == 1)).cast("bigint")


def distinct(weights: Column) -> Column:
    return F.size(F.array_distinct(weights)).cast("bigint")


def multiplicities(weights: Column) -> Column:
    """How often each distinct weight occurs, largest first."""
    each = F.transform(F.array_distinct(weights), lambda x: F.size(F.filter(weights, lambda y: y == x)).cast("bigint"))
    return F.reverse(F.array_sort(each))


def gorenstein(weights: Column) -> Column:
    """Whether every weight divides the degree."""
    divides = _each_with(weights, total(weights), lambda x, d: (x > 0) & (d % F.when(x != 0, x) == 0))
    return F.forall(divides, lambda x: x)


def may_be_interior(weights: Column) -> Column:
    """A necessary condition for an interior origin: no weight above half the degree."""
    return 2 * F.array_max(weights) <= total(weights)


def normalised_degree(weights: Column, degree: Column) -> Column:
    """The degree of a row of a combined system: its sum where 0 is given, null where the row is no good.

    A row is no good if a weight is negative, the sum isn't positive, or another
    degree is given than the sum.
    """
    s = total(weights)
    good = F.forall(weights, lambda x: x >= 0) & (s > 0) & ((degree == 0) | (degree == s))
    return F.when(good, s)


def point_count(weights: Column) -> Column:
    """The number of lattice points of the polytope: ways to write the degree as a sum of weights.

    One array of counts by partial sum is folded over the weights, in the row;
    nothing is exploded or shuffled.
    """
    d = total(weights)
    start = F.transform(F.sequence(F.lit(0).cast("bigint"), d), lambda k: F.when(k == 0, 1).otherwise(0).cast("bigint"))

    def add(ways: Column, w: Column) -> Column:
        def at(k: Column) -> Column:
            return F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.floor(k / w)), F.lit(0).cast("bigint"), lambda a, j: a + F.element_at(ways, (k - j * w + 1).cast("int")))

        return F.transform(F.sequence(F.lit(0).cast("bigint"), d), at)

    return F.element_at(F.aggregate(weights, start, add), -1)


def hodge_h22(h11: Column, h12: Column, h13: Column) -> Column:
    """The middle Hodge number of a fourfold from the others."""
    return 44 + 4 * h11 - 2 * h12 + 4 * h13


def gale_dimension(vertices: Column) -> Column:
    return vertices - 6
