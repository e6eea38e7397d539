"""Queries of the geometry kernel, with SQL where theory gives what SQL can compute.

Weight systems whose weights all divide the degree have simplices: six vertices
and facets, reflexive, as many lattice points as there are ways to write the degree,
the volume from the weights, no two systems with one polytope, and an Euler number by a
sum over twisted sectors.  SQL has all of that without a hull.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polycat.functions import weights as W
from polycat.operators import algebra, classify, enrich, fibres, generate, sieve
from polycat.operators import cascade as C
from polycat.operators import catalogue as K
from polycat.plans.derive import MANY, weight_rows
from polycat.queries import LINE_W, PART_W, _line_weights, _part_weights, _query, _table, with_rows
from polycat.schema import WEIGHTS, resolve_input
from polycat.sources.files import spread

TOP = 42

# Sorted coprime weights to degree TOP that all divide it.
DIVIDING = f"""
d AS (SELECT unnest(generate_series(6, {TOP})) AS d), v AS (SELECT d, x FROM d, generate_series(1, {TOP // 2}) s(x) WHERE d % x = 0 AND 2 * x <= d),
g AS (SELECT a.d, [a.x, b.x, c.x, e.x, f.x, h.x] AS ws FROM v a JOIN v b ON b.d = a.d AND b.x >= a.x JOIN v c ON c.d = a.d AND c.x >= b.x AND a.x + b.x + c.x < a.d
  JOIN v e ON e.d = a.d AND e.x >= c.x JOIN v f ON f.d = a.d AND f.x >= e.x JOIN v h ON h.d = a.d AND h.x >= f.x AND a.x + b.x + c.x + e.x + f.x + h.x = a.d
  WHERE gcd(gcd(gcd(gcd(gcd(a.x, b.x), c.x), e.x), f.x), h.x) = 1)"""
POINTS = """
p1 AS (SELECT ws, d - a * ws[6] AS r FROM (SELECT ws, d, unnest(generate_series(0, d // ws[6])) AS a FROM g)),
p2 AS (SELECT ws, r - a * ws[5] AS r FROM (SELECT ws, r, unnest(generate_series(0, r // ws[5])) AS a FROM p1)),
p3 AS (SELECT ws, r - a * ws[4] AS r FROM (SELECT ws, r, unnest(generate_series(0, r // ws[4])) AS a FROM p2)),
p4 AS (SELECT ws, r - a * ws[3] AS r FROM (SELECT ws, r, unnest(generate_series(0, r // ws[3])) AS a FROM p3)),
p5 AS (SELECT ws, r - a * ws[2] AS r FROM (SELECT ws, r, unnest(generate_series(0, r // ws[2])) AS a FROM p4)),
n AS (SELECT ws, count(*) AS points FROM p5 WHERE r % ws[1] = 0 GROUP BY ws)"""
VOLUME = "(d // ws[1]) * (d // ws[2]) * (d // ws[3]) * (d // ws[4]) * (d // ws[5]) * (d // ws[6]) // d"


def _dividing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of those systems as many times as there are nations, its weights in another order each time."""
    found = generate.candidates(spark, 6, TOP).where(W.gorenstein(F.col("weights")))
    turned = found.join(F.broadcast(_table(spark, sf_dir, "nation").select("n_nationkey")))  # 25 rows
    k = (F.col("n_nationkey") % 6).cast("int")
    ws = F.concat(F.slice("weights", k + 1, F.lit(6)), F.slice("weights", F.lit(1), k))
    return turned.select(F.monotonically_increasing_id().alias("source_index"), F.col("degree"), ws.alias("ws"))


def _rows(df: DataFrame) -> DataFrame:
    return resolve_input(df.select("source_index", *(F.get("ws", F.lit(k)).cast("int").alias(c) for k, c in enumerate(WEIGHTS))))


def _sorted() -> Column:
    return W.shown(F.array_sort(F.array(*(F.col(c).cast("bigint") for c in WEIGHTS))))


@_query(f"WITH {DIVIDING}, {POINTS} SELECT array_to_string(g.ws, ' ') AS weights, 25::BIGINT AS count, 6 AS vertex_count, 6 AS facet_count, n.points::INTEGER AS point_count FROM g JOIN n ON n.ws = g.ws")
def nf_simplices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of simplices from weights in many orders, the kernel on every row: classes, counts, vertices, facets, points."""
    found = K.catalogue(_rows(_dividing(spark, sf_dir)), presort=False, remember=False)
    return found.select(_sorted().alias("weights"), "count", "vertex_count", "facet_count", "point_count")


@_query(f"WITH {DIVIDING}, {POINTS} SELECT array_to_string(g.ws, ' ') AS weights, n.points::INTEGER AS point_count, 6 AS vertex_count, 6 AS facet_count FROM g JOIN n ON n.ws = g.ws")
def nf_simplices_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the exact kernel, merged before."""
    found = K.catalogue(_rows(_dividing(spark, sf_dir)), backend="exact")
    return found.select(_sorted().alias("weights"), "point_count", "vertex_count", "facet_count")


def _simplex_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    tried = K.classified(_rows(_dividing(spark, sf_dir)), WEIGHTS).where("ok")
    return tried.select(_sorted().alias("weights"), "nf", "nf_key", "point_count")


# The Euler number as a sum over pairs of twists l and r: the weights that both leave alone give (w - d) / w each.
EULER = """
e AS (SELECT ws, d, round(sum(f) / d)::BIGINT AS chi FROM (
  SELECT ws, d, list_reduce(list_prepend(1.0::DOUBLE, list_transform(ws, lambda w: CASE WHEN l * w % d = 0 AND r * w % d = 0 THEN (w - d) / w::DOUBLE ELSE 1.0::DOUBLE END)), lambda a, b: a * b) AS f
  FROM (SELECT ws, d, l, unnest(generate_series(0, d - 1)) AS r FROM (SELECT ws, d, unnest(generate_series(0, d - 1)) AS l FROM g))) GROUP BY ws, d)"""


@_query(f"WITH {DIVIDING}, {EULER} SELECT array_to_string(ws, ' ') AS weights, true AS reflexive, chi, true AS consistent FROM e")
def hodge_simplices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Euler numbers of simplices by points of faces and dual faces, against SQL's sum over twists."""
    found = classify.with_hodge(_simplex_forms(spark, sf_dir))
    rule = (F.col("chi") == 48 + 6 * (F.col("h11") + F.col("h13") - F.col("h12"))) & (F.col("h22") == W.hodge_h22(F.col("h11"), F.col("h12"), F.col("h13")))
    return found.select("weights", "reflexive", "chi", rule.alias("consistent"))


@_query(f"WITH {DIVIDING} SELECT array_to_string(ws, ' ') AS weights, {VOLUME} AS volume, 6::BIGINT AS vertices, 0::BIGINT AS gale_dimension FROM g")
def simplex_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised volumes of simplices from their normal forms."""
    return classify.with_volume(_simplex_forms(spark, sf_dir)).select("weights", "volume", (F.size("nf") / 5).cast("bigint").alias("vertices"), W.gale_dimension(F.size("nf") / 5).cast("bigint").alias("gale_dimension"))


@_query(f"WITH {DIVIDING}, {POINTS}, q AS (SELECT array_to_string(g.ws, ' ') AS weights, points FROM g JOIN n ON n.ws = g.ws) SELECT a.weights AS weights_a, b.weights AS weights_b, CASE WHEN a.weights = b.weights THEN 'EQUIVALENT' ELSE 'INEQUIVALENT' END AS verdict FROM q a JOIN q b ON a.points = b.points AND a.weights <= b.weights")
def gl_equiv_simplices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simplices with as many points in pairs, each also with itself in other coordinates: only these are equivalent."""
    forms = _simplex_forms(spark, sf_dir).select("weights", "point_count", "nf")
    # Another basis and order: rows 1 and 2 of the matrix are added to each other and columns turned round.
    turned = F.expr("flatten(transform(sequence(0, 4), i -> reverse(transform(sequence(0, 5), j -> nf[i * 6 + j] + if(i = 1, nf[j + 12], 0) - if(i = 3, nf[j], 0)))))")
    pairs = forms.select("point_count", F.col("weights").alias("weights_a"), F.col("nf").alias("nf_a")).join(forms.select("point_count", F.col("weights").alias("weights_b"), turned.alias("nf_b")), "point_count").where("weights_a <= weights_b")
    return classify.isomorphic_pairs(pairs).select("weights_a", "weights_b", "verdict")


@_query(f"WITH {DIVIDING} SELECT array_to_string(ws, ' ') AS weights, 25::BIGINT AS members, CASE WHEN {VOLUME} = d THEN 'S3' ELSE 'S4' END AS stage, array_to_string(ws, ' ') AS class_id, 'DIFFERENT' AS verdict FROM g")
def sieve_simplices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sieve on simplices: circuits tell all of them apart."""
    found = sieve.sieve(_dividing(spark, sf_dir))
    return found.select(W.shown(F.col("canonical")).alias("weights"), "members", "stage", "class_id", "verdict")


@_query()
def sieve_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sieve on the systems of part: how many each stage decides (tested against the catalogue's classes)."""
    found = sieve.sieve(_part_weights(spark, sf_dir))
    return found.groupBy("stage", "verdict").agg(F.count("*").alias("systems"), F.sum("members").cast("bigint").alias("members"))


def _short(spark: SparkSession, sf_dir: str, width: int) -> DataFrame:
    """How many rows of lineitem have each system as their first weights, sorted and over their common divisor."""
    first = F.array(*(F.col(c).cast("bigint") for c in WEIGHTS[:width]))
    return _line_weights(spark, sf_dir).groupBy(W.shown(W.canonical(first)).alias("weights")).agg(F.count("*").alias("n_rows"))


def _short_sql(width: int) -> str:
    g = "ws[1]"
    for k in range(2, width + 1):
        g = f"gcd({g}, ws[{k}])"
    return f"m AS (SELECT array_to_string(list_sort(list_transform(ws[1:{width}], lambda x: x // {g})), ' ') AS weights, count(*) AS n FROM w GROUP BY 1)"


@_query(
    f"""
WITH {LINE_W}, {_short_sql(3)}, f AS (
  SELECT d AS degree, a || ' ' || b || ' ' || (d - a - b) AS weights FROM generate_series(3, 12) s(d), generate_series(1, 4) t(a), generate_series(1, 6) u(b)
  WHERE b >= a AND d - a - b >= b AND d % a = 0 AND d % b = 0 AND d % (d - a - b) = 0 AND gcd(gcd(a, b), d) = 1)
SELECT degree, weights, coalesce(n, 0) AS n_rows FROM f LEFT JOIN m USING (weights)
"""
)
def search_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All systems of three weights by adding points, those of the elliptic curves; and how many rows of lineitem begin with each."""
    return with_rows(generate.search(spark, 3).select("degree", W.shown(F.col("weights")).alias("weights")), _short(spark, sf_dir, 3))


def _monomial(of: str, degree: str) -> str:
    """SQL: whether a degree is a sum of some weights, repeated."""
    if len(of) == 1:
        return f"({degree}) % {of} = 0"
    return f"len(list_filter(generate_series(0, ({degree}) // {of[0]}), lambda p{len(of)}: {_monomial(of[1:], f'{degree} - p{len(of)} * {of[0]}')})) > 0"


def _smooth_sql() -> str:
    """SQL: four weights whose general hypersurface has no singular point beside the origin.  The systems of four weights with an
    interior origin are known to be the 95 of these."""
    some = []
    for n in (1, 2, 3):
        for part in combinations("abcd", n):
            pure, others = _monomial("".join(part), "n"), [e for e in "abcd" if e not in part]
            mixed = [_monomial("".join(part), f"n - {e}") for e in others]
            enough = [" AND ".join(c) for c in combinations(mixed, n)]
            some.append("(" + " OR ".join([pure, *(f"({c})" for c in enough)]) + ")")
    return f"""
WITH {LINE_W}, {_short_sql(4)}, c AS (
  SELECT n, a, b, c, n - a - b - c AS d
  FROM generate_series(4, 80) s(n), generate_series(1, 20) t(a), generate_series(1, 40) u(b), generate_series(1, 40) v(c)
  WHERE a <= b AND b <= c AND c <= n - a - b - c AND 2 * (n - a - b - c) <= n AND gcd(gcd(a, b), gcd(c, n)) = 1),
f AS (SELECT n AS degree, a || ' ' || b || ' ' || c || ' ' || d AS weights FROM c WHERE {' AND '.join(some)})
SELECT degree, weights, coalesce(m.n, 0) AS n_rows FROM f LEFT JOIN m USING (weights)
"""


@_query(_smooth_sql())
def search_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 95 systems of four weights by adding points, whatever their degree; and how many rows of lineitem begin with each."""
    return with_rows(generate.search(spark, 4).select("degree", W.shown(F.col("weights")).alias("weights")), _short(spark, sf_dir, 4))


@_query()
def nf_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of all candidates to degree 40: no repeats, so the kernel runs on each."""
    found = generate.candidates(spark, 6, 40).select(F.monotonically_increasing_id().alias("source_index"), F.col("weights").alias("ws"))
    return K.catalogue(_rows(spread(found)), presort=False).select(F.lower(F.hex("nf_key")).alias("nf_key"), "count", *WEIGHTS, "vertex_count", "facet_count", "point_count")


def _rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of part with its free invariants and packed forms."""
    return _enriched(K.catalogue(weight_rows(_table(spark, sf_dir, "part"), F.col("p_partkey"), MANY)))


def _enriched(systems: DataFrame) -> DataFrame:
    return enrich.add_normal_forms(systems, verify=False).select(F.col("source_index").alias("row_id"), F.col("point_count"), F.col("vertex_count").alias("bh_mv"), F.col("facet_count").alias("bh_nv"), "nf_vertices")


@_query()
def fibre_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade with its real keys over a catalogue: free invariants, then the layers L1 and Lpm of what collides."""
    return fibres.completeness(_rich(spark, sf_dir))


@_query()
def fibre_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What that cascade leaves of the rows of part, which aren't merged before: rows of one polytope, by group (tested to be those of one catalogue key)."""
    systems = K.classified(weight_rows(_table(spark, sf_dir, "part"), F.col("p_partkey"), MANY), WEIGHTS, presort=False).where("ok").select("source_index", *WEIGHTS, "vertex_count", "facet_count", "point_count")
    left = fibres.residual(_enriched(systems))
    return left.groupBy("point_count", "bh_mv", "bh_nv", "geometry_key").agg(F.count("*").alias("members"), F.min("row_id").alias("first"))


MATRIX = "[[ws[1] - 2, ws[2], ws[3]], [ws[4], ws[5] - 4, ws[6]], [key % 5, 1, key % 3]]"


def _matrix() -> Column:
    w = lambda k: F.get("ws", F.lit(k))
    n = lambda x: F.lit(x).cast("bigint")
    return F.array(F.array(w(0) - 2, w(1), w(2)), F.array(w(3), w(4) - 4, w(5)), F.array(F.col("key") % 5, n(1), F.col("key") % 3))


DET = "m[1][1] * (m[2][2] * m[3][3] - m[2][3] * m[3][2]) - m[1][2] * (m[2][1] * m[3][3] - m[2][3] * m[3][1]) + m[1][3] * (m[2][1] * m[3][2] - m[2][2] * m[3][1])"


@_query(f"WITH {PART_W}, v AS (SELECT key, {MATRIX} AS m FROM w) SELECT key, ({DET})::BIGINT AS determinant FROM v")
def exact_determinants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part_weights(spark, sf_dir).select("key", _matrix().alias("m"))
    return algebra.with_determinant(rows, "m").select("key", "determinant")


@_query(f"WITH {PART_W}, v AS (SELECT key, gcd(gcd(ws[1], ws[2]), gcd(ws[3], key % 4)) AS g, abs(ws[1] * (key % 4) - ws[2] * ws[3]) AS d FROM w) SELECT key, CASE WHEN d = 0 THEN g::VARCHAR ELSE g || ' ' || (d // g) END AS factors FROM v")
def smith_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariant factors of 2 x 2 matrices."""
    w = lambda k: F.get("ws", F.lit(k))
    rows = _part_weights(spark, sf_dir).select("key", F.array(F.array(w(0), w(1)), F.array(w(2), F.col("key") % 4)).alias("m"))
    return algebra.with_smith_factors(rows, "m").select("key", W.shown(F.col("smith_factors")).alias("factors"))


@_query(f"WITH {PART_W}, v AS (SELECT key, ws, unnest(generate_series(2, 6)) AS k FROM w) SELECT key, k - 2 AS place, -(ws[k] // gcd(ws[1], ws[k])) AS head, ws[1] // gcd(ws[1], ws[k]) AS tail FROM v")
def integer_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors orthogonal to the weights: each has two numbers that aren't 0."""
    rows = _part_weights(spark, sf_dir).select("key", "ws", F.array("ws").alias("m"))
    found = algebra.with_integer_kernel(rows, "m").select("key", F.posexplode("integer_kernel").alias("place", "v"))
    return found.select("key", F.col("place").cast("bigint").alias("place"), F.get("v", F.lit(0)).alias("head"), F.element_at("v", (F.col("place") + 2).cast("int")).alias("tail"))


@_query(f"WITH {PART_W}, v AS (SELECT key, list_sort([[ws[1], ws[4]], [ws[2], ws[5]], [ws[3], ws[6]]]) AS p FROM w) SELECT key, p[1][1] || ',' || p[1][2] || ' ' || p[2][1] || ',' || p[2][2] || ' ' || p[3][1] || ',' || p[3][2] AS points FROM v")
def canonical_point_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a 2 x 3 matrix as a sorted set of points."""
    points = F.transform(fibres.canonical_points(F.col("ws"), 2), lambda p: F.array_join(F.transform(p, lambda x: x.cast("string")), ","))
    return _part_weights(spark, sf_dir).select("key", F.array_join(points, " ").alias("points"))
