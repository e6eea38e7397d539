"""The registered queries of the engine over the driver's tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polycat.functions import weights as W
from polycat.operators import buckets
from polycat.operators import cascade as C
from polycat.operators import catalogue as K
from polycat.operators import classify, enrich, generate, points, sampling
from polycat.plans.derive import FEW, MANY, weight_rows, weights_of, weights_sql
from polycat.schema import WEIGHTS, profile_of_structure
from polycat.sources import sinks
from polycat.sources.files import spread
from polycat.storage import Workspace
from polycat.streaming import incremental

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _all() -> None:
    from polycat import queries_files, queries_geometry  # noqa: F401, they register theirs


def queries() -> dict:
    _all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE_KEY = "l_orderkey * 8 + l_linenumber"

# The derived weights of part and of lineitem, as SQL.
PART_W = f"w AS (SELECT p_partkey AS key, {weights_sql('p_partkey', MANY)} AS ws FROM part)"
FEW_W = f"w AS (SELECT p_partkey AS key, {weights_sql('p_partkey', FEW)} AS ws FROM part)"
LINE_W = f"w AS (SELECT {LINE_KEY} AS key, l_orderkey % 8 AS shard, {weights_sql(LINE_KEY, MANY)} AS ws FROM lineitem)"
SHOWN = "array_to_string(list_sort(ws), ' ')"
FIRST = ", ".join(f"arg_min(ws[{k + 1}], key)::INTEGER AS weight{k}" for k in range(6))


def _part_weights(spark: SparkSession, sf_dir: str, moduli: tuple = MANY) -> DataFrame:
    keys = spread(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key")))
    return keys.select("key", weights_of(F.col("key"), moduli).alias("ws"))


def _line_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.expr(f"cast({LINE_KEY} as bigint)")
    keys = spread(_table(spark, sf_dir, "lineitem").select(key.alias("source_index"), (F.col("l_orderkey") % 8).alias("shard")))
    df = keys.select("source_index", "shard", weights_of(F.col("source_index"), MANY).alias("ws"))
    return df.select("source_index", "shard", W.shown(F.array_sort("ws")).alias("key"), *(F.get("ws", F.lit(k)).cast("int").alias(c) for k, c in enumerate(WEIGHTS)))


@_query(
    f"""
WITH {PART_W}, s AS (SELECT key, list_sort(ws) AS s, list_sum(ws)::BIGINT AS degree, list_sort(list_distinct(ws)) AS d FROM w)
SELECT key, degree, array_to_string(s, ' ') AS canonical, len(d)::BIGINT AS n_distinct,
       len(list_filter(s, lambda x: x = 1))::BIGINT AS n_ones,
       array_to_string(list_reverse_sort(list_transform(d, lambda x: len(list_filter(s, lambda y: y = x)))), ' ') AS multiplicities,
       list_bool_and(list_transform(s, lambda x: degree % x = 0)) AS gorenstein, 2 * s[6] <= degree AS may_be_interior
FROM s
"""
)
def ws_degree_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = F.col("ws")
    return _part_weights(spark, sf_dir).select(
        "key",
        W.total(ws).alias("degree"),
        W.shown(W.canonical(ws)).alias("canonical"),
        W.distinct(ws).alias("n_distinct"),
        W.ones(ws).alias("n_ones"),
        W.shown(W.multiplicities(ws)).alias("multiplicities"),
        W.gorenstein(ws).alias("gorenstein"),
        W.may_be_interior(ws).alias("may_be_interior"),
    )


SIGNED = "list_transform(ws, lambda x: CASE WHEN key % 11 = 0 THEN x - 2 ELSE x END)"


@_query(
    f"""
WITH {PART_W}, v AS (SELECT key, {SIGNED} AS s, key % 50 AS structure_id,
    CASE WHEN key % 5 = 0 THEN 0 WHEN key % 7 = 0 THEN list_sum({SIGNED})::BIGINT + 1 ELSE list_sum({SIGNED})::BIGINT END AS given FROM w)
SELECT key, CASE WHEN list_min(s) >= 0 AND list_sum(s) > 0 AND given IN (0, list_sum(s)) THEN list_sum(s)::BIGINT ELSE -1 END AS degree,
  (CASE WHEN structure_id <= 1 THEN 1 WHEN structure_id <= 3 THEN 2 WHEN structure_id <= 7 THEN 3 WHEN structure_id <= 14 THEN 4
        WHEN structure_id <= 32 THEN 5 WHEN structure_id <= 45 THEN 6 WHEN structure_id <= 47 THEN 7 ELSE 0 END)::INTEGER AS profile_id
FROM v
"""
)
def ws_v2_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = F.when(F.col("key") % 11 == 0, F.transform("ws", lambda x: x - 2)).otherwise(F.col("ws"))
    rows = _part_weights(spark, sf_dir).select("key", signed.alias("s"))
    s = F.col("s")
    given = F.when(F.col("key") % 5 == 0, 0).when(F.col("key") % 7 == 0, W.total(s) + 1).otherwise(W.total(s))
    return rows.select("key", F.coalesce(W.normalised_degree(s, given), F.lit(-1)).cast("bigint").alias("degree"), profile_of_structure(F.col("key") % 50).alias("profile_id"))


@_query(
    f"""
WITH {FEW_W}, c AS (SELECT DISTINCT list_sort(ws) AS s, list_sum(ws)::BIGINT AS d FROM w),
p1 AS (SELECT s, d - a * s[6] AS r FROM (SELECT s, d, unnest(generate_series(0, d // s[6])) AS a FROM c)),
p2 AS (SELECT s, r - a * s[5] AS r FROM (SELECT s, r, unnest(generate_series(0, r // s[5])) AS a FROM p1)),
p3 AS (SELECT s, r - a * s[4] AS r FROM (SELECT s, r, unnest(generate_series(0, r // s[4])) AS a FROM p2)),
p4 AS (SELECT s, r - a * s[3] AS r FROM (SELECT s, r, unnest(generate_series(0, r // s[3])) AS a FROM p3)),
p5 AS (SELECT s, r - a * s[2] AS r FROM (SELECT s, r, unnest(generate_series(0, r // s[2])) AS a FROM p4)),
n AS (SELECT s, count(*) AS points FROM p5 WHERE r % s[1] = 0 GROUP BY s)
SELECT w.key, n.points FROM w JOIN n ON n.s = list_sort(w.ws)
"""
)
def ws_point_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_weights(spark, sf_dir, FEW).select("key", W.point_count(W.canonical(F.col("ws"))).alias("points"))


@_query(SQL["ws_point_count"].replace(FEW_W, PART_W))
def ws_point_count_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of all systems of part, by partial sums along residues."""
    return points.with_point_count(_part_weights(spark, sf_dir), "ws").select("key", "points")


@_query(
    f"""
WITH {LINE_W}, m AS (SELECT {SHOWN} AS k, count(*) AS n FROM w GROUP BY 1), d AS (SELECT unnest(generate_series(6, 24)) AS degree),
a AS (SELECT degree, unnest(generate_series(1, degree // 6)) AS w0 FROM d),
b AS (SELECT *, unnest(generate_series(w0, (degree - w0) // 5)) AS w1 FROM a),
c AS (SELECT *, unnest(generate_series(w1, (degree - w0 - w1) // 4)) AS w2 FROM b),
e AS (SELECT *, unnest(generate_series(w2, (degree - w0 - w1 - w2) // 3)) AS w3 FROM c),
f AS (SELECT *, unnest(generate_series(w3, (degree - w0 - w1 - w2 - w3) // 2)) AS w4 FROM e),
g AS (SELECT *, degree - w0 - w1 - w2 - w3 - w4 AS w5 FROM f)
SELECT degree, array_to_string([w0, w1, w2, w3, w4, w5], ' ') AS weights, coalesce(m.n, 0) AS n_rows
FROM g LEFT JOIN m ON m.k = array_to_string([w0, w1, w2, w3, w4, w5], ' ')
WHERE w5 >= w4 AND 2 * w5 <= degree AND gcd(gcd(gcd(gcd(gcd(w0, w1), w2), w3), w4), w5) = 1
"""
)
def ip_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates to degree 24, and how many rows of lineitem each is of."""
    have = _line_weights(spark, sf_dir).groupBy(F.col("key").alias("weights")).agg(F.count("*").alias("n_rows"))
    return with_rows(generate.candidates(spark, 6, 24).select("degree", W.shown(F.col("weights")).alias("weights")), have)


def with_rows(found: DataFrame, have: DataFrame) -> DataFrame:
    """Generated systems with the number of a table's rows that are of each, 0 where there are none."""
    return found.join(have, "weights", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)).cast("bigint"))


@_query(f"WITH {LINE_W} SELECT {SHOWN} AS key, count(*) AS count, min(key) AS source_index, {FIRST} FROM w GROUP BY {SHOWN}")
def dedup_count_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.count_first(_line_weights(spark, sf_dir), ["key"], WEIGHTS)


@_query(SQL["dedup_count_first"])
def run_spill_then_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _line_weights(spark, sf_dir)
    # A run for each of 8 shards, a catalogue for each of 2 nodes, one of all; runs are keyed by shard in one pass.
    runs = K.count_first(rows, ["shard", "key"], WEIGHTS).select("shard", "key", "count", "source_index", *WEIGHTS)
    nodes = K.count_first(runs.withColumn("node", F.col("shard") % 2), ["node", "key"], WEIGHTS, count=F.col("count")).select("node", "key", "count", "source_index", *WEIGHTS)
    return K.merge(*(nodes.where(F.col("node") == k).drop("node") for k in (0, 1)), key=["key"])


@_query(SQL["dedup_count_first"])
def incremental_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _line_weights(spark, sf_dir).withColumnRenamed("shard", "file")
    done = rows.where("file < 5")
    before = K.count_first(done, ["key"], WEIGHTS)
    # The whole range once more: what the ledger has is left out.
    after, _ = K.resume(before, done.select("file").distinct(), rows, unit="file", key=["key"], payload=WEIGHTS)
    return after


@_query(
    f"""
WITH {LINE_W} SELECT {SHOWN} AS key, count(*) AS count, min(key) AS source_index, {FIRST}, ('0x' || substr(md5({SHOWN}), 1, 6))::BIGINT % 32 AS bucket FROM w GROUP BY {SHOWN}
"""
)
def bucketed_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of seven shards, of the eighth, and of the eighth once more, each of which rewrites only the buckets it touches."""
    rows, folder = _line_weights(spark, sf_dir), Workspace(spark, "buckets").base
    for tag, part in (("first", "shard < 7"), ("more", "shard = 7"), ("more", "shard = 7")):
        buckets.add_run(K.count_first(rows.where(part), ["key"], WEIGHTS), folder, tag, key="key", buckets=32)
    return buckets.read(spark, folder).withColumn("bucket", F.col("bucket").cast("bigint"))


@_query(
    f"""
WITH {PART_W}, g AS (SELECT {SHOWN} AS k, 2 * list_max(ws) <= list_sum(ws) AS ok, count(*) AS n FROM w GROUP BY ALL)
SELECT sum(n)::BIGINT AS processed, coalesce(sum(n) FILTER (WHERE NOT ok), 0)::BIGINT AS failed, count(*) FILTER (WHERE ok) AS "unique",
       coalesce(sum(n - 1) FILTER (WHERE ok), 0)::BIGINT AS duplicate, true AS balanced FROM g
"""
)
def accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = F.col("ws")
    rows = _part_weights(spark, sf_dir).select(W.shown(W.canonical(ws)).alias("nf_key"), W.may_be_interior(ws).alias("ok"), F.lit(1).cast("bigint").alias("count"))
    return K.accounting(rows)


FREE = ["l_returnflag", "l_linestatus", "l_linenumber", "bin"]
FREE_VIEW = f"f AS (SELECT *, {LINE_KEY} AS row_id, l_partkey % 400 AS bin, l_suppkey % 7 + 6 AS nv FROM lineitem)"


def _free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", (F.col("l_partkey") % 400).alias("bin"), (F.col("l_suppkey") % 7 + 6).alias("nv"), "l_partkey", F.col("l_quantity").cast("bigint").alias("quantity"), F.expr(f"cast({LINE_KEY} as bigint)").alias("row_id"))


def _deep(df: DataFrame) -> DataFrame:
    """A digest in place of an expensive key."""
    return df.withColumn("deep", F.sha2(F.concat_ws(" ", F.col("l_partkey").cast("string"), F.col("quantity").cast("string")), 256))


DEEP = "sha256(concat_ws(' ', l_partkey::VARCHAR, l_quantity::BIGINT::VARCHAR))"
COLLIDING = f"c AS (SELECT *, {DEEP} AS deep FROM (SELECT *, count(*) OVER (PARTITION BY {', '.join(FREE)}) AS m FROM f) WHERE m > 1)"


@_query(f"WITH {FREE_VIEW} SELECT {', '.join(FREE)}, count(*) AS members FROM f GROUP BY ALL")
def free_invariant_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.group_sizes(_free(spark, sf_dir), FREE)


@_query(
    f"""
WITH {FREE_VIEW}, {COLLIDING}, g AS (SELECT {', '.join(FREE)}, count(*) AS n FROM f GROUP BY ALL)
SELECT (SELECT count(*) FROM f) AS n_rows, count(*) AS free_groups, coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS colliding,
       (SELECT count(*) FROM (SELECT DISTINCT {', '.join(FREE)}, deep FROM c)) AS keys_in_collisions,
       (SELECT count(*) FROM f) - coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT + (SELECT count(*) FROM (SELECT DISTINCT {', '.join(FREE)}, deep FROM c)) AS distinct_keys
FROM g
"""
)
def collision_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cascade_report(_free(spark, sf_dir), FREE, _deep, "deep")


@_query(f"WITH {FREE_VIEW}, {COLLIDING} SELECT (nv - 6)::BIGINT AS stratum, count(*) AS n FROM c GROUP BY ALL")
def collision_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.histogram(C.collisions(_free(spark, sf_dir), FREE), W.gale_dimension(F.col("nv")))


@_query(
    f"""
WITH {FREE_VIEW} SELECT {', '.join(FREE)}, count(*) AS members, count(DISTINCT {DEEP}) AS keys,
  CASE WHEN count(*) = count(DISTINCT {DEEP}) THEN 'RESOLVED' ELSE 'STILL COLLIDING' END AS verdict
FROM f GROUP BY {', '.join(FREE)} HAVING count(*) > 1
"""
)
def residual_group_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.verdicts(_deep(_free(spark, sf_dir)), FREE, "deep")


@_query(
    f"""
WITH {FREE_VIEW}, {COLLIDING}, x AS (SELECT *, count(*) OVER (PARTITION BY {', '.join(FREE)}, deep) AS k FROM c)
SELECT a.row_id AS row_id_a, b.row_id AS row_id_b, a.nv = b.nv AS same FROM x a JOIN x b
  ON a.l_returnflag = b.l_returnflag AND a.l_linestatus = b.l_linestatus AND a.l_linenumber = b.l_linenumber AND a.bin = b.bin AND a.deep = b.deep
WHERE a.k > 1 AND b.k > 1 AND a.row_id < b.row_id
"""
)
def pairwise_within_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = C.cascade(_free(spark, sf_dir), FREE, _deep, "deep")
    return C.pairs_within(left, [*FREE, "deep"], "row_id", ["nv"]).select("row_id_a", "row_id_b", (F.col("nv_a") == F.col("nv_b")).alias("same"))


@_query(
    f"""
WITH {FREE_VIEW}, {COLLIDING}, x AS (SELECT *, count(*) OVER (PARTITION BY {', '.join(FREE)}, deep) AS k FROM c)
SELECT {', '.join(FREE)}, row_id * 8 + nv - 6 AS member, min(row_id * 8 + nv - 6) OVER w AS class_id, count(*) OVER w - 1 AS links FROM x WHERE k > 1
WINDOW w AS (PARTITION BY {', '.join(FREE)}, deep, nv)
"""
)
def classes_within_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pairs say, without pairs: for each row that the cascade leaves the least one that it equals."""
    left = C.cascade(_free(spark, sf_dir), FREE, _deep, "deep")
    left = left.withColumn("member", F.col("row_id") * 8 + F.col("nv") - 6)  # a row id may repeat
    found = C.classes_within(left, [*FREE, "deep"], "member", ["nv"], lambda pairs: pairs.withColumn("same", F.col("nv_a") == F.col("nv_b")))
    return found.select(*FREE, "member", "class_id", "links")


def _positions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    at = [F.floor(F.col("o_orderkey") / 1000).cast("int").alias("source_row_group"), (F.col("o_orderkey") % 1000).cast("int").alias("source_row_in_group")]
    orders = _table(spark, sf_dir, "orders")
    left = orders.select(*at, F.col("o_custkey").alias("count"), (F.col("o_custkey") % 10).cast("int").alias("h11"), (F.col("o_orderkey") % 97).alias("source_index"))
    right = orders.select(*at, (F.col("o_orderkey") % 13).cast("int").alias("h11_c"), (F.col("o_custkey") % 17).cast("int").alias("h12_c"), (F.col("o_orderkey") % 19).cast("int").alias("h13_c"))
    return left, right


@_query(
    """
SELECT (o_orderkey // 1000)::INTEGER AS source_row_group, (o_orderkey % 1000)::INTEGER AS source_row_in_group, o_orderkey % 97 AS source_index,
       (o_orderkey % 13)::INTEGER AS h11, (o_custkey % 17)::INTEGER AS h12, (o_orderkey % 19)::INTEGER AS h13, o_custkey AS count FROM orders
"""
)
def positional_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _positions(spark, sf_dir)
    return enrich.positional_merge(left, right, drop=("h11",), rename={"h11_c": "h11", "h12_c": "h12", "h13_c": "h13"})


@_query(SQL["positional_merge"])
def aligned_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of two folders of files in one order, whose row groups are cut otherwise: without a shuffle."""
    work = Workspace(spark, "aligned")
    sides = []
    for name, side, size in zip(("left", "right"), _positions(spark, sf_dir), (1 << 16, 1 << 18), strict=True):
        rows = side.withColumn("shard", F.col("source_row_group") % 4)
        sides.append(sinks.write_shards(rows, f"{work.base}/{name}", "shard", 4, *enrich.POSITION, options={"parquet.block.size": size}))
    return enrich.aligned_merge(spark, *sides, drop=("h11",), rename={"h11_c": "h11", "h12_c": "h12", "h13_c": "h13"}, rows=1000)


@_query(
    """
WITH k AS (SELECT o_orderkey AS k, 1 AS l, 0 AS r FROM orders UNION ALL SELECT l_orderkey, 0, 1 FROM lineitem),
g AS (SELECT k, sum(l) AS l, sum(r) AS r FROM k GROUP BY k)
SELECT sum(l)::BIGINT AS left_rows, sum(r)::BIGINT AS right_rows, count(*) FILTER (WHERE r = 0) AS left_only, count(*) FILTER (WHERE l = 0) AS right_only,
       count(*) FILTER (WHERE l > 1 OR r > 1) AS repeated, count(*) FILTER (WHERE l <> 1 OR r <> 1) = 0 AS aligned FROM g
"""
)
def positional_merge_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against line items by order key: some orders have no item, most have several."""
    left, _ = _positions(spark, sf_dir)
    key = F.col("l_orderkey")
    right = _table(spark, sf_dir, "lineitem").select(F.floor(key / 1000).cast("int").alias("source_row_group"), (key % 1000).cast("int").alias("source_row_in_group"))
    return enrich.positional_audit(left, right)


@_query(
    f"""
WITH {PART_W}, r AS (SELECT key, list_sum(ws)::BIGINT AS degree, row_number() OVER (ORDER BY list_sum(ws), key) - 1 AS rank FROM w)
SELECT key, degree, rank FROM r WHERE rank % 5 = 0 AND rank < 5 * 400
"""
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part_weights(spark, sf_dir).select("key", W.total(F.col("ws")).alias("degree"))
    return sampling.systematic(rows, ["degree", "key"], 5, 400).select("key", "degree", F.col("rank").cast("bigint").alias("rank"))


@_query(f"WITH {PART_W} SELECT key, sha256({SHOWN}) AS sha, substr(sha1({SHOWN}), 1, 16) AS layer FROM w")
def canonical_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = W.shown(W.canonical(F.col("ws")))
    return _part_weights(spark, sf_dir).select("key", F.sha2(text, 256).alias("sha"), F.substring(F.sha1(text), 1, 16).alias("layer"))


@_query(
    """
SELECT row_number() OVER (ORDER BY part, k) - 1 AS place, part, k FROM (SELECT 0 AS part, s_suppkey AS k FROM supplier UNION ALL SELECT 1, p_partkey FROM part)
"""
)
def concat_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [_table(spark, sf_dir, t).select(F.lit(k).alias("part"), F.col(c).alias("k")) for k, (t, c) in enumerate((("supplier", "s_suppkey"), ("part", "p_partkey")))]
    return sampling.ranked(K.strict_union(*parts), ["part", "k"], name="place").select(F.col("place").cast("bigint").alias("place"), "part", "k")


@_query(
    f"""
WITH {LINE_W}, g AS (SELECT {SHOWN} AS k, count(*) AS n FROM w GROUP BY 1)
SELECT count(*) AS fibres, sum(n)::BIGINT AS rows_in_all, max(n) AS largest, count(*) FILTER (WHERE n = 1) AS singletons,
       quantile_disc(n, 0.5) AS median FROM g
"""
)
def fibre_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _line_weights(spark, sf_dir).groupBy("key").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.count("*").cast("bigint").alias("fibres"),
        F.sum("n").cast("bigint").alias("rows_in_all"),
        F.max("n").alias("largest"),
        F.count_if(F.col("n") == 1).cast("bigint").alias("singletons"),
        F.expr("percentile_disc(0.5) within group (order by n)").cast("bigint").alias("median"),
    )


@_query(
    f"""
WITH {PART_W}, c AS (SELECT list_sort(ws) AS s, list_sum(ws)::BIGINT AS degree, count(*) AS members FROM w GROUP BY ALL),
l AS (SELECT s, members, list_sort(list_distinct(s)) AS d, len(list_filter(s, lambda x: x = 1))::BIGINT AS n_ones,
        list_bool_and(list_transform(s, lambda x: degree % x = 0)) AS gorenstein FROM c),
v AS (SELECT *, len(d)::BIGINT AS n_distinct, array_to_string(list_reverse_sort(list_transform(d, lambda x: len(list_filter(s, lambda y: y = x)))), ' ') AS multiplicities FROM l)
SELECT n_distinct, multiplicities, n_ones, gorenstein, count(*) AS systems, sum(members)::BIGINT AS members, count(*) FILTER (WHERE members > 1) AS same,
       CASE WHEN count(*) = 1 THEN 'ALONE' ELSE 'SHARED' END AS verdict
FROM v GROUP BY n_distinct, multiplicities, n_ones, gorenstein
"""
)
def sieve_s1_s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Systems that are equal up to order are the same (S1); of those that differ, which are alone with their local numbers (S2).

    Whether systems of one polytope always share these numbers isn't proven, so being alone decides nothing by itself.
    """
    w = F.col("canonical")
    systems = _part_weights(spark, sf_dir).groupBy(W.canonical(F.col("ws")).alias("canonical")).agg(F.count("*").alias("members"))
    local = systems.select("members", W.distinct(w).alias("n_distinct"), W.shown(W.multiplicities(w)).alias("multiplicities"), W.ones(w).alias("n_ones"), W.gorenstein(w).alias("gorenstein"))
    out = local.groupBy("n_distinct", "multiplicities", "n_ones", "gorenstein").agg(F.count("*").alias("systems"), F.sum("members").cast("bigint").alias("members"), F.count_if(F.col("members") > 1).alias("same"))
    return out.withColumn("verdict", F.when(F.col("systems") == 1, "ALONE").otherwise("SHARED"))


@_query("SELECT p_partkey AS key, 44 + 4 * (p_partkey % 31) - 2 * (p_partkey % 17) + 4 * (p_partkey % 101) AS h22 FROM part")
def hodge_h22(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return _table(spark, sf_dir, "part").select(k.alias("key"), W.hodge_h22(k % 31, k % 17, k % 101).alias("h22"))


def _shown_catalogue(df: DataFrame) -> DataFrame:
    return df.select(F.lower(F.hex("nf_key")).alias("nf_key"), *(c for c in df.columns if c != "nf_key"))


@_query()
def nf_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of the weight systems of part, equal systems merged before the kernel."""
    return _shown_catalogue(K.catalogue(weight_rows(_table(spark, sf_dir, "part"), F.col("p_partkey"))))


@_query()
def nf_catalogue_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over lineitem: thirty times the rows, and few more systems."""
    return _shown_catalogue(K.catalogue(weight_rows(_table(spark, sf_dir, "lineitem"), F.expr(f"cast({LINE_KEY} as bigint)"))))


@_query()
def nf_catalogue_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same catalogue with nothing merged before and nothing remembered: the kernel runs on every row."""
    return _shown_catalogue(K.catalogue(weight_rows(_table(spark, sf_dir, "part"), F.col("p_partkey")), presort=False, remember=False))


@_query()
def nf_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.accounting(K.classified(weight_rows(_table(spark, sf_dir, "part"), F.col("p_partkey")), WEIGHTS))


@_query()
def add_nf_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue with its normal forms computed anew and its keys checked."""
    out = enrich.add_normal_forms(K.catalogue(weight_rows(_table(spark, sf_dir, "part"), F.col("p_partkey"))))
    return out.select(F.lower(F.hex("nf_key")).alias("nf_key"), "count", "vertex_count", F.lower(F.hex("nf_vertices")).alias("nf_vertices"), "key_matches")


def _forms(spark: SparkSession, sf_dir: str, moduli: tuple) -> DataFrame:
    tried = K.classified(weight_rows(_table(spark, sf_dir, "part"), F.col("p_partkey"), moduli), WEIGHTS)
    return tried.where("ok").dropDuplicates(["nf_key"]).select(F.lower(F.hex("nf_key")).alias("nf_key"), "vertex_count", "facet_count", "point_count", "nf")


@_query()
def fingerprint_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.fingerprints(_forms(spark, sf_dir, FEW)).drop("nf")


@_query()
def gl_equiv_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of distinct polytopes with as many vertices, facets and points, tested for isomorphism."""
    forms = C.collisions(_forms(spark, sf_dir, MANY), ["vertex_count", "facet_count", "point_count"])
    pairs = C.pairs_within(forms, ["vertex_count", "facet_count", "point_count"], "nf_key", ["nf"])
    return classify.isomorphic_pairs(pairs).select("nf_key_a", "nf_key_b", "verdict")


@_query()
def gl_equiv_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of isomorphic polytopes, by representatives; distinct normal forms should be in classes of their own."""
    forms = C.collisions(_forms(spark, sf_dir, MANY), ["vertex_count", "facet_count", "point_count"])
    return classify.isomorphism_classes(forms, ["vertex_count", "facet_count", "point_count"])


@_query()
def nf_hodge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duals' points and Hodge numbers of the distinct polytopes of part."""
    return classify.with_hodge(_forms(spark, sf_dir, MANY)).drop("nf")


@_query()
def gl_equiv_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pairwise tests say of each group of polytopes with as many vertices, facets and points."""
    key = ["vertex_count", "facet_count", "point_count"]
    pairs = C.pairs_within(C.collisions(_forms(spark, sf_dir, MANY), key), key, "nf_key", ["nf"])
    return C.pair_verdicts(classify.isomorphic_pairs(pairs), key)


@_query(
    f"""
WITH {LINE_W}, g AS (SELECT {SHOWN} AS k, min(list_sum(ws))::BIGINT % 10 AS stratum, count(*) AS n FROM w GROUP BY 1)
SELECT stratum, count(*) AS fibres, sum(n)::BIGINT AS n_rows, max(n) AS largest, count(*) FILTER (WHERE n = 1) AS singletons,
       (sum(sum(n)) OVER (ORDER BY stratum))::BIGINT AS rows_up_to FROM g GROUP BY stratum
"""
)
def fibre_mass_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _line_weights(spark, sf_dir)
    degree = sum((F.col(c) for c in WEIGHTS[1:]), F.col(WEIGHTS[0])).cast("bigint")
    sizes = rows.groupBy("key").agg(F.count("*").alias("count"), (F.min(degree) % 10).alias("stratum"))
    return C.fibre_mass(sizes, "count", "stratum")


@_query()
def stream_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of part by a stream over files of its weight systems: the same rows as ``nf_catalogue``."""
    work = Workspace(spark, "stream")
    rows = work.save(weight_rows(_table(spark, sf_dir, "part"), F.col("p_partkey")).select("source_index", *WEIGHTS).repartition(4), "in")
    incremental.follow(spark, f"{work.base}/in", rows.schema, f"{work.base}/runs", f"{work.base}/state", files_per_batch=2).awaitTermination()
    return _shown_catalogue(incremental.current(spark, f"{work.base}/runs"))
