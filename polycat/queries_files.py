"""Queries of sources and sinks: each writes files from the driver's tables, and reads them by the operator that it is named after."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polycat import schema
from polycat.functions import weights as W
from polycat.operators import cascade as C
from polycat.operators import catalogue as K
from polycat.operators import generate, sampling
from polycat.plans.derive import MANY, weights_of
from polycat.queries import FIRST, FREE, FREE_VIEW, LINE_W, PART_W, SHOWN, _deep, _free, _line_weights, _query, _table
from polycat.schema import WEIGHTS
from polycat.sources import files, sinks, text
from polycat.storage import Workspace

SHARDS = 6


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = files.spread(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key")))
    return keys.select("key", weights_of(F.col("key"), MANY).alias("ws"))


def _shards(spark: SparkSession, sf_dir: str, *more) -> str:
    """A folder with the weights of part in files by key % SHARDS, in the order of keys; and some metadata."""
    folder = f"{Workspace(spark, 'shards').base}/in"
    rows = _keys(spark, sf_dir).select((F.col("key") % SHARDS).alias("shard"), "key", *(F.get("ws", F.lit(k)).cast("int").alias(c) for k, c in enumerate(WEIGHTS)), *more)
    sinks.write_shards(rows, folder, "shard", SHARDS, "key")
    return folder


# Rows of a folder of shards as SQL: the file's place and the row's in the file.
SHARD_W = f"{PART_W}, s AS (SELECT *, key % {SHARDS} AS file, row_number() OVER (PARTITION BY key % {SHARDS} ORDER BY key) - 1 AS place FROM w)"
WEIGHTS_SQL = ", ".join(f"ws[{k + 1}]::INTEGER AS weight{k}" for k in range(6))


def _split(df: DataFrame) -> DataFrame:
    at = F.col("source_index")
    return df.withColumn("file", F.floor(at / files.FILE_STRIDE).cast("bigint")).withColumn("place", (at % files.FILE_STRIDE).cast("bigint"))


@_query(f"WITH {SHARD_W} SELECT file, place, {WEIGHTS_SQL} FROM s WHERE file BETWEEN 1 AND 3 AND place < 25")
def file_range_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 rows of each of the files 1 to 3 of a folder."""
    rows = files.read_weights(spark, _shards(spark, sf_dir), start=1, end=3, max_rows=25)
    return _split(rows).select("file", "place", *WEIGHTS)


@_query(f"WITH {SHARD_W} SELECT file, place, {WEIGHTS_SQL} FROM s WHERE file >= 4")
def file_range_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range that ends beyond the last file."""
    return _split(files.read_weights(spark, _shards(spark, sf_dir), start=4, end=99)).select("file", "place", *WEIGHTS)


@_query(f"WITH {SHARD_W} SELECT file, place, {WEIGHTS_SQL} FROM s WHERE file = 0 AND place < 40")
def benchmark_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A benchmark's input: the first rows of the first file."""
    return _split(files.first_rows(spark, _shards(spark, sf_dir), 40)).select("file", "place", *WEIGHTS)


@_query(
    f"""
WITH {PART_W} SELECT key AS source_index, 1 AS nw, 6 AS n, list_sum(ws)::BIGINT AS degree, {SHOWN.replace("list_sort(ws)", "ws")} AS weights,
  0 AS structure_id, 1 AS profile_id, 0 AS vertex_count, (key % 11)::INTEGER AS h11, 0 AS h12, (key % 7)::INTEGER AS h13, 0 AS dual_point_count FROM w
"""
)
def scan_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight rows without some columns: what is missing is 0, ids are derived."""
    extra = ((F.col("key") % 11).cast("int").alias("h11"), F.when(F.col("key") % 3 > 0, 0).alias("h12"), (F.col("key") % 7).cast("int").alias("h13"), F.lit("unread").alias("other"))
    rows = spark.read.parquet(_shards(spark, sf_dir, *extra)).withColumnRenamed("key", "source_index")
    found = schema.resolve_input(rows)
    shown = W.shown(F.element_at("rows", 1))
    return found.select("source_index", "nw", "n", F.element_at("degrees", 1).alias("degree"), shown.alias("weights"), "structure_id", "profile_id", "vertex_count", "h11", "h12", "h13", "dual_point_count")


@_query(
    f"""
WITH {PART_W}
SELECT key AS source_index, 2 AS nw, 7 AS n, (ws[1] + ws[2] + ws[3])::BIGINT AS degree0, 0::BIGINT AS degree1,
  ws[1] || ' ' || ws[2] || ' ' || ws[3] || ' 0 0 0 0' AS row0, '0 0 0 1 ' || ws[4] || ' ' || ws[5] || ' ' || ws[6] AS row1, 0 AS weight0,
  (CASE WHEN key % 50 <= 1 THEN 1 WHEN key % 50 <= 3 THEN 2 WHEN key % 50 <= 7 THEN 3 WHEN key % 50 <= 14 THEN 4
        WHEN key % 50 <= 32 THEN 5 WHEN key % 50 <= 45 THEN 6 WHEN key % 50 <= 47 THEN 7 ELSE 0 END)::INTEGER AS profile_id
FROM w
"""
)
def scan_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combined systems of two rows, with some of the columns of the wide schema."""
    w = lambda k: F.get("ws", F.lit(k)).cast("int")
    cells = [w(k).alias(f"weight0_{k}") for k in range(3)] + [F.lit(1).alias("weight1_3"), *(w(k).alias(f"weight1_{k + 1}") for k in (3, 4, 5))]
    degree = sum((w(k) for k in (1, 2)), w(0))
    wide = _keys(spark, sf_dir).select(F.col("key").alias("source_index"), (F.col("key") % 50).cast("int").alias("structure_id"), F.lit(2).alias("nw"), F.lit(7).alias("N"), degree.alias("degree0"), F.lit(0).alias("degree1"), *cells)
    rows = Workspace(spark, "combined").save(wide, "in")
    row = lambda k: W.shown(F.element_at("rows", k))
    degrees = [F.element_at("degrees", k + 1).alias(f"degree{k}") for k in (0, 1)]
    return schema.resolve_input(rows).select("source_index", "nw", "n", *degrees, row(1).alias("row0"), row(2).alias("row1"), "weight0", "profile_id")


@_query(f"WITH {SHARD_W} SELECT key, {WEIGHTS_SQL} FROM s WHERE place % 37 = 5")
def fetch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by file and place: only the row groups that have some are read."""
    from polycat.sources import rowgroups

    folder = _shards(spark, sf_dir)
    wanted = spark.read.parquet(folder).select(F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("row_index")).where("row_index % 37 = 5")
    return rowgroups.fetch(spark, files.list_files(spark, folder), wanted, columns=["key", *WEIGHTS]).select("key", *WEIGHTS)


@_query(f"WITH {PART_W} SELECT 'shard-' || lpad((key % {SHARDS})::VARCHAR, 5, '0') || '.parquet' AS file, count(*) AS n_rows, NULL AS problem, sum(key)::BIGINT AS keys FROM w GROUP BY key % {SHARDS} UNION ALL SELECT 'shard-cut.parquet', NULL, 'no trailer', NULL")
def sound_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder with a file that isn't whole: it is named, and the others are read."""
    from polycat.sources import rowgroups

    folder = _shards(spark, sf_dir)
    spark.createDataFrame([("PAR1 and then nothing more",)], "value string").coalesce(1).write.text(f"{folder}/.cut")
    store, at = files.hadoop(spark, f"{folder}/.cut")
    part = next(s.getPath() for s in store.listStatus(at) if s.getPath().getName().startswith("part-"))
    store.rename(part, files.hadoop(spark, f"{folder}/shard-cut.parquet")[1])
    name = F.regexp_extract("file", "[^/]+$", 0).alias("file")
    good, _ = files.sound_files(spark, folder)
    read = spark.read.parquet(*good).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.sum("key").alias("keys"))
    return rowgroups.check_files(spark, files.list_files(spark, folder)).select(name, F.col("rows").alias("n_rows"), "problem").join(read, "file", "left")


def _written_text(spark: SparkSession, lines: DataFrame) -> str:
    path = f"{Workspace(spark, 'text').base}/lines"
    lines.write.text(path)
    return path


@_query(
    f"""
WITH {PART_W}, v AS (SELECT key, CASE WHEN key % 7 = 0 THEN list_sum(ws)::BIGINT + 1 ELSE list_sum(ws)::BIGINT END AS d, ws FROM w)
SELECT key, CASE WHEN key % 11 = 0 THEN NULL ELSE d END AS degree, array_to_string(CASE WHEN key % 13 = 0 THEN ws[1:5] ELSE ws END, ' ') AS weights,
  key % 7 > 0 AND key % 11 > 0 AND key % 13 > 0 AS ok FROM v
"""
)
def weight_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of text with a degree and weights, some of them no good; the key is what comes after them."""
    degree = F.when(F.col("key") % 11 == 0, "x").otherwise((W.total(F.col("ws")) + F.when(F.col("key") % 7 == 0, 1).otherwise(0)).cast("string"))
    ws = F.when(F.col("key") % 13 == 0, F.slice("ws", 1, 5)).otherwise(F.col("ws"))
    path = _written_text(spark, _keys(spark, sf_dir).select(F.concat(F.lit(" "), degree, F.lit("  "), W.shown(ws), F.lit(" k"), F.col("key").cast("string"))))
    found = text.weight_lines(spark, path)
    key = F.regexp_extract("line", r"k(\d+)$", 1).cast("bigint")
    return found.select(key.alias("key"), "degree", W.shown(F.filter("weights", lambda x: x.isNotNull())).alias("weights"), "ok")


@_query(f"WITH {PART_W} SELECT list_sum(ws)::BIGINT || ' ' || array_to_string(ws, ' ') AS ws, CASE WHEN key % 3 = 0 THEN 0 ELSE key END::BIGINT AS point_count FROM w")
def sample_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a sample: seven numbers, and a point count after ``M:`` in some."""
    count = F.when(F.col("key") % 3 > 0, F.concat(F.lit(" M:"), F.col("key").cast("string"), F.lit(" 9"))).otherwise(" N:5")
    path = _written_text(spark, _keys(spark, sf_dir).select(F.concat(W.total(F.col("ws")).cast("string"), F.lit("  "), W.shown(F.col("ws")), count)))
    return text.sample_lines(spark, path)


@_query(
    f"""
WITH {PART_W} SELECT 2 AS height, 3 AS width, (ws[1] - 3) || ' ' || ws[2] || ' ' || ws[3] AS first_row, ws[4] || ' ' || (-ws[5]) || ' ' || key AS second_row FROM w
"""
)
def normal_form_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of matrices in text: a header, the rows, and lines in between that belong to none."""
    w = lambda k: F.get("ws", F.lit(k))
    say = lambda *c: F.concat_ws(" ", *(x.cast("string") for x in c))
    block = F.concat_ws("\n", F.lit("noise"), F.lit("2 3  Normal form of vertices of a polytope"), F.concat(F.lit("  "), say(w(0) - 3, w(1), w(2))), say(w(3), -w(4), F.col("key")))
    found = text.normal_form_blocks(spark, _written_text(spark, _keys(spark, sf_dir).select(block)))
    return found.select("height", "width", W.shown(F.element_at("nf", 1)).alias("first_row"), W.shown(F.element_at("nf", 2)).alias("second_row"))


@_query(f"WITH {PART_W} SELECT array_to_string(ws, ' ') AS ws, 2 AS dim, 3 AS nv, ws[1] || ' ' || ws[2] || ' ' || ws[3] AS first_row, 48 AS bytes_len, sha256(array_to_string(ws, ' ')) AS sha FROM w")
def golden_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden records written as JSON lines and read again."""
    ws = W.shown(F.col("ws"))
    records = _keys(spark, sf_dir).select(ws.alias("ws"), F.lit(2).alias("dim"), F.lit(3).alias("nv"), F.array(F.slice("ws", 1, 3), F.slice("ws", 4, 3)).alias("nf"), F.lit(48).alias("bytes_len"), F.create_map(F.lit("sha256"), F.sha2(ws, 256)).alias("digests"))
    path = f"{Workspace(spark, 'golden').base}/records"
    sinks.write_golden(records, path)
    return text.golden_records(spark, path).select("ws", "dim", "nv", W.shown(F.element_at("nf", 1)).alias("first_row"), "bytes_len", F.element_at("digests", "sha256").alias("sha"))


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue whose keys are digests of the weights, so that SQL has them too."""
    rows = _line_weights(spark, sf_dir).select(F.unhex(F.md5("key")).alias("nf_key"), "source_index", "shard", *WEIGHTS, *((F.col("source_index") % k).cast("int").alias(c) for k, c in enumerate(["vertex_count", "facet_count", "point_count"], 5)), *(F.lit(3).alias(c) for c in schema.REFLEXIVE_ONLY))
    return rows


PAYLOAD = [*WEIGHTS, "vertex_count", "facet_count", "point_count"]
KEYED = f"""
WITH {LINE_W}, g AS (SELECT md5({SHOWN}) AS nf_key, count(*) AS count, min(key) AS source_index, {FIRST} FROM w GROUP BY {SHOWN})
SELECT nf_key, count, source_index, {", ".join(WEIGHTS)}, (source_index % 5)::INTEGER AS vertex_count, (source_index % 6)::INTEGER AS facet_count, (source_index % 7)::INTEGER AS point_count
"""


@_query(f"{KEYED}, row_number() OVER (ORDER BY nf_key) - 1 AS place FROM g")
def catalogue_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue as written: its 13 columns in the order of keys over all files, the dual's columns dropped."""
    found = K.count_first(_keyed(spark, sf_dir), ["nf_key"], [*PAYLOAD, *schema.REFLEXIVE_ONLY])
    path = f"{Workspace(spark, 'catalogue').base}/out"
    sinks.write_catalogue(found, path)
    back = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return sampling.ranked(back, ["_file", "_row"], name="place").select(F.lower(F.hex("nf_key")).alias("nf_key"), "count", "source_index", *PAYLOAD, F.col("place").cast("bigint").alias("place"))


@_query(f"{KEYED} FROM g")
def sorted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted runs of shards, one of them written twice, merged to one catalogue."""
    rows, folder = _keyed(spark, sf_dir), f"{Workspace(spark, 'runs').base}/runs"
    for k in (0, 1, 0):
        sinks.write_run(K.count_first(rows.where(F.col("shard") % 2 == k), ["nf_key"], PAYLOAD), folder, f"part-{k:05d}", files=[f"shards {k} mod 2"])
    merged = K.merge(spark.read.parquet(folder).drop("run"))
    return merged.select(F.lower(F.hex("nf_key")).alias("nf_key"), "count", "source_index", *PAYLOAD)


@_query("SELECT 'run-' || l_orderkey % 4 AS run, 'shard ' || l_orderkey % 8 AS file, count(*) AS n_rows FROM lineitem GROUP BY l_orderkey % 4, l_orderkey % 8")
def run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files the runs of a folder are of; a run that is written again replaces itself."""
    folder = f"{Workspace(spark, 'ledger').base}/runs"
    rows = _keyed(spark, sf_dir).select("nf_key", "shard")
    for k in (0, 1, 2, 3, 1):
        sinks.write_run(rows.where(F.col("shard") % 4 == k), folder, f"run-{k}", files=["lost"] if k == 0 else [f"shard {k}", f"shard {k + 4}"])
    sinks.write_run(rows.where(F.col("shard") % 4 == 0), folder, "run-0", files=["shard 0", "shard 4"])
    ledger = spark.createDataFrame([(tag, f) for tag, some in sinks.run_files(spark, folder).items() for f in some], "run string, file string")
    counts = spark.read.parquet(folder).groupBy("run", F.concat(F.lit("shard "), F.col("shard").cast("string")).alias("file")).agg(F.count("*").alias("n_rows"))
    return ledger.join(counts, ["run", "file"], "full_outer")


@_query(
    f"""
WITH {PART_W}, g AS (SELECT {SHOWN} AS k, 2 * list_max(ws) <= list_sum(ws) AS ok, count(*) AS n FROM w GROUP BY ALL), c AS (
SELECT sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (WHERE NOT ok), 0)::BIGINT AS failed, count(*) FILTER (WHERE ok) AS uniq, coalesce(sum(n - 1) FILTER (WHERE ok), 0)::BIGINT AS dup FROM g)
SELECT 'catalogue' AS shape, total AS total_cws, failed AS failed_cws, dup AS duplicate_cws, uniq AS unique_polytopes, NULL::BIGINT AS runs_written, total / 2 AS throughput_cws_per_sec FROM c
UNION ALL SELECT 'spill-runs', total, failed, NULL, NULL, 3, total / 2 FROM c
"""
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of a run, in both shapes, as written and read again; its time is given as two seconds."""
    ws = F.col("ws")
    tried = _keys(spark, sf_dir).select(W.shown(W.canonical(ws)).alias("nf_key"), W.may_be_interior(ws).alias("ok"), F.lit(1).cast("bigint").alias("count"))
    numbers, base = K.accounting(tried).first().asDict(), Workspace(spark, "summary").base
    sinks.write_summary(spark, f"{base}/s/shape=catalogue", numbers, seconds=2.0, files=1, backend="array")
    sinks.write_summary(spark, f"{base}/s/shape=spill-runs", numbers, seconds=2.0, files=1, backend="array", runs=3)
    kinds = "total_cws bigint, failed_cws bigint, duplicate_cws bigint, unique_polytopes bigint, runs_written bigint, throughput_cws_per_sec double, shape string"
    return spark.read.schema(kinds).json(f"{base}/s").select("shape", "total_cws", "failed_cws", "duplicate_cws", "unique_polytopes", "runs_written", "throughput_cws_per_sec")


@_query("SELECT row_number() OVER (ORDER BY part, k) - 1 AS place, k FROM (SELECT 0 AS part, s_suppkey AS k FROM supplier UNION ALL SELECT 1, p_partkey FROM part)")
def concat_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables one after the other in one file, as it was written."""
    parts = [_table(spark, sf_dir, t).select(F.col(c).alias("k")).repartition(1).sortWithinPartitions("k") for t, c in (("supplier", "s_suppkey"), ("part", "p_partkey"))]
    path = f"{Workspace(spark, 'concat').base}/one"
    sinks.concatenate(parts, path)
    return spark.read.parquet(path).select(F.col("_metadata.row_index").alias("place"), "k")


@_query(f"WITH {PART_W} SELECT key, CASE WHEN key % 3 = 0 THEN ws[1] || ' ' || ws[2] || ' ' || ws[3] || ' 0 0 0 0' ELSE array_to_string(ws, ' ') END AS first_row, CASE WHEN key % 3 = 0 THEN '0 0 0 1 ' || ws[4] || ' ' || ws[5] || ' ' || ws[6] END AS second_row FROM w")
def replay_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight rows that catalogue rows are recomputed from: a stored matrix, weights, or first weights."""
    keys = _keys(spark, sf_dir)
    w = lambda k: F.get("ws", F.lit(k)).cast("int")
    cells = [w(k).alias(f"first_weight0_{k}") for k in range(3)] + [F.lit(1).alias("first_weight1_3"), *(w(k).alias(f"first_weight1_{k + 1}") for k in (3, 4, 5))]
    stored = keys.where("key % 3 = 0").select("key", F.lit(2).alias("first_nw"), F.lit(7).alias("first_N"), *cells)
    plain = keys.where("key % 3 = 1").select("key", *(w(k).alias(c) for k, c in enumerate(WEIGHTS)))
    first = keys.where("key % 3 = 2").select("key", *(w(k).alias(f"first_{c}") for k, c in enumerate(WEIGHTS)))
    out = [t.select("key", schema.resolve_catalogue(t).alias("rows")) for t in (stored, plain, first)]
    every = out[0].unionByName(out[1]).unionByName(out[2])
    return every.select("key", W.shown(F.get("rows", F.lit(0))).alias("first_row"), W.shown(F.get("rows", F.lit(1))).alias("second_row"))


DEEP_SQL = "sha256(concat_ws(' ', l_partkey::VARCHAR, l_quantity::BIGINT::VARCHAR))"


@_query(f"WITH {FREE_VIEW}, x AS (SELECT row_id, count(*) OVER (PARTITION BY {', '.join(FREE)}, {DEEP_SQL}) AS k FROM f) SELECT row_id FROM x WHERE k > 1")
def residual_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of the rows that a cascade leaves, as it writes them."""
    free, path = _free(spark, sf_dir), f"{Workspace(spark, 'residual').base}/out"
    sinks.write_residual(C.cascade(free, FREE, _deep, "deep"), C.cascade_report(free, FREE, _deep, "deep"), path, stratum=F.col("nv"))
    return spark.read.parquet(f"{path}/rows")


@_query(f"WITH {LINE_W}, g AS (SELECT {SHOWN} AS key, count(*) AS n FROM w GROUP BY 1) SELECT key, n FROM g ORDER BY n DESC, key LIMIT 12")
def largest_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve largest fibres, for a report."""
    return sampling.largest_groups(_line_weights(spark, sf_dir).groupBy("key").agg(F.count("*").alias("n")), 12, "n", "key")


@_query(f"WITH {PART_W} SELECT {SHOWN} AS canonical, count(*) AS members, min(array_to_string(ws, ' ')) = max(array_to_string(ws, ' ')) AS same_bytes, true AS same_points FROM w GROUP BY 1")
def identical_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal weights up to order: whether all rows are the same as they are, and as sets."""
    ws = F.col("ws")
    rows = _keys(spark, sf_dir).select(W.shown(F.array_sort(ws)).alias("canonical"), W.shown(ws).alias("blob"), W.shown(F.array_sort(ws)).alias("points"))
    return C.identical_members(rows, ["canonical"], "blob", "points")


@_query(f"WITH {PART_W} SELECT key, array_to_string(ws, ' ') || ' ' || list_sum(ws)::BIGINT AS weights, 2 * list_sum(ws)::BIGINT AS degree FROM w")
def half_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each system with one more weight, half of the new degree."""
    more = generate.with_half_weight(F.col("ws"))
    return _keys(spark, sf_dir).select("key", W.shown(more).alias("weights"), W.total(more).alias("degree"))


@_query(f"WITH {PART_W} SELECT key, trim(repeat('0 ', (key % 3)::INTEGER) || array_to_string(ws, ' ') || repeat(' 0', (key % 4)::INTEGER)) AS cells FROM w")
def padded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a combined system's matrix: weights between zeros."""
    cells = generate.padded_row(F.col("ws"), (F.col("key") % 3).cast("int"), (F.col("key") % 4).cast("int"))
    return _keys(spark, sf_dir).select("key", W.shown(cells).alias("cells"))


@_query(
    """
WITH RECURSIVE t AS (SELECT [l] AS lengths FROM generate_series(2, 6) s(l)
  UNION ALL SELECT list_append(lengths, l) FROM t, generate_series(2, 6) s(l) WHERE len(lengths) < 5 AND l <= lengths[-1]),
u AS (SELECT lengths, list_sum(lengths)::BIGINT - len(lengths) - 5 AS shared, len(lengths) AS n FROM t),
v AS (SELECT array_to_string(lengths, ' ') AS lengths, shared FROM u WHERE shared BETWEEN 0 AND (n - 1) * (lengths[-1] - 1) AND (n > 1 OR shared = 0)),
r AS (SELECT *, row_number() OVER (ORDER BY lengths, shared) - 1 AS place FROM v),
m AS (SELECT l_partkey % (SELECT count(*) FROM v) AS place, count(*) AS n FROM lineitem GROUP BY 1)
SELECT lengths, shared, coalesce(n, 0) AS n_rows FROM r LEFT JOIN m USING (place)
"""
)
def combined_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shapes of combined weight systems of dimension 5, and how many rows of lineitem are dealt to each by their part."""
    shapes = sorted((" ".join(map(str, lengths)), shared) for lengths, shared in generate.combined_types())
    table = spark.createDataFrame([(*x, k) for k, x in enumerate(shapes)], "lengths string, shared bigint, place bigint")
    dealt = _table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % len(shapes)).alias("place")).agg(F.count("*").alias("n"))
    return table.join(dealt, "place", "left").select("lengths", "shared", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_rows"))


@_query(
    """
WITH f AS (SELECT p_size::BIGINT AS n, count(*) AS n_rows FROM part GROUP BY 1)
SELECT n AS files, k AS shards, j AS shard, least(j, n % k) + j * (n // k) AS first, least(j + 1, n % k) + (j + 1) * (n // k) - 1 AS last, n_rows
FROM f, generate_series(1, 7) b(k), generate_series(0, 6) c(j) WHERE j < k AND least(j + 1, n % k) + (j + 1) * (n // k) > least(j, n % k) + j * (n // k)
"""
)
def shard_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of files by shard, where each size of part has as many files as it says, for up to 7 shards."""
    sizes = _table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("bigint").alias("files")).agg(F.count("*").alias("n_rows"))
    each = sizes.withColumn("shards", F.explode(F.sequence(F.lit(1), F.lit(7)))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    return each.select("files", F.col("shards").cast("bigint").alias("shards"), F.col("shard").cast("bigint").alias("shard"), *files.shard_range(F.col("files"), F.col("shards"), F.col("shard")), "n_rows").where("last >= first")


