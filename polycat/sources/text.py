"""Text sources: weight lines, sample lines, blocks of normal forms, golden records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polycat.storage import Workspace


def _numbers(line: Column) -> Column:
    tokens = F.filter(F.split(F.trim(line), r"\s+"), lambda t: t != "")
    return F.transform(tokens, lambda t: F.try_to_number(t, F.lit("S999999999999999999")).cast("bigint"))


def weight_lines(spark: SparkSession, path: str, *, width: int = 6) -> DataFrame:
    """Lines ``degree w0 w1 ...`` as (line, degree, weights, ok): ok where all are numbers and the weights sum to the degree."""
    lines = spark.read.text(path).select(F.col("value").alias("line")).where(F.trim("line") != "")
    parsed = lines.withColumn("_n", _numbers(F.col("line")))
    whole = (F.size("_n") >= width + 1) & F.forall(F.slice("_n", 1, width + 1), lambda x: x.isNotNull())
    weights = F.slice("_n", 2, width)
    total = F.aggregate(weights, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return parsed.select("line", F.get("_n", F.lit(0)).alias("degree"), weights.alias("weights"), (whole & (F.get("_n", F.lit(0)) == total)).alias("ok"))


def sample_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a sample file as (ws, point_count): the first seven tokens, and the number after ``M:`` (0 without)."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    first = F.array_join(F.slice(F.split(F.trim("value"), r"\s+"), 1, 7), " ")
    found = F.regexp_extract("value", r"M:(\d+)", 1)
    return lines.select(first.alias("ws"), F.when(found != "", found.cast("bigint")).otherwise(0).alias("point_count"))


# Fixed value: how a block of a normal form begins in the text format.
HEADER = r"^\s*(\d+)\s+(\d+)\s+Normal form of vertices"


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, n, value): the lines of text files, numbered within the parts that Spark cuts a file into."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")
    return lines.withColumn("n", F.row_number().over(Window.partitionBy("file", "split").orderBy("at")) - 1).drop("at")


def normal_form_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of normal forms as (file, line, height, width, nf): a header line, then as many rows as it says.

    Lines are numbered within their file, from 0, and belong to the header before them; lines
    beyond a block's height are ignored, as is text before the first header.  A short
    or uneven block is an error.  A file is cut wherever Spark cuts text and read by many tasks: each numbers its own
    lines and finds its last header, and from a row for each part follow the number of its first line
    and the header that it begins under.
    """
    tokens = F.filter(F.split(F.trim("value"), r"\s+"), lambda t: t != "")
    shape = F.struct(F.regexp_extract("value", HEADER, 1).cast("int").alias("height"), F.regexp_extract("value", HEADER, 2).cast("int").alias("width"))
    head = F.when(F.regexp_like("value", F.lit(HEADER)), F.struct("n", shape.alias("shape")))
    numbers = F.transform(tokens, lambda t: F.try_to_number(t, F.lit("S999999999999999999")).cast("bigint"))
    lines = _numbered(spark, path).select("file", "split", "n", head.alias("head"), numbers.alias("numbers"))
    lines = Workspace(spark, "blocks").save(lines, "lines")
    parts = lines.groupBy("file", "split").agg(F.count("*").alias("lines"), F.max("head").alias("last"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("lines").over(before), F.lit(0)))
    last = F.when(F.col("last").isNotNull(), F.struct((F.col("base") + F.col("last.n")).alias("n"), F.col("last.shape").alias("shape")))
    parts = parts.select("file", "split", "base", F.last(last, True).over(before).alias("carried"))
    placed = lines.join(parts, ["file", "split"])
    placed = placed.withColumn("line", F.col("base") + F.col("n"))
    own = F.when(F.col("head").isNotNull(), F.struct(F.col("line").alias("n"), F.col("head.shape").alias("shape")))
    under = F.coalesce(F.last(own, True).over(Window.partitionBy("file", "split").orderBy("n")), "carried")
    begun = placed.withColumn("under", under).select("file", "line", "head", "numbers", F.col("under.n").alias("begin"), F.col("under.shape").alias("shape"))
    rows = begun.where(F.col("begin").isNotNull() & (F.col("line") <= F.col("begin") + F.col("shape.height")))
    blocks = rows.groupBy("file", "begin", "shape").agg(F.array_sort(F.collect_list(F.when(F.col("head").isNull(), F.struct("line", "numbers")))).alias("rows"))
    nf = F.transform("rows", lambda r: r["numbers"])
    height, width = F.col("shape.height"), F.col("shape.width")
    good = (F.size(nf) == height) & F.forall(nf, lambda r: (F.size(r) == width) & F.forall(r, lambda x: x.isNotNull()))
    checked = F.when(good, nf).otherwise(F.raise_error(F.concat(F.lit("the block of a normal form that begins at line "), F.col("begin").cast("string"), F.lit(" is short or uneven"))).cast("array<array<bigint>>"))
    return blocks.select("file", F.col("begin").cast("int").alias("line"), height.alias("height"), width.alias("width"), checked.alias("nf"))


# The fields of a golden record.
GOLDEN = "ws string, dim int, nv int, nf array<array<bigint>>, bytes_len int, digests map<string,string>"


def golden_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of golden normal forms."""
    return spark.read.schema(GOLDEN).json(path)
