"""The jobs as queries: each runs its job twice over a whole table into a new folder, and returns what is there afterwards."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import follow_records, worklist
from polycat.operators import buckets
from polycat.queries import FIRST, LINE_W
from polycat.storage import Workspace


def job1_follow_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of the lines of all documents; the second run finds nothing new."""
    config = json.loads(follow_records.DEFAULT.read_text())
    base = Workspace(spark, "follow").base
    for _ in range(2):
        follow_records.follow(spark, config, f"{sf_dir}/documents.parquet", base, f"{base}/checkpoint")
    return buckets.read(spark, base).select("key", "count", F.col("source_index").alias("first_doc"), "chars", F.col("bucket").cast("bigint").alias("bucket"))


JOB1_SQL = r"""
WITH l AS (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM documents)
SELECT md5(line) AS key, count(*) AS count, min(doc_id) AS first_doc, length(line) AS chars, ('0x' || substr(md5(md5(line)), 1, 6))::BIGINT % 16 AS bucket
FROM l WHERE line <> '' GROUP BY line
"""


def job2_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worklist of the weight systems of lineitem."""
    config = json.loads(worklist.DEFAULT.read_text())
    base = Workspace(spark, "worklist").base
    for _ in range(2):
        worklist.worklist(spark, config, f"{sf_dir}/lineitem.parquet", base)
    return worklist.read(spark, base)


JOB2_SQL = f"""
WITH {LINE_W}, s AS (SELECT list_sort(ws) AS s, count(*) AS count, min(key) AS source_index, {FIRST} FROM w GROUP BY 1),
v AS (SELECT *, list_sum(s)::BIGINT AS degree, list_sort(list_distinct(s)) AS d FROM s),
n AS (
  SELECT *, len(d)::BIGINT AS n_distinct, array_to_string(list_reverse_sort(list_transform(d, lambda x: len(list_filter(s, lambda y: y = x)))), ' ') AS multiplicities,
         len(list_filter(s, lambda x: x = 1))::BIGINT AS n_ones, list_bool_and(list_transform(s, lambda x: degree % x = 0)) AS gorenstein, 2 * s[6] <= degree AS inside FROM v),
m AS (SELECT *, CASE WHEN inside THEN count(*) OVER (PARTITION BY inside, n_distinct, multiplicities, n_ones, gorenstein) ELSE 0 END AS sharing FROM n)
SELECT array_to_string(s, ' ') AS system, count, source_index, weight0, weight1, weight2, weight3, weight4, weight5, degree, n_distinct, multiplicities, n_ones, gorenstein, sharing,
       CASE WHEN NOT inside THEN 'no_interior' WHEN sharing = 1 THEN 'alone' ELSE 'shared' END AS status, degree // 8 AS band
FROM m
"""


def queries() -> dict:
    return {"job1_follow_records": job1_follow_records, "job2_worklist": job2_worklist}


def oracle_sql() -> dict[str, str]:
    return {"job1_follow_records": JOB1_SQL, "job2_worklist": JOB2_SQL}
