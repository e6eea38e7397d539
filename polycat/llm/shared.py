"""The shared folder for intermediate tables, and small helpers on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polycat.operators.sampling import ranked
from polycat.storage import Scope, Workspace, shared_dir, tidy

__all__ = ["NO_ID", "Scope", "Workspace", "fold", "id_key", "numbered", "partitions", "shared_dir", "tidy"]


def fold(doc_id: str, parts: int):
    """The fold of a document: crc32 of its id as text, modulo ``parts`` (a null id: of the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Stands for a null id where ids are integers.
NO_ID = -(1 << 63)


def id_key(df: DataFrame, name: str) -> Column:
    """A column that is equal for equal ids of any simple type, and never null: a null id has the least integer's, or the empty text's, key."""
    if isinstance(df.schema[name].dataType, T.IntegralType):
        return F.coalesce(F.col(name).cast("bigint"), F.lit(NO_ID))
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def numbered(df: DataFrame, name: str) -> DataFrame | None:
    """(``name``, ``number``) of the distinct ids, numbered in their order; None where ids are integers and need no numbers."""
    if isinstance(df.schema[name].dataType, T.IntegralType):
        return None
    ids = df.select(name).where(F.col(name).isNotNull()).distinct()
    return ranked(ids, [name], name="number")
