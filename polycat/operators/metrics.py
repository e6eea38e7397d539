"""Numbers of rows, counted while the rows are used."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation


def counted(df: DataFrame, *numbers: Column) -> tuple[DataFrame, Callable[[], dict]]:
    """``df``, and what gives its named aggregates once ``df`` was used: no pass of its own is needed for them.

    Where nothing is left of ``df`` further on, Spark drops the rest of the plan and the numbers with it; only then
    they are computed anew.  Rows that a lost executor's tasks read again may be counted
    twice: numbers for a log, not for a result.
    """
    seen = Observation()

    def taken() -> dict:
        try:
            return dict(seen.get)
        except Py4JJavaError:
            return df.agg(*numbers).first().asDict()

    return df.observe(seen, *numbers), taken
