"""The total order of tuples and its panes."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import fresh


def with_tid(df: DataFrame, key: str = "kid", tid: str = "tid") -> DataFrame:
    """df with tid = 1, 2, 3, ... in the order of a unique numeric key; a column of that name is replaced.

    Keys are dealt into ranges, numbered within them and moved by the sizes of the ranges before, so
    no task needs more than a range. Rows without a key come first, in an order of their hashes, and
    have as many ranges.
    """
    at, part, n, before = fresh([*df.columns, tid], "at", "part", "n", "before")
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    number = F.col(key).cast("double")
    cuts = sorted(set(df.select(number.alias(at)).approxQuantile(at, [i / parts for i in range(1, parts)], 0.2 / parts)))
    rows = df.withColumn(at, F.coalesce(number, F.lit(-float("inf"))))
    if cuts:
        rows = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol=at, outputCol=part).transform(rows)
    else:
        rows = rows.withColumn(part, F.lit(0.0))
    some = F.xxhash64(*[c for c, kind in df.dtypes if not kind.startswith("map")])
    rows = rows.withColumn(part, F.when(F.col(key).isNull(), F.pmod(some, F.lit(parts)) - parts).otherwise(F.col(part).cast("long")))
    sizes = rows.groupBy(part).count()  # one row for each range
    shift = sizes.select(part, (F.sum("count").over(Window.orderBy(part)) - F.col("count")).alias(before))
    rows = rows.withColumn(n, F.row_number().over(Window.partitionBy(part).orderBy(key, some))).join(F.broadcast(shift), part)
    return rows.withColumn(tid, (F.col(before) + F.col(n)).cast("long")).select(*[c for c in df.columns if c.lower() != tid.lower()], tid)


def pane(step: int, tid: str = "tid") -> Column:
    """The pane of a tuple: panes are step tuples long and count from 1. A window is a tuple's pane and the one before."""
    return F.expr(f"(`{tid}` - 1) div {int(step)} + 1")
