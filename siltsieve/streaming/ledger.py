"""Tables of sums that a stream keeps in the shared folder, as what each micro-batch adds to them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import remove

SCHEMA = "rid int, l string, p long, r string, n long, t long"


class Ledger:
    """(rid, l, p, r, n, t): how many tuples of a group have a value in a pane, and the first of them.

    A batch adds its own sums as a folder of its own, so what it writes follows its size. Every so many
    batches all is summed up anew, and what is not live any more is left out. A batch that runs again
    reads the same folders and writes its own once more.
    """

    def __init__(self, spark: SparkSession, place: str, every: int = 8) -> None:
        self.spark, self.place, self.every = spark, place, every

    def _base(self, batch: int) -> str:
        return f"{self.place}/base-{batch}"

    def _paths(self, base: int, batch: int) -> list[str]:
        """Folders with what batches before this one added, from a base on."""
        return ([self._base(base)] if base else []) + [f"{self.place}/batch-{i}" for i in range(base, batch)]

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*paths)
        return rows.groupBy("rid", "l", "p", "r").agg(F.sum("n").alias("n"), F.min("t").alias("t")) if len(paths) > 1 else rows

    def before(self, batch: int, live: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """All live entries of earlier batches."""
        base = batch - batch % self.every
        if base and base == batch:
            live(self._read(self._paths(base - self.every, batch))).write.mode("overwrite").parquet(self._base(base))
            # What the base before this one stands on is no longer read by any batch that may run again.
            remove(self.spark, *self._paths(max(base - 2 * self.every, 0), base - self.every))
        return live(self._read(self._paths(base, batch)))

    def add(self, batch: int, rows: DataFrame) -> None:
        """rows: rid, l, p, r, tid."""
        sums = rows.groupBy("rid", "l", "p", "r").agg(F.count("*").alias("n"), F.min("tid").alias("t"))
        sums.write.mode("overwrite").parquet(f"{self.place}/batch-{batch}")
