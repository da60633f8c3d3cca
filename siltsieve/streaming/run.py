"""Running a cleaner over a stream of files to its end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import cut, shared_dir
from ..plans.cleaner import Cleaner
from .live import LiveCleaner
from .stateful import OUT


def parts(df: DataFrame, cuts: Sequence[int]) -> list[DataFrame]:
    """df by ascending places, a new part from each of cuts on."""
    at = F.col("tid")
    bounds = [(at >= a) if b is None else (at >= a) & (at < b) for a, b in zip([0, *cuts], [*cuts, None])]
    return [df.where(x) for x in bounds]


def drain_live(spark: SparkSession, df: DataFrame, live: LiveCleaner, cuts: Sequence[int], messages: dict[int, Sequence[tuple[str, str]]] | None = None) -> None:
    """Run live to the end of df, in micro-batches that begin at cuts; messages: control messages by the number of the micro-batch that brings them.

    The query is started once for each micro-batch, which takes all files that are new, so these may be as many as tasks wrote.
    """
    schema = "name string, payload string"
    for i, own in enumerate(parts(cut(df), cuts)):
        own.write.mode("append").parquet(f"{live.place}/in")
        control = None
        if messages:
            spark.createDataFrame(list(messages.get(i, ())), schema).coalesce(1).write.mode("append").parquet(f"{live.place}/control")
            control = spark.readStream.schema(schema).parquet(f"{live.place}/control")
        live.start(spark.readStream.schema(df.schema).parquet(f"{live.place}/in"), control).awaitTermination()


def drain(spark: SparkSession, df: DataFrame, cleaner: Cleaner, name: str, batches: int = 3, live: bool = True) -> DataFrame:
    """df in a few files by order of tid, read as a stream and repaired; the decisions (see streaming.stateful.OUT). live: by a LiveCleaner, where there is one for such rules, else by keyed state."""
    place = f"{shared_dir(spark)}/{name}"
    df = cut(df)  # the order of tuples, once
    last = df.agg(F.max("tid")).first()[0] or 0
    size = max(1, -(-last // batches))
    cuts = [i * size + 1 for i in range(1, batches)]
    if live and cleaner.can_live():
        own = cleaner.live(spark, f"{place}/live")
        drain_live(spark, df, own, cuts)
        return spark.read.schema(OUT).parquet(f"{own.place}/decisions").select("kid", "tid", "attr", "violating", "is_new", "fix")
    for own in parts(df, cuts):
        own.write.mode("append").parquet(f"{place}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{place}/in")
        q = cleaner.repair_stream(stream).writeStream.format("parquet").option("checkpointLocation", f"{place}/checkpoint").option("path", f"{place}/out").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(f"{place}/out")
