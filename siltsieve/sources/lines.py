"""Delimited lines in and out: files, Kafka where its connector is installed, and text into Kafka."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROBE_EVERY = 100


def parse_delimited(lines: DataFrame, columns: Sequence[str], separator: str = r"\|", value: str = "value") -> DataFrame:
    """Columns of lines split at a regular expression; empty ones at the end are kept, the first is a whole number, all others text, missing ones null."""
    parts = F.split(F.col(value).cast("string"), separator, -1)
    rows = lines.select(parts.alias("parts"), parse_key(value, separator).alias("key"))
    return rows.select(F.col("key").alias(columns[0]), *[F.try_element_at("parts", F.lit(i + 2)).alias(c) for i, c in enumerate(columns[1:])])


def parse_key(value: str = "value", separator: str = r"\|") -> Column:
    """The first part of a line as a whole number, null where it is none."""
    return F.try_element_at(F.split(F.col(value).cast("string"), separator, -1), F.lit(1)).try_cast("long")


def parse_control(lines: DataFrame, separator: str = r"\|", value: str = "value") -> DataFrame:
    """(name, payload) of control messages."""
    parts = F.split(F.col(value).cast("string"), separator, 2)
    return lines.select(F.try_element_at(parts, F.lit(1)).alias("name"), F.try_element_at(parts, F.lit(2)).alias("payload"))


def probes(df: DataFrame, tid: str = "tid", every: int = PROBE_EVERY) -> DataFrame:
    """Every so many tuples one, to measure how long tuples take."""
    return df.where(F.col(tid) % every == 0)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def stream_lines(spark: SparkSession, path: str, files_a_batch: int = 1) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(path)


def kafka_lines(spark: SparkSession, servers: str, topic: str, earliest: bool = True) -> DataFrame:
    """A stream of a topic's values, from its beginning (data) or from now on (control)."""
    start = "earliest" if earliest else "latest"
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", start).load().select(F.col("value").cast("string"))


def lines_to_kafka(spark: SparkSession, path: str, servers: str, topic: str) -> None:
    """One message without a key for each line of text."""
    read_lines(spark, path).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def log_lines(spark: SparkSession, path: str, earliest: bool = True) -> DataFrame:
    """kafka_lines of a log of lines (see linelog) in place of a topic."""
    from .linelog import LineLog

    spark.dataSource.register(LineLog)
    return spark.readStream.format("linelog").option("path", path).option("startingOffsets", "earliest" if earliest else "latest").load()


def lines_to_log(lines: DataFrame, path: str) -> None:
    """Add (value) to a log of lines, as lines_to_kafka does to a topic."""
    from .linelog import LineLog

    lines.sparkSession.dataSource.register(LineLog)
    lines.select("value").write.format("linelog").mode("append").option("path", path).save()


def to_lines(df: DataFrame, columns: Sequence[str], separator: str = "|") -> DataFrame:
    """(value): rows as delimited lines, null as nothing."""
    return df.select(F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), separator).alias("value"))
