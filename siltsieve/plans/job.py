"""A whole job from its configuration: read delimited lines, repair, write delimited lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import ConfigError
from ..functions.order import with_tid
from ..functions.shared import cut, shared_dir
from ..sources.lines import kafka_lines, parse_control, parse_delimited, parse_key, read_lines, to_lines
from .cleaner import Cleaner
from .config import Config, parse_config


def tuples(lines: DataFrame, config: Config) -> DataFrame:
    """Lines as tuples; the first attribute is the key and becomes kid. Lines whose key is no whole number are none, see bad_lines."""
    df = parse_delimited(lines, config.columns, config.separator).where(F.col(config.columns[0]).isNotNull())
    return df if config.columns[0] == "kid" else df.withColumn("kid", F.col(config.columns[0]))


def bad_lines(lines: DataFrame, config: Config) -> DataFrame:
    """(value) of the lines that tuples leaves out, as they are."""
    return lines.where(parse_key("value", config.separator).isNull()).select("value")


def cleaner(config: Config) -> Cleaner:
    return Cleaner(config.rules, config.mode, config.window_step, config.repair_mode, config.columns)


def run_batch(spark: SparkSession, text: str, prefix: str | None = None, separator: str = "|") -> DataFrame:
    """Repair the lines at the configuration's input in the order of their keys and write them to its output; what was written, with repaired and changed.

    Lines whose key is no whole number can't be placed in that order: they go, as they are, to the
    output's name with `_bad` after it. So every line is in one of the two.
    """
    config = parse_config(text, prefix)
    if not config.input or not config.output:
        raise ConfigError("a batch job needs an input and an output")
    lines = read_lines(spark, config.input)
    out = cut(cleaner(config).repair(with_tid(tuples(lines, config))))
    to_lines(out, config.columns, separator).write.mode("errorifexists").text(config.output)
    bad_lines(lines, config).write.mode("errorifexists").text(f"{config.output.rstrip('/')}_bad")
    return out


def start_stream(spark: SparkSession, text: str, prefix: str | None = None, lines: DataFrame | None = None, name: str = "job") -> StreamingQuery:
    """Decisions (see streaming.stateful.OUT) on a stream of lines, by default the configuration's topic, as Parquet at its output. The key is the order; a stopped query goes on from its checkpoint in the shared folder."""
    config = parse_config(text, prefix)
    if not config.output:
        raise ConfigError("a job needs an output")
    if lines is None:
        if not config.topic or not config.servers:
            raise ConfigError("a stream needs a topic and a server")
        lines = kafka_lines(spark, config.servers, config.topic)
    found = cleaner(config).repair_stream(tuples(lines, config).withColumn("tid", F.col("kid")))
    return found.writeStream.format("parquet").option("checkpointLocation", f"{shared_dir(spark)}/{name}-checkpoint").option("path", config.output).outputMode("append").trigger(availableNow=True).start()


def start_live(spark: SparkSession, text: str, prefix: str | None = None, lines: DataFrame | None = None, control: DataFrame | None = None, available_now: bool = True) -> StreamingQuery:
    """Whole repaired tuples from a stream of lines, with rules that a stream of control lines changes while it runs; both by default from the configuration's topics. The key is the order. The output is a LiveCleaner's place: its `tuples` are the result, its `state` and `checkpoint` let a stopped query go on."""
    config = parse_config(text, prefix)
    if not config.output:
        raise ConfigError("a job needs an output")
    if lines is None:
        if not config.topic or not config.servers:
            raise ConfigError("a stream needs a topic and a server")
        lines = kafka_lines(spark, config.servers, config.topic)
        if control is None and config.control_topic:
            control = kafka_lines(spark, config.servers, config.control_topic, earliest=False)
    own = tuples(lines, config).withColumn("tid", F.col("kid"))
    return cleaner(config).live(spark, config.output).start(own, None if control is None else parse_control(control), available_now)
