"""A log of lines: both ends, restarts, growing files, and a whole job with control messages on logs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siltsieve.plans.job import start_live
from siltsieve.sources import lines
from siltsieve.sources.linelog import LineLog


def drained(spark, path, place, earliest=True):
    q = lines.log_lines(spark, path, earliest).writeStream.format("parquet").option("checkpointLocation", f"{place}/checkpoint").option("path", f"{place}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(r.value for r in spark.read.schema("value string").parquet(f"{place}/out").collect())


def put(spark, path, *own):
    lines.lines_to_log(spark.createDataFrame([(x,) for x in own], "value string"), path)


def test_both_ends_and_restarts(spark, tmp_path):
    log = f"{tmp_path}/log"
    put(spark, log, *(f"a{i}" for i in range(30)))
    first = sorted(f"a{i}" for i in range(30))
    assert drained(spark, log, f"{tmp_path}/x") == first
    assert drained(spark, log, f"{tmp_path}/y", earliest=False) == []
    with open(f"{log}/tail.log", "w") as f:
        f.write("b0\nb1\nhal")  # a line that is not whole yet
    assert drained(spark, log, f"{tmp_path}/x") == [*first, "b0", "b1"]
    with open(f"{log}/tail.log", "a") as f:
        f.write("f\né|ü\n")
    assert drained(spark, log, f"{tmp_path}/x") == [*first, "b0", "b1", "half", "é|ü"]
    assert drained(spark, log, f"{tmp_path}/y", earliest=False) == ["b0", "b1", "half", "é|ü"]
    spark.dataSource.register(LineLog)
    assert spark.read.format("linelog").option("path", log).load().count() == 34
    assert spark.read.format("linelog").option("path", f"{tmp_path}/none").load().count() == 0
    with pytest.raises(Exception, match="earliest or latest"):
        spark.readStream.format("linelog").option("path", log).option("startingOffsets", "middle").load().writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/z").trigger(availableNow=True).start().awaitTermination()


def test_a_job_on_logs_with_control(spark, tmp_path):
    text = f"x.schema=key,zip,city\nx.window=false\nx.rule.num=1\nx.rule.0=FD,zip,city\nx.output={tmp_path}/out\nkafka.data.delimiter=\\\\|\n"

    def go():
        start_live(spark, text, lines=lines.log_lines(spark, f"{tmp_path}/data"), control=lines.log_lines(spark, f"{tmp_path}/control")).awaitTermination()

    put(spark, f"{tmp_path}/data", "1|p|a", "2|p|a", "3|p|b", "what|p|a")
    go()
    put(spark, f"{tmp_path}/data", "4|p|c", "5|q|d", "3|p|b")
    put(spark, f"{tmp_path}/control", "del_rule|0")
    go()
    got = {(r.key, r.city, r.repaired) for r in spark.read.parquet(f"{tmp_path}/out/tuples").collect()}
    assert got == {(1, "a", False), (2, "a", False), (3, "a", True), (4, "c", False), (5, "d", False)}
