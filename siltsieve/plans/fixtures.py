"""Tables with sparse dirt over the test data: orders with their customers, and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import with_tid
from ..functions.rules import Rule, parse_rule

RULES: dict[int, Rule] = {i: parse_rule(i, t) for i, t in enumerate(["FD,custkey,segment", "FD,loc,segment", "CFD,custkey,segment,(cname neq null)", "CFD,custkey,segment,(status eq F)", "FD,cname,loc", "CFD,custkey,cname,(cname neq null)", "FD,custkey,cname"])}
COLUMNS = ["kid", "custkey", "loc", "segment", "cname", "status"]

DIRTY_SQL = """dirty AS (SELECT o.o_orderkey AS kid, row_number() OVER (ORDER BY o.o_orderkey) AS tid, CAST(o.o_custkey AS VARCHAR) AS custkey,
 CAST(c.c_nationkey AS VARCHAR) || '_' || c.c_mktsegment AS loc,
 CASE WHEN o.o_orderkey % 13 = 0 THEN 'ZZ_' || CAST(o.o_orderkey % 3 AS VARCHAR) ELSE c.c_mktsegment END AS segment,
 CASE WHEN o.o_orderkey % 11 = 0 THEN '' WHEN o.o_orderkey % 17 = 0 THEN 'null' ELSE c.c_name END AS cname, o.o_orderstatus AS status
 FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("o_orderkey")
    rows = o.join(c, o.o_custkey == c.c_custkey).select(
        k.alias("kid"),
        F.col("o_custkey").cast("string").alias("custkey"),
        F.concat_ws("_", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("loc"),
        F.when(k % 13 == 0, F.concat(F.lit("ZZ_"), (k % 3).cast("string"))).otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(k % 11 == 0, "").when(k % 17 == 0, "null").otherwise(F.col("c_name")).alias("cname"),
        F.col("o_orderstatus").alias("status"),
    )
    return with_tid(rows)


EVENT_RULES = {0: parse_rule(0, "FD,user_id,event_type"), 1: parse_rule(1, "FD,props,event_type")}
EVENTS_SQL = "ev AS (SELECT event_id AS kid, event_id + 1 AS tid, CAST(user_id AS VARCHAR) AS user_id, props, event_type FROM events)"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("kid"), (F.col("event_id") + 1).alias("tid"), F.col("user_id").cast("string").alias("user_id"), "props", "event_type")
