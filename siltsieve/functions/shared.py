"""The folder that driver and executors share, and cutting lineage into it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import ConfigError


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where a local session (a test) names none, a temporary folder. On a cluster that is an error."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ConfigError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="siltsieve-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


#: A writer holds a whole row group; each task has one.
ROW_GROUP_BYTES = 16 << 20


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """Compute df once into the shared folder (or a path in it): a lost executor loses nothing of it, and what reads it reads only the columns it needs."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders, wherever they lie; one that is not there is no matter."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
