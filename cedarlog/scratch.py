"""Tables of work in the folder that driver and executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Where it is unset, a local folder, but only for a local master: executors elsewhere could not read it."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.cedarlog.scratch", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="cedarlog-")
        spark.conf.set("spark.cedarlog.scratch", where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` and reads it back: lineage is cut there, and a lost executor costs no earlier step again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
