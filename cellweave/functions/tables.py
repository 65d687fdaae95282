"""Lineage cuts: tables in the folder that the whole cluster shares."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; without it a temporary folder where all runs on one machine, as in tests, else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("a cluster must name a shared folder in spark.checkpoint.dir")
    return tempfile.mkdtemp(prefix="cellweave-")


def kept(df: DataFrame, name: str = "table", by: str | None = None) -> DataFrame:
    """df written to the shared folder and read again: its rows are fixed from then on and survive lost
    executors. by: a column to store it by."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cellweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)
