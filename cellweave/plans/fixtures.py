"""Derived tables that the queries run on, in Spark and as SQL for the oracle."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNITS = 8
CLASSES = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample: customer, feature: part, value: summed quantity (whole numbers, so exact)."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).groupBy(F.col("o_custkey").alias("sample"), F.col("l_partkey").alias("feature")).agg(F.sum("l_quantity").alias("value"))


def raw_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same before summing: a feature may repeat in a sample."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).select(F.col("o_custkey").alias("sample"), F.col("l_partkey").alias("feature"), F.col("l_quantity").alias("value"))


def formula(src, dst):
    return F.pmod(src.cast("bigint") * 31 + dst.cast("bigint") * 17 + 7, F.lit(101)).cast("double") / F.lit(101.0) - F.lit(0.5)


def wide_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature, w): an array of UNITS weights for each part."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("feature"))
    return p.select("feature", F.array(*[formula(F.col("feature"), F.lit(u)) for u in range(UNITS)]).alias("w"))


def class_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, unit, a, t, w): outputs in (0, 1) and one-hot targets of the embeddings' labels."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), "label")
    g = e.withColumn("unit", F.explode(F.sequence(F.lit(0), F.lit(CLASSES - 1))))
    a = (F.pmod(F.col("sample") * 31 + F.col("unit") * 17 + 7, F.lit(101)) + 1).cast("double") / F.lit(102.0)
    return g.select("sample", "unit", a.alias("a"), F.when(F.col("label") == F.col("unit"), 1.0).otherwise(0.0).alias("t"), (F.lit(1.0) + F.pmod(F.col("label"), F.lit(3)).cast("double") / F.lit(10.0)).alias("w"))


def x_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, unit, x): pre-activations from -2 to 2."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"))
    g = e.withColumn("unit", F.explode(F.sequence(F.lit(0), F.lit(CLASSES - 1))))
    return g.select("sample", "unit", (F.pmod(F.col("sample") * 13 + F.col("unit") * 7, F.lit(201)).cast("double") / F.lit(50.0) - F.lit(2.0)).alias("x"))


def embedding_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), F.posexplode("embedding").alias("unit", "a")).select("sample", "unit", F.col("a").cast("double").alias("a"))


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 4 channels of 4 x 4 places."""
    u = embedding_units(spark, sf_dir)
    return u.select("sample", F.floor(F.col("unit") / 16).cast("int").alias("channel"), F.pmod(F.col("unit"), F.lit(4)).alias("x"), F.pmod(F.floor(F.col("unit") / 4), F.lit(4)).cast("int").alias("y"), "a")


def edges(spark: SparkSession, sf_dir: str, outs: int = UNITS) -> DataFrame:
    """(src, dst, w, g, v, vg): weights from each part to `outs` units with a gradient and state."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src")).withColumn("dst", F.explode(F.sequence(F.lit(0), F.lit(outs - 1))))
    g = F.pmod(F.col("src") * 7 + F.col("dst") * 3, F.lit(41)).cast("double") / F.lit(100.0) - F.lit(0.2)
    v = F.pmod(F.col("src") * 5 + F.col("dst"), F.lit(19)).cast("double") / F.lit(100.0)
    return p.select("src", "dst", formula(F.col("src"), F.col("dst")).alias("w"), g.alias("g"), v.alias("v"), (v / F.lit(2.0)).alias("vg"))


SQL = {
    "cells": "cells AS (SELECT o_custkey AS sample, l_partkey AS feature, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)",
    "raw": "raw AS (SELECT o_custkey AS sample, l_partkey AS feature, l_quantity AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "grid": "grid AS (SELECT vec_id AS sample, u::INT AS unit, ((vec_id * 31 + u * 17 + 7) % 101 + 1)::DOUBLE / 102 AS a, CASE WHEN label = u THEN 1::DOUBLE ELSE 0::DOUBLE END AS t, 1::DOUBLE + (label % 3)::DOUBLE / 10 AS w FROM embeddings, range(10) r(u))",
    "xs": "xs AS (SELECT vec_id AS sample, u::INT AS unit, ((vec_id * 13 + u * 7) % 201)::DOUBLE / 50 - 2 AS x FROM embeddings, range(10) r(u))",
    "units": "units AS (SELECT vec_id AS sample, (i - 1)::INT AS unit, embedding[i]::DOUBLE AS a FROM embeddings, range(1, 65) r(i))",
    "plane": "plane AS (SELECT sample, (unit // 16)::INT AS channel, (unit % 4)::INT AS x, ((unit // 4) % 4)::INT AS y, a FROM units)",
    "edges": "edges AS (SELECT src, dst, ((src * 31 + dst * 17 + 7) % 101)::DOUBLE / 101 - 0.5 AS w, ((src * 7 + dst * 3) % 41)::DOUBLE / 100 - 0.2 AS g, ((src * 5 + dst) % 19)::DOUBLE / 100 AS v, ((src * 5 + dst) % 19)::DOUBLE / 100 / 2 AS vg FROM (SELECT p_partkey AS src, d::INT AS dst FROM part, range(8) r(d)))",
}


def with_(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names) + " "


def fixed(x: str) -> str:
    return f"(sum(CAST(round(({x}) * 1073741824::DOUBLE) AS BIGINT))::DOUBLE / 1073741824::DOUBLE)"


def w_sql(src: str, dst: str) -> str:
    return f"((({src}) * 31 + ({dst}) * 17 + 7) % 101)::DOUBLE / 101 - 0.5::DOUBLE"
