"""Exact nearest neighbours: a stated set of queries against all vectors, in blocks."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.dense import l2_normalised
from cellweave.operators.rank import topk_products


def nearest(queries: DataFrame, collection: DataFrame, k: int, normalise: bool = False, digits: int = 6, rank_digits: int = 12) -> DataFrame:
    """(query, rank, key, score) by inner product (cosine with normalise) of (key, vec) tables. Scores are
    ranked at rank_digits, so that the order of a sum's terms doesn't decide, and returned at `digits`. Ties go to
    the smaller key; fewer than k vectors give fewer rows. The smaller side is the one cut in blocks and
    broadcast: the collection's vectors, in blocks of bounded size."""
    if k < 1:
        raise ValueError("k must be positive")
    vec = l2_normalised(F.col("vec")) if normalise else F.col("vec").cast("array<double>")
    found = topk_products(queries.select(F.col("key").alias("sample"), vec.alias("vec")), collection.select(F.col("key").alias("idx"), vec.alias("vec")), k, digits=rank_digits)
    return found.select(F.col("sample").alias("query"), "rank", F.col("idx").alias("key"), F.round("score", digits).alias("score"))
