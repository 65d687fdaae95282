"""Sparse cells (sample, feature, value): statistics, products, gathers, denoising."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.fixed import fixed_sum, to_fixed, SCALE
from cellweave.functions.generators import uniform


def row_ranges(cells: DataFrame) -> DataFrame:
    """(sample, start, end): half-open ranges of the samples' cells, samples in order.

    Counts come first, so the running sum is over samples only; it's in blocks of samples, with a
    window over the blocks' totals."""
    n = cells.groupBy("sample").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("sample") / 4096))
    totals = n.groupBy("block").agg(F.sum("n").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.sum("n").over(Window.partitionBy("block").orderBy("sample"))
    out = n.withColumn("w", within).join(totals.select("block", before.alias("b")), "block")
    return out.select("sample", (F.col("b") + F.col("w") - F.col("n")).alias("start"), (F.col("b") + F.col("w")).alias("end"))


def feature_counts(cells: DataFrame) -> DataFrame:
    """(feature, n, most_repeats, repeating): stored cells, most in one sample, samples with a repeat."""
    each = cells.groupBy("feature", "sample").agg(F.count("*").alias("k"))
    return each.groupBy("feature").agg(F.sum("k").alias("n"), F.max("k").alias("most_repeats"), F.count_if(F.col("k") > 1).alias("repeating"))


def density(cells: DataFrame, examples: int, width: int) -> DataFrame:
    return cells.agg(F.count("*").alias("nnz")).select("nnz", (F.col("nnz") / F.lit(float(examples) * width)).alias("density"))


def gather(index: DataFrame, cells: DataFrame) -> DataFrame:
    """cells of every example of index(sample, unique_id)."""
    return index.join(cells.withColumnRenamed("sample", "unique_id"), "unique_id").select("sample", "feature", "value")


def weighted(cells: DataFrame, weights: DataFrame) -> DataFrame:
    return cells.join(weights, "sample", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def one_hot(rows: DataFrame, value: str, width: int) -> DataFrame:
    """(sample, feature, value): a dense boolean dataset of one number each, as `width` cells."""
    return rows.select("sample", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("feature"), F.col(value).alias("v")).select("sample", "feature", F.when(F.col("feature") == F.col("v"), 1.0).otherwise(0.0).alias("value"))


def denoise(cells: DataFrame, p: float, epoch: int = 0, seed: int = 12134) -> DataFrame:
    """Cells that survive (u >= p), scaled by 1/(1-p); u is fixed by sample, feature, epoch and seed."""
    u = uniform(F.col("sample"), F.col("feature"), F.lit(epoch), seed=seed)
    return cells.where(u >= F.lit(p)).withColumn("value", F.col("value") * F.lit(1.0 / (1.0 - p)))


def sparse_z(cells: DataFrame, weights: DataFrame, units: int, boolean: bool = False, bias: DataFrame | None = None) -> DataFrame:
    """(sample, unit, z): products of cells with weights(feature, w array of `units`).

    A stored cell is one joined row whatever the number of units; the sums are `units` aggregate
    columns with partial sums before the shuffle."""
    v = F.lit(1.0) if boolean else F.col("value")
    joined = cells.join(weights, "feature").select("sample", *[to_fixed(v * F.get("w", F.lit(u))).alias(f"u{u}") for u in range(units)])
    sums = joined.groupBy("sample").agg(*[F.sum(f"u{u}").alias(f"u{u}") for u in range(units)])
    z = sums.select("sample", F.posexplode(F.array(*[F.col(f"u{u}").cast("double") / F.lit(SCALE) for u in range(units)])).alias("unit", "z"))
    if bias is not None:
        z = z.join(F.broadcast(bias), "unit").select("sample", "unit", (F.col("z") + F.col("b")).alias("z"))
    return z


def weight_gradient(cells: DataFrame, deltas: DataFrame, batch: int, boolean: bool = False, sharing: int = 1) -> DataFrame:
    """(src, dst, g) = -1/(sharing * batch) * inputs^T deltas, from cells and deltas(sample, unit, d)."""
    v = F.lit(1.0) if boolean else F.col("value")
    return cells.join(deltas, "sample").groupBy(F.col("feature").alias("src"), F.col("unit").alias("dst")).agg((fixed_sum(v * F.col("d")) * F.lit(-1.0 / (sharing * batch))).alias("g"))
