"""Convolution, pooling and normalisation between whole layers (sample, unit, a).

Units are numbered x first, then y, z and w. A table of links(unit, row, place, n) says which source
unit reaches which place of a layer: `row` is the kernel's row, n the number of a place's links. It
has at most places x kernel cells and depends on the network alone. Cells that aren't stored are 0.
"""
from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.fixed import fixed_sum

#: The normalisation across channels, and the least variance of a batch.
LRN_K, LRN_N, LRN_ALPHA, LRN_BETA, NORM_EPS, COSINE_EPS = 2.0, 5, 1e-4, 0.75, 1e-5, 1e-8


def places(size: int, kernel: int, stride: int) -> tuple[int, int]:
    """(number of windows, padding before the first) along one axis."""
    if size <= kernel:
        return 1, (kernel - size + 1) // 2
    return (size, kernel // 2) if stride == 1 else ((size - kernel) // stride + 1, 0)


def _counted(links: DataFrame) -> DataFrame:
    return links.join(links.groupBy("place").agg(F.count("*").alias("n")), "place").select("unit", "row", "place", "n")


def window_links(spark: SparkSession, source: tuple[int, ...], kernel: tuple[int, ...], stride: tuple[int, ...], channels: int = 1) -> DataFrame:
    """Links of windows over the axes of source. channels: so many planes of this shape, one after the
    other, all of which a window covers, each with its own kernel rows."""
    cut = [places(*axis) for axis in zip(source, kernel, stride, strict=True)]
    whole = lambda c, k: F.floor(c / F.lit(k))
    at, tap, unit, inside, step = F.col("place"), F.col("tap"), F.lit(0), F.lit(True), 1
    for (n, pad), size, k, s in zip(cut, source, kernel, stride, strict=True):
        here = F.pmod(at, F.lit(n)) * s - pad + F.pmod(tap, F.lit(k))
        unit, inside, step = unit + here * step, inside & (here >= 0) & (here < size), step * size
        at, tap = whole(at, n), whole(tap, k)
    grid = spark.range(prod(n for n, _ in cut)).select(F.col("id").alias("place"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(prod(kernel) - 1).cast("bigint"))).alias("tap"))
    plane = grid.where(inside).select("place", "tap", unit.cast("bigint").alias("unit"))
    planes = plane.withColumn("c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(channels - 1).cast("bigint"))))
    return _counted(planes.select((F.col("c") * prod(source) + F.col("unit")).alias("unit"), (F.col("c") * prod(kernel) + F.col("tap")).alias("row"), "place"))


def channel_links(spark: SparkSession, width: int, plane: int) -> DataFrame:
    """Links of each unit to the units of the same spot in the channels around it; plane: units of a channel."""
    half = LRN_N // 2
    grid = spark.range(width).select(F.col("id").alias("place"), F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("c"))
    return _counted(grid.select((F.col("place") + F.col("c") * plane).cast("bigint").alias("unit"), (F.col("c") + half).cast("bigint").alias("row"), "place").where((F.col("unit") >= 0) & (F.col("unit") < width)))


def _reached(units: DataFrame, links: DataFrame) -> DataFrame:
    return units.select("sample", "unit", "a").join(links, "unit")


# ------------------------------------------------------------------ convolution


def convolved(units: DataFrame, links: DataFrame, kernel: DataFrame, size: int, w: str = "w", also: tuple[str, ...] = ()) -> DataFrame:
    """(sample, unit, a): a cell for each link and output channel that still has to be summed by unit. kernel(src:
    row, dst: channel, w); size: places of a channel; also: columns on which both sides must agree."""
    cells = units.join(links, "unit").withColumnRenamed("row", "src").join(kernel, ["src", *also])
    return cells.groupBy("sample", (F.col("dst") * size + F.col("place")).alias("unit")).agg(fixed_sum(F.col("a") * F.col(w)).alias("a"))


def _placed(deltas: DataFrame, size: int) -> DataFrame:
    return deltas.select("sample", F.floor(F.col("unit") / F.lit(size)).alias("dst"), F.pmod("unit", F.lit(size)).alias("place"), "d")


def convolved_back(deltas: DataFrame, links: DataFrame, kernel: DataFrame, size: int) -> DataFrame:
    """(sample, unit, d) of the source."""
    rows = _placed(deltas, size).join(kernel.select("src", "dst", "w"), "dst").groupBy("sample", "place", F.col("src").alias("row")).agg(fixed_sum(F.col("d") * F.col("w")).alias("d"))
    return rows.join(links, ["place", "row"]).groupBy("sample", "unit").agg(fixed_sum(F.col("d")).alias("d"))


def kernel_gradient(units: DataFrame, links: DataFrame, deltas: DataFrame, size: int, batch: int) -> DataFrame:
    """(src, dst, g): minus the batch mean over all places."""
    cells = _reached(units, links).join(_placed(deltas, size), ["sample", "place"])
    return cells.groupBy(F.col("row").alias("src"), "dst").agg((fixed_sum(F.col("a") * F.col("d")) * F.lit(-1.0 / batch)).alias("g"))


# ------------------------------------------------------------------ pooling


def _numbered(sources: list[DataFrame]) -> DataFrame:
    out = None
    for i, s in enumerate(sources):
        part = s.select("sample", "unit", "a", F.lit(i).cast("bigint").alias("i"))
        out = part if out is None else out.unionByName(part)
    return out


def _highest(count: Column, of: Column) -> Column:
    return F.when(count < of, F.greatest(F.max("a"), F.lit(0.0))).otherwise(F.max("a"))


def _against_first(sources: list[DataFrame]) -> DataFrame:
    """(sample, unit, i, x, y): cells of the first source beside those of each other."""
    rest = _numbered(sources).where("i > 0").select("sample", "unit", "i", F.col("a").alias("y"))
    first = sources[0].select("sample", "unit", F.col("a").alias("x"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(len(sources) - 1).cast("bigint"))).alias("i"))
    both = first.join(rest, ["sample", "unit", "i"], "full")
    return both.select("sample", "unit", "i", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))


def _products(pairs: DataFrame) -> DataFrame:
    p, x, y = F.col("x") * F.col("y"), F.col("x") * F.col("x"), F.col("y") * F.col("y")
    sums = pairs.groupBy("sample", "i").agg(fixed_sum(p).alias("dp"), fixed_sum(x).alias("xx"), fixed_sum(y).alias("yy"))
    return sums.select("sample", "i", "dp", (F.sqrt("xx") + COSINE_EPS).alias("nx"), (F.sqrt("yy") + COSINE_EPS).alias("ny"))


def pooled(kind: str, sources: list[DataFrame], links: list[DataFrame | None]) -> DataFrame:
    """(sample, unit, a) of a pooling layer; units without any cell of the sources are left out (0). Several
    sources of max, average and LRN pooling are pooled apart and must still be summed."""
    if kind in ("dotproduct", "cosine"):
        value = F.col("dp") if kind == "dotproduct" else F.col("dp") / (F.col("nx") * F.col("ny"))
        return _products(_against_first(sources)).select("sample", (F.col("i") - 1).alias("unit"), value.alias("a"))
    if kind == "maxout":
        return _numbered(sources).groupBy("sample", "unit").agg(_highest(F.count("*"), F.lit(len(sources))).alias("a"))
    out = None
    for s, l in zip(sources, links, strict=True):
        cells = _reached(s, l).groupBy("sample", F.col("place").alias("unit"))
        if kind == "max":
            part = cells.agg(_highest(F.count("*"), F.max("n")).alias("a"))
        elif kind == "average":
            part = cells.agg((fixed_sum(F.col("a")) / F.max("n")).alias("a"))
        else:
            part = s.select("sample", "unit", "a").join(cells.agg(_lrn_base().alias("base")), ["sample", "unit"]).select("sample", "unit", (F.col("a") * F.pow("base", F.lit(-LRN_BETA))).alias("a"))
        out = part if out is None else out.unionByName(part)
    return out


def _lrn_base() -> Column:
    return F.lit(LRN_K) + F.lit(LRN_ALPHA / LRN_N) * fixed_sum(F.col("a") * F.col("a"))


def pooled_back(kind: str, sources: list[DataFrame], links: list[DataFrame | None], deltas: DataFrame, which: int) -> DataFrame:
    """(sample, unit, d) of source number `which`, from the layer's deltas (sample, unit, d). Of equal cells
    of a max window the first takes the delta; of equal sources of maxout each does."""
    mine, l = sources[which].select("sample", "unit", "a"), links[which]
    if kind in ("dotproduct", "cosine"):
        pairs = _against_first(sources)
        d = deltas.select("sample", (F.col("unit") + 1).alias("i"), "d")
        if kind == "cosine":
            d = d.join(_products(pairs), ["sample", "i"])
        cells = pairs.join(d, ["sample", "i"])
        own, other, a, b = ("x", "y", "nx", "ny") if which == 0 else ("y", "x", "ny", "nx")
        slope = F.col(other) if kind == "dotproduct" else F.col(other) / (F.col(a) * F.col(b)) - F.col(own) * F.col("dp") / (F.pow(a, F.lit(3.0)) * F.col(b))
        cells = cells if which == 0 else cells.where(F.col("i") == which)
        return cells.groupBy("sample", "unit").agg(fixed_sum(F.col("d") * slope).alias("d"))
    if kind == "maxout":
        top = pooled(kind, sources, links).withColumnRenamed("a", "top")
        return mine.join(top, ["sample", "unit"]).join(deltas, ["sample", "unit"]).where(F.col("a") == F.col("top")).select("sample", "unit", "d")
    placed = deltas.select("sample", F.col("unit").alias("place"), "d")
    if kind == "average":
        return placed.join(l, "place").groupBy("sample", "unit").agg(fixed_sum(F.col("d") / F.col("n")).alias("d"))
    if kind == "max":
        best = _reached(mine, l).groupBy("sample", "place").agg((-F.max(F.struct("a", (-F.col("unit")).alias("u")))["u"]).alias("unit"))
        return best.join(placed, ["sample", "place"]).groupBy("sample", "unit").agg(fixed_sum(F.col("d")).alias("d"))
    base = _reached(mine, l).groupBy("sample", F.col("place").alias("unit")).agg(_lrn_base().alias("base"))
    at = mine.join(base, ["sample", "unit"]).join(deltas, ["sample", "unit"])
    own = at.select("sample", "unit", (F.col("d") * F.pow("base", F.lit(-LRN_BETA))).alias("d"))
    sent = at.select("sample", F.col("unit").alias("place"), (F.col("d") * F.col("a") * F.pow("base", F.lit(-LRN_BETA - 1))).alias("e"))
    back = sent.join(l, "place").groupBy("sample", "unit").agg(fixed_sum(F.col("e")).alias("e")).join(mine, ["sample", "unit"])
    return own.unionByName(back.select("sample", "unit", (F.lit(-2 * LRN_ALPHA * LRN_BETA / LRN_N) * F.col("a") * F.col("e")).alias("d"))).groupBy("sample", "unit").agg(fixed_sum(F.col("d")).alias("d"))


# ------------------------------------------------------------------ batch normalisation


def _mean(x: Column) -> Column:
    return fixed_sum(x) / F.count("*")


def moments(z: DataFrame, key: Column) -> DataFrame:
    """(dst, m, var, cells) over the batch; key: which units share moments."""
    m = z.groupBy(key.alias("dst")).agg(_mean(F.col("x")).alias("m"), _mean(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("cells"))
    return m.select("dst", "m", F.greatest(F.lit(0.0), F.col("q") - F.col("m") * F.col("m")).alias("var"), "cells")


def running(held: DataFrame, batch: DataFrame) -> DataFrame:
    """held(dst, m, var, calls) as the mean over all batches, the variance without its bias."""
    now = batch.select("dst", F.col("m").alias("bm"), (F.col("var") * F.col("cells") / F.greatest(F.lit(1), F.col("cells") - 1)).alias("bv"))
    step = F.lit(1.0) / (F.col("calls") + 1)
    return held.join(now, "dst").select("dst", (F.col("m") + step * (F.col("bm") - F.col("m"))).alias("m"), (F.col("var") + step * (F.col("bv") - F.col("var"))).alias("var"), (F.col("calls") + 1).alias("calls"))


def normalised(z: DataFrame, key: Column, of: DataFrame, scale: DataFrame, shift: DataFrame) -> DataFrame:
    """(sample, unit, x) of z(sample, unit, x) by the moments `of`, scale(dst, w) and shift(dst, w)."""
    by = of.select("dst", "m", "var").join(scale.select("dst", F.col("w").alias("scale")), "dst").join(shift.select("dst", F.col("w").alias("shift")), "dst")
    return z.withColumn("dst", key).join(by, "dst").select("sample", "unit", (F.col("scale") * (F.col("x") - F.col("m")) / F.sqrt(F.col("var") + NORM_EPS) + F.col("shift")).alias("x"))


def normalised_back(z: DataFrame, key: Column, deltas: DataFrame, of: DataFrame, scale: DataFrame, batch: int, live: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sample, unit, d) before the normalisation; (dst, g) of scale and of shift. live: the moments are the
    batch's own, so they move with it."""
    both = z.join(deltas, ["sample", "unit"]).withColumn("dst", key)
    by = of.select("dst", "m", F.sqrt(F.col("var") + NORM_EPS).alias("s")).join(scale.select("dst", F.col("w").alias("scale")), "dst")
    cells = both.join(by, "dst").withColumn("unitless", (F.col("x") - F.col("m")) / F.col("s"))
    sums = cells.groupBy("dst").agg(fixed_sum(F.col("d")).alias("sd"), fixed_sum(F.col("d") * F.col("unitless")).alias("sdn"), F.count("*").alias("cells"))
    d = F.col("d") - (F.col("sd") + F.col("unitless") * F.col("sdn")) / F.col("cells") if live else F.col("d")
    back = cells.join(sums, "dst").select("sample", "unit", (F.col("scale") / F.col("s") * d).alias("d"))
    return back, sums.select("dst", (F.col("sdn") / F.lit(float(batch))).alias("g")), sums.select("dst", (F.col("sd") / F.lit(float(batch))).alias("g"))
