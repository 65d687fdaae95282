"""Dense layers as cells (sample, unit, a): products, biases, pooling, normalisation, convolution."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.fixed import fixed_sum
from cellweave.functions.generators import uniform


def dense_z(units: DataFrame, weights: DataFrame, a: str = "a") -> DataFrame:
    """(sample, unit, z) of units(sample, unit, a) and weights(src, dst, w)."""
    return units.join(weights, units["unit"] == weights["src"]).groupBy("sample", F.col("dst").alias("unit")).agg(fixed_sum(F.col(a) * F.col("w")).alias("z"))


def add_bias(z: DataFrame, *biases: DataFrame) -> DataFrame:
    """z plus the biases(unit, b) of any number of sources."""
    total = biases[0]
    for b in biases[1:]:
        total = total.unionByName(b)
    total = total.groupBy("unit").agg(fixed_sum(F.col("b")).alias("b"))
    return z.join(total, "unit", "left").select("sample", "unit", (F.col("z") + F.coalesce("b", F.lit(0.0))).alias("z"))


def skip_add(*layers: DataFrame) -> DataFrame:
    """Sum of aligned layers (sample, unit, a)."""
    total = layers[0]
    for x in layers[1:]:
        total = total.unionByName(x)
    return total.groupBy("sample", "unit").agg(fixed_sum(F.col("a")).alias("a"))


def scale_and_bias(x: Column, scale: float, bias: float) -> Column:
    """scale * x - bias: the bias is taken away."""
    return x * F.lit(scale) - F.lit(bias)


def dropout(units: DataFrame, p: float, target: float = 0.0, epoch: int = 0, seed: int = 12134) -> DataFrame:
    """Units with u < p take the target; the others are scaled by 1/(1-p) if the target is 0."""
    u = uniform(F.col("sample"), F.col("unit"), F.lit(epoch), seed=seed)
    keep = F.col("a") * F.lit(1.0 / (1.0 - p)) if target == 0.0 else F.col("a")
    return units.withColumn("a", F.when(u < F.lit(p), F.lit(target)).otherwise(keep))


def batch_norm(units: DataFrame, eps: float = 1e-5, gamma: float = 1.0, beta: float = 0.0) -> DataFrame:
    """Each unit at mean 0 and variance 1 over the samples; moments are a small joined aggregate."""
    m = units.groupBy("unit").agg((fixed_sum(F.col("a")) / F.count("*")).alias("m"), (fixed_sum(F.col("a") * F.col("a")) / F.count("*")).alias("q"))
    return units.join(m, "unit").select("sample", "unit", (F.lit(gamma) * (F.col("a") - F.col("m")) / F.sqrt(F.greatest(F.lit(0.0), F.col("q") - F.col("m") * F.col("m")) + F.lit(eps)) + F.lit(beta)).alias("a"))


def dot(x: Column, y: Column) -> Column:
    """Inner product of two arrays in double precision, added up in order."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def cosine(x: Column, y: Column) -> Column:
    return dot(x, y) / ((norm(x) + F.lit(1e-8)) * (norm(y) + F.lit(1e-8)))


def cosine_delta(x: Column, y: Column, d: Column) -> Column:
    """The delta that a cosine unit sends back to its source x."""
    a, b, dp = norm(x) + F.lit(1e-8), norm(y) + F.lit(1e-8), dot(x, y)
    return F.zip_with(x, y, lambda p, q: d * (q.cast("double") / (a * b) - p.cast("double") * dp / (a * a * a * b)))


def l2_normalised(x: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = norm(x)
    return F.when(n > 0, F.transform(x, lambda v: v.cast("double") / n)).otherwise(F.transform(x, lambda v: v.cast("double")))


def maxout(*layers: DataFrame) -> DataFrame:
    total = layers[0]
    for x in layers[1:]:
        total = total.unionByName(x)
    return total.groupBy("sample", "unit").agg(F.max("a").alias("a"))


def pool(grid: DataFrame, size: int, stride: int, kind: str, width: int, height: int) -> DataFrame:
    """(sample, channel, x, y, a) of windows size x size, stride apart, that fit into the plane."""
    nx, ny = (width - size) // stride + 1, (height - size) // stride + 1

    def windows(at: Column, n: int) -> Column:
        lo = F.greatest(F.lit(0), F.ceil((at - (size - 1)) / stride)).cast("int")
        hi = F.least(F.lit(n - 1), F.floor(at / stride)).cast("int")
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    spread = grid.select("sample", "channel", "a", F.col("y").alias("y0"), F.explode(windows(F.col("x"), nx)).alias("x")).select("sample", "channel", "a", "x", F.explode(windows(F.col("y0"), ny)).alias("y"))
    value = F.max("a") if kind == "max" else fixed_sum(F.col("a")) / F.lit(float(size * size))
    return spread.groupBy("sample", "channel", "x", "y").agg(value.alias("a"))


def lrn(grid: DataFrame, k: float = 2.0, n: int = 5, alpha: float = 1e-4, beta: float = 0.75) -> DataFrame:
    """Normalisation across neighbouring channels of each place."""
    w = Window.partitionBy("sample", "x", "y").orderBy("channel").rangeBetween(-(n // 2), n // 2)
    return grid.withColumn("a", F.col("a") / F.pow(F.lit(k) + F.lit(alpha / n) * F.sum(F.col("a") * F.col("a")).over(w), F.lit(beta)))


def convolve(grid: DataFrame, kernel: DataFrame, width: int, height: int) -> DataFrame:
    """(sample, out, x, y, z) of grid(sample, channel, x, y, a) and kernel(out, channel, dx, dy, w)."""
    j = grid.join(F.broadcast(kernel), "channel").select("sample", "out", (F.col("x") - F.col("dx")).alias("x"), (F.col("y") - F.col("dy")).alias("y"), (F.col("a") * F.col("w")).alias("p"))
    size = kernel.agg(F.max("dx"), F.max("dy")).first()
    return j.where((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") <= width - 1 - size[0]) & (F.col("y") <= height - 1 - size[1])).groupBy("sample", "out", "x", "y").agg(fixed_sum(F.col("p")).alias("z"))


def back_delta(deltas: DataFrame, weights: DataFrame) -> DataFrame:
    """(sample, unit, d): deltas(sample, unit, d) sent back through weights(src, dst, w)."""
    return deltas.join(weights, deltas["unit"] == weights["dst"]).groupBy("sample", F.col("src").alias("unit")).agg(fixed_sum(F.col("d") * F.col("w")).alias("d"))


def bias_gradient(deltas: DataFrame, batch: int) -> DataFrame:
    return deltas.groupBy("unit").agg((fixed_sum(F.col("d")) / F.lit(float(batch))).alias("g"))


def transpose(weights: DataFrame) -> DataFrame:
    return weights.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")


def biased_dropout(units: DataFrame, p: float, activation: str, alpha: float = 1.0, scale: float = 1.050701, epoch: int = 0, seed: int = 12134) -> DataFrame:
    """The form for ELU and SELU: a dropped unit sits at the saturation value, and all are scaled and
    shifted so that mean and variance stay."""
    low = -(scale if activation == "selu" else 1.0) * alpha
    q = 1.0 - p
    a = 1.0 / (q + low * low * p * q) ** 0.5
    b = -a * p * low
    u = uniform(F.col("sample"), F.col("unit"), F.lit(epoch), seed=seed)
    return units.withColumn("a", F.when(u < F.lit(p), F.lit(a * low + b)).otherwise(F.lit(a) * F.col("a") + F.lit(b)))


def dot_delta(x: Column, y: Column, d: Column) -> tuple[Column, Column]:
    """What a dot-product unit's delta sends back to its sources x and y."""
    back = lambda v: F.transform(v, lambda e: d * e.cast("double"))
    return back(y), back(x)


def maxout_delta(source: DataFrame, out: DataFrame, deltas: DataFrame) -> DataFrame:
    """(sample, unit, d) for a source of a maxout layer: the delta where it holds the maximum, else 0."""
    top = out.select("sample", "unit", F.col("a").alias("top"))
    return source.join(top, ["sample", "unit"]).join(deltas, ["sample", "unit"]).select("sample", "unit", F.when(F.col("a") == F.col("top"), F.col("d")).otherwise(0.0).alias("d"))


def _in_window(grid: DataFrame, size: int, stride: int, width: int, height: int) -> DataFrame:
    """grid with (px, py), a row for each pooling window that holds the cell."""
    nx, ny = (width - size) // stride + 1, (height - size) // stride + 1

    def windows(at: Column, n: int) -> Column:
        lo = F.greatest(F.lit(0), F.ceil((at - (size - 1)) / stride)).cast("int")
        hi = F.least(F.lit(n - 1), F.floor(at / stride)).cast("int")
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    return grid.withColumn("px", F.explode(windows(F.col("x"), nx))).withColumn("py", F.explode(windows(F.col("y"), ny)))


def pool_delta(grid: DataFrame, deltas: DataFrame, size: int, stride: int, kind: str, width: int, height: int) -> DataFrame:
    """(sample, channel, x, y, d) from deltas(sample, channel, x, y, d) of pooling windows: to the cell with
    the window's maximum (the first in order of y, x), or in equal shares."""
    cells = _in_window(grid, size, stride, width, height)
    of = deltas.select("sample", "channel", F.col("x").alias("px"), F.col("y").alias("py"), "d")
    key = ["sample", "channel", "px", "py"]
    if kind == "max":
        best = cells.groupBy(*key).agg(F.max(F.struct("a", (-F.col("y")).alias("my"), (-F.col("x")).alias("mx"))).alias("m"))
        shares = best.join(of, key).select("sample", "channel", (-F.col("m.mx")).alias("x"), (-F.col("m.my")).alias("y"), "d")
    else:
        shares = cells.join(of, key).select("sample", "channel", "x", "y", (F.col("d") / F.lit(float(size * size))).alias("d"))
    back = shares.groupBy("sample", "channel", "x", "y").agg(fixed_sum(F.col("d")).alias("d"))
    return grid.select("sample", "channel", "x", "y").join(back, ["sample", "channel", "x", "y"], "left").withColumn("d", F.coalesce("d", F.lit(0.0)))


def convolution_delta(deltas: DataFrame, kernel: DataFrame) -> DataFrame:
    """(sample, channel, x, y, d): deltas(sample, out, x, y, d) sent back through the kernel."""
    j = deltas.join(F.broadcast(kernel), "out")
    return j.groupBy("sample", "channel", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y")).agg(fixed_sum(F.col("d") * F.col("w")).alias("d"))


def convolution_gradient(grid: DataFrame, deltas: DataFrame, size: int, batch: int) -> DataFrame:
    """(out, channel, dx, dy, g): minus the batch mean of input times delta over all places."""
    shift = F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    spread = deltas.withColumn("dx", shift).withColumn("dy", shift).select("sample", "out", "dx", "dy", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "d")
    return grid.join(spread, ["sample", "x", "y"]).groupBy("out", "channel", "dx", "dy").agg((fixed_sum(F.col("a") * F.col("d")) * F.lit(-1.0 / batch)).alias("g"))


def batch_norm_delta(units: DataFrame, deltas: DataFrame, eps: float = 1e-5, gamma: float = 1.0) -> DataFrame:
    """(sample, unit, d) before the normalisation, from deltas behind it."""
    both = units.join(deltas, ["sample", "unit"])
    m = both.groupBy("unit").agg((fixed_sum(F.col("a")) / F.count("*")).alias("m"), (fixed_sum(F.col("a") * F.col("a")) / F.count("*")).alias("q"), (fixed_sum(F.col("d")) / F.count("*")).alias("md"), (fixed_sum(F.col("d") * F.col("a")) / F.count("*")).alias("mda"))
    s = F.sqrt(F.greatest(F.lit(0.0), F.col("q") - F.col("m") * F.col("m")) + F.lit(eps))
    n = (F.col("a") - F.col("m")) / s
    slope = (F.col("mda") - F.col("m") * F.col("md")) / s
    return both.join(m, "unit").select("sample", "unit", (F.lit(gamma) / s * (F.col("d") - F.col("md") - n * slope)).alias("d"))
