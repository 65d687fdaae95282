"""Losses and output deltas of a cell: output a, target t, example weight w.

Sparse targets are never spread over the grid: a loss is the sum over all cells with t = 0 plus a
correction on the stored cells, two aggregates over data that exist.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.activations import derivative
from cellweave.functions.fixed import fixed_sum

EPS = 1e-12
#: Defaults of the margins.
ONE_TARGET, ZERO_TARGET, ONE_SCALE, ZERO_SCALE = 0.9, 0.1, 1.0, 1.0


@dataclass(frozen=True)
class Margin:
    one_target: float = ONE_TARGET
    zero_target: float = ZERO_TARGET
    one_scale: float = ONE_SCALE
    zero_scale: float = ZERO_SCALE


def _ln(x: Column) -> Column:
    return F.ln(F.greatest(F.lit(EPS), x))


def _hinge2(a: Column, t: Column) -> Column:
    d = a - F.abs(t)
    return F.when(t > 0, F.least(F.lit(0.0), d)).otherwise(F.greatest(F.lit(0.0), d))


def loss(name: str, a: Column, t: Column, w: Column | None = None, margin: Margin = Margin()) -> Column:
    w = F.lit(1.0) if w is None else w
    one, zero, m = F.lit(1.0), F.lit(0.0), margin
    if name == "l1":
        return w * F.abs(a - t)
    if name == "l2":
        return F.lit(0.5) * w * (a - t) * (a - t)
    if name == "l2hinge":
        return F.lit(0.5) * w * _hinge2(a, t) * _hinge2(a, t)
    if name == "hinge":
        return w * F.greatest(zero, one - t * a)
    if name == "crossentropy":
        return w * (-t * _ln(a) - (one - t) * _ln(one - a))
    if name == "multinomialcrossentropy":
        return -w * t * _ln(a)
    if name == "scaledmarginalcrossentropy":
        return w * F.when((t == 1) & (a < m.one_target), -F.lit(m.one_scale) * _ln(a)).when((t == 0) & (a > m.zero_target), -F.lit(m.zero_scale) * _ln(one - a)).otherwise(zero)
    if name == "multinomialscaledmarginalcrossentropy":
        return F.when((t != 0) & (a < m.one_target), -w * t * F.lit(m.one_scale) * _ln(a)).otherwise(zero)
    if name == "datascaledmarginalcrossentropy":  # positives scale by the stored value; weights are ignored
        return F.when((t != 0) & (a < m.one_target), -F.lit(m.one_scale) * t * _ln(a)).when((t == 0) & (a > m.zero_target), -F.lit(m.zero_scale) * _ln(one - a)).otherwise(zero)
    raise ValueError(f"unknown loss {name}")


def output_delta(name: str, act: str, a: Column, t: Column, w: Column | None = None, margin: Margin = Margin(), slope: float = 1.0, alpha: float = 1.0, scale: float = 1.050701) -> Column:
    """dLoss/dx of an output cell, as dispatched: the sum of losses over its batch isn't averaged here."""
    w = F.lit(1.0) if w is None else w
    zero, m, act = F.lit(0.0), margin, act.lower()

    def slope_of() -> Column:
        if act == "softmax":
            return F.lit(1.0)
        if act == "selu":  # the output form differs from the hidden one
            return F.when(a > 0, F.lit(scale)).otherwise(F.lit(scale * alpha) * F.exp(a))
        return derivative(act, a, slope, alpha, scale)

    if name == "l1":
        return w * F.signum(a - t) * slope_of()
    if name == "l2":
        return w * (a - t) * slope_of()
    if name == "l2hinge":
        return w * _hinge2(a, t) * slope_of()
    if name == "hinge":  # as the reference has it; not the loss's gradient
        return w * F.when(a < 0, -t).otherwise(zero)
    if name in ("crossentropy", "multinomialcrossentropy"):
        if act not in ("sigmoid", "softmax"):
            raise ValueError("cross entropy takes sigmoid or softmax outputs")
        return w * (a - t)
    if name in ("scaledmarginalcrossentropy", "multinomialscaledmarginalcrossentropy"):
        if act == "softmax":
            return F.when((t != 0) & (a < m.one_target), w * F.lit(m.one_scale) * (a - t)).when((t == 0) & (a > m.zero_target), w * F.lit(m.zero_scale) * (a - t)).otherwise(zero)
        return F.when((t == 1) & (a < m.one_target), w * F.lit(m.one_scale) * (a - t)).when((t == 0) & (a > m.zero_target), w * F.lit(m.zero_scale) * (a - t)).otherwise(zero)
    if name == "datascaledmarginalcrossentropy":
        if act == "softmax":
            raise ValueError("no softmax form")
        return F.when((t != 0) & (a < m.one_target), F.lit(m.one_scale) * t * (a - F.lit(1.0))).when((t == 0) & (a > m.zero_target), F.lit(m.zero_scale) * a).otherwise(zero)
    raise ValueError(f"unknown loss {name}")


def dense_loss(name: str, grid: DataFrame, margin: Margin = Margin()) -> DataFrame:
    """One row `loss` from grid(a, t[, w])."""
    w = F.col("w") if "w" in grid.columns else None
    return grid.agg(F.coalesce(fixed_sum(loss(name, F.col("a"), F.col("t"), w, margin)), F.lit(0.0)).alias("loss"))


def sparse_loss(name: str, outputs: DataFrame, targets: DataFrame, ignore_zero: bool = False, boolean: bool = True, margin: Margin = Margin(), keys: tuple[str, ...] = ("sample", "unit")) -> DataFrame:
    """The loss of outputs(keys, a[, w]) against stored targets(keys[, t]) without the grid of targets.

    boolean: stored cells count as t = 1, whatever they hold (cross entropies do so for any data)."""
    t = F.lit(1.0) if boolean or "t" not in targets.columns else F.col("t")
    w = F.col("w") if "w" in outputs.columns else None
    stored = outputs.join(targets.withColumn("__t", t).select(*keys, "__t"), list(keys))
    at = loss(name, F.col("a"), F.col("__t"), w, margin)
    if ignore_zero:
        return stored.agg(F.coalesce(fixed_sum(at), F.lit(0.0)).alias("loss"))
    base = loss(name, F.col("a"), F.lit(0.0), w, margin)
    raw = outputs.select(base.alias("x"))
    fix = stored.select((at - base).alias("x"))
    return raw.unionByName(fix).agg(F.coalesce(fixed_sum(F.col("x")), F.lit(0.0)).alias("loss"))


def regularization(weights: DataFrame, l2: float, l1: float, w: str = "w") -> DataFrame:
    return weights.agg(F.coalesce(fixed_sum(F.lit(0.5 * l2) * F.col(w) * F.col(w) + F.lit(l1) * F.abs(w)), F.lit(0.0)).alias("loss"))


def sparseness_penalty(units: DataFrame, p: float, beta: float, lo: float = 1e-6) -> DataFrame:
    """(unit, penalty): beta * (-p/q + (1-p)/(1-q)) of each hidden unit, q its clipped batch mean."""
    q = F.least(F.lit(1 - lo), F.greatest(F.lit(lo), fixed_sum(F.col("a")) / F.count("*")))
    return units.groupBy("unit").agg(q.alias("q")).select("unit", (F.lit(beta) * (F.lit(-p) / F.col("q") + F.lit(1 - p) / (F.lit(1.0) - F.col("q")))).alias("penalty"))


def clip_norm(deltas: DataFrame, most: float, d: str = "d", key: str = "sample") -> DataFrame:
    """Deltas of each example, scaled down to norm `most` where they exceed it."""
    norm = deltas.groupBy(key).agg(F.sqrt(fixed_sum(F.col(d) * F.col(d))).alias("__n"))
    return deltas.join(norm, key).withColumn(d, F.when(F.col("__n") > most, F.col(d) * F.lit(most) / F.col("__n")).otherwise(F.col(d))).drop("__n")


def with_share(targets: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """targets(sample, unit) with t: the example's weight, or 1 / (its number of targets) without weights,
    as sparse softmax targets have it."""
    n = targets.groupBy("sample").agg(F.count("*").alias("__n"))
    out = targets.join(n, "sample")
    if weights is None:
        return out.withColumn("t", F.lit(1.0) / F.col("__n")).drop("__n")
    return out.join(weights.select("sample", F.col("weight").alias("t")), "sample").drop("__n")


def sparse_softmax_loss(outputs: DataFrame, targets: DataFrame, weights: DataFrame | None = None, margin: Margin | None = None) -> DataFrame:
    """Cross entropy of softmax outputs against sparse targets; with margin, only where a is under the
    one-target, scaled by the one-scale."""
    stored = outputs.select("sample", "unit", "a").join(with_share(targets.select("sample", "unit"), weights), ["sample", "unit"])
    x = -F.col("t") * _ln(F.col("a"))
    if margin is not None:
        x = F.when(F.col("a") < margin.one_target, x * F.lit(margin.one_scale)).otherwise(0.0)
    return stored.agg(F.coalesce(fixed_sum(x), F.lit(0.0)).alias("loss"))


def sparse_softmax_delta(outputs: DataFrame, targets: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(sample, unit, d): a where nothing is stored (times the example's weight), a - share where it is."""
    t = with_share(targets.select("sample", "unit"), weights)
    grid = outputs.select("sample", "unit", "a").join(t, ["sample", "unit"], "left")
    w = F.lit(1.0)
    if weights is not None:
        grid = grid.join(weights.select("sample", F.col("weight").alias("__w")), "sample", "left")
        w = F.coalesce("__w", F.lit(1.0))
    return grid.select("sample", "unit", F.when(F.col("t").isNull(), w * F.col("a")).otherwise(F.col("a") - F.col("t")).alias("d"))


def sparse_boosted_delta(act: str, outputs: DataFrame, targets: DataFrame, boost_one: float = 1.0, boost_zero: float = 1.0, ignore_zero: bool = False) -> DataFrame:
    """(sample, unit, d) of squared error against stored ones: cells that aren't stored are scaled by
    boost_zero (0 with ignore_zero), stored ones by boost_one."""
    grid = outputs.select("sample", "unit", "a").join(targets.select("sample", "unit", F.lit(1.0).alias("t")), ["sample", "unit"], "left")
    f = derivative(act, F.col("a"))
    zero = F.lit(0.0 if ignore_zero else boost_zero) * F.col("a") * f
    return grid.select("sample", "unit", F.when(F.col("t").isNull(), zero).otherwise(F.lit(boost_one) * (F.col("a") - F.lit(1.0)) * f).alias("d"))
