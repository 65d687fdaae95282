"""Optimizer steps as projections of a weight table.

g is the gradient with its minus sign and batch mean in it, so a step adds; biases take the mean
delta and subtract. Regularisation r = l2*w + l1*sgn(w) holds for weights only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMES = ("sgd", "momentum", "adagrad", "nesterov", "rmsprop", "adadelta", "adam")
_TINY = 1e-9


def step(name: str, weights: DataFrame, alpha: float, mu: float = 0.9, l2: float = 0.0, l1: float = 0.0, t: int = 0, mu1: float = 0.999, bias: bool = False) -> DataFrame:
    """weights(..., w, g[, v, vg]) with w, v and vg after one step; t counts steps from 0."""
    have = set(weights.columns)
    w, g = F.col("w"), F.col("g")
    v = F.col("v") if "v" in have else F.lit(0.0)
    vg = F.col("vg") if "vg" in have else F.lit(0.0)
    if bias:
        g = -g
    else:
        g = g - (F.lit(l2) * w + F.lit(l1) * F.signum(w))
    a, m = F.lit(alpha), F.lit(mu)
    new_v: Column = v
    new_vg: Column = vg
    if name == "sgd":
        out = w + a * g
    elif name == "momentum":
        new_v = m * v + a * g
        out = w + new_v
    elif name == "nesterov":
        new_v = m * v + a * g
        out = w + new_v + m * (new_v - v)
    elif name == "adagrad":
        new_v = v + g * g
        out = w + a * g / F.sqrt(F.greatest(F.lit(_TINY), new_v))
    elif name == "rmsprop":
        new_v = m * v + F.lit(1 - mu) * g * g
        out = w + a * g / F.sqrt(F.greatest(F.lit(_TINY), new_v))
    elif name == "adadelta":
        new_vg = m * vg + F.lit(1 - mu) * g * g
        dw = F.sqrt(F.greatest(F.lit(_TINY), v) / F.greatest(F.lit(_TINY), new_vg)) * g
        new_v = m * v + F.lit(1 - mu) * dw * dw
        out = w + dw
    elif name == "adam":
        new_v = m * v + F.lit(1 - mu) * g
        new_vg = F.lit(mu1) * vg + F.lit(1 - mu1) * g * g
        out = w + a * (new_v / F.lit(1 - mu ** (t + 1))) / (F.sqrt(new_vg / F.lit(1 - mu1 ** (t + 1))) + F.lit(1e-8))
    else:
        raise ValueError(f"unknown optimizer {name}")
    keys = [c for c in weights.columns if c not in ("w", "g", "v", "vg")]
    return weights.select(*keys, out.alias("w"), new_v.alias("v"), new_vg.alias("vg"))


def look_ahead(weights: DataFrame, mu: float) -> DataFrame:
    """The shift w + mu * v of a separate Nesterov look-ahead."""
    return weights.withColumn("w", F.col("w") + F.lit(mu) * F.col("v"))


def max_norm(weights: DataFrame, most: float, key: str = "dst") -> DataFrame:
    """Weights into each unit, scaled down to norm `most` where they exceed it."""
    from cellweave.functions.losses import clip_norm

    return clip_norm(weights, most, "w", key)


def decayed(alpha: float, decay: float, batches: int) -> float:
    return alpha / (1 + decay * batches) if decay > 0 else alpha


class Brake:
    """After `warm` steps an error over twice its moving average cuts the step to a tenth for `steps`
    steps; the first of them is left out."""

    def __init__(self, warm: int = 100, steps: int = 25):
        self.warm, self.steps, self.seen, self.left, self.mean = warm, steps, 0, 0, 0.0

    def factor(self, error: float) -> float:
        self.seen += 1
        out = 1.0
        if self.left:
            self.left -= 1
            out = 0.1
        elif self.seen > self.warm and error > 2 * self.mean:
            self.left = self.steps - 1
            out = 0.0
        self.mean = error if self.seen == 1 else 0.9 * self.mean + 0.1 * error
        return out
