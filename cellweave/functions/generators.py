"""Deterministic stand-ins for random numbers: arithmetic on keys, the same on every cluster."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime modulus and multipliers of the mixing steps (all products fit in 64 bits).
_P, _A, _B, _C = 2147483647, 48271, 69621, 40692


def uniform(*keys: Column, seed: int = 12134) -> Column:
    """A number in (0, 1] for each combination of whole-number keys."""
    h = F.lit(seed % _P).cast("bigint")
    for k in keys:
        h = F.pmod((F.pmod(h * _A + F.pmod(k.cast("bigint"), F.lit(_P)) * _B + 12345, F.lit(_P)) * _C + 67891), F.lit(_P))
    h = F.pmod(h * _A, F.lit(_P))
    return (h + 1).cast("double") / F.lit(float(_P))


def weight_init(scheme: str, src: Column, dst: Column, n_in: int, n_out: int, scale: float = 1.0, seed: int = 12134) -> Column:
    """Initial weight of the edge src -> dst."""
    u = uniform(src, dst, seed=seed)
    name = scheme.lower()
    spread = u * 2.0 - 1.0
    if name == "caffexavier":
        return spread * (scale * math.sqrt(3.0 / n_out))
    if name == "xavier":
        return spread * (0.5 * scale * math.sqrt(6.0 / (n_in + n_out)))
    if name == "uniform":
        return spread * scale
    if name == "unitball":
        return u * scale
    if name == "constant":
        return F.lit(-scale)
    normal = F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(2 * math.pi) * uniform(src, dst, seed=seed + 1))
    if name == "gaussian":
        return normal * scale
    if name == "selu":
        return normal * (1.0 / n_in)
    raise ValueError(f"unknown scheme {scheme}")


def formula_weights(rows: DataFrame, src: str, dst: str) -> DataFrame:
    """w = ((31 src + 17 dst + 7) mod 101) / 101 - 0.5: weights that any engine can recompute."""
    return rows.withColumn("w", F.pmod(F.col(src).cast("bigint") * 31 + F.col(dst).cast("bigint") * 17 + 7, F.lit(101)).cast("double") / F.lit(101.0) - F.lit(0.5))
