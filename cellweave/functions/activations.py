"""Activations of pre-activations x, and their derivatives as functions of the activation a."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Defaults of the parameters.
SLOPE, ELU_ALPHA, SELU_LAMBDA, SELU_ALPHA = 1.0, 1.0, 1.050701, 1.673263
#: Names that a network may give but that compute nothing.
PARSED_ONLY = frozenset({"softplus", "softsign", "relumax", "linearmax"})


def _one() -> Column:
    return F.lit(1.0)


def activation(name: str, x: Column, slope: float = SLOPE, alpha: float = ELU_ALPHA, scale: float = SELU_LAMBDA) -> Column:
    name = name.lower()
    forms: dict[str, Callable[[], Column]] = {
        "sigmoid": lambda: _one() / (_one() + F.exp(-x)),
        "tanh": lambda: F.tanh(x),
        "relu": lambda: F.greatest(x, F.lit(0.0)),
        "lrelu": lambda: F.greatest(x, x * F.lit(slope)),
        "elu": lambda: F.when(x > 0, x).otherwise(F.lit(alpha) * (F.exp(x) - _one())),
        "selu": lambda: F.when(x > 0, x * F.lit(scale)).otherwise(F.lit(scale * alpha) * (F.exp(x) - _one())),
        "linear": lambda: x,
    }
    if name in PARSED_ONLY:
        return x
    if name not in forms:
        raise ValueError(f"unknown activation {name}")
    return forms[name]()


def derivative(name: str, a: Column, slope: float = SLOPE, alpha: float = ELU_ALPHA, scale: float = SELU_LAMBDA, dropout: float = 0.0) -> Column:
    """f'(a) for hidden layers. With dropout, tanh works on the scaled activation."""
    name = name.lower()
    s = 1.0 / (1.0 - dropout)
    if name == "sigmoid":
        return a * (_one() - a)
    if name == "tanh":
        r = a / F.lit(s)
        return F.lit(s) * (_one() - r * r)
    if name == "relu":
        return F.when(a > 0, 1.0).otherwise(0.0)
    if name == "lrelu":
        return F.when(a > 0, 1.0).otherwise(F.lit(slope))
    if name == "elu":
        return F.when(a > 0, 1.0).otherwise(a + F.lit(alpha))
    if name == "selu":
        return F.when(a > 0, F.lit(scale)).otherwise(a + F.lit(scale * alpha))
    if name == "linear" or name in PARSED_ONLY:
        return _one()
    raise ValueError(f"no derivative for {name}")


def softmax(cells: DataFrame, x: str = "x", key: str = "sample", out: str = "a") -> DataFrame:
    """Adds out: e^(x - max) over its sum in each sample, at most 1."""
    w = Window.partitionBy(key)
    e = F.exp(F.col(x) - F.max(x).over(w))
    return cells.withColumn("__e", e).withColumn(out, F.least(_one(), F.col("__e") / F.sum("__e").over(w))).drop("__e")
