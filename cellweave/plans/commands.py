"""Running a command of the JSON command language: train, predict or validate a network on a data folder.

The data folder holds the datasets `input` and `output`; paths are read by Spark, except the network's
JSON, which the driver reads.
"""
from __future__ import annotations

from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.plans.network import Command, Network, parse_command, parse_network, resized
from cellweave.sources import dataset


def _network(spark: SparkSession, c: Command, inputs: dataset.Dataset, targets: dataset.Dataset) -> Network:
    spec = parse_network(Path(c.network).read_text())
    widths = {"input": inputs.of.width, "output": targets.of.width}
    spec = resized(spec, **{x.name: widths[x.kind] for x in spec.layers if x.n is None and x.kind in widths})
    for x in spec.layers:
        if x.kind in widths and x.n < widths[x.kind]:
            raise ValueError(f"layer {x.name} is narrower than its dataset")
    return Network(spark, spec, {}, c.seed)


def validate(net: Network, inputs: DataFrame, targets: DataFrame, step: float = 0.001, within: float = 20.0, block: int = 512) -> list[tuple[str, int | None, int, float]]:
    """The errors of the gradients against one-sided differences, of all weights and biases that differ by
    more than `within` steps (none: the gradients are right); src is null for a bias. `block` places at a
    time, each with its own copy of the samples."""
    edges, biases, base = net.gradients(inputs, targets)
    spark, wrong = net.spark, []
    tables = [((s, d), f"{s}-{d}", g.select("src", "dst", "g"), 1.0) for (s, d), g in edges.items()]
    tables += [(d, d, g.select(F.lit(None).cast("bigint").alias("src"), "dst", "g"), -1.0) for d, g in biases.items()]

    def check(key, name: str, rows: list, sign: float) -> None:
        table = spark.createDataFrame([(r["src"], r["dst"], step, i) for i, r in enumerate(rows)], "src bigint, dst bigint, by double, copy bigint")
        errors = net.errors_nudged(inputs, targets, {key: table if isinstance(key, tuple) else table.drop("src")}, len(rows))
        for i, r in enumerate(rows):
            error = abs((errors[i] - base) / step + sign * r["g"])
            if error > within * step:
                wrong.append((name, r["src"], r["dst"], error))

    for key, name, g, sign in tables:
        rows = []
        for r in g.toLocalIterator():
            rows.append(r)
            if len(rows) == block:
                check(key, name, rows, sign)
                rows = []
        if rows:
            check(key, name, rows, sign)
    return wrong


def run_command(spark: SparkSession, text: str, k: int | None = None, batch: int = 1024):
    """Train: the epochs' errors (the model goes to `results`); predict: top-k rows (written to `results`
    if named; k: 100, or the output's width where that is less); validate: the places where a gradient is wrong."""
    c = parse_command(text)
    inputs, targets = dataset.load(spark, f"{c.data}/input"), dataset.load(spark, f"{c.data}/output")
    if inputs.of.examples != targets.of.examples:
        raise ValueError("input and output have different numbers of examples")
    net = _network(spark, c, inputs, targets)
    if c.mode == "validate":
        net.spec = replace(net.spec, denoise=0.0)
        return validate(net, inputs.expanded(), targets.expanded())
    if c.mode == "predict":
        if c.checkpoint:
            net.load(c.checkpoint)
        found = net.predict(inputs.expanded(), min(100, targets.of.width) if k is None else k)
        if c.results:
            found.write.parquet(c.results)
        return found
    errors = net.train(
        inputs.expanded(), targets.expanded(), c.epochs, batch, c.optimizer, c.alpha, c.mu, c.l2,
        checkpoint=c.checkpoint, interval=c.checkpoint_interval, alpha_interval=c.alpha_interval, alpha_multiplier=c.alpha_multiplier,
    )
    if c.results:
        net.save(c.results)
    return errors
