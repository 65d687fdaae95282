"""Command line: generate, train, predict, knn-search, evaluate.

    python -m cellweave.cli generate -d NAME -i TEXT -o OUT -f FEATURES -s SAMPLES [-c | -m] [-t indicator|analog]
    python -m cellweave.cli train -c NETWORK.json -i IN -o TARGETS -n MODEL [-b 1024] [-e 40]
    python -m cellweave.cli predict -c NETWORK.json -n MODEL -r TEXT -d IN_FEATURES -l OUT_FEATURES -o OUT -k 100 [-f FILTERS]
    python -m cellweave.cli knn-search -i VECTORS -q QUERIES -o OUT -k 100 [--keys-only] [--normalise]
    python -m cellweave.cli evaluate -p SCORES -t TARGETS -k 10
"""
from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import evaluate, knn, rank
from cellweave.plans import network
from cellweave.sources import dataset, text


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cellweave")
    sub = p.add_subparsers(dest="command", required=True)
    g = sub.add_parser("generate", help="text to a dataset and its indexes")
    for flag, name in (("-d", "name"), ("-i", "input"), ("-o", "output"), ("-f", "features"), ("-s", "samples")):
        g.add_argument(flag, dest=name, required=True)
    how = g.add_mutually_exclusive_group()
    how.add_argument("-c", dest="create", action="store_true", help="new indexes (default)")
    how.add_argument("-m", dest="merge", action="store_true", help="add to the feature and sample indexes")
    g.add_argument("-t", dest="type", choices=("indicator", "analog"), default="indicator")
    t = sub.add_parser("train", help="train a network on two datasets")
    for flag, name in (("-c", "config"), ("-i", "input"), ("-o", "output"), ("-n", "model")):
        t.add_argument(flag, dest=name, required=True)
    t.add_argument("-b", dest="batch", type=int, default=1024)
    t.add_argument("-e", dest="epochs", type=int, default=40)
    t.add_argument("--optimizer", default="sgd")
    t.add_argument("--alpha", type=float, default=0.025)
    t.add_argument("--mu", type=float, default=0.5)
    t.add_argument("--l2", type=float, default=0.0001)
    r = sub.add_parser("predict", help="recommendations for text samples")
    for flag, name in (("-c", "config"), ("-n", "model"), ("-r", "input"), ("-d", "features"), ("-l", "labels"), ("-o", "output")):
        r.add_argument(flag, dest=name, required=True)
    r.add_argument("-f", dest="filters")
    r.add_argument("-k", dest="k", type=int, default=100)
    r.add_argument("--analog", action="store_true", help="use the input's values (default: presence alone)")
    k = sub.add_parser("knn-search", help="exact nearest neighbours of text vectors")
    for flag, name in (("-i", "input"), ("-q", "queries"), ("-o", "output")):
        k.add_argument(flag, dest=name, required=True)
    k.add_argument("-k", dest="k", type=int, default=100)
    k.add_argument("--keys-only", action="store_true")
    k.add_argument("--normalise", action="store_true")
    e = sub.add_parser("evaluate", help="precision, recall, nDCG and MRR of scores against targets")
    e.add_argument("-p", dest="scores", required=True, help="Parquet (sample, idx, score)")
    e.add_argument("-t", dest="targets", required=True, help="Parquet (sample, idx)")
    e.add_argument("-k", dest="k", type=int, default=10)
    return p


def _named(spark: SparkSession, parsed: DataFrame, label: str, order: str, path: str, merge: bool) -> DataFrame:
    """The index of a label column, written to path; with merge it starts from the one that is there."""
    old = text.load_index(spark, path) if merge else None
    index = text.build_index(parsed.select(F.col(label).alias("label"), F.col(order)), order, old)
    text.export_index(index, path + "-new" if merge else path)
    return text.load_index(spark, path + "-new" if merge else path)


def generate(spark: SparkSession, a: argparse.Namespace) -> None:
    parsed = text.parse_samples(text.ordered_lines(spark, a.input), appearance=True)
    features = _named(spark, parsed, "feature", "at", a.features, a.merge)
    samples = _named(spark, parsed, "sample", "first", a.samples, a.merge)
    cells = text.index_cells(parsed, samples, features)
    dataset.save(dataset.sparse(spark, a.name, cells, features.count(), boolean=a.type == "indicator"), a.output)


def _spec(path: str, widths: dict[str, int]) -> network.Spec:
    spec = network.parse_network(Path(path).read_text())
    return network.resized(spec, **{x.name: widths[x.kind] for x in spec.layers if x.n is None and x.kind in widths})


def train(spark: SparkSession, a: argparse.Namespace) -> list[float]:
    inputs, targets = dataset.load(spark, a.input), dataset.load(spark, a.output)
    spec = _spec(a.config, {"input": inputs.of.width, "output": targets.of.width})
    net = network.Network(spark, spec, {})
    errors = net.train(inputs.expanded(), targets.expanded(), a.epochs, a.batch, a.optimizer, a.alpha, a.mu, a.l2)
    net.save(a.model)
    return errors


def predict(spark: SparkSession, a: argparse.Namespace) -> None:
    features, labels = text.load_index(spark, a.features), text.load_index(spark, a.labels)
    parsed = text.parse_samples(text.ordered_lines(spark, a.input), appearance=True)
    samples = text.build_index(parsed.select(F.col("sample").alias("label"), "first"), "first")
    cells = text.index_cells(parsed, samples, features)
    cells = cells if a.analog else cells.withColumn("value", F.lit(1.0))
    pad = lambda n: -(-n // 128) * 128
    net = network.Network(spark, _spec(a.config, {"input": pad(features.count()), "output": pad(labels.count())}), {}).load(a.model)
    filters = rank.filter_rows(text.ordered_lines(spark, a.filters), samples, labels) if a.filters else None
    found = net.predict(cells, a.k, filters=filters)
    named = found.join(labels.select("label", "idx"), "idx").join(samples.select(F.col("label").alias("name"), F.col("idx").alias("sample")), "sample")
    text.format_recs(named, sample="name").write.text(a.output)


def knn_search(spark: SparkSession, a: argparse.Namespace) -> None:
    """Keys are numbered for the search and named again in the result."""
    vectors = text.numbered_rows(text.parse_vectors(spark.read.text(a.input)), [F.col("key")])
    queries = text.numbered_rows(text.parse_vectors(spark.read.text(a.queries)), [F.col("key")])
    name = lambda t, c: t.select(F.col("n").alias(c), F.col("key").alias(f"{c}_name"))
    found = knn.nearest(queries.select(F.col("n").alias("key"), "vec"), vectors.select(F.col("n").alias("key"), "vec"), a.k, a.normalise)
    named = found.join(name(queries, "query"), "query").join(name(vectors, "key"), "key").select(F.col("query_name").alias("query"), "rank", F.col("key_name").alias("key"), "score")
    text.format_neighbors(named, a.keys_only).write.text(a.output)


def evaluation(spark: SparkSession, a: argparse.Namespace) -> None:
    scores, targets = spark.read.parquet(a.scores), spark.read.parquet(a.targets)
    evaluate.precision_recall_ndcg(scores, targets, a.k).orderBy("j").show(a.k)
    evaluate.mrr(scores, targets).show()


def main(args: list[str] | None = None, spark: SparkSession | None = None):
    a = _parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("cellweave").getOrCreate()
    return {"generate": generate, "train": train, "predict": predict, "knn-search": knn_search, "evaluate": evaluation}[a.command](spark, a)


if __name__ == "__main__":
    main()
