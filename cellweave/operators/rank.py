"""Top-k, score filters, recommendation by blocked products."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def topk(scores: DataFrame, k: int, key: str = "sample", idx: str = "idx", score: str = "score") -> DataFrame:
    """Rows with rank 1..k in each key: score descending, then index ascending. Partial top-k before the
    shuffle (a window group limit); further columns are carried."""
    if k < 1:
        raise ValueError("k must be positive")
    w = Window.partitionBy(key).orderBy(F.desc(score), F.asc(idx))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def topk_two_level(scores: DataFrame, k: int, shards: int, factor: int = 5, key: str = "sample", idx: str = "idx", score: str = "score") -> DataFrame:
    """The same by shards of the index range: factor * k of each shard, then k of those."""
    shard = scores.withColumn("shard", F.pmod(F.col(idx), F.lit(shards)))
    w = Window.partitionBy(key, "shard").orderBy(F.desc(score), F.asc(idx))
    return topk(shard.withColumn("r", F.row_number().over(w)).where(F.col("r") <= factor * k).drop("r", "shard"), k, key, idx, score)


def apply_filter(scores: DataFrame, filters: DataFrame, key: str = "sample", idx: str = "idx", lo: int | None = None, hi: int | None = None) -> DataFrame:
    """score * factor where filters(sample, feature, factor) names the cell; lo, hi: only that range."""
    f = filters.select(F.col("sample").alias(key), F.col("feature").alias(idx), "factor")
    if lo is not None:
        f = f.where((F.col(idx) >= lo) & (F.col(idx) < hi))
    return scores.join(f, [key, idx], "left").withColumn("score", F.col("score") * F.coalesce("factor", F.lit(1.0))).drop("factor")


def filter_rows(lines: DataFrame, samples: DataFrame, features: DataFrame) -> DataFrame:
    """filters(sample, feature, factor) from filter text: a missing factor is 0, unknown labels drop."""
    from cellweave.sources.text import index_cells, parse_samples

    return index_cells(parse_samples(lines), samples, features).withColumnRenamed("value", "factor")


class _Block:
    """Items of a block by kind: those of one kind have the same vector and bias, so the same score."""

    def __init__(self, idx: np.ndarray, kind: np.ndarray, mat: np.ndarray, bias):
        by = np.lexsort((idx, kind))
        self.members, self.kind, self.mat, self.bias = idx[by], kind[by], mat, bias  # by kind, then index
        self.size = np.bincount(kind, minlength=len(mat))
        self.start = np.cumsum(self.size) - self.size
        self.place = np.argsort(self.members, kind="stable")
        self.sorted = self.members[self.place]


def _runs(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of the lengths n: each element's run and its place there."""
    run = np.repeat(np.arange(len(n)), n)
    return run, np.arange(len(run)) - (np.cumsum(n) - n)[run]


def _block_best(vec: np.ndarray, skips: tuple[np.ndarray, np.ndarray, np.ndarray] | None, block: _Block, k: int, activation: str, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, idx, score) of the k best of each row. Activation and rounding keep the order, so they're
    applied only to what can still be among the best, and to filtered cells, whose factor may change it.
    skips: row, index and factor of the filtered cells."""

    def final(x: np.ndarray, factor=1.0) -> np.ndarray:
        return np.round((1.0 / (1.0 + np.exp(-x)) if activation == "sigmoid" else x) * factor, digits)

    n, rows = len(block.members), len(vec)
    s = vec @ block.mat.T + block.bias
    fr, fp, fs = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    if skips is not None and len(skips[0]):
        at = np.minimum(np.searchsorted(block.sorted, skips[1]), n - 1)
        ok = block.sorted[at] == skips[1]
        fr, fp = skips[0][ok], block.place[at[ok]]
        fs = final(s[fr, block.kind[fp]], skips[2][ok])
    gone = np.unique(fr * n + fp)
    pair, out = np.unique(gone // n * len(block.mat) + block.kind[gone % n], return_counts=True)  # filtered of a row and kind
    whole = pair[out == block.size[pair % len(block.mat)]]
    s[whole // len(block.mat), whole % len(block.mat)] = -np.inf
    m = min(k, s.shape[1])
    least = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m]
    # one unit of the last digit below the k-th best: all that could tie with it after rounding
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        edge = final(least) - 1.5 * 10.0**-digits
        cut = np.where(edge > 0, np.log(edge / (1 - np.minimum(edge, 1 - 1e-16))) - 1e-9, -np.inf) if activation == "sigmoid" else edge
    r, c = np.divmod(np.flatnonzero((s >= cut[:, None]) & (s > -np.inf)), s.shape[1])
    score = final(s[r, c])
    order = np.lexsort((-score, r))
    r, c, score = r[order], c[order], score[order]
    # kinds that come after k items of better ones are out
    cut_off = np.zeros(len(r), int)
    if len(pair):
        at = np.minimum(np.searchsorted(pair, r * len(block.mat) + c), len(pair) - 1)
        cut_off = np.where(pair[at] == r * len(block.mat) + c, out[at], 0)
    have = block.size[c] - cut_off
    before = np.cumsum(have) - have
    run = np.concatenate([[True], (r[1:] != r[:-1]) | (score[1:] != score[:-1])])[: len(r)]
    better = (before[run] - before[np.searchsorted(r, r[run])])[np.cumsum(run) - 1]
    stay = better < k
    r, c, score, cut_off, have = r[stay], c[stay], score[stay], cut_off[stay], have[stay]
    least = np.full(rows, np.inf)
    np.minimum.at(least, r, score)
    least[np.bincount(r, have, rows) < k] = -np.inf
    near = fs >= least[fr]
    which, at = _runs(np.minimum(block.size[c], k + cut_off))
    place = block.start[c][which] + at
    r, score = r[which], score[which]
    if len(gone):
        key = r * n + place
        free = gone[np.minimum(np.searchsorted(gone, key), len(gone) - 1)] != key
        r, place, score = r[free], place[free], score[free]
    r, idx, score = np.concatenate([r, fr[near]]), block.members[np.concatenate([place, fp[near]])], np.concatenate([score, fs[near]])
    order = np.lexsort((idx, -score, r))
    r, idx, score = r[order], idx[order], score[order]
    keep = np.arange(len(r)) - np.searchsorted(r, np.arange(rows))[r] < k
    return r[keep], idx[keep], score[keep]


def _matrix(lists: pa.ChunkedArray | pa.Array) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


def _blocks(items: DataFrame, most_items: int) -> Iterator[_Block]:
    """Blocks of items(idx, vec, b): at most most_items vectors each. Where there are no more different ones
    than that, they're sent once and the other items as (idx, kind), eight times as many to a block."""
    n = items.count()
    own = items.withColumn("h", F.xxhash64("vec", "b"))
    kinds = own.select("h", "vec", "b").distinct().limit(most_items + 1).toArrow()
    h = kinds["h"].to_numpy()
    few = len(h) <= most_items and len(np.unique(h)) == len(h)
    blocks = max(1, math.ceil(n / (8 * most_items if few else most_items)))
    for i in range(blocks):
        part = own.where(F.pmod(F.xxhash64("idx"), F.lit(blocks)) == i).select(F.col("idx").cast("long").alias("idx"), *(["h"] if few else ["vec", "b"])).toArrow()
        if not len(part):
            continue
        of, kind = kinds if few else part, np.arange(len(part))
        if few:
            order = np.argsort(h)
            kind = order[np.searchsorted(h, part["h"].to_numpy(), sorter=order)]
            seen, kind = np.unique(kind, return_inverse=True)  # a kind without an item here would be a best one
            of = kinds.take(seen)
        yield _Block(part["idx"].to_numpy(), kind, _matrix(of["vec"]), of["b"].to_numpy().astype(float))


def topk_products(queries: DataFrame, items: DataFrame, k: int, activation: str = "linear", digits: int = 6, most_items: int = 200_000, offset: str | None = None) -> DataFrame:
    """(sample, rank, idx, score): for each queries(sample, vec[, skip, factor]) the k best items(idx, vec
    [, b]) by activation(vec . vec + b) * factor, rounded to `digits` before ranking.

    skip and factor are equally long arrays: filtered indexes and their multipliers. Items are taken in
    blocks of at most most_items different vectors (a broadcast of bounded size each); a block is a matrix
    product with these and a partial top-k in a map over the queries, the blocks' top-k meet in a window
    group limit. Items with equal vectors and biases are multiplied once and told apart by index."""
    spark = queries.sparkSession
    has_skip = "skip" in queries.columns
    items = items.select("idx", "vec", F.col("b").cast("double") if "b" in items.columns else F.lit(0.0).alias("b"))
    cols = ["sample", "vec", *(["skip", "factor"] if has_skip else [])]
    # a row here is a product with all items: as many tasks as there are cores at least
    spread = queries.select(F.col("sample").cast("long").alias("sample"), *cols[1:]).repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "sample")
    out = None
    for block in _blocks(items, most_items):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            block = held.value
            step = max(256, min(4096, 2_000_000 // len(block.mat)))  # few kinds: more rows at once
            for batch in batches:
                for lo in range(0, batch.num_rows, step):
                    rows, skips = batch.slice(lo, step), None
                    if has_skip:
                        n = rows.column(2).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                        skips = np.repeat(np.arange(len(n)), n), *(rows.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
                    r, idx, score = _block_best(_matrix(rows.column(1)), skips, block, k, activation, digits)
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(r)), pa.array(idx, pa.int64()), pa.array(score, pa.float64())], names=["sample", "idx", "score"])

        part = spread.mapInArrow(run, "sample bigint, idx bigint, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "sample bigint, rank int, idx bigint, score double")
    return topk(out, k).select("sample", "rank", "idx", "score")


def k_sparse(units: DataFrame, k: int, key: str = "sample", idx: str = "unit", score: str = "a") -> DataFrame:
    """All units, those that aren't among a sample's k largest set to 0."""
    w = Window.partitionBy(key).orderBy(F.desc(score), F.asc(idx))
    return units.withColumn("__r", F.row_number().over(w)).withColumn(score, F.when(F.col("__r") <= k, F.col(score)).otherwise(0.0)).drop("__r")
