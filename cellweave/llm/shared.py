"""Helpers that the operators share: the shared folder, lineage cuts, connected components."""
from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ensure_workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package when only the driver's sys.path holds it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where none is set one of our own if all runs on one machine, as in
    tests, else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("a cluster must name a shared folder in spark.checkpoint.dir")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="cellweave-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cellweave/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held.written_at = path
    return held


def delete_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of `materialise` that nothing reads any more."""
    for t in tables:
        delete_folder(t.sparkSession, t.written_at)


def small(ids: DataFrame, most: int = 500_000) -> DataFrame:
    """A table of ids, broadcast if it has at most `most` rows, so that texts joined with it stay in place."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The first columns of just these names, in this order. Found by place, so further columns whose
    names are equal, or equal but for case, don't matter."""
    at = [df.columns.index(n) for n in names]
    placed = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return placed.select(*[f"c{i}" for i in at]).toDF(*names)


def kept_and_text(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """The columns of keep, then the text as `__text`."""
    at = [docs.columns.index(n) for n in [*keep, text_col]]
    placed = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return placed.select(*[F.col(f"c{i}").alias(n) for i, n in zip(at[:-1], keep, strict=True)], F.col(f"c{at[-1]}").cast("string").alias("__text"))


def as_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so extra columns of any name can't clash."""
    return pick(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the smallest node of its component.

    Alternating large-star and small-star steps, each an aggregate and an equi-join, so a node
    with very many neighbours is a partial aggregate and a splittable join side, never one task's
    list. Null or equal ends are no edges. Raises if max_rounds don't suffice (they grow with the
    logarithm of the longest path).
    """
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, mark = _written(pairs)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = now.select(F.col("v").alias("u"), F.col("u").alias("far")).join(low, "u").select(F.col("far").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # an edge's smaller end sends its larger end to the smallest neighbour of the smaller end
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v")
        last = now
        now, after = _written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        discard(last)
        if after == mark:
            break
        mark = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _written(pairs: DataFrame) -> tuple[DataFrame, tuple]:
    held = materialise(pairs, "edges")
    row = held.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return held, (row["n"], row["h"])


def deal_blocks(rows: DataFrame, keys: list[str], spread: Column, block: int, filed: Column | None = None) -> DataFrame:
    """Deal the rows of each bucket (keys) out as pairs of blocks (a, b), a <= b, with role 0 or 1.

    A bucket of up to `block` filed rows is the one group (0, 0) of role 0. A larger one gets
    ceil(rows / block) blocks, filled by the hash `spread`; each row goes to every pair that its block
    is in, so all pairs of rows meet in some group and none is larger than about two blocks. Rows that
    aren't filed only probe: they meet each block (b, b) once, with role 1.
    """
    filed = F.lit(True) if filed is None else filed
    full = rows.where(filed).groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > block).select(*keys, F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    full = materialise(full, "hot-buckets")
    few = full.limit(10_001).count() <= 10_000  # broadcast only then
    dealt = rows.join(F.broadcast(full) if few else full, keys, "left")
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = dealt.withColumn("home", F.pmod(spread, blocks.cast("long")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    a = F.when(filed, F.least("home", "other")).otherwise(F.col("other"))
    b = F.when(filed, F.greatest("home", "other")).otherwise(F.col("other"))
    role = F.when(filed, (F.col("home") > F.col("other")).cast("int")).otherwise(F.lit(1))
    return dealt.select(*[c for c in rows.columns if c != "role"], a.alias("a"), b.alias("b"), role.alias("role"))


class Forest:
    """Union-find over positions."""

    def __init__(self):
        self.up: list[int] = []

    def grow(self, n: int) -> None:
        self.up += range(len(self.up), n)

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def links(self, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int]]:
        """Those of the pairs (i, j) that join what wasn't joined before. Each round takes one pair for
        each i, so a dense block costs a few rounds instead of a step for each of its pairs."""
        while len(i):
            nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            root = np.array([self.find(x) for x in nodes.tolist()])[at]
            apart = root[: len(i)] != root[len(i) :]
            i, j = i[apart], j[apart]
            one, first = np.unique(i, return_index=True)
            for x, y in zip(one.tolist(), j[first].tolist(), strict=True):
                p, q = self.find(x), self.find(y)
                if p != q:
                    self.up[max(p, q)] = min(p, q)
                    yield x, y
