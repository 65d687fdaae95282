"""Embedding near-duplicates by Euclidean p-stable hashing.

Unit vectors are projected on Gaussian directions, shifted and cut into steps of width `step`; a
table's key is the tuple of `projections` steps. Vectors that share a key in some table are compared
by exact cosine in double precision; those at or over the threshold link.

The number of projections follows from the number of vectors (unrelated ones should share a bucket
with about `bucket` others), the number of tables from the wished recall at the very threshold: more
similar pairs are found with a higher chance. Both grow with the input (tables as a root of it).

Scale: equal vectors are one class with a count. A pair is counted in the first table in which it
meets, so no table of pairs is built; a task yields link counts and a spanning forest for each
bucket. A bucket of more than `block` classes is dealt out as pairs of blocks. No caps.

Defined cases: vectors that are null, empty, all zero or hold null or non-finite components have no
links and are their own component; vectors of different lengths don't link; repeated rows and equal
ids stay rows; a component whose ids are all null has a null id; empty tables give none.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.shared import Forest, connected_components, deal_blocks, ensure_workers_import, materialise, pick

_TILE = 1024


def meet_chance(distance: float, step: float) -> float:
    """Chance that two points at this distance share a step of one projection."""
    r = step / distance
    phi = 0.5 * (1 + math.erf(-r / math.sqrt(2)))
    return 1 - 2 * phi - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan_tables(n: int, threshold: float, recall: float, step: float, bucket: float) -> tuple[int, int]:
    """(projections, tables) for n vectors; unrelated vectors are taken as orthogonal."""
    near, far = meet_chance(math.sqrt(2 - 2 * threshold), step), meet_chance(math.sqrt(2), step)
    k = max(1, math.ceil(math.log(max(2.0, n / bucket)) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log1p(-(near**k))))


def _keys(unit: np.ndarray, k: int, tables: int, step: float, seed: int) -> np.ndarray:
    rng = np.random.default_rng([seed, unit.shape[1]])
    planes = rng.standard_normal((unit.shape[1], tables * k))
    shift = rng.uniform(0, step, tables * k)
    cell = np.floor((unit @ planes + shift) / step).astype(np.int64).astype(np.uint64).reshape(len(unit), tables, k)
    h = np.full((len(unit), tables), unit.shape[1], dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = (h ^ cell[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return (h >> np.uint64(32)).astype("<u4")


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1 in double precision, without overflow or underflow on the way."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _hashed(classes: DataFrame, k: int, tables: int, step: float, seed: int, kind: str) -> DataFrame:
    """(tab, key, cid, mult, keys, vec): a row for each class and table, vec as given (kind)."""
    schema = pa.schema([("tab", pa.int32()), ("key", pa.int64()), ("cid", pa.int64()), ("mult", pa.int64()), ("keys", pa.binary()), ("vec", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            cid, mult = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for d in np.unique(sizes):
                at = np.nonzero(sizes == d)[0]
                for lo in range(0, len(at), 512):
                    rows = at[lo : lo + 512]
                    x = flat[starts[rows][:, None] + np.arange(d)[None, :]]
                    keys = _keys(_unit(x), k, tables, step, seed)
                    bits, vecs = [r.tobytes() for r in keys], [r.astype(kind).tobytes() for r in x]
                    for t in range(tables):
                        n = len(rows)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(keys[:, t].astype(np.int64)), pa.array(cid[rows]), pa.array(mult[rows]), pa.array(bits, pa.binary()), pa.array(vecs, pa.binary())], schema=schema)

    return classes.select("cid", "mult", "embedding").mapInArrow(run, "tab int, key long, cid long, mult long, keys binary, vec binary")


def _compare(batches: Iterator[pa.RecordBatch], tables: int, threshold: float, kind: str) -> Iterator[pa.RecordBatch]:
    """A sorted stream of (tab, key, a, b, role, cid, mult, keys, vec) to forest links (a, b, null)
    and counts (a, null, n). Rows of role 0 are held, a block of them at most; the rest stream by."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
    out: list[list] = [[], [], []]
    group, held, forest, spot, counts = None, None, Forest(), {}, {}

    def close() -> None:
        for c, n in counts.items():
            out[0].append(c)
            out[1].append(None)
            out[2].append(n)
        counts.clear()

    def flush() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)
        for c in out:
            c.clear()
        return b

    def place(cid: int) -> int:
        at = spot.setdefault(cid, len(forest.up))
        forest.grow(at + 1)
        return at

    def compare(tab: int, x: tuple, y: tuple, first: int | None) -> None:
        """Links of x with y; first: y's position in x where y is its tail, else None."""
        for r in range(0, len(x[0]), _TILE):
            for s in range(0, len(y[0]), _TILE):
                if first is not None and first + s + _TILE <= r:
                    continue
                p, q = slice(r, r + _TILE), slice(s, s + _TILE)
                i, j = np.nonzero(x[3][p] @ y[3][q].T >= threshold)
                if first is not None:
                    below = i + r < j + s + first
                    i, j = i[below], j[below]
                for t in range(tab):  # those that met in an earlier table are counted there
                    if not len(i):
                        break
                    new = x[2][p][i, t] != y[2][q][j, t]
                    i, j = i[new], j[new]
                if not len(i):
                    continue
                ci, cj, mi, mj = x[0][p], y[0][q], x[1][p], y[1][q]
                for ids, n in ((ci, np.bincount(i, weights=mj[j], minlength=len(ci))), (cj, np.bincount(j, weights=mi[i], minlength=len(cj)))):
                    for k in np.nonzero(n)[0].tolist():
                        c = int(ids[k])
                        counts[c] = counts.get(c, 0) + int(n[k])
                at = np.array([place(c) for c in ci.tolist()])[i], np.array([place(c) for c in cj.tolist()])[j]
                name = dict(zip(at[0].tolist(), ci[i].tolist(), strict=True)) | dict(zip(at[1].tolist(), cj[j].tolist(), strict=True))
                for a, b in forest.links(*at):
                    out[0].append(name[a])
                    out[1].append(name[b])
                    out[2].append(None)

    for batch in batches:
        if not batch.num_rows:
            continue
        tab, key, a, b, role, cid, mult = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(7))
        keys = np.frombuffer(b"".join(batch.column(7).to_pylist()), "<u4").reshape(-1, tables)
        raw = batch.column(8).to_pylist()
        size = np.array([len(u) for u in raw])
        cut = np.nonzero((tab[1:] != tab[:-1]) | (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (role[1:] != role[:-1]) | (size[1:] != size[:-1]))[0] + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(tab)], strict=True):
            now = (tab[lo], key[lo], a[lo], b[lo], size[lo])
            if now != group:
                close()
                group, held, forest = now, None, Forest()
                spot.clear()
            part = (cid[lo:hi], mult[lo:hi].astype(np.float64), keys[lo:hi], _unit(np.frombuffer(b"".join(raw[lo:hi]), kind).reshape(hi - lo, -1)))
            if role[lo] == 0:
                n = 0 if held is None else len(held[0])
                held = part if held is None else tuple(np.concatenate([u, v]) for u, v in zip(held, part, strict=True))
                if a[lo] == b[lo] and len(held[0]) > 1:
                    compare(int(tab[lo]), held, part, n)
            elif held is not None:
                compare(int(tab[lo]), held, part, None)
            if len(out[0]) > 50_000:
                yield flush()
    close()
    if out[0]:
        yield flush()


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.98, step: float = 2.0, bucket: float = 256.0, block: int = 4096, seed: int = 7, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors."""
    spark = vectors.sparkSession
    ensure_workers_import(spark)
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"
    vectors = pick(vectors, id_col, vec_col)
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vec_col].cast(f"array<{'float' if single else 'double'}>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = rows.where(fit)
    classes = good.groupBy("embedding").agg(F.count("*").alias("mult"), F.min("vec_id").alias("least_id"))
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    k, tables = plan_tables(classes.count(), threshold, recall, step, bucket)
    dealt = deal_blocks(_hashed(classes, k, tables, step, seed, kind), ["tab", "key"], F.xxhash64("cid"), block)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    size = F.length("vec")
    stream = dealt.select("tab", "key", "a", "b", "role", "cid", "mult", "keys", "vec").repartition(parts, "tab", "key", "a", "b").sortWithinPartitions("tab", "key", "a", "b", size, "role")
    found = materialise(stream.mapInArrow(lambda it: _compare(it, tables, threshold, kind), "a long, b long, n long"), "vector-links")
    counts = found.where("n IS NOT NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("b IS NOT NULL").select("a", "b"))
    named = classes.join(roots, classes["cid"] == roots["node"], "left").join(counts, "cid", "left").select("embedding", "mult", "least_id", F.coalesce("root", "cid").alias("root"), F.coalesce("n", F.lit(0)).alias("n"))
    low = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = named.join(low, "root").select("embedding", (F.col("mult") - 1 + F.col("n")).alias("n_links"), "component_id")
    linked = good.join(named, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
