"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits, each the majority of that bit over the hashes of all word shingles.
Fingerprints within `bits` differing bits link; links join documents to groups.

The search: correlated bits (co-occurrence counts over all fingerprints) are grouped into
partitions; a threshold t_i >= -1 per partition with sum(t_i + 1) = bits + 1 is chosen by dynamic
programming over estimated candidate counts, so two linked fingerprints must differ in at most t_i
bits of some partition i. Each fingerprint is filed under its masked bits and looks up all keys
within t_i flips; candidates of a bucket are verified on all bits.

Scale: equal fingerprints are one node. A bucket of more than `block` fingerprints is dealt out as
pairs of blocks, so no task holds an unbounded bucket, and a task yields a spanning forest of its
links, not all pairs. No caps: every linked pair is compared.

Defined cases: null and empty text have fingerprint 0 and link as any other; equal texts share a
group; repeated rows stay rows; a group whose ids are all null has a null id; empty tables give none.
"""
from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.shared import Forest, as_documents, connected_components, deal_blocks, discard, ensure_workers_import, materialise, small

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_CHUNK = 1 << 15
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits; sums of up to 255 rows fit a byte."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    out = bits[whole:].sum(0, dtype=np.uint8).astype(np.int64)
    if whole:
        out += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return out


def _majority(hashes: Iterator[np.ndarray]) -> int:
    ones, n = np.zeros(64, dtype=np.int64), 0
    for h in hashes:
        ones += _ones(h)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]) if n else 0


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of all shingles of A-Z-lowered text, in parts of bounded size."""
    from xxhash import xxh64_intdigest

    # bytes.split() cuts at space and \x09-\x0d, which UTF-8 uses for nothing else
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    n = max(1, len(w) - words + 1) if w else 0
    for at in range(0, n, _CHUNK):
        yield np.fromiter((xxh64_intdigest(b" ".join(w[i : i + words]), 42) for i in range(at, min(n, at + _CHUNK))), dtype="<u8")


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of each hash (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        z = h + np.uint64((k * _MIX[0]) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(_MIX[1])
        z = (z ^ (z >> np.uint64(27))) * np.uint64(_MIX[2])
        return z ^ (z >> np.uint64(31))


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    ensure_workers_import(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([_majority(shingle_hashes(t.as_py(), words)) for t in batch.column(1)], dtype="<u8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view("<i8"), pa.int64())], names=["doc_id", "fp"])

    return as_documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- the plan of partitions


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of rows and the 64 x 64 counts of rows that have both bits, over all rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((65, 65))
        for p in parts:
            x = p["fp"].to_numpy(dtype="<i8")
            for at in range(0, len(x), 1 << 14):
                y = x[at : at + (1 << 14)].copy()
                m = np.ones((len(y), 65), dtype=np.float32)
                m[:, :64] = np.unpackbits(y.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                total += m.T @ m
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "n": total[i, j]})

    both = np.zeros((65, 65))
    for i, j, n in fps.select("fp").mapInPandas(run, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n")).collect():  # 65 * 65 rows at most
        both[i, j] = n
    return int(both[64, 64]), both[:64, :64]


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """`parts` groups of bits of like size, each grown by the bit most correlated with the group."""
    p = np.diag(both) / max(1, n)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(1, n) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = set(range(64)), []
    for g in range(parts):
        size = 64 // parts + (g < 64 % parts)
        first = max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())
        group = [first]
        left.discard(first)
        while len(group) < size:
            best = max(sorted(left), key=lambda b: corr[b, group].sum())
            group.append(best)
            left.discard(best)
        out.append(sorted(group))
    return out


def pairs_within(n: int, both: np.ndarray, group: list[int], most: int) -> list[float]:
    """Estimated pairs of rows that differ in at most t bits of the group, t = 0..most.

    The bits form a chain: whether a pair of rows differs in a bit depends on whether it differs in the
    bit before, by the joint counts of the two bits."""
    n = max(1, n)
    p = np.diag(both) / n
    dist = np.zeros((2, len(group) + 1))  # (agrees or differs in the last bit, bits that differ)
    q = 2 * p[group[0]] * (1 - p[group[0]])
    dist[0, 0], dist[1, 1] = 1 - q, q
    for a, b in zip(group, group[1:], strict=False):
        c11 = both[a, b] / n
        c10, c01 = p[a] - c11, p[b] - c11
        c00 = 1 - c11 - c10 - c01
        move = np.array([[c11**2 + c10**2 + c01**2 + c00**2, 2 * (c11 * c10 + c01 * c00)], [2 * (c11 * c01 + c10 * c00), 2 * (c11 * c00 + c10 * c01)]])
        move /= np.maximum(move.sum(1, keepdims=True), 1e-300)
        agrees, differs = dist[0] * move[0, 0] + dist[1] * move[1, 0], dist[0] * move[0, 1] + dist[1] * move[1, 1]
        dist[0], dist[1, 0], dist[1, 1:] = agrees, 0, differs[:-1]
    near = np.cumsum(dist.sum(0))
    return [float(n * (n - 1) / 2 * near[min(t, len(group))]) for t in range(most + 1)]


#: Cost of a filed or probing row against that of one candidate's comparison.
ROW_COST = 400.0


def rows_of(group: list[int], t: int) -> int:
    """Rows of a node in a partition of threshold t: itself and its flips of up to t bits."""
    return sum(math.comb(len(group), d) for d in range(t + 1))


def thresholds(n: int, both: np.ndarray, groups: list[list[int]], bits: int, row_cost: float = ROW_COST) -> tuple[float, list[int]]:
    """Least estimated cost and the thresholds t_i >= -1 with sum(t_i + 1) = bits + 1."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for g in groups:
        found = pairs_within(n, both, g, bits)
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for t in range(-1, bits + 1):
                if used + t + 1 > bits + 1:
                    break
                rows = rows_of(g, t)
                if rows > 20_000:
                    break
                c = cost + (n * rows * row_cost + (1 + (t > 0)) * found[t] if t >= 0 else 0)
                if used + t + 1 not in nxt or c < nxt[used + t + 1][0]:
                    nxt[used + t + 1] = (c, [*ts, t])
        best = nxt
    return best.get(bits + 1, (math.inf, []))


def plan_partitions(n: int, both: np.ndarray, bits: int, row_cost: float = ROW_COST) -> list[tuple[list[int], int]]:
    """(bits of the partition, threshold) with the least estimated cost over 1 to bits + 2 partitions."""
    n = max(1, n)
    best: tuple[float, list] = (math.inf, [])
    for m in range(1, min(64, bits + 2) + 1):
        groups = group_bits(n, both, m)
        cost, ts = thresholds(n, both, groups, bits, row_cost)
        if cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, ts, strict=True) if t >= 0])
    return best[1]


def differing(similar: float) -> float:
    """Chance that a bit differs between sets of this Jaccard similarity (the most, at equal sizes)."""
    return math.acos(min(1.0, 2 * similar / (1 + similar))) / math.pi


def meet_chance(plan: list[tuple[list[int], int]], p: float) -> float:
    """Chance that a pair whose bits differ independently with chance p meets in some partition."""
    miss = 1.0
    for group, t in plan:
        miss *= 1 - sum(math.comb(len(group), d) * p**d * (1 - p) ** (len(group) - d) for d in range(t + 1))
    return 1 - miss


def plan_for(n: int, both: np.ndarray, similar: float, recall: float, most_rows: int = 24) -> list[tuple[list[int], int]]:
    """The plan of the smallest radius in which pairs at `similar` meet with the chance `recall`.

    A node has at most most_rows rows however many nodes there are, as these rows are what is shuffled:
    rows count for more until a plan has no more. Where no such plan reaches the recall, rows are unbounded."""
    for most in (most_rows, math.inf):
        for bits in range(64):
            cost = ROW_COST
            plan = plan_partitions(n, both, bits, cost)
            while sum(rows_of(g, t) for g, t in plan) > most and cost < 1e15:
                cost *= 32
                plan = plan_partitions(n, both, bits, cost)
            if meet_chance(plan, differing(similar)) >= recall and sum(rows_of(g, t) for g, t in plan) <= most:
                return plan
            if bits >= most:  # a plan has bits + 1 rows at least
                break
    return plan


# ---------------------------------------------------------------- probe and verify


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _signatures(fps: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """A row (part, key, role, fp, ...) per partition (role 0: filed) and per flip of up to t bits (role 1)."""
    probes = []
    for part, (group, t) in enumerate(plan):
        mask = F.lit(_signed(sum(1 << b for b in group))).cast("long").alias("mask")
        for d in range(t + 1):
            for flip in itertools.combinations(group, d):
                probes.append(F.struct(F.lit(part).alias("part"), mask, F.lit(_signed(sum(1 << b for b in flip))).cast("long").alias("flip"), F.lit(int(d > 0)).alias("role")))
    return fps.select("*", F.explode(F.array(*probes)).alias("s")).select(F.col("s.part").alias("part"), F.col("fp").bitwiseAND(F.col("s.mask")).bitwiseXOR(F.col("s.flip")).alias("key"), F.col("s.role").alias("role"), *fps.columns)


_TILE = 512  # pairs of fingerprints that stay in a core's cache


def _links_of(batches: Iterator[pa.RecordBatch], bits: int, wide: int, wide_bits: int) -> Iterator[pa.RecordBatch]:
    """A sorted stream of (part, key, a, b, role, fp, node, wide) to links of nodes: filed rows first,
    then those that probe. Filed rows of one group are held (about a block at most), the others stream by."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    none = (np.zeros(0, "<u8"), np.zeros(0, "<i8"), np.zeros((0, wide), "<u8"))
    group, filed, forest, probing = None, none, Forest(), {}
    out: tuple[list, list] = ([], [])

    def compare(x: tuple, y: tuple, first: int | None) -> None:
        """Links between x, all that is filed, and y; first: y's position in x, None for probing rows."""
        for r in range(0, len(x[0]), _TILE):
            for s in range(0, len(y[0]), _TILE):
                (p, pn, pw), (q, qn, qw) = (v[r : r + _TILE] for v in x), (v[s : s + _TILE] for v in y)
                # places of a flat array are found several times faster than those of two dimensions
                i, j = np.divmod(np.flatnonzero(np.bitwise_count(p[:, None] ^ q[None, :]) <= bits), len(q))
                other = pn[i] != qn[j]
                i, j = i[other], j[other]
                if wide and len(i):
                    near = np.bitwise_count(pw[i] ^ qw[j]).sum(1, dtype=np.int64) <= wide_bits
                    i, j = i[near], j[near]
                if not len(i):
                    continue
                if first is None:
                    where = np.zeros(len(q), dtype=np.int64)
                    for k in np.unique(j).tolist():
                        where[k] = probing.setdefault(int(qn[k]), len(forest.up))
                        forest.grow(int(where[k]) + 1)
                    at = where[j]
                else:
                    at = j + s + first
                value = dict(zip(at.tolist(), qn[j].tolist(), strict=True))
                for a, b in forest.links(i + r, at):
                    out[0].append(int(x[1][a]))
                    out[1].append(value[b])

    def flush() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)
        out[0].clear()
        out[1].clear()
        return b

    for batch in batches:
        if not batch.num_rows:
            continue
        part, key, a, b, role, fp, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(7))
        fp = fp.astype("<i8").view("<u8")
        w = batch.column(7).flatten().to_numpy(zero_copy_only=False).astype("<i8").view("<u8").reshape(-1, wide) if wide else np.zeros((len(fp), 0), "<u8")
        cut = np.nonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (role[1:] != role[:-1]))[0] + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(fp)], strict=True):
            now = (part[lo], key[lo], a[lo], b[lo])
            if now != group:
                group, filed, forest = now, none, Forest()
                probing.clear()
            x = (fp[lo:hi], node[lo:hi], w[lo:hi])
            if role[lo] == 0:
                n = len(filed[0])
                filed = tuple(np.concatenate([u, v]) for u, v in zip(filed, x, strict=True))
                forest.grow(len(filed[0]))
                if a[lo] == b[lo] and len(filed[0]) > 1:
                    compare(filed, x, n)
            elif len(filed[0]):
                compare(filed, x, None)
            if len(out[0]) > 50_000:
                yield flush()
    if out[0]:
        yield flush()


def links(fps: DataFrame, bits: int, wide: int = 0, wide_bits: int = 0, block: int = 4096, plan: list | None = None) -> DataFrame:
    """Links (a, b) that join the nodes that meet in a partition of the plan and whose fingerprints are
    within `bits` (and, with wide, within wide_bits of the wide part), from rows (fp, node, wide). The plan
    of `bits` lets all of these meet. A spanning forest per bucket: enough for groups."""
    plan = plan or plan_partitions(*bit_counts(fps), bits)
    dealt = deal_blocks(_signatures(fps, plan), ["part", "key"], F.xxhash64("node"), block, F.col("role") == 0).select("part", "key", "a", "b", "role", "fp", "node", "wide")
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return dealt.repartition(parts, "part", "key", "a", "b").sortWithinPartitions("part", "key", "a", "b", "role").mapInArrow(lambda it: _links_of(it, bits, wide, wide_bits), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4, block: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of docs; component_id: the smallest reachable doc_id.
    Rows with equal fingerprints are one node."""
    prints = materialise(fingerprints(docs, words, id_col, text_col), "fingerprints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    roots = connected_components(links(nodes.select("fp", F.col("fp").alias("node"), F.array().cast("array<long>").alias("wide")), bits, block=block))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    low = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = named.join(low, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- exact confirmation


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(np.concatenate([np.zeros(0, "<u8"), *shingle_hashes(text, words)]))


def set_prints(docs: DataFrame, words: int, prints: int) -> DataFrame:
    """(doc_id, digest, prints): fingerprints of the set of shingles (repeats count once, as in a
    Jaccard similarity) and a 128-bit digest of the set."""
    from xxhash import xxh3_128_digest

    ensure_workers_import(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("prints", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, found = [], []
            for text in batch.column(1):
                h = shingle_set(text.as_py(), words)
                digests.append(xxh3_128_digest(h.tobytes()))
                ones = np.zeros((prints, 64), dtype=np.int64)
                for at in range(0, len(h), _CHUNK):
                    part = h[at : at + _CHUNK]
                    for k in range(prints):
                        ones[k] += _ones(mixed(part, k) if k else part)
                found.append(np.packbits(2 * ones > len(h), axis=1, bitorder="little").view("<i8").ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(found, pa.list_(pa.int64()))], schema=schema)

    return docs.mapInArrow(run, "doc_id long, digest binary, prints array<long>")


def _similar_pairs(nodes: np.ndarray, known: np.ndarray, side: np.ndarray, sets: list[np.ndarray], similar: float, cross: bool) -> Iterator[tuple[int, int]]:
    """A forest of links that joins all pairs of nodes at `similar` or more that `known`, a label of each
    node, doesn't join yet; with cross, only pairs of both sides."""
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]  # the empty set is like no other
    nodes, side, size, label = nodes[order], side[order], size[order], np.unique(known[order], return_inverse=True)[1]
    if len(order) < 2:
        return
    values, ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(len(values), dtype=np.int32)
    # in order of size, those that may be similar to one follow it without a gap
    last = np.searchsorted(size * similar, size + 1e-9, side="right")
    for i in range(len(order) - 1):
        may = label[i + 1 : last[i]] != label[i]
        if cross:
            may &= side[i + 1 : last[i]] != side[i]
        j = np.nonzero(may)[0] + i + 1
        if not len(j):
            continue
        mark[ids[at[i] : at[i + 1]]] = 1
        if 4 * len(j) < len(may):
            part = np.concatenate([ids[at[k] : at[k + 1]] for k in j.tolist()])
            both = np.add.reduceat(mark[part], np.concatenate([[0], np.cumsum(size[j])[:-1]]))
        else:
            both = np.add.reduceat(mark[ids[at[i + 1] : at[last[i]]]], at[i + 1 : last[i]] - at[i + 1])[j - i - 1]
        mark[ids[at[i] : at[i + 1]]] = 0
        j = j[both + 1e-9 >= similar * (size[i] + size[j] - both)]
        if len(j):
            joined, first = np.unique(label[j], return_index=True)
            for k in j[first].tolist():
                yield int(nodes[i]), int(nodes[k])
            label[np.isin(label, joined)] = label[i]


def _confirmed(batches: Iterator[pa.RecordBatch], similar: float) -> Iterator[pa.RecordBatch]:
    """A sorted stream of (root, a, b, side, node, known, shingles) to confirmed links: each group
    (root, a, b) is compared within, or where a <> b across its two sides."""

    def close() -> pa.RecordBatch:
        nodes, known, side = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(3))
        found = list(_similar_pairs(nodes, known, side, [r[3] for r in rows], similar, group[1] != group[2]))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    group, rows = None, []
    for batch in batches:
        root, a, b, side, node, known = (batch.column(i).to_pylist() for i in range(6))
        for r in range(batch.num_rows):
            now = (root[r], a[r], b[r])
            if now != group:
                if len(rows) > 1:
                    yield close()
                group, rows = now, []
            rows.append((node[r], known[r], side[r], np.frombuffer(batch.column(6)[r].as_py(), "<u8")))
    if len(rows) > 1:
        yield close()


def _compared(dealt: DataFrame, similar: float) -> DataFrame:
    """Confirmed links (a, b), written, of rows (root, a, b, side, node, known, shingles)."""
    parts = max(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = dealt.select("root", "a", "b", "side", "node", "known", "shingles")
    return materialise(rows.repartition(parts, "root", "a", "b").sortWithinPartitions("root", "a", "b").mapInArrow(lambda it: _confirmed(it, similar), "a long, b long"), "confirmed")


def _weight(block_bytes: int):
    """Blocks that the rows' shingles fill."""
    return F.greatest(F.lit(1), F.ceil(F.sum(F.octet_length("shingles") + 64) / block_bytes)).cast("int")


def confirmed_links(held: DataFrame, similar: float, block_bytes: int) -> DataFrame:
    """Links that join all pairs at `similar` or more within each root of rows (root, node, shingles).

    A root of one block is compared in one task. A larger one is first dealt out by a hash and compared
    within its blocks, then the smallest nodes of the clusters found so far are compared in the same way;
    last, all pairs of blocks are compared but for those that lie in one cluster. Large clusters
    have blocks of their own, so a group of copies, however large, meets only the blocks of the others."""
    zero, node = F.lit(0), F.col("node")
    large = materialise(held.groupBy("root").agg(_weight(block_bytes).alias("blocks")).where("blocks > 1"), "blocks")
    home = F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1)).cast("long")).cast("int")
    rows = held.join(small(large), "root", "left").withColumn("a", home)
    found = _compared(rows.select("root", "a", F.col("a").alias("b"), zero.alias("side"), "node", node.alias("known"), "shingles"), similar)
    if large.isEmpty():
        return found
    rest = held.join(small(large.select("root")), "root", "left_semi")

    def named(links: DataFrame) -> DataFrame:
        return rest.join(connected_components(links).select("node", F.col("root").alias("known")), "node", "left").select("root", "node", F.coalesce("known", "node").alias("known"), "shingles")

    heads = named(found).where("node = known")
    dealt = small(materialise(heads.groupBy("root").agg(_weight(block_bytes).alias("blocks")), "blocks"))
    more = _compared(heads.join(dealt, "root").withColumn("a", home).select("root", "a", F.col("a").alias("b"), zero.alias("side"), "node", "known", "shingles"), similar)
    found = found.unionByName(more)
    rows = materialise(named(found), "clusters")
    # the blocks: a cluster of more than one block has its own, the other rows of the root share
    size = rows.groupBy("root", "known").agg(_weight(block_bytes).alias("own"), F.sum(F.octet_length("shingles") + 64).alias("bytes"))
    shared = size.where("own = 1").groupBy("root").agg(F.greatest(F.lit(1), F.ceil(F.sum("bytes") / block_bytes)).cast("int").alias("blocks")).withColumn("of", F.lit(None).cast("long"))
    blocks = materialise(shared.unionByName(size.where("own > 1").select("root", F.col("own").alias("blocks"), F.col("known").alias("of"))), "blocks")
    rows = rows.join(small(blocks.select("root", F.col("of").alias("known"), F.lit(True).alias("large")).where("known IS NOT NULL")), ["root", "known"], "left")
    rows = rows.withColumn("of", F.when(F.col("large"), F.col("known")))
    each = blocks.select("root", "of", F.posexplode(F.sequence(F.lit(1), "blocks")).alias("k", "_")).drop("_")
    left = each.toDF("root", "of1", "k1")
    pairs = left.join(each.toDF("root", "of2", "k2"), "root").where("struct(coalesce(of1, -1), k1) <= struct(coalesce(of2, -1), k2) AND NOT coalesce(of1 = of2, false)")
    pairs = pairs.select("root", F.struct("of1", "k1").alias("x"), F.struct("of2", "k2").alias("y")).withColumn("a", F.xxhash64("x")).withColumn("b", F.xxhash64("y"))
    ends = pairs.select("root", "a", "b", F.col("x.*"), F.lit(0).alias("side")).toDF("root", "a", "b", "of", "k", "side")
    ends = ends.unionByName(pairs.where("a <> b").select("root", "a", "b", F.col("y.*"), F.lit(1).alias("side")).toDF("root", "a", "b", "of", "k", "side"))
    mine = rows.join(small(blocks), (rows["root"] == blocks["root"]) & rows["of"].eqNullSafe(blocks["of"])).select(rows["root"], rows["of"], "node", "known", "shingles", home.alias("k"))
    dealt = mine.join(ends, (mine["root"] == ends["root"]) & mine["of"].eqNullSafe(ends["of"]) & (mine["k"] == ends["k"])).select(mine["root"], "a", "b", "side", "node", "known", "shingles")
    return found.unionByName(_compared(dealt, similar))


def similar_groups(docs: DataFrame, words: int = 5, prints: int = 6, all_bits: int = 80, similar: float = 0.8, recall: float = 0.995, block: int = 131_072, block_bytes: int = 8_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) per row of docs, whose ids must be distinct and not null. Groups are joined
    by pairs whose shingle sets have a Jaccard similarity of at least `similar`, computed exactly.

    Candidates meet in a partition of the first fingerprint and are within all_bits of all fingerprints;
    they only say which texts are looked at. The plan's radius is the smallest in which pairs at
    `similar` meet with the chance `recall` (for independent bits; the chance grows with the
    similarity). A row for a candidate search has about 64 bytes, so a block of them 8 MB. Texts with equal
    sets are one node. Within what candidates connect all pairs are compared."""
    held = as_documents(docs, id_col, text_col)
    known = materialise(set_prints(held, words, prints), "set-prints")
    nodes = materialise(known.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("prints").alias("prints")), "set-nodes")
    known = known.select("doc_id", "digest")
    fps = nodes.select(F.get("prints", F.lit(0)).alias("fp"), "node", F.col("prints").alias("wide"))
    found = materialise(links(fps, 20, prints, all_bits, block, plan_for(*bit_counts(fps), similar, recall)), "candidates")
    near = materialise(connected_components(found), "near")
    discard(found)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingles = pa.array([shingle_set(t.as_py(), words).tobytes() for t in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), shingles], names=["root", "node", "shingles"])

    looked = materialise(held.join(small(near), F.col("doc_id") == F.col("node")).select("root", "node", "text").mapInArrow(sets, "root long, node long, shingles binary"), "shingles")
    roots = materialise(connected_components(confirmed_links(looked, similar, block_bytes)).select("node", "root"), "groups")
    discard(looked)
    named = nodes.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("component_id"))
    return known.join(named, "digest").select("doc_id", "component_id")
