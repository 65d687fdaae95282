"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may be hidden in a text with up to k = floor(rate * m) edits. Cut into
k + 1 pieces, at least one piece is in the text unchanged; an automaton finds all pieces in one pass.
The windows around an item's hits are merged where they overlap, so each part of a text is verified
once for an item, by Myers' bit-parallel distance. Texts and items are compared in lower case with
white space folded.

Scale: one map over documents for each block of items. A block has at most `most_bytes`, so whatever the
size of the benchmark no broadcast is larger; a worker holds the automaton of one block, built once. Each
further block is one more pass over the documents.

Defined cases: null and empty texts match nothing; null and empty items (after folding) are passed over;
an item under `least` characters matches exactly and between word boundaries only, as with
edits it would match anywhere; items with equal texts each report; an item reports its best match in a
document (the first of equals); repeated rows of documents report each; empty tables give none.
"""
from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.shared import ensure_workers_import, kept_and_text, pick


def folded(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of like length, with their places in the item."""
    n = k + 1
    return [(len(item) * j // n, item[len(item) * j // n : len(item) * (j + 1) // n]) for j in range(n)]


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern (bit masks of its characters, length m) to any part of text,
    and the end of the first such part."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, dist = full, 0, m
    best, at = m, 0
    get = masks.get
    for i, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            dist += 1
        elif mh & top:
            dist -= 1
        ph = ph << 1
        mh = mh << 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
        if dist < best:
            best, at = dist, i
    return best, at


def char_masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float, least: int):
        import ahocorasick

        self.items, of = [], {}
        for item_id, text in items:
            text = folded(text)
            if not text:
                continue
            short = len(text) < least
            k = 0 if short else math.floor(rate * len(text))
            at = len(self.items)
            self.items.append((item_id, text, k, short, None))
            for start, piece in pieces(text, k):
                # a piece that an item has several times is one hit with the span of its places
                spots = of.setdefault(piece, {})
                low, high = spots.get(at, (start, start))
                spots[at] = (min(low, start), max(high, start))
        self.find = ahocorasick.Automaton()
        for piece, spots in of.items():
            # how far an item reaches before and after the place of its piece, with k edits
            reach = [(at, high + self.items[at][2], len(self.items[at][1]) + self.items[at][2] - low) for at, (low, high) in spots.items()]
            self.find.add_word(piece, (len(piece), reach))
        self.any = bool(of)
        if of:
            self.find.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """For each item with a hit the parts (start, end) of the folded text in which it can be."""
        out: dict[int, list[list[int]]] = {}
        for end, (size, reach) in self.find.iter(text):
            begin = end + 1 - size
            for at, back, ahead in reach:
                lo, hi = begin - back, begin + ahead
                held = out.get(at)
                if held is None:
                    out[at] = [[lo, hi]]
                elif lo <= held[-1][1]:
                    held[-1][0], held[-1][1] = min(lo, held[-1][0]), max(hi, held[-1][1])
                else:
                    held.append([lo, hi])
        return out

    def _verify(self, at: int, text: str, windows: list[list[int]]) -> tuple[int, int, int] | None:
        item_id, item, k, short, masks = self.items[at]
        exact = re.compile(rf"(?<!\w){re.escape(item)}(?!\w)") if short else None
        best = None
        for lo, hi in windows:
            lo, hi = max(0, lo), min(hi, len(text))
            if exact:
                m = exact.search(text, lo, min(len(text), hi + 1))
                if m:
                    return 0, m.start(), m.end()
                continue
            if (spot := text.find(item, lo, hi)) >= 0:
                return 0, spot, spot + len(item)
            if masks is None:
                masks = char_masks(item)
                self.items[at] = (item_id, item, k, short, masks)
            dist, stop = myers(masks, len(item), text[lo:hi])
            if dist <= k and (best is None or dist < best[0]):
                best = (dist, max(0, stop + lo - len(item)), stop + lo)
        return best

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of the best match of each item that is in the text; places are
        in the folded text, start within the distance of the exact place."""
        if not self.any:
            return []
        text = folded(text)
        found = ((self.items[at][0], self._verify(at, text, held)) for at, held in self.windows(text).items())
        return sorted((item_id, *best) for item_id, best in found if best)


_built: dict[tuple, Matcher] = {}


def _matcher(name: str, held, rate: float, least: int) -> Matcher:
    """The matcher of a block, built once for each worker, which keeps the last one."""
    key = (name, rate, least)
    if key not in _built:
        _built.clear()
        _built[key] = Matcher(held.value, rate, least)
    return _built[key]


def _blocks(benchmark: DataFrame, most_bytes: int, item_col: str, item_text_col: str) -> Iterator:
    """The items as broadcasts of at most about most_bytes, each with a name of its own."""
    spark = benchmark.sparkSession
    ensure_workers_import(spark)
    items = pick(benchmark, item_col, item_text_col).toDF("item_id", "text").select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(size / most_bytes))
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == b)
        yield uuid.uuid4().hex, spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in block.orderBy("item_id", "text").toLocalIterator()])


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06, least: int = 20, most_bytes: int = 8_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """A row for each document row and item found in it: columns of `keep` (default: the id), item_id,
    distance, start, end."""
    keep = [id_col] if keep is None else keep
    rows = kept_and_text(docs, keep, text_col)
    schema = rows.drop("__text").schema.add("item_id", "long").add("distance", "integer").add("start", "long").add("end", "long")
    out = None
    for name, held in _blocks(benchmark, most_bytes, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], name=name, held=held) -> Iterator[pa.RecordBatch]:
            match = _matcher(name, held, rate, least)
            for batch in batches:
                row, found = [], []
                for i, text in enumerate(batch.column(batch.num_columns - 1)):
                    for m in match.matches(text.as_py()):
                        row.append(i)
                        found.append(m)
                kept = [c.take(pa.array(row, pa.int64())) for c in batch.columns[:-1]]
                cols = [pa.array([m[k] for m in found], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*kept, *cols], names=[*batch.schema.names[:-1], "item_id", "distance", "start", "end"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06, least: int = 20, most_bytes: int = 8_000_000, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs in which no item is found, with all their columns: a map for each block of items."""
    at, names, schema = docs.columns.index(text_col), docs.columns, docs.schema
    for name, held in _blocks(benchmark, most_bytes, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], name=name, held=held) -> Iterator[pa.RecordBatch]:
            match = _matcher(name, held, rate, least)
            for batch in batches:
                yield batch.filter(pa.array([not match.matches(text.as_py()) for text in batch.column(at)], pa.bool_()))

        docs = docs.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, _renamed(schema)).toDF(*names)
    return docs


def _renamed(schema):
    from pyspark.sql.types import StructField, StructType

    return StructType([StructField(f"c{i}", f.dataType, True) for i, f in enumerate(schema)])
