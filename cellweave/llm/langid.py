"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: character n-grams (lengths in `orders`) of the lower-cased text, hashed to `width`
buckets; the weight of a bucket is its relative frequency in the text times its inverse document
frequency over all rows that may be learnt from. Training: follow-the-regularised-leader with
elastic-net penalties on a sample of at most `per_class` rows of each language, then one
temperature, fitted on a held-back part of the sample, calibrates the probabilities.

Scale: document frequencies are one map with partial sums and a small aggregate; the sample is
bounded (classes x per_class rows of at most `width` pairs); prediction is a map over whole texts.

Defined cases: null text or text without a letter gives `und` with score 1.0 if it holds nothing
to judge; labels that are null are not learnt; a table without any labelled row gives `und` with
score 0.0 for all; repeated rows and ties are independent (equal scores: the first label in order).
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.shared import ensure_workers_import, kept_and_text, pick

_PART = 1 << 18
_STEP = np.uint32(0x9E3779B1)


def gram_buckets(text: str, orders: tuple[int, ...], width: int) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of the whole lower-cased text, in parts of bounded size."""
    shift = np.uint32(32 - (width.bit_length() - 1))
    code = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    longest = max(orders)
    for at in range(0, len(code), _PART):
        c = code[at : at + _PART + longest - 1]
        for n in orders:
            m = min(_PART, len(c) - n + 1)
            if m <= 0:
                continue
            h = np.full(m, n, dtype=np.uint32)
            for k in range(n):
                h = (h ^ c[k : k + m]) * _STEP
                h ^= h >> np.uint32(15)
            yield (h * _STEP) >> shift


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text)) if text else False


@dataclass
class LanguageModel:
    labels: list[str]
    weights: np.ndarray  # width x classes, with the inverse document frequency multiplied in
    bias: np.ndarray
    temperature: float
    orders: tuple[int, ...]

    def probabilities(self, text: str) -> np.ndarray:
        z, n = np.zeros(len(self.labels)), 0
        for g in gram_buckets(text, self.orders, len(self.weights)):
            z += self.weights.take(g, axis=0).sum(0, dtype=np.float64)
            n += len(g)
        z = (z / max(1, n) + self.bias) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()


def _frequencies(rows: DataFrame, orders: tuple[int, ...], width: int) -> tuple[int, np.ndarray]:
    """Rows, and for each bucket the rows that have it, over all of `rows`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(width, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                seen = np.zeros(width, dtype=bool)
                for g in gram_buckets(text.as_py() or "", orders, width):
                    seen[g] = True
                df += seen
                n += 1
        at = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n), pa.int64())], names=["g", "n"])

    total = rows.select("text").mapInArrow(run, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()  # width + 1 rows at most
    df, n = np.zeros(width, dtype=np.int64), 0
    for g, c in total:
        if g < 0:
            n = c
        else:
            df[g] = c
    return n, df


def _sample(rows: DataFrame, per_class: int, orders: tuple[int, ...], width: int, most_classes: int) -> tuple[list[str], list[tuple[int, np.ndarray, np.ndarray]]]:
    """At most per_class rows of each label, by a hash of the text, as (label, buckets, shares)."""
    counts = rows.groupBy("lang").count().orderBy("lang").limit(most_classes + 1).collect()
    if len(counts) > most_classes:
        raise ValueError(f"more than {most_classes} languages")
    labels = [r["lang"] for r in counts]
    if not labels:
        return [], []
    scale = 1 << 40
    cut = F.lit(0)
    for r in counts:
        cut = F.when(F.col("lang") == r["lang"], F.lit(int(min(1.0, per_class / r["count"]) * scale))).otherwise(cut)
    picked = rows.where(F.pmod(F.xxhash64("text", "lang"), F.lit(scale)) < cut).dropDuplicates()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gs, fs = [], []
            for text in batch.column(0):
                count, n = np.zeros(width, dtype=np.int32), 0
                for g in gram_buckets(text.as_py() or "", orders, width):
                    count += np.bincount(g, minlength=width).astype(np.int32)
                    n += len(g)
                at = np.nonzero(count)[0]
                gs.append(at.astype("<u4").tobytes())
                fs.append((count[at] / max(1, n)).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(gs, pa.binary()), pa.array(fs, pa.binary())], names=["lang", "g", "f"])

    got = picked.select("text", "lang").limit(2 * per_class * len(labels)).mapInArrow(run, "lang string, g binary, f binary").collect()
    index = {x: i for i, x in enumerate(labels)}
    rng = np.random.default_rng(12)
    got = sorted(got, key=lambda r: (r["lang"], bytes(r["g"][:64]), bytes(r["f"][:64])))
    return labels, [(index[got[i]["lang"]], np.frombuffer(got[i]["g"], "<u4").astype(np.int64), np.frombuffer(got[i]["f"], "<f4").astype(np.float64)) for i in rng.permutation(len(got))]


def train(labelled: DataFrame, per_class: int = 400, orders: tuple[int, ...] = (1, 2, 3), width: int = 1 << 14, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-4, epochs: int = 3, most_classes: int = 500) -> LanguageModel | None:
    """Fit on labelled(text, lang): per_class bounds the sampled rows of a language; statistics of
    n-grams cover all rows. None if there is no labelled row."""
    if width & (width - 1):
        raise ValueError("width must be a power of two")
    ensure_workers_import(labelled.sparkSession)
    rows = pick(labelled, "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    labels, sample = _sample(rows, per_class, orders, width, most_classes)
    if not sample:
        return None
    n, df = _frequencies(rows, orders, width)
    idf = np.log((1 + n) / (1 + df)) + 1
    k = len(labels)
    z, nn = np.zeros((width + 1, k)), np.zeros((width + 1, k))

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        w = -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn[at])) / alpha + l2)
        w[np.abs(zz) <= l1] = 0.0
        return w

    held = sample[: len(sample) // 5] if len(sample) >= 20 else sample
    fit = sample[len(sample) // 5 :] if len(sample) >= 20 else sample
    gain = 30.0  # relative frequencies are small; a fixed factor puts them on the scale of 1
    for _ in range(epochs):
        for y, g, f in fit:
            at = np.append(g, width)
            x = np.append(f * idf[g] * gain, 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            grad = x[:, None] * p[None, :]
            sigma = (np.sqrt(nn[at] + grad * grad) - np.sqrt(nn[at])) / alpha
            z[at] += grad - sigma * w
            nn[at] += grad * grad
    w = weights(np.arange(width + 1))
    scores = np.array([(f * idf[g] * gain) @ w[g] + w[width] for _, g, f in held])
    truth = np.array([y for y, _, _ in held])

    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), truth]).mean())

    temperature = min(np.geomspace(0.2, 5.0, 60), key=loss)
    return LanguageModel(labels, (w[:width] * idf[:, None] * gain).astype(np.float32), w[width], float(temperature), tuple(orders))


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns of `keep` (default: the id) with lang_pred and score, for every row's whole text."""
    keep = [id_col] if keep is None else keep
    ensure_workers_import(docs.sparkSession)
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    rows = kept_and_text(docs, keep, text_col)
    schema = rows.drop("__text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            lang, score = [], []
            for text in batch.column(batch.num_columns - 1):
                text = text.as_py()
                if m is None or not has_letter(text):
                    lang.append("und")
                    score.append(0.0 if has_letter(text) else 1.0)
                    continue
                p = m.probabilities(text)
                best = int(p.argmax())
                lang.append(m.labels[best])
                score.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return rows.mapInArrow(run, schema)
