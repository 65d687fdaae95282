"""Document quality from line labels of a linear-chain conditional random field.

Every line gets the state bad or good. A line's potential is linear in its own features and those of
the lines before and after it; transitions have a weight for each pair of states. Forward-backward
gives each line's marginal; their mean, weighted by the lines' lengths, is the document's raw
quality, which two parameters fitted on held-back documents turn into a probability. A line's label is good
if its marginal is one half or more.

Lines have no labels of their own, documents have. So training maximises the likelihood of the documents'
labels, where the chance of label 1 is the raw quality: lines of either kind may stand in a document of
either label, and what follows what is learnt from that. All weights follow the gradient of this one
objective. It takes a bounded sample of labelled documents (`per_class` of each label; of a
document of more than `most_lines` lines, runs of `run_lines` spread evenly over it). Scoring is a map
over whole texts; features are counts of characters and words, so no language is favoured.

Defined cases: null and empty text is one empty line; several labels of a document count by majority
(a tie is good); of several rows with one id the smallest text is learnt from; null labels are ignored;
without labelled rows of both kinds every score is the share of good labels (0.5 without any); repeated
rows are scored alike; empty tables give none.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.shared import as_documents, ensure_workers_import, kept_and_text, pick

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_SPACE = b" \t\r\x0b\x0c"
_SYMBOL = b"!#$%&*|@^~<>{}[]=+_\\/"
_PUNCT = b".,;:?'\"()-"
OWN = 14


def _line(line: str, seen: set[str]) -> list[float]:
    b = line.encode("utf-8", "surrogatepass")
    n = len(b)
    words = line.split()
    w = len(words)
    if not w:
        seen.add(line)
        return [0.0] * (OWN - 1) + [1.0]
    upper, lower, digit, symbol, punct = (n - len(b.translate(None, s)) for s in (_UPPER, _LOWER, _DIGIT, _SYMBOL, _PUNCT))
    space = n - len(b.translate(None, _SPACE))
    ink = max(1, n - space)
    count = Counter(words)
    again = sum(map(str.__eq__, words, words[1:]))
    repeat = float(line in seen)
    seen.add(line)
    return [
        float(np.log1p(w)), min(30.0, ink / w) / 10, upper / max(1, upper + lower), symbol / ink, punct / ink, digit / ink,
        len(count) / w, max(count.values()) / w, again / w, float(words[-1][-1] in ".!?:"), float(line[:1].isupper()),
        sum(x[-1] in "!#$%&*|@^~" for x in words) / w, repeat, 0.0,
    ]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features, lengths): own features, then those of the lines before and after."""
    seen: set[str] = set()
    lines = (text or "").split("\n")
    own = np.array([_line(x, seen) for x in lines], dtype=np.float32)
    none = np.zeros((1, OWN), dtype=np.float32)
    edge = np.zeros((len(lines), 2), dtype=np.float32)
    edge[0, 0] = edge[-1, 1] = 1
    x = np.hstack([own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none]), edge])
    return x, np.array([max(1, len(s)) for s in lines], dtype=np.float64)


def marginals(unary: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line, expected transitions (2 x 2) and the sum of log normalisers.

    unary: each line's log-odds of good, sequences end to end; all sequences advance together."""
    order = np.argsort(-sizes, kind="stable")
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])[order]
    size = sizes[order]
    t_max = int(size[0]) if len(size) else 0
    live = [int(np.searchsorted(-size, -t, side="left")) for t in range(t_max + 1)]  # sequences longer than t
    e = np.exp(trans - trans.max())
    pot = np.stack([1 / (1 + np.exp(np.clip(unary, -50, 50))), 1 / (1 + np.exp(-np.clip(unary, -50, 50)))], axis=1)
    log_z = float(np.logaddexp(0, np.clip(unary, -50, 50)).sum() + trans.max() * (len(unary) - len(sizes)))
    alpha, beta = np.empty((len(unary), 2)), np.ones((len(unary), 2))
    for t in range(t_max):
        k = live[t]
        at = start[:k] + t
        a = pot[at] if t == 0 else (alpha[at - 1] @ e) * pot[at]
        s = a.sum(1, keepdims=True)
        alpha[at] = a / s
        log_z += float(np.log(s).sum())
    moves = np.zeros((2, 2))
    for t in range(t_max - 2, -1, -1):
        k = live[t + 1]
        at = start[:k] + t
        nxt = pot[at + 1] * beta[at + 1]
        b = nxt @ e.T
        beta[at] = b / b.sum(1, keepdims=True)
        pair = alpha[at][:, :, None] * e[None] * nxt[:, None, :]
        moves += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
    p = alpha * beta
    return p[:, 1] / p.sum(1), moves, log_z


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    trans: np.ndarray
    slope: float
    shift: float

    def lines(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """P(good) of each line, documents end to end."""
        x = np.concatenate([x for x, _ in docs])
        return marginals(((x - self.mean) / self.scale) @ self.weights + self.bias, np.array([len(n) for _, n in docs]), self.trans)[0]

    def mean_of(self, good: np.ndarray, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Raw quality: the mean of the lines' chances, weighted by length."""
        n = np.concatenate([n for _, n in docs])
        at = np.concatenate([[0], np.cumsum([len(n) for _, n in docs])[:-1]])
        return np.add.reduceat(good * n, at) / np.add.reduceat(n, at)

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * _logit(raw) + self.shift, -40, 40)))

    def score(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return self.calibrated(self.mean_of(self.lines(docs), docs))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


class Objective:
    """Mean negative log-likelihood of documents' labels (with an l2 penalty) and its gradient, for
    parameters (weights, bias, four transitions)."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, importance: np.ndarray, l2: float):
        self.x = np.concatenate([d[0] for d in docs])
        self.sizes = np.array([len(d[1]) for d in docs])
        self.at = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        length = np.concatenate([d[1] for d in docs])
        self.share = length / np.repeat(np.add.reduceat(length, self.at), self.sizes)
        self.y, self.importance, self.l2 = y.astype(float), importance / importance.sum(), l2

    def _expected(self, unary: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line, and the expected features."""
        p, moves, _ = marginals(unary, self.sizes, trans)
        return p, np.concatenate([self.x.T @ p, [p.sum()], moves.ravel()])

    def __call__(self, theta: np.ndarray, step: float = 1e-2) -> tuple[float, np.ndarray]:
        k = self.x.shape[1]
        unary, trans = self.x @ theta[:k] + theta[k], theta[-4:].reshape(2, 2)
        p = marginals(unary, self.sizes, trans)[0]
        q = np.clip(np.add.reduceat(p * self.share, self.at), 1e-6, 1 - 1e-6)
        loss = -float((self.importance * (self.y * np.log(q) + (1 - self.y) * np.log(1 - q))).sum()) + self.l2 / 2 * float(theta @ theta)
        # a mean marginal's gradient is the covariance of the marked lines with the features: how the
        # expected features change as the marked lines' potentials do, here for all documents at once
        pull = self.importance * (q - self.y) / (q * (1 - q))
        mark = np.repeat(pull, self.sizes) * self.share
        e = step / max(np.abs(mark).max(), 1e-12)
        up, down = self._expected(unary + e * mark, trans)[1], self._expected(unary - e * mark, trans)[1]
        return loss, (up - down) / (2 * e) + self.l2 * theta


def fit(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, importance: np.ndarray | None = None, l2: float = 1e-4, rounds: int = 120, rate: float = 0.1) -> QualityModel:
    """Adam on the whole sample, then the calibration on every fifth document."""
    importance = np.ones(len(docs)) if importance is None else importance
    hold = np.arange(len(docs)) % 5 == 0 if len(docs) >= 50 else np.ones(len(docs), bool)
    use = ~hold if len(docs) >= 50 else hold
    picked = [d for d, u in zip(docs, use, strict=True) if u]
    x = np.concatenate([d[0] for d in picked]).astype(np.float64)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    objective = Objective([((d[0] - mean) / scale, d[1]) for d in picked], y[use], importance[use], l2)
    # a start in which lines of a document tend to agree
    theta, m, v = np.concatenate([np.zeros(x.shape[1] + 1), [0.5, -0.5, -0.5, 0.5]]), 0.0, 0.0
    for t in range(1, rounds + 1):
        _, g = objective(theta)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    k = x.shape[1]
    model = QualityModel(mean, scale, theta[:k], float(theta[k]), theta[-4:].reshape(2, 2).copy(), 1.0, 0.0)
    back = [d for d, h in zip(docs, hold, strict=True) if h]
    z, target, w = _logit(model.mean_of(model.lines(back), back)), y[hold].astype(float), importance[hold] / importance[hold].sum()
    a, b = 1.0, 0.0
    for _ in range(500):  # logistic regression with a weak pull to the identity
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        a -= 0.05 * (float(((q - target) * z * w).sum()) + 1e-2 * (a - 1))
        b -= 0.05 * (float(((q - target) * w).sum()) + 1e-2 * b)
    model.slope, model.shift = max(a, 0.05), b
    return model


def _runs(lines: int, most: int, run: int) -> list[tuple[int, int]]:
    """The whole text, or runs of lines spread evenly over it with `most` lines together."""
    if lines <= most:
        return [(0, lines)]
    count = max(1, most // run)
    return [(at, at + run) for at in ((lines - run) * i // max(1, count - 1) for i in range(count))]


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, most_lines: int = 300, run_lines: int = 50) -> QualityModel | float:
    """From docs(doc_id, text) and labels(doc_id, quality): about per_class documents of each label, chosen
    by a hash of the id."""
    ensure_workers_import(docs.sparkSession)
    known = pick(labels, "doc_id", "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(F.col("quality").cast("double")) >= 0.5).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}  # two rows
    total = sum(counts.values())
    if len(counts) < 2:
        return (counts.get(1, 0) / total) if total else 0.5
    scale = 1 << 40
    cut = F.when(F.col("y") == 1, F.lit(int(min(1.0, per_class / counts[1]) * scale))).otherwise(F.lit(int(min(1.0, per_class / counts[0]) * scale)))
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text, y in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                x, n = features(text.as_py())
                spans = _runs(len(n), most_lines, run_lines)
                for lo, hi in spans:
                    for c, v in zip(out, (doc, y, 1 / len(spans), x[lo:hi].tobytes(), n[lo:hi].tobytes()), strict=True):
                        c.append(v)
            types = (pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "y", "w", "x", "n"])

    sample = as_documents(docs).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("doc_id", "text", "y")
    got = sample.mapInArrow(run, "doc_id long, y int, w double, x binary, n binary").collect()  # the bounded sample
    of = {r["doc_id"]: r["y"] for r in got}
    if len(set(of.values())) < 2:
        return counts.get(1, 0) / total
    place = {d: i for i, d in enumerate(np.random.default_rng(3).permutation(sorted(of)).tolist())}
    got.sort(key=lambda r: place[r["doc_id"]])
    pairs = [(np.frombuffer(r["x"], "<f4").reshape(-1, 3 * OWN + 2), np.frombuffer(r["n"], "<f8")) for r in got]
    model = fit(pairs, np.array([r["y"] for r in got]), np.array([r["w"] for r in got]))
    # the sample's share of good labels isn't the table's
    y = np.array(list(of.values()))
    model.shift += float(np.log(counts[1] / counts[0]) - np.log(max(1, y.sum()) / max(1, (1 - y).sum())))
    return model


def score(docs: DataFrame, model: QualityModel | float, cut: float = 0.3, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns of `keep` (default: the id) with score, predicted, lines and bad_lines (how many lines there
    are, and how many are labelled bad; null without a model), for every row's whole text."""
    keep = [id_col] if keep is None else keep
    ensure_workers_import(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = kept_and_text(docs, keep, text_col)
    schema = rows.drop("__text").schema.add("score", "double").add("predicted", "integer").add("lines", "long").add("bad_lines", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            if isinstance(m, float):
                scores, lines, bad = [m] * batch.num_rows, [None] * batch.num_rows, [None] * batch.num_rows
            else:
                scores, lines, bad = [], [], []
                for part, good in _judged(batch.column(batch.num_columns - 1), m):
                    scores += m.calibrated(m.mean_of(good, part)).tolist()
                    size = [len(n) for _, n in part]
                    lines += size
                    bad += np.add.reduceat(good < 0.5, np.concatenate([[0], np.cumsum(size)[:-1]]), dtype=np.int64).tolist()
            s = np.array(scores, dtype=np.float64)
            more = [pa.array(s), pa.array((s >= cut).astype(np.int32)), pa.array(lines, pa.int64()), pa.array(bad, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=[*batch.schema.names[:-1], "score", "predicted", "lines", "bad_lines"])

    return rows.mapInArrow(run, schema)


def _judged(texts, model: QualityModel, most_lines: int = 20_000) -> Iterator[tuple[list, np.ndarray]]:
    """Parts of the texts' features, each with its lines' chances; about most_lines at a time."""
    part, lines = [], 0
    for text in texts:
        part.append(features(text.as_py()))
        lines += len(part[-1][1])
        if lines > most_lines:
            yield part, model.lines(part)
            part, lines = [], 0
    if part:
        yield part, model.lines(part)


def label_lines(docs: DataFrame, model: QualityModel, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each line: columns of `keep` (default: the id), line (from 0), good (its marginal) and
    label (good or bad)."""
    keep = [id_col] if keep is None else keep
    ensure_workers_import(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = kept_and_text(docs, keep, text_col)
    schema = rows.drop("__text").schema.add("line", "long").add("good", "double").add("label", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for part, good in _judged(batch.column(batch.num_columns - 1), held.value):
                size = [len(n) for _, n in part]
                row = np.repeat(np.arange(first, first + len(part)), size)
                first += len(part)
                line = np.concatenate([np.arange(n) for n in size])
                more = [pa.array(line, pa.int64()), pa.array(good, pa.float64()), pa.array(np.where(good >= 0.5, "good", "bad").tolist(), pa.string())]
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(row)) for c in batch.columns[:-1]], *more], names=[*batch.schema.names[:-1], "line", "good", "label"])

    return rows.mapInArrow(run, schema)
