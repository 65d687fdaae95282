"""Packing by power-of-two decomposition.

A document's ids (with the closing id) are cut into pieces whose lengths are powers of two: as many
pieces of the longest length as fit, then the binary digits of the rest, longest first. Pieces of
one length form a bucket, each piece is a sequence by itself, so no sequence crosses documents and
none holds padding. Sequence numbers run bucket by bucket, so in their order equal lengths lie together;
`write_buckets` stores a folder for each bucket. A pure map over documents: no shuffle, and a lost task
is simply run again.

Defined cases: null text packs as empty text (the closing id alone); empty tables give no rows;
repeated rows are packed each by itself; null doc_id stays null; very long texts are tokenised in
bounded parts cut only where the vocabulary's pattern always cuts, which is at white space: a text
without any is one part.
"""
from __future__ import annotations

import functools
import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.shared import as_documents, ensure_workers_import

_PART = 200_000
_CUT = re.compile(r"(?<=\S)[ \n]")


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _fast_encoder(path: str):
    """The same vocabulary and pattern in tiktoken, if the file is a byte-level BPE whose merges are in
    the order of their ids (then both give the same ids); else None."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    if model.get("ignore_merges") or model.get("byte_fallback") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    vocab = model["vocab"]
    special = {t["content"] for t in spec.get("added_tokens", [])}
    merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if None in merged or any(x >= y for x, y in zip(merged, merged[1:], strict=False)):
        return None
    of = _byte_of_char()
    ranks = {bytes(of[c] for c in t): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class CachedTokenizer:
    """ids of a text as little-endian unsigned 32-bit bytes, each distinct word encoded once.

    The pattern of the byte-level vocabulary always cuts between a character that isn't white space
    and a space or line feed, and on both sides of a line feed that stands alone between two of them.
    So a text falls apart into words (with the space before them); texts where a word begins or ends
    with other white space, or is empty, are encoded whole. Special tokens' strings are ordinary text.
    The memory is bounded: the cache is emptied when it holds `most` words.
    """

    def __init__(self, path: str, most: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        fast = _fast_encoder(path)
        if fast:
            self._ids = fast.encode_ordinary
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.encode_special_tokens = True
            self._ids = lambda text: tok.encode(text, add_special_tokens=False).ids
        self.most, self.spaced, self.plain, self.words = most, {}, {}, fast is not None

    def _whole(self, text: str) -> bytes:
        return np.array(self._ids(text), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.words:
            return self._whole(text)
        return b"".join(self._part(p, i > 0) for i, p in enumerate(self._parts(text)))

    def _parts(self, text: str) -> Iterator[str]:
        """Parts of bounded size (if there is any white space), cut before a space or line feed."""
        at = 0
        while len(text) - at > _PART and (m := _CUT.search(text, at + _PART)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def _part(self, text: str, later: bool) -> bytes:
        out: list[bytes] = []
        for n, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if later and not n and not words[0] and len(words) > 1:  # a part that begins with its space
                first: bytes | None = b""
            else:
                first = self.plain.get(words[0])
            if n:
                out.append(self._one("\n"))
            elif later and not words[0] and len(words) == 1:
                first = b""
            out.append(first)
            found = list(map(self.spaced.get, words[1:]))
            if first is None or None in found:
                if first is None:
                    first = out[-1] = self._add(self.plain, words[0], words[0])
                for i, ids in enumerate(found):
                    if ids is None:
                        found[i] = self._add(self.spaced, words[i + 1], " " + words[i + 1])
                if first is None or None in found:
                    return self._whole(text)
            out += found
        return b"".join(out)

    def _one(self, text: str) -> bytes:
        ids = self.plain.get(text)
        if ids is None:
            ids = self.plain[text] = self._whole(text)
        return ids

    def _add(self, known: dict[str, bytes], word: str, text: str) -> bytes | None:
        """None if the word doesn't stand alone."""
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        if word in known:
            return known[word]
        if len(self.spaced) + len(self.plain) >= self.most:
            self.spaced.clear()
            self.plain.clear()
        ids = known[word] = array("I", self._ids(text)).tobytes() if _LITTLE else self._whole(text)
        return ids


#: Bits of a sequence number below the bucket's: 25 for the partition and 33 for the row.
_NUMBER_BITS = 58
_LITTLE = sys.byteorder == "little" and array("I").itemsize == 4


@functools.cache
def _tokenizer(path: str) -> CachedTokenizer:
    """One for each worker process, which Spark uses for many tasks."""
    return CachedTokenizer(path)


def cut_lengths(n: int, longest: int) -> list[int]:
    """Powers of two that add up to n, longest first."""
    out = [longest] * (n // longest)
    rest = n % longest
    bit = longest
    while rest:
        bit >>= 1
        if rest & bit:
            out.append(bit)
            rest -= bit
    return out


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


def pack(docs: DataFrame, tokenizer_path: str, longest: int = 1024, closing_id: int = 0, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, ids, bucket, sequence_id, offset.

    longest must be a power of two. bucket is the length's exponent. sequence_id is unique within a
    result, its top bits are the bucket's; offset is 0, as each piece is a whole sequence.
    tokenizer_path is read by the workers (the file is installed with Python there).
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    ensure_workers_import(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(tokenizer_path)
        end = np.array([closing_id], dtype="<u4").tobytes()
        cols: list[list] = [[] for _ in range(6)]
        held = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = tok.encode(text.as_py() or "") + end
                n, at = len(ids) // 4, 0
                for size in cut_lengths(n, longest):
                    part = ids[4 * at : 4 * (at + size)]
                    for c, v in zip(cols, (doc, at, size, zlib.crc32(part), n, np.frombuffer(part, "<i4") if with_ids else None), strict=True):
                        c.append(v)
                    at += size
                held += n if with_ids else 8
                if held > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _SCHEMA, strict=True)], schema=_SCHEMA)
                    cols, held = [[] for _ in range(6)], 0
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _SCHEMA, strict=True)], schema=_SCHEMA)

    pieces = as_documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>")
    pieces = pieces.select("*", F.round(F.log2("length")).cast("int").alias("bucket"), F.monotonically_increasing_id().alias("number"))
    number = F.shiftleft(F.col("bucket").cast("long"), _NUMBER_BITS).bitwiseOR(F.col("number"))
    return pieces.select(*pieces.columns[:-1], number.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Store pieces with a folder bucket=k for each length 2^k, so a batch of one length reads one folder."""
    pieces.write.partitionBy("bucket").parquet(path)
