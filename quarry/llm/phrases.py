"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases (LZ78: the longest phrase seen before and one more code point).
The set of phrases is hashed, the hashes are dealt into BINS by their high bits, and each bin keeps 16
bits of its least hash. Likeness is the share of equal bins among those that either text fills, an
estimate of the Jaccard likeness of the phrase sets, which is high where one text helps to compress
the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import id_and_text, row_key, shuffle_partitions

BINS = 128
_SHIFT = np.uint64(64 - 7)
_EDGES = np.arange(BINS, dtype=np.uint64) << _SHIFT
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 2**64)


class Powers:
    """Powers of the base and of its inverse, as far as they have been asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            grow = lambda x: np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, x, np.uint64)]))
            self.up, self.down = grow(_BASE), grow(_INVERSE)
        return self.up[:n], self.down[:n]


_powers = Powers()


def parse(text: str, start: int, seen: set[str]) -> list[int]:
    """Ends of the phrases from start on; their texts are added to seen. What is left over makes no phrase.

    seen holds every prefix of its phrases, so the length at which a phrase is new can be looked for
    from a guess in either direction.
    """
    ends: list[int] = []
    n, at, size = len(text), start, 4
    add, append = seen.add, ends.append
    while at < n:
        end = at + size
        if text[at:end] in seen:
            end += 1
            while end <= n and text[at:end] in seen:
                end += 1
            if end > n:
                break
        else:
            while size > 1 and text[at : end - 1] not in seen:
                size -= 1
                end -= 1
            if end > n:
                end = n
                if text[at:end] in seen:
                    break
        add(text[at:end])
        append(end)
        size = end - at if end - at > 2 else 2
        at = end
    return ends


def phrase_hashes(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each phrase's code points, the same wherever it stands."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    up, down = _powers.to(len(codes) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * up[: len(codes)], dtype=np.uint64)])
    h = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def signature(hashes: np.ndarray) -> np.ndarray:
    """16 bits of each bin's least hash; 0 marks an empty bin."""
    out = np.zeros(BINS, np.uint16)
    if len(hashes):
        hashes = np.sort(hashes)
        first = np.searchsorted(hashes, _EDGES)
        ok = first < len(hashes)
        least = hashes[np.minimum(first, len(hashes) - 1)]
        ok &= (least >> _SHIFT) == np.arange(BINS, dtype=np.uint64)
        low = (least & np.uint64(0xFFFF)).astype(np.uint16)
        out[ok] = np.maximum(low[ok], 1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1.0 for two empty signatures."""
    filled = int(((a > 0) | (b > 0)).sum())
    return float(((a == b) & (a > 0)).sum() / filled) if filled else 1.0


def fingerprint(text: str) -> tuple[np.ndarray, set[str], list[int], np.ndarray]:
    """Signature, and what an edit of the text's end can start from: phrases, ends, hashes."""
    seen: set[str] = set()
    ends = parse(text, 0, seen)
    e = np.array(ends, np.int64)
    hashes = phrase_hashes(text, np.concatenate([[0], e[:-1]]).astype(np.int64), e) if ends else np.empty(0, np.uint64)
    return signature(hashes), seen, ends, hashes


def edited_signature(text: str, edited: str, cut: int, seen: set[str], ends: list[int], hashes: np.ndarray) -> np.ndarray:
    """Signature of edited, which equals text before cut; phrases that end by then are not parsed anew. Uses seen up."""
    same = int(np.searchsorted(np.array(ends, np.int64), cut, side="right")) if ends else 0
    start = ends[same - 1] if same else 0
    at = start
    for end in ends[same:]:
        seen.discard(text[at:end])
        at = end
    tail = edited[start:]
    new = np.array(parse(tail, 0, seen), np.int64)
    if not len(new):
        return signature(hashes[:same])
    return signature(np.concatenate([hashes[:same], phrase_hashes(tail, np.concatenate([[0], new[:-1]]), new)]))


def as_hex(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (block, extra, rid, doc_id, text) in order within their partition, one block each: a row's successor
    in ascending doc_id is the row after it; a block ends with its successor's first row (extra), the last
    block with the very first row. Blocks are ranges of ids of about equal counts; only their bounds and
    least ids (one a block) pass through the driver.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs).withColumn("rid", row_key())
    n = shuffle_partitions(spark)
    bounds = rows.select("rid").approxQuantile("rid", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    bounds = sorted({int(b) for b in bounds})
    block = F.lit(0)
    if bounds:
        block = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("rid")))
    placed = rows.withColumn("block", block.cast("int"))
    firsts = sorted((r["first"], r["block"]) for r in placed.groupBy("block").agg(F.min("rid").alias("first")).collect())
    if not firsts:
        return placed.select("block", F.lit(False).alias("extra"), "rid", "doc_id", "text")
    before = spark.createDataFrame([(rid, firsts[i - 1][1]) for i, (rid, _) in enumerate(firsts)], "rid long, block int")
    extra = rows.join(F.broadcast(before), "rid").select("block", F.lit(True).alias("extra"), "rid", "doc_id", "text")
    both = placed.select("block", F.lit(False).alias("extra"), "rid", "doc_id", "text").unionByName(extra)
    return both.repartitionById(n, F.col("block")).sortWithinPartitions("block", "extra", "rid", "text")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Nulls: a null text is an empty text; a null doc_id sorts before all others. Rows with one doc_id are
    ordered by text, so repeated rows are each other's successors. An empty text has no phrases: its
    fingerprint is all zeros and its likeness to another such text is 1. A lone document is its own
    successor. An empty table gives an empty result; other columns are ignored.
    """
    fields = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before: block, doc_id, text and its fingerprint
        for batch in batches:
            out = []
            for block, extra, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if extra and (held is None or held[0] != block or held[4]):
                    continue  # a further row of the next block's first id
                mark = fingerprint(text)
                if held is not None and held[0] == block:
                    _, own_id, own, (sig, seen, ends, hashes), _ = held
                    cut = len(own) - len(own) // 4
                    edited = own[:cut] + text[: len(own) // 4]
                    esig = edited_signature(own, edited, cut, seen, ends, hashes)
                    out.append((own_id, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_hex(sig), as_hex(esig), likeness(sig, esig), likeness(sig, mark[0])))
                held = (block, doc_id, text, mark, extra)
            cols = list(zip(*out)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])

    rows = with_next(docs).select("block", "extra", "doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
