"""Packing by power-of-two decomposition.

A document of n ids is cut into pieces whose lengths are the powers of two of n's binary form (with as
many of the largest size as it takes), and pieces of one length make up one bucket. A sequence is one
piece: it holds ids of one document alone, has a power of two as its length and needs no padding.
Sequences are numbered bucket by bucket, without gaps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import id_and_text, row_key, spread, written
from quarry.llm.word_ids import encode_texts, encoder

MAX_TOKENS = 2048
#: Parts of a bucket that are numbered apart.
LANES = 256


def cuts(n: int, most: int = MAX_TOKENS) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces, largest first. most: a power of two."""
    out = [(i * most, most) for i in range(n // most)]
    start = n // most * most
    while start < n:
        size = 1 << ((n - start).bit_length() - 1)
        out.append((start, size))
        start += size
    return out


def pieces(docs: DataFrame, tokenizer_path: str, most: int = MAX_TOKENS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and row (tells repeated document rows apart)."""
    if most < 1 or most & (most - 1):
        raise ValueError("the longest sequence must be a power of two")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_path)
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode_texts(words, batch.column(1))):
                for start, size in cuts(len(ids), most):
                    for col, value in zip(out, (doc_id, start, size, zlib.crc32(ids[start : start + size]), len(ids))):
                        col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)

    return spread(id_and_text(docs)).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def pack(docs: DataFrame, tokenizer_path: str, most: int = MAX_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Nulls: a null text is an empty text, which has its end id alone; a null doc_id stays null and sorts
    first. Repeated rows are packed each on its own; ties in the numbering are of equal rows, so any order
    gives the same result. An empty table gives an empty result; other columns are ignored.
    """
    rows = written(pieces(docs, tokenizer_path, most).withColumn("lane", F.pmod(F.xxhash64("doc_id", "start"), F.lit(LANES)).cast("int")), "pieces")
    # at most LANES rows for each of log2(most) + 1 lengths, whatever the input
    lanes = rows.groupBy("length", "lane").agg(F.count(F.lit(1)).alias("n"))
    before = lanes.withColumn("first_id", F.sum("n").over(Window.orderBy("length", "lane").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    within = Window.partitionBy("length", "lane").orderBy(row_key(), "start", "doc_tokens", "ids_crc32")
    numbered = rows.withColumn("at", F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(before.select("length", "lane", "first_id")), ["length", "lane"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first_id") + F.col("at")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
