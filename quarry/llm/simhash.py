"""SimHash near-duplicates with a pigeonring filter.

64 bits are five segments on a ring. If two fingerprints differ in at most 4 bits, some segment starts a
chain whose running differences stay within 4/5 per segment: 0 after one segment, at most 1 after two,
2 after three, 3 after four. Candidates are therefore looked up by exact keys that hold the first segment
and what the chain leaves equal in the next two: both halves of the second (no difference there), or one
half of each (one difference at most in each). A key covers about 26 bits and each distinct fingerprint
has 25 keys, so the table is linear in the input. Within a key's group only a spanning forest of the
true links is emitted, never all pairs; very large groups are split into blocks and compared block by
block. Chains are checked segment by segment before the full Hamming distance.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import id_and_text, row_key, salted_join, spread, with_text_key, written
from quarry.llm.components import components

SHINGLE_WORDS, SEED = 4, 42
MAX_BITS = 4
#: (shift, bits) of the ring's segments from the lowest bit.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Fingerprints of one key that are compared in one piece.
BLOCK = 50_000

SPACES = re.compile(rb"[\x20\x09-\x0D]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str) -> int:
    """Signed 64-bit value; a bit is set if more than half the shingles' hashes have it."""
    flat = SPACES.sub(b" ", text.encode("utf-8", "surrogatepass").translate(LOWER)).strip(b" ")
    if not flat:
        return 0
    blanks = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    if len(blanks) < SHINGLE_WORDS - 1:
        hashes = [xxhash.xxh64_intdigest(flat, SEED)]
    else:
        starts = [0, *(blanks[: len(blanks) - SHINGLE_WORDS + 2] + 1).tolist()]
        ends = [*blanks[SHINGLE_WORDS - 1 :].tolist(), len(flat)]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(flat[a:b], SEED) for a, b in zip(starts, ends)]
    counts = np.zeros(64, np.int64)
    values = np.array(hashes, dtype=np.uint64)
    for at in range(0, len(values), 65_536):
        bits = np.unpackbits(values[at : at + 65_536].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(values), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long) and text_id (SHA-256) of each row; a null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            ids = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(fingerprint, texts), pa.int64()), pa.array(ids, pa.string())], names=["doc_id", "fp", "text_id"])

    return spread(id_and_text(docs)).mapInArrow(run, "doc_id long, fp long, text_id string")


def _bits(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def chain_keys(fp: Column) -> Column:
    """The 25 keys of a fingerprint: chain start * 5 + case in the high bits, key bits below."""
    keys = []
    for i in range(5):
        (s0, w0), (s1, w1), (s2, w2) = (SEGMENTS[(i + j) % 5] for j in range(3))
        first = _bits(fp, s0, w0)
        h1, h2 = w1 // 2, w2 // 2
        cases = [_bits(fp, s1, w1)]
        for part1 in (_bits(fp, s1, h1), _bits(fp, s1 + h1, w1 - h1)):
            for part2 in (_bits(fp, s2, h2), _bits(fp, s2 + h2, w2 - h2)):
                cases.append(F.shiftleft(part1, 7).bitwiseOR(part2))
        for case, rest in enumerate(cases):
            keys.append(F.lit((i * 5 + case) << 32).bitwiseOR(F.shiftleft(first, 14)).bitwiseOR(rest))
    return F.array(*keys)


def linked(one: np.uint64, many: np.ndarray) -> np.ndarray:
    """Which of many differ from one in at most MAX_BITS bits: chain prefixes first, the full count last."""
    diff = many ^ one
    near = np.zeros(len(many), bool)
    for start in range(5):
        left = np.flatnonzero(~near)
        sums = np.zeros(len(left), np.int64)
        for j in range(5):
            shift, width = SEGMENTS[(start + j) % 5]
            part = (diff[left] >> np.uint64(shift)) & np.uint64((1 << width) - 1)
            sums += np.bitwise_count(part)
            keep = sums <= (j + 1) * MAX_BITS // 5
            left, sums = left[keep], sums[keep]
            if not len(left):
                break
        near[left] = True
    return near


def forest(fps: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the links among distinct fingerprints (breadth first)."""
    a: list[int] = []
    b: list[int] = []
    rest = fps
    queue: list[np.uint64] = []
    while len(rest):
        if not queue:
            queue, rest = [rest[0]], rest[1:]
            continue
        at = queue.pop()
        near = linked(at, rest) if len(rest) > 16 else np.bitwise_count(rest ^ at) <= MAX_BITS
        found = rest[near]
        if len(found):
            rest = rest[~near]
            queue.extend(found)
            a += [int(at.view(np.int64))] * len(found)
            b += found.view(np.int64).tolist()
    return a, b


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forest edges of each group of rows (key, blocks, fp) that stand together."""
    carried: list[np.ndarray] = [np.empty(0, np.int64)] * 3

    def edges(cols: list[np.ndarray]) -> pa.RecordBatch:
        key, block, fp = cols
        change = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
        starts = np.concatenate([[0], change])
        ends = np.concatenate([change, [len(key)]])
        a: list[int] = []
        b: list[int] = []
        for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            x, y = forest(np.unique(fp[s:e]).view(np.uint64))
            a += x
            b += y
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        cols = [np.concatenate([c, batch.column(i).to_numpy(zero_copy_only=False)]) for i, c in enumerate(carried)]
        if not len(cols[0]):
            continue
        last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on in the next batch
        carried = [c[cut:] for c in cols]
        if cut:
            yield edges([c[:cut] for c in cols])
    if len(carried[0]):
        yield edges(carried)


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect all that are linked."""
    keys = distinct.select("fp", F.explode(chain_keys(F.col("fp"))).alias("key"))
    big = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("long").alias("parts")), "big-keys")
    rows = keys.withColumn("blocks", F.lit(0).cast("long"))
    if not big.isEmpty():
        mine = F.pmod(F.xxhash64("fp"), F.col("parts"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
        split = keys.join(big, "key").withColumn("mine", mine).withColumn("other", other)
        pair = F.least("mine", "other") * F.col("parts") + F.greatest("mine", "other")
        rows = rows.join(big, "key", "left_anti").unionByName(split.select("fp", "key", (pair + 1).alias("blocks")))
    together = rows.select("key", "blocks", "fp").repartition(F.col("key"), F.col("blocks")).sortWithinPartitions("key", "blocks")
    return together.mapInArrow(_links, "a long, b long")


def rooted(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, fp, text_id of each row, root (the same for all rows of a component) and component_id (its least doc_id)."""
    rows = written(fingerprints(docs), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct, block)).select(F.col("node").alias("fp"), "root")
    # only fingerprints with a link have to ask for their component's least id
    linked_fps = written(distinct.join(roots, "fp"), "linked")
    least = linked_fps.groupBy("root").agg(F.min("least").alias("component_id"))
    named = salted_join(linked_fps.select("fp", "root"), least, "root", "fp")
    single = distinct.join(roots.select("fp"), "fp", "left_anti").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    return salted_join(rows, named.unionByName(single), "fp", "doc_id", salts=8)


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id of all documents that links (at most 4 differing bits) lead to.
    Nulls: a null text is an empty text; texts without words have fingerprint zero and link like any
    other. A null doc_id counts as larger than any: component_id is null only if the whole component has
    no id. Repeated rows give repeated rows; a very long text is one row like any other; an empty table gives an
    empty result; other columns are ignored.
    """
    return rooted(docs, block).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each component the row with the smallest doc_id (nulls last, then the least SHA-256 of a text), with all its columns.

    Rows are told apart by id and text: of rows that are equal in both one stays, and an id that is repeated
    with another text is judged by that text alone.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), row_key().alias("rid"), F.col("text_id").alias("sha"))
    kept = rooted(docs).groupBy("root").agg(F.min(order).alias("first")).select("first.rid", "first.sha")
    return with_text_key(docs).join(kept, ["rid", "sha"], "left_semi").dropDuplicates(["rid", "sha"]).select("row.*")
