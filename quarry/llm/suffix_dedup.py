"""Removal of repeated passages by a common-prefix-aware distributed merge sort of suffixes.

Only suffixes at anchors are sorted. The anchor of a 100-byte window is the position in it whose 16-byte string
has the least hash among the window's 85; equal windows have their anchors at the same offset, so every
repeat of 100 bytes shows at an anchor whose 16-byte string is another anchor's too. Anchors whose
string occurs once are dropped first. The rest are sorted within their chunk by what follows them (up to 100
bytes, as far as their own windows reach), front-coded, and exchanged by ranges of their first 16 bytes; runs are merged by a loser tree that
compares strings only beyond prefixes it knows. The merged order's common prefix lengths tell which suffixes
agree on how many bytes to the right; the same is found for the bytes to the left. Two anchors
that agree on both sides of a window's offset hold the same window, and all but the earliest lose it.

A string at more than HOT_COPIES anchors isn't sorted: its place would hold them all. Its anchors' windows
are dealt by 128-bit hashes of their 100 bytes instead, each once from a chunk, so a place gets a
window at most once a chunk.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import NULL_ID, delete, fresh_path, id_and_text, shuffle_partitions, spread, written
from quarry.llm.katz import _rows, packed, packed_sorted, unpacked, unpacked_sorted
from quarry.llm.phrases import _powers

MATCH, GRAM = 100, 16
REACH = MATCH - GRAM  # bytes of a window that can stand left of its anchor
CHUNK_BYTES = 12 << 20
_SLICE = 1 << 20
_PLACE = np.uint64((1 << 21) - 1)  # room for a place in a slice
#: Chunks that the splitters are taken from, and prefixes of each; they decide how evenly places are filled, not what is found.
SAMPLE_CHUNKS, SAMPLE = 16, 2_000
#: A string at more anchors than this is found by its windows' hashes.
HOT_COPIES = 10_000

CHUNK = "chunk long, doc_ids binary, has_id binary, lengths binary, data binary"


def _chunks(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    ids: list[int | None] = []
    texts: list[bytes] = []
    size = made = 0

    def row() -> pa.RecordBatch:
        cols = [(part << 32) + made, packed(np.array([0 if i is None else i for i in ids], np.int64)), packed(np.array([i is not None for i in ids], np.uint8)), packed(np.array([len(t) for t in texts], np.int64)), zlib.compress(b"".join(texts), 4)]
        return pa.RecordBatch.from_arrays([pa.array([c], pa.int64() if i == 0 else pa.binary()) for i, c in enumerate(cols)], names=["chunk", "doc_ids", "has_id", "lengths", "data"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(doc_id)
            texts.append(text.as_py().encode("utf-8", "surrogatepass"))
            size += len(texts[-1])
            if size >= most:
                yield row()
                ids, texts, size, made = [], [], 0, made + 1
    if ids:
        yield row()


class Chunk:
    def __init__(self, row: dict):
        has = unpacked(row["has_id"], np.uint8)
        self.doc_ids = [int(i) if h else None for i, h in zip(unpacked(row["doc_ids"], np.int64), has)]
        self.lengths = unpacked(row["lengths"], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.data = zlib.decompress(row["data"])

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchors by position: where, the hash of the 16 bytes there, and the first and last start of their windows.

        Each window within a document belongs to one anchor, the least of its strings (the leftmost of equals).
        """
        a = np.frombuffer(self.data, np.uint8)
        out: list[tuple[np.ndarray, ...]] = []
        for s in range(0, len(a), _SLICE):
            n = min(_SLICE, len(a) - MATCH + 1 - s)
            if n <= 0:  # the last slice is too short for a window, perhaps even for a string
                break
            h = _gram_hashes(a[s : s + _SLICE + MATCH - 1])
            # the low bits hold the place, so that the least value tells where it stands
            least = _slide((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), REACH + 1, np.minimum)[:n]
            start = np.arange(s, s + n)
            start = start[self.ends[np.searchsorted(self.ends, start, "right")] - start >= MATCH]
            if not len(start):
                continue
            at = (least[start - s] & _PLACE).astype(np.int64)
            new = np.concatenate([[True], at[1:] != at[:-1]])
            out.append((at[new] + s, h[at[new]], start[new], start[np.concatenate([new[1:], [True]])]))
        kinds = (np.int64, np.uint64, np.int64, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.empty(0, k) for k in kinds)


def _gram_hashes(a: np.ndarray) -> np.ndarray:
    up, down = _powers.to(len(a) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], dtype=np.uint64)])
    h = (sums[GRAM:] - sums[:-GRAM]) * down[: len(a) - GRAM + 1]
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over x[i : i + width], for each i where that fits."""
    have = 1
    while 2 * have <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def contexts(c: Chunk, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor: the 84 bytes before and the 100 from it on (zeros outside its windows), their lengths, its document."""
    a = np.frombuffer(b"\0" * REACH + c.data + b"\0" * MATCH, np.uint8)
    left, right = at - first, last + MATCH - at
    rows = np.lib.stride_tricks.sliding_window_view(a, REACH + MATCH)[at].copy()
    col = np.arange(REACH + MATCH)
    rows[(col < REACH - left[:, None]) | (col >= REACH + right[:, None])] = 0
    return rows, left, right, np.searchsorted(c.ends, at, "right")


def window_starts(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All starts from each first to its last."""
    n = last - first + 1
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def window_hashes(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the windows that start there."""
    words = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), 8) if len(starts) else None
    out = np.empty((2, len(starts)), np.uint64)
    for s in range(0, len(starts), _SLICE):
        part = starts[s : s + _SLICE]
        h, g = np.full(len(part), 0x243F6A8885A308D3, np.uint64), np.full(len(part), 0x13198A2E03707344, np.uint64)
        for i in [*range(0, MATCH - 7, 8), MATCH - 8]:
            w = words[part + i].view("<u8").ravel()
            h = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            g = (g + w) * np.uint64(0xBF58476D1CE4E5B9)
            g ^= g >> np.uint64(29)
        out[:, s : s + _SLICE] = h, g
    return out[0], out[1]


def _joined_spans(chunk, doc: np.ndarray, start: np.ndarray) -> dict:
    """Windows that start there, neighbours as one span."""
    by = np.lexsort((start, doc))
    doc, start = doc[by], start[by]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)])
    end = np.concatenate([new[1:], [True]])
    return _spans(chunk, doc[new], start[new], start[end] + MATCH)


def front_coded(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Common prefix length of each sorted row with the row before, and the bytes that differ from it on."""
    lcp = _neighbour_lcp(rows)
    return lcp, rows[np.arange(rows.shape[1]) >= lcp[:, None]].tobytes()


def _neighbour_lcp(rows: np.ndarray) -> np.ndarray:
    differs = rows[1:] != rows[:-1]
    lcp = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    return np.concatenate([[0], lcp]).astype(np.int64) if len(rows) else np.empty(0, np.int64)


def _decoded(lcp: np.ndarray, tails: bytes, width: int) -> list[bytes]:
    out, before, at = [], b"", 0
    for n in lcp.tolist():
        size = width - n
        before = before[:n] + tails[at : at + size]
        at += size
        out.append(before)
    return out


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Merge sorted runs of (strings of one width, their common prefix lengths with the string before).

    Returns the run of each string in merged order (each run's strings keep their order), its place in the
    run, and its common prefix length with the string before it. A loser tree: each loser keeps the length of its common
    prefix with the string that beat it last, so two strings are compared from there on only.
    """
    k = 1
    while k < len(runs):
        k *= 2
    strings = [r[0] for r in runs] + [[]] * (k - len(runs))
    lcps = [r[1] for r in runs] + [[]] * (k - len(runs))
    at = [0] * k
    head: list[bytes | None] = [s[0] if s else None for s in strings]
    known = [0] * k  # common prefix with the last string put out

    def better(x: int, y: int) -> tuple[int, int]:
        """(winner, loser); the loser's known becomes its common prefix with the winner."""
        a, b = head[x], head[y]
        if b is None:
            return x, y
        if a is None:
            return y, x
        kx, ky = known[x], known[y]
        if kx > ky:
            return x, y
        if ky > kx:
            return y, x
        n, i = len(a), kx
        step = 8
        while i < n and a[i : i + step] == b[i : i + step]:
            i += step
        while i < n and a[i] == b[i]:
            i += 1
        i = min(i, n)
        if i == n or a[i] < b[i]:
            known[y] = i
            return x, y
        known[x] = i
        return y, x

    losers = [0] * k
    level = list(range(k))
    while len(level) > 1:
        winners = []
        for j in range(0, len(level), 2):
            w, loser = better(level[j], level[j + 1])
            losers[(len(level) + j) // 2] = loser
            winners.append(w)
        level = winners
    run_of, place_in, lcp_out = [], [], []
    win = level[0]
    while head[win] is not None:
        run_of.append(win)
        place_in.append(at[win])
        lcp_out.append(known[win])
        at[win] += 1
        i = at[win]
        if i < len(strings[win]):
            head[win] = strings[win][i]
            known[win] = lcps[win][i]
        else:
            head[win] = None
        node = (win + k) // 2
        while node >= 1:
            w, losers[node] = better(win, losers[node])
            win = w
            node //= 2
    return run_of, place_in, lcp_out


def repeated(rows: np.ndarray, lcp: np.ndarray, left: np.ndarray, right: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each anchor, the least and the largest offset of a window that an earlier anchor has too (-1: none).

    rows are sorted by their right part, lcp are that part's common prefixes; order: rank of each row by document and position.
    """
    least, most = np.full(len(rows), -1), np.full(len(rows), -1)
    if len(rows) < 2:
        return least, most
    mirrored = np.ascontiguousarray(rows[:, :REACH][:, ::-1])
    by_left = np.argsort(mirrored.view(f"S{REACH}").ravel(), kind="stable")
    left_lcp = _neighbour_lcp(mirrored[by_left])
    left_class = np.empty(len(rows), np.int64)
    for offset in range(REACH + 1):
        ok = np.flatnonzero((left >= offset) & (right >= MATCH - offset))
        if len(ok) < 2:
            continue
        right_class = np.cumsum(lcp < MATCH - offset)
        left_class[by_left] = np.cumsum(left_lcp < offset) if offset else 0
        window = right_class[ok] * np.int64(2**32) + left_class[ok]
        by = np.lexsort((order[ok], window))
        again = ok[by[1:][window[by[1:]] == window[by[:-1]]]]
        most[again] = offset
        least[again] = np.where(least[again] < 0, offset, least[again])
    return least, most


def _spans(chunk, doc, start, end) -> dict:
    return {"kind": "gone", "place": -1, "chunk": int(chunk), "a": packed(doc.astype(np.int64)), "b": packed(start.astype(np.int64)), "c": packed(end.astype(np.int64)), "d": b"", "e": b"", "f": b""}


ROW = "kind string, place int, chunk long, a binary, b binary, c binary, d binary, e binary, f binary"
_TYPES = [("kind", pa.string()), ("place", pa.int32()), ("chunk", pa.int64()), *[(x, pa.binary()) for x in "abcdef"]]


def _table(rows: list[dict]) -> dict:
    return {name: pa.array([r[name] for r in rows], kind) for name, kind in _TYPES}


class SuffixDedup:
    """The steps of the removal; each writes a table under path and deletes those that are not read any more."""

    def __init__(self, docs: DataFrame, path: str | None = None):
        self.spark = docs.sparkSession
        self.path = path or fresh_path(self.spark, "suffix-dedup")
        self.chunks = written(spread(id_and_text(docs)).mapInArrow(functools.partial(_chunks, CHUNK_BYTES), CHUNK), "suffix-chunks")
        # a place holds no more than about a chunk does, however large the input
        self.n = max(shuffle_partitions(self.spark), self.chunks.count())

    def shared_grams(self) -> DataFrame:
        """chunk, and the hashes of its anchors' strings that occur at another anchor too; hot: at very many."""
        n, limit = self.n, HOT_COPIES

        def hashes(row: dict) -> dict:
            keys, counts = np.unique(Chunk(row).anchors()[1], return_counts=True)
            place = (keys >> np.uint64(40)) % np.uint64(n)
            parts = [(p, place == p) for p in np.unique(place).tolist()]
            return {
                "place": pa.array([p for p, _ in parts], pa.int32()),
                "chunk": pa.array([row["chunk"]] * len(parts), pa.int64()),
                "keys": pa.array([packed_sorted(keys[m]) for _, m in parts], pa.binary()),
                "copies": pa.array([packed(counts[m].astype(np.uint32)) for _, m in parts], pa.binary()),
            }

        def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [r for b in batches for r in b.to_pylist()]
            if not rows:
                return
            keys = [unpacked_sorted(r["keys"]) for r in rows]
            _, at = np.unique(np.concatenate(keys), return_inverse=True)
            copies = np.bincount(at, weights=np.concatenate([unpacked(r["copies"], np.uint32) for r in rows]))[at]
            each = [(k, c) for k, c in zip(keys, np.split(copies, np.cumsum([len(k) for k in keys])[:-1]))]
            back = [[packed_sorted(k[m(c)]) for k, c in each] for m in (lambda c: (c > 1) & (c <= limit), lambda c: c > limit)]
            yield pa.RecordBatch.from_arrays([pa.array([r["chunk"] for r in rows], pa.int64()), *[pa.array(x, pa.binary()) for x in back]], names=["chunk", "keys", "hot"])

        sent = _rows(self.chunks, hashes, "place int, chunk long, keys binary, copies binary")
        got = sent.repartitionById(n, F.col("place")).mapInArrow(known, "chunk long, keys binary, hot binary")
        return written(got.repartition(n, "chunk").groupBy("chunk").agg(F.collect_list("keys").alias("keys"), F.collect_list("hot").alias("hot")), "grams", path=f"{self.path}/grams")

    def runs(self, grams: DataFrame) -> DataFrame:
        """Front-coded sorted runs by place, and the spans of anchors whose whole surroundings repeat within a chunk."""
        joined = self.chunks.repartition(self.n, "chunk").join(grams.repartition(self.n, "chunk"), "chunk")

        def sample(row: dict) -> dict:
            c = Chunk(row)
            at = c.anchors()[0]
            at = at[:: max(1, -(-len(at) // SAMPLE))]
            return {"gram": pa.array([c.data[i : i + GRAM] for i in at.tolist()], pa.binary())}

        some = self.chunks.orderBy(F.xxhash64("chunk")).limit(SAMPLE_CHUNKS)
        grams16 = sorted(bytes(r["gram"]).ljust(GRAM, b"\0") for r in _rows(some, sample, "gram binary").collect())  # SAMPLE_CHUNKS * SAMPLE at most
        n = self.n
        splitters = np.array(sorted({grams16[len(grams16) * i // n] for i in range(1, n)}) if grams16 else [], f"S{GRAM}")

        def windows(chunk: int, c: Chunk, start: np.ndarray, rid: np.ndarray, out: list[dict]) -> None:
            """The windows of hot anchors: the earliest of equal ones to their places, the others are gone."""
            doc = np.searchsorted(c.ends, start, "right")
            by = np.lexsort((start, doc, rid[doc]))
            start, doc = start[by], doc[by]
            h, g = window_hashes(c.data, start)
            start = start - (c.ends - c.lengths)[doc]
            by = np.lexsort((g, h))  # stable: equal windows stay in order
            h, g, start, doc = (x[by] for x in (h, g, start, doc))
            first = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
            if not first.all():
                out.append(_joined_spans(chunk, doc[~first], start[~first]))
            h, g, start, doc = (x[first] for x in (h, g, start, doc))
            place = (h >> np.uint64(40)) % np.uint64(n)
            for p in np.unique(place).tolist():
                m = place == p
                out.append({"kind": "window", "place": int(p), "chunk": chunk, "a": packed_sorted(h[m]), "b": packed(g[m]), "c": packed(rid[doc[m]]), "d": packed(doc[m].astype(np.uint32)), "e": packed(start[m].astype(np.uint32)), "f": b""})

        def make(row: dict) -> dict:
            c = Chunk(row)
            at, h, first, last = c.anchors()
            hot = np.isin(h, np.concatenate([unpacked_sorted(k) for k in row["hot"]]))
            shared = np.isin(h, np.concatenate([unpacked_sorted(k) for k in row["keys"]]))
            out: list[dict] = []
            kept: list[tuple[np.ndarray, ...]] = []
            rid = np.array([NULL_ID if i is None else i for i in c.doc_ids], np.int64)
            if hot.any():
                windows(row["chunk"], c, window_starts(first[hot], last[hot]), rid, out)
            at, first, last = at[shared], first[shared], last[shared]
            del h, hot, shared

            def collapse(rows, left, right, doc, where):
                """One anchor for each surroundings, the earliest; the others' windows all repeat it."""
                order = np.lexsort((where, doc, rid[doc]))
                rows, left, right, doc, where = (x[order] for x in (rows, left, right, doc, where))
                key = np.concatenate([rows[:, REACH:], rows[:, :REACH][:, ::-1], left[:, None].astype(np.uint8), right[:, None].astype(np.uint8)], axis=1)
                by = np.argsort(np.ascontiguousarray(key).view(f"V{key.shape[1]}").ravel(), kind="stable") if len(key) else np.empty(0, np.int64)
                key = key[by]
                first = np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]) if len(key) else np.empty(0, bool)
                again = by[~first]
                if len(again):
                    begins = c.ends[doc[again]] - c.lengths[doc[again]]
                    out.append(_spans(row["chunk"], doc[again], where[again] - left[again] - begins, where[again] + right[again] - begins))
                mine = by[first]
                return tuple(x[mine] for x in (rows, left, right, doc, where))

            for s in range(0, len(at), 100_000):
                part = slice(s, s + 100_000)
                kept.append(collapse(*contexts(c, at[part], first[part], last[part]), at[part]))
            if kept:
                rows, left, right, doc, where = collapse(*(np.concatenate(x) for x in zip(*kept)))
                suffix = np.ascontiguousarray(rows[:, REACH:])
                by = np.argsort(suffix.view(f"V{MATCH}").ravel(), kind="stable") if len(rows) else np.empty(0, np.int64)
                rows, left, right, doc, where, suffix = (x[by] for x in (rows, left, right, doc, where, suffix))
                place = np.searchsorted(splitters, np.ascontiguousarray(suffix[:, :GRAM]).view(f"S{GRAM}").ravel(), "right") if len(splitters) else np.zeros(len(rows), np.int64)
                begins = c.ends[doc] - c.lengths[doc]
                for p in np.unique(place).tolist():
                    m = place == p
                    lcp, tails = front_coded(suffix[m])
                    sides = np.stack([left[m], right[m]]).astype(np.uint8)
                    out.append({"kind": "run", "place": p, "chunk": row["chunk"], "a": packed(lcp.astype(np.uint8)), "b": zlib.compress(tails, 1), "c": zlib.compress(rows[m][:, :REACH].tobytes(), 1), "d": packed(sides.ravel()), "e": packed(np.stack([rid[doc[m]], doc[m].astype(np.int64)]).ravel()), "f": packed((where - begins)[m].astype(np.int64))})
            return _table(out)

        runs = written(_rows(joined, make, ROW), "runs", by="kind", path=f"{self.path}/runs")
        delete(self.spark, f"{self.path}/grams")
        return runs

    def merged(self, runs: DataFrame) -> DataFrame:
        """Spans (chunk, documents, starts, ends) that the merge of all runs of a place shows to repeat."""

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [r for b in batches for r in b.to_pylist()]
            if not rows:
                return
            rows.sort(key=lambda r: r["chunk"])
            lcps = [unpacked(r["a"], np.uint8).astype(np.int64) for r in rows]
            texts = [_decoded(n, zlib.decompress(r["b"]), MATCH) for n, r in zip(lcps, rows)]
            run_of, place_in, lcp = merge_runs([(t, n.tolist()) for t, n in zip(texts, lcps)])
            firsts = np.cumsum([0, *[len(t) for t in texts]])[:-1]
            pick = firsts[np.array(run_of)] + np.array(place_in)
            whole = lambda parts: np.concatenate(parts)[pick]
            left_bytes = whole([np.frombuffer(zlib.decompress(r["c"]), np.uint8).reshape(-1, REACH) for r in rows])
            sides = [unpacked(r["d"], np.uint8).astype(np.int64).reshape(2, -1) for r in rows]
            ids = [unpacked(r["e"], np.int64).reshape(2, -1) for r in rows]
            left, right = whole([s[0] for s in sides]), whole([s[1] for s in sides])
            rid, doc, pos = whole([i[0] for i in ids]), whole([i[1] for i in ids]), whole([unpacked(r["f"], np.int64) for r in rows])
            chunk = np.array([r["chunk"] for r in rows], np.int64)[np.array(run_of)]
            order = np.empty(len(pick), np.int64)
            order[np.lexsort((pos, doc, chunk, rid))] = np.arange(len(pick))
            least, most = repeated(left_bytes, np.array(lcp), left, right, order)
            out = []
            for c in np.unique(chunk[most >= 0]).tolist():
                m = (chunk == c) & (most >= 0)
                out.append(_spans(c, doc[m], pos[m] - most[m], pos[m] - least[m] + MATCH))
            if out:
                yield pa.RecordBatch.from_pydict(_table(out))

        return runs.where("kind = 'run'").repartitionById(self.n, F.col("place")).mapInArrow(merge, ROW)

    def repeated_windows(self, runs: DataFrame) -> DataFrame:
        """Spans of the windows around hot anchors that an earlier chunk or document has too."""

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [r for b in batches for r in b.to_pylist()]
            if not rows:
                return
            keys = [unpacked_sorted(r["a"]) for r in rows]
            of = np.repeat(np.arange(len(rows)), [len(k) for k in keys])
            h, g = np.concatenate(keys), np.concatenate([unpacked(r["b"], np.uint64) for r in rows])
            rid = np.concatenate([unpacked(r["c"], np.int64) for r in rows])
            chunk = np.array([r["chunk"] for r in rows], np.int64)
            by = np.lexsort((chunk[of], rid, g, h))
            again = by[1:][(h[by[1:]] == h[by[:-1]]) & (g[by[1:]] == g[by[:-1]])]
            gone = np.zeros(len(of), bool)
            gone[again] = True
            out = []
            for r, m in zip(rows, np.split(gone, np.cumsum([len(k) for k in keys])[:-1])):
                if m.any():
                    out.append(_joined_spans(r["chunk"], unpacked(r["d"], np.uint32)[m].astype(np.int64), unpacked(r["e"], np.uint32)[m].astype(np.int64)))
            if out:
                yield pa.RecordBatch.from_pydict(_table(out))

        return runs.where("kind = 'window'").repartitionById(self.n, F.col("place")).mapInArrow(compare, ROW)

    def result(self) -> DataFrame:
        runs = self.runs(self.shared_grams())
        spans = runs.where("kind = 'gone'").unionByName(self.merged(runs)).unionByName(self.repeated_windows(runs)).select("chunk", "a", "b", "c")
        spans = written(spans, "suffix-spans")
        delete(self.spark, f"{self.path}/runs")
        spans = spans.repartition(self.n, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("a", "b", "c")).alias("gone"))

        def cut(row: dict) -> dict:
            c = Chunk(row)
            a = np.frombuffer(c.data, np.uint8)
            steps = np.zeros(len(a) + 1, np.int64)
            begins = c.ends - c.lengths
            for g in row["gone"] or ():
                doc = unpacked(g["a"], np.int64)
                np.add.at(steps, begins[doc] + unpacked(g["b"], np.int64), 1)
                np.add.at(steps, begins[doc] + unpacked(g["c"], np.int64), -1)
            gone = np.cumsum(steps[:-1]) > 0
            out: dict[str, list] = {"doc_id": c.doc_ids, "n_bytes": c.lengths.tolist(), "n_removed": [], "n_spans": [], "kept_sha256": []}
            for s, e in zip(begins.tolist(), c.ends.tolist()):
                g = gone[s:e]
                n = int(g.sum())
                out["n_removed"].append(n)
                out["n_spans"].append(int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if n else 0)
                out["kept_sha256"].append(hashlib.sha256(a[s:e][~g].tobytes() if n else c.data[s:e]).hexdigest())
            return {k: pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items()}

        return _rows(self.chunks.repartition(self.n, "chunk").join(spans, "chunk", "left"), cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Nulls: a null text is an empty text; a null doc_id comes before all others. Rows with one doc_id are taken in
    the order of their chunks, and of two equal ones the first keeps its bytes. Texts under 100 bytes lose
    nothing. An empty table gives an empty result; other columns are ignored.
    """
    return SuffixDedup(docs).result()
