"""Katz backoff language model of order 3: Good-Turing discounted counts, exactly normalised backoff weights.

Words are 64-bit hashes. Every word of the training documents is a context and a target, whatever the
corpus; one unknown word has the unseen mass. Counts of one, two and three words cover all training documents
and are stored in tables, a row a place and a folder a kind; nothing that grows with the corpus is
gathered or broadcast. The discounts of each order are Simple Good-Turing's: Turing estimates for small counts that
are known well, then a line through the logarithms of the counts of counts, so that Katz's factors exist for any corpus.

The corpus is worked on in chunks of a few million tokens. A chunk's row holds its documents as numbers
into its own sorted word list, so each distinct n-gram of a chunk is sent once to the place that
sums it, and the sum is sent back once, with the n-gram's number: an n-gram is the pair of its context's
number and its last word's. N-grams go to the place that numbered their context, which so knows all that
follows it and sends back what its backoff weight needs; those of the few contexts with a large share of the
tokens are dealt by the pair. A bigram that a single chunk has is no context in any other: that chunk counts
its trigrams itself, and only writes them down, by their places in the chunk. Scoring evaluates a token by its trigram where that was seen, else by its
context's backoff weight times the bigram model of the shorter context, and that likewise by single words.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bucketed, delete, fresh_path, id_and_text, shuffle_partitions, spread, written
from quarry.llm.phrases import _powers
from quarry.llm.simhash import LOWER

HOLD_OUT, HELD = 7, 2
CHUNK_TOKENS = 1_000_000
#: Counts up to this are discounted.
GT_LIMIT = 5
#: Counts of counts up to this one make the line of Simple Good-Turing.
FIT_LIMIT = 1000
#: Its slope must be under -1 (then all factors are in (0, 1)); tiny corpora whose slope isn't have this one.
LEAST_SLOPE = -1.05
#: A Turing estimate further than this many standard deviations from the line is taken as it is (fixed by the method).
DEVIATIONS = 1.96
#: A context with this part of the tokens or more (so no more contexts than this) has its bigrams dealt to all places.
HOT_SHARE = 1024
#: Slots of a place from this one on stand for hot contexts.
HOT_SLOT = 1 << 31
#: The end token's hash; words hash to other values but for one in 2**64.
END = np.uint64(7)
_SLICE = 1 << 20
#: Tokens scored at once.
_PART = 1 << 17
#: Short texts are hashed together, about so many bytes at a time.
_GROUP = 1 << 18
_ZSTD, _UNZSTD = zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % HOLD_OUT == HELD


def packed(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes, the lowest first; a byte tells how many there are, as those that are 0 throughout on top are left out."""
    size = values.dtype.itemsize
    values = np.ascontiguousarray(values)
    top = int(values.view(f"u{size}").max(initial=0))
    planes = np.empty((max(1, -(-top.bit_length() // 8)), len(values)), np.uint8)
    for i, plane in enumerate(planes):
        plane[:] = values.view(np.uint8)[i::size]
    return bytes([len(planes)]) + _ZSTD.compress(planes)


def unpacked(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(_UNZSTD.decompress(memoryview(data)[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros(planes.shape[1], dtype)
    for i, plane in enumerate(planes):
        out.view(np.uint8)[i::size] = plane
    return out


def packed_sorted(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=keys.dtype.type(0)))


def unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


#: Words of more bytes are hashed by XXH64: a polynomial modulo 2**64 gives long words of certain forms one hash.
LONG_WORD = 64


def word_hashes(text: str) -> np.ndarray:
    """Hashes of a text's lower-cased words in order, and of its end."""
    return hashes_of([text.encode("utf-8", "surrogatepass")])[0]


def hashes_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and the end of each text, one text after the other, and how many each has."""
    data = b" ".join(texts).translate(LOWER)
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = len(data)
        if end - at > _SLICE and (found := _BLANK.search(data, at + _SLICE)):
            end = found.start()
        s, h = _hashed(data[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    start = np.concatenate([np.zeros(0, np.int64), *starts])
    sizes = np.array([len(t) + 1 for t in texts])
    n = np.diff(np.searchsorted(start, np.cumsum(sizes) - sizes), append=len(start)) + 1
    out = np.full(n.sum(), END)
    word = np.ones(len(out), bool)
    word[np.cumsum(n) - 1] = False
    out[word] = np.concatenate([np.zeros(0, np.uint64), *hashes])
    return out, n


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words."""
    a = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(_SPACE[a], prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers.to(len(a) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], dtype=np.uint64)])
    h = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]])
    return starts, h


CHUNK = "kind string, chunk long, doc_ids binary, has_id binary, lengths binary, seq binary, words binary, n binary"


def _chunks(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk a row of its documents (kind seq) and one of its words with their training counts (kind words)."""
    ids: list[int | None] = []
    docs: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    texts: list[bytes] = []  # those not hashed yet
    waiting = tokens = made = 0
    part = TaskContext.get().partitionId()

    def rows() -> pa.RecordBatch:
        coded = pa.array(np.concatenate(docs)).dictionary_encode()
        words = coded.dictionary.to_numpy()
        order = np.argsort(words)
        words, place = words[order], np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order))
        seq = place[coded.indices.to_numpy()]
        lengths = np.concatenate(sizes)
        trained = np.repeat([not held_out(i) for i in ids], lengths)
        n = np.bincount(seq[trained], minlength=len(words)).astype(np.uint32)
        two = lambda of_seq, of_words: pa.array([of_seq, of_words], pa.binary())
        return pa.RecordBatch.from_pydict({
            "kind": ["seq", "words"],
            "chunk": pa.array([(part << 32) + made] * 2, pa.int64()),
            "doc_ids": two(packed(np.array([0 if i is None else i for i in ids], np.int64)), None),
            "has_id": two(packed(np.array([i is not None for i in ids], np.uint8)), None),
            "lengths": two(packed(lengths), None),
            "seq": two(packed(seq), None),
            "words": two(None, packed_sorted(words)),
            "n": two(None, packed(n)),
        })

    def hashed() -> None:
        nonlocal texts, waiting, tokens
        hashes, n = hashes_of(texts)
        docs.append(hashes)
        sizes.append(n)
        tokens += len(hashes)
        texts, waiting = [], 0

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            ids.append(doc_id)
            texts.append(text.as_py())
            waiting += len(texts[-1]) + 1  # no fewer than its tokens
            if waiting >= min(size, _GROUP):
                hashed()
            if tokens >= size:
                yield rows()
                ids, docs, sizes, tokens, made = [], [], [], 0, made + 1
    if texts:
        hashed()
    if ids:
        yield rows()


def joined(replies: list[dict], column: str, dtype) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype), *[unpacked(r[column], dtype) for r in replies]])


class Chunk:
    """One chunk's arrays; seq holds places in the chunk's sorted words, ids and counts are those words' numbers and training counts."""

    def __init__(self, row: dict):
        has = unpacked(row["has_id"], np.uint8)
        self.doc_ids = [int(i) if h else None for i, h in zip(unpacked(row["doc_ids"], np.int64), has)]
        self.lengths = unpacked(row["lengths"], np.int64)
        self.seq = unpacked(row["seq"], np.uint32)
        self.held = np.array([held_out(i) for i in self.doc_ids], bool)
        self.firsts = np.cumsum(self.lengths) - self.lengths
        self.trained = np.repeat(~self.held, self.lengths)
        # places hold ranges of the sorted words
        words = sorted(row.pop("order1"), key=lambda r: r["place"])
        self.ids, self.counts = joined(words, "ids", np.uint64), joined(words, "n", np.uint64).astype(np.int64)
        self.word = self.ids[self.seq]

    def before(self) -> np.ndarray:
        """The word before each token, by its place in the chunk's words; a text starts after an end."""
        out = np.concatenate([self.seq[:1], self.seq[:-1]])
        out[self.firsts] = self.seq[self.lengths[0] - 1]
        return out


class Ngrams:
    """A chunk's distinct n-grams whose context is known, in the order of places.

    context: for each token where its context's number stands in numbers, which are distinct but for 0 (unknown).
    names: the contexts, those that are hot last; index: their places in numbers; keys: a place's slot of the context and the last word's
    number; at: each token's n-gram, for the tokens in known.
    """

    def __init__(self, context: np.ndarray, numbers: np.ndarray, word: np.ndarray, hot: np.ndarray, n: int):
        self.known = (numbers > 0)[context]
        here = np.zeros(len(numbers), bool)
        here[context[self.known]] = True
        names = numbers[here]
        is_hot, slot = among(names, hot), (names - np.uint64(1)) // np.uint64(n)
        home = names - np.uint64(1) - slot * np.uint64(n)
        slot[is_hot] = np.uint64(HOT_SLOT) + np.searchsorted(hot, names[is_hot]).astype(np.uint64)
        home[is_hot] = n  # after all places
        order = np.argsort((home << np.uint64(32)) | slot)
        rank = np.zeros(len(numbers), np.uint64)
        self.size, self.places, self.index = len(names), n, np.flatnonzero(here)[order]
        rank[self.index] = np.arange(len(names), dtype=np.uint64)
        self.names, self.cold = names[order], int((~is_hot).sum())
        keys, at = np.unique((rank[context[self.known]] << np.uint64(32)) | word[self.known], return_inverse=True)
        self.of, last = (keys >> np.uint64(32)).astype(np.int64), keys & np.uint64(2**32 - 1)
        place = home[order][self.of]
        tail = slice(int(np.searchsorted(self.of, self.cold)), None)
        mixed = (self.names[self.of[tail]] * np.uint64(0x9E3779B97F4A7C15)) ^ (last[tail] * np.uint64(0xBF58476D1CE4E5B9))
        place[tail] = (mixed >> np.uint64(32)) % np.uint64(n)
        keys = (slot[order][self.of] << np.uint64(32)) | last
        by = np.argsort(place.astype(np.min_scalar_type(n)), kind="stable")  # few bytes, so that it is a radix sort
        self.keys, self.place, self.of = keys[by], place[by], self.of[by]
        back = np.empty(len(by), np.uint32)
        back[by] = np.arange(len(by), dtype=np.uint32)
        self.at = back[at]

    def messages(self, chunk: int, trained: np.ndarray, lower: np.ndarray) -> dict:
        """Rows to the places: training counts in the chunk, and what the place needs of each n-gram's lower order (lower: by token)."""
        target = np.zeros(len(self.keys), np.uint64)
        target[self.at] = lower[self.known]
        n = np.bincount(self.at[trained[self.known]], minlength=len(self.keys)).astype(np.uint32)
        return _messages(chunk, self.place, keys=(self.keys, packed_sorted), n=(n, packed), lower=(target, packed))

    def told(self, replies: list[dict] | None, of_hot: list[tuple[float, list[int]]], hot: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the places reply: training count of each n-gram; sum of lower orders (discounted by d) and times by context."""
        replies = sorted(replies or [], key=lambda r: r["place"])
        low, times = np.zeros(self.size), np.zeros((GT_LIMIT, self.size), np.uint32)
        if replies:
            stats = [stats_of(r, d) for r in replies]
            low[: self.cold] = np.concatenate([x for x, _ in stats])
            times[:, : self.cold] = np.concatenate([x for _, x in stats], axis=1)
        for i in range(self.cold, self.size):
            low[i], times[:, i] = of_hot[int(np.searchsorted(hot, self.names[i]))]
        return joined(replies, "n", np.uint32).astype(np.int64), low, times


class Lone:
    """A chunk's distinct trigrams whose contexts (lone, of all contexts) no other chunk has; known, of, at and index as in Ngrams."""

    def __init__(self, context: np.ndarray, lone: np.ndarray, word: np.ndarray, trained: np.ndarray, lower: np.ndarray):
        self.known, self.index = lone[context], np.flatnonzero(lone)
        rank = np.cumsum(lone).astype(np.uint64)[context[self.known]] - np.uint64(1)
        keys, self.at = np.unique((rank << np.uint64(32)) | word[self.known], return_inverse=True)
        self.of, self.size = (keys >> np.uint64(32)).astype(np.int64), int(lone.sum())
        self.n = np.bincount(self.at[trained[self.known]], minlength=len(keys))
        self.lower = np.zeros(len(keys), np.int64)
        self.lower[self.at] = lower[self.known].astype(np.int64)

    def message(self, chunk: int, place: int) -> dict:
        """A row (without lower) of the counts, by the places in the chunk where its trigrams first end."""
        where = np.flatnonzero(self.known)
        first = np.full(len(self.n), 2**63 - 1, np.int64)
        np.minimum.at(first, self.at, where)
        seen = np.flatnonzero(self.n)
        seen = seen[np.argsort(first[seen])]
        return {"place": place, "chunk": chunk, "keys": packed_sorted(first[seen].astype(np.uint64)), "n": packed(self.n[seen].astype(np.uint32)), "lower": None}

    def told(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What places reply for other trigrams."""
        seen = self.n > 0
        times = np.array([np.bincount(self.of[self.n == r], minlength=self.size) for r in range(1, GT_LIMIT + 1)], np.uint32)
        return self.n, np.bincount(self.of[seen], weights=discounted(self.lower[seen], d), minlength=self.size), times


def stats_of(row: dict, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By context: sum of its followers' lower orders, discounted by d, and how many followers were seen 1, 2, ... times."""
    times, small = unpacked(row["times"], np.uint32).reshape(2, GT_LIMIT, -1)
    return unpacked(row["sums"], np.uint64) - (np.arange(1, len(d)) * (1 - d[1:])) @ small, times


def among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def _messages(chunk: int, place: np.ndarray, **columns) -> dict:
    """One row a place from arrays in the order of places; columns are (array, how to pack it)."""
    ends = np.flatnonzero(np.diff(place, append=np.uint64(2**64 - 1)) != 0) + 1
    starts = np.concatenate([[0], ends])[:-1].astype(np.int64)  # none if there is nothing to send
    out = {"place": pa.array([int(place[i]) for i in starts], pa.int32()), "chunk": pa.array([chunk] * len(starts), pa.int64())}
    return out | {k: pa.array([pack(x[a:b]) for a, b in zip(starts, ends)], pa.binary()) for k, (x, pack) in columns.items()}


def _rows(df: DataFrame, make, schema: str) -> DataFrame:
    """make(row as a dict) -> a dict of columns, for each row of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # rows are large
                yield pa.RecordBatch.from_pydict(make(batch.slice(i, 1).to_pylist()[0]))

    return df.mapInArrow(run, schema)


def discounts(n: dict[int, int], limit: int = GT_LIMIT) -> np.ndarray:
    """Katz's factors d[r] for counts r = 0..limit from counts of counts, estimated by Simple Good-Turing.

    From count 1 on, the Turing estimate (r + 1) n[r + 1] / n[r] holds while it differs from the line's by more than
    DEVIATIONS of its standard deviation; from the first count where it doesn't (or isn't below r, as factors must be), the
    line holds for all. For the line each count of counts is spread over the gap to its neighbours; its slope b gives counts
    of counts in proportion to r ** b. Fewer than two different counts have LEAST_SLOPE.
    """
    r = np.array(sorted(k for k in n if k > 0 and n[k]), float)
    slope = LEAST_SLOPE
    if len(r) > 1:
        gaps = np.concatenate([[r[1]], r[2:] - r[:-2], [2 * (r[-1] - r[-2])]]) / 2
        slope = min(slope, float(np.polyfit(np.log(r), np.log(np.array([n[int(k)] for k in r]) / gaps), 1)[0]))
    up_to = np.arange(1, limit + 1)
    kept = ((up_to + 1) / up_to) ** (1 + slope)  # what stays of a count
    for k in range(1, limit + 1):
        here, above = n.get(k, 0), n.get(k + 1, 0)
        turing = (k + 1) * above / here if here else 0.0
        if not 0 < turing < k or abs(turing - k * kept[k - 1]) <= DEVIATIONS * (k + 1) / here * (above * (1 + above / here)) ** 0.5:
            break
        kept[k - 1] = turing / k
    # (limit + 1) n[limit + 1] / n[1] of the estimates: Katz leaves counts above the limit as they are
    tail = kept.prod()
    return np.concatenate([[1.0], (kept - tail) / (1 - tail)])


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * np.where(counts < len(d), d[np.minimum(counts, len(d) - 1)], 1.0)


def weights(c: np.ndarray, times: np.ndarray, low: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backoff weights and the scale of seen n-grams, for contexts with counts c, times[r - 1] followers seen r times and followers' lower orders summing to low."""
    kept = c - (np.arange(1, len(d)) * (1 - d[1:])) @ times
    # a context without a discounted count still leaves 1 of c + 1 for what it wasn't seen with
    mass = np.maximum(1 - kept / c, 1 / (c + 1))
    some = 1 - low > 1e-12  # else every word was seen after this one: nothing to back off to
    return np.where(some, mass / np.where(some, 1 - low, 1.0), 0.0), np.where(some, 1 - mass, 1.0) * c / kept


class Unigrams:
    """The model of single words by training counts: the empty context, with the unknown word as all that wasn't seen."""

    def __init__(self, total: int, distinct: int, n: dict[int, int]):
        self.total, self.distinct = total, distinct
        self.d = discounts(n)
        self.unknown, self.scale = 1.0, 0.0  # scale: of seen words
        if total:
            times = np.array([[n.get(r, 0)] for r in range(1, GT_LIMIT + 1)])
            self.unknown, self.scale = (float(x[0]) for x in weights(np.array([total]), times, np.zeros(1), self.d))

    def of_word(self, counts: np.ndarray) -> np.ndarray:
        """Probability of words with these counts (0: unknown)."""
        return np.where(counts > 0, discounted(counts, self.d) * self.unit, self.unknown)

    @property
    def unit(self) -> float:
        """Probability of a seen word by its discounted count."""
        return self.scale / max(1, self.total)


class KatzModel:
    """Count tables (Parquet, under path) and the few parameters of a model fitted on documents."""

    def __init__(self, docs: DataFrame, path: str | None = None):
        spark = self.spark = docs.sparkSession
        self.path = path or fresh_path(spark, "katz")
        chunks = written(spread(id_and_text(docs)).mapInArrow(functools.partial(_chunks, CHUNK_TOKENS), CHUNK), "chunks", by="kind", path=f"{self.path}/chunks")
        self.chunks = chunks.where("kind = 'seq'").select("chunk", "doc_ids", "has_id", "lengths", "seq")
        # a place holds about what a chunk does
        self.n = max(shuffle_partitions(spark), self.chunks.count())
        self._count_words(chunks.where("kind = 'words'").select("chunk", "words", "n"))
        self._delete("chunks/kind=words")
        self.ngrams: dict[int, DataFrame] = {}
        self.hot: dict[int, np.ndarray] = {2: self._frequent(self.words, np.uint64)}
        self.of_hot: dict[int, list] = {}
        self.d = {1: self.law.d}
        # from here on chunks lie where replies are sent, and carry those of single words
        self.chunks = bucketed(self.chunks.repartition(self.n, "chunk").join(self._replies(1), "chunk"), f"{self.path}/numbered", "chunk", self.n)
        self._delete("chunks", "order1/kind=reply")
        self._count_ngrams(2)
        self.hot[3] = self._frequent(self.ngrams[2], np.uint32)
        # a chunk without a known context has no replies
        self.chunks = self.chunks.join(bucketed(self._replies(2), f"{self.path}/replied", "chunk", self.n), "chunk", "left")
        self._delete("order2/kind=reply")
        self._count_ngrams(3)

    def _delete(self, *parts: str) -> None:
        for part in parts:
            delete(self.spark, f"{self.path}/{part}")

    def _exchanged(self, sent: DataFrame, summed, schema: str, name: str) -> DataFrame:
        """What summed (rows of a place -> batch) gives for each place, by kind."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by_place: dict[int, list[dict]] = {}
            for b in batches:
                for r in b.to_pylist():
                    by_place.setdefault(r["place"], []).append(r)
            for p in sorted(by_place):
                yield summed(by_place.pop(p))

        got = sent.repartitionById(self.n, F.col("place")).mapInArrow(run, schema)
        return written(got, name, by="kind", path=f"{self.path}/{name}")

    def _count_words(self, chunks: DataFrame) -> None:
        n = self.n

        def words(row: dict) -> dict:
            w = unpacked_sorted(row["words"])
            # hashes are even, so ranges of them are; a chunk's sorted words stay in order
            return _messages(row["chunk"], ((w >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32), keys=(w, packed_sorted), n=(unpacked(row["n"], np.uint32), packed))

        def summed(rows: list[dict]) -> pa.RecordBatch:
            place, keys = rows[0]["place"], [unpacked_sorted(r["keys"]) for r in rows]
            words, at = np.unique(np.concatenate(keys), return_inverse=True)
            totals = np.bincount(at, weights=np.concatenate([unpacked(r["n"], np.uint32) for r in rows])).astype(np.uint64)
            # frequent words get small numbers
            seen = np.flatnonzero(totals)
            seen = seen[np.argsort(totals[seen], kind="stable")[::-1]]
            if len(seen) and len(seen) * n + place >= 2**32:
                raise OverflowError("words have numbers of 32 bits")
            ids = np.zeros(len(words), np.uint64)
            ids[seen] = np.arange(len(seen)).astype(np.uint64) * np.uint64(n) + np.uint64(place + 1)
            cuts = np.cumsum([len(k) for k in keys])[:-1]
            known = totals > 0
            return pa.RecordBatch.from_pydict({
                "kind": ["reply"] * len(rows) + ["model"],
                "place": pa.array([place] * (len(rows) + 1), pa.int32()),
                "chunk": pa.array([*[r["chunk"] for r in rows], -1], pa.int64()),
                "keys": pa.array([*[None] * len(rows), packed_sorted(words[known])], pa.binary()),
                "ids": pa.array([packed(x) for x in [*np.split(ids[at], cuts), ids[known]]], pa.binary()),
                "n": pa.array([packed(x) for x in [*np.split(totals[at], cuts), totals[known]]], pa.binary()),
            })

        sent = _rows(chunks, words, "place int, chunk long, keys binary, n binary")
        self.words = self._exchanged(sent, summed, "kind string, place int, chunk long, keys binary, ids binary, n binary", "order1")
        self.law = Unigrams(*self._counts_of_counts(self.words, np.uint64))

    def _counts_of_counts(self, table: DataFrame, dtype) -> tuple[int, int, dict[int, int]]:
        """Sum and number of the counts, and how many are r for the r up to FIT_LIMIT."""

        def of_place(row: dict) -> dict:
            counts = unpacked(row["n"], dtype).astype(np.int64)
            r, k = np.unique(counts[counts <= FIT_LIMIT], return_counts=True)
            return {"r": pa.array([0, -1, *r.tolist()], pa.int64()), "k": pa.array([int(counts.sum()), len(counts), *k.tolist()], pa.int64())}

        rows = _rows(table.where("kind IN ('model', 'lone')").select("n"), of_place, "r long, k long").groupBy("r").agg(F.sum("k").alias("k")).collect()  # FIT_LIMIT + 2 at most
        k = {r["r"]: r["k"] for r in rows}
        return k.pop(0, 0), k.pop(-1, 0), k

    def _frequent(self, table: DataFrame, dtype) -> np.ndarray:
        """Numbers of the table's words or n-grams with 1 in HOT_SHARE of the tokens or more, of which there are HOT_SHARE at most."""
        least = max(1, -(-self.law.total // HOT_SHARE))

        def frequent(row: dict) -> dict:
            many = unpacked(row["n"], dtype) >= least
            # n-grams are numbered in their stored order
            ids = unpacked(row["ids"], np.uint64) if row["ids"] else self_numbers(len(many), row["place"])
            return {"id": pa.array(ids[many].astype(np.int64))}

        self_numbers = functools.partial(numbered, self.n)
        return np.sort(np.array([r["id"] for r in _rows(table.where("kind = 'model'").select("place", "ids", "n"), frequent, "id long").collect()], np.uint64))

    def _replies(self, order: int) -> DataFrame:
        """What the places of this order replied, a row a chunk."""
        table = self.words if order == 1 else self.ngrams[order]
        names = ["place", "n", *{1: ["ids"], 2: ["ids", "lone", "sums", "times"], 3: ["sums", "times"]}[order]]
        rows = table.where("kind = 'reply'").select("chunk", *names).repartition(self.n, "chunk")
        return rows.groupBy("chunk").agg(F.collect_list(F.struct(*names)).alias(f"order{order}"))

    def _count_ngrams(self, order: int) -> None:
        n, hot = self.n, self.hot

        def sent(row: dict) -> dict:
            c = Chunk(row)
            before = c.before()
            two = Ngrams(before, c.ids, c.word, hot[2], n)
            if order == 2:
                return two.messages(row["chunk"], c.trained, c.counts.astype(np.uint64)[c.seq])
            context, numbers, lone, count = bigrams_of(c, two, row["order2"])
            del two
            out = Ngrams(context, numbers, c.word, hot[3], n).messages(row["chunk"], c.trained, count)
            own = Lone(context, lone, c.word, c.trained, count).message(row["chunk"], row["chunk"] % n)
            return {k: pa.array([*x.to_pylist(), own[k]], x.type) for k, x in out.items()}

        def summed(rows: list[dict]) -> pa.RecordBatch:
            place, alone, rows = rows[0]["place"], [r for r in rows if r["lower"] is None], [r for r in rows if r["lower"] is not None]
            keys = [unpacked_sorted(r["keys"]) for r in rows]
            cuts = np.cumsum([len(k) for k in keys], dtype=np.int64)[:-1]
            every, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]), return_inverse=True)
            totals = np.bincount(at, weights=joined(rows, "n", np.uint32), minlength=len(every)).astype(np.int64)
            senders = np.bincount(at, minlength=len(every))
            target = np.zeros(len(every), np.int64)
            target[at] = joined(rows, "lower", np.uint64).astype(np.int64)
            seen = totals > 0
            slot = every >> np.uint64(32)
            first = np.flatnonzero(np.diff(slot, prepend=np.uint64(2**64 - 1)))
            of = np.repeat(np.arange(len(first)), np.diff(first, append=len(slot)))
            slot = slot[first]
            # followers by count and by lower order; discounts and constant factors are left to the chunks
            times = np.zeros((2, GT_LIMIT, len(slot)), np.uint32)
            for x, t in zip((totals, target), times):
                few = np.flatnonzero(seen & (x <= GT_LIMIT) & (x > 0))
                t[:] = np.bincount((x[few] - 1) * len(slot) + of[few], minlength=GT_LIMIT * len(slot)).reshape(GT_LIMIT, -1)
            sums = np.bincount(of[seen], weights=target[seen], minlength=len(slot)).astype(np.uint64)  # under 2**53, so exact
            rank = np.cumsum(seen, dtype=np.uint64) - np.uint64(1)
            if len(slot) and seen.sum() >= HOT_SLOT:
                raise OverflowError("a place numbers fewer than 2**31 n-grams")
            out: dict[str, list] = {c: [] for c in ("keys", "ids", "n", "lone", "slots", "sums", "times")}

            def add(**columns: bytes) -> None:
                for c in out:
                    out[c].append(columns.get(c))

            stats = lambda which: {"sums": packed(sums[which]), "times": packed(times[:, :, which].ravel())}
            for _, part in zip(rows, np.split(at, cuts)):
                # of n-grams that were seen, their ranks among all of the place's; they make their numbers
                numbers = {"ids": packed_sorted(rank[part[seen[part]]]), "lone": packed(np.packbits(senders[part] == 1))} if order == 2 else {}
                mine = of[part]
                mine = mine[np.flatnonzero(np.diff(mine, prepend=-1))]
                add(n=packed(totals[part].astype(np.uint32)), **numbers, **stats(mine[slot[mine] < HOT_SLOT]))
            cold = slot < HOT_SLOT
            add(keys=packed_sorted(every[seen]), n=packed(totals[seen].astype(np.uint32)))
            add(slots=packed_sorted(slot[~cold]), **stats(~cold))
            for r in alone:
                add(keys=r["keys"], n=r["n"])
            kinds = ["reply"] * len(rows) + ["model", "hot"] + ["lone"] * len(alone)
            return pa.RecordBatch.from_pydict({
                "kind": kinds,
                "place": pa.array([place] * len(kinds), pa.int32()),
                "chunk": pa.array([*[r["chunk"] for r in rows], -1, -1, *[r["chunk"] for r in alone]], pa.int64()),
                **{c: pa.array(x, pa.binary()) for c, x in out.items()},
            })

        schema = "kind string, place int, chunk long, keys binary, ids binary, n binary, lone binary, slots binary, sums binary, times binary"
        message = "place int, chunk long, keys binary, n binary, lower binary"
        self.ngrams[order] = self._exchanged(_rows(self.chunks, sent, message), summed, schema, f"order{order}")
        self.d[order] = discounts(self._counts_of_counts(self.ngrams[order], np.uint32)[2])
        self.of_hot[order] = self._sums_of_hot(order)

    def _sums_of_hot(self, order: int) -> list[tuple[float, list[int]]]:
        """Sum of lower orders and times of each hot context, over all places."""
        d = self.d[order - 1]
        names = [f"n{r}" for r in range(1, GT_LIMIT + 1)]

        def rows(row: dict) -> dict:
            low, times = stats_of(row, d)
            at = unpacked_sorted(row["slots"]) - np.uint64(HOT_SLOT)
            return {"at": pa.array(at.astype(np.int64)), "low": pa.array(low), **{k: pa.array(x) for k, x in zip(names, times.astype(np.int64))}}

        table = self.ngrams[order].where("kind = 'hot'").select("slots", "sums", "times")
        parts = _rows(table, rows, "at long, low double, " + ", ".join(f"{x} long" for x in names))
        found = {r["at"]: (r["low"], [r[x] for x in names]) for r in parts.groupBy("at").agg(*[F.sum(x).alias(x) for x in ("low", *names)]).collect()}  # HOT_SHARE rows at most
        return [found.get(i, (0.0, [0] * GT_LIMIT)) for i in range(len(self.hot[order]))]

    def score(self) -> DataFrame:
        """One row per document of the chunks."""
        law, d, hot, n, of_hot = self.law, self.d, self.hot, self.n, self.of_hot

        def run(row: dict) -> dict:
            c = Chunk(row)
            before = c.before()
            two = Ngrams(before, c.ids, c.word, hot[2], n)
            context, numbers, lone, lower = bigrams_of(c, two, row["order2"])
            seen, low, times = two.told(row.pop("order2"), of_hot[2], hot[2], d[1])
            # by word of the chunk: its count and weights as a context
            place = np.argsort(c.ids, kind="stable")
            place = place[np.searchsorted(c.ids[place], two.names)]
            backoff, scale = np.ones(len(c.ids)), np.ones(len(c.ids))
            backoff[place], scale[place] = weights(c.counts[place], times, low * law.unit, d[2])
            of_context = scale / np.maximum(c.counts, 1)
            counts = np.append(seen, 0)  # of bigrams as contexts
            del two, seen, low, times
            p, of_word = np.empty(len(c.seq)), law.of_word(c.counts)
            for a in range(0, len(p), _PART):
                part = slice(a, a + _PART)
                b, pair = before[part], lower[part].astype(np.int64)
                p[part] = np.where(pair > 0, discounted(pair, d[2]) * of_context[b], backoff[b] * of_word[c.seq[part]])
            three = Ngrams(context, numbers, c.word, hot[3], n)
            _by_trigram(p, three, *three.told(row.pop("order3"), of_hot[3], hot[3], d[2]), counts, before, of_context, d[3])
            del three
            own = Lone(context, lone, c.word, c.trained, lower)
            del context, numbers, lone, lower
            _by_trigram(p, own, *own.told(d[2]), counts, before, of_context, d[3])
            del own
            logs = np.log10(np.maximum(p, 1e-300))
            base = np.log10((c.counts + 1) / (law.total + law.distinct + 1))[c.seq]
            per = lambda x: np.add.reduceat(x, c.firsts)  # noqa: E731  every document has an end token at least
            return {
                "doc_id": pa.array(c.doc_ids, pa.int64()),
                "held_out": pa.array(c.held),
                "n_tokens": pa.array(c.lengths),
                "n_known": pa.array(per((c.counts > 0).astype(np.int64)[c.seq])),
                "train_tokens": pa.array(np.full(len(c.lengths), law.total, np.int64)),
                "base_score": pa.array(per(base)),
                "score": pa.array(per(logs)),
            }

        return _rows(self.chunks.join(self._replies(3), "chunk", "left"), run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def numbered(n: int, many: int, place: int) -> np.ndarray:
    """The numbers that a place gives to its n-grams, in order; n places share out all numbers."""
    return np.arange(many, dtype=np.uint64) * np.uint64(n) + np.uint64(place + 1)


def _by_trigram(p: np.ndarray, three: Ngrams | Lone, seen: np.ndarray, low: np.ndarray, times: np.ndarray, counts: np.ndarray, before: np.ndarray, of_context: np.ndarray, d: np.ndarray) -> None:
    """Turn p by bigram into p by trigram where the context is one of three's; counts: training counts of the chunk's bigrams; before: as in Chunk; of_context: by word."""
    # of each context (a bigram): its count, and the factor that its followers' bigrams share
    count, factor = counts[three.index], np.ones(three.size)
    known = np.flatnonzero(three.known)
    parts = [slice(a, a + _PART) for a in range(0, len(known), _PART)]
    for part in parts:
        factor[three.of[three.at[part]]] = of_context[before[known[part]]]
    backoff, scale = weights(count, times, low * factor, d)
    scale /= count
    for part in parts:
        at, k = three.at[part], known[part]
        of, m = three.of[at], seen[at]
        p[k] = np.where(m > 0, discounted(m, d) * scale[of], backoff[of] * p[k])


def bigrams_of(c: Chunk, two: Ngrams, replies: list[dict] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bigram before each token, by its place in the numbers of bigrams (the last of them is 0, for none: a text's first token
    has none; those that no other chunk has are 0 too); which are of this chunk alone; by token the training count of the bigram
    that ends there."""
    replies = sorted(replies or [], key=lambda r: r["place"])
    n = [unpacked(r["n"], np.uint32) for r in replies]
    numbers = np.zeros(sum(map(len, n)) + 1, np.uint64)
    ranks = [unpacked_sorted(r["ids"]) * np.uint64(two.places) + np.uint64(r["place"] + 1) for r in replies]
    seen = np.concatenate([*n, np.zeros(1, np.uint32)]) > 0
    numbers[seen] = np.concatenate([np.zeros(0, np.uint64), *ranks])
    bits = [np.unpackbits(unpacked(r["lone"], np.uint8), count=len(i)) for r, i in zip(replies, n)]
    lone = (np.concatenate([*bits, np.zeros(1, np.uint8)]) > 0) & (numbers > 0)
    numbers[lone] = 0
    place, count = np.full(len(c.seq), len(numbers) - 1, np.uint32), np.zeros(len(c.seq), np.uint64)
    place[two.known] = two.at
    count[two.known] = np.concatenate([np.zeros(0, np.uint32), *n])[two.at]
    context = np.concatenate([place[:1], place[:-1]])
    context[c.firsts] = len(numbers) - 1
    return context, numbers, lone, count


def score_documents(docs: DataFrame) -> DataFrame:
    """Fit on the documents that are not held out and score all of them.

    Nulls: a null text is an empty text, which is one end token; a null doc_id is never held out. Repeated
    rows count and are scored each. A very long text is one document of its chunk, hashed slice by slice. An
    empty table gives an empty result; other columns are ignored. If no document is left for training, every
    word is unknown.
    """
    return KatzModel(docs).score()
