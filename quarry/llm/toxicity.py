"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Examples are a bounded sample of labelled rows (MAX_TOXIC, MAX_CLEAN and MAX_CHARS, by a hash of the id); each is indexed
with all its terms: words, and word starts of 4 and 6 letters. A term weighs (1 + ln tf) * idf ** 2, with
document frequencies over all documents. Examples with like terms share a block, and the index keeps
the largest weight of each term in each block. Lists of rare terms are short and walked in full;
frequent terms are kept block by block, and a block is looked at only if its bound can reach the text's
k-th best so far, so the result is exact. All examples as near as the k-th vote, by similarity and by
how many labelled rows they stand for; a monotone fit over the examples, each of which is scored
without itself, maps votes to probabilities. The nearest examples are the evidence.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import id_and_text, spread, written

#: Bounds of the example sample: rows of each class, and characters of an example's text (longer ones are no examples).
MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 1500, 1500, 20_000
NEIGHBOURS, BLOCK = 100, 64
#: Terms in this share of the examples are kept by blocks, rarer ones by lists.
FREQUENT = 0.05
#: Texts that are searched for together.
BATCH = 128
#: Weight of the prior in a vote.
PRIOR_WEIGHT = 0.2
HOLD_OUT = 5

WORDS = re.compile(r"[^\W\d_]+")
STARTS = (4, 6)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode()) % HOLD_OUT == 0 if doc_id is not None else False


def term_counts(text: str) -> dict[str, int]:
    """Counts of words as they are, and of starts with a dash after them."""
    words = Counter(WORDS.findall(text.lower()))
    out = dict(words)
    for w, n in words.items():
        size = len(w)
        for k in STARTS:
            if size > k:
                t = w[:k] + "-"
                out[t] = out.get(t, 0) + n
    return out


class Terms:
    """Places and counts of those terms of a text that the examples have too."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.words: dict[str, int] | None = None  # made where it is used, not in the driver

    def make(self) -> None:
        self.words = {t: i for i, t in enumerate(self.terms) if t[-1] != "-"}
        self.starts = [(k, {t[:-1]: i for i, t in enumerate(self.terms) if t[-1] == "-" and len(t) == k + 1}) for k in STARTS]

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        if self.words is None:
            self.make()
        words = Counter(WORDS.findall(text.lower()))
        names, n = list(words), np.array(list(words.values()), float)
        found = [np.array([self.words.get(w, -1) for w in names], np.int64)]
        for k, of in self.starts:
            found.append(np.array([of.get(w[:k], -1) if len(w) > k else -1 for w in names], np.int64))
        every = np.concatenate(found)
        known = every >= 0
        terms, at = np.unique(every[known], return_inverse=True)
        return terms, np.bincount(at, weights=np.tile(n, len(found))[known], minlength=len(terms)) if len(terms) else np.zeros(0)


class BlockMaxIndex:
    """Exact nearest examples by cosine in the space of the examples' terms; bounded by the sample."""

    def __init__(self, idf: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]]):
        """idf of each term; (terms, counts) of each example."""
        self.idf = idf
        df = np.bincount(np.concatenate([np.zeros(0, np.int64), *[v[0] for v in vectors]]), minlength=len(idf))
        # alike examples (by their most frequent terms) share blocks, which tightens the bounds
        by_use = [tuple(sorted(v[0].tolist(), key=lambda t: (-df[t], t))[:12]) for v in vectors]
        self.ids = np.array(sorted(range(len(vectors)), key=lambda i: by_use[i]), np.int64)
        frequent = df >= max(2, FREQUENT * len(vectors))
        self.column = np.where(frequent, np.cumsum(frequent) - 1, -1)
        self.dense = np.zeros((len(vectors), int(frequent.sum())))
        lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for row, i in enumerate(self.ids):
            t, w = self.weights(*vectors[i])
            c = self.column[t]
            self.dense[row, c[c >= 0]] = w[c >= 0]
            lists.append((t[c < 0], np.full((c < 0).sum(), row), w[c < 0]))
        t, row, w = (np.concatenate([np.zeros(0, k), *x]) for k, x in zip((np.int64, np.int64, float), zip(*lists))) if lists else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        by = np.argsort(t, kind="stable")
        self.row, self.weight = row[by], w[by]
        self.starts = np.searchsorted(t[by], np.arange(len(idf) + 1))
        self.edges = np.arange(0, len(vectors), BLOCK)
        self.bounds = np.maximum.reduceat(self.dense, self.edges, axis=0) if len(vectors) else np.zeros((0, self.dense.shape[1]))

    def weights(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.idf[terms] ** 2
        return terms, w / (math.sqrt(float((w * w).sum())) or 1.0)

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, without: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector the examples as near as its k-th (ties all belong) and their cosines, nearest first; cosine 0 is none.

        without: for each vector an example that doesn't count.
        """
        out = []
        for a in range(0, len(vectors), BATCH):
            out += self._nearest(vectors[a : a + BATCH], k, None if without is None else without[a : a + BATCH])
        return out

    def _nearest(self, vectors, k, without):
        n, m = len(vectors), len(self.ids)
        if not m:
            return [(np.zeros(0, np.int64), np.zeros(0))] * n
        dense = np.zeros((n, self.dense.shape[1]))
        scores = np.zeros((n, m))
        for i, v in enumerate(vectors):
            t, w = self.weights(*v)
            c = self.column[t]
            dense[i, c[c >= 0]] = w[c >= 0]
            t, w = t[c < 0], w[c < 0]
            sizes = self.starts[t + 1] - self.starts[t]
            if total := int(sizes.sum()):
                at = np.repeat(self.starts[t] - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)
                scores[i] = np.bincount(self.row[at], weights=self.weight[at] * np.repeat(w, sizes), minlength=m)
        hidden = None
        if without is not None:
            back = np.empty(m, np.int64)
            back[self.ids] = np.arange(m)
            hidden = back[without]
        bound = dense @ self.bounds.T + np.maximum.reduceat(scores, self.edges, axis=1)
        order = np.argsort(-bound, axis=1, kind="stable")
        done = np.zeros(bound.shape, bool)
        least = np.zeros(n)
        blocks, step = bound.shape[1], max(1, -(-2 * k // BLOCK))
        first = 0
        while first < blocks:
            wanted = np.zeros(bound.shape, bool)
            np.put_along_axis(wanted, order[:, first : first + step], True, axis=1)
            wanted &= (bound > 0) & (bound >= least[:, None] - 1e-9)
            if not wanted.any():
                break  # later blocks have no larger bounds
            for b in np.flatnonzero(wanted.any(axis=0)):
                rows, span = np.flatnonzero(wanted[:, b]), slice(self.edges[b], self.edges[b] + BLOCK)
                scores[rows, span] += dense[rows] @ self.dense[span].T
            done |= wanted
            first, step = first + step, step * 2
            if first < blocks and m > k:
                seen = np.where(np.repeat(done, BLOCK, axis=1)[:, :m], scores, 0.0)
                if hidden is not None:
                    seen[np.arange(n), hidden] = 0.0
                least = np.partition(seen, m - k, axis=1)[:, m - k]
        scores[~np.repeat(done, BLOCK, axis=1)[:, :m]] = 0.0
        if hidden is not None:
            scores[np.arange(n), hidden] = 0.0
        # rounded: equal texts tie whatever the order of the sums
        scores = np.round(scores, 9)
        out = []
        for s in scores:
            last = np.partition(s, m - k)[m - k] if m > k else 0.0
            hit = np.flatnonzero((s >= last) & (s > 0))
            hit = hit[np.lexsort((self.ids[hit], -s[hit]))]
            out.append((self.ids[hit], s[hit]))
        return out


def monotone_fit(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a non-decreasing map from vote to share of label 1 (pool adjacent violators; equal votes are one)."""
    votes, at = np.unique(votes, return_inverse=True)
    sums = [np.bincount(at, weights=x, minlength=len(votes)) for x in (weights, weights * labels, weights)]
    pools: list[list[float]] = []  # weight, weighted label sum, weighted vote sum
    for w, wy, wv in zip(sums[0], sums[1], sums[2] * votes):
        pools.append([w, wy, wv])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[2] / p[0] for p in pools]), np.array([p[1] / p[0] for p in pools])


class ToxicityModel:
    """Examples, index and calibration; small enough to go with each task (bounded by the constants)."""

    def __init__(self, index: BlockMaxIndex, examples: list[tuple[int, int]], vectors: list[tuple[np.ndarray, np.ndarray]], totals: dict[int, int]):
        """examples: (doc_id, label); totals: labelled rows of each class that the examples stand for."""
        self.index = index
        self.neighbours = NEIGHBOURS
        self.doc_ids = [e[0] for e in examples]
        self.labels = np.array([e[1] for e in examples], dtype=float)
        self.weight = np.where(self.labels > 0, totals.get(1, 0) / max(1, self.labels.sum()), totals.get(0, 0) / max(1, (1 - self.labels).sum()))
        self.prior = totals.get(1, 0) / max(1, sum(totals.values()))
        near = index.nearest(vectors, self.neighbours, without=np.arange(len(vectors)))
        votes = np.array([self.vote(*x) for x in near if len(x[0])])
        found = np.array([len(x[0]) > 0 for x in near], bool)
        self.knots = monotone_fit(votes, self.labels[found], self.weight[found]) if found.any() else (np.array([0.0]), np.array([self.prior]))

    def vote(self, ids: np.ndarray, similarity: np.ndarray) -> float:
        w = similarity * self.weight[ids]
        scale = PRIOR_WEIGHT * w.mean()
        # rounded: equal votes stay equal whatever the order of the sums
        return round(float(((w * self.labels[ids]).sum() + scale * self.prior) / (w.sum() + scale)), 9)

    def scores(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, str]]:
        """Probability of label 1, and the nearest examples as doc_id:label:similarity."""
        out = []
        for ids, similarity in self.index.nearest(vectors, self.neighbours):
            p = float(np.interp(self.vote(ids, similarity), *self.knots)) if len(ids) else self.prior
            out.append((min(1.0, max(0.0, p)), ",".join(f"{self.doc_ids[i]}:{int(self.labels[i])}:{s:.4f}" for i, s in zip(ids[:3], similarity))))
        return out


def sampled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """The examples (doc_id, toxic, text), one row an id however often it is repeated; and the labelled rows of each class."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % HOLD_OUT != 0)
    short = docs.where(F.length(F.coalesce("text", F.lit(""))) <= MAX_CHARS)
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    fit_for = known.join(short.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sample = [r for y, most in ((1, MAX_TOXIC), (0, MAX_CLEAN)) for r in fit_for.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]
    rows = docs.sparkSession.createDataFrame(sample, "doc_id long, toxic int")
    return id_and_text(short).join(F.broadcast(rows), "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text")), totals


VECTOR = "doc_id long, text_id string, terms array<int>, n array<int>"


def vectors_of(docs: DataFrame, terms: list[str]) -> DataFrame:
    """A row per document row, written: doc_id, the text's SHA-256, and which of these terms it has how often."""
    shared = docs.sparkSession.sparkContext.broadcast(Terms(terms))  # as large as the examples' texts at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            found = [shared.value.counts(t) for t in texts]
            ends = pa.array(np.cumsum([0, *[len(t) for t, _ in found]]), pa.int32())
            flat = lambda at: pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[at] for x in found]).astype(np.int32)))
            ids = pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, flat(0), flat(1)], names=["doc_id", "text_id", "terms", "n"])

    return written(spread(id_and_text(docs)).mapInArrow(run, VECTOR), "toxicity-vectors")


def inverse_frequency(vectors: DataFrame, size: int) -> np.ndarray:
    """Of each term, from how many of all documents have it."""

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size + 1, np.int64)
        for batch in batches:
            n[:-1] += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
            n[-1] += batch.num_rows
        hit = np.flatnonzero(n)
        for a in range(0, len(hit), 50_000):
            part = hit[a : a + 50_000]
            yield pa.RecordBatch.from_pydict({"at": pa.array(part), "n": pa.array(n[part])})

    counts = vectors.select("terms").mapInArrow(used, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # a row a term of the examples
    df = np.zeros(size + 1)
    df[counts["at"].to_numpy()] = counts["n"].to_numpy()
    return np.log((1 + df[-1]) / (1 + df[:-1])) + 1


def fit(docs: DataFrame, labels: DataFrame) -> tuple[ToxicityModel, DataFrame]:
    """Learn from labelled rows that are not held out; the model, and the vectors of all documents that it scores.

    docs: doc_id, text; labels: doc_id, toxic (0, 1, null).
    """
    examples, totals = sampled(docs, labels)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [term_counts(t.as_py()) for t in batch.column(2)]
            cols = [batch.column(0), batch.column(1), pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "toxic", "terms", "n"])

    # MAX_TOXIC + MAX_CLEAN rows at most, of texts of MAX_CHARS at most
    taken = examples.mapInArrow(counted, "doc_id long, toxic int, terms array<string>, n array<int>").toArrow().sort_by("doc_id")
    coded = pa.chunked_array([x.flatten() for x in taken["terms"].chunks], pa.string()).combine_chunks().dictionary_encode()
    counts = np.concatenate([np.zeros(0), *[x.flatten().to_numpy() for x in taken["n"].chunks]])
    by = pc.sort_indices(coded.dictionary).to_numpy()
    terms = coded.dictionary.take(pa.array(by)).to_pylist()
    at = np.empty(len(by), np.int64)
    at[by] = np.arange(len(by))
    codes = at[coded.indices.to_numpy()]
    cuts = np.cumsum(pc.list_value_length(taken["n"]).to_numpy())[:-1]
    own = list(zip(np.split(codes, cuts), np.split(counts, cuts))) if taken.num_rows else []
    labelled = list(zip(taken["doc_id"].to_pylist(), taken["toxic"].to_pylist()))
    del taken, coded, counts, codes
    vectors = vectors_of(docs, terms)
    return ToxicityModel(BlockMaxIndex(inverse_frequency(vectors, len(terms)), own), labelled, own, totals), vectors


def score_documents(docs: DataFrame, labels: DataFrame, with_text_id: bool = False) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted, evidence (and text_id, the text's SHA-256, if asked for).

    Nulls: a null text is an empty text; an empty text (or one that shares no term with any example) gets the
    share of label 1 among the labelled rows, without evidence. A null doc_id is not held out and never an example.
    Labels that contradict for one document count as toxic. Without any label all scores are 0. Repeated
    rows are scored each and equal texts alike. Whole texts are scored whatever their length; as examples
    those over MAX_CHARS don't serve. An empty table gives an empty result; other columns are ignored.
    """
    model, vectors = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("evidence", pa.string())]
    fields += [("text_id", pa.string())] if with_text_id else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(2).offsets.to_numpy()
            terms, n = (batch.column(i).values.to_numpy() for i in (2, 3))
            ids = batch.column(0).to_pylist()
            got = shared.value.scores([(terms[a:b], n[a:b]) for a, b in zip(ends, ends[1:])])
            scores = [s for s, _ in got]
            cols = [ids, [held_out(i) for i in ids], scores, [int(s >= 0.5) for s in scores], [e for _, e in got]]
            if with_text_id:
                cols.append(batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])

    schema = "doc_id long, held_out boolean, score double, predicted int, evidence string" + (", text_id string" if with_text_id else "")
    return vectors.mapInArrow(run, schema)
