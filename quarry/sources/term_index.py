"""A stored term index: segments of postings in blocks, deletes by tombstones, block-max search.

Chunks go into segments. A segment's rows are numbered in order of their lengths, RANGE neighbours make a
range, and a term's postings of a range are one row with their largest weight. Each add or delete writes signed
deltas of document frequencies; a snapshot names the segments, deltas and tombstones that count, and holds totals.
A search reads the postings of its words alone. A task sums the largest weights of each question's words in a range,
and scores the range only for those questions whose k-th score so far it could reach. Results are those of Bm25Index.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import light_stem, raw_tokens, stem_word
from quarry.operators.retrieval import B, DIGITS, EPSILON, K1, spread, top_k
from quarry.sources.snapshots import Snapshots, written

FORMAT = 1
#: Neighbours in a range are 2**RANGE_BITS. Questions of a block.
RANGE_BITS, QUESTIONS = 7, 1024
#: Postings that a bucket folder of the first segment is planned for; least and most buckets.
BUCKET_POSTINGS, BUCKETS = 2**24, (16, 2**12)
#: Pairs of questions and rows that are scored at once.
PAIRS = 1 << 14
#: Up to so many distinct words of a block of questions are pushed down to the scan.
PUSHED_TERMS = 10_000


def _saturation(tf, dl, avgdl):
    return tf / (tf + K1 * (1 - B + B * dl / avgdl))


def _counted(stem: bool):
    """(chunk_id, tokens) -> (chunk_id, dl, terms, tfs): a text's words counted where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(1)
            sizes = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
            words = tokens.flatten().dictionary_encode()
            terms, code = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            if stem:  # each word of the batch once
                stems = pa.array([stem_word(w) for w in terms.to_pylist()], pa.string()).dictionary_encode()
                terms, code = stems.dictionary, stems.indices.to_numpy(zero_copy_only=False).astype(np.int64)[code]
            key, tfs = np.unique(np.repeat(np.arange(len(sizes)), sizes) * max(1, len(terms)) + code, return_counts=True)
            row, at = np.divmod(key, max(1, len(terms)))
            offsets = pa.array(np.searchsorted(row, np.arange(len(sizes) + 1)), pa.int32())
            lists = lambda x: pa.ListArray.from_arrays(offsets, x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), lists(terms.take(pa.array(at))), lists(pa.array(tfs, pa.int64()))], names=["chunk_id", "dl", "terms", "tfs"])

    return run


def _blocks(avgdl: float, buckets: int):
    """Rows (doc_no, dl, terms, tfs) in order -> a row for each range and term. A range that is read in two parts gives two rows, which are as good."""
    names, step = ["bucket", "term", "range", "docs", "tfs", "dls", "top"], 1 << RANGE_BITS + 3

    def made(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        terms, tfs = rows.column(2), rows.column(3).flatten().to_numpy(zero_copy_only=False)
        if not len(tfs):
            return None
        words = terms.flatten().dictionary_encode()
        sizes = np.diff(terms.offsets.to_numpy())
        docs, dls = np.repeat(rows.column(0).to_numpy(), sizes), np.repeat(rows.column(1).to_numpy(), sizes)
        word, first = words.indices.to_numpy().astype(np.int64), int(docs[0] >> RANGE_BITS)
        key = ((docs >> RANGE_BITS) - first) * len(words.dictionary) + word
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) > 0]))
        offsets = pa.array(np.append(starts, len(order)), pa.int32())
        lists = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x[order], pa.int64()))
        top = np.maximum.reduceat(_saturation(tfs[order], dls[order], avgdl), starts)
        in_bucket = np.array([hash_of(w) % buckets for w in words.dictionary.to_pylist()], np.int32)
        at = word[order][starts]
        return pa.RecordBatch.from_arrays(
            [pa.array(in_bucket[at]), words.dictionary.take(pa.array(at)), pa.array((key[order][starts] // len(words.dictionary) + first)), lists(docs), lists(tfs), lists(dls), pa.array(top)], names=names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                rows = batch.slice(start, step)
                if (out := made(rows.take(pa.array(np.arange(rows.num_rows))))) is not None:  # take: offsets from 0 on
                    yield out

    return run


def _best(weights: pa.Table, k: int, avgdl: float):
    """Rows of _ranges() -> the k best rows of each question in a task, and all that tie with the k-th."""
    words = pc.unique(weights["term"]).sort()
    weights = weights.append_column("place", pc.index_in(weights["term"], value_set=words)).sort_by([("query_id", "ascending"), ("w", "ascending"), ("place", "ascending")])
    asked = weights["query_id"].combine_chunks().dictionary_encode()
    ids, owner, w, word = asked.dictionary, asked.indices.to_numpy(), weights["w"].to_numpy(), weights["place"].to_numpy()
    begin = np.searchsorted(owner, np.arange(len(ids)))
    positive, width = np.maximum(w, 0) * (K1 + 1), 1 << RANGE_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.full(len(ids), -np.inf)  # each question's k-th score so far
        kept: list[list[np.ndarray]] = [[] for _ in range(len(ids))]  # scores, and places in ranges
        ranges: list[tuple[str, int]] = []
        gone: dict[tuple[str, int], list[int]] = {}

        def score(at: tuple[str, int], place, row, docs, tf, dl, most) -> None:
            """A range's words (place, most), and its postings: which of the words (row), doc_no, tf and dl."""
            top, line, found = np.zeros(len(words)), np.full(len(words), -1), np.unique(place)
            np.maximum.at(top, place, most)
            line[found] = np.arange(len(found))
            # a question's words by weight: while those so far can't reach its k-th score, a row that has no later one can't either
            reach = np.cumsum(positive * top[word])
            reach -= (reach[begin] - positive[begin] * top[word[begin]])[owner]
            use = np.flatnonzero(line[word] >= 0)
            telling = use[reach[use] >= least[owner[use]] - 2 * 10.0**-DIGITS]  # less rounds to less than the k-th
            if not len(telling):
                return
            matrix = np.zeros((len(found), width))
            matrix[line[place][row], docs & (width - 1)] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
            if at in gone:
                matrix[:, np.array(gone[at]) & (width - 1)] = 0
            own = owner[telling]
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            which, column = np.nonzero(np.logical_or.reduceat((matrix > 0)[line[word[telling]]], starts, axis=0))
            asking = own[starts][which]
            first, n = np.searchsorted(owner[use], np.arange(len(ids))), np.bincount(owner[use], minlength=len(ids))
            better = []
            for start in range(0, len(asking), PAIRS):
                q, doc = asking[start : start + PAIRS], column[start : start + PAIRS]
                ends = np.cumsum(n[q])
                pairs = use[np.arange(ends[-1]) + np.repeat(first[q] - ends + n[q], n[q])]  # each question's words that the range has
                got = np.round(np.add.reduceat(matrix[line[word[pairs]], np.repeat(doc, n[q])] * w[pairs], ends - n[q]), DIGITS)
                better.append(np.stack([got, doc, q])[:, got >= least[q]])
            if not better or not (better := np.concatenate(better, 1)).shape[1]:
                return
            ranges.append(at)
            q = better[2].astype(np.int64)
            cuts = np.flatnonzero(q[1:] != q[:-1]) + 1
            for a, b in zip([0, *cuts], [*cuts, len(q)]):
                mine = kept[q[a]]
                mine.append(np.stack([better[0, a:b], better[1, a:b] + width * (len(ranges) - 1)]))
                if sum(x.shape[1] for x in mine) >= k:
                    every = np.concatenate(mine, 1)
                    least[q[a]] = -np.partition(-every[0], k - 1)[k - 1]
                    kept[q[a]] = [every[:, every[0] >= least[q[a]]]]

        def scored(rows: pa.Table, last: bool) -> pa.Table:
            """Score all ranges of rows but the last, which may go on in the rows to come; return what is left."""
            if not rows.num_rows:
                return rows
            column = {c: rows[c].combine_chunks() for c in rows.column_names}
            column = {c: x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for c, x in column.items()}
            segment, number, place = column["segment"].dictionary_encode(), column["range"].to_numpy(), column["place"].to_numpy()
            code = segment.indices.to_numpy()
            most = column["top"].to_numpy() * np.maximum(1.0, avgdl / column["avgdl"].to_numpy())
            docs, tfs, dls = (column[c].flatten().to_numpy() for c in ("docs", "tfs", "dls"))
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(column["docs"]).to_numpy())])
            cuts = [0, *(np.flatnonzero((code[1:] != code[:-1]) | (number[1:] != number[:-1])) + 1), rows.num_rows]
            for a, b in zip(cuts[: None if last else -2], cuts[1:]):
                x, y = ends[a], ends[b]
                score((segment.dictionary[code[a]].as_py(), int(number[a])), place[a:b], np.repeat(np.arange(b - a), np.diff(ends[a : b + 1])), docs[x:y], tfs[x:y], dls[x:y], most[a:b])
            return rows.slice(rows.num_rows if last else cuts[-2])

        left = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            for r in rows.filter(pc.is_null(rows["term"])).select(["segment", "range", "docs"]).to_pylist():
                gone.setdefault((r["segment"], r["range"]), []).extend(r["docs"])
            rows = rows.append_column("place", pc.index_in(rows["term"], value_set=words)).drop_columns(["term"])
            rows = rows.filter(pc.is_valid(rows["place"]))
            left = scored(rows if left is None else pa.concat_tables([left, rows]), False)
        if left is not None:
            scored(left, True)
        for q, parts in enumerate(kept):
            if parts:
                mine = np.concatenate(parts, 1)
                at = mine[1].astype(np.int64)
                where = [ranges[i] for i in at >> RANGE_BITS]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(ids[q], len(at)), pa.array([s for s, _ in where]), pa.array(np.array([n * width for _, n in where], np.int64) + (at & (width - 1))), pa.array(mine[0])],
                    names=["query_id", "segment", "doc_no", "score"],
                )

    return run


def hash_of(term: str) -> int:
    """A term's hash for its bucket, the same in every process."""
    return zlib.crc32(term.encode())


class TermIndex:
    """A term index in a folder. Ids of chunks are unique among those that live; a chunk id that is deleted may come again."""

    def __init__(self, spark: SparkSession, path: str, stem: bool = True):
        self.spark, self.path, self.stem = spark, path.rstrip("/"), stem
        self.snapshots = Snapshots(spark, path)

    def _state(self) -> tuple[int, dict]:
        number, state = self.snapshots.latest()
        state = state or {"format": FORMAT, "stem": self.stem, "id_type": None, "buckets": None, "segments": {}, "deltas": [], "tombstones": [], "n_docs": 0, "tokens": 0, "floor": 0.0}
        if (state["format"], state["stem"]) != (FORMAT, self.stem):
            raise ValueError(f"{self.path} has format {state['format']} and stem {state['stem']}")
        return number, state

    def _read(self, kind: str, part: str, names: list[str], schema: str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], f"{schema}, {part} string")
        return self.spark.read.option("basePath", f"{self.path}/{kind}").schema(f"{schema}, {part} string").parquet(*[f"{self.path}/{kind}/{part}={n}" for n in names])

    def _docs(self, state: dict) -> DataFrame:
        docs = self._read("docs", "segment", list(state["segments"]), f"doc_no long, chunk_id {state['id_type'] or 'string'}, dl long, terms array<string>, tfs array<long>")
        return self._live(docs, state)

    def _live(self, rows: DataFrame, state: dict) -> DataFrame:
        if not state["tombstones"]:
            return rows
        gone = self._read("tombstones", "commit", state["tombstones"], "segment string, doc_no long").select("segment", "doc_no")
        return rows.join(gone, ["segment", "doc_no"], "left_anti")

    def _deltas(self, state: dict) -> DataFrame:
        """(term, df) of the state, summed over its signed deltas."""
        return self._read("deltas", "commit", state["deltas"], "term string, df long").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def _committed(self, number: int, state: dict) -> None:
        """Commit with the floor that words of most chunks get: a share of the mean over all words."""
        n = state["n_docs"]
        raw = F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        state["floor"] = self._deltas(state).agg((F.avg(raw) * EPSILON).alias("floor")).first()["floor"] or 0.0
        self.snapshots.commit(number, state)

    def live_ids(self) -> DataFrame:
        return self._docs(self._state()[1]).select("chunk_id")

    def totals(self) -> tuple[int, int]:
        """Chunks and tokens."""
        state = self._state()[1]
        return state["n_docs"], state["tokens"]

    def add(self, chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> int:
        """Chunks whose id the index lacks go into a new segment, each id once; how many there were. A null text has no words."""
        number, state = self._state()
        kind = dict(chunks.dtypes)[id_col]
        if state["id_type"] not in (None, kind):
            raise ValueError(f"ids are {kind}, those of the index {state['id_type']}")
        fresh = chunks.select(F.col(id_col).alias("chunk_id"), F.coalesce(text_col, F.lit("")).alias("text"))
        if state["segments"]:
            fresh = fresh.join(self._docs(state).select("chunk_id"), "chunk_id", "left_anti")
        if fresh.groupBy("chunk_id").count().where("count > 1").head(1):  # reads ids alone; texts are dealt by id only if some come twice
            fresh = fresh.dropDuplicates(["chunk_id"])
        fresh = spread(fresh)
        segment, kinds = uuid.uuid4().hex, f"chunk_id {kind}, dl long, terms array<string>, tfs array<long>"
        counted = fresh.select("chunk_id", raw_tokens(F.col("text")).alias("tokens")).mapInArrow(_counted(self.stem), kinds)
        # neighbours of like length: their largest weights say more
        numbered = counted.sortWithinPartitions("dl", "chunk_id").select(F.monotonically_increasing_id().alias("doc_no"), "*")
        numbered.write.parquet(f"{self.path}/docs/segment={segment}")
        state["id_type"] = kind
        docs = self._read("docs", "segment", [segment], f"doc_no long, {kinds}")
        n, tokens, postings = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
        if n == 0:
            return 0
        state["buckets"] = state["buckets"] or max(BUCKETS[0], min(BUCKETS[1], postings // BUCKET_POSTINGS))
        self._write_postings(docs, segment, tokens / n if tokens else 1.0, postings, state["buckets"])
        return self._with_segment(number, state, segment, n, tokens)

    def _write_postings(self, docs: DataFrame, segment: str, avgdl: float, postings: int, buckets: int) -> None:
        blocks = docs.select("doc_no", "dl", "terms", "tfs").mapInArrow(_blocks(avgdl, buckets), "bucket int, term string, range long, docs array<long>, tfs array<long>, dls array<long>, top double")
        blocks = blocks.withColumn("avgdl", F.lit(avgdl))
        salts = max(1, postings // buckets // BUCKET_POSTINGS + 1)  # a bucket with more than planned is several files
        dealt = blocks.repartition(buckets * salts, "bucket", F.pmod("range", F.lit(salts))).sortWithinPartitions("bucket", "term", "range")
        dealt.write.partitionBy("bucket").parquet(f"{self.path}/postings/segment={segment}")
        rows = self._read("postings", "segment", [segment], "term string, docs array<long>, bucket int")
        rows.groupBy("term").agg(F.sum(F.size("docs")).alias("df")).sortWithinPartitions("term").write.parquet(f"{self.path}/deltas/commit={segment}")

    def _with_segment(self, number: int, state: dict, segment: str, n: int, tokens: int) -> int:
        state["segments"][segment] = n
        state["deltas"].append(segment)
        state["n_docs"], state["tokens"] = state["n_docs"] + n, state["tokens"] + tokens
        self._committed(number, state)
        return n

    def remove(self, ids: DataFrame) -> int:
        """Chunks with these ids (column chunk_id) leave the index; how many there were."""
        number, state = self._state()
        gone = written(self._docs(state).join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi"), "removed")
        n, tokens = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        if n == 0:
            return 0
        commit = uuid.uuid4().hex
        gone.select("segment", "doc_no").write.parquet(f"{self.path}/tombstones/commit={commit}")
        less = gone.select(F.explode("terms").alias("term")).groupBy("term").agg((-F.count(F.lit(1))).alias("df"))
        less.sortWithinPartitions("term").write.parquet(f"{self.path}/deltas/commit={commit}")
        state["tombstones"].append(commit)
        state["deltas"].append(commit)
        state["n_docs"], state["tokens"] = state["n_docs"] - n, state["tokens"] - tokens
        self._committed(number, state)
        return n

    def compact(self) -> None:
        """All live chunks in one segment, without tombstones; what it takes the place of stays until expire()."""
        number, state = self._state()
        if len(state["deltas"]) < 2:
            return
        segment = uuid.uuid4().hex
        live = self._docs(state).select("chunk_id", "dl", "terms", "tfs").sortWithinPartitions("dl", "chunk_id").select(F.monotonically_increasing_id().alias("doc_no"), "*")
        live.write.parquet(f"{self.path}/docs/segment={segment}")
        docs = self._read("docs", "segment", [segment], f"doc_no long, chunk_id {state['id_type']}, dl long, terms array<string>, tfs array<long>")
        n, tokens, postings = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
        new = {**state, "segments": {}, "deltas": [], "tombstones": [], "n_docs": 0, "tokens": 0}
        if n:
            self._write_postings(docs, segment, tokens / n if tokens else 1.0, postings, state["buckets"])
            self._with_segment(number, new, segment, n, tokens)
        else:
            self._committed(number, new)

    def expire(self, keep: int = 1) -> list[str]:
        """Drop all but the last states and what only they use."""
        def folders(state: dict) -> list[str]:
            return [f"{kind}/{part}={n}" for kind, part, names in (("docs", "segment", state["segments"]), ("postings", "segment", state["segments"]), ("deltas", "commit", state["deltas"]), ("tombstones", "commit", state["tombstones"])) for n in names]

        return self.snapshots.expire(keep, folders)

    def idf(self) -> DataFrame:
        """(term, df, idf): words of more than half of the chunks get the floor."""
        return self._idf(self._state()[1])

    def _idf(self, state: dict) -> DataFrame:
        raw = F.log(F.lit(float(state["n_docs"])) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        return self._deltas(state).select("term", "df", F.when(raw < 0, F.lit(state["floor"])).otherwise(raw).alias("idf"))

    def _weighted(self, queries: DataFrame, state: dict) -> DataFrame:
        """(query_id, term, w) of the questions' words that the index has."""
        term = light_stem(F.col("raw")) if self.stem else F.col("raw")
        asked = queries.select("query_id", F.explode(raw_tokens(F.col("query_text"))).alias("raw")).groupBy("query_id", term.alias("term")).agg(F.count(F.lit(1)).alias("qtf"))
        return written(asked.join(self._idf(state), "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w")), "weighted")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """queries: query_id, query_text -> query_id, chunk_id, score, rank. Candidates share a word with the question; a score may be zero or negative.

        Questions go in blocks of about QUESTIONS: a block's weights go with the tasks, and the postings of its words are dealt by range. A task
        keeps the k best of each question (with all ties of the k-th) and leaves out the ranges that can't reach them.
        """
        _, state = self._state()
        weighted = self._weighted(queries, state)
        blocks = max(1, -(-queries.count() // QUESTIONS))
        kinds = dict(weighted.dtypes)["query_id"], state["id_type"] or "string"
        found = []
        for b in range(blocks):
            rows = weighted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
            if rows.num_rows and k > 0:
                found.append(self._ranges(state, rows["term"].unique().to_pylist()).mapInArrow(_best(rows, k, state["tokens"] / state["n_docs"]), f"query_id {kinds[0]}, segment string, doc_no long, score double"))
        if not found:
            return top_k(self.spark.createDataFrame([], f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double"), max(k, 1), F.desc("score"), F.asc("chunk_id"))
        every = reduce(DataFrame.unionByName, found)
        tied = every.withColumn("tied", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("tied") <= k)
        docs = self._read("docs", "segment", list(state["segments"]), f"doc_no long, chunk_id {kinds[1]}")
        return top_k(tied.join(docs, ["segment", "doc_no"]).select("query_id", "chunk_id", "score"), k, F.desc("score"), F.asc("chunk_id"))

    def _ranges(self, state: dict, terms: list[str]) -> DataFrame:
        """Postings of these words, a range's rows together, and before them the range's deleted rows (a null term)."""
        columns = "segment", "range", "term", "docs", "tfs", "dls", "top", "avgdl"
        rows = self._read("postings", "segment", list(state["segments"]), "term string, range long, docs array<long>, tfs array<long>, dls array<long>, top double, avgdl double, bucket int")
        # folders and row groups without any of the words aren't read
        rows = rows.where(F.col("bucket").isin(sorted({hash_of(t) % state["buckets"] for t in terms})))
        if len(terms) <= PUSHED_TERMS:
            rows = rows.where(F.expr(f"term IN ({', '.join(map(repr, terms))})"))  # words have letters and digits alone
        rows = rows.select(*columns)
        if state["tombstones"]:
            gone = self._read("tombstones", "commit", state["tombstones"], "segment string, doc_no long").groupBy("segment", F.shiftright("doc_no", RANGE_BITS).alias("range")).agg(F.collect_list("doc_no").alias("docs"))
            rows = rows.unionByName(gone, allowMissingColumns=True)
        return rows.repartition("segment", "range").sortWithinPartitions("segment", "range", F.asc_nulls_first("term"))
