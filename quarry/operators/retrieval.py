"""Top-k retrieval over whole batches of queries: BM25, dense vectors, rank fusion, reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import light_stem, raw_tokens

K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60
#: Scores are rounded before they are ranked, so that the order of float sums can't decide a rank.
DIGITS = 6


def top_k(scored: DataFrame, k: int, *order: Column, by: str = "query_id") -> DataFrame:
    """Dense 1-based rank per query; the limit is pushed below the shuffle as a window group limit."""
    if k <= 0:
        return scored.withColumn("rank", F.lit(0).cast("long")).limit(0)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: a table that comes in fewer splits than there are cores (a small one) is dealt out, any other stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class Bm25Index:
    """Postings with their chunks' lengths, and idf, as DataFrames. Chunk ids are unique.

    A text is tokenized once. Raw tokens are counted per chunk before they are stemmed, and only the distinct
    vocabulary is stemmed, so the suffix patterns run once a word and not once an occurrence. The index stays
    cached until release(); lineage rebuilds lost blocks.
    """

    def __init__(self, chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", stem: bool = True):
        tokens = spread(chunks.select(F.col(id_col).alias("chunk_id"), F.col(text_col).alias("text"))).select("chunk_id", raw_tokens(F.col("text")).alias("tokens"))
        # a chunk's tokens are counted where they are; what is dealt by word is one row a chunk and word
        raw = tokens.select("chunk_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("raw")).groupBy("raw", "chunk_id").agg(F.count(F.lit(1)).alias("n"), F.first("dl").alias("dl"))
        self.stem, self._cached = stem, []
        if stem:
            raw = raw.persist()
            self._cached.append(raw)
            words = raw.select("raw").distinct().withColumn("term", light_stem(F.col("raw")))
            postings = raw.join(words, "raw").groupBy("term", "chunk_id").agg(F.sum("n").alias("tf"), F.first("dl").alias("dl"))
        else:
            postings = raw.select(F.col("raw").alias("term"), "chunk_id", F.col("n").alias("tf"), "dl")
        self.postings = postings.persist()
        self._cached.append(self.postings)
        n_chunks = chunks.agg(F.count(F.lit(1)).alias("n_docs"))
        self.stats = n_chunks.crossJoin(self.postings.agg(F.sum("tf").alias("tokens"))).select("n_docs", (F.col("tokens") / F.col("n_docs")).alias("avgdl"))  # one row each
        df = self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        raw_idf = df.crossJoin(self.stats.select("n_docs")).withColumn("raw_idf", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        floor = raw_idf.agg((F.avg("raw_idf") * EPSILON).alias("floor"))  # one row
        self.idf = raw_idf.crossJoin(floor).select("term", "df", F.when(F.col("raw_idf") < 0, F.col("floor")).otherwise(F.col("raw_idf")).alias("idf"))

    def release(self) -> None:
        for df in self._cached:
            df.unpersist()

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """queries: query_id, query_text. Candidates share a term with the query; a score may be zero or negative."""
        terms = queries.select("query_id", F.explode(raw_tokens(F.col("query_text"))).alias("term"))
        if self.stem:
            terms = terms.withColumn("term", light_stem(F.col("term")))
        terms = terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")).join(self.idf, "term").crossJoin(F.broadcast(self.stats))
        part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        scored = terms.join(self.postings, "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), DIGITS).alias("score"))
        return top_k(scored, k, F.desc("score"), F.asc("chunk_id"))


def dense_search(queries: DataFrame, vectors: DataFrame, k: int, query_block: int = 4096) -> DataFrame:
    """Exact inner products of query vectors (query_id, query_vec) with all vectors (chunk_id, embedding).

    The stated queries meet all rows in blocks of about query_block: a block goes with the tasks as one matrix, each
    Arrow batch of vectors is one matrix product, and only the k best of a batch for each query leave it. Rows
    with a null vector are no candidates.
    """
    blocks = max(1, -(-queries.count() // query_block))
    lane = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    kind = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["chunk_id"]

    def best_of(ids: list, matrix: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                found = np.round(matrix @ flat.reshape(batch.num_rows, -1).T, DIGITS)
                at = np.argpartition(-found, k - 1, axis=1)[:, : k] if k < batch.num_rows else np.broadcast_to(np.arange(batch.num_rows), found.shape)
                if k < batch.num_rows:  # ties of the k-th all leave the batch
                    row, col = np.nonzero(found >= np.take_along_axis(found, at, 1).min(axis=1)[:, None])
                else:
                    row, col = (x.ravel() for x in np.indices(found.shape))
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in row]), batch.column(0).take(pa.array(col)), pa.array(found[row, col])], names=["query_id", "chunk_id", "score"])

        return run

    rows = spread(vectors.where("embedding IS NOT NULL").select("chunk_id", "embedding"))
    parts = []
    for b in range(blocks):
        block = queries.where((lane == b) & F.col("query_vec").isNotNull()).select("query_id", "query_vec").collect()  # about query_block rows
        if block:
            run = best_of([r["query_id"] for r in block], np.array([r["query_vec"] for r in block], np.float64))
            parts.append(rows.mapInArrow(run, f"query_id {kind[0]}, chunk_id {kind[1]}, score double"))
    if not parts:
        return top_k(queries.sparkSession.createDataFrame([], f"query_id {kind[0]}, chunk_id {kind[1]}, score double"), k, F.desc("score"), F.asc("chunk_id"))
    return top_k(reduce(DataFrame.unionByName, parts), k, F.desc("score"), F.asc("chunk_id"))


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = RRF_K, limit: int | None = None) -> DataFrame:
    """Ranked lists (query_id, chunk_id, rank) fused by position; ties go to the list, then the place, of first appearance."""
    every = reduce(DataFrame.unionByName, [x.select("query_id", "chunk_id", F.lit(i).alias("list_at"), F.col("rank").alias("pos")) for i, x in enumerate(lists)])
    fused = every.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(1 / (k + F.col("pos"))), 9).alias("score"), F.count(F.lit(1)).alias("retriever_hits"), F.min(F.struct("list_at", "pos")).alias("seen")
    )
    ranked = top_k(fused, limit if limit is not None else 2**31 - 1, F.desc("score"), F.asc("seen.list_at"), F.asc("seen.pos"))
    return ranked.select("query_id", "chunk_id", "score", "rank", "retriever_hits")


def rerank(candidates: DataFrame, score: Callable[[], Column] | Column, k: int, min_score: float | None = None) -> DataFrame:
    """Candidates anew by a scorer; ties keep the former order, scores under min_score go before the cut to k."""
    out = candidates.withColumn("score", score() if callable(score) else score).withColumnRenamed("rank", "former")
    if min_score is not None:
        out = out.where(F.col("score") >= min_score)
    return top_k(out, k, F.desc("score"), F.asc("former")).drop("former")


def hybrid(retrievers: list[Callable[[DataFrame, int], DataFrame]], queries: DataFrame, k: int, fetch_k: int = 20, rrf_k: int = RRF_K, reranker: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Each list to fetch_k, fused; then the first k, or the reranker's k of the first fetch_k. Itself usable as a retriever."""
    if not retrievers:
        raise ValueError("at least one retriever")
    if fetch_k < k:
        raise ValueError("fetch_k must not be under k")
    lists = [r(queries, fetch_k) for r in retrievers]
    if reranker is None:
        return reciprocal_rank_fusion(lists, rrf_k, k)
    return reranker(reciprocal_rank_fusion(lists, rrf_k, fetch_k), k)


def parent_passages(hits: DataFrame, sections: DataFrame) -> DataFrame:
    """Hits (query_id, rank, file_name, page, first_word, end_word) as passages: the sections that they touch, neighbours merged.

    sections: file_name, page, number, first_word, end_word; a page's numbers run without gaps. Returns query_id, file_name, page, first_word,
    end_word, n_hits and rank, by the best hit of a passage. A hit that touches two sections counts once.
    """
    s = sections.select("file_name", "page", "number", F.col("first_word").alias("from"), F.col("end_word").alias("to"))
    touched = hits.select("query_id", "file_name", "page", F.col("rank").alias("hit"), "first_word", "end_word").join(s, ["file_name", "page"]).where((F.col("first_word") < F.col("to")) & (F.col("from") < F.col("end_word")))
    one = touched.groupBy("query_id", "file_name", "page", "number", "from", "to").agg(F.collect_set("hit").alias("hits"))
    place = F.row_number().over(Window.partitionBy("query_id", "file_name", "page").orderBy("number"))
    merged = one.withColumn("island", F.col("number") - place).groupBy("query_id", "file_name", "page", "island").agg(
        F.min("from").alias("first_word"), F.max("to").alias("end_word"), F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits")
    )
    best = merged.select("query_id", "file_name", "page", "first_word", "end_word", F.size("hits").cast("long").alias("n_hits"), F.array_min("hits").alias("best"))
    return top_k(best, 2**31 - 1, F.asc("best"), F.asc("file_name"), F.asc("page"), F.asc("first_word")).drop("best")
