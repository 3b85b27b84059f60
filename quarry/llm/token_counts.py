"""Token counts by source, language and tokenizer version, kept as delta-maintained rollups.

A change is a signed row: an insert adds a document's count, a delete takes it away, a revision does
both. A batch of changes is summed per key (partial sums before the shuffle, so a hot source is no hot
task) and committed as one folder; a batch id that is committed already is left alone, so a replay
changes nothing. Totals are the sum of the committed deltas; compaction folds them into one snapshot.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Commits, fresh_path, shuffles_dropped, spread, written
from quarry.llm.word_ids import encode_texts, encoder

KEYS = ["source", "lang", "tokenizer_version"]
SUMS = ["n_docs", "n_tokens"]
DELTA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"

#: Tokenizer versions that are rules (fixed): words are runs without blanks; parts are runs of letters and digits, or single other signs.
VERSIONS = {
    "words-1": lambda text: F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))),
    "parts-1": lambda text: F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]"), F.lit(0))),
}


def changes(rows: DataFrame, sign: int | Column = 1, tokens: str = "n_tokens") -> DataFrame:
    """Signed changes from rows with KEYS and a count column."""
    sign = F.lit(sign) if isinstance(sign, int) else sign
    return rows.select(*KEYS, sign.cast("long").alias("n_docs"), (sign * F.coalesce(F.col(tokens), F.lit(0))).cast("long").alias("n_tokens"))


def revisions(rows: DataFrame, before: str, after: str) -> DataFrame:
    """A revised count: the old one out, the new one in; the document count stays."""
    return rows.select(*KEYS, F.lit(0).cast("long").alias("n_docs"), (F.coalesce(F.col(after), F.lit(0)) - F.coalesce(F.col(before), F.lit(0))).cast("long").alias("n_tokens"))


class TokenRollup:
    """Committed deltas under one folder; a batch counts once its marker is there, and never twice."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or fresh_path(spark, "token-rollup")
        self.commits = Commits(spark, self.path)

    def commit(self, batch_id: str, delta: DataFrame) -> bool:
        """Add a batch of signed changes. False if that batch is committed already; an error if it was with other changes."""
        summed = delta.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).where("n_docs <> 0 OR n_tokens <> 0")
        known = self.commits.all()
        folder = self.commits.new_folder()
        if batch_id not in known:
            with shuffles_dropped(self.spark):
                summed.write.parquet(folder)
            summed = self.spark.read.schema(DELTA).parquet(folder)
        rows = summed.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*KEYS, *SUMS).cast("decimal(38,0)"))).first()
        digest = f"{rows[0]}:{rows[1]}"
        if batch_id in known:
            if known[batch_id][1] != digest:
                raise ValueError(f"batch {batch_id!r} is committed with other changes")
            return False
        return self.commits.add(batch_id, folder, digest)

    def deltas(self) -> DataFrame:
        return self.commits.read(DELTA)

    def totals(self) -> DataFrame:
        """KEYS and SUMS of all keys that still have documents or tokens."""
        return self._sums(self.deltas())

    @staticmethod
    def _sums(deltas: DataFrame) -> DataFrame:
        return deltas.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).where("n_docs <> 0 OR n_tokens <> 0")

    def compacted(self, path: str) -> TokenRollup:
        """A new rollup whose data are this one's totals; it knows this one's batches, so their replays change nothing there either.

        The batches are listed once, and totals and batches come in one commit: a batch that is committed meanwhile is in neither.
        """
        known, out = self.commits.all(), TokenRollup(self.spark, path)
        out.commits.take_over(known, self._sums(self.commits.read(DELTA, known)))
        return out


def _tokens(paths: list[str]):
    """Rows whose last column is a text -> the same with the text's number of tokens by each word-end BPE file in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, text = batch.columns
            # an encoded text has its end id besides
            counts = [pa.array([len(ids) - 1 for ids in encode_texts(encoder(p), text)], pa.int64()) for p in paths]
            yield pa.RecordBatch.from_arrays([*columns, *counts], names=[*batch.schema.names[:-1], *[f"t{i}" for i in range(len(paths))]])

    return run


def counted(docs: DataFrame, tokenizers: dict[str, str] | None = None) -> DataFrame:
    """A row per document and tokenizer version: doc_id, source, lang, blob, guess, tokenizer_version, n_tokens.

    Versions are the rules in VERSIONS and tokenizers, which are files of word-end BPE models by the version's name. A text is read and counted once for all.
    """
    tokenizers = tokenizers or {}
    text = F.coalesce(F.col("text"), F.lit(""))
    wide = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        F.sha2(text, 256).alias("blob"), F.ceil(F.length(text) / 6).alias("guess"), *[rule(text).cast("long").alias(f"v{i}") for i, rule in enumerate(VERSIONS.values())], text.alias("text"),
    )
    if tokenizers:
        kinds = [f"{n} {t}" for n, t in wide.dtypes[:-1]] + [f"t{i} long" for i in range(len(tokenizers))]
        wide = spread(wide).mapInArrow(_tokens(list(tokenizers.values())), ", ".join(kinds))
    slim = written(wide.drop("text"), "token-counts")
    names = {v: f"v{i}" for i, v in enumerate(VERSIONS)} | {v: f"t{i}" for i, v in enumerate(tokenizers)}
    version = F.explode(F.array(*[F.struct(F.lit(v).alias("tokenizer_version"), F.col(c).alias("n_tokens")) for v, c in names.items()])).alias("v")
    return slim.select("doc_id", "source", "lang", "blob", "guess", version).select("doc_id", "source", "lang", "blob", "guess", "v.*")


def maintain(docs: DataFrame, rollup: TokenRollup | None = None, tokenizers: dict[str, str] | None = None) -> DataFrame:
    """Totals of the corpus without exact copies, reached by three batches over the whole table.

    "load" inserts every document with a guessed count (characters / 6), "count" revises every guess to
    the exact count, "copies" deletes each document whose text a smaller doc_id has. Each batch is
    delivered twice; the replay must change nothing. tokenizers: see counted(). Returns source, lang, tokenizer_version, n_docs, n_tokens.

    Nulls: a null text is empty, a null source or lang is a key of its own, a null doc_id sorts last
    among copies. Repeated rows are copies. A very long text is encoded whole, word by word. An empty table gives no totals; other columns are ignored.
    """
    rollup = rollup or TokenRollup(docs.sparkSession)
    rows = counted(docs, tokenizers)
    # a copy's first row: the text's smallest (doc_id, source, lang); all others go
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "source", "lang")
    one = rows.where(F.col("tokenizer_version") == next(iter(VERSIONS)))
    firsts = one.groupBy("blob").agg(F.min(order).alias("first")).select(F.col("first.source").alias("source"), F.col("first.lang").alias("lang"), "blob")
    versions = rows.groupBy("blob", "tokenizer_version").agg(F.max("n_tokens").alias("n_tokens"))
    kept = firsts.join(versions, "blob")
    # deletes of all documents but the firsts: everything out, the firsts in again
    copies = reduce(DataFrame.unionByName, [changes(rows, -1), changes(kept, 1)])
    for batch, delta in (("load", changes(rows, 1, "guess")), ("count", revisions(rows, "guess", "n_tokens")), ("copies", copies)):
        rollup.commit(batch, delta)
        rollup.commit(batch, delta)
    return rollup.totals()


#: SQL for the rules; tests compare the counts of tokenizers with their library's.
_SQL_VERSION = {
    "words-1": r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))",
    "parts-1": r"len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]'))",
}
SQL = " UNION ALL ".join(
    f"""SELECT source, lang, '{v}' AS tokenizer_version, count(*) AS n_docs, sum({count})::BIGINT AS n_tokens
FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id NULLS LAST, source NULLS FIRST, lang NULLS FIRST) AS copy FROM documents)
WHERE copy = 1 GROUP BY source, lang"""
    for v, count in _SQL_VERSION.items()
)
