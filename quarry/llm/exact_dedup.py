"""Exact dedup by content sort, with DataFrame functions only.

Rows are range-partitioned by their normalised text with splitters that Spark samples, each partition
is sorted externally, equal texts become neighbours and are compared in full by the window over the
whole text. The range key is a bounded prefix of the text (its lead), so the sample stays small on the
driver. Two salts part what would be too much for one range: a lead that more than a range's share of rows have is dealt
by a hash of the whole text, so that equal texts still meet; a text that so many rows have is dealt by doc_id, and the heads
of its runs, one a salt, are compared in full again. All other texts are one run each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import row_key, shuffle_partitions, with_text_key, written

#: A lead or text is hot if it has more than 1 / (HOT_SHARE * ranges) of the rows, and more than HOT_ROWS, which fit any range; so there are at most HOT_SHARE * ranges of each, which are broadcast.
HOT_SHARE, HOT_ROWS = 4, 256
PREFIX_CHARS = 48


def content_runs(docs: DataFrame, normalise=lambda c: c, keep: str = "max", ranges: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows of docs in runs of equal texts: doc_id, text_sha256, hot, run (a number), at (place in the run), run_best, run_size, head (the text, for the first row of a hot text's run)."""
    best = F.max if keep == "max" else F.min
    parts = HOT_SHARE * (ranges or max(32, shuffle_partitions(docs.sparkSession)))
    text: Column = F.coalesce(normalise(F.coalesce(F.col("text"), F.lit(""))), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("body")).select("doc_id", "body", F.substring("body", 1, PREFIX_CHARS).alias("lead_chars"), F.xxhash64("body").alias("hash"))
    # the hash steers salts alone; that two texts share one does no harm
    counts = written(rows.groupBy("lead_chars", "hash").agg(F.count(F.lit(1)).alias("n")), "exact-dedup-counts")
    most = F.lit(max(hot_rows, (counts.agg(F.sum("n")).first()[0] or 0) / parts))
    leads = counts.groupBy("lead_chars").agg(F.sum("n").alias("n")).where(F.col("n") > most).select("lead_chars", F.ceil(F.col("n") / most).cast("int").alias("lead_salts"))
    texts = counts.where(F.col("n") > most).select("lead_chars", "hash", F.ceil(F.col("n") / most).cast("int").alias("text_salts"))
    rows = rows.join(F.broadcast(leads), "lead_chars", "left").join(F.broadcast(texts), ["lead_chars", "hash"], "left")
    dealt = lambda by, salts: F.coalesce(F.pmod(by, F.col(salts)).cast("int"), F.lit(0))
    rows = rows.select("doc_id", "body", "lead_chars", dealt(F.col("hash"), "lead_salts").alias("salt"), dealt(F.xxhash64("doc_id"), "text_salts").alias("copy_salt"), F.col("text_salts").isNotNull().alias("hot"))
    run = Window.partitionBy("lead_chars", "salt", "copy_salt", "body")
    first = run.orderBy(F.col("doc_id").desc_nulls_last() if keep == "max" else F.col("doc_id").asc_nulls_last())
    ranged = rows.repartitionByRange("lead_chars", "salt", "copy_salt").withColumn("place", F.monotonically_increasing_id())
    found = ranged.select(
        "doc_id", "hot", F.sha2("body", 256).alias("text_sha256"), "body", F.row_number().over(first).alias("at"), F.min("place").over(run).alias("run"),
        best("doc_id").over(run).alias("run_best"), F.count(F.lit(1)).over(run).alias("run_size"),
    )
    return written(found.withColumn("head", F.when(F.col("hot") & (F.col("at") == 1), F.col("body"))).drop("body"), "exact-dedup")


def exact_dedup(docs: DataFrame, normalise=lambda c: c, keep: str = "max", ranges: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per document row: doc_id, keep_id, group_size, kept, text_sha256.

    Nulls: a null text is an empty text; a null doc_id loses to any other and is kept only in a group that
    has no other. Empty texts form one group. Repeated rows (same id and text) count each in group_size,
    and just one of them is kept. keep: "max" or "min" doc_id stays. Very long texts are compared whole. An empty table gives an empty result;
    columns other than doc_id and text are ignored, whatever their names.
    """
    if keep not in ("max", "min"):
        raise ValueError(f"keep must be max or min, not {keep!r}")
    best = F.max if keep == "max" else F.min
    runs = content_runs(docs, normalise, keep, ranges, hot_rows)
    group = Window.partitionBy("head")  # a row for each salt of a hot text
    order = F.col("run_best").desc_nulls_last() if keep == "max" else F.col("run_best").asc_nulls_last()
    heads = runs.where("head IS NOT NULL").select(
        "run", best("run_best").over(group).alias("best"), F.sum("run_size").over(group).alias("size"), F.row_number().over(group.orderBy(order, "run")).alias("head_rank")
    )
    return runs.join(heads, "run", "left").select(
        "doc_id",
        F.when(F.col("hot"), F.col("best")).otherwise(F.col("run_best")).alias("keep_id"),
        F.when(F.col("hot"), F.col("size")).otherwise(F.col("run_size")).alias("group_size"),
        ((F.col("at") == 1) & F.coalesce(F.col("head_rank") == 1, F.lit(True))).alias("kept"),
        "text_sha256",
    )


def keep_unique(docs: DataFrame, keep: str = "max") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns (repeated rows collapse to one)."""
    kept = exact_dedup(docs, keep=keep).where("kept").select(row_key().alias("rid"), F.col("text_sha256").alias("sha"))
    return with_text_key(docs).join(kept, ["rid", "sha"], "left_semi").dropDuplicates(["rid", "sha"]).select("row.*")


SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
