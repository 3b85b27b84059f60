"""Ingest bookkeeping: manifest currency, incremental adds, listings, duplicates, safe file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import strip

MIN_TEXT_CHARS = 100
# Device names that are no file names.
RESERVED = ["con", "prn", "aux", "nul", *[f"{d}{i}" for d in ("com", "lpt") for i in range(1, 10)]]


def text_layer(pages: DataFrame) -> DataFrame:
    """Per file: pages, stripped characters, and whether there is enough text to index."""
    chars = F.sum(F.length(strip(F.coalesce("text", F.lit("")))))
    out = pages.groupBy("file_name").agg(F.count(F.lit(1)).alias("page_count"), chars.alias("total_chars"))
    return out.withColumn("status", F.when(F.col("total_chars") >= MIN_TEXT_CHARS, "ok").otherwise("no_text_layer"))


def new_chunks(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Chunks whose id the index lacks, each id once."""
    return chunks.dropDuplicates(["chunk_id"]).join(index.select("chunk_id"), "chunk_id", "left_anti")


def without_file(index: DataFrame, file_name: str) -> DataFrame:
    return index.where(F.col("file_name") != file_name)


def currency(files: DataFrame, manifest: DataFrame, index: DataFrame, model_id: str) -> DataFrame:
    """files (file_name, content_hash) with is_current: known, same hash and model, ok, and every chunk indexed."""
    ids = manifest.select("file_name", F.explode("chunk_ids").alias("chunk_id"))
    lost = ids.join(index.select("chunk_id").distinct(), "chunk_id", "left_anti").select("file_name").distinct().withColumn("lost", F.lit(True))
    known = manifest.select("file_name", F.col("content_hash").alias("known_hash"), "status", "embedder_model_id", F.size("chunk_ids").alias("n_ids"))
    out = files.join(known, "file_name", "left").join(lost, "file_name", "left")
    ok = (F.col("known_hash") == F.col("content_hash")) & (F.col("status") == "ok") & (F.col("embedder_model_id") == model_id) & (F.col("n_ids") > 0) & F.col("lost").isNull()
    return out.select("file_name", "content_hash", F.coalesce(ok, F.lit(False)).alias("is_current"))


def listing(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Visible files on disk with what the manifest knows; unknown ones are skipped so far."""
    out = files.where(~F.startswith("file_name", F.lit("."))).join(manifest.select("file_name", "status", "chunk_count"), "file_name", "left")
    status, count = F.coalesce("status", F.lit("skipped")), F.coalesce("chunk_count", F.lit(0)).cast("long")
    return out.select(*files.columns, status.alias("status"), count.alias("chunk_count"), ((status == "ok") & (count > 0)).alias("is_searchable"), (status == "no_text_layer").alias("needs_ocr"))


def with_report(files: DataFrame, report: DataFrame) -> DataFrame:
    """Files in the order of their names with their status in an ingest report, null for those it lacks."""
    return files.join(report.select("file_name", F.col("status").alias("reported")), "file_name", "left").orderBy("file_name")


def ingest_plan(files: DataFrame, layers: DataFrame, current: DataFrame, manifest: DataFrame) -> DataFrame:
    """What to do with each file: file_name, status, replaced.

    files: file_name, error (null if it could be read); layers: text_layer's rows; current: currency's rows. Current
    files are skipped, unreadable ones failed, and those without a text layer are tried again by the next run. Only
    files that go in (status ok) take the place of rows that the manifest knows.
    """
    known = manifest.select("file_name", F.lit(True).alias("known")).distinct()
    rows = files.join(current.select("file_name", "is_current"), "file_name", "left").join(layers.select("file_name", F.col("status").alias("layer")), "file_name", "left").join(known, "file_name", "left")
    status = F.when(F.col("is_current"), "skipped").when(F.col("error").isNotNull(), "failed").when(F.col("layer") == "ok", "ok").otherwise("no_text_layer")
    return rows.select("file_name", status.alias("status"), ((status == "ok") & F.coalesce("known", F.lit(False))).alias("replaced"))


def ingested(index: DataFrame, plan: DataFrame, chunks: DataFrame) -> DataFrame:
    """The index after a run: rows of replaced files go, chunks of the files that go in come, each id once."""
    kept = index.join(plan.where("replaced").select("file_name"), "file_name", "left_anti")
    fresh = chunks.join(plan.where("status = 'ok'").select("file_name"), "file_name", "left_semi")
    return kept.unionByName(new_chunks(fresh, kept))


def duplicates(files: DataFrame, order: str) -> DataFrame:
    """files (file_name, content_hash, order) -> first file with the same content under another name."""
    firsts = files.groupBy("content_hash").agg(F.min_by("file_name", order).alias("duplicate_of"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    # a hash that very many files share is dealt over several tasks
    salt = F.array(*[F.lit(i) for i in range(16)])
    dealt = files.withColumn("join_salt", F.pmod(F.xxhash64("file_name"), F.lit(16)).cast("int"))
    found = dealt.join(firsts.withColumn("join_salt", F.explode(salt)), ["content_hash", "join_salt"]).where(F.col("duplicate_of") != F.col("file_name"))
    return found.select(*files.columns, "duplicate_of")


def safe_name(raw: Column, max_length: int = 200) -> Column:
    """The last path part if it is a safe file name, else null. Input in NFC."""
    name = strip(raw)
    base = F.regexp_extract(F.translate(name, "\\", "/"), "[^/]*$", 0)
    stem = F.lower(F.regexp_replace(base, r"\.[^.]*$", ""))
    bad = (
        (name == "") | F.rlike(name, F.lit(r"[\x00-\x1f\x7f-\x9f​-‏ -‮]")) | (base == "") | F.startswith(base, F.lit("."))
        | (F.length(base) > max_length) | stem.isin(RESERVED) | ~F.rlike(base, F.lit(r"(?U)^[\w\s.,()\[\]+&#@!'çğıöşüÇĞİÖŞÜ-]+$"))
    )
    return F.when(~bad, base)


def has_extension(name: Column, allowed: list[str]) -> Column:
    return F.lower(F.regexp_extract(name, r"\.[^.]+$", 0)).isin(allowed)
