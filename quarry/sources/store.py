"""Versioned index folders: a version is written whole, then a snapshot names it; loads check compatibility."""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.snapshots import Snapshots

FORMAT = 1


class IndexCompatibilityError(RuntimeError):
    """The stored index doesn't fit the format, dimension or model asked for."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder in order; none if it is absent."""
    fs, p = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def save_index(chunks: DataFrame, path: str, model_id: str, dimension: int) -> str:
    """Write chunks (with embedding) as a new version; readers see it once a snapshot names it. A writer that another one overtakes gets a Conflict."""
    spark, states = chunks.sparkSession, Snapshots(chunks.sparkSession, path)
    number, _ = states.latest()
    version = uuid.uuid4().hex
    chunks.write.parquet(f"{path}/{version}/chunks")
    count = spark.read.parquet(f"{path}/{version}/chunks").count()
    states.commit(number, {"format": FORMAT, "model_id": model_id, "dimension": dimension, "count": count, "version": version})
    return version


def load_index(spark: SparkSession, path: str, model_id: str, dimension: int) -> DataFrame:
    number, meta = Snapshots(spark, path).latest()
    if number < 0:
        raise IndexCompatibilityError(f"{path} holds no index")
    for name, want in (("format", FORMAT), ("model_id", model_id), ("dimension", dimension)):
        if meta[name] != want:
            raise IndexCompatibilityError(f"{name} is {meta[name]!r}, not {want!r}")
    chunks = spark.read.parquet(f"{path}/{meta['version']}/chunks")
    if chunks.count() != meta["count"]:
        raise IndexCompatibilityError("row count differs from the one stored")
    return chunks


def expire_index(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Drop all but the last versions."""
    return Snapshots(spark, path).expire(keep, lambda meta: [meta["version"]])


MANIFEST = "file_name string, content_hash string, status string, page_count long, chunk_count long, chunk_ids array<string>, embedder_model_id string, processed_at timestamp, error string"


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest that is absent, broken or of another format is an empty one."""
    empty = spark.createDataFrame([], MANIFEST)
    if not _folders(spark, path):
        return empty
    rows = spark.read.schema(MANIFEST + ", format int, broken string").option("columnNameOfCorruptRecord", "broken").json(path)
    wrong = F.col("broken").isNotNull() | F.coalesce(F.col("format") != FORMAT, F.lit(True))
    return empty if rows.where(wrong).head(1) else rows.drop("format", "broken")


def upsert_manifest(manifest: DataFrame, changed: DataFrame, path: str) -> None:
    keep = manifest.join(changed.select("file_name"), "file_name", "left_anti")
    keep.unionByName(changed).withColumn("format", F.lit(FORMAT)).write.mode("errorifexists").json(path)


GOLDEN = "query_id string, query_text string, kind string, expected array<struct<file_name: string, page: long>>, must_contain array<string>, must_not_contain array<string>"


def save_golden(questions: DataFrame, path: str) -> None:
    questions.withColumn("format", F.lit(FORMAT)).write.mode("errorifexists").json(path)


def load_golden(spark: SparkSession, path: str) -> DataFrame:
    """A question set; that it is absent or of another format is an error."""
    rows = spark.read.schema(GOLDEN + ", format int").json(path)
    if rows.where(F.coalesce(F.col("format") != FORMAT, F.lit(True))).head(1):
        raise ValueError(f"{path} isn't a question set of format {FORMAT}")
    return rows.drop("format")


def save_evaluation(results: DataFrame, path: str, at: datetime) -> str:
    """Results of a run in a folder of its own, named by the time in UTC; one that exists is never written again."""
    target = f"{path}/eval_{at.astimezone(timezone.utc):%Y%m%dT%H%M%SZ}"
    results.write.mode("errorifexists").json(target)
    return target


def load_prompt(spark: SparkSession, path: str, version: str, name: str) -> str:
    """The template path/version/name.txt; an unknown version or name lists those there are."""
    for folder, wanted in ((path, version), (f"{path}/{version}", f"{name}.txt")):
        if wanted not in (there := _folders(spark, folder)):
            raise KeyError(f"{wanted} is none of {there}")
    return spark.read.text(f"{path}/{version}/{name}.txt", wholetext=True).first()["value"]


#: How the bytes of a file become pages (page, text, error), by extension; others may be added.
LOADERS: dict[str, Callable[[bytes], list[tuple[int, str]]]] = {
    "txt": lambda data: [(1, data.decode("utf-8"))],
    "html": lambda data: [(1, html.unescape(re.sub(r"(?is)<(script|style).*?</\1>|<[^>]+>", " ", data.decode("utf-8"))))],
}


def read_pages(files: DataFrame, loaders: dict[str, Callable[[bytes], list[tuple[int, str]]]] | None = None) -> DataFrame:
    """files (file_name, content) by the loader of their extension, in either case: file_name, content_hash, page, text, error.

    Files without a loader are left out; one that its loader can't read has one row with the error and no text.
    """
    by = {k.lower(): f for k, f in (LOADERS if loaders is None else loaders).items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, data in zip(batch["file_name"], batch["content"]):
                digest = hashlib.sha256(data).hexdigest()[:32]
                try:
                    rows += [(name, digest, page, unicodedata.normalize("NFC", text), None) for page, text in by[name.rsplit(".", 1)[-1].lower()](bytes(data))]
                except Exception as e:  # whatever a loader raises is that file's result
                    rows.append((name, digest, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["file_name", "content_hash", "page", "text", "error"]).astype({"page": "Int64"})

    known = files.where(F.lower(F.regexp_extract("file_name", r"\.([^.]+)$", 1)).isin(list(by)))
    return known.select("file_name", "content").mapInPandas(run, "file_name string, content_hash string, page long, text string, error string")


def named(files: DataFrame) -> DataFrame:
    """Rows of binaryFile as (file_name, content)."""
    return files.select(F.regexp_extract("path", "[^/]*$", 0).alias("file_name"), "content")


def load_files(spark: SparkSession, path: str, loaders: dict[str, Callable[[bytes], list[tuple[int, str]]]] | None = None) -> DataFrame:
    """read_pages() of the files of a folder (not below it)."""
    return read_pages(named(spark.read.format("binaryFile").load(path)), loaders)
