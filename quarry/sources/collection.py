"""A collection of files as one stored thing: chunks with vectors, the manifest, and the files on disk.

One snapshot names the chunk segments, what of them is gone, and the manifest, so that chunks and manifest always agree. Files
are deleted from disk after the snapshot that forgets them; until that is done the snapshot lists them, and the next
writer ends what a lost one had begun. A batch of a stream is in the snapshot that has its rows, so that it counts once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import chunking, library
from quarry.sources import store
from quarry.sources.snapshots import Snapshots, written

CHUNKS = "chunk_id string, file_name string, page long, ordinal long, token_count long, text string, embedding array<double>"


class Collection:
    """path: the folder of chunks, manifest and snapshots. embedder: has model_id, dimension and passage(Column). files: the folder that the files lie in."""

    def __init__(self, spark: SparkSession, path: str, embedder, files: str | None = None, rules: chunking.ChunkRules = chunking.ChunkRules(), count: Callable[[str], int] = chunking.count_words):
        if rules.hard_limit > embedder.max_tokens:
            raise ValueError(f"chunks of {rules.hard_limit} tokens are over the embedder's {embedder.max_tokens}")
        self.spark, self.path, self.embedder, self.files, self.rules, self.count = spark, path.rstrip("/"), embedder, files, rules, count
        self.snapshots = Snapshots(spark, path)

    def _state(self) -> tuple[int, dict]:
        number, state = self.snapshots.latest()
        own = {"format": store.FORMAT, "model_id": self.embedder.model_id, "dimension": self.embedder.dimension}
        state = state or {**own, "segments": [], "gone": [], "manifest": None, "batches": {}, "count": 0, "unlink": {}}
        for name, want in own.items():
            if state[name] != want:
                raise store.IndexCompatibilityError(f"{name} is {state[name]!r}, not {want!r}")
        return number, state

    def _chunks(self, state: dict) -> DataFrame:
        if not state["segments"]:
            return self.spark.createDataFrame([], f"{CHUNKS}, segment string")
        rows = self.spark.read.option("basePath", f"{self.path}/chunks").schema(f"{CHUNKS}, segment string").parquet(*[f"{self.path}/chunks/segment={s}" for s in state["segments"]])
        if state["gone"]:
            gone = self.spark.read.schema("segment string, file_name string").parquet(*[f"{self.path}/gone/{g}" for g in state["gone"]])
            rows = rows.join(gone, ["segment", "file_name"], "left_anti")
        return rows

    def _manifest(self, state: dict) -> DataFrame:
        if state["manifest"] is None:
            return self.spark.createDataFrame([], store.MANIFEST)
        return self.spark.read.schema(store.MANIFEST).parquet(f"{self.path}/manifest/{state['manifest']}")

    def chunks(self) -> DataFrame:
        return self._chunks(self._state()[1]).drop("segment")

    def manifest(self) -> DataFrame:
        return self._manifest(self._state()[1])

    def ingest(self, pages: DataFrame, batch: tuple[str, int] | None = None) -> DataFrame:
        """pages (file_name, content_hash, page, text, error; see read_pages) go in by what the manifest knows of their files; one row a file: file_name, status, replaced, page_count, chunk_count.

        batch: a stream and its batch's number; one that is not over the last committed one changes nothing and reports no file. Files
        with the content, model and chunks that the manifest has are skipped. Of two contents of one name in a batch the one with the larger hash counts.
        """
        self.recover()
        number, state = self._state()
        report = "file_name string, status string, replaced boolean, page_count long, chunk_count long"
        if batch is not None and batch[1] <= state["batches"].get(batch[0], -1):
            return self.spark.createDataFrame([], report)
        pages = written(pages.select("file_name", "content_hash", "page", "text", "error"), "pages")
        files = pages.groupBy("file_name").agg(F.max("content_hash").alias("content_hash"), F.max_by("error", "content_hash").alias("error"))
        pages = pages.join(files.select("file_name", "content_hash"), ["file_name", "content_hash"], "left_semi")
        live, manifest = self._chunks(state), self._manifest(state)
        current = library.currency(files, manifest, live, self.embedder.model_id)
        layers = library.text_layer(pages)
        plan = library.ingest_plan(files.select("file_name", "error"), layers, current, manifest)
        taken = plan.where("status = 'ok'").select("file_name")
        cut = chunking.chunk_documents(pages.join(taken, "file_name", "left_semi").select("file_name", "page", "text"), self.rules, self.count).drop("error")
        segment = uuid.uuid4().hex
        whole = cut.dropDuplicates(["chunk_id"]).withColumn("embedding", self.embedder.passage(F.col("text")))
        whole.select(*[c.split()[0] for c in CHUNKS.split(", ")]).write.parquet(f"{self.path}/chunks/segment={segment}")
        fresh = self.spark.read.schema(CHUNKS).parquet(f"{self.path}/chunks/segment={segment}")
        ids = fresh.groupBy("file_name").agg(F.collect_list("chunk_id").alias("chunk_ids"))
        done = plan.join(ids, "file_name", "left").join(layers.select("file_name", "page_count"), "file_name", "left").join(files, "file_name")
        done = done.join(manifest.select("file_name", F.col("page_count").alias("known_pages"), F.col("chunk_count").alias("known_chunks")), "file_name", "left")
        n = F.coalesce(F.size("chunk_ids"), F.lit(0)).cast("long")
        skipped, status = F.col("status") == "skipped", F.when((F.col("status") == "ok") & (F.greatest(n, F.lit(0)) == 0), "no_text_layer").otherwise(F.col("status"))
        pages_of = F.when(F.col("status") == "failed", 0).otherwise(F.coalesce("page_count", F.lit(0))).cast("long")
        done = written(
            done.select(
                "file_name", "content_hash", "error", status.alias("status"), (F.col("replaced") & (status == "ok")).alias("replaced"), F.when(skipped, F.col("known_pages")).otherwise(pages_of).alias("page_count"),
                F.when(skipped, F.col("known_chunks")).otherwise(F.greatest(n, F.lit(0))).cast("long").alias("chunk_count"), F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"),
            ),
            "report",
        )
        changed = done.where("status <> 'skipped'").select(
            "file_name", "content_hash", "status", "page_count", "chunk_count", "chunk_ids", F.lit(self.embedder.model_id).alias("embedder_model_id"), F.current_timestamp().alias("processed_at"), "error"
        )
        gone = live.join(done.where("replaced").select("file_name"), "file_name", "left_semi").select("segment", "file_name").distinct()
        new = {**state, "segments": [*state["segments"], segment], "batches": {**state["batches"], **({batch[0]: batch[1]} if batch else {})}}
        self._commit(number, new, changed, gone, changed.select("file_name"))
        return done.select("file_name", "status", "replaced", "page_count", "chunk_count")

    def _commit(self, number: int, state: dict, changed: DataFrame | None, gone: DataFrame, forget: DataFrame) -> int:
        """Commit state with the manifest's rows changed or forgotten and the (segment, file_name) pairs of gone; rows that left."""
        name = uuid.uuid4().hex
        before = self._chunks(state).count() if state["gone"] or state["segments"] else 0
        gone.write.parquet(f"{self.path}/gone/{name}")
        rows = self._manifest(state).join(forget, "file_name", "left_anti")
        (rows if changed is None else rows.unionByName(changed)).write.parquet(f"{self.path}/manifest/{name}")
        state = {**state, "gone": [*state["gone"], name], "manifest": name}
        state["count"] = self._chunks(state).count()
        self.snapshots.commit(number, state)
        return before - state["count"]

    def remove(self, names: list[str]) -> int:
        """Files leave the chunks and the manifest at once, and then the disk; how many chunks left. Unknown names are passed over."""
        self.recover()
        number, state = self._state()
        asked = self.spark.createDataFrame([(n,) for n in names], "file_name string").distinct()
        gone = self._chunks(state).join(asked, "file_name", "left_semi").select("segment", "file_name").distinct()
        new = {**state, "unlink": {n: self._mark(n) for n in names if self.files and self._mark(n)}}
        left = self._commit(number, new, None, gone, asked)
        self.recover()
        return left

    def remove_all(self) -> int:
        """Every file of the manifest leaves; how many there were."""
        names = [r["file_name"] for r in self.manifest().select("file_name").toLocalIterator()]
        self.remove(names)
        return len(names)

    def _file(self, name: str):
        if "/" in name or name in ("", ".", ".."):
            raise ValueError(f"{name!r} is no file name")
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(f"{self.files}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _mark(self, name: str) -> list[int]:
        """Length and time of a file; nothing if it isn't there."""
        fs, path = self._file(name)
        return [fs.getFileStatus(path).getLen(), fs.getFileStatus(path).getModificationTime()] if fs.exists(path) else []

    def recover(self) -> None:
        """Delete the files that a remove() left behind; a file that has been put there anew stays."""
        number, state = self._state()
        if not state["unlink"]:
            return
        for name, mark in state["unlink"].items():
            if self._mark(name) == mark:
                fs, path = self._file(name)
                fs.delete(path, False)
        self.snapshots.commit(number, {**state, "unlink": {}})

    def listing(self) -> DataFrame:
        """Visible files on disk with what the manifest knows of them."""
        files = store.named(self.spark.read.format("binaryFile").load(self.files)).select("file_name")
        return library.listing(files, self.manifest())

    def expire(self, keep: int = 2) -> list[str]:
        """Drop all but the last states and what only they use."""
        return self.snapshots.expire(keep, lambda s: [*[f"chunks/segment={x}" for x in s["segments"]], *[f"gone/{x}" for x in s["gone"]], *([f"manifest/{s['manifest']}"] if s["manifest"] else [])])

    def compact(self) -> None:
        """All live chunks in one segment."""
        number, state = self._state()
        segment = uuid.uuid4().hex
        self._chunks(state).drop("segment").write.parquet(f"{self.path}/chunks/segment={segment}")
        self.snapshots.commit(number, {**state, "segments": [segment], "gone": []})


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps in its checkpoint: a new checkpoint is a new stream, whose batches begin at 0 again."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()["value"])["id"]


def ingest_stream(collection: Collection, files: DataFrame, checkpoint: str, loaders=None) -> None:
    """A stream of files (file_name, content) into a collection, batch by batch, until all that is there is in. A batch that is tried again counts once."""

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = Collection(spark, collection.path, collection.embedder, collection.files, collection.rules, collection.count)
        own.ingest(store.read_pages(batch, loaders), (stream_id(spark, checkpoint), number))

    files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
