"""Streams of answer pieces: thinking blocks are held back while they are open, tags may be split over pieces."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quarry.functions.text import sse_frame

OPEN, CLOSE = re.compile(r"<think[^>]*>", re.I), re.compile(r"</think[^>]*>", re.I)
ERROR_EVENT, END_EVENT = "[HATA] Cevap üretilemedi.", "[DONE]"  # fixed values
HOLD = 16  # fixed value: characters of a possible tag that are held back
#: Places of a stream whose waiting pieces are stored as one.
BLOCK = 256


class ReasoningFilter:
    """Feed pieces, get what may be shown; finish() gives what was held back."""

    def __init__(self, buffer: str = "", inside: bool = False):
        self.buffer, self.inside = buffer, inside

    def feed(self, piece: str) -> str:
        self.buffer += piece
        if "<" not in self.buffer:  # no tag, and no start of one
            out, self.buffer = ("", self.buffer[-HOLD:]) if self.inside else (self.buffer, "")
            return out
        out = ""
        while True:
            tag = (CLOSE if self.inside else OPEN).search(self.buffer)
            if tag is None:
                break
            if not self.inside:
                out += self.buffer[: tag.start()]
            self.buffer, self.inside = self.buffer[tag.end() :], not self.inside
        if self.inside:
            self.buffer = self.buffer[-HOLD:]
            return out
        at = self.buffer.rfind("<")
        if at < 0 or len(self.buffer) - at > HOLD:
            at = len(self.buffer)
        out, self.buffer = out + self.buffer[:at], self.buffer[at:]
        return out

    def finish(self) -> str:
        out, self.buffer = ("" if self.inside else self.buffer), ""
        return out


def filter_pieces(pieces: DataFrame) -> DataFrame:
    """Batch form: (query_id, seq, piece) -> query_id, text shown in order. One stream is one small group."""

    def run(key, batch: pd.DataFrame) -> pd.DataFrame:
        f = ReasoningFilter()
        shown = [f.feed(p or "") for p in batch.sort_values("seq")["piece"]]
        return pd.DataFrame({"query_id": [key[0]], "text": ["".join(shown) + f.finish()]})

    return pieces.groupBy("query_id").applyInPandas(run, "query_id long, text string")


class _Reordered(StatefulProcessor):
    """Each stream's pieces in order of seq, from 0 on, through a ReasoningFilter; the piece marked last ends the stream and its state.

    A group is a lane of streams, so that what Spark does for a group is done for many. A stream's state is its place, and the pieces that
    came early and wait for those before them, in blocks of BLOCK neighbours: the place's own block is stored with it, others by number. A
    batch so reads and writes a stream's place once, and not each piece. Pieces that came already are left out. A stream whose pieces stop
    coming loses its state after ttl_ms, unless that is None.
    """

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.places = handle.getMapState("places", "query_id long", "next long, buffer string, inside boolean, near string, blocks array<long>", self.ttl_ms)
        self.waiting = handle.getMapState("waiting", "query_id long, block long", "pieces string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            streams: dict[int, dict[int, tuple[str, bool]]] = {}
            for query_id, seq, piece, last in zip(*(batch[c].tolist() for c in ("query_id", "seq", "piece", "last"))):
                streams.setdefault(query_id, {})[seq] = (piece or "", bool(last))
            shown = [(query_id, seq, text) for query_id, new in streams.items() for seq, text in self._shown(query_id, new) if text]
            if shown:
                yield pd.DataFrame(shown, columns=["query_id", "seq", "text"])

    def _shown(self, query_id: int, pieces: dict[int, tuple[str, bool]]) -> list[tuple[int, str]]:
        """(seq, text) of the pieces of a stream that need wait no longer."""
        place = self.places.getValue((query_id,))
        at, buffer, inside, near, numbers = place or (0, "", False, "[]", [])
        f, stored, shown, done = ReasoningFilter(buffer, inside), set(numbers), [], False
        pieces.update(_unpacked(near))
        while not done:
            if at not in pieces:
                if (number := at // BLOCK) not in stored:
                    break
                pieces.update(self._taken(query_id, number, stored))
                continue
            piece, done = pieces[at]
            shown.append((at, f.feed(piece) + (f.finish() if done else "")))
            at += 1
        if done:
            for number in list(stored):
                self._taken(query_id, number, stored)
            if place:
                self.places.removeKey((query_id,))
            return shown
        blocks: dict[int, dict[int, tuple[str, bool]]] = {at // BLOCK: {}}
        for seq, value in pieces.items():
            if seq >= at:
                blocks.setdefault(seq // BLOCK, {})[seq] = value
        near = json.dumps(list(blocks.pop(at // BLOCK).items()))
        for number, far in blocks.items():
            if number in stored:
                far = self._taken(query_id, number, stored) | far
            self.waiting.updateValue((query_id, number), (json.dumps(list(far.items())),))
        self.places.updateValue((query_id,), (at, f.buffer, f.inside, near, sorted(stored | blocks.keys())))
        return shown

    def _taken(self, query_id: int, number: int, stored: set[int]) -> dict[int, tuple[str, bool]]:
        """A stored block, which leaves the state."""
        found = self.waiting.getValue((query_id, number))
        self.waiting.removeKey((query_id, number))
        stored.discard(number)
        return _unpacked(found[0]) if found else {}

    def close(self) -> None:
        pass


def _unpacked(block: str) -> dict[int, tuple[str, bool]]:
    return {seq: tuple(value) for seq, value in json.loads(block)}


def filter_stream(pieces: DataFrame, ttl_ms: int | None = 3_600_000, lanes: int = 1024) -> DataFrame:
    """Streaming form over (query_id, seq, piece, last): query_id, seq, and the text that may be shown once that piece is there. Pieces may come in any order and more than once.

    Needs the RocksDB state store (use_rocksdb). A piece of a stream that has ended opens a new state, which goes by ttl_ms; it may give rows
    once more. They equal those before, as a row's text hangs on the pieces up to its own alone: readers take one row of a query_id and seq.
    A finite stream that is to end by itself takes None: while state can expire, Spark goes on making empty batches. Streams are dealt by
    query_id to lanes, which share the work of the tasks; their number is fixed for a checkpoint. A piece without query_id or seq is of no stream.
    """
    mode = "None" if ttl_ms is None else "ProcessingTime"
    lane = F.pmod(F.xxhash64("query_id"), F.lit(lanes)).alias("lane")
    rows = pieces.where("query_id IS NOT NULL AND seq IS NOT NULL").select(lane, "query_id", "seq", F.coalesce("piece", F.lit("")).alias("piece"), F.coalesce("last", F.lit(False)).alias("last"))
    return rows.groupBy("lane").transformWithStateInPandas(_Reordered(ttl_ms), "query_id long, seq long, text string", "Append", mode)


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def shown_texts(pieces: DataFrame, path: str) -> tuple[DataFrame, list[dict]]:
    """What a finite stream of pieces shows, by query: it runs to its end into a table under path; with the progress of its batches."""
    use_rocksdb(pieces.sparkSession)
    query = filter_stream(pieces, None).writeStream.format("parquet").option("path", f"{path}/shown").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    shown = pieces.sparkSession.read.schema("query_id long, seq long, text string").parquet(f"{path}/shown").dropDuplicates(["query_id", "seq"])
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    return shown.groupBy("query_id").agg(F.array_join(in_order, "").alias("text")), [json.loads(p.json) for p in query.recentProgress]


def frames(pieces: DataFrame) -> DataFrame:
    return pieces.withColumn("frame", sse_frame(F.col("piece")))


def events(pieces: DataFrame) -> DataFrame:
    """A stream's server-sent events in order of `at`: a frame for each piece (query_id, seq, piece, error), an error's frame in the place of a piece that failed, and the end's frame after the last.

    Nothing of a stream comes after its first error but the end.
    """
    failed = F.min(F.when(F.col("error").isNotNull(), F.col("seq"))).over(Window.partitionBy("query_id"))
    rows = pieces.withColumn("failed", failed).where(F.col("failed").isNull() | (F.col("seq") <= F.col("failed")))
    said = rows.select("query_id", F.col("seq").cast("long").alias("at"), sse_frame(F.when(F.col("error").isNull(), F.coalesce("piece", F.lit(""))).otherwise(F.lit(ERROR_EVENT))).alias("frame"))
    end = rows.groupBy("query_id").agg((F.max("seq") + 1).cast("long").alias("at")).withColumn("frame", sse_frame(F.lit(END_EVENT)))
    return said.unionByName(end)
