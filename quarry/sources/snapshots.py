"""Numbered states of a stored thing, and scratch tables in the folder that all executors share."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession


class Conflict(RuntimeError):
    """Another writer has committed since the state was read."""


def put(spark: SparkSession, path: str, data: bytes) -> bool:
    """A small file in place whole, by a rename that never overwrites; False if one is there already."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    target = hadoop.Path(path)
    draft, fs = hadoop.Path(target.getParent(), f".{uuid.uuid4().hex}"), target.getFileSystem(conf)
    stream = fs.create(draft, False)
    stream.write(data)
    stream.close()
    rename = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    try:
        hadoop.FileContext.getFileContext(target.toUri(), conf).rename(draft, target, options)
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


class Snapshots:
    """States of a folder by number, each a small JSON file under snapshots/ that comes into place whole and is never replaced.

    A writer reads the latest state, writes data beside it and commits the next number; of two that started from one
    state the second gets a Conflict. A state appears by a rename that never overwrites, which HDFS and object stores with
    such a rename do at once; a local file system checks and renames in two steps.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop, self._conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def numbers(self) -> list[int]:
        folder = self._at("snapshots")
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n[:12]) for n in names if re.fullmatch(r"\d{12}\.json", n))

    def read(self, number: int) -> dict:
        stream = self._fs.open(self._at(f"snapshots/{number:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict]:
        """The last state's number and the state; -1 and an empty one if there is none."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (-1, {})

    def commit(self, after: int, state: dict) -> int:
        """Put state in place as the one after number after."""
        if not put(self.spark, f"{self.path}/snapshots/{after + 1:012d}.json", json.dumps(state).encode()):
            raise Conflict(f"{self.path} has a state {after + 1} already")
        return after + 1

    def change(self, make: Callable[[dict], dict | None], tries: int = 10) -> dict:
        """Commit make(state) over the latest state, again from the start if another writer was first. None: nothing to change."""
        for _ in range(tries):
            number, state = self.latest()
            new = make(state)
            if new is None:
                return state
            try:
                self.commit(number, new)
                return new
            except Conflict:
                continue
        raise Conflict(f"{self.path}: {tries} tries, others were first each time")

    def expire(self, keep: int, folders: Callable[[dict], Iterable[str]]) -> list[str]:
        """Drop all but the last keep states, and the folders (paths below this one) that only dropped states name; returns these.

        Folders that no state names (of a writer at work, or one that was lost) are left alone.
        """
        numbers = self.numbers()
        gone, kept = numbers[:-keep] if keep else numbers, numbers[-keep:] if keep else []
        used = {f for n in kept for f in folders(self.read(n))}
        unused = sorted({f for n in gone for f in folders(self.read(n))} - used)
        for n in gone:  # states first: none may name a folder that is gone
            self._fs.delete(self._at(f"snapshots/{n:012d}.json"), False)
        for f in unused:
            self._fs.delete(self._at(f), True)
        return unused


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; one of our own where that is unset in local mode (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def version(df: DataFrame) -> str:
    """A name for the files that df reads as they are now: it changes when one of them does."""
    spark = df.sparkSession
    said = []
    for name in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        said.append([name, status.getLen(), status.getModificationTime()])
    return hashlib.sha256(json.dumps(said).encode()).hexdigest()[:32]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """written(), with aggregates of the rows that pass, taken by the job that writes them, and its seconds."""
    watch, began = Observation(), time.time()
    out = written(df.observe(watch, *[c.alias(k) for k, c in metrics.items()]), name)
    return out, {**watch.get, "seconds": time.time() - began}


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: read as often as wanted, and not made again when an executor is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
