"""Helpers that the operators share: input columns, written intermediate tables, byte-plane coding."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.snapshots import put

#: A document id that is null sorts before all others; this stands for it in join keys.
NULL_ID = -(2**63)

#: Spaces that separate words: blank and the five ASCII control spaces (fixed by the word rule).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns that operators read; a null text is an empty one, other columns are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: a table that comes in fewer splits than there are cores (a small one) is dealt out, any other stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def split_words(text: bytes, table: bytes, piece: int = 2**20) -> Iterator[list[bytes]]:
    """Words of a UTF-8 text, about a piece at a time; table maps bytes of words to what they become and all others to a blank."""
    start = 0
    while start < len(text):
        part = text[start : start + piece].translate(table)
        if start + piece < len(text):
            end = part.rfind(b" ")
            if end < 0:  # a word longer than a piece
                part = text[start:].translate(table)
                end = part.find(b" ") % (len(part) + 1)
            part = part[:end]
        start += max(1, len(part))
        yield part.split()


def row_key(col: str = "doc_id") -> Column:
    """A join key that is never null."""
    return F.coalesce(F.col(col), F.lit(NULL_ID).cast("long"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset in local mode (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """A write in here drops its shuffle files when it is done: what it wrote is all that later steps read."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, name: str, by: str | None = None, path: str | None = None) -> DataFrame:
    """Write df to the shared folder (in one folder for each value of column by) and read it back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    with shuffles_dropped(spark):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, path: str, key: str, n: int) -> DataFrame:
    """Like written(), for rows that are dealt by hash of key into n parts: a join with others that are leaves this side where it is."""
    spark = df.sparkSession
    name = f"quarry_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key}) INTO {n} BUCKETS LOCATION '{path}'")
    with shuffles_dropped(spark):  # an insert drops them, a write that makes the table would not
        df.write.insertInto(name)
    out = spark.read.table(name)
    out.schema  # resolved now: the name isn't needed any more
    spark.sql(f"DROP TABLE {name}")  # of a table with a path of its own this leaves the files
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def salted_join(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """left join right on key, where right has one row a key: a key that many rows of left share is dealt over salts tasks by their column by."""
    salt = [F.lit(i) for i in range(salts)]
    dealt = left.withColumn("join_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    return dealt.join(right.withColumn("join_salt", F.explode(F.array(*salt))), [key, "join_salt"], how).drop("join_salt")


def with_text_key(docs: DataFrame) -> DataFrame:
    """rid and sha, which name a row by id and text, and the whole row as a struct: no name of its columns can clash."""
    return docs.select(row_key().alias("rid"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("sha"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


class Commits:
    """Committed folders by id, each named by a marker file that comes into place whole, after its data, and is never replaced.

    A folder without a marker counts as nothing, so a half-written commit can be tried again; of two writers of one id
    the first to place the marker wins. A marker holds the folder and the ids that it stands for, each with a digest of its input.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        root = self.hadoop.Path(path)
        self.fs = root.getFileSystem(spark._jsc.hadoopConfiguration())

    def all(self) -> dict[str, tuple[str, str]]:
        """Folder and digest of each id, as of one listing."""
        marks = self.fs.globStatus(self.hadoop.Path(f"{self.path}/commits/*.json")) or []
        out = {}
        for m in marks:
            stream = self.fs.open(m.getPath())
            said = self._said(bytes(stream.readAllBytes()))
            stream.close()
            out |= {i: (said["folder"], digest) for i, digest in said["ids"].items()}
        return out

    @staticmethod
    def _said(data: bytes) -> dict:
        """A marker's content; one that isn't whole was left by a writer that placed it otherwise, and says nothing."""
        return json.loads(data) if data.endswith(b"}") else {"folder": "", "ids": {}}

    def new_folder(self) -> str:
        return f"{self.path}/data/{uuid.uuid4().hex}"

    def add(self, commit_id: str, folder: str, digest: str = "") -> bool:
        return self._placed(commit_id, folder, {commit_id: digest})

    def _placed(self, name: str, folder: str, ids: dict[str, str]) -> bool:
        mark, data = f"{self.path}/commits/{hashlib.sha256(name.encode()).hexdigest()}.json", json.dumps({"folder": folder, "ids": ids}).encode()
        if put(self.spark, mark, data):
            return True
        path = self.hadoop.Path(mark)
        stream = self.fs.open(path)
        whole = bytes(stream.readAllBytes()).endswith(b"}")
        stream.close()
        return not whole and self.fs.delete(path, False) and put(self.spark, mark, data)

    def read(self, schema: str, known: dict[str, tuple[str, str]] | None = None) -> DataFrame:
        """Rows of all committed folders, or of those in known."""
        folders = sorted({f for f, _ in (self.all() if known is None else known).values() if f})
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def take_over(self, known: dict[str, tuple[str, str]], rows: DataFrame) -> None:
        """Commit rows in the place of all ids of known, in one marker, to this so far empty place; again with the same ids does nothing."""
        if here := self.all():
            if {i: d for i, (_, d) in here.items()} != {i: d for i, (_, d) in known.items()}:
                raise ValueError(f"{self.path} holds other commits")
            return
        folder = self.new_folder()
        with shuffles_dropped(self.spark):
            rows.write.parquet(folder)
        self._placed("compacted", folder, {i: d for i, (_, d) in known.items()})


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
