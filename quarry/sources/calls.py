"""Calls of a model, kept by what was asked."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.snapshots import Snapshots, written


class CallTable:
    """Replies of a model by the hash of its id and the prompt, in a folder.

    ask(prompt, key) is made for each distinct prompt without a reply, at most wave of them in a job, and each wave is committed: what was answered is
    never asked again, by this run or a later one. A task that is lost in a wave may ask its own prompts again; the key
    lets a service tell that. What ask raises is the prompt's error; it isn't kept, so that a later run asks again.
    """

    def __init__(self, spark: SparkSession, path: str, model_id: str, ask: Callable[[str, str], str], wave: int = 100_000):
        self.spark, self.path, self.model_id, self.ask, self.wave = spark, path.rstrip("/"), model_id, ask, wave
        self.snapshots = Snapshots(spark, path)

    def known(self) -> DataFrame:
        """(key, text) of all replies."""
        parts = self.snapshots.latest()[1].get("parts", [])
        if not parts:
            return self.spark.createDataFrame([], "key string, text string")
        return self.spark.read.schema("key string, text string").parquet(*[f"{self.path}/replies/{p}" for p in parts]).dropDuplicates(["key"])

    def __call__(self, prompts: DataFrame) -> DataFrame:
        """prompts (query_id, prompt) -> query_id, text, error; a null prompt has neither."""
        key = F.sha2(F.concat(F.lit(self.model_id), F.char(F.lit(0)), F.col("prompt")), 256)
        asked = written(prompts.select("query_id", "prompt", key.alias("key")), "prompts")
        new = written(asked.where("key IS NOT NULL").dropDuplicates(["key"]).select("key", "prompt").join(self.known(), "key", "left_anti"), "new-prompts")
        waves = -(-new.count() // self.wave)
        failed = self.spark.createDataFrame([], "key string, error string")
        for w in range(waves):
            failed = failed.unionByName(self._wave(new.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == w)))
        return asked.join(self.known(), "key", "left").join(failed, "key", "left").select("query_id", "text", "error")

    def _wave(self, prompts: DataFrame) -> DataFrame:
        ask = self.ask

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for key, prompt in zip(batch["key"], batch["prompt"]):
                    try:
                        rows.append((key, ask(prompt, key), None))
                    except Exception as e:  # whatever a model raises is that prompt's result
                        rows.append((key, None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=["key", "text", "error"])

        name = uuid.uuid4().hex
        cores = self.spark.sparkContext.defaultParallelism
        prompts.repartition(cores).mapInPandas(run, "key string, text string, error string").write.parquet(f"{self.path}/replies/{name}-all")
        told = self.spark.read.schema("key string, text string, error string").parquet(f"{self.path}/replies/{name}-all")
        told.where("error IS NULL").select("key", "text").write.parquet(f"{self.path}/replies/{name}")
        self.snapshots.change(lambda s: {"parts": [*s.get("parts", []), name]})
        return told.where("error IS NOT NULL").select("key", "error")
