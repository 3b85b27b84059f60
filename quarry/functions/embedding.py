"""An embedder that needs no model: hashed word counts of length one, the same on every machine."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import raw_tokens, words


@functools.lru_cache(1 << 16)
def _slot(word: str, dimension: int) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dimension


class HashingEmbedder:
    """Texts as vectors (array<double>); queries and passages have a prefix each. A text without words has a null vector."""

    def __init__(self, dimension: int = 64, query_prefix: str = "query: ", passage_prefix: str = "passage: ", max_tokens: int = 1024):
        self.max_tokens = max_tokens
        self.dimension, self.query_prefix, self.passage_prefix = dimension, query_prefix, passage_prefix
        self.model_id = f"hashed-words-{dimension}"

    def _vectors(self, text: Column) -> Column:
        dimension = self.dimension

        @F.pandas_udf("array<double>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                out = []
                for w in texts:
                    if w is None or not len(w):
                        out.append(None)
                        continue
                    v = np.bincount([_slot(x, dimension) for x in w], minlength=dimension).astype(np.float64)
                    out.append(v / np.sqrt(v @ v))
                yield pd.Series(out, dtype=object)

        return embed(raw_tokens(text))

    @staticmethod
    def count_tokens(text: str) -> int:
        """Words as the vectors have them, of a text as it is given."""
        return len(words(text))

    def query(self, text: Column) -> Column:
        return self._vectors(F.concat(F.lit(self.query_prefix), text))

    def passage(self, text: Column) -> Column:
        return self._vectors(F.concat(F.lit(self.passage_prefix), text))
