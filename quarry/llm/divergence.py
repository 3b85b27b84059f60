"""How sources of a language differ in their words, from joint tables of counts.

Each language keeps its frequent terms. A source's share of a term depends on the count alone, so two sources differ by
the sum over pairs of count levels (c, d) of the number of terms that have c in one and d in the other,
times the difference of the two prices. These joint tables are a matrix product: with a 0/1 column for each
(source, count level) and a row for each term, the columns' matrix transposed times itself has all joint tables of
all pairs of sources. The product is made in blocks of terms and tiles of sources; a block's tables are
priced where they are made, in 64-bit integers, so that only a number for each pair of sources leaves a task.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import split_words, written

MIN_DOCS, TOP_TERMS, ADDED = 30, 50, 5
#: Rows and (source) columns of a matrix block; terms of a product inside a block: so many at most, fewer while they have more levels a source.
BLOCK_TERMS, TILE_SOURCES = 256, 24
_SLICES, _LEVELS = (256, 128, 64, 32), 24
#: Distinct terms that a task holds before it sends their counts on.
_HELD = 2**19
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, A-Z lower-cased, piece by piece."""
    return split_words(text, _TABLE)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("n_docs", pa.int64())])
    places: dict[tuple, Counter] = defaultdict(Counter)
    holders: dict[tuple, Counter] = defaultdict(Counter)

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in places.items():
            docs = holders[lang, source]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(counts), pa.string()), pa.array([source] * len(counts), pa.string()), pa.array(list(counts), pa.binary()).cast(pa.string()),
                 pa.array(list(counts.values()), pa.int64()), pa.array([docs[t] for t in counts], pa.int64())], schema=schema
            )
        places.clear()
        holders.clear()

    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
            seen: set[bytes] = set()
            for terms in terms_of(text.as_py()):
                places[lang, source].update(terms)
                seen.update(terms)
            holders[lang, source].update(seen)
        if sum(map(len, places.values())) > _HELD:
            yield from sent()
    yield from sent()


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, n_docs) of whole texts; counts are summed in each task before they are shuffled."""
    counts = _named(docs).mapInArrow(_count, "lang string, source string, term string, n long, n_docs long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def price(n: Column, total: Column, n_terms: Column) -> Column:
    """1 + floor(10**9 * (n + 5) / (total + 5 * terms)), exactly."""
    number = lambda c, digits: c.cast(f"decimal({digits},0)")
    top = number(n + ADDED, 20) * number(F.lit(1_000_000_000), 10)
    return F.lit(1) + F.call_function("div", top, number(total + ADDED * n_terms, 20))


def _slices(counts: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of counts in order of their sums, in runs with few levels a column."""
    order, start = np.argsort(counts.sum(1), kind="stable"), 0
    while start < len(order):
        for size in _SLICES:
            rows = order[start : start + size]
            if size == _SLICES[-1] or sum(len(np.unique(c)) for c in counts[rows].T) <= _LEVELS * counts.shape[1]:
                break
        yield rows
        start += len(rows)


def _columns(counts: np.ndarray, prices: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indicator columns of (source, level), each one's price, and where each source's columns begin."""
    ones, cost, first = [], [], []
    for s in range(counts.shape[1]):
        levels, at, own = np.unique(counts[:, s], return_index=True, return_inverse=True)
        first.append(sum(map(len, cost)))
        cost.append(prices[at, s])
        ones.append(own[:, None] == np.arange(len(levels)))
    return np.concatenate(ones, 1).astype(np.float32), np.concatenate(cost), np.array(first)


def priced(counts: np.ndarray, prices: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sum over terms (rows) of the difference of prices, for each pair of a left and a right source (columns).

    A product has whole numbers up to the number of its rows, which float32 holds exactly.
    """
    out = np.zeros((len(left), len(right)), np.int64)
    if not len(left) or not len(right):
        return out
    for rows in _slices(counts):
        a, cost_a, first_a = _columns(counts[np.ix_(rows, left)], prices[np.ix_(rows, left)])
        b, cost_b, first_b = _columns(counts[np.ix_(rows, right)], prices[np.ix_(rows, right)])
        joint = (a.T @ b).astype(np.int64)
        joint *= np.abs(cost_a[:, None] - cost_b[None, :])
        out += np.add.reduceat(np.add.reduceat(joint, first_a, axis=0), first_b, axis=1)
    return out


def _price_block(key: tuple, rows: pa.Table) -> pa.Table:
    lang, _, tile, other = (k.as_py() for k in key)
    sources, terms = rows.column("source").combine_chunks().dictionary_encode(), rows.column("term").combine_chunks().dictionary_encode()
    names, s = np.array(sources.dictionary.to_pylist(), dtype=object), sources.indices.to_numpy()
    t = terms.indices.to_numpy(zero_copy_only=False)
    n, p, tiles = (rows.column(c).to_numpy() for c in ("n", "p", "tile"))
    of_source = rows.column("term").is_null().to_numpy()  # a source's own row: the number of the block's terms and the price of no place at all
    base, tile_of = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    base[s[of_source]] = p[of_source]
    tile_of[s] = tiles
    counts = np.zeros((len(terms.dictionary), len(names)), np.int64)
    prices = np.broadcast_to(base, counts.shape).copy()
    held = ~of_source
    at = t[held].astype(np.int64), s[held]
    counts[at], prices[at] = n[held], p[held]
    left, right = np.flatnonzero(tile_of == tile), np.flatnonzero(tile_of == other)
    value = priced(counts, prices, left, right)
    # terms of the block that no source of these tiles has: all have the price of no place
    absent = int(n[of_source].max()) - len(counts)
    value += absent * np.abs(base[left][:, None] - base[right][None, :])
    i, j = np.nonzero(np.ones_like(value) if tile != other else left[:, None] < right[None, :])
    return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "a": pa.array(names[left[i]], pa.string()), "b": pa.array(names[right[j]], pa.string()), "value": value[i, j]})


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): each source's distance to each other of its language, and the terms that it has more of than the language.

    Nulls: a null text, lang or source is ''. Repeated rows count as documents of their own. A group whose texts have no term is still compared; a language
    without a kept term gives distances of 0 and no terms. A lone source has no pairs. Very long texts are read whole, piece by
    piece. Ties are ranked by item in UTF-8 order. An empty table gives an empty result; other columns are ignored.
    """
    counts = written(term_counts(docs), "divergence-counts")
    groups = _named(docs).select("lang", "source").distinct()
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("n_docs").alias("n_docs")).where(F.col("n_docs") >= min_docs).drop("n_docs")
    cells = written(counts.drop("n_docs").join(kept, ["lang", "term"]), "divergence-kept")
    # a language's totals from its sources' rows: each kept term once for V
    terms = written(cells.groupBy("lang", "term").agg(F.sum("n").alias("n")), "divergence-terms")
    of_lang = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    of_group = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    tiles = groups.groupBy("lang").agg(F.ceil(F.count("*") / TILE_SOURCES).cast("int").alias("tiles"))
    own = groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").join(tiles, "lang")
    own = own.na.fill(0, ["total", "v", "lang_total"]).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / BLOCK_TERMS)).cast("int"))
    own = written(own.withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")), "divergence-groups")

    priced_cells = cells.join(own, ["lang", "source"]).withColumn("p", price(F.col("n"), F.col("total"), F.col("v")))
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")
    sizes = terms.join(own.select("lang", "blocks").distinct(), "lang").groupBy("lang", block).agg(F.count("*").alias("n"))
    of_terms = priced_cells.select("lang", block, "source", "term", "n", "p", "tile", "tiles")
    none = F.when(F.col("v") > 0, price(F.lit(0).cast("long"), F.col("total"), F.col("v"))).otherwise(0)
    of_sources = own.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", none.cast("long").alias("p"), "tile", "tiles")
    of_sources = of_sources.join(sizes, ["lang", "block"], "left").select("lang", "block", "source", F.lit(None).cast("string").alias("term"), F.coalesce("n", F.lit(0).cast("long")).alias("n"), "p", "tile", "tiles")
    met = of_terms.unionByName(of_sources).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.select("lang", "block", F.least("tile", "with").alias("tile_a"), F.greatest("tile", "with").alias("tile_b"), "source", "term", "n", "p", "tile")
    blocks = met.groupBy("lang", "block", "tile_a", "tile_b").applyInArrow(_price_block, "lang string, a string, b string, value long")
    sums = blocks.groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = sums.select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    q = price(F.col("n_lang"), F.col("lang_total"), F.col("v"))
    above = priced_cells.withColumn("value", F.col("p") - q).where(F.col("value") > 0)
    higher = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = higher.withColumn("rank", rank).where(F.col("rank") <= top_terms).unionByName(pairs.withColumn("rank", rank))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), t AS (SELECT row, lang, source, unnest(terms) AS term FROM d
), kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT row) >= 30
), of_lang AS (SELECT l.lang, count(k.term) AS v, coalesce(sum(k.n), 0) AS total FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept k USING (lang) GROUP BY l.lang
), groups AS (SELECT DISTINCT lang, source FROM d
), counts AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL
), full_counts AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT f.lang, f.source, f.term, f.n, (1 + (f.n + 5)::HUGEINT * 1000000000 // (f.total + 5 * l.v)::HUGEINT)::BIGINT AS p FROM full_counts f JOIN of_lang l USING (lang)
), q AS (
  SELECT k.lang, k.term, (1 + (k.n + 5)::HUGEINT * 1000000000 // (l.total + 5 * l.v)::HUGEINT)::BIGINT AS q FROM kept k JOIN of_lang l USING (lang)
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, p.p - q.q FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
