"""Spelling variants, found by k-d trees over letter counts.

A word is a point: how often it has each letter. One inserted or deleted letter moves it by 1 in one
coordinate, one replaced letter by 1 up in one and by 1 down in another, so near words lie at L1 distance
1 or 2. Words of each length have a k-d tree of their own and two searches: by words of the same length (one
up, one down) and by words one letter shorter (one up). A search goes into every box that such a step can
reach, and what it finds there is kept if the order of the letters agrees too.

The upper part of each tree is made from a bounded sample that only steers where the cuts lie: each word goes
to the cell that holds it, and as a visitor to each other cell that its searches reach. In a cell a tree over
the words that are there does the rest. Every word is in one cell, so each pair is found once for each
search that finds it. Letters are those of Latin-1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import id_and_text, written

LEAST_LENGTH, LEAST_COUNT, EVERY, FORM_FACTOR = 7, 2, 31, 10
#: a-z and the letters from U+00C0 to U+00FF.
LETTERS = 26 + 64
#: Words of a cell as it is planned, and letters in it at most if its words are long.
CELL_WORDS, CELL_LETTERS = 4096, 2**22
#: The sample that steers the cuts: so many words a cell, and so many in all; and cells of all lengths together at most.
SAMPLE_PER_CELL, SAMPLE_WORDS, CELLS = 32, 2**20, 2**16
#: Words of a leaf of the tree inside a cell; pairs that a leaf of equal vectors compares one by one.
LEAF_WORDS, LEAF_PAIRS = 48, 2**16
_FAR = np.iinfo(np.int32).max


def codes_of(words: list[str]) -> np.ndarray:
    """Letters of words that have one length, a row each."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def counts_of(codes: np.ndarray) -> np.ndarray:
    """How often each row has each letter."""
    dims = np.where(codes < 0xC0, codes.astype(np.int64) - 97, codes.astype(np.int64) - 0xC0 + 26)
    at = np.arange(len(codes), dtype=np.int64)[:, None] * LETTERS + dims
    return np.bincount(at.ravel(), minlength=len(codes) * LETTERS).reshape(len(codes), LETTERS).astype(np.int32)


@dataclass
class Tree:
    """A k-d tree: a box a node, two children or a leaf's number (children -1); leaves hold the rows they were made of."""

    low: list[np.ndarray] = field(default_factory=list)
    high: list[np.ndarray] = field(default_factory=list)
    children: list[tuple[int, int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    rows: list[np.ndarray] = field(default_factory=list)

    def add(self, low: np.ndarray, high: np.ndarray) -> int:
        self.low.append(low)
        self.high.append(high)
        self.children.append((-1, -1))
        self.leaf.append(-1)
        return len(self.low) - 1

    def search(self, q: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each leaf that rows of q reach by at most up letters more and down letters less, with those rows."""
        stack = [(0, np.arange(len(q)))]
        while stack:
            node, at = stack.pop()
            here = q[at]
            more = np.maximum(self.low[node] - here, 0).sum(1)
            less = np.maximum(here - self.high[node], 0).sum(1)
            at = at[(more <= up) & (less <= down)]
            if len(at) == 0:
                continue
            if self.leaf[node] >= 0:
                yield self.leaf[node], at
            else:
                stack += [(child, at) for child in self.children[node]]


def grown(points: np.ndarray, leaf_size: int, tight: bool) -> Tree:
    """A tree over the rows of points. tight: boxes hug their points; else they fill all space, so that any vector has one leaf."""
    tree, n_dims = Tree(), points.shape[1]
    box = lambda rows: (points[rows].min(0), points[rows].max(0))
    every = np.arange(len(points))
    low, high = box(every) if tight else (np.zeros(n_dims, np.int32), np.full(n_dims, _FAR, np.int32))
    stack = [(tree.add(low, high), every)]
    while stack:
        node, rows = stack.pop()
        own = points[rows]
        spread = own.var(0) if len(rows) > leaf_size else np.zeros(1)
        if spread.max() == 0:
            tree.leaf[node] = len(tree.rows)
            tree.rows.append(rows)
            continue
        dim = int(spread.argmax())
        x = own[:, dim]
        cut = min(int(np.median(x)), int(x.max()) - 1)
        sides = []
        for is_left in (True, False):
            side = rows[(x <= cut) == is_left]
            if tight:
                low, high = box(side)
            else:
                low, high = tree.low[node].copy(), tree.high[node].copy()
                (high if is_left else low)[dim] = cut if is_left else cut + 1
            sides.append((tree.add(low, high), side))
        tree.children[node] = sides[0][0], sides[1][0]
        stack += sides
    return tree


@dataclass
class Cells:
    """The upper part of a length's tree. first: number of its first cell; parts: in how many a leaf of one vector is dealt by hash."""

    tree: Tree
    first: list[int]
    parts: list[int]


def planned(sample: list[str], share: float) -> dict[int, Cells]:
    """Cells by length from a sample that has this share of all words."""
    by_length: dict[int, list[str]] = {}
    for w in sample:
        by_length.setdefault(len(w), []).append(w)
    out, number = {}, 0
    for length in sorted(by_length):
        own = by_length[length]
        size = max(1, int(max(1, min(CELL_WORDS, CELL_LETTERS // length)) * share))
        tree = grown(counts_of(codes_of(own)), size, tight=False)
        cells = Cells(tree, [], [])
        for rows in tree.rows:
            cells.first.append(number)
            cells.parts.append(max(1, math.ceil(len(rows) / (16 * size))))
            number += cells.parts[-1]
        tree.rows = [rows[:0] for rows in tree.rows]
        out[length] = cells
    return out


def _length_groups(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths):
        yield int(length), np.flatnonzero(lengths == length)


#: What a row is to its cell: one of its words, a visitor of the same length, or one that is a letter shorter.
HOME, SAME, SHORTER = 0, 1, 2


def _to_cells(plan: dict[int, Cells]):
    schema = pa.schema([("cell", pa.int64()), ("kind", pa.int8()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            salts = batch.column(2).to_numpy()
            at, cell, kind = [], [], []

            def put(rows: np.ndarray, cells: np.ndarray, what: int) -> None:
                at.append(rows)
                cell.append(cells)
                kind.append(np.full(len(rows), what, np.int8))

            for length, rows in _length_groups(words):
                q = counts_of(codes_of([words[i] for i in rows]))
                if length not in plan:  # no sampled word: one cell for the length
                    put(rows, np.full(len(rows), -length), HOME)
                else:
                    p = plan[length]
                    home = np.full(len(rows), -1)
                    for leaf, i in p.tree.search(q, 0, 0):
                        home[i] = p.first[leaf] + salts[rows[i]] % p.parts[leaf]
                    put(rows, home, HOME)
                    for leaf, i in p.tree.search(q, 1, 1):
                        for part in range(p.parts[leaf]):
                            c = p.first[leaf] + part
                            away = i[home[i] != c]
                            put(rows[away], np.full(len(away), c), SAME)
                if length + 1 not in plan:
                    put(rows, np.full(len(rows), -length - 1), SHORTER)
                else:
                    p = plan[length + 1]
                    for leaf, i in p.tree.search(q, 1, 0):
                        for part in range(p.parts[leaf]):
                            put(rows[i], np.full(len(i), p.first[leaf] + part), SHORTER)
            if at:
                i = np.concatenate(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(cell)), pa.array(np.concatenate(kind)), batch.column(0).take(pa.array(i)), pa.array(counts[i])], schema=schema
                )

    return run


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ at one place."""
    return (a != b).sum(1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether rows of long are those of short and one letter more somewhere: equal starts and equal ends together make up the short row."""
    n = short.shape[1]
    front, back = short != long[:, :n], (short != long[:, 1:])[:, ::-1]
    heads = np.where(front.any(1), front.argmax(1), n)
    tails = np.where(back.any(1), back.argmax(1), n)
    return heads + tails >= n


def _by_lookup(queries: list[str], words: list[str], step: np.ndarray) -> tuple[list[int], list[int]]:
    """Pairs (query, word) one edit apart, where all words have one vector and step leads to it: each edited query is looked up."""
    place = {w: i for i, w in enumerate(words)}
    letter = lambda d: chr(d + 97) if d < 26 else chr(d - 26 + 0xC0)
    new = letter(int(np.flatnonzero(step == 1)[0]))
    gone = np.flatnonzero(step == -1)
    old = letter(int(gone[0])) if len(gone) else None
    a, b = [], []
    for i, q in enumerate(queries):
        if old is None:
            edited = {q[:k] + new + q[k:] for k in range(len(q) + 1)}
        else:
            edited = {q[:k] + new + q[k + 1 :] for k, c in enumerate(q) if c == old}
        found = [place[e] for e in edited if e in place]
        a += [i] * len(found)
        b += found
    return a, b


def near_in_cell(home: list[str], visitors: list[str], shorter: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(visitor, home word) pairs of one edit; all home words have one length, and so have the visitors, which may be the same words."""
    if not home or not visitors:
        return
    words, queries = codes_of(home), codes_of(visitors)
    p, q = counts_of(words), counts_of(queries)
    used = np.flatnonzero(p.any(0) | q.any(0))
    p, q = np.ascontiguousarray(p[:, used]), np.ascontiguousarray(q[:, used])
    kind = np.float32 if words.shape[1] < 2000 else np.float64  # squares stay exact
    pf, qf = p.astype(kind), q.astype(kind)
    pp, qq = (pf * pf).sum(1), (qf * qf).sum(1)
    want = 1 if shorter else 2  # the square of the distance: one step up, or one up and one down
    tree = grown(p, LEAF_WORDS, tight=True)
    for leaf, at in tree.search(q, 1, 0 if shorter else 1):
        rows = tree.rows[leaf]
        if len(rows) > LEAF_WORDS:  # equal vectors, which no cut parts
            steps = p[rows[0]] - q[at]
            at = at[np.abs(steps).sum(1) == want]
            if len(at) * len(rows) > LEAF_PAIRS:
                steps = p[rows[0]] - q[at]
                for step in np.unique(steps, axis=0):
                    own = at[(steps == step).all(1)]
                    full = np.zeros(LETTERS, np.int32)
                    full[used] = step
                    a, b = _by_lookup([visitors[i] for i in own], [home[i] for i in rows], full)
                    yield own[a], rows[b]
                continue
        for start in range(0, len(at), 4096):
            part = at[start : start + 4096]
            i, j = np.nonzero(qq[part][:, None] + pp[rows][None, :] - 2 * (qf[part] @ pf[rows].T) == want)
            i, j = part[i], rows[j]
            good = one_inserted(queries[i], words[j]) if shorter else one_replaced(queries[i], words[j])
            if good.any():
                yield i[good], j[good]


class _Best:
    """Near words counted for each word of a list, and the first of them in another list."""

    def __init__(self, n: int):
        self.count, self.first = np.zeros(n, np.int64), np.full(n, _FAR, np.int64)

    def add(self, own: np.ndarray, other: np.ndarray) -> None:
        self.count += np.bincount(own, minlength=len(self.count))
        np.minimum.at(self.first, own, other)


def _search_cell(key: tuple, rows: pa.Table) -> pa.Table:
    kind, n = rows.column("kind").to_numpy(), rows.column("n").to_numpy()
    word = np.array(rows.column("word").to_pylist(), dtype=object)
    order = np.lexsort((word.astype(str), -n))  # the first of any near words is the form that counts
    kind, n, word = kind[order], n[order], word[order]
    home, same, shorter = (np.flatnonzero(m) for m in (kind == HOME, kind != SHORTER, kind == SHORTER))
    out = []

    def put(own: np.ndarray, other: np.ndarray, best: _Best, whole: bool) -> None:
        keep = np.arange(len(own)) if whole else np.flatnonzero(best.count)
        some = best.count[keep] > 0
        at = other[np.where(some, best.first[keep], 0)] if len(other) else np.zeros(len(keep), int)
        out.append(
            pa.table({"word": pa.array(word[own[keep]], pa.string()), "n": pa.array(n[own[keep]], pa.int64()), "n_near": pa.array(best.count[keep], pa.int64()),
                      "best_n": pa.array(n[at], pa.int64(), mask=~some), "best": pa.array(word[at], pa.string(), mask=~some)})
        )

    by_same, by_shorter, longer = _Best(len(same)), _Best(len(shorter)), _Best(len(home))
    for i, j in near_in_cell(list(word[home]), list(word[same]), False):
        by_same.add(i, j)
    for i, j in near_in_cell(list(word[home]), list(word[shorter]), True):
        by_shorter.add(i, j)
        longer.add(j, i)
    put(same, home, by_same, False)
    put(shorter, home, by_shorter, False)
    put(home, shorter, longer, True)
    return pa.concat_tables(out)


def near_words(words: DataFrame) -> DataFrame:
    """For each row of words (word, n; each word once): n_near, how many others are one edit away, and the most frequent of them (best, best_n; ties: the smallest).

    Memory: a cell has about CELL_WORDS words and its visitors; a vector that more words share (anagrams) is dealt
    over several cells, which its visitors all see. Above CELLS cells in all, cells grow instead.
    """
    total = words.count()
    cells = min(CELLS, max(1, math.ceil(total / CELL_WORDS)))
    share = min(1.0, cells * SAMPLE_PER_CELL / max(1, total), SAMPLE_WORDS / max(1, total))
    if total <= SAMPLE_PER_CELL * CELL_WORDS:
        share = 1.0
    sample = [r[0] for r in words.where(F.pmod(F.xxhash64("word", F.lit("sample")), F.lit(2**20)) < int(share * 2**20)).select("word").collect()]
    plan = planned(sample, share)
    rows = words.select("word", "n", F.pmod(F.xxhash64("word"), F.lit(2**31)).alias("salt"))
    found = rows.mapInArrow(_to_cells(plan), "cell long, kind byte, word string, n long").groupBy("cell").applyInArrow(_search_cell, "word string, n long, n_near long, best_n long, best string")
    best = F.min(F.when(F.col("best_n").isNotNull(), F.struct((-F.col("best_n")).alias("n"), "best")))
    return found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n", "n_near", F.col("b.best").alias("best"), (-F.col("b.n")).alias("best_n"))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): runs of letters of whole texts, A-Z lower-cased, one letter left out where the contract's checksum says so, of LEAST_LENGTH letters and LEAST_COUNT places at least."""
    run = F.translate(F.col("run"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # a run of fewer letters than LEAST_LENGTH can't become a word
    runs = id_and_text(docs).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(rf"([A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}})"), 1)).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    place = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.expr("substring(run, 1, cast(h % length(run) as int))"), F.col("run").substr(place + 2, F.length("run")))
    words = runs.select("id", run.alias("run")).withColumn("h", h).select(F.when(F.col("h") % EVERY == 0, short).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def group_variants(words: DataFrame, factor: int = FORM_FACTOR) -> DataFrame:
    """Rows of words (word, n; each word once) with form, root, n_near and form_n.

    A form is a word's most frequent near word if that has factor times its count or more; forms are followed to the last. Counts
    grow by the factor at each step, so a chain has at most log(largest count) steps and a few rounds of doubling end it.
    """
    counted = written(near_words(words), "spelling-near")
    has_form: Column = F.col("best_n") >= factor * F.col("n")
    forms = counted.where(has_form).select("word", F.col("best").alias("root"))
    most = counted.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.floor(math.log(most) / math.log(factor)))
    reach = 1
    while reach < steps:
        on = forms.select(F.col("word").alias("root"), F.col("root").alias("next"))
        forms = written(forms.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
        reach *= 2
    out = counted.join(forms, "word", "left")
    return out.select("word", F.when(has_form, F.col("best")).alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", F.when(has_form, F.col("best_n")).alias("form_n"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """One row per word of docs: word, form, root, n, n_near, form_n.

    Nulls: a null text has no words; a null doc_id is an empty string before the checksum's colon. Repeated rows count again. Empty texts and
    empty tables have no words; very long texts and words are read whole. Ties among near words go to the smallest. Other columns are ignored.
    """
    return group_variants(written(count_words(docs), "spelling-words"))


#: The checksum is CRC-32 (reflected polynomial 0xEDB88320), byte by byte; near words meet by what is left without one letter.
SQL = r"""
WITH RECURSIVE bits AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents
), hexed AS (
  SELECT run, hex(encode(id || ':' || run)) AS x FROM runs WHERE length(run) >= 7
), summed AS (
  SELECT run, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: ('0x' || x[i:i + 1])::BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS h FROM hexed, bits
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, count(*) AS n FROM summed GROUP BY 1 HAVING count(*) >= 2 AND length(word) >= 7
), less AS (
  SELECT DISTINCT word, n, k, word[1:k - 1] || word[k + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)
), pairs AS (
  SELECT a.word, b.word AS other FROM less a JOIN less b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
  UNION SELECT a.rest, a.word FROM less a JOIN words w ON a.rest = w.word
  UNION SELECT a.word, a.rest FROM less a JOIN words w ON a.rest = w.word
), best AS (
  SELECT p.word, count(*) AS n_near, first(p.other ORDER BY o.n DESC, p.other) AS other, max(o.n) AS other_n FROM pairs p JOIN words o ON p.other = o.word GROUP BY p.word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS at FROM formed
  UNION ALL
  SELECT walk.word, f.form FROM walk JOIN formed f ON walk.at = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN walk w USING (word) JOIN formed l ON l.word = w.at AND l.form IS NULL
"""
