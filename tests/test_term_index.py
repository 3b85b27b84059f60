"""The stored term index against the one that is made anew for each search, and the snapshots it stands on."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from compare import spark_rows
from quarry.functions import text as T
from quarry.operators import evaluation
from quarry.operators.retrieval import Bm25Index
from quarry.plans import catalog
from quarry.sources import term_index
from quarry.sources.snapshots import Conflict, Snapshots
from quarry.sources.term_index import TermIndex


def corpus(n=300, seed=2):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeğıçö") for _ in range(r.randint(2, 9))) for _ in range(120)]
    texts = [" ".join(words[min(int(r.expovariate(0.06)), 119)] for _ in range(r.choice([0, 3, 10, 40, 400]))) for _ in range(n)]
    texts[5] = texts[6] = texts[7] = texts[50]  # copies tie
    return [(f"c{i:04d}", None if i == 9 else t) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, text string").repartition(3)


@pytest.fixture(scope="module")
def questions(spark):
    rows = [(i, " ".join(t.split()[: 4 + i % 9])) for i, (_, t) in enumerate(corpus(60, 2)) if t] + [(900, "nowhere"), (901, ""), (902, None)]
    return spark.createDataFrame(rows, "query_id long, query_text string")


def results(spark, questions, live, stem=True):
    return spark_rows(Bm25Index(frame(spark, live), stem=stem).search(questions, 7))


def test_adds_and_deletes_leave_what_a_new_index_has(spark, questions, tmp_path):
    rows = corpus()
    index = TermIndex(spark, f"file://{tmp_path}/index")
    found = lambda: spark_rows(index.search(questions, 7))
    assert found()[1] == [] and index.totals() == (0, 0)
    assert index.add(frame(spark, rows[:200])) == 200 and index.add(frame(spark, rows[:100])) == 0
    assert index.add(frame(spark, rows[150:] + rows[290:])) == 100 and found() == results(spark, questions, rows)
    gone = spark.createDataFrame([(rows[i][0],) for i in (*range(0, 300, 4), 5)] + [("none",), ("c0000",)], "chunk_id string")
    assert index.remove(gone) == 76 and index.remove(gone) == 0
    again = [("c0000", "abc new"), ("c0004", rows[4][1])]
    assert index.add(frame(spark, again)) == 2
    live = [x for i, x in enumerate(rows) if i % 4 and i != 5] + again
    expected = results(spark, questions, live)
    assert found() == expected and spark_rows(index.idf().select("term", "df", F.round("idf", 6).alias("idf"))) == spark_rows(Bm25Index(frame(spark, live)).idf.select("term", "df", F.round("idf", 6).alias("idf")))
    states = len(index.snapshots.numbers())
    index.compact()
    assert index.totals()[0] == len(live) and len(index.expire()) == 3 * 2 + 4 + 1 and states == 4 and found() == expected
    assert index.remove(index.live_ids()) == len(live) and found()[1] == []
    index.compact()
    assert index.totals() == (0, 0) and index.add(frame(spark, rows[:9])) == 9


def test_without_stems(spark, questions, tmp_path):
    index = TermIndex(spark, f"file://{tmp_path}/index", stem=False)
    index.add(frame(spark, corpus()[:150]))
    assert spark_rows(index.search(questions, 7)) == results(spark, questions, corpus()[:150], stem=False)


def test_questions_in_blocks_and_many_words(spark, questions, tmp_path, monkeypatch):
    index = TermIndex(spark, f"file://{tmp_path}/index")
    index.add(frame(spark, corpus()))
    whole = spark_rows(index.search(questions, 3))
    monkeypatch.setattr(term_index, "QUESTIONS", 10)
    monkeypatch.setattr(term_index, "PUSHED_TERMS", 2)
    assert spark_rows(index.search(questions, 3)) == whole and len(whole[1]) > 100


def test_ranges_that_cannot_reach_the_best_are_skipped(spark):
    """Rows of a range whose postings don't agree with its largest weight show whether it was scored."""
    import pyarrow as pa

    best = term_index._best(pa.table({"query_id": [1], "term": ["a"], "w": [2.0]}), 1, 10.0)
    row = lambda number, tf, top: {"segment": "s", "range": number, "term": "a", "docs": [number << term_index.RANGE_BITS], "tfs": [tf], "dls": [10], "top": top, "avgdl": 10.0}
    names = ["segment", "range", "term", "docs", "tfs", "dls", "top", "avgdl"]
    run = lambda rows: [x for b in best(iter([pa.RecordBatch.from_pylist(rows).select(names)])) for x in b.to_pylist()]
    assert [x["doc_no"] for x in run([row(0, 5, 0.9), row(1, 900, 0.1)])] == [0]
    assert [x["doc_no"] for x in run([row(0, 5, 0.9), row(1, 900, 1.0)])] == [1 << term_index.RANGE_BITS]


def test_stems_in_tasks_are_those_of_the_engine(spark):
    words = sorted({w for _, t in corpus() for w in (t or "").split()} | {"raporların", "güvenliğin", "kitabın", "standard", "kodun", "ab", "lerinden"})
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.light_stem(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in rows} == {w: T.stem_word(w) for w in words}


def test_one_of_two_writers_wins(spark, tmp_path):
    states = Snapshots(spark, f"file://{tmp_path}/s")
    assert states.latest() == (-1, {})
    assert states.commit(-1, {"a": 1}) == 0
    with pytest.raises(Conflict):
        states.commit(-1, {"a": 2})
    assert states.latest() == (0, {"a": 1}) and [x.name for x in (tmp_path / "s" / "snapshots").iterdir() if not x.name.endswith(".crc")] == ["000000000000.json"]
    once = []

    def make(state):
        if not once:
            once.append(states.commit(0, {"a": 5}))  # another writer comes first
        return {"a": state["a"] + 1}

    assert states.change(make) == {"a": 6} and states.numbers() == [0, 1, 2]
    assert states.change(lambda s: None) == {"a": 6}
    (tmp_path / "s" / "snapshots" / "000000000009.json.tmp").write_text("{")
    assert states.latest()[0] == 2


def test_a_lost_add_leaves_no_trace(spark, questions, tmp_path):
    index = TermIndex(spark, f"file://{tmp_path}/index")
    index.add(frame(spark, corpus()[:50]))
    before = spark_rows(index.search(questions, 3))
    index.snapshots.commit, kept = lambda *a: (_ for _ in ()).throw(RuntimeError("lost")), index.snapshots.commit
    with pytest.raises(RuntimeError, match="lost"):
        index.add(frame(spark, corpus()[:80]))
    index.snapshots.commit = kept
    assert spark_rows(index.search(questions, 3)) == before and index.add(frame(spark, corpus()[:80])) == 30


def test_holders_of_questions(spark):
    texts = ["ab cd ef gh", "xab cd ef ghy", "cd ef", "AB cd ef gh", "İb cd ef x", "", None, "q"]
    docs = spark.createDataFrame(list(enumerate(texts)), "page long, text string")
    q = ["ab cd ef gh", "cd ef", "cd", "b cd ef ", "İb cd ef", "no such words here", "q", "..."]
    got = evaluation.holders(spark.createDataFrame(list(enumerate(q)), "query_id long, query_text string"), docs)
    assert {(r.query_id, r.page) for r in got.collect()} == {(i, j) for i, x in enumerate(q) for j, t in enumerate(texts) if t is not None and x in t}


def test_an_index_of_a_table_is_built_once_a_version(spark, tmp_path):
    frame(spark, corpus()[:40]).selectExpr("cast(substring(chunk_id, 2) as long) AS doc_id", "text", "'s' AS source").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    one = catalog._index(spark, str(tmp_path))
    assert catalog._index(spark, str(tmp_path)).snapshots.numbers() == [0] and one.totals()[0] == 40
    assert catalog._index(spark, str(tmp_path), stem=False).path != one.path
    spark.createDataFrame([(99, "abc", "s")], "doc_id long, text string, source string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    two = catalog._index(spark, str(tmp_path))
    assert two.path != one.path and two.totals()[0] == 41


def test_rows_without_a_telling_word_are_not_scored(monkeypatch):
    class Add:
        cells = 0

        def __getattr__(self, name):
            return getattr(np.add, name)

        def reduceat(self, x, *args, **options):
            Add.cells += x.size
            return np.add.reduceat(x, *args, **options)

    class Numpy:
        add = Add()

        def __getattr__(self, name):
            return getattr(np, name)

    monkeypatch.setattr(term_index, "np", Numpy())
    width, n = 1 << term_index.RANGE_BITS, 50
    rows = []
    for r in range(n):  # common words in every row, a rare one in one row of a range
        docs = list(range(r * width, (r + 1) * width))
        rows += [("s", r, f"common{i}", docs, [1] * width, [40] * width, 0.4, 40.0) for i in range(6)] + [("s", r, "rare", docs[5:6], [1 + r % 7], [40], 0.9, 40.0)]
    names = "segment", "range", "term", "docs", "tfs", "dls", "top", "avgdl"
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, row)) for row in rows[a : a + 10]]) for a in range(0, len(rows), 10)]
    weights = pa.table({"query_id": [1] * 7, "term": [f"common{i}" for i in range(6)] + ["rare"], "w": [0.01] * 6 + [9.0]})
    found = pa.Table.from_batches(list(term_index._best(weights, 4, 40.0)(iter(batches)))).to_pylist()
    best = sorted(r * width + 5 for r in range(n) if r % 7 == 6)
    assert sorted(x["doc_no"] for x in found) == best
    assert Add.cells < 5 * 7 * width  # the whole of the first ranges, until four rows have the rare word
