"""Pair rerankers, kept calls, answers with errors and a judge, metrics of a running job."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import answers as A
from quarry.operators import rerank, retrieval
from quarry.sources import snapshots
from quarry.sources.calls import CallTable


def loaders():
    """Made here, so that they go to the workers by value."""

    def longest_first():
        return lambda questions, texts: [float(len(t)) for t in texts]

    def absent():
        raise ImportError("no such model")

    def none():
        return None

    def checks_batches():
        def score(questions, texts):
            assert 0 < len(texts) <= 4 and max(map(len, texts)) - min(map(len, texts)) <= 60  # of like length
            return [float(len(t)) for t in texts]

        return score

    return {f.__name__: f for f in (longest_first, absent, none, checks_batches)}


LOADERS = loaders()


@pytest.fixture(scope="module")
def found(spark):
    questions = spark.createDataFrame([(1, "q1"), (2, None), (3, "q3")], "query_id long, query_text string")
    texts = spark.createDataFrame([(f"c{i}", None if i == 7 else "x" * (i * 37 % 90)) for i in range(40)], "chunk_id string, text string")
    rows = [(q, f"c{i}", 1.0 / r, r, "fused", r % 3) for q in (1, 2, 3) for r, i in enumerate(range(q, 40, q), 1)]
    return questions, texts, spark.createDataFrame(rows, "query_id long, chunk_id string, score double, rank long, stage string, retriever_hits int"), rows


@pytest.mark.parametrize("load", ["longest_first", "checks_batches"])
def test_pairs_rerank(spark, found, load):
    questions, texts, candidates, rows = found
    got = rerank.PairReranker(LOADERS[load], questions, texts, batch_size=4, min_score=30.0)(candidates, 5).collect()
    size = lambda c: 0 if c == "c7" else int(c[1:]) * 37 % 90
    for q in (1, 2, 3):
        best = sorted((r for r in rows if r[0] == q and size(r[1]) >= 30), key=lambda r: (-size(r[1]), r[3]))[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [(r.chunk_id, r.score, r.rank, r.stage, r.retriever_hits) for r in mine] == [(c, float(size(c)), i, "reranked", h) for i, (_, c, _, _, _, h) in enumerate(best, 1)]


@pytest.mark.parametrize("load", ["absent", "none"])
def test_without_a_model_the_former_order_stays(found, load):
    questions, texts, candidates, rows = found
    got = sorted(rerank.PairReranker(LOADERS[load], questions, texts, min_score=9.0)(candidates, 4).collect(), key=lambda r: (r.query_id, r.rank))
    assert [(r.query_id, r.chunk_id, r.score, r.rank, r.stage) for r in got] == [(q, c, s, k, st) for q, c, s, k, st, _ in rows if k <= 4]


def test_a_reranked_list_nests(found):
    questions, texts, candidates, rows = found
    inner = lambda q, k: rerank.PairReranker(LOADERS["longest_first"], questions, texts)(candidates.where(F.col("rank") <= 30), k)
    plain = lambda q, k: candidates.where(F.col("rank") <= k)
    out = retrieval.hybrid([inner, plain], questions, 5, 10)
    assert {r.query_id for r in out.collect()} == {1, 2, 3} and out.where("retriever_hits > 1").count() > 0


def test_a_prompt_is_asked_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def ask(prompt, key):
        (log / f"{key}-{len(list(log.glob(key + '*')))}").write_text(prompt)
        if "bad" in prompt:
            raise ValueError("no")
        return prompt.upper()

    table = CallTable(spark, f"file://{tmp_path}/calls", "m", ask, wave=3)
    prompts = spark.createDataFrame([(i, f"p{i % 7}") for i in range(20)] + [(20, "bad"), (21, None)], "query_id long, prompt string")
    first = {r.query_id: (r.text, r.error) for r in table(prompts).collect()}
    assert first == {**{i: (f"P{i % 7}", None) for i in range(20)}, 20: (None, "ValueError: no"), 21: (None, None)} and len(list(log.iterdir())) == 8
    again = CallTable(spark, f"file://{tmp_path}/calls", "m", ask)
    assert {r.query_id: (r.text, r.error) for r in again(prompts).collect()} == first
    assert len(list(log.iterdir())) == 9  # the failed one alone
    assert CallTable(spark, f"file://{tmp_path}/calls", "other", ask)(prompts.where("query_id = 0")).first().text == "P0" and len(list(log.iterdir())) == 10


def test_answers_with_errors_and_a_judge(spark):
    queries = spark.createDataFrame([(i, f"q{i}") for i in range(4)], "query_id long, query_text string")
    hits = spark.createDataFrame([(i, 1, 10, "bir metin", "f.pdf", 1, "") for i in range(3)], "query_id long, rank long, token_count long, text string, file_name string, page int, section string")
    llm = lambda df: df.select("query_id", F.when(F.col("query_id") == 0, "yanıt [1] [3]").when(F.col("query_id") == 2, A.ABSTAIN_PHRASE).alias("text"), F.when(F.col("query_id") == 1, "Timeout").alias("error"))
    judge = lambda df: df.select("query_id", F.concat(F.lit("Toplam: 20000000000 desteklenen: 5000000000 "), "prompt").alias("text"))
    rows = {r.query_id: r for r in A.answer_pipeline(queries, hits, llm, "{context} {question} {abstain_phrase}", judge=judge, judge_template="{answer}|{context}").collect()}
    assert (rows[0].citations, rows[0].unknown_markers, rows[0].groundedness, rows[0].error) == ([1], [3], 0.25, None)
    assert (rows[1].text, rows[1].abstained, rows[1].citations, rows[1].groundedness, rows[1].error) == (None, False, [], None, "Timeout")
    assert rows[2].abstained and rows[2].groundedness is None and rows[3].abstained and rows[3].text == A.ABSTAIN_PHRASE + "."


def test_metrics_come_from_the_job_that_writes(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("observed", "")
    try:
        rows, seen = snapshots.observed(spark.range(100).withColumn("x", F.col("id") * 2), "rows", n=F.count(F.lit(1)), top=F.max("x"))
        assert (seen["n"], seen["top"]) == (100, 198) and seen["seconds"] > 0
        assert len(tracker.getJobIdsForGroup("observed")) == 1
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert rows.count() == 100
