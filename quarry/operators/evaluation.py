"""Retrieval and answer evaluation: metrics per question, summary, diagnosis, validation of the question set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import raw_tokens
from quarry.operators.answers import found_phrases, missing_phrases, resolve_citations
from quarry.sources.snapshots import written

MEANS_ANSWERABLE = ("recall", "hit_rate", "mrr", "precision")


def holders(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """questions (query_id, query_text) joined with the docs (text, ...) whose text holds theirs.

    A text that holds the question has all its words whole, but for the first and the last. So a question meets only
    documents with the rarest of its inner words, by an equi-join; a question without an inner word meets all, in
    blocks. A document that repeats a row counts as often as it is there.
    """
    rows = docs.withColumn("at", F.monotonically_increasing_id())
    rows = written(rows, "held")
    words = raw_tokens(F.col("query_text"))
    inner = F.array_distinct(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))))
    asked = questions.where("query_text IS NOT NULL").select("query_id", "query_text", inner.alias("inner"))
    wanted = asked.select("query_id", F.explode("inner").alias("word"))
    held = rows.select("at", F.explode(F.array_distinct(raw_tokens(F.col("text")))).alias("word")).join(wanted.select("word").distinct(), "word", "left_semi")
    held = written(held, "holding")
    df = held.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    rarest = wanted.join(df, "word", "left").groupBy("query_id").agg(F.min_by("word", F.struct(F.coalesce("df", F.lit(0)), "word")).alias("word"))
    pairs = rarest.join(held, "word").select("query_id", "at").join(asked.select("query_id", "query_text"), "query_id").join(rows, "at")
    found = pairs.where(F.contains("text", "query_text")).drop("at")
    short = asked.where(F.size("inner") == 0).select("query_id", "query_text")
    blocks = max(1, -(-short.count() // 256))
    met = [rows.crossJoin(F.broadcast(short.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b))).where(F.contains("text", "query_text")).drop("at") for b in range(blocks)] if short.head(1) else []
    return reduce(DataFrame.unionByName, [found, *met])


def source_matches(retrieved: DataFrame, expected: DataFrame) -> DataFrame:
    """retrieved (query_id, rank, file_name, page) with is_relevant: an expected row has the file and its page or no page."""
    files = expected.where("page IS NULL").select("query_id", "file_name", F.lit(True).alias("by_file")).distinct()
    pages = expected.where("page IS NOT NULL").select("query_id", "file_name", "page", F.lit(True).alias("by_page")).distinct()
    out = retrieved.join(files, ["query_id", "file_name"], "left").join(pages, ["query_id", "file_name", "page"], "left")
    return out.withColumn("is_relevant", F.coalesce("by_file", "by_page", F.lit(False))).drop("by_file", "by_page")


def retrieval_metrics(questions: DataFrame, expected: DataFrame, retrieved: DataFrame, k: int) -> DataFrame:
    """Per question: recall and precision within k, hit, reciprocal rank over the whole list."""
    marked = source_matches(retrieved, expected)
    per_hit = marked.groupBy("query_id").agg(
        F.min(F.when(F.col("is_relevant"), F.col("rank"))).alias("first_relevant_rank"),
        F.coalesce(F.avg(F.when(F.col("rank") <= k, F.col("is_relevant").cast("double"))), F.lit(0.0)).alias("precision"),
    )
    top = retrieved.where(F.col("rank") <= k).select("query_id", "file_name", F.col("page").alias("got"))
    one = expected.distinct().join(top, ["query_id", "file_name"], "left").withColumn("found", F.col("got").isNotNull() & (F.col("page").isNull() | (F.col("page") == F.col("got"))))
    recall = one.groupBy("query_id", "file_name", "page").agg(F.bool_or("found").alias("found")).groupBy("query_id").agg(F.avg(F.col("found").cast("double")).alias("recall"))
    out = questions.join(per_hit, "query_id", "left").join(recall, "query_id", "left")
    first = F.col("first_relevant_rank")
    return out.select(
        *questions.columns, first.cast("long").alias("first_relevant_rank"), F.coalesce("recall", F.lit(0.0)).alias("recall"), F.coalesce("precision", F.lit(0.0)).alias("precision"),
        F.coalesce(first <= k, F.lit(False)).alias("hit"), F.coalesce(1 / first, F.lit(0.0)).alias("reciprocal_rank"),
    )


def summary(results: DataFrame) -> DataFrame:
    """One row: means over answerable questions, and over all where the metric concerns all."""
    answerable = F.col("kind") == "answerable"
    over = lambda c, name: F.coalesce(F.avg(F.when(answerable, F.col(c).cast("double"))), F.lit(0.0)).alias(name)
    every = lambda c, name: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(name)
    return results.agg(
        F.count(F.lit(1)).alias("n_questions"), F.count(F.when(answerable, 1)).alias("n_answerable"), over("recall", "recall"), over("hit", "hit_rate"), over("reciprocal_rank", "mrr"), over("precision", "precision"),
        over("cited", "citation_rate"), over("citations_correct", "citation_accuracy"), over("facts_ok", "fact_accuracy"), every("abstention_correct", "abstention_accuracy"), every("hallucinated", "hallucination_rate"), every("passed", "pass_rate"),
    )


def judged(results: DataFrame) -> DataFrame:
    """Adds abstention_correct, hallucinated, cited, passed from kind, abstained, forbidden, n_citations, facts_ok, citations_correct."""
    answerable = F.col("kind") == "answerable"
    out = results.withColumn("abstention_correct", F.when(answerable, ~F.col("abstained")).otherwise(F.col("abstained")))
    out = out.withColumn("hallucinated", (~answerable & ~F.col("abstained")) | F.col("forbidden"))
    out = out.withColumn("cited", ~answerable | (F.col("n_citations") > 0))
    return out.withColumn("passed", F.col("abstention_correct") & ~F.col("hallucinated") & F.col("facts_ok") & F.col("cited") & F.col("citations_correct"))


def wrong_citations(cited: DataFrame, expected: DataFrame) -> DataFrame:
    """Resolved citations (query_id, marker, file_name, page, ...) whose source is none of the expected ones, for questions that expect some."""
    asked = cited.where(F.col("file_name").isNotNull()).join(expected.select("query_id").distinct(), "query_id", "left_semi")
    return source_matches(asked, expected).where(~F.col("is_relevant")).drop("is_relevant")


def evaluate(questions: DataFrame, expected: DataFrame, used: DataFrame, answers: DataFrame, k: int) -> DataFrame:
    """One judged row a question, measured on the chunks that the answer was made from; nothing is retrieved a second time.

    questions: query_id, kind, must_contain, must_not_contain (arrays); used: query_id, rank, chunk_id, file_name, page;
    answers: query_id, text, abstained. A question without an answer counts as an abstention.
    """
    cited = resolve_citations(answers, used).where(F.col("file_name").isNotNull())
    n = cited.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_citations"))
    wrong = wrong_citations(cited, expected).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_wrong"))
    out = retrieval_metrics(questions, expected, used, k).join(answers.select("query_id", "text", "abstained"), "query_id", "left").join(n, "query_id", "left").join(wrong, "query_id", "left")
    text, no_phrases = F.coalesce("text", F.lit("")), F.array().cast("array<string>")
    out = out.withColumn("abstained", F.coalesce("abstained", F.lit(True))).withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_citations", "n_wrong")})
    out = out.withColumn("facts_ok", (F.col("kind") != "answerable") | (F.size(missing_phrases(text, F.coalesce("must_contain", no_phrases))) == 0))
    out = out.withColumn("forbidden", F.size(found_phrases(text, F.coalesce("must_not_contain", no_phrases))) > 0)
    return judged(out.withColumn("citations_correct", F.col("n_wrong") == 0))


def failures(results: DataFrame) -> DataFrame:
    return results.where(~F.col("passed"))


def diagnosis(row: DataFrame) -> DataFrame:
    """Names of the rules that a summary row breaks, in order; "none" if no rule is broken."""
    # fixed values: the rules' thresholds
    rules = [
        ("hallucination", "hallucination_rate > 0"),
        ("retrieval", "hit_rate < 0.8"),
        ("ranking", "hit_rate >= 0.8 AND mrr < 0.5 AND hit_rate >= 0.5"),
        ("noise", "precision < 0.4 AND hit_rate >= 0.8"),
        ("wrong_citations", "citation_accuracy < 0.9"),
        ("missing_citations", "citation_rate < 0.9"),
        ("lost_facts", "fact_accuracy < 0.8 AND hit_rate >= 0.8"),
    ]
    found = F.filter(F.array(*[F.when(F.expr(test), F.lit(name)) for name, test in rules]), lambda x: x.isNotNull())
    return row.select(F.posexplode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("none")))).alias("at", "finding"))


def golden_problems(questions: DataFrame) -> DataFrame:
    """Problems of a question set: questions (id, kind, n_sources, n_must_contain) -> (id, problem)."""
    of = lambda df, name: df.select(F.col("id"), F.lit(name).alias("problem"))
    parts = [
        of(questions.groupBy("id").count().where("count > 1"), "duplicate_id"),
        of(questions.where("kind = 'answerable' AND n_sources = 0"), "answerable_without_source"),
        of(questions.where("kind = 'unanswerable' AND n_sources > 0"), "unanswerable_with_source"),
        of(questions.where("kind = 'unanswerable' AND n_must_contain > 0"), "unanswerable_with_facts"),
        of(questions.agg(F.count(F.when(F.col("kind") == "unanswerable", 1)).alias("n")).where("n = 0").withColumn("id", F.lit(None).cast("string")), "no_negative_example"),
    ]
    return reduce(DataFrame.unionByName, parts)
