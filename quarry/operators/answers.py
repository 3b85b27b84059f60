"""From ranked chunks to checked answers: context packing, citations, abstention, groundedness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import source_label, tr_contains, tr_lower

ABSTAIN_PHRASE = "Bu bilgi verilen dokümanlarda yok"  # fixed value


def pack_context(hits: DataFrame, budget: int) -> DataFrame:
    """Ranked hits (query_id, rank, token_count, ...) while their running token sum fits; the first one always stays."""
    so_far = F.sum("token_count").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return hits.withColumn("tokens_so_far", so_far).where((F.col("tokens_so_far") <= budget) | (F.col("rank") == 1))


def render_context(used: DataFrame) -> DataFrame:
    """query_id and the numbered context text of packed hits (text, file_name, page, section)."""
    part = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] (kaynak: "), source_label(F.col("file_name"), F.col("page"), F.col("section")), F.lit(")\n"), F.col("text"))
    rows = used.select("query_id", F.struct("rank", part.alias("part")).alias("p"))
    return rows.groupBy("query_id").agg(F.concat_ws("\n\n", F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"])).alias("context"))


def render_prompt(template: str, **values: Column) -> Column:
    """A template's {names} replaced; a name without a value is an error."""
    import string

    names = {n for _, n, _, _ in string.Formatter().parse(template) if n}
    if missing := names - values.keys():
        raise KeyError(f"no value for {sorted(missing)}")
    out = F.lit(template)
    for name in sorted(names):
        out = F.replace(out, F.lit("{" + name + "}"), values[name])
    return out


def markers(answer: Column) -> Column:
    """Distinct citation numbers in order of appearance; more than two digits are none."""
    return F.transform(F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,2})\]"), F.lit(1))), lambda m: m.cast("int"))


def valid_markers(answer: Column, n_used: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(markers(answer), lambda m: (m >= 1) & (m <= n_used))))


def invalid_markers(answer: Column, n_used: Column) -> Column:
    return F.array_distinct(F.filter(markers(answer), lambda m: (m < 1) | (m > n_used)))


def resolve_citations(answers: DataFrame, used: DataFrame) -> DataFrame:
    """One row per cited position: answers (query_id, text, abstained) against used (query_id, rank, ...); abstentions cite nothing."""
    cited = answers.where(~F.col("abstained")).select("query_id", F.explode(markers(F.col("text"))).alias("marker")).distinct()
    return cited.join(used.withColumnRenamed("rank", "marker"), ["query_id", "marker"], "left")


def answer_view(cited: DataFrame, preview_chars: int = 300) -> DataFrame:
    """Resolved citations (marker, chunk_id, text, file_name, page, section, score) as they are shown; unknown markers have no row."""
    return cited.where(F.col("chunk_id").isNotNull()).select(
        "query_id", "marker", "chunk_id", source_label(F.col("file_name"), F.col("page"), F.col("section")).alias("label"), F.round("score", 4).alias("score"), F.substring("text", 1, preview_chars).alias("preview")
    )


def abstained(answer: Column, phrase: str = ABSTAIN_PHRASE) -> Column:
    return tr_contains(answer, F.lit(phrase)) & (F.length(answer) < 3 * len(phrase))


def grounded(is_abstained: Column, n_citations: Column) -> Column:
    return is_abstained | (n_citations > 0)


def groundedness(verdict: Column) -> Column:
    """Supported / total from a judge's text; null without both numbers or with a total of zero."""
    number = lambda name: F.regexp_extract(verdict, rf"(?i){name}:\s*(\d+)", 1).try_cast("double")
    total, supported = number("TOPLAM"), number("DESTEKLENEN")
    return F.when((total > 0) & supported.isNotNull(), F.least(F.lit(1.0), supported / total))


def missing_phrases(answer: Column, needles: Column) -> Column:
    folded = tr_lower(answer)
    return F.filter(needles, lambda n: ~F.contains(folded, tr_lower(n)))


def found_phrases(answer: Column, needles: Column) -> Column:
    folded = tr_lower(answer)
    return F.filter(needles, lambda n: F.contains(folded, tr_lower(n)))


def contexts(queries: DataFrame, hits: DataFrame, budget: int) -> DataFrame:
    """queries with context and n_used of their packed hits; null and 0 for those without."""
    used = pack_context(hits, budget)
    context = render_context(used).join(used.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_used")), "query_id")
    return queries.join(context, "query_id", "left").withColumn("n_used", F.coalesce("n_used", F.lit(0)))


def answer_pipeline(queries: DataFrame, hits: DataFrame, llm, template: str, budget: int = 4096, judge=None, judge_template: str | None = None) -> DataFrame:
    """queries (query_id, query_text) and ranked hits with chunk columns -> query_id, text, abstained, citations, unknown_markers, error, groundedness.

    llm and judge: DataFrame(query_id, prompt) -> DataFrame(query_id, text), with an error column if they tell of errors (see CallTable). Queries
    without context never reach the llm. A question whose call failed has its error, no text and no citations. The judge reads answers that
    are no abstention, with their contexts; groundedness is null without it, and where it failed.
    """
    asked = contexts(queries, hits, budget)
    prompt = render_prompt(template, context=F.col("context"), question=F.col("query_text"), abstain_phrase=F.lit(ABSTAIN_PHRASE))
    told = llm(asked.where(F.col("context").isNotNull()).select("query_id", prompt.alias("prompt")))
    error = F.col("error") if "error" in told.columns else F.lit(None).cast("string").alias("error")
    out = asked.join(told.select("query_id", F.col("text").alias("told"), error), "query_id", "left")
    out = out.withColumn("text", F.when(F.col("error").isNull(), F.coalesce("told", F.lit(ABSTAIN_PHRASE + "."))))
    is_abstained = F.col("context").isNull() | F.coalesce(abstained(F.col("text")), F.lit(False))
    none, text = F.array().cast("array<int>"), F.coalesce("text", F.lit(""))
    out = out.select(
        "query_id", "text", is_abstained.alias("abstained"), F.when(is_abstained, none).otherwise(valid_markers(text, F.col("n_used"))).alias("citations"), invalid_markers(text, F.col("n_used")).alias("unknown_markers"), "error", "context"
    )
    if judge is None:
        return out.drop("context").withColumn("groundedness", F.lit(None).cast("double"))
    verdict = render_prompt(judge_template, context=F.col("context"), answer=F.col("text"))
    said = judge(out.where(~F.col("abstained") & F.col("text").isNotNull()).select("query_id", verdict.alias("prompt")))
    return out.join(said.select("query_id", groundedness(F.col("text")).alias("groundedness")), "query_id", "left").drop("context")
