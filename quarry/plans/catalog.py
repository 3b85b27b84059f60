"""The engine's own queries by name, with their DuckDB SQL.

A document is a page (file_name = source, page = doc_id), benchmark items are questions, and a question
is answerable if some document holds its text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.embedding import HashingEmbedder
from quarry.operators import answers as A
from quarry.operators import chunking, evaluation, library, neighbours, rerank, retrieval
from quarry.sources import snapshots, store
from quarry.sources.calls import CallTable
from quarry.sources.collection import Collection, ingest_stream, stream_id
from quarry.sources.term_index import TermIndex
from quarry.streaming import pieces as streams

TOP, FETCH = 3, 20


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark, d):
    return _table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("source").alias("file_name"), F.col("doc_id").alias("page"))


def _questions(spark, d):
    return _table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def _index(spark, d, stem=True):
    """The stored term index of all documents in their present version: the first query that wants it builds it, later ones find it."""
    index = TermIndex(spark, f"{snapshots.shared_dir(spark)}/quarry/terms-{snapshots.version(_table(spark, d, 'documents'))}-{'stems' if stem else 'words'}", stem)
    if index.snapshots.latest()[0] < 0:
        index.add(_docs(spark, d))
    return index


def _bm25(spark, d, k):
    """Hits of all questions, written once: whatever asks for them again reads them."""
    return snapshots.written(_index(spark, d).search(_questions(spark, d), k), "hits")


def _vectors(spark, d):
    v = _table(spark, d, "embeddings")
    return v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")), v.select(F.col("vec_id").alias("chunk_id"), "embedding")


def tr_tokenize_stats(spark, d):
    """Tokens and distinct tokens per document."""
    t = T.raw_tokens(F.col("text"))
    return _docs(spark, d).select(F.col("chunk_id").alias("doc_id"), F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


def stem_vocabulary(spark, d):
    """Every distinct token with its stem and document frequency."""
    rows = _docs(spark, d).select("chunk_id", F.explode(F.array_distinct(T.raw_tokens(F.col("text")))).alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).withColumn("stem", T.light_stem(F.col("token")))


def normalized_text(spark, d):
    n = T.normalize_text(T.nfc(F.col("text")))
    return _docs(spark, d).select(F.col("chunk_id").alias("doc_id"), F.length(n).cast("long").alias("n_chars"), F.sha2(n, 256).alias("text_sha256"))


def chunk_ids(spark, d):
    return _docs(spark, d).select(F.col("chunk_id").alias("doc_id"), T.chunk_id(F.col("text"), F.col("file_name"), F.col("page")).alias("chunk_id"), T.source_label(F.col("file_name"), F.col("page"), F.lit("")).alias("label"))


def duplicate_documents(spark, d):
    files = _docs(spark, d).select(F.col("chunk_id").cast("string").alias("file_name"), "chunk_id", T.content_hash(F.col("text")).alias("content_hash"))
    return library.duplicates(files, "chunk_id").select(F.col("chunk_id").alias("doc_id"), F.col("duplicate_of").cast("long").alias("duplicate_of"))


def text_layer_status(spark, d):
    return library.text_layer(_docs(spark, d))


def chunk_documents(spark, d):
    return chunking.chunk_documents(_docs(spark, d).select("file_name", "page", "text"))


def chunk_tokens(spark, d):
    """Chunks by the tokens of a BPE tokenizer, which counts separators and joins as they come."""
    import public_tokenizers

    count = chunking.TokenCounter(public_tokenizers.path("byte_bpe_50k.json"))
    return chunking.chunk_documents(_docs(spark, d).select("file_name", "page", "text"), count=count)


def chunk_stats(spark, d):
    return chunk_documents(spark, d).groupBy("file_name").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("token_count").alias("n_tokens"), F.max("token_count").alias("max_tokens"))


def bm25_idf(spark, d):
    return _index(spark, d).idf().select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark, d):
    return _bm25(spark, d, FETCH)


def stored_bm25(spark, d):
    """An index that takes up the sources in two adds, the second with all rows again, and then loses every copy of an earlier text."""
    docs = _docs(spark, d)
    index = TermIndex(spark, snapshots.scratch_path(spark, "terms"))
    index.add(docs.where("file_name < 'src2'"))
    index.add(docs)
    index.remove(duplicate_documents(spark, d).select(F.col("doc_id").alias("chunk_id")))
    return index.search(_questions(spark, d), FETCH)


def dense_topk(spark, d):
    return retrieval.dense_search(*_vectors(spark, d), 10)


def parent_passages(spark, d):
    """Windows of 40 words found by terms, and the sections of 200 words that they come from, neighbours merged."""
    docs = _docs(spark, d).select("chunk_id", "file_name", "page", "text")
    small = snapshots.written(chunking.windows(docs, 40, 30).withColumn("chunk_id", F.col("chunk_id") * 1_000_000 + F.col("number")), "windows")
    index = TermIndex(spark, snapshots.scratch_path(spark, "terms"))
    index.add(small)
    hits = snapshots.written(index.search(_questions(spark, d), FETCH).join(small.select("chunk_id", "file_name", "page", "first_word", "end_word"), "chunk_id"), "hits")
    # sections of the pages with hits alone: the others are in no passage
    return retrieval.parent_passages(hits, chunking.windows(docs.join(hits.select("page").distinct(), "page", "left_semi"), 200, 200).drop("text"))


def ann_topk(spark, d):
    """The same queries as dense_topk through random hyperplanes."""
    queries, vectors = _vectors(spark, d)
    return neighbours.HyperplaneIndex(vectors, 64).search(queries, 10)


def mmr_topk(spark, d):
    """Of each query's first hits by vectors, a diverse five."""
    queries, vectors = _vectors(spark, d)
    return neighbours.diverse(retrieval.dense_search(queries, vectors, FETCH), vectors, 5)


def rrf_fusion(spark, d):
    """Stemmed and unstemmed term rankings fused."""
    questions = _questions(spark, d)
    lists = [_index(spark, d, s).search(questions, FETCH) for s in (True, False)]
    return retrieval.reciprocal_rank_fusion(lists, limit=FETCH)


def hybrid_topk(spark, d):
    """Stemmed and unstemmed term retrievers fused by rank, cut to the first hits."""
    retrievers = [_index(spark, d, s).search for s in (True, False)]
    return retrieval.hybrid(retrievers, _questions(spark, d), TOP, FETCH)


def _embedded(spark, d):
    """Search by hashed word vectors: (queries, k) -> hits."""
    e = HashingEmbedder()
    passages = _docs(spark, d).select("chunk_id", e.passage(F.col("text")).alias("embedding"))
    return lambda q, k: retrieval.dense_search(q.select("query_id", e.query(F.coalesce("query_text", F.lit(""))).alias("query_vec")), passages, k)


def embedded_topk(spark, d):
    return _embedded(spark, d)(_questions(spark, d), FETCH)


def hybrid_embedded(spark, d):
    """Terms and vectors fused by rank, cut to the first hits."""
    return retrieval.hybrid([_index(spark, d).search, _embedded(spark, d)], _questions(spark, d), TOP, FETCH)


def retrieval_stage_counts(spark, d):
    """Per question: hits of each retriever, of their fusion, and those kept."""
    questions = _questions(spark, d)
    lists = [_index(spark, d, s).search(questions, FETCH) for s in (True, False)]
    stages = {"stemmed": lists[0], "plain": lists[1], "fused": retrieval.reciprocal_rank_fusion(lists, limit=FETCH)}
    rows = reduce(DataFrame.unionByName, [x.select("query_id", F.lit(name).alias("stage"), "rank") for name, x in stages.items()])
    n = lambda name: F.count(F.when(F.col("stage") == name, 1)).alias(f"n_{name}")
    return rows.groupBy("query_id").agg(*map(n, stages), F.count(F.when((F.col("stage") == "fused") & (F.col("rank") <= TOP), 1)).alias("n_kept"))


def library_totals(spark, d):
    """One row over the library: files, searchable ones, those without text, chunks."""
    rows = library_listing(spark, d)
    n = lambda c: F.count(F.when(F.col(c), 1))
    return rows.agg(F.count(F.lit(1)).alias("n_files"), n("is_searchable").alias("n_searchable"), n("needs_ocr").alias("n_needs_ocr"), F.sum("chunk_count").alias("n_chunks"))


def fusion_consensus(spark, d):
    return rrf_fusion(spark, d).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_fused"), F.sum((F.col("retriever_hits") > 1).cast("long")).alias("n_consensus"))


def rerank_minscore(spark, d):
    """BM25 candidates ordered anew by the share of the question's distinct words that the document has."""
    docs, questions = _docs(spark, d), _questions(spark, d)
    c = _bm25(spark, d, FETCH).join(questions, "query_id").join(docs.select("chunk_id", "text"), "chunk_id")
    q = F.array_distinct(T.raw_tokens(F.col("query_text")))
    share = F.round(F.size(F.array_intersect(q, T.raw_tokens(F.col("text")))) / F.size(q), 6)
    return retrieval.rerank(c, share, TOP, 0.5).select("query_id", "chunk_id", "score", "rank")


def rerank_pairs(spark, d):
    """Two term retrievers fused and reranked by a pair scorer, itself a retriever of an outer fusion with one of them."""
    docs, questions = _docs(spark, d), _questions(spark, d)
    stemmed, plain = (_index(spark, d, s).search for s in (True, False))
    reranker = rerank.PairReranker(rerank.overlap_scorer, questions, docs)
    inner = lambda q, k: retrieval.hybrid([stemmed, plain], q, k, FETCH, reranker=reranker)
    return inner(questions, TOP).select("query_id", "chunk_id", "score", "rank", "stage", "retriever_hits")


def answers_judged(spark, d):
    """Every question answered by an extractive answerer through a table of calls, and judged by the words that its context has."""
    docs = _docs(spark, d).withColumn("token_count", F.size(T.raw_tokens(F.col("text"))).cast("long"))
    hits = _bm25(spark, d, FETCH).join(docs, "chunk_id").withColumn("section", F.lit(""))
    calls = [CallTable(spark, snapshots.scratch_path(spark, f.__name__), f.__name__, f) for f in (extract, weigh)]
    rows = A.answer_pipeline(_questions(spark, d), hits, calls[0], "{context}\n\n{abstain_phrase}\n{question}", 1000, calls[1], "{answer}\n\n\n{context}")
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda m: m.cast("string")))
    return rows.select("query_id", F.sha2("text", 256).alias("text_sha256"), "abstained", joined(F.col("citations")).alias("cited"), joined(F.col("unknown_markers")).alias("unknown"), "error", F.round("groundedness", 6).alias("groundedness"))


def extract(prompt: str, key: str) -> str:
    """An answerer without a model: 120 characters of the first part, with markers; the phrase if the question's length is a multiple of 3."""
    question = prompt.rpartition(f"\n\n{A.ABSTAIN_PHRASE}\n")[2]
    return f"{A.ABSTAIN_PHRASE}." if len(question) % 3 == 0 else prompt.partition("\n")[2][:120] + " [1] [2] [1] [99]"


def weigh(prompt: str, key: str) -> str:
    """A judge without a model: of the answer's distinct words, how many its context has."""
    answer, _, context = prompt.partition("\n\n\n")
    own = set(T.words(answer))
    return f"TOPLAM: {len(own)}\nDESTEKLENEN: {len(own & set(T.words(context)))}"


def retrieval_run(spark, d):
    """One row of the run that finds the hits: hits, questions with a hit, the best score and the mean one."""
    rank = F.col("rank") == 1
    _, seen = snapshots.observed(_index(spark, d).search(_questions(spark, d), FETCH), "hits", n_hits=F.count(F.lit(1)), n_answered=F.count(F.when(rank, 1)), top_score=F.max("score"), mean_score=F.avg("score"))
    return spark.createDataFrame([(seen["n_hits"], seen["n_answered"], seen["top_score"], round(seen["mean_score"] or 0.0, 6))], "n_hits long, n_answered long, top_score double, mean_score double")


def ingest_run(spark, d):
    """One row of the run that decides on the files: how many of each status."""
    of = lambda s: F.count(F.when(F.col("status") == s, 1))
    names = {"n_added": "ok", "n_skipped": "skipped", "n_failed": "failed", "n_needs_ocr": "no_text_layer"}
    _, seen = snapshots.observed(_plan(spark, d), "plan", n_files=F.count(F.lit(1)), **{k: of(v) for k, v in names.items()})
    return spark.createDataFrame([tuple(seen[k] for k in ("n_files", *names))], "n_files long, " + ", ".join(f"{k} long" for k in names))


def context_pack(spark, d):
    docs = _docs(spark, d).select("chunk_id", F.size(T.raw_tokens(F.col("text"))).cast("long").alias("token_count"))
    packed = A.pack_context(_bm25(spark, d, FETCH).join(docs, "chunk_id"), 1000)
    return packed.select("query_id", "chunk_id", "rank", "tokens_so_far")


def _said(spark, d):
    """Assistant turns with markers and tags put in, as answers."""
    c = _table(spark, d, "conversations").where("role = 'assistant'")
    key = (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id")
    n = F.length("text")
    return c.select(key, F.concat("text", F.lit(" ["), (n % 7).cast("string"), F.lit("] ["), (n % 3).cast("string"), F.lit("] [123]")).alias("cited"), "text")


def citation_markers(spark, d):
    valid, unknown = A.valid_markers(F.col("cited"), F.lit(3)), A.invalid_markers(F.col("cited"), F.lit(3))
    as_text = lambda a: F.concat_ws(",", F.transform(a, lambda m: m.cast("string")))
    return _said(spark, d).select("query_id", as_text(valid).alias("valid"), as_text(unknown).alias("unknown"))


def abstention_flags(spark, d):
    """Answers that are the phrase in upper or mixed case, hold it in their midst, or lack it."""
    n, phrase = F.length("text"), A.ABSTAIN_PHRASE
    t = F.when(n % 4 == 0, F.lit("BU BİLGİ VERİLEN DOKÜMANLARDA YOK")).when(n % 4 == 1, F.concat(F.substring("text", 1, 60), F.lit(f" {phrase}."))).when(n % 4 == 2, F.concat("text", F.lit(f" {phrase}"))).otherwise(F.col("text"))
    return _said(spark, d).select("query_id", A.abstained(t).alias("abstained"))


def reasoning_strip(spark, d):
    """Answers with a closed and an open thinking block, with a block and a stray tag, or as they are."""
    n = F.length("text")
    t = F.when(n % 3 == 0, F.concat(F.lit("<think>a\nb</THINK> "), "text", F.lit(" <think>open"))).when(n % 3 == 1, F.concat(F.lit('<THINK x="1">u</think>'), "text", F.lit("</think>\n"))).otherwise(F.col("text"))
    return _said(spark, d).select("query_id", F.sha2(T.strip_reasoning(t), 256).alias("text_sha256"))


def groundedness_parse(spark, d):
    """Verdicts after the answer itself; every fifth lacks the supported number, others have a total of zero."""
    n = F.length("text")
    supported = F.when(n % 5 == 4, F.lit("")).otherwise(F.concat(F.lit("desteklenen:  "), (n % 6).cast("string")))
    verdict = F.concat(F.col("text"), F.lit("\n"), supported, F.lit("\nToplam: "), (n % 7).cast("string"))
    return _said(spark, d).select("query_id", F.round(A.groundedness(verdict), 6).alias("groundedness"))


def sse_frames(spark, d):
    return streams.frames(_said(spark, d).select("query_id", F.col("text").alias("piece"))).select("query_id", "frame")


def sse_events(spark, d):
    """Answers in pieces of 50 characters as events; in every fifth the second piece fails."""
    at = F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / 50).cast("int")))
    rows = _said(spark, d).select("query_id", at.alias("seq"), "text")
    error = F.when((F.length("text") % 5 == 0) & (F.col("seq") == 1), F.lit("LLMError"))
    return streams.events(rows.select("query_id", "seq", F.substring("text", F.col("seq") * 50 + 1, 50).alias("piece"), error.alias("error")))


def _thinking_pieces(spark, d):
    """Answers with thinking blocks before, in or after them, dealt out in pieces of 7 characters."""
    n, block = F.length("text"), F.lit("<think>x < y</think>")
    t = F.when(n % 3 == 0, F.concat(block, "text")).when(n % 3 == 1, F.concat(F.substring("text", 1, 11), block, F.lit("a < b"), F.expr("substring(text, 12)"))).otherwise(F.concat("text", block, block))
    at = F.explode(F.sequence(F.lit(0), F.floor(F.length("t") / 7).cast("int")))
    rows = _said(spark, d).select("query_id", t.alias("t")).select("query_id", at.alias("seq"), "t")
    return rows.select("query_id", "seq", F.substring("t", F.col("seq") * 7 + 1, 7).alias("piece"), (F.col("seq") == F.floor(F.length("t") / 7)).alias("last"))


def stream_filter(spark, d):
    return streams.filter_pieces(_thinking_pieces(spark, d))


def stream_filter_late(spark, d):
    """The same pieces as a stream: four batches, to which the pieces of each answer are dealt by hash, and every eleventh comes twice."""
    path = snapshots.scratch_path(spark, "pieces")
    pieces = _thinking_pieces(spark, d)
    twice = pieces.where("pmod(hash(query_id, seq), 11) = 0").withColumn("batch", F.lit(3))
    dealt = pieces.withColumn("batch", F.pmod(F.hash("seq", "query_id"), F.lit(4))).unionByName(twice)
    dealt.repartition(4, "batch").write.partitionBy("batch").parquet(f"{path}/in")
    stream = spark.readStream.schema("query_id long, seq long, piece string, last boolean").option("maxFilesPerTrigger", 1).parquet(f"{path}/in/batch=*")
    return streams.shown_texts(stream, path)[0]


def _golden(spark, d):
    """questions (query_id, kind) and expected (query_id, file_name, page): the documents that hold a question's text."""
    docs = _docs(spark, d)
    q = _questions(spark, d).where("query_text <> ''")
    hits = snapshots.written(evaluation.holders(q, docs).select("query_id", "file_name", "page"), "expected")
    kind = F.when(F.col("n").isNull(), "unanswerable").otherwise("answerable").alias("kind")
    return _questions(spark, d).join(hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").select("query_id", kind), hits


def _retrieved(spark, d):
    """Hits with their files, written once."""
    return _bm25(spark, d, FETCH).withColumn("page", F.col("chunk_id")).join(_docs(spark, d).select("page", "file_name"), "page").select("query_id", "rank", "file_name", "page", "score")


def retrieval_metrics(spark, d):
    questions, expected = _golden(spark, d)
    m = evaluation.retrieval_metrics(questions, expected, _retrieved(spark, d), TOP)
    return m.select("query_id", "kind", "first_relevant_rank", "hit", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "reciprocal_rank")])


def _results(spark, d):
    """Metrics with a stand-in answerer that abstains unless its best hit scores 20 or more, and cites its first hit."""
    hits = _retrieved(spark, d)
    m = evaluation.retrieval_metrics(*_golden(spark, d), hits, TOP)
    best = hits.where("rank = 1").select("query_id", "score")
    r = m.join(best, "query_id", "left").withColumn("abstained", F.coalesce(F.col("score") < 20, F.lit(True)))
    r = r.withColumn("n_citations", F.when(F.col("abstained"), 0).otherwise(1)).withColumn("facts_ok", (F.col("kind") != "answerable") | F.col("hit"))
    r = r.withColumn("forbidden", F.lit(False)).withColumn("citations_correct", F.col("abstained") | (F.col("kind") != "answerable") | F.coalesce(F.col("first_relevant_rank") == 1, F.lit(False)))
    return evaluation.judged(r)


def _used(spark, d):
    """The chunks of each question's context, as packed."""
    docs = _docs(spark, d).withColumn("token_count", F.size(T.raw_tokens(F.col("text"))).cast("long"))
    return snapshots.written(A.pack_context(_bm25(spark, d, FETCH).join(docs, "chunk_id"), 1000).withColumn("section", F.lit("")), "used")


def _answers(spark, d, used):
    """An extractive answerer: the start of the first chunk with three markers, or the abstention phrase under a score of 20."""
    best = used.where("rank = 1").select("query_id", F.when(F.col("score") >= 20, F.concat(F.substring("text", 1, 200), F.lit(" [1] [2] [9]"))).alias("told"))
    text = F.coalesce("told", F.lit(A.ABSTAIN_PHRASE + "."))
    return _questions(spark, d).join(best, "query_id", "left").select("query_id", text.alias("text"), A.abstained(text).alias("abstained"))


def _cited(spark, d):
    used = _used(spark, d)
    return A.resolve_citations(_answers(spark, d, used), used)


def citation_resolve(spark, d):
    """Every citation of every answer; those that point to no chunk have nulls."""
    return _cited(spark, d).select("query_id", "marker", "chunk_id", "file_name")


def answer_view(spark, d):
    return A.answer_view(_cited(spark, d))


def wrong_citations(spark, d):
    return evaluation.wrong_citations(_cited(spark, d), _golden(spark, d)[1]).select("query_id", "marker", "chunk_id")


def _evaluated(spark, d):
    """Questions must have their first word in the answer and may not have the phrase that a document never holds."""
    questions, expected = _golden(spark, d)
    first = F.slice(T.raw_tokens(F.col("query_text")), 1, 1)
    asked = questions.join(_questions(spark, d), "query_id").select("query_id", "kind", first.alias("must_contain"), F.array(F.lit("[2] [9]")).alias("must_not_contain"))
    used = _used(spark, d)
    return snapshots.written(evaluation.evaluate(asked, expected, used, _answers(spark, d, used), TOP), "evaluated")


_SHOWN = ("query_id", "kind", "first_relevant_rank", "hit", "abstained", "n_citations", "n_wrong", "facts_ok", "forbidden", "citations_correct", "passed")


def eval_used(spark, d):
    """Every question judged on the chunks that its answer used."""
    r = _evaluated(spark, d)
    return r.select(*_SHOWN, *[F.round(c, 6).alias(c) for c in ("recall", "precision", "reciprocal_rank")])


def eval_failures(spark, d):
    return evaluation.failures(_evaluated(spark, d)).select("query_id", "kind", "abstained", "n_wrong")


def eval_summary(spark, d):
    s = evaluation.summary(_results(spark, d))
    return s.select("n_questions", "n_answerable", *[F.round(c, 6).alias(c) for c in s.columns[2:]])


def diagnosis(spark, d):
    return evaluation.diagnosis(evaluation.summary(_results(spark, d))).select(F.col("at").cast("long").alias("at"), "finding")


def golden_validation(spark, d):
    """The derived set with every seventh id repeated under kind unanswerable."""
    questions, expected = _golden(spark, d)
    n = expected.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    q = questions.join(n, "query_id", "left").select(F.col("query_id").cast("string").alias("id"), "kind", F.coalesce("n", F.lit(0)).alias("n_sources"), F.lit(0).alias("n_must_contain"))
    again = q.where("cast(id as int) % 7 = 0").withColumn("kind", F.lit("unanswerable"))
    return evaluation.golden_problems(q.unionByName(again))


def _files(spark, d):
    """Sources as files; the hash is over their documents' ids and texts."""
    page = F.conv(F.substring(F.sha2(F.concat_ws(":", "page", "text"), 256), 1, 8), 16, 10).cast("long")
    rows = _docs(spark, d).groupBy("file_name").agg(F.sum(page).alias("pages"), F.count(F.lit(1)).alias("n"), F.min("page").alias("first"))
    return rows.select("file_name", F.concat_ws(":", "pages", "n").alias("content_hash"), "n", "first")


def _manifest(spark, d):
    """Files with an even first page are known; of those, every fourth has changed since."""
    f = _files(spark, d).where("first % 2 = 0")
    ids = _docs(spark, d).groupBy("file_name").agg(F.collect_list(F.col("page").cast("string")).alias("chunk_ids"))
    changed = F.when(F.col("first") % 4 == 0, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash"))
    return f.join(ids, "file_name").select("file_name", changed.alias("content_hash"), F.lit("ok").alias("status"), F.col("n").alias("chunk_count"), "chunk_ids", F.lit("m").alias("embedder_model_id"))


def manifest_currency(spark, d):
    index = _docs(spark, d).where("page <> 2").select(F.col("page").cast("string").alias("chunk_id"))
    return library.currency(_files(spark, d).select("file_name", "content_hash"), _manifest(spark, d), index, "m")


def library_listing(spark, d):
    return library.listing(_files(spark, d).select("file_name"), _manifest(spark, d))


def _plan(spark, d):
    """Files with a first page of 1 more than a multiple of 5 can't be read."""
    error = F.when(F.col("first") % 5 == 1, F.lit("unreadable")).alias("error")
    return library.ingest_plan(_files(spark, d).select("file_name", error), text_layer_status(spark, d), manifest_currency(spark, d), _manifest(spark, d))


def incremental_ingest(spark, d):
    """What a run does with each file, and the file's rows in the index after it."""
    plan, chunks = _plan(spark, d), _docs(spark, d).select("chunk_id", "file_name")
    index = chunks.where("chunk_id <> 2").join(_manifest(spark, d).select("file_name"), "file_name", "left_semi").select("chunk_id", "file_name")
    n = library.ingested(index, plan, chunks).groupBy("file_name").agg(F.count(F.lit(1)).alias("n"))
    return plan.join(n, "file_name", "left").select("file_name", "status", "replaced", F.coalesce("n", F.lit(0)).cast("long").alias("n_indexed"))


def report_lookup(spark, d):
    """Files by name with their status in the report of a run that took up the changed and the unknown ones."""
    return library.with_report(_files(spark, d).select("file_name"), _plan(spark, d).where("status <> 'skipped'"))


def incremental_add(spark, d):
    """Chunks that an index of the even documents lacks, each id once."""
    ids = chunk_ids(spark, d)
    return library.new_chunks(ids.select("chunk_id"), ids.where("doc_id % 2 = 0").select("chunk_id"))


def ingest_report(spark, d):
    s = text_layer_status(spark, d)
    return s.agg(F.count(F.lit(1)).alias("n_files"), F.sum("page_count").alias("n_pages"), F.sum((F.col("status") == "ok").cast("long")).alias("n_ok"), F.sum((F.col("status") != "ok").cast("long")).alias("n_needs_ocr"))


def _page_files(pages):
    return pages.select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("file_name"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("content"))


def _page_collection(spark, d):
    """The web pages as a stream of files into a collection; then the stream again from its checkpoint, and its first batch once more."""
    path = snapshots.scratch_path(spark, "pages")
    held = Collection(spark, f"{path}/collection", HashingEmbedder())
    table = _table(spark, d, "pages")
    stream = _page_files(spark.readStream.schema(table.schema).option("pathGlobFilter", "pages.parquet*").parquet(d))
    for _ in range(2):
        ingest_stream(held, stream, f"{path}/checkpoint")
    held.ingest(store.read_pages(_page_files(table)), (stream_id(spark, f"{path}/checkpoint"), 0))
    return held


def ingest_pages(spark, d):
    """The manifest after a stream of web pages, and the pages' chunks in the index."""
    held = _page_collection(spark, d)
    n = held.chunks().groupBy("file_name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("chunk_id").alias("n_ids"))
    rows = held.manifest().join(n, "file_name", "left")
    return rows.select("file_name", "content_hash", "status", "page_count", (F.col("n") == F.col("chunk_count")).alias("whole"), (F.col("n") == F.col("n_ids")).alias("once"))


def library_delete(spark, d):
    """Files with text and those without after the pages of mobile hosts have been removed."""
    held = _page_collection(spark, d)
    names = _table(spark, d, "pages").where("url LIKE '%://m.%'").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("file_name"))
    held.remove([r["file_name"] for r in names.toLocalIterator()])
    indexed = held.chunks().select("file_name").distinct().withColumn("indexed", F.lit(True))
    return held.manifest().join(indexed, "file_name", "full").select("file_name", "status", F.coalesce("indexed", F.lit(False)).alias("indexed"))


def _layers(spark, d):
    """Each document as a file of its own."""
    return library.text_layer(_docs(spark, d).withColumn("file_name", F.col("page").cast("string")))


def text_layer_documents(spark, d):
    return _layers(spark, d)


def library_documents(spark, d):
    """Documents as files, of which the manifest knows those that have been tried."""
    layers = _layers(spark, d)
    tried = layers.where("total_chars % 10 <> 0").select("file_name", "status", F.when(F.col("status") == "ok", F.col("page_count")).otherwise(0).alias("chunk_count"))
    return library.listing(layers.select("file_name"), tried)


def ingest_documents(spark, d):
    """One row over documents as files: pages, those that go in, those without text, characters of each."""
    by = lambda s, c: F.sum(F.when(F.col("status") == s, F.col(c)).otherwise(0))
    return _layers(spark, d).agg(F.count(F.lit(1)).alias("n_files"), by("ok", "page_count").alias("n_ok"), by("no_text_layer", "page_count").alias("n_needs_ocr"), by("ok", "total_chars").alias("ok_chars"), by("no_text_layer", "total_chars").alias("other_chars"))


def safe_file_names(spark, d):
    p = _table(spark, d, "pages")
    return p.select("page_id", library.safe_name(F.col("url")).alias("safe_name"))


_SUFFIX = "|".join(T.SUFFIXES)
_TOKENS = f"regexp_extract_all(lower(translate(coalesce(text, ''), '{T.TR_UPPER}', '{T.TR_LOWER}')), '[0-9a-zçğıöşü]+')"


def _sql_stem(c: str) -> str:
    for _ in range(T.STEM_PASSES):
        c = f"regexp_replace({c}, '^(.{{{T.MIN_STEM},}}?)(?:{_SUFFIX})$', '\\1')"
    return c


_SQL_HARD = f"CASE WHEN len(s) > {T.MIN_STEM} THEN left(s, len(s) - 1) || translate(right(s, 1), 'ğbcd', 'kpçt') ELSE s END"


def _sql_bm25(stem: bool, p: str = "") -> str:
    """CTEs ending in {p}hits(query_id, chunk_id, score, rank)."""
    words = f"SELECT w, {_SQL_HARD} AS term FROM (SELECT w, {_sql_stem('w')} AS s FROM (SELECT DISTINCT w FROM {p}occ UNION SELECT DISTINCT w FROM {p}qocc))" if stem else f"SELECT DISTINCT w, w AS term FROM (SELECT w FROM {p}occ UNION SELECT w FROM {p}qocc)"
    return f"""{p}occ AS (SELECT doc_id, unnest({_TOKENS}) AS w FROM documents),
{p}qocc AS (SELECT item_id, unnest({_TOKENS}) AS w FROM benchmark),
{p}words AS ({words}),
{p}post AS (SELECT term, doc_id, count(*) AS tf FROM {p}occ JOIN {p}words USING (w) GROUP BY ALL),
{p}len AS (SELECT doc_id, sum(tf) AS dl FROM {p}post GROUP BY doc_id),
{p}st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM {p}len) / (SELECT count(*) FROM documents) AS avgdl),
{p}raw AS (SELECT term, count(*) AS df, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM {p}post, {p}st GROUP BY term, n),
{p}idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM {p}raw) ELSE r END AS idf FROM {p}raw),
{p}q AS (SELECT item_id, term, count(*) AS qtf FROM {p}qocc JOIN {p}words USING (w) GROUP BY ALL),
{p}sc AS (SELECT item_id AS query_id, doc_id AS chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM {p}q JOIN {p}idf USING (term) JOIN {p}post USING (term) JOIN {p}len USING (doc_id), {p}st GROUP BY item_id, doc_id),
{p}hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {p}sc) WHERE rank <= {FETCH})"""


_FUSED = f"""{_sql_bm25(True, 'x')}, {_sql_bm25(False, 'y')},
every AS (SELECT query_id, chunk_id, 0 AS l, rank FROM xhits UNION ALL SELECT query_id, chunk_id, 1, rank FROM yhits),
fused AS (SELECT query_id, chunk_id, round(sum(1 / (60 + rank)), 9) AS score, count(*) AS retriever_hits, min(l * 1000 + rank) AS seen FROM every GROUP BY ALL),
ranked AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS rank, retriever_hits FROM fused),
rrf AS (SELECT * FROM ranked WHERE rank <= {FETCH})"""

_SAID = "said AS (SELECT conv_id * 1000 + turn AS query_id, text, len(text) AS n FROM conversations WHERE role = 'assistant')"

_GOLDEN = "expected AS (SELECT item_id AS query_id, source AS file_name, doc_id AS page FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> ''),\ngolden AS (SELECT item_id AS query_id, CASE WHEN item_id IN (SELECT query_id FROM expected) THEN 'answerable' ELSE 'unanswerable' END AS kind FROM benchmark)"

_METRICS_OF = f"""marked AS (SELECT h.*, e.page IS NOT NULL AS rel FROM @HITS@ h LEFT JOIN expected e ON e.query_id = h.query_id AND e.page = h.chunk_id),
per AS (SELECT query_id, min(rank) FILTER (rel) AS first, avg(CASE WHEN rel THEN 1.0 ELSE 0.0 END) FILTER (rank <= {TOP}) AS prec, count(*) FILTER (rel AND rank <= {TOP}) AS found FROM marked GROUP BY query_id),
exact AS (SELECT g.query_id, g.kind, first AS first_relevant_rank, coalesce(first <= {TOP}, false) AS hit,
  coalesce(found / nullif((SELECT count(*) FROM expected e WHERE e.query_id = g.query_id), 0), 0.0) AS recall, coalesce(prec, 0.0) AS precision, coalesce(1 / first, 0.0) AS reciprocal_rank FROM golden g LEFT JOIN per USING (query_id)),
metrics AS (SELECT * REPLACE (round(recall, 6) AS recall, round(precision, 6) AS precision, round(reciprocal_rank, 6) AS reciprocal_rank) FROM exact)"""

_METRICS = f"{_sql_bm25(True)}, {_GOLDEN},\n{_METRICS_OF.replace('@HITS@', 'hits')}"

_FOLD = "lower(translate({}, '" + T.TR_UPPER + "', '" + T.TR_LOWER + "'))"

_USED = f"""{_sql_bm25(True)}, {_GOLDEN},
used AS (SELECT * FROM (SELECT hits.*, sum(n) OVER (PARTITION BY query_id ORDER BY rank) AS so_far FROM hits JOIN (SELECT doc_id, len({_TOKENS}) AS n FROM documents) ON doc_id = chunk_id) WHERE so_far <= 1000 OR rank = 1),
best AS (SELECT query_id, score, coalesce(text, '') AS text FROM used JOIN documents ON doc_id = chunk_id WHERE rank = 1),
told AS (SELECT item_id AS query_id, CASE WHEN score >= 20 THEN substring(best.text, 1, 200) || ' [1] [2] [9]' ELSE '{A.ABSTAIN_PHRASE}.' END AS text FROM benchmark LEFT JOIN best ON query_id = item_id),
answers AS (SELECT *, contains({_FOLD.format('text')}, {_FOLD.format("'" + A.ABSTAIN_PHRASE + "'")}) AND len(text) < {3 * len(A.ABSTAIN_PHRASE)} AS abstained FROM told),
marks AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(text, '\\[(\\d{{1,2}})\\]', 1))::INT AS marker FROM answers WHERE NOT abstained),
cited AS (SELECT m.query_id, marker, chunk_id, source AS file_name, score, text FROM marks m LEFT JOIN used u ON u.query_id = m.query_id AND rank = marker LEFT JOIN documents ON doc_id = chunk_id),
wrong AS (SELECT query_id, marker, chunk_id FROM cited c WHERE chunk_id IS NOT NULL AND query_id IN (SELECT query_id FROM expected) AND NOT EXISTS (SELECT 1 FROM expected e WHERE e.query_id = c.query_id AND e.page = c.chunk_id))"""

_EVAL_USED = f"""{_USED}, {_METRICS_OF.replace('@HITS@', 'used')},
counted AS (SELECT m.*, a.text, a.abstained, (SELECT count(*) FROM cited c WHERE c.query_id = m.query_id AND chunk_id IS NOT NULL) AS n_citations, (SELECT count(*) FROM wrong w WHERE w.query_id = m.query_id) AS n_wrong, m.kind = 'answerable' AS ans,
  (SELECT ({_TOKENS})[1] FROM benchmark WHERE item_id = m.query_id) AS word FROM metrics m JOIN answers a USING (query_id)),
checked AS (SELECT *, NOT ans OR word IS NULL OR contains({_FOLD.format('text')}, {_FOLD.format('word')}) AS facts_ok, contains(text, '[2] [9]') AS forbidden, n_wrong = 0 AS citations_correct FROM counted),
evaluated AS (SELECT *, abstained <> ans AND NOT ((NOT ans AND NOT abstained) OR forbidden) AND facts_ok AND (NOT ans OR n_citations > 0) AND citations_correct AS passed FROM checked)"""

_EMBEDDED = f"""qv AS (SELECT item_id, b, count(*) AS c FROM (SELECT item_id, ('0x' || substr(md5(unnest({_TOKENS})), 1, 8))::BIGINT % 64 AS b FROM (SELECT item_id, 'query: ' || coalesce(text, '') AS text FROM benchmark)) GROUP BY ALL),
dv AS (SELECT doc_id, b, count(*) AS c FROM (SELECT doc_id, ('0x' || substr(md5(unnest({_TOKENS})), 1, 8))::BIGINT % 64 AS b FROM (SELECT doc_id, 'passage: ' || coalesce(text, '') AS text FROM documents)) GROUP BY ALL),
qn AS (SELECT item_id, sqrt(sum(c * c)) AS norm FROM qv GROUP BY item_id), dn AS (SELECT doc_id, sqrt(sum(c * c)) AS norm FROM dv GROUP BY doc_id),
dots AS (SELECT item_id, doc_id, sum(qv.c * dv.c) AS dot FROM qv JOIN dv USING (b) GROUP BY ALL),
cosines AS (SELECT qn.item_id AS query_id, dn.doc_id AS chunk_id, round(coalesce(dot, 0) / (qn.norm * dn.norm), 6) AS score FROM qn CROSS JOIN dn LEFT JOIN dots ON dots.item_id = qn.item_id AND dots.doc_id = dn.doc_id),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM cosines) WHERE rank <= {FETCH})"""

_PLAN = f"""{{files}}, layers AS (SELECT source AS file_name, sum(len({{stripped}})) AS chars FROM documents GROUP BY source),
plan AS (SELECT file_name, n, first, CASE WHEN first % 2 = 0 AND first % 4 <> 0 AND file_name NOT IN (SELECT source FROM documents WHERE doc_id = 2) THEN 'skipped' WHEN first % 5 = 1 THEN 'failed' WHEN chars < 100 THEN 'no_text_layer' ELSE 'ok' END AS status FROM files JOIN layers USING (file_name))"""

_JUDGED = f"""{_METRICS},
said AS (SELECT m.*, coalesce(h.score < 20, true) AS abstained, kind = 'answerable' AS ans FROM exact m LEFT JOIN (SELECT * FROM hits WHERE rank = 1) h USING (query_id)),
judged AS (SELECT *, abstained <> ans AS abst_ok, NOT ans AND NOT abstained AS halluc, NOT ans OR NOT abstained AS cited, NOT ans OR hit AS facts, abstained OR NOT ans OR coalesce(first_relevant_rank = 1, false) AS cit_ok FROM said),
summary AS (SELECT count(*) AS n_questions, count(*) FILTER (ans) AS n_answerable,
  {', '.join(f"round(coalesce(avg({c}::DOUBLE) FILTER (ans), 0.0), 6) AS {n}" for c, n in (('recall', 'recall'), ('hit::INT', 'hit_rate'), ('reciprocal_rank', 'mrr'), ('precision', 'precision'), ('cited::INT', 'citation_rate'), ('cit_ok::INT', 'citation_accuracy'), ('facts::INT', 'fact_accuracy')))},
  {', '.join(f"round(coalesce(avg(({c})::INT::DOUBLE), 0.0), 6) AS {n}" for c, n in (('abst_ok', 'abstention_accuracy'), ('halluc', 'hallucination_rate'), ('abst_ok AND NOT halluc AND facts AND cited AND cit_ok', 'pass_rate')))} FROM judged)"""

_FILES = "files AS (SELECT source AS file_name, sum(('0x' || substr(sha256(doc_id || ':' || coalesce(text, '')), 1, 8))::BIGINT)::BIGINT || ':' || count(*) AS content_hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY source)"

_STRIPPED = r"regexp_replace(coalesce(text, ''), '^[\s\x0b\x{85}\p{Z}]+|[\s\x0b\x{85}\p{Z}]+$', '', 'g')"

_LAYERS = f"layers AS (SELECT *, CASE WHEN total_chars >= 100 THEN 'ok' ELSE 'no_text_layer' END AS status FROM (SELECT doc_id::VARCHAR AS file_name, len({_STRIPPED}) AS total_chars FROM documents))"

_PLAN = _PLAN.format(files=_FILES, stripped=_STRIPPED)

# white space that is left once control characters are out, but for line ends
_BLANKS = r"[\t\r \x{85}\x{2028}\x{2029}\p{Zs}]"
_NORMALIZED = "nfc_normalize(coalesce(text, ''))"
for _pattern, _new in (
    (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), (r"(\p{L})-\n(\p{L})", r"\1\2"), (r"(\p{L})-\n(\p{L})", r"\1\2"), (_BLANKS + "{2,}", " "), (r"\n{3,}", "\n\n"),
    (r"(?m)" + _BLANKS + "+$", ""), (r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$", ""),
):
    _NORMALIZED = f"regexp_replace({_NORMALIZED}, '{_pattern}', '{_new}', 'g')"

# what is left of a page without scripts, styles and tags; entities that pages have
_PAGE_TEXT = "regexp_replace(coalesce(html, ''), '(?is)<script.*?</script>|<style.*?</style>|<[^>]+>', ' ', 'g')"
for _entity, _char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
    _PAGE_TEXT = f"replace({_PAGE_TEXT}, '{_entity}', '{_char}')"
_PAGES = f"""page_texts AS (SELECT page_id || '.html' AS file_name, url, substr(sha256(coalesce(html, '')), 1, 32) AS content_hash, {_PAGE_TEXT} AS text FROM pages),
page_files AS (SELECT file_name, url, content_hash, CASE WHEN len({_STRIPPED}) >= 100 THEN 'ok' ELSE 'no_text_layer' END AS status FROM page_texts)"""

_NAME = _STRIPPED.replace("text", "url")
_SAFE = f"""SELECT page_id, CASE WHEN name <> '' AND base <> '' AND NOT regexp_matches(name, '[\\x00-\\x1f\\x7f-\\x9f\\x{{200b}}-\\x{{200f}}\\x{{2028}}-\\x{{202e}}]') AND NOT starts_with(base, '.') AND len(base) <= 200
  AND lower(regexp_replace(base, '\\.[^.]*$', '')) NOT IN ({", ".join(f"'{r}'" for r in library.RESERVED)}) AND regexp_full_match(base, '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}\\s\\p{{Z}}.,()\\[\\]+&#@!''çğıöşüÇĞİÖŞÜ-]+') THEN base END AS safe_name
FROM (SELECT page_id, name, regexp_extract(replace(name, '\\', '/'), '[^/]*$', 0) AS base FROM (SELECT page_id, {_NAME} AS name FROM pages))"""

_CHUNK_ID = "substr(sha256(coalesce(text, '') || chr(0) || source || chr(0) || doc_id), 1, 32)"

SQL = {
    "tr_tokenize_stats": f"SELECT doc_id, len({_TOKENS}) AS n_tokens, len(list_distinct({_TOKENS})) AS n_distinct FROM documents",
    "stem_vocabulary": f"SELECT token, df, {_SQL_HARD} AS stem FROM (SELECT token, df, {_sql_stem('token')} AS s FROM (SELECT token, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({_TOKENS})) AS token FROM documents) GROUP BY token))",
    "chunk_ids": f"SELECT doc_id, {_CHUNK_ID} AS chunk_id, source || ' · s.' || doc_id AS label FROM documents",
    "duplicate_documents": "SELECT doc_id, first AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents) WHERE first <> doc_id",
    "text_layer_status": f"SELECT file_name, page_count, total_chars, CASE WHEN total_chars >= 100 THEN 'ok' ELSE 'no_text_layer' END AS status FROM (SELECT source AS file_name, count(*) AS page_count, sum(len({_STRIPPED})) AS total_chars FROM documents GROUP BY source)",
    "bm25_idf": f"WITH {_sql_bm25(True)} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_topk": f"WITH {_sql_bm25(True)} SELECT query_id, chunk_id, score, rank FROM hits",
    "stored_bm25": f"WITH documents AS (SELECT * FROM main.documents QUALIFY row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) = 1), {_sql_bm25(True)} SELECT query_id, chunk_id, score, rank FROM hits",
    "ingest_pages": f"WITH {_PAGES} SELECT file_name, content_hash, status, 1 AS page_count, CASE WHEN status = 'ok' THEN true END AS whole, CASE WHEN status = 'ok' THEN true END AS once FROM page_files",
    "library_delete": f"WITH {_PAGES} SELECT file_name, status, status = 'ok' AS indexed FROM page_files WHERE url NOT LIKE '%://m.%'",
    "rerank_pairs": f"""WITH {_FUSED}, qs AS (SELECT item_id, list_distinct({_TOKENS}) AS qt FROM benchmark), ds AS (SELECT doc_id, {_TOKENS} AS dt FROM documents),
re AS (SELECT query_id, chunk_id, rank AS former, retriever_hits, round(len(list_intersect(qt, dt)) / len(qt), 6) AS score FROM rrf JOIN qs ON item_id = query_id JOIN ds ON doc_id = chunk_id)
SELECT query_id, chunk_id, score, rank, 'reranked' AS stage, retriever_hits FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, former) AS rank FROM re) WHERE rank <= {TOP}""",
    "answers_judged": f"""WITH {_USED},
parts AS (SELECT query_id, rank, coalesce(text, '') AS text, '[' || rank || '] (kaynak: ' || source || ' · s.' || chunk_id || ')' AS head FROM used JOIN documents ON doc_id = chunk_id),
ctx AS (SELECT query_id, count(*) AS n_used, string_agg(head || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM parts GROUP BY query_id),
body AS (SELECT b.item_id AS query_id, n_used, context, CASE WHEN context IS NULL OR len(b.text) % 3 = 0 THEN '{A.ABSTAIN_PHRASE}.' ELSE substring(substring(context, strpos(context, chr(10)) + 1) || chr(10) || chr(10) || '{A.ABSTAIN_PHRASE}' || chr(10) || b.text, 1, 120) || ' [1] [2] [1] [99]' END AS text FROM benchmark b LEFT JOIN ctx ON ctx.query_id = item_id),
marked AS (SELECT *, contains({_FOLD.format('text')}, {_FOLD.format("'" + A.ABSTAIN_PHRASE + "'")}) AND len(text) < {3 * len(A.ABSTAIN_PHRASE)} AS abst, list_transform(regexp_extract_all(text, '\\[(\\d{{1,2}})\\]', 1), lambda x: x::INT) AS m FROM body),
said AS (SELECT *, list_distinct({_TOKENS}) AS own, {_TOKENS.replace('text', 'context')} AS ctx FROM marked)
SELECT query_id, sha256(text) AS text_sha256, abst AS abstained, CASE WHEN abst THEN '' ELSE array_to_string(list_sort(list_distinct(list_filter(m, lambda x: x BETWEEN 1 AND n_used))), ',') END AS cited,
  array_to_string(list_filter(m, lambda x, i: (x < 1 OR x > coalesce(n_used, 0)) AND list_position(m, x) = i), ',') AS unknown, NULL::VARCHAR AS error, CASE WHEN NOT abst AND len(own) > 0 THEN round(len(list_intersect(own, ctx)) / len(own), 6) END AS groundedness FROM said""",
    "retrieval_run": f"WITH {_sql_bm25(True)} SELECT count(*) AS n_hits, count(*) FILTER (rank = 1) AS n_answered, max(score) AS top_score, round(coalesce(avg(score), 0.0), 6) AS mean_score FROM hits",
    "ingest_run": f"WITH {_PLAN} SELECT count(*) AS n_files, count(*) FILTER (status = 'ok') AS n_added, count(*) FILTER (status = 'skipped') AS n_skipped, count(*) FILTER (status = 'failed') AS n_failed, count(*) FILTER (status = 'no_text_layer') AS n_needs_ocr FROM plan",
    "mmr_topk": f"""WITH RECURSIVE near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)) WHERE rank <= {FETCH}),
likes AS (SELECT x.query_id, x.chunk_id, list({{'b': y.chunk_id, 's': round(list_inner_product(p.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)}}) AS likes FROM near x JOIN near y ON x.query_id = y.query_id JOIN embeddings p ON p.vec_id = x.chunk_id JOIN embeddings q ON q.vec_id = y.chunk_id GROUP BY ALL),
cand AS (SELECT * FROM near JOIN likes USING (query_id, chunk_id)),
pick AS (SELECT query_id, 1 AS step, [chunk_id] AS sel FROM near WHERE rank = 1
  UNION ALL SELECT query_id, step + 1, list_append(sel, best) FROM (
    SELECT p.query_id, p.step, p.sel, first(c.chunk_id ORDER BY round(0.5 * c.score - 0.5 * list_max(list_transform(list_filter(c.likes, lambda x: list_contains(p.sel, x.b)), lambda x: x.s)), 6) DESC, c.rank) AS best
    FROM pick p JOIN cand c ON c.query_id = p.query_id AND NOT list_contains(p.sel, c.chunk_id) WHERE p.step < 5 GROUP BY p.query_id, p.step, p.sel))
SELECT p.query_id, c.chunk_id, c.score, list_position(p.sel, c.chunk_id)::BIGINT AS rank, c.rank AS former FROM pick p JOIN near c ON c.query_id = p.query_id AND list_contains(p.sel, c.chunk_id) WHERE p.step = (SELECT max(step) FROM pick x WHERE x.query_id = p.query_id)""",
    "sse_events": f"""WITH {_SAID}, p AS (SELECT query_id, text, n, unnest(range(n // 50 + 1)) AS k FROM said), q AS (SELECT query_id, k, CASE WHEN n % 5 = 0 AND k = 1 THEN '[HATA] Cevap üretilemedi.' ELSE replace(substring(text, k * 50 + 1, 50), chr(10), '\\n') END AS t, n FROM p WHERE n % 5 <> 0 OR k <= 1),
e AS (SELECT query_id, k, t FROM q UNION ALL SELECT query_id, max(k) + 1, '[DONE]' FROM q GROUP BY query_id) SELECT query_id, k AS at, 'data: ' || t || chr(10) || chr(10) AS frame FROM e""",
    "text_layer_documents": f"WITH {_LAYERS} SELECT file_name, 1 AS page_count, total_chars, status FROM layers",
    "library_documents": f"""WITH {_LAYERS} SELECT file_name, CASE WHEN total_chars % 10 = 0 THEN 'skipped' ELSE status END AS status, CASE WHEN total_chars % 10 <> 0 AND status = 'ok' THEN 1 ELSE 0 END AS chunk_count,
  total_chars % 10 <> 0 AND status = 'ok' AS is_searchable, total_chars % 10 <> 0 AND status <> 'ok' AS needs_ocr FROM layers""",
    "ingest_documents": f"WITH {_LAYERS} SELECT count(*) AS n_files, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status <> 'ok') AS n_needs_ocr, coalesce(sum(total_chars) FILTER (status = 'ok'), 0)::BIGINT AS ok_chars, coalesce(sum(total_chars) FILTER (status <> 'ok'), 0)::BIGINT AS other_chars FROM layers",
    "parent_passages": f"""WITH split AS (SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM main.documents),
numbered AS (SELECT doc_id, source, w, unnest(range(greatest(ceil((len(w) - 40) / 30), 0)::BIGINT + 1)) AS k FROM split WHERE len(w) > 0),
documents AS (SELECT doc_id * 1000000 + k AS doc_id, doc_id AS page, source, k * 30 AS first_word, least(k * 30 + 40, len(w)) AS end_word, array_to_string(w[k * 30 + 1:k * 30 + 40], ' ') AS text FROM numbered),
{_sql_bm25(True)}, sections AS (SELECT doc_id AS page, k AS number, k * 200 AS s, least(k * 200 + 200, n) AS e FROM (SELECT doc_id, len(w) AS n, unnest(range(greatest(ceil((len(w) - 200) / 200), 0)::BIGINT + 1)) AS k FROM split WHERE len(w) > 0)),
touched AS (SELECT h.query_id, d.source, d.page, number, s, e, h.rank AS hit FROM hits h JOIN documents d ON d.doc_id = h.chunk_id JOIN sections x ON x.page = d.page AND d.first_word < e AND s < d.end_word),
one AS (SELECT DISTINCT query_id, source, page, number, s, e FROM touched), islands AS (SELECT *, number - row_number() OVER (PARTITION BY query_id, page ORDER BY number) AS island FROM one),
merged AS (SELECT i.query_id, i.source, i.page, min(i.s) AS first_word, max(i.e) AS end_word, count(DISTINCT hit) AS n_hits, min(hit) AS best FROM islands i JOIN touched t ON t.query_id = i.query_id AND t.page = i.page AND t.number = i.number GROUP BY i.query_id, i.source, i.page, island)
SELECT query_id, source AS file_name, page, first_word, end_word, n_hits, row_number() OVER (PARTITION BY query_id ORDER BY best, source, page, first_word) AS rank FROM merged""",
    "dense_topk": "SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)) WHERE rank <= 10",
    "rrf_fusion": f"WITH {_FUSED} SELECT query_id, chunk_id, score, rank, retriever_hits FROM rrf",
    "hybrid_topk": f"WITH {_FUSED} SELECT query_id, chunk_id, score, rank, retriever_hits FROM rrf WHERE rank <= {TOP}",
    "retrieval_stage_counts": f"WITH {_FUSED} SELECT query_id, count(*) FILTER (s = 'x') AS n_stemmed, count(*) FILTER (s = 'y') AS n_plain, count(*) FILTER (s = 'f') AS n_fused, count(*) FILTER (s = 'f' AND rank <= {TOP}) AS n_kept FROM (SELECT query_id, 'x' AS s, rank FROM xhits UNION ALL SELECT query_id, 'y', rank FROM yhits UNION ALL SELECT query_id, 'f', rank FROM rrf) GROUP BY query_id",
    "library_totals": f"WITH {_FILES} SELECT count(*) AS n_files, count(*) FILTER (first % 2 = 0) AS n_searchable, 0 AS n_needs_ocr, coalesce(sum(n) FILTER (first % 2 = 0), 0)::BIGINT AS n_chunks FROM files",
    "normalized_text": f"SELECT doc_id, len(n) AS n_chars, sha256(n) AS text_sha256 FROM (SELECT doc_id, {_NORMALIZED} AS n FROM documents)",
    "safe_file_names": _SAFE,
    "embedded_topk": f"WITH {_EMBEDDED} SELECT query_id, chunk_id, score, rank FROM near",
    "hybrid_embedded": f"""WITH {_sql_bm25(True)}, {_EMBEDDED}, every AS (SELECT query_id, chunk_id, 0 AS l, rank FROM hits UNION ALL SELECT query_id, chunk_id, 1, rank FROM near),
fused AS (SELECT query_id, chunk_id, round(sum(1 / (60 + rank)), 9) AS score, count(*) AS retriever_hits, min(l * 1000 + rank) AS seen FROM every GROUP BY ALL)
SELECT query_id, chunk_id, score, rank, retriever_hits FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS rank FROM fused) WHERE rank <= {TOP}""",
    "citation_resolve": f"WITH {_USED} SELECT query_id, marker, chunk_id, file_name FROM cited",
    "answer_view": f"WITH {_USED} SELECT query_id, marker, chunk_id, file_name || ' · s.' || chunk_id AS label, round(score, 4) AS score, substring(coalesce(text, ''), 1, 300) AS preview FROM cited WHERE chunk_id IS NOT NULL",
    "wrong_citations": f"WITH {_USED} SELECT query_id, marker, chunk_id FROM wrong",
    "eval_used": f"WITH {_EVAL_USED} SELECT {', '.join(_SHOWN)}, recall, precision, reciprocal_rank FROM evaluated",
    "eval_failures": f"WITH {_EVAL_USED} SELECT query_id, kind, abstained, n_wrong FROM evaluated WHERE NOT passed",
    "incremental_ingest": f"WITH {_PLAN} SELECT file_name, status, first % 2 = 0 AND status = 'ok' AS replaced, CASE WHEN status = 'ok' THEN n WHEN first % 2 = 0 THEN n - (SELECT count(*) FROM documents WHERE doc_id = 2 AND source = file_name) ELSE 0 END AS n_indexed FROM plan",
    "report_lookup": f"WITH {_PLAN} SELECT file_name, nullif(status, 'skipped') AS reported FROM plan",
    "fusion_consensus": f"WITH {_FUSED} SELECT query_id, count(*) AS n_fused, count(*) FILTER (retriever_hits > 1) AS n_consensus FROM rrf GROUP BY query_id",
    "rerank_minscore": f"""WITH {_sql_bm25(True)},
qs AS (SELECT item_id, list_distinct({_TOKENS}) AS qt FROM benchmark), ds AS (SELECT doc_id, {_TOKENS} AS dt FROM documents),
re AS (SELECT query_id, chunk_id, rank AS former, round(len(list_intersect(qt, dt)) / len(qt), 6) AS score FROM hits JOIN qs ON item_id = query_id JOIN ds ON doc_id = chunk_id)
SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, former) AS rank FROM re WHERE score >= 0.5) WHERE rank <= {TOP}""",
    "context_pack": f"""WITH {_sql_bm25(True)}
SELECT query_id, chunk_id, rank, tokens_so_far FROM (SELECT query_id, chunk_id, rank, sum(n) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS tokens_so_far FROM hits JOIN (SELECT doc_id, len({_TOKENS}) AS n FROM documents) ON doc_id = chunk_id) WHERE tokens_so_far <= 1000 OR rank = 1""",
    "citation_markers": f"""WITH {_SAID}, m AS (SELECT query_id, list_transform(regexp_extract_all(text || ' [' || n % 7 || '] [' || n % 3 || '] [123]', '\\[(\\d{{1,2}})\\]', 1), lambda x: x::INT) AS l FROM said)
SELECT query_id, array_to_string(list_sort(list_distinct(list_filter(l, lambda x: x BETWEEN 1 AND 3))), ',') AS valid, array_to_string(list_filter(l, lambda x, i: (x < 1 OR x > 3) AND list_position(l, x) = i), ',') AS unknown FROM m""",
    "abstention_flags": f"""WITH {_SAID}, t AS (SELECT query_id, CASE n % 4 WHEN 0 THEN 'BU BİLGİ VERİLEN DOKÜMANLARDA YOK' WHEN 1 THEN substring(text, 1, 60) || ' {A.ABSTAIN_PHRASE}.' WHEN 2 THEN text || ' {A.ABSTAIN_PHRASE}' ELSE text END AS t FROM said)
SELECT query_id, contains({_FOLD.format('t')}, {_FOLD.format("'" + A.ABSTAIN_PHRASE + "'")}) AND len(t) < {3 * len(A.ABSTAIN_PHRASE)} AS abstained FROM t""",
    "reasoning_strip": f"""WITH {_SAID}, t AS (SELECT query_id, CASE n % 3 WHEN 0 THEN '<think>a' || chr(10) || 'b</THINK> ' || text || ' <think>open' WHEN 1 THEN '<THINK x="1">u</think>' || text || '</think>' || chr(10) ELSE text END AS t FROM said),
u AS (SELECT query_id, regexp_replace(regexp_replace(regexp_replace(t, '(?is)<think[^>]*>.*?</think>', '', 'g'), '(?is)<think[^>]*>.*$', ''), '(?i)</?think[^>]*>', '', 'g') AS text FROM t)
SELECT query_id, sha256({_STRIPPED}) AS text_sha256 FROM u""",
    "groundedness_parse": f"""WITH {_SAID}, v AS (SELECT query_id, text || chr(10) || CASE WHEN n % 5 = 4 THEN '' ELSE 'desteklenen:  ' || n % 6 END || chr(10) || 'Toplam: ' || n % 7 AS v FROM said),
w AS (SELECT query_id, try_cast(regexp_extract(v, '(?i)desteklenen:\\s*(\\d+)', 1) AS DOUBLE) AS good, try_cast(regexp_extract(v, '(?i)toplam:\\s*(\\d+)', 1) AS DOUBLE) AS total FROM v)
SELECT query_id, CASE WHEN total > 0 AND good IS NOT NULL THEN round(least(1.0, good / total), 6) END AS groundedness FROM w""",
    "sse_frames": f"WITH {_SAID} SELECT query_id, 'data: ' || replace(text, chr(10), '\\n') || chr(10) || chr(10) AS frame FROM said",
    "stream_filter": f"""WITH {_SAID}, t AS (SELECT query_id, CASE n % 3 WHEN 0 THEN '<think>x < y</think>' || text WHEN 1 THEN substring(text, 1, 11) || '<think>x < y</think>a < b' || substring(text, 12) ELSE text || '<think>x < y</think><think>x < y</think>' END AS t FROM said)
SELECT query_id, regexp_replace(t, '(?s)<think>.*?</think>', '', 'g') AS text FROM t""",
    "retrieval_metrics": f"WITH {_METRICS} SELECT * FROM metrics",
    "eval_summary": f"WITH {_JUDGED} SELECT * FROM summary",
    "diagnosis": f"""WITH {_JUDGED}, f AS (SELECT list_filter([CASE WHEN hallucination_rate > 0 THEN 'hallucination' END, CASE WHEN hit_rate < 0.8 THEN 'retrieval' WHEN mrr < 0.5 THEN 'ranking' END,
  CASE WHEN precision < 0.4 AND hit_rate >= 0.8 THEN 'noise' END, CASE WHEN citation_accuracy < 0.9 THEN 'wrong_citations' END, CASE WHEN citation_rate < 0.9 THEN 'missing_citations' END, CASE WHEN fact_accuracy < 0.8 AND hit_rate >= 0.8 THEN 'lost_facts' END], lambda x: x IS NOT NULL) AS l FROM summary),
g AS (SELECT CASE WHEN len(l) = 0 THEN ['none'] ELSE l END AS l FROM f) SELECT unnest(range(len(l))) AS at, unnest(l) AS finding FROM g""",
    "golden_validation": f"""WITH {_GOLDEN}, q AS (SELECT query_id::VARCHAR AS id, kind, (SELECT count(*) FROM expected e WHERE e.query_id = g.query_id) AS n FROM golden g),
a AS (SELECT * FROM q UNION ALL SELECT id, 'unanswerable', n FROM q WHERE id::INT % 7 = 0)
SELECT id, 'duplicate_id' AS problem FROM a GROUP BY id HAVING count(*) > 1 UNION ALL SELECT id, 'answerable_without_source' FROM a WHERE kind = 'answerable' AND n = 0
UNION ALL SELECT id, 'unanswerable_with_source' FROM a WHERE kind = 'unanswerable' AND n > 0 UNION ALL SELECT NULL, 'no_negative_example' WHERE NOT EXISTS (SELECT 1 FROM a WHERE kind = 'unanswerable')""",
    "manifest_currency": f"WITH {_FILES} SELECT file_name, content_hash, first % 2 = 0 AND first % 4 <> 0 AND file_name NOT IN (SELECT source FROM documents WHERE doc_id = 2) AS is_current FROM files",
    "library_listing": f"WITH {_FILES} SELECT file_name, CASE WHEN first % 2 = 0 THEN 'ok' ELSE 'skipped' END AS status, CASE WHEN first % 2 = 0 THEN n ELSE 0 END AS chunk_count, first % 2 = 0 AS is_searchable, false AS needs_ocr FROM files",
    "incremental_add": f"SELECT DISTINCT {_CHUNK_ID} AS chunk_id FROM documents WHERE {_CHUNK_ID} NOT IN (SELECT {_CHUNK_ID} FROM documents WHERE doc_id % 2 = 0)",
    "ingest_report": f"SELECT count(*) AS n_files, sum(p)::BIGINT AS n_pages, count(*) FILTER (c >= 100) AS n_ok, count(*) FILTER (c < 100) AS n_needs_ocr FROM (SELECT count(*) AS p, sum(len({_STRIPPED})) AS c FROM documents GROUP BY source)",
}

_QUERIES = (
    tr_tokenize_stats, stem_vocabulary, normalized_text, chunk_ids, duplicate_documents, text_layer_status, chunk_documents, chunk_tokens, chunk_stats, bm25_idf, bm25_topk, stored_bm25, dense_topk, parent_passages, ann_topk, mmr_topk, rrf_fusion, hybrid_topk, embedded_topk, hybrid_embedded, retrieval_stage_counts, library_totals, fusion_consensus,
    rerank_minscore, rerank_pairs, answers_judged, retrieval_run, ingest_run, context_pack, citation_markers, abstention_flags, reasoning_strip, groundedness_parse, sse_frames, stream_filter, stream_filter_late, retrieval_metrics, eval_summary, diagnosis, golden_validation,
    sse_events, text_layer_documents, library_documents, ingest_documents, citation_resolve, answer_view, wrong_citations, eval_used, eval_failures, manifest_currency, library_listing, incremental_ingest, report_lookup, incremental_add, ingest_pages, library_delete, ingest_report, safe_file_names,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**SQL, "stream_filter_late": SQL["stream_filter"]}
