from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from compare import duckdb_rows, spark_rows
from quarry.functions import text as T
from quarry.operators import answers as A
from quarry.operators import chunking, library, retrieval
from quarry.plans import catalog
from quarry.sources import store
from quarry.streaming.pieces import ReasoningFilter

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert spark_rows(catalog.queries()[name](spark, SF)) == duckdb_rows(catalog.oracle_sql()[name], SF)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "token,stem",
    [("poliçenin", "poliç"), ("gövdesi", "gövd"), ("raporların", "rapor"), ("güvenliğin", "güvenlik"), ("kitabın", "kitap"), ("kodun", "kodun"), ("standard", "standart"), ("binlik", "binlik")],
)
def test_stems(spark, token, stem):
    assert one(spark, T.light_stem(F.lit(token))) == stem


def test_normalize(spark):
    assert one(spark, T.normalize_text(F.lit("  a\x00b  c-\nd 2020-\n2021\n\n\n\ne \n"))) == "ab cd 2020-\n2021\n\ne"


def test_fusion_ties(spark):
    lists = [spark.createDataFrame(rows, "query_id long, chunk_id string, rank long") for rows in ([(1, "A", 1), (1, "B", 2)], [(1, "C", 1), (1, "B", 2)])]
    rows = retrieval.reciprocal_rank_fusion(lists).orderBy("rank").collect()
    assert [(r.chunk_id, r.retriever_hits) for r in rows] == [("B", 2), ("A", 1), ("C", 1)]


def test_zero_idf_is_a_hit(spark):
    docs = spark.createDataFrame([(1, "elma armut"), (2, "kiraz")], "chunk_id long, text string")
    hits = retrieval.Bm25Index(docs).search(spark.createDataFrame([(1, "elma")], "query_id long, query_text string"), 5).collect()
    assert [(h.chunk_id, h.score) for h in hits] == [(1, 0.0)]


def test_context_budget(spark):
    hits = spark.createDataFrame([(1, i, 100) for i in range(1, 11)], "query_id long, rank long, token_count long")
    assert A.pack_context(hits, 250).count() == 2
    assert A.pack_context(hits, 50).count() == 1


def test_chunker_vectors():
    rules = chunking.ChunkRules(20, 5, 3, 25)
    page = " ".join(" ".join(f"w{s}x{i}" for i in range(7)) + f" end{s}." for s in range(6))
    assert [chunking.count_words(c) for c in chunking.chunk_page(page, rules)] == [16, 13, 13, 13, 13]
    assert chunking.chunk_page("", rules) == []


def test_safe_names(spark):
    cases = {"../../../etc/passwd": "passwd", "C:\\Windows\\win.ini": "win.ini", "CON.pdf": None, ".gizli.pdf": None, "a*b.pdf": None, "rapor\x00.pdf": None, "": None}
    df = spark.createDataFrame([(k,) for k in cases], "n string").select("n", library.safe_name(F.col("n")).alias("s"))
    assert {r.n: r.s for r in df.collect()} == cases


def test_stream_filter_over_split_tags():
    f = ReasoningFilter()
    assert "".join(map(f.feed, ["a <th", "ink>x </thi", "nk>b < c"])) + f.finish() == "a b < c"


def test_index_versions(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    chunks = spark.createDataFrame([("c1", [1.0, 0.0])], "chunk_id string, embedding array<float>")
    store.save_index(chunks, path, "m", 2)
    assert store.load_index(spark, path, "m", 2).count() == 1
    with pytest.raises(store.IndexCompatibilityError):
        store.load_index(spark, path, "other", 2)


def test_answer_pipeline_without_context(spark):
    queries = spark.createDataFrame([(1, "q1"), (2, "q2")], "query_id long, query_text string")
    hits = spark.createDataFrame([(1, 1, 10, "metin", "f.pdf", 1, "")], "query_id long, rank long, token_count long, text string, file_name string, page int, section string")
    llm = lambda df: df.select("query_id", F.lit("cevap [1][4]").alias("text"))
    rows = {r.query_id: r for r in A.answer_pipeline(queries, hits, llm, "{context} {question} {abstain_phrase}").collect()}
    assert rows[1].citations == [1] and rows[1].unknown_markers == [4] and not rows[1].abstained
    assert rows[2].abstained and rows[2].citations == []


def test_pages_keep_their_words_in_chunks():
    rules = chunking.ChunkRules(20, 0, 1, 25)
    page = "Bir bkz. iki no. üç. Dört!\n\n" + " ".join(f"s{i}" for i in range(65)) + "\n \nson"
    got = chunking.chunk_page(page, rules)
    assert " ".join(got).split() == page.split()
    assert all(chunking.count_words(c) <= rules.hard_limit for c in got)
    assert chunking.sentences("Bir bkz. iki no. üç. Dört!") == ["Bir bkz. iki no. üç.", "Dört!"]


def test_files_by_loader(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("käse", encoding="utf-8")
    (tmp_path / "b.html").write_text("<p>a &amp; b</p><script>x</script>", encoding="utf-8")
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "d.bin").write_bytes(b"1")
    rows = {r.file_name: r for r in store.load_files(spark, f"file://{tmp_path}").collect()}
    assert set(rows) == {"a.TXT", "b.html", "c.txt"}
    assert rows["a.TXT"].text == "käse" and rows["b.html"].text.split() == ["a", "&", "b"]
    assert rows["c.txt"].text is None and rows["c.txt"].error.startswith("UnicodeDecodeError")


def test_manifest_is_empty_unless_whole(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    assert store.load_manifest(spark, path).count() == 0
    row = spark.createDataFrame([("f", "h", "ok", 1, 1, ["c"], "m", None, None)], store.MANIFEST)
    store.upsert_manifest(store.load_manifest(spark, path), row, path)
    assert [r.file_name for r in store.load_manifest(spark, path).collect()] == ["f"]
    for name, line in (("broken", "{no"), ("other", '{"file_name": "f", "format": 9}')):
        (tmp_path / name).write_text(line + "\n")
        assert store.load_manifest(spark, f"file://{tmp_path}/{name}").count() == 0


def test_question_sets_evaluations_and_prompts(spark, tmp_path):
    path = f"file://{tmp_path}"
    questions = spark.createDataFrame([("q", "nerede?", "answerable", [("f", 1)], ["x"], [])], store.GOLDEN)
    store.save_golden(questions, f"{path}/golden")
    assert store.load_golden(spark, f"{path}/golden").collect() == questions.collect()
    questions.withColumn("format", F.lit(9)).write.json(f"{path}/later")
    with pytest.raises(ValueError):
        store.load_golden(spark, f"{path}/later")
    at = datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc)
    assert store.save_evaluation(questions, path, at).endswith("/eval_20240102T030405Z")
    with pytest.raises(Exception, match="exist"):
        store.save_evaluation(questions, path, at)
    (tmp_path / "v1").mkdir()
    (tmp_path / "v1" / "answer.txt").write_text("{question}\n{context}")
    assert store.load_prompt(spark, path, "v1", "answer") == "{question}\n{context}"
    for version, name, there in (("v2", "answer", "v1"), ("v1", "judge", "answer.txt")):
        with pytest.raises(KeyError, match=there):
            store.load_prompt(spark, path, version, name)


def test_readers_take_the_last_whole_version(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    chunks = spark.createDataFrame([("c1", [1.0, 0.0])], "chunk_id string, embedding array<float>")
    store.save_index(chunks, path, "m", 2)
    store.save_index(chunks.union(chunks), path, "m", 2)
    (tmp_path / "index" / "snapshots" / ".draft").write_text("{")  # a writer that was lost
    (tmp_path / "index" / "abc" / "chunks").mkdir(parents=True)
    assert store.load_index(spark, path, "m", 2).count() == 2
    assert len(store.expire_index(spark, path, 1)) == 1 and store.load_index(spark, path, "m", 2).count() == 2
    with pytest.raises(store.IndexCompatibilityError, match="no index"):
        store.load_index(spark, f"{path}2", "m", 2)


def test_evaluation_uses_the_citations(spark):
    from quarry.operators import evaluation

    questions = spark.createDataFrame([(1, "answerable", ["Elma"], []), (2, "unanswerable", None, ["armut"])], "query_id long, kind string, must_contain array<string>, must_not_contain array<string>")
    expected = spark.createDataFrame([(1, "f", None)], "query_id long, file_name string, page long")
    used = spark.createDataFrame([(1, 1, "a", "f", 3), (1, 2, "b", "g", 1), (2, 1, "b", "g", 1)], "query_id long, rank long, chunk_id string, file_name string, page long")
    answers = spark.createDataFrame([(1, "elma [1] [2] [7]", False), (2, "ARMUT [1]", False)], "query_id long, text string, abstained boolean")
    one, two = evaluation.evaluate(questions, expected, used, answers, 3).orderBy("query_id").collect()
    assert (one.hit, one.n_citations, one.n_wrong, one.facts_ok, one.citations_correct, one.passed) == (True, 2, 1, True, False, False)
    assert (two.n_wrong, two.forbidden, two.hallucinated, two.passed) == (0, True, True, False)


def test_sections_are_cut_of_pages_with_hits_alone(spark, tmp_path, monkeypatch):
    docs = [(i, f"word{i} " * 450 if i != 7 else "apple " * 450, "en", f"src{i % 3}", 9) for i in range(12)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "an apple")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    cut, windows = [], chunking.windows
    monkeypatch.setattr(chunking, "windows", lambda pages, size, step: cut.append((size, pages.count())) or windows(pages, size, step))
    rows = catalog.parent_passages(spark, str(tmp_path)).collect()
    assert [(r.query_id, r.page) for r in rows][0] == (1, 7) and {r.page for r in rows} == {7}
    assert cut == [(40, 12), (200, 1)]
