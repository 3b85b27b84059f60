"""Operators against brute force on small tables with nulls, empty and repeated rows and clashing columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from compare import duckdb_rows, spark_rows
from quarry.llm import common, components, exact_dedup, katz, packing, phrases, pieces, registry, secret_scan, simhash, suffix_dedup, token_counts, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, fingerprint string, blob string"
PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def make(seed=1):
    r = random.Random(seed)
    passage = "".join(r.choice("abcdef ") for _ in range(260))
    texts = [None, "", " ", "A b", 'token = "abcdef123456"', "AKIA" + "B" * 20, "é漢🙂  x\n", "Is " * 400, passage, passage + " more", "x " + passage[20:200]]
    texts += [" ".join(r.choice(["the", "of", "ing", "Word", "zebra,"]) for _ in range(r.randint(0, 120))) for _ in range(25)]
    rows = [(i, t, r.choice(["en", None]), r.choice(["s0", "s0", None]), len(t or ""), 7, "f", "b") for i, t in enumerate(texts)]
    return rows + [rows[9], (None, "A b", "en", "s0", 3, 7, "f", "b"), (100, passage, "en", "s0", 260, 7, "f", "b")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert spark_rows(registry.queries()[name](spark, SF)) == duckdb_rows(registry.oracle_sql()[name], SF)


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for out in (
        katz.score_documents(empty), phrases.fingerprint_documents(empty), token_counts.maintain(empty), simhash.near_duplicates(empty), toxicity.score_documents(empty, labels),
        suffix_dedup.remove_repeats(empty), secret_scan.scan_documents(empty), exact_dedup.exact_dedup(empty), packing.pack(empty, WORDS), pieces.encode_documents(empty, PIECES),
    ):
        assert out.collect() == []


@pytest.mark.parametrize("hot_rows", [1, 1000])
def test_exact_dedup(docs, hot_rows):
    rows = exact_dedup.exact_dedup(docs, ranges=100, hot_rows=hot_rows).collect()
    groups = {}
    for i, t, *_ in make():
        groups.setdefault(t or "", []).append(i)
    assert len(rows) == len(make()) and sum(r.kept for r in rows) == len(groups)
    for r in rows:
        ids = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.keep_id == max(i for i in ids if i is not None) and r.group_size == len(ids)
    assert exact_dedup.keep_unique(docs).count() == len(groups)


def test_equal_texts_are_neighbours_unless_hot(spark):
    """Every text that isn't hot is one run, made by comparison; a hot one has a run for each salt, and a hot lead parts different texts only."""
    lead = "x" * exact_dedup.PREFIX_CHARS
    texts = ["hot"] * 400 + [f"{lead}{i % 150}" for i in range(600)] + [f"t{i % 90}" for i in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    runs = exact_dedup.content_runs(rows, ranges=8, hot_rows=1).groupBy("text_sha256").agg(F.countDistinct("run").alias("runs"), F.max("hot").alias("hot"), F.max("run_size").alias("n"), F.count(F.lit(1)).alias("all")).collect()
    assert len(runs) == 241 and [r.all for r in runs if r.hot] == [400]
    assert all(r.runs == 1 and r.n == r.all for r in runs if not r.hot) and next(r.runs for r in runs if r.hot) > 5
    out = exact_dedup.exact_dedup(rows, ranges=8, hot_rows=1).where("kept").collect()
    assert sorted(r.doc_id for r in out) == sorted(max(i for i, x in enumerate(texts) if x == t) for t in set(texts))
    assert {r.doc_id: r.group_size for r in out}[399] == 400


def test_long_words_of_one_polynomial_hash_differ():
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    assert len(a) == 2048 and len({*katz.word_hashes(a)[:1], *katz.word_hashes(b)[:1], *katz.word_hashes(a[:1024])[:1], *katz.word_hashes(b[:1024])[:1]}) == 4
    assert list(katz.word_hashes(f"x {a} {b} {a}")[[1, 3]]) == list(katz.word_hashes(a)[:1]) * 2


def test_secret_ledger_and_redaction(spark, docs, tmp_path):
    ledger = secret_scan.BlobLedger(spark, f"file://{tmp_path}/ledger")
    found = {r.doc_id: r.spans for r in secret_scan.scan_documents(docs, ledger).collect()}
    assert found[4] == "assign:0:21" and found[5] == "access:0:24" and found[0] == ""
    versions = secret_scan.versions_of(docs)
    assert ledger.unseen(versions, secret_scan.RULES_VERSION).count() == 0
    assert ledger.unseen(versions, "next").count() > 0
    assert ledger.scan(versions, "next", "a") == 1 and ledger.scan(versions, "next", "a") == 0
    clean = {r.doc_id: r for r in secret_scan.redact(docs).collect()}
    assert clean[4].text == '[SECRET]"' and clean[4].n_chars == 9 and clean[0].text is None and clean[3].text == "A b"


def test_token_rollup_is_idempotent(spark, docs, tmp_path):
    rollup = token_counts.TokenRollup(spark, f"file://{tmp_path}/rollup")
    first = sorted(map(str, token_counts.maintain(docs, rollup).collect()))
    assert sorted(map(str, token_counts.maintain(docs, rollup).collect())) == first
    assert sum(r.n_docs for r in rollup.totals().where("tokenizer_version = 'words-1'").collect()) == len({t or "" for _, t, *_ in make()})
    assert sorted(map(str, rollup.compacted(f"file://{tmp_path}/small").totals().collect())) == first


def test_token_counts_are_those_of_sql_and_of_the_library(spark, docs):
    """The query over a whole table: rules by SQL, the tokenizer by its library; nulls, copies and a long text in a small one, where a null is a key."""
    count = Tokenizer.from_file(WORDS)

    def by_library(rows):
        out, seen = Counter(), set()
        for i, t, lang, source in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
            if (t or "") not in seen:
                seen.add(t or "")
                out[source, lang, "n_docs"] += 1
                out[source, lang, "n_tokens"] += len(count.encode(t or "", add_special_tokens=False).ids)
        return dict(out)

    def found(got):
        return {(r.source, r.lang, c): r[c] for r in got.where("tokenizer_version = 'word_bpe_49k'").collect() for c in ("n_docs", "n_tokens")}

    got = registry.op3_token_counts(spark, SF).cache()
    assert spark_rows(got.where("tokenizer_version <> 'word_bpe_49k'")) == duckdb_rows(token_counts.SQL, SF)
    assert found(got) == by_library(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect())
    rows = [(*r[:4],) for r in make()] + [(200, "Ünïcode 漢字 don't <|endoftext|> x1 " * 60_000, None, "s0")]
    small = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    # the repeated row of make() and the copy of "A b" with a null id come last among their texts
    assert found(token_counts.maintain(small, tokenizers={"word_bpe_49k": WORDS})) == by_library(rows)


def test_commits_survive_failures_and_replays(spark, tmp_path):
    delta = lambda n: spark.createDataFrame([("s", "en", "v", 1, n)], token_counts.DELTA)
    rollup = token_counts.TokenRollup(spark, f"file://{tmp_path}/r")
    delta(99).write.parquet(rollup.commits.new_folder())  # written, never committed
    assert rollup.totals().collect() == []
    assert rollup.commit("a", delta(5)) and not rollup.commit("a", delta(5))
    with pytest.raises(ValueError):
        rollup.commit("a", delta(6))
    (tmp_path / "r/commits" / (hashlib.sha256(b"b").hexdigest() + ".json")).write_text("")  # a writer that died
    assert rollup.commit("b", delta(7)) and not rollup.commit("b", delta(7))
    assert not rollup.commits.add("b", rollup.commits.new_folder(), "")  # the second of two writers
    assert rollup.totals().first().n_tokens == 12
    small = rollup.compacted(f"file://{tmp_path}/small")
    assert not small.commit("a", delta(5)) and small.totals().first().n_tokens == 12
    assert small.commit("c", delta(1)) and small.totals().first().n_tokens == 13
    ledger = secret_scan.BlobLedger(spark, f"file://{tmp_path}/l")
    blobs = lambda *t: secret_scan.versions_of(spark.createDataFrame([(x,) for x in t], "text string"))
    secret_scan.LEDGER and spark.createDataFrame([], secret_scan.LEDGER).write.parquet(ledger.commits.new_folder())
    assert ledger.rows().collect() == [] and ledger.scan(blobs("x", "AKIA" + "C" * 16), scan_id="1") == 1
    assert ledger.scan(blobs("x", "AKIA" + "C" * 16), scan_id="1") == 0 and ledger.rows().count() == 2
    with pytest.raises(ValueError):
        ledger.scan(blobs("y"), scan_id="1")
    assert ledger.scan(blobs("x", "y"), scan_id="2") == 1 and ledger.rows().count() == 3


def test_of_two_writers_of_a_batch_the_first_wins(spark, tmp_path, monkeypatch):
    delta = lambda n: spark.createDataFrame([("s", "en", "v", 1, n)], token_counts.DELTA)
    one, two = (token_counts.TokenRollup(spark, f"file://{tmp_path}/r") for _ in range(2))
    monkeypatch.setattr(one.commits, "new_folder", lambda: two.commit("a", delta(5)) and f"file://{tmp_path}/r/data/one")  # the second is done before the first has its marker
    assert not one.commit("a", delta(5)) and one.totals().first().n_tokens == 5
    assert two.commit("b", delta(1)) and one.totals().first().n_tokens == 6


def test_compaction_knows_what_it_has(spark, tmp_path, monkeypatch):
    """A batch that comes while it runs is in neither ids nor totals; one that is lost before its commit refuses no replay."""
    delta = lambda n: spark.createDataFrame([("s", "en", "v", 1, n)], token_counts.DELTA)
    rollup = token_counts.TokenRollup(spark, f"file://{tmp_path}/r")
    rollup.commit("a", delta(5))
    read = common.Commits.read
    monkeypatch.setattr(common.Commits, "read", lambda self, *a: rollup.commit("b", delta(7)) and read(self, *a))
    small = rollup.compacted(f"file://{tmp_path}/small")
    monkeypatch.setattr(common.Commits, "read", read)
    assert small.totals().first().n_tokens == 5 and small.commit("b", delta(7)) and small.totals().first().n_tokens == 12
    monkeypatch.setattr(common.Commits, "_placed", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        rollup.compacted(f"file://{tmp_path}/lost")
    monkeypatch.undo()
    lost = token_counts.TokenRollup(spark, f"file://{tmp_path}/lost")
    assert lost.totals().collect() == [] and rollup.compacted(f"file://{tmp_path}/lost").totals().first().n_tokens == 12
    assert rollup.compacted(f"file://{tmp_path}/lost").totals().first().n_tokens == 12
    with pytest.raises(ValueError):
        lost.commit("c", delta(1)) and rollup.compacted(f"file://{tmp_path}/lost")
    ledger = secret_scan.BlobLedger(spark, f"file://{tmp_path}/l")
    blobs = secret_scan.versions_of(spark.createDataFrame([("x",), ("AKIA" + "C" * 16,)], "text string"))
    assert ledger.scan(blobs, scan_id="1") == 1 and ledger.scan(blobs, "next", "2") == 1
    new = ledger.compacted(f"file://{tmp_path}/l2")
    assert sorted(map(str, new.rows().collect())) == sorted(map(str, ledger.rows().collect())) and new.scan(blobs, scan_id="1") == 0 and new.unseen(blobs, "next").count() == 0


def test_texts_with_very_many_secrets(spark):
    """Offsets over the borders of blocks, in a time that doesn't grow with the square of the matches."""
    text = "".join(f'é {"token" if i % 3 else "x"}= "a{i % 7 * "b"}cdef{i}" ' + ("AKIA" + "Q" * 16 + ", ") * (i % 2) for i in range(16_000))
    began = time.time()
    row = secret_scan.scan_documents(spark.createDataFrame([(1, text), (2, text[: len(text) // 50])], "doc_id long, text string")).where("doc_id = 1").first()
    assert time.time() - began < 15
    want = [(m.start(), 0, m.end()) for m in re.finditer(secret_scan.RULES[0][1], text) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer(secret_scan.RULES[1][1], text)]
    assert row.spans == ",".join(f"{('assign', 'access')[k]}:{a}:{b}" for a, k, b in sorted(want)) and row.n_assign + row.n_access > 16_000


def test_rows_keep_their_columns(spark):
    """One hot text and id, nulls and columns named like the operators' own."""
    texts = ["same text here, one two three"] * 40 + ["", None, "token = abcdef99", "other words", "same text here, one two three"]
    rows = [(None if i == 43 else min(i, 42), t, f"s{i}", f"r{i}", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sha string, row string, join_salt int")
    for out in (exact_dedup.keep_unique(docs), simhash.keep_one(docs), secret_scan.redact(docs)):
        assert out.columns == docs.columns
        by_mark = {r.row: r for r in out.collect()}
        assert all((rows[r.join_salt][2], rows[r.join_salt][0]) == (r.sha, r.doc_id) for r in by_mark.values())
        if out.count() == len(rows):
            assert by_mark["r42"].text == "[SECRET]" and by_mark["r41"].text is None
    assert {r.row for r in simhash.keep_one(docs).collect()} == {"r0", "r40", "r42", "r43"}
    # doc_id 42 is there with two texts: each is judged for itself
    assert {r.text for r in exact_dedup.keep_unique(docs).collect()} == {texts[0], "token = abcdef99", "other words", *{r.text for r in exact_dedup.keep_unique(docs).collect() if not r.text}}


def test_pieces_equal_the_library(docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = pieces.encode_documents(docs, PIECES, with_ids=True).collect()
    texts = {}
    for i, t, *_ in make():
        texts.setdefault(i, t or "")
    assert len(rows) == len(make())
    for r in rows:
        ids = sp.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.decoded == sp.decode(ids)


def test_packing(docs):
    t = Tokenizer.from_file(WORDS)
    want = {}
    for i, x, *_ in make():
        want.setdefault(i, [*t.encode(x or "", add_special_tokens=False).ids, 1])
    rows = packing.pack(docs, WORDS, most=64).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    assert sum(r.length for r in rows) == sum(len(want[i]) for i, *_ in make())
    for r in rows:
        ids = np.array(want[r.doc_id], "<u4")
        assert r.length & (r.length - 1) == 0 and r.length <= 64 and r.offset == 0
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("block", [2, 50_000])
def test_simhash_links(spark, docs, block):
    rows = simhash.near_duplicates(docs, block=block).collect()
    fps = [int(r.fingerprint, 16) for r in rows]
    assert sorted(fps) == sorted(brute_fingerprint(t or "") for _, t, *_ in make())
    label = {f: f for f in fps}
    for _ in fps:
        for a in label:
            for b in label:
                if (a ^ b).bit_count() <= 4:
                    label[a] = label[b] = min(label[a], label[b])
    for r, f in zip(rows, fps):
        assert r.component_id == min(x.doc_id for x, g in zip(rows, fps) if label[g] == label[f] and x.doc_id is not None)


def test_forest_keeps_every_link():
    r = np.random.default_rng(0)
    fps = np.unique(np.concatenate([np.uint64(r.integers(2**63)) ^ (np.uint64(1) << r.integers(0, 12, 200).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 200).astype(np.uint64)) for _ in range(3)]))
    for f in fps[:50]:
        assert (simhash.linked(f, fps) == (np.bitwise_count(fps ^ f) <= 4)).all()


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (7, 7), (10, 11), (None, 1)], "a long, b long")
    assert {(r.node, r.root) for r in components.components(edges).collect()} == {(3, 3), (4, 3), (5, 3), (9, 3), (10, 10), (11, 10)}


def test_phrases(docs):
    rows = phrases.fingerprint_documents(docs).collect()
    order = sorted(make(), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    texts = [t or "" for _, t, *_ in order]
    want = []
    for i, (doc_id, *_) in enumerate(order):
        t, after = texts[i], texts[(i + 1) % len(texts)]
        e = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        a, b, c = (phrases.fingerprint(x)[0] for x in (t, e, after))
        want.append((str(doc_id), hashlib.sha256(e.encode()).hexdigest(), phrases.as_hex(a), phrases.as_hex(b), phrases.likeness(a, b), phrases.likeness(a, c)))
    assert sorted(want) == sorted((str(r.doc_id), r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in rows)


def test_suffix_dedup(docs):
    seen, want = set(), []
    for doc_id, t, *_ in sorted(make(), key=lambda x: (x[0] is not None, x[0] or 0)):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        want.append((str(doc_id), len(b), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    assert sorted(want) == sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect())


def test_anchors_of_chunks_of_every_length(monkeypatch):
    """Each window within a document has one anchor, its leftmost least string, however few bytes the last slice has."""
    monkeypatch.setattr(suffix_dedup, "_SLICE", 256)
    r = random.Random(6)
    data = bytes(r.choice(b"abc") for _ in range(512 + 130))
    for size in [*range(130), *range(256, 256 + 130), *range(512, 512 + 130)]:
        lengths = [size // 3, size - size // 3]
        ids, has = (suffix_dedup.packed(np.array([1, 1], kind)) for kind in (np.int64, np.uint8))
        row = {"doc_ids": ids, "has_id": has, "lengths": suffix_dedup.packed(np.array(lengths, np.int64)), "data": zlib.compress(data[:size])}
        at, h, first, last = suffix_dedup.Chunk(row).anchors()
        starts = suffix_dedup.window_starts(first, last) if len(first) else first
        assert starts.tolist() == [i for end, n in zip((lengths[0], size), lengths) for i in range(end - n, end - 99)]
        if len(at):
            grams = suffix_dedup._gram_hashes(np.frombuffer(data[:size], np.uint8))
            assert (h == grams[at]).all()
            rank = grams & ~suffix_dedup._PLACE
            assert np.repeat(at, last - first + 1).tolist() == [int(i + rank[i : i + 85].argmin()) for i in starts.tolist()]


def test_merge_of_runs_knows_its_prefixes():
    r = random.Random(4)
    runs = [sorted(bytes(r.choice(b"ab") for _ in range(12)) for _ in range(r.randint(0, 30))) for _ in range(5)]
    lcp = lambda x, y: next((i for i in range(12) if x[i] != y[i]), 12)
    coded = [(s, [0, *[lcp(a, b) for a, b in zip(s, s[1:])]][: len(s)]) for s in runs]
    run_of, place, got = suffix_dedup.merge_runs(coded)
    merged = [runs[a][b] for a, b in zip(run_of, place)]
    assert merged == sorted(sum(runs, []))
    assert got == [0, *[lcp(a, b) for a, b in zip(merged, merged[1:])]]


def test_block_max_search_is_exact():
    r = random.Random(5)
    vectors = [{r.choice([r.randrange(12), r.randrange(300)]): r.randint(1, 4) for _ in range(r.randint(0, 8))} for _ in range(700)]
    vectors[600:] = vectors[:100]  # ties
    arrays = [(np.array(sorted(v), np.int64), np.array([v[t] for t in sorted(v)], float)) for v in vectors]
    idf = np.array([1 + i / 10 for i in range(300)])
    index = toxicity.BlockMaxIndex(idf, arrays)
    assert 0 < index.dense.shape[1] < 300 and len(index.edges) > 8
    dense = np.zeros((700, 300))
    for i, v in enumerate(vectors):
        for t, n in v.items():
            dense[i, t] = (1 + np.log(n)) * idf[t] ** 2
        dense[i] /= np.linalg.norm(dense[i]) or 1
    for i, (ids, similarity) in enumerate(index.nearest(arrays, 9, without=np.arange(700))):
        s = np.round(dense @ dense[i], 9)
        s[i] = 0
        last = np.sort(s)[-9]
        assert sorted(ids) == [j for j in range(700) if s[j] >= last and s[j] > 0]
        assert np.allclose(similarity, s[ids], atol=1e-8)


def brute_toxicity(rows, labels, k):
    """Score and evidence of each text by dictionaries: every example's cosine, all ties of the k-th, the monotone fit by definition."""

    def terms(text):
        words = [w for w in re.findall(r"[^\W\d_]+", (text or "").lower())]
        return Counter(words + [w[:n] + "-" for w in words for n in (4, 6) if len(w) > n])

    toxic = {}
    for i, y in labels:
        if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5:
            toxic[i] = max(y, toxic.get(i, 0))
    texts = {}
    for i, t in rows:
        if i in toxic:
            texts[i] = min(t or "", texts.get(i, t or ""))
    examples = [(i, toxic[i], terms(texts[i])) for i in sorted(texts)]
    space = {t for e in examples for t in e[2]}
    df = Counter(t for _, x in rows for t in terms(x) if t in space)
    idf = {t: np.log((1 + len(rows)) / (1 + df[t])) + 1 for t in space}

    def vector(counts):
        v = {t: (1 + np.log(n)) * idf[t] ** 2 for t, n in counts.items() if t in space}
        norm = np.sqrt(sum(x * x for x in v.values())) or 1.0
        return {t: x / norm for t, x in v.items()}

    vectors = [vector(e[2]) for e in examples]
    n = Counter(toxic.values())
    weight = {y: n[y] / sum(e[1] == y for e in examples) for y in (0, 1)}
    prior = n[1] / len(toxic)

    def near(v, without=None):
        s = [(round(sum(x * u.get(t, 0.0) for t, x in v.items()), 9), i) for i, u in enumerate(vectors) if i != without]
        s = sorted(((x, i) for x, i in s if x > 0), key=lambda x: (-x[0], x[1]))
        return [x for x in s if len(s) <= k or x[0] >= s[k - 1][0]]

    def vote(found):
        w = [x * weight[examples[i][1]] for x, i in found]
        scale = 0.2 * np.mean(w)
        return round((sum(x for x, (_, i) in zip(w, found) if examples[i][1]) + scale * prior) / (sum(w) + scale), 9)

    fitted = [(vote(f), examples[i][1], weight[examples[i][1]]) for i, v in enumerate(vectors) if (f := near(v, i))]
    knots = toxicity.monotone_fit(*(np.array(x, float) for x in zip(*fitted)))
    out = []
    for i, t in rows:
        found = near(vector(terms(t)))
        p = float(np.interp(vote(found), *knots)) if found else prior
        out.append((str(i), round(p, 6), ",".join(f"{examples[j][0]}:{examples[j][1]}:{s:.4f}" for s, j in found[:3])))
    return sorted(out)


def test_monotone_fit():
    votes, y, w = np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]), np.array([1.0, 1.0, 3.0, 1.0])
    knots = toxicity.monotone_fit(votes, y, w)
    assert np.allclose(knots[0], [0.1, 0.275, 0.4]) and np.allclose(knots[1], [0.0, 0.25, 1.0])


def test_toxicity_equals_brute_force(spark, monkeypatch):
    """Scores, evidence and classes over nulls, repeats, contradicting labels, a long text and clashing columns."""
    monkeypatch.setattr(toxicity, "NEIGHBOURS", 7)
    r = random.Random(6)
    some = ["on", "the", "of", "reading", "readers", "hermits", "Übung", *[f"zz{chr(97 + i)}abcd" for i in range(20)]]
    rows = [(i, " ".join([*(r.choice(some) for _ in range(r.randint(1, 30))), *(["idiotic", "idiots"][: 1 + i % 2] if i % 4 == 0 else [])])) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "12 !"), (None, "the idiots"), rows[4], rows[5], (203, "nothing alike"), (204, "the idiotic readers " * 9000)]
    labels = [(i, int(i % 4 == 0)) for i in range(100)] + [(5, 1), (None, 1), (7, None), (999, 1), (204, 1)]
    docs = spark.createDataFrame([(*x, "lang", 3, "n", "terms") for x in rows], "doc_id long, text string, text_id string, n long, score string, terms string").repartition(3)
    out = toxicity.score_documents(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    got = sorted((str(x.doc_id), round(x.score, 6), x.evidence) for x in out)
    short = [x for x in labels if x[0] not in (999, 204)]
    want = brute_toxicity(rows, short, 7)
    assert [x[0] for x in got] == [x[0] for x in want]
    # 999 and 204 are labelled but no examples: classes count them
    assert [x[2] for x in got] == [x[2] for x in want]
    assert all(x.predicted == int(x.score >= 0.5) for x in out)
    exact = toxicity.score_documents(docs, spark.createDataFrame(short, "doc_id long, toxic int")).collect()
    assert sorted((str(x.doc_id), round(x.score, 6), x.evidence) for x in exact) == want


def test_toxicity_learns(spark):
    r = random.Random(6)
    rows = [(i, " ".join([*(r.choice("on the of ing her".split()) for _ in range(30)), *(["idiot"] if i % 4 == 0 else [])])) for i in range(400)]
    docs = spark.createDataFrame([*rows, (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    out = toxicity.score_documents(docs, labels).collect()
    assert len(out) == 401 and all(x.predicted == int(x.doc_id % 4 == 0) for x in out if x.doc_id is not None)


def test_toxicity_with_few_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], "doc_id long, text string")
    of = lambda labels: [x.score for x in toxicity.score_documents(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()]
    assert of([]) == [0.0] * 3
    assert all(0 <= x <= 1 for x in of([(1, 1)])) and all(x == 0 for x in of([(1, 0), (2, 0)]))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slope_factors(counts):
    """Simple Good-Turing by the book: Turing estimates, from the first that is near on a line through log counts of counts; then Katz's factors for 1 to 5."""
    n = Counter(c for c in counts if c <= 1000)
    r = sorted(n)
    if len(r) < 2:
        b = -1.05
    else:
        z = []
        for i, x in enumerate(r):
            q = r[i - 1] if i else 0
            t = r[i + 1] if i + 1 < len(r) else 2 * x - q
            z.append(n[x] / (0.5 * (t - q)))
        x, y = np.log(r), np.log(z)
        b = min(-1.05, ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum())
    new, on_line = {}, False
    for k in range(1, 6):
        new[k] = (k + 1) * ((k + 1) / k) ** b
        if not on_line and n[k] and n[k + 1]:
            x = (k + 1) * n[k + 1] / n[k]
            variance = (k + 1) ** 2 * n[k + 1] / n[k] ** 2 * (1 + n[k + 1] / n[k])
            on_line = x >= k or abs(x - new[k]) <= 1.96 * np.sqrt(variance)
            new[k] = new[k] if on_line else x
        else:
            on_line = True
    tail = np.prod([x / k for k, x in new.items()])
    return {k: (x / k - tail) / (1 - tail) for k, x in new.items()}


class BruteKatz:
    """Order 3 over Python dicts, evaluated recursively."""

    def __init__(self, rows):
        train = [[*words_of(t), None] for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
        self.words = Counter(w for d in train for w in d)
        self.total = sum(self.words.values())
        after = {1: {(): self.words}, 2: {}, 3: {}}
        for d in train:
            for v, w in zip([None, *d], d):
                after[2].setdefault((v,), Counter())[w] += 1
            for u, v, w in zip([None, *d], d, d[1:]):
                after[3].setdefault((u, v), Counter())[w] += 1
        self.after = after
        self.d = {k: slope_factors(n for x in a.values() for n in x.values()) for k, a in after.items()}
        self.made = {}

    def of_context(self, context):
        """Discounted probabilities of the seen words, and the backoff weight; None for an unknown context."""
        if context not in self.made:
            order = len(context) + 1
            seen = self.after[order].get(context)
            if seen is None:
                self.made[context] = None
            else:
                c, d = sum(seen.values()), self.d[order]
                cut = {w: n * d.get(n, 1.0) for w, n in seen.items()}
                mass = max(1 - sum(cut.values()) / c, 1 / (c + 1))
                low = sum(self.p(context[1:], w) for w in seen) if context else 0.0
                self.made[context] = {w: x / sum(cut.values()) * (1 - mass) for w, x in cut.items()}, mass / (1 - low)
        return self.made[context]

    def p(self, context, w):
        found = self.of_context(context)
        shorter = (lambda: self.p(context[1:], w)) if context else (lambda: 1.0)  # the unknown word has all that is left
        if found is None:
            return shorter()
        return found[0][w] if w in found[0] else found[1] * shorter()

    def score(self, text):
        d = [*words_of(text), None]
        contexts = [(None,), *zip([None, *d], d)]
        return sum(np.log10(self.p(c, w)) for c, w in zip(contexts, d))


def test_factors_by_turing_and_by_line():
    """Exact counts of counts give Katz's own factors; few, odd or rising ones give the line's; in between the first ones are Turing's."""
    n = {1: 1_000_000, 2: 259_586, 3: 28_000, 4: 9_000, 5: 5_000, 6: 2_000, 7: 1_500, 900: 1}
    tail = 6 * n[6] / n[1]
    assert np.allclose(katz.discounts(n)[1:], [((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail) for r in range(1, 6)])
    line = lambda b: [(((r + 1) / r) ** (1 + b) - 6.0 ** (1 + b)) / (1 - 6.0 ** (1 + b)) for r in range(1, 6)]
    for few in ({}, {3: 4}, {1: 10}):
        assert np.allclose(katz.discounts(few)[1:], line(katz.LEAST_SLOPE))
    for m in (n, {1: 20, 2: 9, 3: 5, 4: 3, 5: 2, 8: 1}, {1: 100, 2: 5_000, 3: 10, 4: 9, 5: 8, 6: 7}, {1: 10**6, 2: 10**5, 3: 10, 4: 9, 5: 8, 6: 7}, {2: 10**6, 4: 10**5}):
        got, want = katz.discounts(m), slope_factors(k for k, v in m.items() for _ in range(v))
        assert np.allclose(got[1:], list(want.values())) and got[0] == 1 and all(0 < x < 1 for x in got[1:])


def check_katz(spark, rows):
    got = {}
    for x in katz.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        got.setdefault(str(x.doc_id), []).append(x)
    model, n = BruteKatz(rows), 0
    for i, t in rows:
        x, d = got[str(i)].pop(), [*words_of(t), None]
        n += x.held_out
        assert x.held_out == (i is not None and zlib.crc32(str(i).encode()) % 7 == 2)
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(d), sum(w in model.words for w in d), model.total)
        base = sum(np.log10((model.words[w] + 1) / (model.total + len(model.words) + 1)) for w in d)
        assert np.allclose([x.base_score, x.score], [base, model.score(t)], rtol=1e-9)
    assert not any(got.values()) and n
    for context in [(), (None,), *list(model.after[2])[:20], *list(model.after[3])[:40]]:
        assert abs(sum(model.p(context, w) for w in [*model.words, "never seen"]) - 1) < 1e-9
    assert all(0 < x < 1 for d in model.d.values() for x in d.values())


def test_katz_equals_brute_force(spark):
    """Every column over nulls, empty and repeated rows and a long text; contexts of all orders sum to 1."""
    rows = [(i, t) for i, t, *_ in make()]
    rows = [x for k, x in enumerate(rows) if x[0] is None or all(y[0] != x[0] for y in rows[:k])]
    r = random.Random(9)
    rows += [(i, " ".join(r.choice(["the", "a", "of", "zebra", f"w{r.randrange(60)}"]) for _ in range(r.randint(1, 60)))) for i in range(200, 260)]
    check_katz(spark, [*rows, (300, " ".join(f"w{r.randrange(40)}" for _ in range(300_000)))])


@pytest.mark.parametrize("hot", [4, 1 << 40])
def test_katz_knows_rare_words(spark, monkeypatch, hot):
    """A word far below 1 of 2**17 tokens has bigrams of its own; frequent contexts are dealt by the pair or not."""
    monkeypatch.setattr(katz, "HOT_SHARE", hot)
    monkeypatch.setattr(katz, "CHUNK_TOKENS", 40_000)
    r = random.Random(7)
    rare = [f"r{i}" for i in range(150)]
    rows = [(i, " ".join(["the of"] * 20_000)) for i in range(10)]
    rows += [(i, " ".join(r.choice(rare) if r.random() < 0.7 else "the" for _ in range(12)) + (" new words" if i % 3 == 0 else "")) for i in range(10, 60)]
    check_katz(spark, [*rows, (None, None)])


def test_katz_replies_are_small(spark, monkeypatch):
    """What places reply of trigrams and their contexts takes few bytes a token: whole numbers, no floats that can't be compressed."""
    monkeypatch.setattr(katz, "CHUNK_TOKENS", 20_000)
    r = random.Random(3)
    rows = [(i, " ".join(f"w{int(r.paretovariate(0.9)) % 5_000}" for _ in range(2_000))) for i in range(60)]
    model = katz.KatzModel(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    replies = model.ngrams[3].where("kind = 'reply'").collect()
    assert sum(len(x) for row in replies for x in row if isinstance(x, (bytes, bytearray))) < 0.55 * 60 * 2_001


def test_suffix_dedup_deals_hot_strings_by_windows(spark, monkeypatch):
    """A passage in all documents between different surroundings: no string brings more than HOT_COPIES rows to its place."""
    monkeypatch.setattr(suffix_dedup, "HOT_COPIES", 5, raising=False)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 5_000)
    r = random.Random(8)
    some = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, pair = some(300), some(200)
    rows = [(i, some(r.randint(0, 200)) + passage + some(r.randint(0, 200))) for i in range(40)]
    rows += [(50, pair), (51, "x" + pair), (52, passage * 2), (None, passage[:150]), (40, rows[3][1]), (40, rows[3][1])]
    job = suffix_dedup.SuffixDedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    times = Counter()
    for run in job.runs(job.shared_grams()).where("kind = 'run'").collect():
        for t in suffix_dedup._decoded(suffix_dedup.unpacked(run.a, np.uint8).astype(np.int64), zlib.decompress(run.b), suffix_dedup.MATCH):
            times[t[:16]] += 1
    assert times and max(times.values()) <= 5
    seen, want = set(), []
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        want.append((str(i), int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    got = suffix_dedup.SuffixDedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).result().collect()
    assert sorted(want) == sorted((str(x.doc_id), x.n_removed, x.kept_sha256) for x in got)


def plain_fingerprint(text):
    """LZ78 with a plain set, a phrase's hash by its definition in whole numbers, each bin's least hash by search."""
    seen, phrases_of, now = set(), [], ""
    for c in text:
        now += c
        if now not in seen:
            seen.add(now)
            phrases_of.append(now)
            now = ""
    bins = [None] * 128
    for p in phrases_of:
        h = (sum((ord(c) + 1) * pow(0x9E3779B97F4A7C15, i, 2**64) for i, c in enumerate(p)) + len(p)) % 2**64
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            h = (h ^ h >> shift) * factor % 2**64
        at = h >> 57
        if bins[at] is None or h < bins[at]:
            bins[at] = h
    return [0 if h is None else max(1, h & 0xFFFF) for h in bins]


def plain_likeness(a, b):
    filled = [(x, y) for x, y in zip(a, b) if x or y]
    return sum(x == y for x, y in filled) / len(filled) if filled else 1.0


def test_phrases_against_brute_force(spark, docs):
    """Every column of every row, successors by (id, text), nulls first."""
    rows = sorted(((i, t or "") for i, t, *_ in make()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    expected = Counter()
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(t) - len(t) // 4
        edited = t[:cut] + after[: len(t) // 4]
        own, other, following = plain_fingerprint(t), plain_fingerprint(edited), plain_fingerprint(after)
        as_hex = lambda f: "".join(f"{x:04x}" for x in f)
        expected[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), as_hex(own), as_hex(other), plain_likeness(own, other), plain_likeness(own, following)] += 1
    got = phrases.fingerprint_documents(docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got) == expected
