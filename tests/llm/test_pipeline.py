"""The pipeline's stages against brute force over what each stage got."""

from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import simhash, toxicity
from quarry.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        kept.append((docs, out))
        docs = out
    (before, clean), (_, single), (_, apart), (_, masked) = kept
    bad = {r.doc_id for r in toxicity.score_documents(before, table(spark, SF, "labels")).collect() if r.predicted}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in before.collect()} - bad
    last = {}
    for r in clean.collect():
        last[r.text] = max(r.doc_id, last.get(r.text, -1))
    assert {r.doc_id for r in single.collect()} == set(last.values())
    fps = {r.doc_id: simhash.fingerprint(r.text) & (2**64 - 1) for r in single.collect()}
    root = {i: i for i in fps}
    for _ in range(4):
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    assert {r.doc_id for r in apart.collect()} == {i for i in fps if root[i] == i}
    assert Counter(r.doc_id for r in masked.collect()) == Counter(r.doc_id for r in apart.collect())
    pieces = corpus_pipeline.STAGES[-1][1](spark, masked, SF).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in masked.collect()}
    got = Counter()
    for p in pieces:
        got[p.doc_id] += p.length
    assert dict(got) == want
