"""Chunks against a plain version that tries one unit after the other and counts the joined text each time."""

import json
import random
import re

import public_tokenizers
import pytest

from quarry.functions.embedding import HashingEmbedder
from quarry.operators import chunking
from quarry.operators.chunking import ChunkRules, TokenCounter, chunk_page
from quarry.plans import catalog
from quarry.sources.collection import Collection


def one_by_one(text, rules, count):
    def grow(parts, room, gap, forced):
        """Lengths of consecutive runs of parts, each ended by the first part that is too much."""
        runs, own = [], []
        for p in parts:
            if count(gap.join([*own, p])) > room and (own or not forced):
                runs.append(own)
                own = [p]
            else:
                own.append(p)
        return runs + [own]

    def tail(texts):
        kept = []
        for t in reversed(texts):
            if count(" ".join([t, *kept])) > rules.overlap:
                break
            kept = [t, *kept]
        return " ".join(kept)

    parts = []
    for paragraph in re.split(r"\n\s*\n", text):
        if not paragraph.strip():
            continue
        paragraph = paragraph.strip()
        for s in [paragraph] if count(paragraph) <= rules.target else chunking.sentences(paragraph):
            parts += [s] if count(s) <= rules.target else [" ".join(r) for r in grow(s.split(), rules.target, " ", True)]
    groups, now = [], []
    for p in parts:
        if now and count("\n\n".join([*now, p])) > rules.target:
            groups.append(now)
            whole = "\n\n".join(now)
            lead = (tail(chunking.sentences(whole)) or tail(whole.split())) if rules.overlap else ""
            now = [lead] if lead else []
        if now and count("\n\n".join([*now, p])) > rules.hard_limit:
            now = []
        now.append(p)
    if now:
        if groups and count("\n\n".join(now)) < rules.least and count("\n\n".join([*groups[-1], *now])) <= rules.hard_limit:
            groups[-1] = [*groups[-1], *now]
        else:
            groups.append(now)
    return ["\n\n".join(g) for g in groups]


def pages(seed=6):
    r = random.Random(seed)
    for _ in range(150):
        text = ""
        for _ in range(r.randint(0, 60)):
            text += "".join(r.choice("abcdeé漢") for _ in range(r.choice([1, 2, 5, 9, 40]))) + r.choice([" "] * 8 + [". ", ". ", "! ", "\n\n", " no. ", "\n"])
        yield text


def thirds(text):
    """Three characters a token, however they are parted: not additive."""
    return -(-len(text) // 3)


def merging(text):
    """Pairs of equal neighbouring letters melt, and a text that ends in c loses two more: a longer start may count less."""
    return max(0, len(re.findall(r"(\w)\1|\S", text)) - 2 * text.endswith("c"))


COUNTERS = {"words": chunking.count_words, "thirds": thirds, "merging": merging, "bytes": TokenCounter(public_tokenizers.path("byte_bpe_50k.json")), "bpe": TokenCounter(public_tokenizers.path("word_bpe_49k.json"))}


@pytest.mark.parametrize("name", sorted(COUNTERS))
def test_chunks_are_those_of_one_by_one(name):
    count, n = COUNTERS[name], 0
    for rules in (ChunkRules(20, 5, 3, 25), ChunkRules(40, 0, 10, 40), ChunkRules(60, 20, 30, 80), ChunkRules(9, 8, 2, 300)):
        for text in pages():
            expected = one_by_one(text, rules, count)
            assert chunk_page(text, rules, count) == expected
            n += len(expected)
    assert n > 1000


def test_words_count_alike_with_and_without_running_sums():
    plain = lambda t: len(t.split())
    for text in pages(8):
        assert chunk_page(text, ChunkRules(20, 5, 3, 25), plain) == chunk_page(text, ChunkRules(20, 5, 3, 25))


def test_chunks_know_their_words():
    for text in pages(9):
        words, last = text.split(), 0
        for chunk, first, end in chunking.chunk_spans(text, ChunkRules(20, 5, 3, 25)):
            own = chunk.split()
            assert first <= last <= end and (own == words[first:end] or sorted(set(own)) == sorted(set(words[first:end])))
            last = end
        assert last == len(words)


def test_few_recounts():
    calls = []
    text = " ".join(["word"] * 3000)
    chunk_page(text, ChunkRules(400, 0, 1, 1000), lambda t: calls.append(1) or len(t.split()))
    assert len(calls) < 400


def test_counts_of_words_are_the_tokenizers():
    path = public_tokenizers.path("byte_bpe_50k.json")
    count, tokenizer, r = TokenCounter(path), chunking._tokenizer(path), random.Random(3)
    assert count.parted
    bits = [*"ab'sé漢1_.<|\x1c\x1f\x85\xa0\u2003\u3000\u180e\u200b\r\t\n", " ", " ", "  ", "\n\n", "'ll", "<|endoftext|>", "Word", "012345"]
    for _ in range(3000):
        text = "".join(r.choices(bits, k=r.randint(0, 12)))
        assert count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids), ascii(text)


def test_other_tokenizers_are_asked_whole(tmp_path):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        said = json.load(f)
    for change in ({"normalizer": {"type": "Strip", "strip_left": True, "strip_right": True}}, {"pre_tokenizer": None}, {"added_tokens": [{**said["added_tokens"][0], "lstrip": True}]}, {"pre_tokenizer": {**said["pre_tokenizer"], "use_regex": False}}):
        path = tmp_path / f"{next(iter(change))}{len(list(tmp_path.iterdir()))}.json"
        path.write_text(json.dumps({**said, **change}), encoding="utf-8")
        assert not TokenCounter(str(path)).parted
    assert not COUNTERS["bpe"].parted


def test_a_text_is_tokenized_about_once(monkeypatch):
    path, asked = public_tokenizers.path("byte_bpe_50k.json"), []
    tokenizer = chunking._tokenizer(path)

    class Heard:
        def encode(self, text, **options):
            asked.append(len(text))
            return tokenizer.encode(text, **options)

        def encode_batch_fast(self, texts, **options):
            asked.extend(map(len, texts))
            return tokenizer.encode_batch_fast(texts, **options)

    monkeypatch.setattr(chunking, "_tokenizer", lambda _: Heard())
    if hasattr(chunking, "_counts"):
        chunking._counts.cache_clear()
    r = random.Random(5)
    text = " ".join("".join(r.choices("abcdefgh", k=r.randint(3, 9))) + r.choice(["", "", "", "", "."]) for _ in range(20_000))
    assert len(chunk_page(text, ChunkRules(), TokenCounter(path))) > 100
    assert sum(asked) < 2 * len(text)
    if hasattr(chunking, "_counts"):
        chunking._counts.cache_clear()


@pytest.mark.parametrize("name", ["chunk_documents", "chunk_tokens"])
def test_queries_chunk_whole_documents(spark, name):
    sf = "/root/testdata/sf0.001"
    count = chunking.count_words if name == "chunk_documents" else COUNTERS["bytes"]
    got = {}
    for r in catalog.queries()[name](spark, sf).collect():
        got.setdefault((r.file_name, r.page), {})[r.ordinal] = (r.text, r.token_count)
    texts = {(r.file_name, r.page): r.text for r in catalog._docs(spark, sf).collect()}
    expected = {k: one_by_one(t, ChunkRules(), count) for k, t in texts.items()}
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {k: [(t, count(t)) for t in v] for k, v in expected.items() if v}


def test_chunks_fit_the_embedder(spark):
    assert HashingEmbedder.count_tokens("İki, üç! 4") == 3
    with pytest.raises(ValueError, match="over the embedder's 100"):
        Collection(spark, "file:///tmp/none", HashingEmbedder(max_tokens=100), rules=ChunkRules(50, 5, 1, 101))
