"""Spelling variants, licence scans and source divergence against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quarry.llm import divergence, licenses, spelling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, n long, cell long, spans string, value long, rank string"


def frame(spark, rows):
    """Rows of (doc_id, text, lang, source), with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, "w", 2, 3, "s", 4, "r") for r in rows], SCHEMA).repartition(3)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# spelling


def brute_words(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def spelling_rows(seed=3):
    r = random.Random(seed)
    bases = ["".join(r.choice("abcdé") for _ in range(r.randint(7, 12))) for _ in range(25)]
    bases += ["".join(p) for p in itertools.islice(itertools.permutations("aaabbbc"), 0, 4000, 130)]  # anagrams
    bases += ["aaaaaaa" + x for x in ("a", "b", "aa", "ÿ")] + ["Àbcdefg", "bcdefgÀ", "z" * 300, "z" * 299 + "y"]
    rows = [(None, None, "en", "s"), (1, "", "en", "s"), (2, "short 1234567 ...", "en", "s"), (3, "z" * 300 + " " + "z" * 299 + "Y", None, None)]
    for i in range(400):
        words = []
        for _ in range(r.randint(0, 12)):
            w = bases[min(int(r.expovariate(0.15)), len(bases) - 1)]
            if r.random() < 0.2:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abcdé") + w[k:], w[:k] + r.choice("abcdé") + w[k + 1 :]])
            words.append(r.choice([w, w.upper() if w.isascii() else w]))
        rows.append((i + 10, r.choice([" ", ", ", "1"]).join(words), "en", "s"))
    return rows + [rows[-1], rows[-1], (None, " ".join(bases), "en", "s")]


@pytest.mark.parametrize("cell_words", [4096, 12])
def test_spelling_variants(spark, monkeypatch, cell_words):
    monkeypatch.setattr(spelling, "CELL_WORDS", cell_words)
    rows = spelling_rows()
    words = brute_words(rows)
    assert len(words) > 100 and any(n >= 100 for n in words.values())
    got = spelling.spelling_variants(frame(spark, rows)).collect()
    assert {tuple(x) for x in got} == brute_variants(words) and len(got) == len(words)
    assert any(x.form and x.root not in (x.form, x.word) for x in got) or all(x.root in (x.form, x.word) for x in got)


def test_spelling_chain_of_forms(spark):
    words = {"aaaaaaab": 2, "aaaaaaa": 20, "aaaaaac": 200, "aaaaacc": 2000, "zzzzzzz": 5}
    rows = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {tuple(x) for x in spelling.group_variants(rows).collect()}
    assert got == brute_variants(words) and ("aaaaaaab", "aaaaaaa", "aaaaacc", 2, 1, 20) in got


@pytest.mark.parametrize("pairs", [2**16, 0])
def test_pairs_of_a_cell_with_anagrams(monkeypatch, pairs):
    """Every leaf's way: by comparison, and by looking edited words up."""
    monkeypatch.setattr(spelling, "LEAF_WORDS", 2)
    monkeypatch.setattr(spelling, "LEAF_PAIRS", pairs)
    home = sorted({"".join(p) for p in itertools.permutations("aabbcd")} | {"aabbce", "zzzzzz"})
    for visitors in (home, sorted({w[:k] + w[k + 1 :] for w in home for k in range(6)} | {"yyyyy"})):
        shorter = len(visitors[0]) < 6
        got = [(visitors[i], home[j]) for a, b in spelling.near_in_cell(home, visitors, shorter) for i, j in zip(a, b)]
        assert len(got) == len(set(got))
        assert set(got) == {(v, w) for v in visitors for w in home if one_edit(v, w)}


def test_hot_vector_is_dealt_over_parts():
    sample = ["".join(p) for p in itertools.islice(itertools.permutations("abcdefgh"), 3000)]
    cells = spelling.planned(sample, 16 / spelling.CELL_WORDS)[8]
    assert len(cells.first) == 1 and cells.parts[0] > 10


def test_spelling_of_nothing(spark):
    assert spelling.spelling_variants(frame(spark, [])).collect() == []
    assert spelling.spelling_variants(frame(spark, [(1, None, None, None), (2, "a b", None, None)])).collect() == []


# licences


def brute_scan(text, templates, phrases):
    """Phrases by comparison at each place; matches by testing every string; chains by trying each earlier match of a template."""
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    words, pool = split(text), [split(t) for _, t in templates]
    places = sorted((label, i) for label, p in phrases for i in range(len(words)) if words[i : i + len(split(p))] == split(p))
    known = {tuple(t[i:j]) for t in pool + [split(p) for _, p in phrases] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    size = [0] * (len(words) + 1)
    for end in range(1, len(words) + 1):
        size[end] = next(n for n in range(size[end - 1] + 1, -1, -1) if n == 0 or tuple(words[end - n : end]) in known)
    spans, nodes = [], defaultdict(list)
    for end in range(1, len(words) + 1):
        n = size[end]
        if n < licenses.MIN_MATCH or end < len(words) and size[end + 1] == n + 1:
            continue
        for t, own in enumerate(pool):
            for stop in range(n, len(own) + 1):
                if own[stop - n : stop] == words[end - n : end]:
                    start, at = end - n, stop - n
                    best, covered = None, n
                    for x in nodes[t]:
                        if x["end"] >= start - licenses.MAX_GAP and x["start"] < start and x["at"] < at and x["stop"] < stop and x["end"] < end and at - x["stop"] <= licenses.MAX_GAP:
                            c = x["covered"] + n - max(0, x["end"] - start, x["stop"] - at)
                            if c > covered:
                                best, covered = x, c
                    if best:
                        best["used"] = True
                    first = best or {"start": start, "at": at}
                    nodes[t].append({"start": first["start"], "at": first["at"], "end": end, "stop": stop, "covered": covered, "used": False})
    for t, own in enumerate(pool):
        spans += [(-x["covered"], -x["covered"] / len(own), x["start"], t, x["end"]) for x in nodes[t] if not x["used"] and (x["covered"] >= licenses.MIN_COVERED or x["covered"] >= licenses.MIN_SHARE * len(own))]
    kept = []
    for c, _, start, t, end in sorted(spans):
        if all(end <= s or start >= e for s, e, *_ in kept):
            kept.append((start, end, t, -c))
    return len(words), places, sorted(kept)


def license_rows(seed=5):
    r = random.Random(seed)
    texts = [None, "", "MIT", "mit LICENSE mit\nlicense", "the mit 'license'", "Smit license", "mit licenseé", "GNU General public-LICENSE.", "general public " * 5 + "license"]
    bodies = [t for _, t in licenses.TEMPLATES]
    for _ in range(60):
        words = " ".join(r.choice(bodies) for _ in range(r.randint(0, 2))).split()
        for _ in range(r.randint(0, 12)):
            k = r.randrange(len(words) + 1)
            if r.random() < 0.5:
                words[k : k + r.randint(0, 3)] = []
            else:
                words[k:k] = r.choices(["Jane", "Doe", "the", "software", "without", "license"], k=r.randint(1, 20))
        texts.append("\n".join([" ".join(words[: r.randint(0, len(words))]), " ".join(words)]))
    return [(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, texts[3], "en", "s"), (3, texts[3], "en", "s")]


def test_licence_scan(spark):
    rows = license_rows()
    expected = Counter()
    for doc_id, text, *_ in rows:
        n, places, spans = brute_scan(text or "", licenses.TEMPLATES, licenses.PHRASES)
        expected[doc_id, n, tuple(places), tuple(spans)] += 1
    got = licenses.scan(frame(spark, rows)).collect()
    assert expected == Counter((x.doc_id, x.n_words, tuple(sorted((p.label, p.word) for p in x.places)), tuple((s.first_word, s.end_word, s.template, s.covered) for s in x.spans)) for x in got)
    assert sum(len(x.spans) for x in got) > 60


def test_licence_digest(spark):
    notice = licenses.TEMPLATES[2][1]
    rows = [(1, notice, None, None), (2, "x MIT license. Licensed under CC BY-NC 4.0. Mit License", None, None), (3, "plain words", None, None), (4, None, None, None), (5, notice[:400], None, None)]
    got = {x.doc_id: x for x in licenses.license_digest(frame(spark, rows)).collect()}
    assert got[1].labels == "mit" and got[1].base_labels == "" and got[1].score == 1 and got[1].first_word is None
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels, got[2].labels, got[2].n_words) == (2, 1, 10, "mit", "cc-by-nc,mit", 12)
    assert got[3].labels == "" and got[3].score == 0 and got[4].n_words == 0 and got[5].labels == "mit" and 0.3 < got[5].score < 0.9
    assert licenses.license_digest(frame(spark, [])).collect() == []


def test_words_of_long_texts():
    text = ("a" * 3000 + " mit license é ") * 900
    assert licenses.words_of(text) == [w for _ in range(900) for w in (b"a" * 3000, b"mit", b"license", "é".encode())]
    assert [len(w) for w in licenses.words_of("b" * 3_000_000 + " c " + "d" * 2_000_000)] == [3_000_000, 1, 2_000_000]
    a = licenses.Automaton(licenses.TEMPLATES, licenses.PHRASES)
    n, places, _ = licenses.scan_text(a, text.encode())
    assert n == 3600 and [at for _, at in places] == list(range(1, 3600, 4))
    with pytest.raises(ValueError):
        licenses.Automaton([("x", "a " * (licenses.MAX_TEMPLATE_WORDS + 1))])


# divergence


def brute_audit(rows, min_docs):
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(text or ""))) for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(t for *_, terms in own for t in set(terms))
        kept = sorted(t for t, n in held.items() if n >= min_docs)
        counts = {s: Counter(t for _, x, terms in own if x == s for t in terms) for s in {d[1] for d in own}}
        prices = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        p = {s: prices(c) for s, c in counts.items()}
        q = prices(sum(counts.values(), Counter()))
        for s in p:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in p if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 50)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(found[:most])}
    return out


@pytest.mark.parametrize("block_terms,tile_sources", [(256, 24), (5, 2)])
def test_divergence(spark, monkeypatch, block_terms, tile_sources):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", block_terms)
    monkeypatch.setattr(divergence, "TILE_SOURCES", tile_sources)
    r = random.Random(9)
    terms = ["".join(r.choice("abéÉß漢") for _ in range(r.randint(1, 3))) for _ in range(90)]
    rows = [(None, None, None, None), (0, "", "en", "lone"), (0, "12 ...", "xx", "a"), (0, "only once", "xx", "b"), (1, "A" * 50, "yy", "alone")]
    for i in range(300):
        lang = r.choice(["en", "en", "de", None])
        text = r.choice([" ", "-", "7"]).join(terms[min(int(r.expovariate(0.08)), 89)] for _ in range(r.randint(0, 60)))
        rows.append((i, text, lang, r.choice(["s1", "s1", "s1", "S2", None, "é", *"abcdef"])))
    rows += [rows[-1], rows[-1]]
    for min_docs in (4, 10**6):
        got = divergence.audit(frame(spark, rows), min_docs).collect()
        assert {tuple(x) for x in got} == brute_audit(rows, min_docs) and len(got) == len({tuple(x) for x in got})
    assert divergence.audit(frame(spark, [])).collect() == []


def test_prices_of_large_counts(spark):
    row = spark.range(1).select(divergence.price((divergence.F.col("id") + 10**14).cast("long"), divergence.F.lit(10**16), divergence.F.lit(3)).alias("p"), divergence.price(divergence.F.col("id"), divergence.F.lit(0), divergence.F.lit(1)).alias("one")).first()
    assert row.p == 1 + 10**9 * (10**14 + 5) // (10**16 + 15) and row.one == 1 + 10**9
