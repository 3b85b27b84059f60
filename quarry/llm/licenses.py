"""Licence scans with one generalised suffix automaton over the words of licence templates.

A text is streamed through the automaton once. At each word the automaton knows the longest string of words ending there
that some template has too (the matching statistics), and where in which templates it stands. Matches that can't be
extended and are long enough are chained: within a template a chain goes forward in text and template, with small gaps
in both. A chain that covers enough of its template is a span. Short phrases are templates as well; their places
are read off the automaton's suffix links, so they need no second search.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import id_and_text, split_words
from quarry.llm.license_texts import TEMPLATES

#: Phrases whose every place counts (fixed by the contract).
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
#: Words that a match must have; words that two matches of a chain may lie apart, in the text and in the template.
MIN_MATCH, MAX_GAP = 4, 12
#: A chain is a span if it covers this share of its template, or so many words of it.
MIN_SHARE, MIN_COVERED = 0.7, 24
#: Templates go to every task; so many words of them fill about 100 MB there, and more are an error.
MAX_TEMPLATE_WORDS = 2**17
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return [w for piece in split_words(text.encode(), _TABLE) for w in piece]


class Automaton:
    """A suffix automaton of several word sequences. occurs: (template, last word's index) of each state's strings; phrases: those that end a state's string."""

    def __init__(self, templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]] = ()):
        self.labels, self.phrases = [label for label, _ in templates], [(label, len(words_of(p))) for label, p in phrases]
        sequences = [words_of(text) for _, text in templates]
        texts = sequences + [words_of(p) for _, p in phrases]
        if sum(map(len, texts)) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates have more than {MAX_TEMPLATE_WORDS} words")
        self.sizes = list(map(len, sequences))
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        numbered = [[self.ids.setdefault(w, len(self.ids)) for w in words] for words in texts]
        for words in numbered:
            last = 0
            for c in words:
                last = self._extended(last, c)
        self.occurs: list[list[tuple[int, int]]] = [[] for _ in self.next]
        self.ending: list[list[int]] = [[] for _ in self.next]
        for t, words in enumerate(numbered):
            v = 0
            for end, c in enumerate(words):
                v = self.next[v][c]
                if t < len(templates):
                    u = v
                    while u > 0:
                        self.occurs[u].append((t, end))
                        u = self.link[u]
            if t >= len(templates) and v:
                self.ending[v].append(t - len(templates))
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.ending[v] = self.ending[self.link[v]] + self.ending[v]

    def _state(self, moves: dict[int, int], length: int, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _parted(self, p: int, c: int) -> int:
        """The state of p's string and c: the present one, or a copy if that has longer strings too."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extended(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._parted(last, c)
        new, p = self._state({}, self.length[last] + 1, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._parted(p, c)
        return new


class Chains:
    """Chains of matches in one text, by template; matches come in order of their ends."""

    def __init__(self, sizes: list[int]):
        self.sizes, self.open, self.spans = sizes, {}, []

    def _end(self, template: int, chain: list) -> None:
        """chain: start and end in the text, start and end in the template, covered words, whether a longer one has it."""
        start, end, _, _, covered, used = chain
        if not used and (covered >= MIN_COVERED or covered >= MIN_SHARE * self.sizes[template]):
            self.spans.append((template, start, end, covered))

    def add(self, template: int, start: int, end: int, at: int) -> None:
        """A match of words start to end of the text with the template's words from at on."""
        stop, mine = at + end - start, self.open.setdefault(template, [])
        best, best_covered = None, end - start
        alive = []
        for chain in mine:
            if chain[1] < start - MAX_GAP:
                self._end(template, chain)
                continue
            alive.append(chain)
            if chain[0] < start and chain[2] < at and chain[3] < stop and chain[1] < end and at - chain[3] <= MAX_GAP:
                covered = chain[4] + end - start - max(0, chain[1] - start, chain[3] - at)
                if covered > best_covered:
                    best, best_covered = chain, covered
        if best is None:
            alive.append([start, end, at, stop, best_covered, False])
        else:
            best[5] = True
            alive.append([best[0], end, best[2], stop, best_covered, False])
        self.open[template] = alive

    def done(self) -> list[tuple[int, int, int, int]]:
        for template, chains in self.open.items():
            for chain in chains:
                self._end(template, chain)
        return self.spans


def chosen(spans: list[tuple[int, int, int, int]], sizes: list[int]) -> list[tuple[int, int, int, int]]:
    """Of spans that overlap, the one that covers most words stays (then the larger share, the first start, the first template); in order of starts."""
    kept: list[tuple[int, int, int, int]] = []
    for template, start, end, covered in sorted(spans, key=lambda s: (-s[3], -s[3] / sizes[s[0]], s[1], s[0])):
        i = bisect_left(kept, (start,))
        if (i == len(kept) or kept[i][0] >= end) and (i == 0 or kept[i - 1][1] <= start):
            insort(kept, (start, end, template, covered))
    return kept


def scan_text(a: Automaton, text: bytes) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int, int]]]:
    """Number of words, (phrase, first word) of every place of a phrase, and the chosen (start, end, template, covered) spans."""
    moves, link, length, ending, occurs, phrases = a.next, a.link, a.length, a.ending, a.occurs, a.phrases
    places, chains, n, v, size = [], Chains(a.sizes), 0, 0, 0
    get, root = a.ids.get, moves[0]

    def ended(end: int) -> None:
        if size >= MIN_MATCH:
            for template, last in occurs[v]:
                chains.add(template, end - size, end, last + 1 - size)

    for words in split_words(text, _TABLE):
        for c in map(get, words):
            if c is None:
                if size:
                    ended(n)
                    v = size = 0
            else:
                if c in moves[v]:
                    v = moves[v][c]
                    size += 1
                else:
                    ended(n)
                    while v and c not in moves[v]:
                        v = link[v]
                    size = length[v] + 1
                    v = moves[v][c] if v else root[c]
                if ending[v]:
                    places += [(p, n + 1 - phrases[p][1]) for p in ending[v] if phrases[p][1] <= size]
            n += 1
    ended(n)
    return n, places, chosen(chains.done(), a.sizes)


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())]))),
])
_SCHEMA = "doc_id long, n_words long, places array<struct<label:string,word:long>>, spans array<struct<label:string,template:int,first_word:long,end_word:long,covered:long,share:double>>"


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """A row per row of docs: doc_id, n_words, places (label, first word) of phrases, spans (label, template's index, first word, end, covered words and share of the template).

    Nulls: a null text is empty, a null doc_id stays null. An empty text has 0 words and neither places nor spans; a very long text is read piece by
    piece. Repeated rows have a row each. Of spans that tie, the first start and then the first template stay. An empty
    table gives an empty result; other columns are ignored. A share lies over 0 and is 1 at most.
    """
    automaton = Automaton(templates, phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, sizes = automaton.labels, automaton.sizes
        for batch in batches:
            n_words, places, spans = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                n, found, covered = scan_text(automaton, text.as_py())
                n_words.append(n)
                places.append([(automaton.phrases[p][0], at) for p, at in found])
                spans.append([(labels[t], t, start, end, c, c / sizes[t]) for start, end, t, c in covered])
            struct = lambda rows, kind: pa.array([[dict(zip(kind.value_type.names, x)) for x in row] for row in rows], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), struct(places, _OUT.field("places").type), struct(spans, _OUT.field("spans").type)], schema=_OUT)

    return id_and_text(docs).mapInArrow(run, _SCHEMA)


def license_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of docs; see scan() for nulls, empty texts, ties and repeats.

    score: 1 where a phrase stands, else the largest share of a template that a span covers, 0 without one.
    """
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base = F.col("places.label")
    best = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.share"), F.lit(0.0)))
    return scan(docs).select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.col("spans.label"))).alias("labels"), best.alias("score"), "spans",
    )
