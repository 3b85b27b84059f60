"""Token-budgeted chunking of pages by offsets: a page becomes units with sizes, running sums give the cuts."""

from __future__ import annotations

import functools
import json
import os
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate, pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import chunk_id
from quarry.operators.retrieval import spread

# Abbreviations after which a sentence goes on.
ABBREVIATIONS = (
    "vb.", "vs.", "bkz.", "örn.", "yy.", "no.", "sy.", "md.", "bkz", "dr.", "prof.", "doç.", "av.", "sn.", "mm.", "cm.", "km.", "kg.",
    "a.ş.", "ltd.", "şti.", "tl.", "usd.",
)
# Where paragraphs and sentences end, and what parts the units of a chunk.
PARAGRAPH_END, SENTENCE_END, GAP = r"\n\s*\n", r"(?<=[.!?:])\s+", "\n\n"


def count_words(text: str) -> int:
    return len(text.split())


#: Of a counter with this mark, a text's count is the sum of its parts', whatever blanks part them.
count_words.additive = True


#: A word with the blanks before it, or a text's last blanks; by Unicode's White_Space, which has less than str.isspace().
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNIT = re.compile(f"[{_BLANK}]*[^{_BLANK}]+|[{_BLANK}]+")
#: Units, and characters of them, whose counts a worker keeps.
KEPT, KEPT_CHARACTERS = 1 << 18, 1 << 22


class TokenCounter:
    """Counts the tokens of a tokenizer file (library tokenizers) without special ones; each worker loads it once.

    Where the tokenizer never joins what stands before a blank with the blank (see _parts_at_blanks), a text's count is the sum of its
    words' counts, each with the blanks before it, and a worker keeps those.
    """

    additive = False

    def __init__(self, path: str):
        self.path = path

    @property
    def parted(self) -> bool:
        return _counts(self.path) is not None

    def begin(self, text: str) -> None:
        """A text whose parts are to be counted."""
        if self.parted:
            _counts(self.path).begin(text)

    def over(self, text: str, limit: int) -> bool:
        """Whether a text has more tokens than limit; of a long one the first words mostly tell."""
        counts = _counts(self.path)
        if counts is not None and len(text) > 16 * limit and sum(map(counts.__getitem__, _UNIT.findall(text[: 16 * limit])[:-1])) > limit:
            return True
        return self(text) > limit

    def __call__(self, text: str) -> int:
        counts = _counts(self.path)
        return counts.of(text) if counts is not None else len(_tokenizer(self.path).encode(text, add_special_tokens=False).ids)


class _Counts(dict):
    """A tokenizer's counts of units, and of the parts of the text at hand: those that are not there are counted."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.characters = tokenizer, 0
        self.texts, self.text_characters = {}, 0

    def __missing__(self, unit: str) -> int:
        self._learn([unit])
        return self[unit]

    def _learn(self, units: list[str]) -> None:
        if len(self) > KEPT or self.characters > KEPT_CHARACTERS:
            self.clear()
            self.characters = 0
        for unit, tokens in zip(units, self.tokenizer.encode_batch_fast(units, add_special_tokens=False)):
            self[unit] = len(tokens)
            self.characters += len(unit)

    def of(self, text: str) -> int:
        """A text's count; parts of a text that is being chunked come more than once."""
        n = self.get(text)
        if n is None and (n := self.texts.get(text)) is None:
            if self.text_characters > KEPT_CHARACTERS:
                self.forget()
            n = self.texts[text] = sum(map(self.__getitem__, _UNIT.findall(text)))
            self.text_characters += len(text)
        return n

    def forget(self) -> None:
        self.texts.clear()
        self.text_characters = 0

    def begin(self, text: str) -> None:
        """Count the units of a text that is to be chunked, many at once."""
        self.forget()
        new = [u for u in set(_UNIT.findall(text)) if u not in self]
        for start in range(0, len(new), 64):
            self._learn(new[start : start + 64])


@functools.lru_cache(4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return Tokenizer.from_file(path)


@functools.lru_cache(4)
def _counts(path: str) -> _Counts | None:
    return _Counts(_tokenizer(path)) if _parts_at_blanks(path) else None


@functools.lru_cache(4)
def _parts_at_blanks(path: str) -> bool:
    """Whether a tokenizer ends a piece before every run of blanks after a word, whatever follows: byte-level pieces by its own pattern, of the
    text as it is, and no token beside the model's that takes blanks in."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    pre, model, added = said.get("pre_tokenizer") or {}, said["model"], said.get("added_tokens") or []
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and not said.get("normalizer") and not said.get("truncation") and not said.get("padding")
    return plain and model.get("type") == "BPE" and not model.get("dropout") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(f"[{_BLANK}]", t["content"]) for t in added)


def sentences(text: str) -> list[str]:
    """Sentences; the parts on both sides of an abbreviation are one."""
    parts = [p for p in re.split(SENTENCE_END, text) if p.strip()]
    folded = [p.strip().lower() for p in parts]
    starts = [0, *(i for i in range(1, len(parts)) if not (folded[i].startswith(ABBREVIATIONS) or folded[i - 1].endswith(ABBREVIATIONS))), len(parts)]
    return [" ".join(parts[a:b]) for a, b in pairwise(starts) if a < b]


@dataclass(frozen=True)
class ChunkRules:
    target: int = 400
    overlap: int = 80
    least: int = 32
    hard_limit: int = 1024
    #: Tokens that a longer start of a text may have less than a shorter one, by the counter in use.
    slack: int = 4

    def __post_init__(self):
        if not 0 <= self.overlap < self.target <= self.hard_limit:
            raise ValueError("overlap < target <= hard_limit is required")


class Sizes:
    """Running sums of the sizes of a list of texts; for additive counters."""

    def __init__(self, texts: list[str], count: Callable[[str], int]):
        self.sums = [0, *accumulate(map(count, texts))]

    def reach(self, a: int, room: int, lead: int = 0) -> int:
        """The first end after a at which texts a to the end, and lead more, are over room; else the end of the list. Less one."""
        return bisect_right(self.sums, self.sums[a] + room - lead) - 1


class Parted:
    """Running sums of the sizes of joined texts, which neither begin nor end with a blank; for counters that part texts at blanks."""

    def __init__(self, texts: list[str], count: Callable[[str], int], gap: str):
        self.texts, self.count, self.gap = texts, count, gap
        # only a space goes with the word after it: other gaps have a count of their own
        self.apart = None if gap.endswith(" ") else count(gap + ".") - count(".")
        self.sums = [0, *accumulate(map(self.after, texts))]

    def after(self, text: str) -> int:
        """The size of a text that stands after a gap, and of the gap."""
        if self.apart is not None:
            return self.apart + self.count(text)
        first = _UNIT.match(text)[0]
        return self.count(self.gap + text) if first == text else self.count(text) + self.count(self.gap + first) - self.count(first)

    def reach(self, a: int, room: int, lead: int = 0) -> int:
        """As Sizes.reach(); a lead stands before a gap."""
        first = self.count(self.texts[a]) + self.sums[a] - self.sums[a + 1]
        return bisect_right(self.sums, self.sums[a] + room - (lead or first)) - 1


def _parted_suffix(texts: list[str], room: int, count: Callable[[str], int]) -> int:
    """Of how many texts the longest suffix within room is, if all shorter ones are."""
    sizes, n, total = Parted([], count, " "), 0, 0
    for text in reversed(texts):
        # no token is shorter than a byte: most texts need no count of their own
        if total + len(text.encode()) > room and total + count(text) > room:
            break
        n, total = n + 1, total + sizes.after(text)
    return n


class Joined:
    """Sizes of joined texts, counted anew as often as it takes.

    A run ends before the first text with which it is over room. To find it, starts of 1, 2, 4 and so on texts are counted, and halves between
    the last two; a start that has slack tokens to spare shows that none before it was over. From the largest such start on,
    each is counted: these are few, as they lie within slack of the room.
    """

    def __init__(self, texts: list[str], count: Callable[[str], int], gap: str, slack: int, backward: bool = False):
        self.texts, self.count, self.gap, self.slack, self.step = texts, count, gap, slack, -1 if backward else 1

    def reach(self, a: int, room: int, lead: str = "") -> int:
        size = lambda b: self.count(self.gap.join([*([lead] if lead else []), *self.texts[a:b]][:: self.step]))
        n, sure, step = len(self.texts), a, 1
        while sure < n and size(end := min(n, a + step)) <= room - self.slack:
            sure, step = end, 2 * step
        high = min(n, a + step)
        while high - sure > 1:
            mid = (sure + high) // 2
            if size(mid) <= room - self.slack:
                sure = mid
            else:
                high = mid
        while sure < n and size(sure + 1) <= room:
            sure += 1
        return sure


def _sizes(texts: list[str], count: Callable[[str], int], gap: str, slack: int) -> Sizes | Parted | Joined:
    if getattr(count, "additive", False):
        return Sizes(texts, count)
    return Parted(texts, count, gap) if getattr(count, "parted", False) else Joined(texts, count, gap, slack)


def _suffix(texts: list[str], room: int, count: Callable[[str], int], slack: int) -> str:
    """The longest suffix of texts within room, and with it all shorter ones."""
    if getattr(count, "additive", False):
        n = Sizes(texts[::-1], count).reach(0, room)
    elif getattr(count, "parted", False):
        n = _parted_suffix(texts, room, count)
    else:
        n = Joined(texts[::-1], count, " ", slack, backward=True).reach(0, room)
    return " ".join(texts[len(texts) - n :])


def units(text: str, target: int, count: Callable[[str], int], slack: int = 0) -> list[str]:
    """A page's paragraphs; those over the target as sentences, and sentences over it as runs of words."""
    over = getattr(count, "over", lambda text, limit: count(text) > limit)
    out: list[str] = []
    for paragraph in filter(None, (p.strip() for p in re.split(PARAGRAPH_END, text))):
        for part in sentences(paragraph) if over(paragraph, target) else [paragraph]:
            if not over(part, target):
                out.append(part)
                continue
            words = part.split()
            sizes, a = _sizes(words, count, " ", slack), 0
            while a < len(words):
                b = max(a + 1, sizes.reach(a, target))
                out.append(" ".join(words[a:b]))
                a = b
    return out


def chunk_spans(text: str, rules: ChunkRules = ChunkRules(), count: Callable[[str], int] = count_words) -> list[tuple[str, int, int]]:
    """(chunk text, first word, end) of one page, in order; its words are those of the page from the first to the end. A word over the hard limit makes a chunk of its own.

    A chunk is an overlap (the end of the chunk before it, left out where it would break the hard limit) and a run of
    units; a short last chunk joins the one before it. Sizes are those of the joined texts, separators included. A counter
    that isn't additive may give a longer start of a text rules.slack tokens less than a shorter one, at most.
    """
    if hasattr(count, "begin"):
        count.begin(text)
    parts = units(text, rules.target, count, rules.slack)
    ends = [0, *accumulate(len(p.split()) for p in parts)]
    sizes, chunks, a, lead = _sizes(parts, count, GAP, rules.slack), [], 0, ""
    while a < len(parts):
        n_lead = lead if isinstance(sizes, Joined) else count(lead)
        if lead and (n_lead + sizes.sums[a + 1] - sizes.sums[a] if isinstance(sizes, Parted) else count(GAP.join([lead, parts[a]]))) > rules.hard_limit:
            lead, n_lead = "", lead[:0] if isinstance(sizes, Joined) else 0
        b = max(a + 1, sizes.reach(a, rules.target, n_lead))
        chunks.append((GAP.join(filter(None, [lead, *parts[a:b]])), ends[a] - len(lead.split()), ends[b]))
        if b < len(parts) and rules.overlap:
            own = chunks[-1][0]
            lead = _suffix(sentences(own), rules.overlap, count, rules.slack) or _suffix(own.split(), rules.overlap, count, rules.slack)
        a = b
    if len(chunks) > 1 and count(chunks[-1][0]) < rules.least and count(GAP.join(c[0] for c in chunks[-2:])) <= rules.hard_limit:
        chunks[-2:] = [(GAP.join(c[0] for c in chunks[-2:]), chunks[-2][1], chunks[-1][2])]
    return chunks


def chunk_page(text: str, rules: ChunkRules = ChunkRules(), count: Callable[[str], int] = count_words) -> list[str]:
    """The texts of chunk_spans()."""
    return [c[0] for c in chunk_spans(text, rules, count)]


def chunk_documents(pages: DataFrame, rules: ChunkRules = ChunkRules(), count: Callable[[str], int] = count_words) -> DataFrame:
    """pages (file_name, page, text) -> chunk_id, file_name, page, ordinal, token_count, text, error, first_word, end_word.

    A chunk over the hard limit (one long word) carries an error instead of failing the job; pages never share a chunk.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (file, page, at, n := count(t), t, f"over {rules.hard_limit} tokens" if n > rules.hard_limit else None, first, end)
                for file, page, text in zip(batch["file_name"], batch["page"], batch["text"])
                for at, (t, first, end) in enumerate(chunk_spans(text or "", rules, count))
            ]
            yield pd.DataFrame(rows, columns=["file_name", "page", "ordinal", "token_count", "text", "error", "first_word", "end_word"])

    cut = spread(pages).select("file_name", F.col("page").cast("long").alias("page"), "text").mapInPandas(run, "file_name string, page long, ordinal long, token_count long, text string, error string, first_word long, end_word long")
    return cut.withColumn("chunk_id", chunk_id(F.col("text"), F.col("file_name"), F.col("page")))


def windows(pages: DataFrame, size: int, step: int) -> DataFrame:
    """pages (text, ...) in windows of size words, one every step words: number, first_word, end_word, text and the other columns. The last one ends with the page; a page without words has none."""
    n = F.size("words")
    numbers = F.sequence(F.lit(0), F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int"))
    others = [c for c in pages.columns if c != "text"]
    rows = pages.select(*others, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), 1).alias("words")).where(n > 0).select(*others, "words", F.explode(numbers).alias("number"))
    first = F.col("number") * step
    return rows.select(*others, F.col("number").cast("long").alias("number"), first.cast("long").alias("first_word"), F.least(first + size, n).cast("long").alias("end_word"), F.array_join(F.slice("words", first + 1, size), " ").alias("text"))
