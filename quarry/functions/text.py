"""Turkish-aware text functions as Catalyst expressions."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters whose lower case differs from the default, the token alphabet and inflection suffixes.
TR_UPPER, TR_LOWER = "İIŞĞÜÖÇ", "iışğüöç"
TOKEN = "([0-9a-zçğıöşü]+)"
SUFFIXES = (
    "lerinden larından lerine larına lerini larını lerin ların leri ları ler lar inden ından unden ündan "
    "ince ınca unca ünce nin nın nun nün den dan ten tan in ın un ün de da te ta ye ya e a "
    "yi yı yu yü i ı u ü si sı su sü le la"
).split()
MIN_STEM = 4
STEM_PATTERN = f"^(.{{{MIN_STEM},}}?)(?:{'|'.join(SUFFIXES)})$"
STEM_PASSES = 3
SOFT, HARD = "ğbcd", "kpçt"
_SUFFIXES, _LONGEST = frozenset(SUFFIXES), max(map(len, SUFFIXES))
_HARD, _LOWER = str.maketrans(SOFT, HARD), str.maketrans(TR_UPPER, TR_LOWER)


@F.pandas_udf(StringType())
def nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFC normalization, which Spark lacks; applied once, at ingest."""
    for s in batches:
        yield s.map(lambda t: t if t is None or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t))


def tr_lower(c: Column) -> Column:
    return F.lower(F.translate(c, TR_UPPER, TR_LOWER))


def tr_equal(a: Column, b: Column) -> Column:
    return tr_lower(a) == tr_lower(b)


def tr_contains(haystack: Column, needle: Column) -> Column:
    return F.contains(tr_lower(haystack), tr_lower(needle))


def light_stem(token: Column) -> Column:
    """Up to three passes, each taking off the longest listed suffix that leaves four letters; then a hard final letter."""
    stem = reduce(lambda t, _: F.regexp_replace(t, STEM_PATTERN, "$1"), range(STEM_PASSES), token)
    last = F.translate(F.substring(stem, -1, 1), SOFT, HARD)
    return F.when(F.length(stem) > MIN_STEM, F.concat(stem.substr(F.lit(1), F.length(stem) - 1), last)).otherwise(stem)


@functools.lru_cache(1 << 18)
def stem_word(token: str) -> str:
    """light_stem() of one token, for tasks that have their tokens in Python."""
    for _ in range(STEM_PASSES):
        for n in range(min(_LONGEST, len(token) - MIN_STEM), 0, -1):  # the longest suffix first
            if token[-n:] in _SUFFIXES:
                token = token[:-n]
                break
        else:
            break
    return token[:-1] + token[-1].translate(_HARD) if len(token) > MIN_STEM else token


def raw_tokens(c: Column) -> Column:
    return F.regexp_extract_all(tr_lower(c), F.lit(TOKEN), F.lit(1))


def words(text: str) -> list[str]:
    """raw_tokens() of one text, for tasks that have their texts in Python."""
    return re.findall(TOKEN, text.translate(_LOWER).lower())


def tokenize(c: Column, stem: bool = True) -> Column:
    return F.transform(raw_tokens(c), light_stem) if stem else raw_tokens(c)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def normalize_text(c: Column) -> Column:
    """Control characters out, hyphenated line ends joined, runs of blanks and empty lines shortened, ends stripped. Input in NFC."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    c = F.regexp_replace(c, r"(?<=\p{L})-\n(?=\p{L})", "")
    c = F.regexp_replace(c, r"(?U)[^\S\n]{2,}", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r"(?dmU)[\s&&[^\n]]+$", "")
    return strip(c)


def source_label(file_name: Column, page: Column, section: Column) -> Column:
    return F.concat_ws(" · ", file_name, F.concat(F.lit("s."), page.cast("string")), F.nullif(section, F.lit("")))


def chunk_id(text: Column, file_name: Column, page: Column) -> Column:
    """First 32 hex digits of SHA-256 over text, file name and page, parted by zero bytes."""
    zero = F.char(F.lit(0))
    return F.substring(F.sha2(F.concat(text, zero, file_name, zero, F.coalesce(page.cast("string"), F.lit("None"))), 256), 1, 32)


def content_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 32)


def strip_reasoning(c: Column) -> Column:
    """Closed thinking blocks, an unclosed one to the end, then stray tags."""
    for pattern in (r"(?is)<think[^>]*>.*?</think>", r"(?is)<think[^>]*>.*\z", r"(?i)</?think[^>]*>"):
        c = F.regexp_replace(c, pattern, "")
    return strip(c)


def sse_frame(piece: Column) -> Column:
    """A server-sent event: newlines escaped, a blank line after it."""
    return F.concat(F.lit("data: "), F.replace(piece, F.lit("\n"), F.lit("\\n")), F.lit("\n\n"))


def l2_normalized(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x / norm)
