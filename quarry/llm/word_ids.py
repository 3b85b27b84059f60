"""Ids of the word-end BPE tokenizer for columns of texts.

The tokenizer's normaliser (NFC, white space to one blank, lower case) and its splitting never join
text across ASCII white space, so what stands between is a word on its own. Arrow splits a slice of the
column and numbers its distinct words. A word of printable ASCII and Latin-1 letters is cut into parts where
the tokenizer cuts it, and the library's BPE model encodes each part once (parts are remembered per Python
worker); any other word goes to the library whole. Numpy lays the ids out in the order of the texts.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: The id that ends every document (fixed by the packing contract).
END_ID = 1
#: Bytes of text in a slice (or one longer text), and parts that a worker remembers.
SLICE_BYTES, MEMO_PARTS = 8 << 20, 500_000

#: Words that the cuts below hold for, once in lower case; special tokens start with <|.
SIMPLE = re.compile(r"(?!.*<\|)[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
#: The tokenizer's own cuts (fixed values), for those characters.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: The model's sign for each byte (fixed rule): printable bytes stand for themselves, the others follow from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
SIGNS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}


class WordEncoder:
    """Ids of words by the tokenizer file, each distinct part encoded once."""

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.ids, self.lengths = array("I"), array("q")

    def _put(self, part: str, ids: list[int]) -> int:
        self.ids.extend(ids)
        self.lengths.append(len(ids))
        self.at[part] = len(self.at)
        return self.at[part]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has."""
        if len(self.at) > MEMO_PARTS:
            self.forget()
        known, tokenize = self.at, self.model.tokenize
        codes, n_parts = array("q"), array("q")
        for word in words:
            simple = SIMPLE.fullmatch(word)
            parts = PARTS.findall(word.lower()) if simple else [word]
            for part in parts:
                code = known.get(part)
                if code is None:
                    if simple:
                        signs = part if part.isascii() else part.encode().decode("latin-1").translate(SIGNS)
                        code = self._put(part, [token.id for token in tokenize(signs)])
                    else:
                        code = self._put(part, self.whole.encode(part, add_special_tokens=False).ids)
                codes.append(code)
            n_parts.append(len(parts))
        got, _, ends = laid_out(np.array(self.ids, np.uint32), np.array(self.lengths, np.int64), np.array(codes, np.int64))
        bounds = ends[np.cumsum(np.array(n_parts, np.int64))]
        return got, np.diff(bounds, prepend=0)


def laid_out(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of each code in turn, how many each has, and their bounds; ids holds those of code 0, 1, ... in lengths."""
    n = lengths[codes]
    bounds = np.concatenate([[0], np.cumsum(n)])
    begins = (np.cumsum(lengths) - lengths)[codes]
    return ids[np.repeat(begins - bounds[:-1], n) + np.arange(bounds[-1])], n, bounds


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per Python worker and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = done = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, done + SLICE_BYTES, "right")))
        yield texts.slice(at, stop - at)
        at, done = stop, int(ends[stop - 1])


def encode_texts(words_of: WordEncoder, texts: pa.Array) -> Iterator[np.ndarray]:
    """Ids (little-endian unsigned 32-bit) of each text of a column without nulls, END_ID last."""
    for part in _slices(texts):
        split = pc.ascii_split_whitespace(part)
        words = pc.dictionary_encode(split.flatten())
        ids, lengths = words_of.encode(words.dictionary.to_pylist())
        flat, _, bounds = laid_out(ids, lengths, words.indices.to_numpy(zero_copy_only=False))
        bounds = bounds[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])]
        for a, b in zip(bounds, bounds[1:]):
            yield np.append(flat[a:b], np.uint32(END_ID)).astype("<u4", copy=False)
