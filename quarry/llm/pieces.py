"""SentencePiece merge-type (BPE) encoding by backtracking, and decoding.

A text is cut where no piece of the vocabulary holds the two characters side by side: no merge can
cross such a place, so the parts are encoded apart and short ones are remembered per Python worker.
Within a part, Aho-Corasick matches give the pieces that start at each position, longest first; a piece
is taken if it is compatible with the piece before it (merging the two pieces' text anew gives those two
pieces), and a bitfield marks positions from which no way led to the end.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from quarry.llm.common import id_and_text, spread

SPACE = "▁"  # stands for a blank in pieces (fixed value)
#: Parts remembered per worker, and the longest part that is.
MEMO_PARTS, MEMO_CHARS = 200_000, 48


class Memo:
    """A bounded dict: when the new half is full it becomes the old half, from which used entries move back."""

    def __init__(self, size: int = MEMO_PARTS):
        self.new: dict = {}
        self.old: dict = {}
        self.size = size

    def get(self, key):
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value


class PieceCodec:
    """Encoder and decoder for one model file; equals the sentencepiece library without sampling."""

    def __init__(self, model_path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.bos, self.eos = sp.bos_id().to_bytes(4, "little"), sp.eos_id().to_bytes(4, "little")
        self.byte_ids = {}
        self.text_of: dict[int, bytes] = {}
        self.score: dict[str, float] = {}
        self.id_of: dict[str, int] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.text_of[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.id_of[piece], self.score[piece] = i, sp.get_score(i)
                self.text_of[i] = piece.replace(SPACE, " ").encode()
        self.joined = {a + b for p in self.id_of for a, b in zip(p, p[1:])}
        self.parts, self.words = Memo(), Memo()
        self.pairs: dict[tuple[str, str], bool] = {}
        # a piece that merging doesn't reach from its own characters never occurs in an encoding
        self.reached = [p for p in self.id_of if len(p) == 1 or self.merge(p) == [p]]
        self.matcher = ahocorasick.Automaton()
        for p in self.reached:
            self.matcher.add_word(p, p)
        self.matcher.make_automaton()
        self.cut = self._cutter()

    def _cutter(self) -> re.Pattern:
        """Matches the parts of a text: blanks go before what follows them, lines end a part.

        A run of letters ends a part where a sign follows that no piece holds right after a letter.
        """
        letters = {c for p in self.id_of for c in p if c.isalpha()}
        signs = {c for p in self.id_of for c in p if not c.isalpha()} - {SPACE}
        ends = signs - {pair[1] for pair in self.joined if pair[0] in letters}
        one_of = lambda chars: "".join(map(re.escape, sorted(chars)))
        word = f"{SPACE}*[{one_of(letters)}]+(?=[{one_of(ends)}{SPACE}\\n]|$)|" if ends else ""
        return re.compile(f"{word}{SPACE}+[^{SPACE}\\n]*|[^{SPACE}\\n]+|\\n")

    def merge(self, text: str) -> list[str]:
        """The pieces of text by merging the best-scored neighbours, leftmost first among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        if left[-1] + right[0] not in self.joined:
            return True
        found = self.pairs.get((left, right))
        if found is None:
            found = self.merge(left + right) == [left, right]
            if len(self.pairs) < 2_000_000:
                self.pairs[left, right] = found
        return found

    def backtrack(self, part: str) -> list[str]:
        """The pieces of a part whose characters are all in the vocabulary."""
        n = len(part)
        starts: list[list[str]] = [[] for _ in range(n)]
        for end, piece in self.matcher.iter(part):
            starts[end + 1 - len(piece)].append(piece)  # shorter ones of a start come first
        open_ = bytearray(b"\x01") * (n + 1)
        taken: list[str] = []
        tries: list[list[str]] = []
        last, pos, left = "", 0, starts[0]
        compatible = self.compatible
        while True:
            while left:
                piece = left.pop()  # the longest that is left; a start is not tried again once it failed
                if open_[pos + len(piece)] and (not last or compatible(last, piece)):
                    break
            else:
                open_[pos] = 0
                left, piece = tries.pop(), taken.pop()
                pos -= len(piece)
                last = taken[-1] if taken else ""
                continue
            taken.append(piece)
            pos += len(piece)
            if pos == n:
                return taken
            tries.append(left)
            last, left = piece, list(starts[pos])

    def encode_part(self, part: str) -> tuple[bytes, bytes]:
        """Ids as little-endian unsigned 32-bit integers, and the UTF-8 bytes that they decode to."""
        ids = array("I")
        start, n = 0, len(part)
        while start < n:
            end = start + 1
            known = part[start] in self.id_of
            while known and end < n and part[end - 1] + part[end] in self.joined:
                end += 1
            piece = part[start:end]
            if known:
                for p in self.backtrack(piece) if len(piece) > 1 else [piece]:
                    ids.append(self.id_of[p])
            else:
                ids.extend(self.byte_ids[b] for b in piece.encode())
            start = end
        return ids.tobytes(), b"".join(map(self.text_of.__getitem__, ids))

    def encode_word(self, word: str) -> tuple[bytes, bytes]:
        """encode_part of each part of a word (what stands between two blanks, with its blanks before it)."""
        ids, out = [], []
        for part in self.cut.findall(word):
            found = self.parts.get(part)
            if found is None:
                found = self.encode_part(part)
                if len(part) <= MEMO_CHARS:
                    self.parts.put(part, found)
            ids.append(found[0])
            out.append(found[1])
        return b"".join(ids), b"".join(out)

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Ids with begin and end, and the decoded text in UTF-8."""
        words = text.split(" ") if text else []
        if "" in words or SPACE in text:  # runs of blanks belong to the word after them
            found = [self.encode_word(w) for w in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))]
        else:
            found = list(map(self.words.new.get, words))
            if None in found:
                for i, known in enumerate(found):
                    if known is None:
                        word = words[i]
                        known = self.words.get(word)
                        if known is None:
                            known = self.encode_word(SPACE + word)
                            if len(word) <= MEMO_CHARS:
                                self.words.put(word, known)
                        found[i] = known
        ids = b"".join([self.bos, *[f[0] for f in found], self.eos])
        decoded = b"".join([f[1] for f in found])
        return ids, decoded[1:] if decoded[:1] == b" " else decoded


_codecs: dict[str, PieceCodec] = {}


def codec(model_path: str) -> PieceCodec:
    """One per Python worker and model."""
    if model_path not in _codecs:
        _codecs[model_path] = PieceCodec(model_path)
    return _codecs[model_path]


def encode_documents(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """One row per document row: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded if with_ids).

    Nulls: a null text is an empty text, whose ids are begin and end alone; a null doc_id stays null.
    Repeated rows give repeated rows, an empty table none; other columns are ignored.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.binary()), ("decoded", pa.string())] if with_ids else []
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(model_path).encode
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, decoded = encode(text.as_py())
                row = (doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest())
                rows.append(row + (ids, decoded.decode()) if with_ids else row)
            cols = list(zip(*rows)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])

    return spread(id_and_text(docs)).mapInArrow(run, schema)
