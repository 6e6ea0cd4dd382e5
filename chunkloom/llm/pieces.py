"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is normalised as the model says (spaces become the space mark, one mark in front), cut where no piece of the
vocabulary can reach across, and each segment is merged through an agenda of adjacent symbol pairs: the pair with the
highest score goes first, the leftmost among equals. Segments recur, so each worker remembers short ones. In every
Arrow batch the library encodes the segments merged for the first time, and some whole texts, and must agree.

Defined cases: a null text is an empty one; an empty text has no pieces (only the end id, where asked for); characters
without a piece become their UTF-8 bytes; repeated rows are encoded each for itself; other columns pass through.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

from pyspark.sql import DataFrame, types as T

MARK = "▁"
REMEMBERED_CHARS = 40
REMEMBERED_SEGMENTS = 200_000
SHORT_SEGMENT = 16
NEVER = float("inf")
CHECKED_TEXTS = 2


def _one_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("one-byte", _one_byte)


class MergeVocabulary:
    """Pieces and scores of a merge-type model with byte fallback, encoding and decoding by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        self.end = self.library.eos_id()
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}      # negated: the smallest goes first
        self.bytes = [0] * 256
        self.surface: list[str] = []            # decoded form; bytes above 127 as escapes
        for i in range(size):
            piece = self.library.id_to_piece(i)
            if self.library.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value] = i
                self.surface.append(chr(value) if value < 128 else chr(0xDC00 + value))
            elif self.library.is_control(i):
                self.surface.append("")
            elif self.library.is_unknown(i):
                self.surface.append(" ⁇ ")
            else:
                self.ids[piece] = i
                self.scores[piece] = -self.library.get_score(i)
                self.surface.append(piece.replace(MARK, " "))
        self.cut = re.compile(self._cut_pattern()).findall
        self.recent: dict[str, bytes] = {}      # ids of segments as 32-bit integers, in two generations
        self.earlier: dict[str, bytes] = {}

    def _cut_pattern(self) -> str:
        """Segments that no merge can leave, as far as the pieces at hand allow such cuts."""
        bodies = [piece.lstrip(MARK) for piece in self.ids]
        if any(MARK in body or "\n" in body for body in bodies):
            return r"(?s).+"
        beside: dict[str, set[str]] = {}
        for a, b in {pair for body in bodies for pair in zip(body, body[1:])}:
            beside.setdefault(a, set()).add(b)
            beside.setdefault(b, set()).add(a)
        apart, new = set(), {","}               # the comma and all that pieces join with it, step by step
        while new:
            apart |= new
            new = {c for a in new for c in beside.get(a, ())} - apart
        if any(c.isalpha() for c in apart):
            return f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+"
        signs = "".join(map(re.escape, sorted(apart)))
        return f"{MARK}*[^{MARK}\n{signs}]+|{MARK}+[{signs}]*|\n|[{signs}]+"

    def merge(self, segment: str) -> list[int]:
        """Ids of one segment, by the agenda."""
        symbols = list(segment)
        if len(symbols) <= SHORT_SEGMENT:
            self._merge_short(symbols)
        else:
            self._merge_long(segment, symbols)
        out: list[int] = []
        for symbol in symbols:
            if symbol:
                piece = self.ids.get(symbol)
                if piece is None:
                    out.extend(map(self.bytes.__getitem__, symbol.encode()))
                else:
                    out.append(piece)
        return out

    def _merge_short(self, symbols: list[str]) -> None:
        """The agenda as a plain list of scores: for few symbols a scan is cheaper than a heap."""
        score = self.scores.get
        agenda = [score(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := min(agenda)) != NEVER:
            i = agenda.index(best)              # the leftmost among equals
            symbols[i] += symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = score(symbols[i] + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = score(symbols[i - 1] + symbols[i], NEVER)

    def _merge_long(self, segment: str, symbols: list[str]) -> None:
        """The agenda as a heap of (score, left, right, length); outdated entries are skipped when they come up."""
        scores, n = self.scores, len(segment)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [
            (score, i, i + 1, 2) for i in range(n - 1) if (score := scores.get(segment[i:i + 2])) is not None
        ]
        heapify(agenda)
        while agenda:
            _, left, right, length = heappop(agenda)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != length:
                continue                        # one of the two has been merged since
            symbols[left] += symbols[right]
            symbols[right] = ""
            behind = after[left] = after[right]
            if behind < n:
                before[behind] = left
                pair = symbols[left] + symbols[behind]
                if (score := scores.get(pair)) is not None:
                    heappush(agenda, (score, left, behind, len(pair)))
            ahead = before[left]
            if ahead >= 0:
                pair = symbols[ahead] + symbols[left]
                if (score := scores.get(pair)) is not None:
                    heappush(agenda, (score, ahead, left, len(pair)))

    def segments(self, text: str) -> list[str]:
        return self.cut(MARK + text.replace(" ", MARK)) if text else []

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as 32-bit integers; raises if the library disagrees on a new segment or a whole text."""
        if len(self.recent) > REMEMBERED_SEGMENTS:
            self.recent, self.earlier = {}, self.recent
        cut = [self.segments(text) for text in texts]
        known, new = self.recent, set(chain.from_iterable(cut)).difference(self.recent)
        for s in new & self.earlier.keys():
            known[s] = self.earlier[s]
        new.difference_update(known)
        merged = {s: self.merge(s) for s in new}
        self._agree(merged)
        for s, ids in merged.items():
            known[s] = array("i", ids).tobytes()
        encoded = [b"".join(map(known.__getitem__, parts)) for parts in cut]
        for s in new:
            if len(s) > REMEMBERED_CHARS:
                del known[s]
        for text, ids in zip(texts[:CHECKED_TEXTS], encoded):
            if array("i", self.library.encode(text)).tobytes() != ids:
                raise ValueError(f"the library encodes a text of {len(text)} characters otherwise")
        return encoded

    def _agree(self, merged: dict[str, list[int]]) -> None:
        # The library puts a mark in front by itself; a segment without one is asked for behind a line end.
        asked = list(merged)
        told = self.library.encode([s[1:] if s[0] == MARK else "\n" + s for s in asked], num_threads=1)
        head, mark = len(self.library.encode("\n")), [self.ids.get(MARK)]
        for s, theirs in zip(asked, told):
            expected = (theirs or mark) if s[0] == MARK else theirs[head:]  # no pieces for an empty text there
            if merged[s] != expected:
                raise ValueError(f"the library encodes {s!r} otherwise: {expected} against {merged[s]}")

    def decode(self, ids: list[int]) -> str:
        """Text of the ids: marks become spaces, byte runs are read as UTF-8, the mark in front goes."""
        text = "".join(map(self.surface.__getitem__, ids))
        first = next((i for i in ids if self.surface[i]), None)
        stripped = first is not None and self.surface[first][0] == " " and not self.library.is_byte(first) and not self.library.is_unknown(first)
        if stripped:
            text = text[1:]
        try:
            text.encode()
            return text
        except UnicodeEncodeError:              # byte pieces: each unbroken run is read as UTF-8
            out, run = [], bytearray()
            for i in [*ids, self.end]:
                if self.library.is_byte(i):
                    run.append(int(self.library.id_to_piece(i)[3:5], 16))
                    continue
                if run:
                    out.append(run.decode("utf-8", "one-byte"))
                    run = bytearray()
                out.append(self.surface[i])
            whole = "".join(out)
            return whole[1:] if stripped else whole


@lru_cache(maxsize=2)
def vocabulary(path: str) -> MergeVocabulary:
    return MergeVocabulary(path)


def encode(
    df: DataFrame, path: str, text: str = "text", ids: str = "ids", end: bool = True, decoded: str | None = None
) -> DataFrame:
    """``df`` with the ids of column ``text``; ``path`` is the model file, present on every machine.

    With ``decoded``, the text decoded from the ids goes into that column in the same pass: one worker, one vocabulary.
    """
    made = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)]
    if decoded:
        made.append(T.StructField(decoded, T.StringType(), False))
    names = [f.name for f in made]
    at = [f.name for f in df.schema if f.name not in names]
    schema = T.StructType([df.schema[c] for c in at] + made)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        model = vocabulary(path)
        tail = array("i", [model.end] if end else []).tobytes()
        for batch in batches:
            encoded = [x + tail for x in model.encode_batch([t or "" for t in batch.column(text).to_pylist()])]
            starts = np.zeros(len(encoded) + 1, "int32")
            np.cumsum([len(x) // 4 for x in encoded], out=starts[1:])
            columns = [pa.ListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(encoded), "int32")))]
            if decoded:
                columns.append(pa.array([model.decode(array("i", x).tolist()) for x in encoded], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in at] + columns, names=[*at, *names])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of column ``ids``. Null ids give an empty text."""
    schema = T.StructType([f for f in df.schema if f.name != text] + [T.StructField(text, T.StringType(), False)])
    at = [f.name for f in schema][:-1]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = vocabulary(path)
        for batch in batches:
            decoded = [model.decode(x or []) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in at] + [pa.array(decoded, pa.string())], names=[*at, text])

    return df.mapInArrow(run, schema)
