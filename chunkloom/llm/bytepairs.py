"""Byte-level BPE encoding and decoding with a contiguous rank array.

A text is split at the added tokens, cut into words by the pre-tokenizer's pattern, and every word is merged by itself:
part boundaries and the ranks of adjacent parts lie in two lists, the least rank is looked for by scanning, its boundary
is deleted and the two neighbouring ranks are looked up anew. That is quadratic in the length of a word, which suits
short ones; words of more than ``SHORT_WORD`` bytes keep the ranks in a heap over linked parts. Words recur, so each
worker remembers the ids of short ones, in two generations of bounded size.

The vocabulary file is that of the tokenizers library; its merges give the ranks. The pattern's letter and number
classes follow the Unicode version of the library, which is asked once for all characters that other versions know.

Defined cases: a null text is an empty one, and an empty text has no ids; added tokens in a text become their ids and
decode to themselves, as in the library; repeated rows are encoded each for itself; columns named like the made ones are
replaced, all others pass through; an empty table gives no rows. Truncation and padding of the file are not applied.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

from pyspark.sql import DataFrame, types as T

SHORT_WORD = 64
REMEMBERED_BYTES = 40
REMEMBERED_WORDS = 200_000
NEVER = 1 << 62

# Letters, numbers, spaces: the three classes of the pre-tokenizer's pattern.
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d| ?[{0}]+| ?[{1}]+| ?[^{2}{0}{1}]+|[{2}]+(?![^{2}])|[{2}]+"


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, and the byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


_LETTER_OF = {b: c for c, b in byte_letters().items()}


def _spelled(text: str) -> str:
    return "".join(map(_LETTER_OF.__getitem__, text.encode()))


def _ranges(characters: list[str]) -> str:
    """A character class without its brackets."""
    out: list[list[int]] = []
    for c in map(ord, characters):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in out)


def _classes(library) -> list[list[str]]:
    """Letters, numbers and spaces as the library sees them.

    The regex module and the library know the same properties, in other versions of Unicode; characters that Python's
    own, older tables leave unassigned are therefore put to the library.
    """
    import regex

    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    out = []
    for kind, beside in (("L", "a"), ("N", "1")):
        found = regex.findall(rf"\p{{{kind}}}", every)
        asked = [c for c in found if unicodedata.category(c) == "Cn"]
        parts = {p for p, _ in library.pre_tokenizer.pre_tokenize_str("\n".join(beside + c for c in asked))}
        other = {c for c in asked if beside + _spelled(c) not in parts}
        out.append([c for c in found if c not in other])
    return [*out, regex.findall(r"\s", every)]


class RankVocabulary:
    """Tokens, merge ranks and added tokens of a byte-level model, encoding and decoding by itself."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, cut = told["model"], told["pre_tokenizer"]
        if (
            model["type"] != "BPE" or cut["type"] != "ByteLevel" or not cut["use_regex"] or cut["add_prefix_space"] or told["normalizer"]
            or model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")
        ):
            raise ValueError("only plain byte-level BPE vocabularies are supported")
        byte = byte_letters()
        spelled = {token: bytes(map(byte.__getitem__, token)) for token in model["vocab"]}
        self.surface = [b""] * (1 + max(chain(model["vocab"].values(), (t["id"] for t in told["added_tokens"]))))
        for token, i in model["vocab"].items():
            self.surface[i] = spelled[token]
        self.byte_ids = [0] * 256
        for token, i in model["vocab"].items():
            if len(spelled[token]) == 1:
                self.byte_ids[spelled[token][0]] = i
        # Rank and id of what two adjacent parts become, by their ids.
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = model["vocab"][left], model["vocab"][right]
            self.ranks[pair] = rank
            self.made[pair] = model["vocab"][left + right]
        self.added = {t["content"]: t["id"] for t in told["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in told["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not supported")
        for content, i in self.added.items():
            self.surface[i] = content.encode()
        longest_first = sorted(self.added, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")").split if self.added else None
        classes = _classes(Tokenizer.from_file(path))
        # Without characters above U+FFFF the classes are lookup tables of the re module, which is several times faster.
        self.words = re.compile(_PATTERN.format(*[_ranges([c for c in kind if c < "\U00010000"]) for kind in classes])).findall
        self.beyond = re.compile("[\U00010000-\U0010ffff]").search
        self.words_beyond = re.compile(_PATTERN.format(*map(_ranges, classes))).findall
        self.recent: dict[str, bytes] = {}      # ids of words as 32-bit integers, in two generations
        self.earlier: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        return self._merge_short(word) if len(word) <= SHORT_WORD else self._merge_long(word)

    def _merge_short(self, word: bytes) -> list[int]:
        """The contiguous rank array: ``ranks[i]`` is that of the parts at boundaries i and i + 1."""
        rank, made, whole = self.ranks, self.made, len(word)
        bounds = list(range(whole))             # where each part begins
        part = list(map(self.byte_ids.__getitem__, word))   # by boundary: the id of the part that begins there
        ranks = [rank.get((a, b), NEVER) for a, b in zip(part, part[1:])]
        while ranks and (least := min(ranks)) != NEVER:
            i = ranks.index(least)              # the leftmost among equals
            left = bounds[i]
            part[left] = new = made[part[left], part[bounds[i + 1]]]
            del bounds[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get((new, part[bounds[i + 1]]), NEVER)
            if i:
                ranks[i - 1] = rank.get((part[bounds[i - 1]], new), NEVER)
        return [part[b] for b in bounds]

    def _merge_long(self, word: bytes) -> list[int]:
        """The same merges with the ranks in a heap; entries whose parts have changed are skipped when they come up."""
        rank, made, n = self.ranks, self.made, len(word)
        part = list(map(self.byte_ids.__getitem__, word))
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(r, i, a, b) for i, (a, b) in enumerate(zip(part, part[1:])) if (r := rank.get((a, b))) is not None]
        heapify(agenda)
        while agenda:
            _, left, a, b = heappop(agenda)
            right = after[left]
            if part[left] != a or right >= n or part[right] != b:
                continue
            part[left] = new = made[a, b]
            part[right] = -1
            behind = after[left] = after[right]
            if behind < n:
                before[behind] = left
                if (r := rank.get((new, part[behind]))) is not None:
                    heappush(agenda, (r, left, new, part[behind]))
            ahead = before[left]
            if ahead >= 0 and (r := rank.get((part[ahead], new))) is not None:
                heappush(agenda, (r, ahead, part[ahead], new))
        return [p for p in part if p >= 0]

    def cut(self, text: str) -> list[str]:
        """Words of a text; added tokens are words of their own, told apart by a mark no word can have."""
        pieces = self.split(text) if self.split else [text]
        if len(pieces) == 1:
            return self._cut_plain(text)
        out: list[str] = []
        for i, piece in enumerate(pieces):
            out.extend((_ADDED + piece,) if i % 2 else self._cut_plain(piece))
        return out

    def _cut_plain(self, text: str) -> list[str]:
        return self.words_beyond(text) if not text.isascii() and self.beyond(text) else self.words(text)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as 32-bit integers."""
        if len(self.recent) > REMEMBERED_WORDS:
            self.recent, self.earlier = {}, self.recent
        known, forget, encoded = self.recent, [], []
        for text in texts:
            words = self.cut(text)
            for word in set(words).difference(known):
                if (ids := self.earlier.get(word)) is None:
                    if word[0] == _ADDED:
                        ids = array("i", [self.added[word[1:]]]).tobytes()
                    else:
                        ids = array("i", self.merge(raw := word.encode())).tobytes()
                        if len(raw) > REMEMBERED_BYTES:
                            forget.append(word)
                known[word] = ids
            encoded.append(b"".join(map(known.__getitem__, words)))
            for word in forget:
                known.pop(word, None)
            forget.clear()
        return encoded

    def decode(self, ids: list[int]) -> str:
        """Text of the ids, added tokens included; what is not UTF-8 becomes U+FFFD."""
        return b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")


# A lone surrogate, which no text holds: it marks words that are added tokens.
_ADDED = "\udc00"


@lru_cache(maxsize=2)
def vocabulary(path: str) -> RankVocabulary:
    return RankVocabulary(path)


def _schema(df: DataFrame, made: list[T.StructField]) -> tuple[list[str], T.StructType]:
    names = {f.name for f in made}
    at = [f.name for f in df.schema if f.name not in names]
    return at, T.StructType([df.schema[c] for c in at] + made)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` with the ids of column ``text``; ``path`` is the vocabulary file, present on every machine.

    With ``decoded``, the text decoded from the ids goes into that column in the same pass: one worker, one vocabulary.
    """
    made = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)]
    if decoded:
        made.append(T.StructField(decoded, T.StringType(), False))
    at, schema = _schema(df, made)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        model = vocabulary(path)
        for batch in batches:
            encoded = model.encode_batch([t or "" for t in batch.column(text).to_pylist()])
            starts = np.zeros(len(encoded) + 1, "int32")
            np.cumsum([len(x) // 4 for x in encoded], out=starts[1:])
            columns = [pa.ListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(encoded), "int32")))]
            if decoded:
                columns.append(pa.array([model.decode(array("i", x).tolist()) for x in encoded], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in at] + columns, names=schema.names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of column ``ids``. Null ids give an empty text."""
    at, schema = _schema(df, [T.StructField(text, T.StringType(), False)])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = vocabulary(path)
        for batch in batches:
            decoded = [model.decode(x or []) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in at] + [pa.array(decoded, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)
