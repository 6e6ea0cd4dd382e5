"""Benchmark decontamination by pigeonhole edit matching.

A test item may be found with up to ``len // ERROR_SHARE`` edits. It is split into one piece more than that: whatever
the edits, one piece stays whole. All pieces are searched at once in the whole text of a document by an Aho-Corasick
automaton, and around each hit Myers' bit-parallel algorithm computes the least edit distance of the item to any
substring. Texts are compared in lower case with single spaces.

The automaton of one block of items is shipped to the tasks. A block holds so many bytes at most; more items make more
blocks, which the rows of one scan pass one after another.

Defined cases: a null or empty text contains nothing; null items and items shorter than ``MIN_CHARS`` are not searched,
as they would hit clean texts; equal items are found under each id, smallest first; repeated rows are judged each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F, types as T

ERROR_SHARE = 20
MIN_CHARS = 20
BLOCK_BYTES = 8_000_000

_HITS = T.ArrayType(T.StructType().add("item_id", T.LongType()).add("distance", T.IntegerType()))


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def budget(item: str, share: int = ERROR_SHARE) -> int:
    return len(item) // share


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """Offset and text of ``errors + 1`` pieces of nearly equal length."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:z]) for a, z in zip(cuts, cuts[1:]) if z > a]


class Pattern:
    """Myers' algorithm: one bit per character of the pattern, one step per character of the text."""

    def __init__(self, item: str):
        self.size = len(item)
        self.places: dict[str, int] = {}
        for i, c in enumerate(item):
            self.places[c] = self.places.get(c, 0) | (1 << i)
        self.all, self.top = (1 << self.size) - 1, 1 << (self.size - 1)

    def least_distance(self, text: str) -> int:
        """Fewest edits between the pattern and any substring of ``text``."""
        full, top, places = self.all, self.top, self.places
        plus, minus, score, best = full, 0, self.size, self.size
        for c in text:
            equal = places.get(c, 0)
            across = equal | minus
            down = ((((equal & plus) + plus) ^ plus) | equal)
            up_plus = minus | (full & ~(down | plus))
            up_minus = plus & down
            if up_plus & top:
                score += 1
            elif up_minus & top:
                score -= 1
                if score < best:
                    best = score
            up_plus = (up_plus << 1) & full     # the match may begin anywhere: no cost comes in at the top
            up_minus = (up_minus << 1) & full
            plus = up_minus | (full & ~(across | up_plus))
            minus = up_plus & across
        return best


class Matcher:
    """Search for all items of one block."""

    def __init__(self, items: list[tuple[int, str]], share: int = ERROR_SHARE):
        import ahocorasick

        self.items = [(i, text, budget(text, share)) for i, text in items]
        self.patterns: dict[int, Pattern] = {}
        found: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text, errors) in enumerate(self.items):
            for offset, piece in pieces(text, errors):
                found.setdefault(piece, []).append((number, offset + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, places)
        if found:
            self.automaton.make_automaton()

    def search(self, text: str) -> list[dict]:
        """Items within their budget, with their least distance, by id."""
        text = normalised(text)
        best: dict[int, int] = {}
        if not len(self.automaton) or not text:
            return []
        tried: set[tuple[int, int]] = set()
        for last, places in self.automaton.iter(text):
            for number, end in places:
                start = last + 1 - end          # where the item would begin without edits before the piece
                if best.get(number) == 0 or (number, start) in tried:
                    continue
                tried.add((number, start))
                _, item, errors = self.items[number]
                if text.startswith(item, max(start, 0)) and start >= 0:
                    best[number] = 0
                    continue
                if number not in self.patterns:
                    self.patterns[number] = Pattern(item)
                window = text[max(0, start - errors):start + len(item) + errors]
                distance = self.patterns[number].least_distance(window)
                if distance <= min(errors, best.get(number, errors)):
                    best[number] = distance
        return sorted(({"item_id": self.items[n][0], "distance": d} for n, d in best.items()), key=lambda h: h["item_id"])


def _blocks(items: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most about ``block_bytes``; one block is on the driver at a time."""
    usable = items.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).cast("bigint").alias("i"), F.col(text).alias("t")).distinct()
    total = usable.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    count = max(1, -(-2 * total // block_bytes))
    for number in range(count):
        part = usable if count == 1 else usable.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == number)
        texts = [(r.i, normalised(r.t)) for r in part.collect()]
        yield sorted((i, t) for i, t in texts if len(t) >= MIN_CHARS)


def find_items(
    df: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    share: int = ERROR_SHARE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``df`` with ``hits``: the items found in its text, with their distances. Rows pass one block after another."""
    schema = T.StructType([f for f in df.schema if f.name != "hits"]).add("hits", _HITS)
    at = [f.name for f in schema][:-1]

    def searched(block: list[tuple[int, str]], first: bool):
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            matcher = Matcher(block, share)
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))
            for batch in batches:
                hits = [matcher.search(t.as_py() or "") for t in batch.column(text)]
                if not first:
                    hits = [sorted(a + b, key=lambda h: h["item_id"]) for a, b in zip(batch.column("hits").to_pylist(), hits)]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in at] + [pa.array(hits, kind)], names=[*at, "hits"])
        return run

    out = df.drop("hits")
    for number, block in enumerate(_blocks(items, item, item_text, block_bytes)):
        out = out.mapInArrow(searched(block, number == 0), schema)
    return out
