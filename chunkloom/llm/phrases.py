"""Phrase collocation mining by HAT-trie counting.

Texts are lower-cased (A-Z), split into pieces at marks and line ends, and into words at spaces and tabs. All counting is
per language. Three passes over the texts:

1. and 2. Hash filters of a fixed number of cells sum up words and word pairs, then triples of words whose pairs pass. A
   cell whose sum stays below the least count proves that nothing in it is frequent. A filter is one bit a cell,
   ``MOST_CELLS`` bits at most, whatever the corpus; it only saves work. Where the corpus outgrows it, it lets more
   through, and results stay the same.
3. Each task counts the phrases whose pairs and triples all pass in a HAT-trie: a shallow trie over word ids whose leaves
   are hash containers (suffix of the phrase to count); a container that grows too large bursts into one more trie
   level. When the trie holds more than ``TRIE_ENTRIES`` counts, its largest subtrees are written out whole as sorted
   runs, in blocks, and freed. Blocks are dealt by language and a hash of the first two words of their phrases, and
   ordered by their first phrase; there a heap merges the runs, which holds one block of each run at a time.

A phrase of two words and more is a candidate if it is frequent enough; everything after that (cuts, scores, longer
candidates, ranks) is DataFrame work on the few frequent phrases. Scores are computed in decimals, so no product wraps.

Defined cases: a null text has no words; a null language is ``und``; repeated rows count each; ties are settled as the
ranking says (score, count, phrase in UTF-8 byte order; the smallest cut); a text of any length is counted whole; an
empty table gives no rows; further columns are not read. Hot words, phrases and sources reach a reducer as one entry per
run; a prefix with very many different phrases is sorted on disk, not held.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from chunkloom.llm.common import ready, written

LEAST_COUNT = 100
MOST_WORDS = 5
TOP = 2000
UNKNOWN = "und"

# Cells of a filter: one for each 16 bytes of text, between these bounds. At the most, 32 MB of bits are broadcast.
LEAST_CELLS, MOST_CELLS = 1 << 22, 1 << 28
BYTES_PER_CELL = 16
SLICE_BITS = 16
# Cells that a task keeps before it hands them on, words it knows, counts its trie holds, counts in a hash container.
HELD_CELLS = 4_000_000
KNOWN_WORDS = 500_000
TRIE_ENTRIES = 600_000
BURST = 4_096
# Phrases in a block of a run; prefix partitions, one for each so many bytes of text, and their least number.
BLOCK = 512
BYTES_PER_PART, LEAST_PARTS = 1 << 28, 64
# Groups that each slice of cells, and each language's ranking, is first reduced in.
SALTS = 16

_LOWERED = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_MARKS = rb".,;:!?\n\x0b\x0c\r"
_WORDS = re.compile(rb"[^\x20\x09" + _MARKS + rb"]+|[" + _MARKS + rb"]").findall
BREAK = 0


class Words(dict):
    """Ids of words, given out as words come up; all marks have the id ``BREAK``. Each word has a hash of 64 bits."""

    def __init__(self, lang: str):
        super().__init__((bytes([mark]), BREAK) for mark in b".,;:!?\n\x0b\x0c\r")
        self.spelled: list[bytes] = [b""]
        self.hashes = np.zeros(1024, "uint64")
        self.seen = np.zeros(0, "int64")        # occurrences by id, as far as counted
        self._head = lang.encode() + b"\0"

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = i = len(self.spelled)
        self.spelled.append(word)
        if i == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros(i, "uint64")])
        self.hashes[i] = xxhash.xxh64_intdigest(self._head + word)
        return i


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_cells(hashes: np.ndarray, cells: int) -> np.ndarray:
    return (_mixed(hashes) & np.uint64(cells - 1)).astype("int64")


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a sequence and one more word."""
    return left * np.uint64(0x9E3779B97F4A7C15) + _mixed(right)


def _passing(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = word_cells(hashes, len(bits) << 3)
    return (bits[at >> 3] >> (at & 7).astype("uint8")) & 1 == 1


def _pairs(ids: np.ndarray, hashes: np.ndarray, bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Where a pair of words begins that passes the filter, and hashes of the pairs there."""
    at = np.flatnonzero((ids[:-1] != BREAK) & (ids[1:] != BREAK))
    joined = _joined(hashes[at], hashes[at + 1])
    if bits is not None:
        good = _passing(bits, joined)
        at, joined = at[good], joined[good]
    return at, joined


def _triples(at: np.ndarray, joined: np.ndarray, hashes: np.ndarray, bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Of the places ``at`` of pairs those where a triple begins, whose second pair passes too, and that passes itself."""
    follows = np.flatnonzero(at[1:] == at[:-1] + 1)
    at, joined = at[follows], _joined(joined[follows], hashes[at[follows] + 2])
    if bits is not None:
        good = _passing(bits, joined)
        at, joined = at[good], joined[good]
    return at, joined


def _by_lang(batch) -> Iterator[tuple[str, bytes]]:
    """Per language all texts of a batch run together, with a break between any two."""
    import pyarrow as pa

    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
        if text:
            texts.setdefault(UNKNOWN if lang is None else lang, []).append(text)
    for lang, parts in texts.items():
        yield lang, b"\n".join(parts).translate(_LOWERED)


def _ids(words: Words, text: bytes) -> np.ndarray:
    return np.fromiter(map(words.__getitem__, _WORDS(text)), "int64")


def _cell_counts(cells: int, pairs_pass):
    """Per slice of cells, the cells met and their counts, in parts of bounded size.

    Of words and pairs, or, with the filter of these, of triples.
    """
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bits = None if pairs_pass is None else pairs_pass.value
        known: dict[str, Words] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, salt = 0, 0

        def handed_on():
            at = np.concatenate([a for a, _ in held])
            order = np.argsort(at, kind="stable")
            at, n = at[order], np.concatenate([b for _, b in held])[order]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            at, n = at[first], np.minimum(np.add.reduceat(n, first), 255).astype("uint8")
            cuts = np.flatnonzero(np.diff(at >> SLICE_BITS)) + 1
            bounds = np.concatenate([[0], cuts, [len(at)]])
            low = (at & ((1 << SLICE_BITS) - 1)).astype("<u2")
            rows = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
            return pa.RecordBatch.from_arrays([
                pa.array((at[bounds[:-1]] >> SLICE_BITS).astype("int32")), pa.array([salt % SALTS] * len(rows), pa.int32()),
                pa.array([low[a:z].tobytes() for a, z in rows], pa.binary()), pa.array([n[a:z].tobytes() for a, z in rows], pa.binary()),
            ], names=["slice", "salt", "cells", "counts"])

        for batch in batches:
            for lang, text in _by_lang(batch):
                words = known.setdefault(lang, Words(lang))
                ids = _ids(words, text)
                if not ids.any():
                    continue
                hashes = words.hashes[ids]
                at, joined = _pairs(ids, hashes, bits)
                if bits is not None:
                    at, joined = _triples(at, joined, hashes, None)
                met, often = np.unique(word_cells(joined, cells), return_counts=True)
                held.append((met, often))
                size += len(met)
                if bits is None:
                    single, often = np.unique(ids[ids != BREAK], return_counts=True)
                    held.append((word_cells(words.hashes[single], cells), often))
                    size += len(single)
                salt += len(text)
            if size > HELD_CELLS:
                yield handed_on()
                held, size = [], 0
            if sum(len(w.spelled) for w in known.values()) > KNOWN_WORDS:
                known = {}
        if size:
            yield handed_on()
    return run


def _summed(last: bool, least: int):
    """Rows of one group (slice, salt) after another become one row each: counts up to 255, at last bits."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, total = None, np.zeros(1 << SLICE_BITS, "int64")

        def done():
            if last:
                cells, counts = b"", np.packbits(total >= least, bitorder="little")
            else:
                at = np.flatnonzero(total)
                cells, counts = at.astype("<u2").tobytes(), np.minimum(total[at], 255).astype("uint8")
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]], pa.int32()), pa.array([0], pa.int32()), pa.array([cells], pa.binary()), pa.array([counts.tobytes()], pa.binary())],
                names=["slice", "salt", "cells", "counts"],
            )

        for batch in batches:
            for k, salt, cells, counts in zip(*(batch.column(c).to_pylist() for c in ("slice", "salt", "cells", "counts"))):
                if now != (k, salt):
                    if now is not None:
                        yield done()
                    now, total = (k, salt), np.zeros(1 << SLICE_BITS, "int64")
                total[np.frombuffer(cells, "<u2")] += np.frombuffer(counts, "uint8")
        if now is not None:
            yield done()
    return run


def frequent_cells(texts: DataFrame, cells: int, least: int, pairs_pass=None) -> np.ndarray:
    """A filter: ``cells`` bits, set where all that falls into a cell reaches ``least`` together. Counts stop at 255."""
    schema = "slice int, salt int, cells binary, counts binary"
    counted = texts.mapInArrow(_cell_counts(cells, pairs_pass), schema)
    some = counted.repartition("slice", "salt").sortWithinPartitions("slice", "salt").mapInArrow(_summed(False, least), schema)
    bits = some.repartition("slice").sortWithinPartitions("slice", "salt").mapInArrow(_summed(True, min(least, 255)), schema)
    out = np.zeros(cells >> 3, "uint8")
    size = 1 << (SLICE_BITS - 3)
    # At most MOST_CELLS bits in all.
    for row in bits.select("slice", "counts").collect():
        out[row["slice"] * size:(row["slice"] + 1) * size] = np.frombuffer(row["counts"], "uint8")
    return out


class Trie:
    """A shallow trie over word ids with hash containers as leaves. Phrases are the bytes of their 32-bit ids."""

    def __init__(self, burst: int = BURST):
        self.burst = burst
        self.top: dict[bytes, list] = {}        # first word -> [count, container or trie level, entries]
        self.entries = 0

    def add(self, phrase: bytes, n: int) -> None:
        node = self.top.get(phrase[:4])
        if node is None:
            node = self.top[phrase[:4]] = [0, {}, 1]
            self.entries += 1
        if len(phrase) == 4:
            node[0] += n
            return
        new = _put(node, phrase[4:], n, self.burst)
        node[2] += new
        self.entries += new

    def largest(self, keep: int) -> list[bytes]:
        """First words of the largest subtrees, so many that at most ``keep`` entries are left."""
        out, left = [], self.entries
        for word, node in sorted(self.top.items(), key=lambda item: -item[1][2]):
            if left <= keep:
                break
            out.append(word)
            left -= node[2]
        return out

    def cut_off(self, word: bytes) -> list[tuple[bytes, int]]:
        """All phrases of a subtree with their counts; the subtree is gone afterwards."""
        node = self.top.pop(word)
        self.entries -= node[2]
        out = [(word, node[0])] if node[0] else []
        _collect(node[1], word, out)
        return out


class Level(dict):
    """A burst container: next word -> [count of the phrase that ends there, container or level]."""


def _put(node: list, rest: bytes, n: int, burst: int) -> int:
    """Adds ``n`` at ``rest`` below ``node``; how many entries that made."""
    below = node[1]
    while isinstance(below, Level):
        node = below.get(rest[:4])
        if node is None:
            node = below[rest[:4]] = [0, {}]
        rest = rest[4:]
        if not rest:
            node[0] += n
            return int(node[0] == n)
        below = node[1]
    before = below.get(rest)
    below[rest] = n if before is None else before + n
    if before is None and len(below) % burst == 0 and max(map(len, below)) > 4:
        node[1] = _burst(below)
    return int(before is None)


def _burst(container: dict[bytes, int]) -> Level:
    level = Level()
    for rest, n in container.items():
        node = level.setdefault(rest[:4], [0, {}])
        if len(rest) == 4:
            node[0] = n
        else:
            node[1][rest[4:]] = n
    return level


def _collect(below: dict, head: bytes, out: list[tuple[bytes, int]]) -> None:
    if isinstance(below, Level):
        for word, (n, deeper) in below.items():
            if n:
                out.append((head + word, n))
            _collect(deeper, head + word, out)
    else:
        out.extend((head + rest, n) for rest, n in below.items())


def _blocks(lang: str, entries: list[tuple[bytes, int]], parts: int) -> Iterator:
    """A sorted run as rows: language, partition, first phrase, phrases one per line, counts."""
    import pyarrow as pa

    dealt: dict[int, list[tuple[bytes, int]]] = {}
    for entry in entries:
        dealt.setdefault(crc32(b" ".join(entry[0].split(b" ", 2)[:2])) % parts, []).append(entry)
    rows = []
    for part, some in sorted(dealt.items()):
        some.sort()
        for a in range(0, len(some), BLOCK):
            block = some[a:a + BLOCK]
            rows.append((lang, part, block[0][0], b"\n".join(p for p, _ in block), np.array([n for _, n in block], "<i8").tobytes()))
    kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    for a in range(0, len(rows), 256):
        columns = [pa.array(column, kind) for column, kind in zip(zip(*rows[a:a + 256]), kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "part", "first", "phrases", "counts"])


def _runs(pairs_pass, triples_pass, most: int, entries: int, parts: int):
    """Pass 3: sorted runs of phrases, of whole subtrees of each task's tries, and of its words."""
    def run(batches: Iterator) -> Iterator:
        pair_bits, triple_bits = pairs_pass.value, triples_pass.value
        known: dict[str, tuple[Words, Trie]] = {}

        def spilled(lang: str, words: Words, trie: Trie, keep: int):
            spell = words.spelled.__getitem__
            out = []
            for first in trie.largest(keep):
                out += [(b" ".join(map(spell, np.frombuffer(p, "<i4").tolist())), n) for p, n in trie.cut_off(first)]
            if not keep:
                # All words count towards the language's total, under the empty phrase.
                out.append((b"", int(words.seen[1:].sum())))
                own = np.flatnonzero(words.seen)
                own = own[(own != BREAK) & _passing(pair_bits, words.hashes[own])]
                out += [(words.spelled[i], int(words.seen[i])) for i in own.tolist()]
            yield from _blocks(lang, out, parts)

        for batch in batches:
            for lang, text in _by_lang(batch):
                if lang not in known:
                    known[lang] = Words(lang), Trie()
                words, trie = known[lang]
                ids = _ids(words, text)
                hashes, raw = words.hashes[ids], ids.astype("<i4").tobytes()
                seen = np.bincount(ids, minlength=len(words.spelled))
                seen[:len(words.seen)] += words.seen
                words.seen = seen
                starts, joined = _pairs(ids, hashes, pair_bits)
                longer = np.zeros(len(ids), bool)
                for k in range(2, most + 1):
                    if k == 3:
                        starts, joined = _triples(starts, joined, hashes, triple_bits)
                        longer[starts] = True
                    elif k > 3:
                        starts = starts[longer[starts + 1]]
                    for phrase, n in Counter([raw[4 * i:4 * (i + k)] for i in starts.tolist()]).items():
                        trie.add(phrase, n)
                    if k > 2:
                        longer[:] = False
                        longer[starts] = True
            while sum(t.entries for _, t in known.values()) > entries:
                lang, (words, trie) = max(known.items(), key=lambda item: item[1][1].entries)
                yield from spilled(lang, words, trie, max(1, trie.entries // 2))
            if sum(len(w.spelled) for w, _ in known.values()) > KNOWN_WORDS:
                # Ids of words end with their trie: all of it goes.
                for lang, (words, trie) in known.items():
                    yield from spilled(lang, words, trie, 0)
                known = {}
        for lang, (words, trie) in known.items():
            yield from spilled(lang, words, trie, 0)
    return run


def _merged(least: int):
    """Runs of each language and partition merged by a heap; phrases below ``least`` go.

    Blocks come in the order of their first phrases, so what is smaller than the next one's is complete.
    """
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        heap: list[tuple] = []                  # (next phrase, number of the block, place, phrases, counts)
        where, phrase, total, number = None, None, 0, 0
        out: list[tuple] = []

        def drained(limit: bytes | None) -> None:
            nonlocal phrase, total
            while heap and (limit is None or heap[0][0] < limit):
                now, block, at, phrases, counts = heappop(heap)
                if now == phrase:
                    total += counts[at]
                else:
                    if phrase is not None and total >= least:
                        out.append((where[0], phrase, phrase.count(b" ") + 1, total))
                    phrase, total = now, counts[at]
                if at + 1 < len(phrases):
                    heappush(heap, (phrases[at + 1], block, at + 1, phrases, counts))

        def ended() -> None:
            nonlocal phrase
            drained(None)
            if phrase is not None and total >= least:
                out.append((where[0], phrase, phrase.count(b" ") + 1, total))
            phrase = None

        def rows():
            lang, phrases, k, n = zip(*out)
            columns = [pa.array(lang, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(k, pa.int32()), pa.array(n, pa.int64())]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "k", "f"])

        for batch in batches:
            for lang, part, first, phrases, counts in zip(*(batch.column(c).to_pylist() for c in ("lang", "part", "first", "phrases", "counts"))):
                if (lang, part) != where:
                    ended()
                    where = lang, part
                drained(first)
                number += 1
                heappush(heap, (first, number, 0, phrases.split(b"\n"), np.frombuffer(counts, "<i8").tolist()))
            if out:
                yield rows()
        ended()
        if out:
            yield rows()
    return run


def phrase_counts(
    df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST_COUNT, most: int = MOST_WORDS,
    cells: int | None = None, entries: int = TRIE_ENTRIES,
) -> DataFrame:
    """``lang``, ``phrase``, ``k`` (words), ``f`` of all phrases of up to ``most`` words found ``least`` times or more.

    The empty phrase, with one word, holds the number of all words of the language.
    """
    spark = ready(df.sparkSession)
    texts = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("text <> ''")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if cells is None:
        cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (size // BYTES_PER_CELL).bit_length()))
    pairs_pass = spark.sparkContext.broadcast(frequent_cells(texts, cells, least))
    triples_pass = spark.sparkContext.broadcast(frequent_cells(texts, cells, least, pairs_pass))
    parts = max(LEAST_PARTS, size // BYTES_PER_PART)
    runs = texts.mapInArrow(_runs(pairs_pass, triples_pass, most, entries, parts), "lang string, part int, first binary, phrases binary, counts binary")
    # One shuffle: a language's phrases with the same first two words meet, in order.
    dealt = runs.repartition("lang", "part").sortWithinPartitions("lang", "part", "first")
    return written(dealt.mapInArrow(_merged(least), "lang string, phrase string, k int, f bigint"), "phrase-counts")


def score_cuts(counts: DataFrame) -> DataFrame:
    """Candidates with their lowest-scoring cut: ``lang``, ``phrase``, ``k``, ``a``, ``l``, ``r``, ``n``, ``score``."""
    # One row per language, dealt out several times: a language may hold a third of all candidates.
    totals = counts.where("phrase = ''").select("lang", F.col("f").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    phrases = counts.where("phrase <> ''")
    words = F.split("phrase", " ")
    cuts = phrases.where("k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"), words.alias("w")).select(
        "lang", "phrase", "k", "a", F.explode(F.expr(
            "transform(sequence(1, k - 1), i -> struct(i AS cut, array_join(slice(w, 1, i), ' ') AS head, array_join(slice(w, i + 1, k - i), ' ') AS tail))"
        )).alias("c"),
    ).select("lang", "phrase", "k", "a", "c.cut", "c.head", "c.tail")
    heads = phrases.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = phrases.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")).join(totals, ["lang", "salt"]).withColumn(
        "score", F.expr("CAST(CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0)) AS DECIMAL(38,0)) "
                        "div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    )
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "k", "a", "l", "r", "n")).alias("b"))
    return best.select("lang", "phrase", "b.k", "b.a", "b.l", "b.r", "b.n", "b.score")


def without_parts(candidates: DataFrame) -> DataFrame:
    """Candidates that lie in no longer candidate with as high a count.

    A phrase between the two has a count between theirs, so only candidates with one word more need be asked.
    """
    words = F.split("phrase", " ")
    parts = candidates.where("k >= 3").select("lang", "a", F.explode(F.array(
        F.array_join(F.slice(words, F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("k") - 1), " ")
    )).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return candidates.join(parts, ["lang", "phrase"], "left").where("longer IS NULL OR longer < a").drop("longer")


def best_by_lang(candidates: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language, ranked first in groups by hash, then among what is left of them."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    some = candidates.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
    ).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top).drop("salt")


def collocations(
    df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST_COUNT, most: int = MOST_WORDS, top: int = TOP,
    cells: int | None = None, entries: int = TRIE_ENTRIES,
) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` of the best phrases of every language."""
    counts = phrase_counts(df, text, lang, least, most, cells, entries)
    candidates = written(score_cuts(counts), "phrase-candidates")
    return best_by_lang(without_parts(candidates), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
