"""Removal of repeated byte strings with a run-length index.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id. The work is cut
so that all places of such a string meet: every window of that length contains an anchor, the substring of ``ANCHOR``
bytes with the least hash, and equal windows have equal anchors. The steps:

1. Texts that equal one of a smaller id go as a whole. The others are packed into compressed blocks of documents.
2. Each block sends the hashes of its anchors once; those that stand in two documents come back.
3. Each block sends the contexts of such anchors (all windows that contain it), once per distinct context. Where they
   meet, a run-compressed Burrows-Wheeler transform of the distinct contexts is built, with a sample at each run's end
   and the smallest document of its matches. Each context is streamed backwards through it; where its match reaches
   ``LENGTH`` bytes in a smaller document, the window is marked, and the marks go back to the blocks.
4. Each block cuts the marked windows out.

Hot passages are combined per block before they are shuffled: a block sends each anchor and each context once.

Defined cases: a null text is empty; matches never cross documents; rows with a null id are neither compared nor cut;
rows with one id are one document's copies and do not cut each other; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from chunkloom.llm.common import written

LENGTH = 50
ANCHOR = 20
REACH = LENGTH - ANCHOR
BLOCK_BYTES = 1_000_000
# What one task of step 2 and of step 3 takes on the average.
ANCHORS_PER_PART = 1_000_000
CONTEXTS_PER_PART = 40_000
# Contexts that are indexed together; anchors are never split over two indexes.
CONTEXTS_PER_INDEX = 10_000
BROADCAST_ROWS = 1_000_000

_BLOCKS = "ids binary, offsets binary, body binary, size bigint"
RESULT = "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"


# -- documents and blocks ---------------------------------------------------------------------------------------------

def _pack(batches: Iterator) -> Iterator:
    """Blocks of about ``BLOCK_BYTES`` of text, documents in the order of their ids."""
    import pyarrow as pa

    held: list[tuple[int, bytes]] = []
    size = 0

    def block():
        held.sort(key=lambda d: d[0])
        texts = [t for _, t in held]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype("int64")
        body = b"".join(texts)
        return pa.RecordBatch.from_arrays([
            pa.array([np.array([i for i, _ in held], "int64").tobytes()], pa.binary()), pa.array([offsets.tobytes()], pa.binary()),
            pa.array([pa.compress(body, codec="zstd", asbytes=True)], pa.binary()), pa.array([len(body)], pa.int64()),
        ], names=["ids", "offsets", "body", "size"])

    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast("binary").to_pylist()):
            held.append((doc, text or b""))
            size += len(held[-1][1])
            if size >= BLOCK_BYTES:
                yield block()
                held, size = [], 0
    if held:
        yield block()


class Block:
    """The documents of one block with their anchors and contexts."""

    def __init__(self, ids: bytes, offsets: bytes, body: bytes, size: int):
        import pyarrow as pa

        from chunkloom.llm.hashing import Substrings, mixed

        self.ids = np.frombuffer(ids, "int64")
        self.offsets = np.frombuffer(offsets, "int64")
        self.bytes = pa.decompress(body, decompressed_size=size, codec="zstd", asbytes=True) if size else b""
        data = np.frombuffer(self.bytes, "uint8")
        self.places = np.zeros(0, "int64")
        self.hashes = np.zeros(0, "uint64")
        if len(data) >= LENGTH:
            sums = Substrings(data)
            grams = sums.all(ANCHOR)
            # The hash above, the place below: the least of them is the leftmost of the least hashes.
            least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype="uint64")
            width = 1
            while 2 * width <= REACH + 1:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            rest = REACH + 1 - width
            if rest:
                least = np.minimum(least[:-rest], least[rest:])
            inside = np.ones(len(data) + 1, bool)   # windows that end in their own document
            for end in self.offsets[1:]:
                inside[max(0, end - LENGTH + 1):end] = False
            places = (least & np.uint64(0xFFFFFFFF)).astype("int64")[inside[:len(least)]]
            if len(places):
                self.places = places[np.concatenate([[True], places[1:] != places[:-1]])]
                self.hashes = grams[self.places]
        self.doc = np.searchsorted(self.offsets, self.places, "right") - 1
        while len(self.doc) and (empty := self.offsets[self.doc + 1] <= self.places).any():
            self.doc = self.doc + empty             # an empty document begins where the next one does
        self.starts = np.maximum(self.offsets[self.doc], self.places - REACH)
        self.ends = np.minimum(self.offsets[self.doc + 1], self.places + LENGTH)
        if len(self.places):
            left = (self.places - self.starts).astype("uint64")
            self.contexts = mixed(sums.of(self.starts, self.ends) + left * np.uint64(0x9E6C63D0676A9A99))
        else:
            self.contexts = self.hashes

    @property
    def anchors(self) -> np.ndarray:
        """47 bits of each anchor's hash, mixed again: the least of many hashes are small ones."""
        from chunkloom.llm.hashing import mixed

        return mixed(self.hashes) >> np.uint64(17)


def _six(values: np.ndarray) -> np.ndarray:
    """48-bit numbers as six bytes each."""
    return np.ascontiguousarray(values.astype("<u8").view("uint8").reshape(-1, 8)[:, :6])


def _unsix(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), "uint8")
    wide[:, :6] = np.frombuffer(data, "uint8").reshape(-1, 6)
    return wide.view("<u8").ravel()


def _parts(anchors: np.ndarray, parts: int) -> np.ndarray:
    return ((anchors >> np.uint64(15)) * np.uint64(parts)) >> np.uint64(32)


def _blocks_of(batches: Iterator) -> Iterator[tuple[int, Block, list]]:
    for batch in batches:
        extra = batch.column("more").to_pylist() if "more" in batch.schema.names else [None] * batch.num_rows
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in ("block", "ids", "offsets", "body", "size")}
            yield row.pop("block"), Block(**row), extra[i] or []


# -- step 2: anchors in two documents ---------------------------------------------------------------------------------

def _send_anchors(parts: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for number, block, _ in _blocks_of(batches):
            order = np.lexsort((block.doc, block.anchors))
            anchors, docs = block.anchors[order], block.ids[block.doc[order]]
            if not len(anchors):
                continue
            new = np.concatenate([[True], anchors[1:] != anchors[:-1]])
            at = np.flatnonzero(new)
            last = np.concatenate([at[1:], [len(anchors)]]) - 1
            distinct = anchors[at]
            several = (docs[at] != docs[last]).astype("uint64")
            owner = _parts(distinct, parts).astype("int64")
            packed = _six((distinct << np.uint64(1)) | several)
            cuts = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1, [len(owner)]])
            yield pa.RecordBatch.from_arrays([
                pa.array(owner[cuts[:-1]], pa.int64()), pa.array(np.full(len(cuts) - 1, number), pa.int64()),
                pa.array([packed[a:z].tobytes() for a, z in zip(cuts, cuts[1:])], pa.binary()),
            ], names=["part", "block", "anchors"])
    return run


def _shared_anchors(rows):
    """Anchors of one part that stand in two documents, per block."""
    import pyarrow as pa

    blocks = rows.column("block").to_numpy()
    lists = [_unsix(b.as_py()) for b in rows.column("anchors")]
    values = np.concatenate(lists)
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    anchors, several = values >> np.uint64(1), (values & np.uint64(1)).astype(bool)
    order = np.argsort(anchors, kind="stable")
    ordered = anchors[order]
    same = ordered[1:] == ordered[:-1]
    shared = several[order]
    shared[1:] |= same
    shared[:-1] |= same
    chosen = order[shared]
    chosen = chosen[np.argsort(owner[chosen], kind="stable")]
    cuts = np.searchsorted(owner[chosen], np.arange(len(lists) + 1))
    packed = _six(anchors[chosen])
    some = np.flatnonzero(cuts[1:] > cuts[:-1])
    return pa.Table.from_arrays([
        pa.array(blocks[some], pa.int64()), pa.array([packed[cuts[i]:cuts[i + 1]].tobytes() for i in some], pa.binary()),
    ], names=["block", "more"])


# -- step 3: contexts, index, marks -----------------------------------------------------------------------------------

_CONTEXTS = "part bigint, block bigint, anchors binary, contexts binary, docs binary, sizes binary, lefts binary, body binary"


def _send_contexts(parts: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for number, block, shared in _blocks_of(batches):
            wanted = np.unique(np.concatenate([_unsix(s) for s in shared])) if shared else np.zeros(0, "uint64")
            chosen = np.flatnonzero(np.isin(block.anchors, wanted))
            # Documents lie in the order of their ids, so the first place is that of the smallest.
            chosen = chosen[np.unique(block.contexts[chosen], return_index=True)[1]]
            chosen = chosen[np.argsort(block.anchors[chosen], kind="stable")]
            if not len(chosen):
                continue
            owner = _parts(block.anchors[chosen], parts).astype("int64")
            cuts = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1, [len(owner)]])
            rows: list[list] = [[] for _ in range(8)]
            for a, z in zip(cuts, cuts[1:]):
                mine = chosen[a:z]
                body = b"".join([block.bytes[s:e] for s, e in zip(block.starts[mine].tolist(), block.ends[mine].tolist())])
                for column, value in zip(rows, (
                    owner[a], number, block.anchors[mine].tobytes(), block.contexts[mine].tobytes(), block.ids[block.doc[mine]].tobytes(),
                    (block.ends[mine] - block.starts[mine]).astype("uint8").tobytes(), (block.places[mine] - block.starts[mine]).astype("uint8").tobytes(), body,
                )):
                    column.append(value)
            types = [pa.int64(), pa.int64()] + [pa.binary()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, types)], names=["part", "block", "anchors", "contexts", "docs", "sizes", "lefts", "body"]
            )
    return run


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of short texts, each with an end mark of its own, in the given order.

    Runs are cut where the character before changes and where the first ``LENGTH`` bytes of the suffix do. A run keeps
    its first row, its character, how often that character came before, a sample of the text position at its end, and
    the smallest document in which the match of its suffixes stands (none for suffixes that are too short).
    """

    def __init__(self, texts: np.ndarray, offsets: np.ndarray, docs: np.ndarray):
        sizes = np.diff(offsets)
        count, total = len(sizes), len(texts)
        # Text i becomes its bytes plus one, then a zero; places[i] is where it begins.
        self.first = offsets[:-1] + np.arange(count)
        self.last = offsets[1:] + np.arange(count)
        signs = np.zeros(total + count, "int64")
        owner = np.repeat(np.arange(count), sizes + 1)
        signs[np.arange(total) + np.repeat(np.arange(count), sizes)] = texts.astype("int64") + 1
        left = self.last[owner] - np.arange(total + count)     # bytes until the end mark
        ranks = self._ranked(self._first_signs(signs, left))
        depth = 7
        while depth < LENGTH // 2 + 1:
            ranks, depth = self._doubled(ranks, left, depth), 2 * depth
        # Two overlapping prefixes make the first LENGTH bytes.
        classes = self._ranked((ranks << np.int64(32)) | self._shifted(ranks, left, LENGTH - depth))
        while depth < sizes.max(initial=0):
            ranks, depth = self._doubled(ranks, left, depth), 2 * depth
        order = np.argsort(ranks, kind="stable")
        before = signs[order - 1]
        before[np.isin(order, self.first)] = 0
        long = left[order] >= LENGTH
        kinds = np.where(long, classes[order], -1)
        new = np.concatenate([[True], (before[1:] != before[:-1]) | (kinds[1:] != kinds[:-1])])
        self.starts = np.flatnonzero(new)
        lengths = np.diff(np.concatenate([self.starts, [len(order)]]))
        self.signs = before[self.starts]
        self.samples = order[self.starts + lengths - 1]
        self.counts = np.zeros(258, "int64")
        np.cumsum(np.bincount(before, minlength=257), out=self.counts[1:])
        self.ranks = np.zeros(len(self.starts), "int64")
        by_sign = np.argsort(self.signs, kind="stable")
        run_lengths = lengths[by_sign]
        sums = np.cumsum(run_lengths) - run_lengths
        fresh = np.concatenate([[True], self.signs[by_sign][1:] != self.signs[by_sign][:-1]])
        self.ranks[by_sign] = sums - np.repeat(sums[fresh], np.diff(np.concatenate([np.flatnonzero(fresh), [len(sums)]])))
        # Runs of one class lie side by side: the class's smallest document is a minimum over neighbouring runs.
        run_docs = np.minimum.reduceat(docs[owner[order]], self.starts)
        run_kinds = kinds[self.starts]
        edge = np.flatnonzero(np.concatenate([[True], run_kinds[1:] != run_kinds[:-1]]))
        smallest = np.minimum.reduceat(run_docs, edge)
        self.smallest = np.repeat(smallest, np.diff(np.concatenate([edge, [len(run_kinds)]])))
        self.smallest[run_kinds < 0] = np.iinfo("int64").max
        self.sizes = sizes

    @staticmethod
    def _ranked(keys: np.ndarray) -> np.ndarray:
        return np.unique(keys, return_inverse=True)[1].astype("int64")

    @staticmethod
    def _first_signs(signs: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Seven signs of nine bits; nothing behind the end mark."""
        padded, keys = np.concatenate([signs, np.zeros(7, "int64")]), np.zeros(len(signs), "int64")
        for i in range(7):
            keys = (keys << np.int64(9)) | np.where(left > i, padded[i:i + len(signs)], 0)
        return keys

    @staticmethod
    def _shifted(ranks: np.ndarray, left: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(len(ranks), "int64")
        inside = np.flatnonzero(left > by)
        out[inside] = ranks[inside + by] + 1
        return out

    def _doubled(self, ranks: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
        return self._ranked((ranks << np.int64(32)) | self._shifted(ranks, left, depth))

    def stream(self) -> np.ndarray:
        """For every text and window start (up to ``REACH``), the smallest document with the same ``LENGTH`` bytes.

        All texts go through the index at once, one character backwards at a step, each from its own end mark.
        """
        none = np.iinfo("int64").max
        found = np.full((len(self.sizes), REACH + 1), none, "int64")
        rows = np.arange(len(self.sizes))           # end marks come first, in the order of the texts
        at = self.sizes.copy()
        going = np.flatnonzero(at > 0)
        while len(going):
            run = np.searchsorted(self.starts, rows[going], "right") - 1
            rows[going] = self.counts[self.signs[run]] + self.ranks[run] + rows[going] - self.starts[run]
            at[going] -= 1
            reached = going[(self.sizes[going] - at[going] >= LENGTH) & (at[going] <= REACH)]
            match = np.searchsorted(self.starts, rows[reached], "right") - 1
            found[reached, at[reached]] = self.smallest[match]
            going = going[at[going] > 0]
        return found


def _with_neighbour(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, places: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Whether another of these contexts goes on like this one for half of ``REACH`` bytes to a side of the anchor.

    A window has ``REACH`` bytes beside its anchor, so half of them, at least, on one side.
    """
    from chunkloom.llm.hashing import Substrings

    half, sums = (REACH + 1) // 2, Substrings(body)
    near = np.zeros(len(starts), bool)
    for a, z in ((places - half, places), (places + ANCHOR, places + ANCHOR + half)):
        inside = np.flatnonzero((a >= starts) & (z <= ends))
        keys = sums.of(a[inside], z[inside]) ^ (anchors[inside] << np.uint64(17))
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        near[inside] |= counts[inverse] > 1
    return near


def _mark(rows):
    """Windows of the contexts of one part that stand in a smaller document, as bit masks per block."""
    import pyarrow as pa

    def column(name: str, kind: str) -> list[np.ndarray]:
        return [np.frombuffer(v.as_py(), kind) for v in rows.column(name)]

    anchors, contexts, docs, sizes, lefts = (
        np.concatenate(column(n, k))
        for n, k in (("anchors", "uint64"), ("contexts", "uint64"), ("docs", "int64"), ("sizes", "uint8"), ("lefts", "uint8"))
    )
    counts = [len(c) for c in column("contexts", "uint64")]
    owner = np.repeat(np.arange(len(counts)), counts)
    body = np.frombuffer(b"".join(v.as_py() for v in rows.column("body")), "uint8")
    ends = np.cumsum(sizes, dtype="int64")
    starts = ends - sizes
    masks = np.zeros(len(contexts), "uint64")
    order = np.lexsort((docs, contexts, anchors))
    new = np.concatenate([[True], (contexts[order][1:] != contexts[order][:-1]) | (anchors[order][1:] != anchors[order][:-1])])
    heads = order[new]                              # distinct contexts, each with its smallest document
    group = np.cumsum(new) - 1
    smallest = np.full((len(heads), REACH + 1), np.iinfo("int64").max, "int64")
    # A context that can match no other only matches itself.
    smallest[:] = docs[heads, None]
    near = _with_neighbour(body, starts[heads], ends[heads], starts[heads] + lefts[heads], anchors[heads])
    chosen = np.flatnonzero(near)
    heads = heads[chosen]
    edges = np.flatnonzero(anchors[heads][1:] != anchors[heads][:-1]) + 1
    cuts, at = [0], 0
    for edge in np.append(edges, len(heads)) if len(heads) else ():
        if edge - at >= CONTEXTS_PER_INDEX or edge == len(heads):
            cuts.append(int(edge))
            at = edge
    bits = np.uint64(1) << np.arange(REACH + 1, dtype="uint64")
    for a, z in zip(cuts, cuts[1:]):
        mine = heads[a:z]
        by_doc = np.argsort(docs[mine], kind="stable")
        mine = mine[by_doc]
        lengths = sizes[mine].astype("int64")
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        take = np.repeat(starts[mine] - offsets[:-1], lengths) + np.arange(offsets[-1])
        smallest[chosen[a:z][by_doc]] = RunIndex(body[take], offsets, docs[mine]).stream()
    for a in range(0, len(order), 100_000):
        some = order[a:a + 100_000]
        masks[some] = ((smallest[group[a:a + 100_000]] < docs[some, None]) * bits).sum(axis=1, dtype="uint64")
    marked = np.flatnonzero(masks)
    marked = marked[np.argsort(owner[marked], kind="stable")]
    at = np.searchsorted(owner[marked], np.arange(len(counts) + 1))
    pairs = np.column_stack([contexts[marked], masks[marked]])
    blocks = rows.column("block").to_numpy()
    some = np.flatnonzero(at[1:] > at[:-1])
    return pa.Table.from_arrays([
        pa.array(blocks[some], pa.int64()), pa.array([pairs[at[i]:at[i + 1]].tobytes() for i in some], pa.binary()),
    ], names=["block", "more"])


# -- step 4: cutting --------------------------------------------------------------------------------------------------

def _cut(batches: Iterator) -> Iterator:
    import pyarrow as pa

    bits = np.arange(REACH + 1, dtype="uint64")
    for _, block, marks in _blocks_of(batches):
        pairs = np.concatenate([np.frombuffer(m, "uint64").reshape(-1, 2) for m in marks]) if marks else np.zeros((0, 2), "uint64")
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        masks = np.zeros(len(block.places), "uint64")
        if len(pairs) and len(masks):
            at = np.minimum(np.searchsorted(pairs[:, 0], block.contexts), len(pairs) - 1)
            masks = np.where(pairs[at, 0] == block.contexts, pairs[at, 1], 0).astype("uint64")
        # A context whose first place in this block is in a smaller document is repeated as a whole.
        if len(masks):
            _, first, inverse = np.unique(block.contexts, return_index=True, return_inverse=True)
            later = block.ids[block.doc] > block.ids[block.doc[first[inverse]]]
            masks[later] = np.uint64((1 << (REACH + 1)) - 1)
        hit = np.flatnonzero(masks)
        set_bits = (masks[hit, None] >> bits) & np.uint64(1) == 1
        windows = (block.starts[hit, None] + bits.astype("int64"))
        windows = windows[set_bits & (windows + LENGTH <= block.ends[hit, None])]
        depth = np.zeros(len(block.bytes) + 1, "int32")
        np.add.at(depth, windows, 1)
        np.add.at(depth, windows + LENGTH, -1)
        gone = np.cumsum(depth[:-1]) > 0
        data = np.frombuffer(block.bytes, "uint8")
        rows: list[list] = [[], [], [], []]
        for doc, a, z in zip(block.ids.tolist(), block.offsets[:-1].tolist(), block.offsets[1:].tolist()):
            edge = np.flatnonzero(np.diff(np.concatenate([[False], gone[a:z], [False]]).astype("int8")))
            rows[0].append(doc)
            rows[1].append(z - a)
            rows[2].append([{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()])
            rows[3].append(data[a:z][~gone[a:z]].tobytes() if len(edge) else block.bytes[a:z])
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        whole = pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), spans, pa.binary()))], names=["doc_id", "n_bytes", "spans", "kept"]
        )
        for i in range(0, whole.num_rows, 512):
            yield whole.slice(i, 512)


def remove_repeats(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its id, size, the spans taken out and the bytes left."""
    spark = df.sparkSession
    rows = df.select(F.col(id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = rows.where("doc_id IS NOT NULL").withColumn("digest", F.sha2("text", 256)).withColumn("n", F.octet_length("text"))
    first = known.where(F.col("n") >= LENGTH).groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    later = written(
        known.where(F.col("n") >= LENGTH).select("doc_id", "digest", F.col("n").cast("bigint").alias("n_bytes")).join(first, "digest")
        .where("doc_id > first").select("doc_id", "digest", "n_bytes"), "later-copies",
    )
    copies = later.select("doc_id", "digest").distinct()
    if copies.count() <= BROADCAST_ROWS:
        copies = F.broadcast(copies)
    alone = known.join(copies, ["doc_id", "digest"], "left_anti").select("doc_id", "text")
    blocks = written(alone.mapInArrow(_pack, _BLOCKS).withColumn("block", F.monotonically_increasing_id()), "text-blocks")
    total = blocks.agg(F.sum("size")).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, total // (16 * ANCHORS_PER_PART))
    shared = written(
        blocks.mapInArrow(_send_anchors(parts), "part bigint, block bigint, anchors binary")
        .groupBy("part").applyInArrow(_shared_anchors, "block bigint, more binary"), "shared-anchors",
    )
    places = shared.agg(F.sum(F.octet_length("more") / 6)).first()[0] or 0
    parts = max(least, int(places) // CONTEXTS_PER_PART)
    lists = shared.groupBy("block").agg(F.collect_list("more").alias("more"))
    marks = written(
        blocks.join(lists, "block").mapInArrow(_send_contexts(parts), _CONTEXTS)
        .groupBy("part").applyInArrow(_mark, "block bigint, more binary"), "marks",
    )
    lists = marks.groupBy("block").agg(F.collect_list("more").alias("more"))
    cut = blocks.join(lists, "block", "left").mapInArrow(_cut, RESULT)
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("end")))
    copied = later.select("doc_id", "n_bytes", whole.alias("spans"), F.lit(b"").alias("kept"))
    nameless = rows.where("doc_id IS NULL").select(
        "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"),
        F.col("text").cast("binary").alias("kept"),
    )
    return cut.unionByName(copied).unionByName(nameless)
