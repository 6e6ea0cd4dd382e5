"""Fill-in-middle transformation by displacement scatter.

Every text is cut in prefix, middle and suffix at two code points drawn from a hash of its id, and written in one of
three forms: plain (the text), psm (prefix, suffix, middle) or spm (suffix, prefix, middle), each part behind its mark.
An Arrow batch is one run of bytes: the cuts are byte places, a difference array holds at each cut by how much the
displacement changes, its cumulative sum is the displacement of every byte, and one scatter writes all outputs. The way
back finds the marks in the outputs alone, builds the difference array of the restored bytes and gathers.

Defined cases: a null text is an empty one, an empty text is plain; a text that contains a mark is plain, so that marks
in an output are always the operator's; a null id counts as an id without digits; rows with one id are cut with the
same draws; columns named like the made ones are replaced, all others pass through; an empty table gives no rows.
Memory per task is a small multiple of one Arrow batch, which is bounded in rows and bytes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, types as T

from chunkloom.llm.hashing import text_column

MARKS = ("<P>", "<S>", "<M>")
FORMS = ("plain", "psm", "spm")
PLAIN, PSM, SPM = range(3)


def _checked(marks: Sequence[str]) -> list[np.ndarray]:
    """The marks as bytes; two of them can never overlap, so that each is found where it was put and nowhere else."""
    raw = [m.encode() for m in marks]
    for a in raw:
        for b in raw:
            if not a or (a is not b and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"marks {marks} are empty, contain or overlap each other")
    return [np.frombuffer(m, "uint8") for m in raw]


def _found(data: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """All places of ``mark``."""
    last = max(0, len(data) - len(mark) + 1)
    hit = data[:last] == mark[0]
    for k in range(1, len(mark)):
        hit &= data[k:last + k] == mark[k]
    return np.flatnonzero(hit)


def _within(places: np.ndarray, size: int, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of ``places`` whose ``size`` bytes lie in one text, and the number of that text."""
    row = np.searchsorted(offsets, places, side="right") - 1
    whole = places + size <= offsets[row + 1]
    return places[whole], row[whole]


def _moved_to(n: int, starts: Sequence[np.ndarray], moves: Sequence[np.ndarray]) -> np.ndarray:
    """Per byte its place plus the move of the segment that holds it; segments of a text follow each other and texts do too."""
    kind = "int32" if n + max((int(np.abs(m).max(initial=0)) for m in moves), default=0) < 1 << 31 else "int64"
    change = np.zeros(n + 1, kind)
    before = np.zeros(len(moves[0]), "int64")
    for at, move in zip(starts, moves):
        np.add.at(change, at, (move - before).astype(kind))
        before = move
    # Where the next text begins, the last move of the one before ends.
    np.add.at(change, starts[0][1:], -before[:-1].astype(kind))
    place = change[:-1]
    np.cumsum(place, out=place)
    place += np.arange(n, dtype=kind)
    return place


def draws(ids: list, seed: int) -> np.ndarray:
    """Four unsigned integers of 32 bits per id: the first half of the SHA-256 of ``seed:id``."""
    from hashlib import sha256

    head = f"{seed}:".encode()
    digests = b"".join(sha256(head + (b"" if i is None else b"%d" % i)).digest()[:16] for i in ids)
    return np.frombuffer(digests, ">u4").reshape(-1, 4).astype("int64")


def scatter(data: np.ndarray, offsets: np.ndarray, drawn: np.ndarray, marks: list[np.ndarray], plain_from: int, spm_below: int):
    """Outputs of a batch: bytes, offsets, forms, code points in all, in the prefix and in the middle."""
    begins, ends = offsets[:-1], offsets[1:]
    heads = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    first = np.searchsorted(heads, offsets)
    n = np.diff(first)
    cuts = np.sort(drawn[:, :2] % (n + 1)[:, None], axis=1)
    form = np.where(drawn[:, 2] % 100 >= plain_from, PLAIN, np.where(drawn[:, 3] % 100 < spm_below, SPM, PSM))
    form[n == 0] = PLAIN
    for mark in marks:
        form[_within(_found(data, mark), len(mark), offsets)[1]] = PLAIN
    moved = form != PLAIN
    one = np.where(moved, heads[first[:-1] + cuts[:, 0]], ends)
    two = np.where(moved, heads[first[:-1] + cuts[:, 1]], ends)
    prefix, middle, suffix = one - begins, two - one, ends - two
    p, s, m = (len(mark) for mark in marks)
    sizes = ends - begins + moved * (p + s + m)
    out_offsets = np.concatenate([[0], np.cumsum(sizes)])
    q = out_offsets[:-1]
    to_prefix = np.select([form == PSM, form == SPM], [q + p, q + s + suffix + p], q)
    to_suffix = np.select([form == PSM, form == SPM], [q + p + prefix + s, q + s], q + prefix)
    to_middle = np.where(moved, q + p + s + m + prefix + suffix, q + prefix)
    out = np.zeros(out_offsets[-1], "uint8")
    out[_moved_to(len(data), [begins, one, two], [to_prefix - begins, to_middle - one, to_suffix - two])] = data
    for mark, places in zip(marks, (to_prefix - p, to_suffix - s, to_middle - m)):
        out[(places[moved][:, None] + np.arange(len(mark))).ravel()] = np.tile(mark, int(moved.sum()))
    return out, out_offsets, form, n, np.where(moved, cuts[:, 0], -1), np.where(moved, cuts[:, 1] - cuts[:, 0], -1)


def gather(out: np.ndarray, offsets: np.ndarray, form: np.ndarray, marks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a batch of outputs, from the outputs and their forms alone: bytes and offsets."""
    p, s, m = (len(mark) for mark in marks)
    begins, ends, moved = offsets[:-1], offsets[1:], form != PLAIN
    at = []
    for mark in marks:
        places, rows = _within(_found(out, mark), len(mark), offsets)
        own = moved[rows]
        if not np.array_equal(rows[own], np.flatnonzero(moved)):
            raise ValueError("an output that is not plain lacks a mark, or has one twice")
        place = begins.copy()
        place[moved] = places[own]
        at.append(place)
    at_p, at_s, at_m = at
    prefix = np.where(moved, np.where(form == PSM, at_s, at_m) - at_p - p, ends - begins)
    suffix = np.where(moved, np.where(form == PSM, at_m, at_p) - at_s - s, 0)
    middle = np.where(moved, ends - at_m - m, 0)
    back = np.concatenate([[0], np.cumsum(prefix + middle + suffix)])
    r = back[:-1]
    from_prefix = np.where(moved, at_p + p, begins) - r
    from_middle = np.where(moved, at_m + m - (r + prefix), from_prefix)
    from_suffix = np.where(moved, at_s + s - (r + prefix + middle), from_prefix)
    return out[_moved_to(int(back[-1]), [r, r + prefix, r + prefix + middle], [from_prefix, from_middle, from_suffix])], back


def _strings(data: np.ndarray, offsets: np.ndarray):
    import pyarrow as pa

    buffers = [None, pa.py_buffer(offsets.astype("int64").tobytes()), pa.py_buffer(data.tobytes())]
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, buffers).cast(pa.string())


def _with_columns(df: DataFrame, made: list[T.StructField]) -> tuple[list[str], T.StructType]:
    names = {f.name for f in made}
    at = [f.name for f in df.schema if f.name not in names]
    return at, T.StructType([df.schema[c] for c in at] + made)


def transform(
    df: DataFrame, id: str = "doc_id", text: str = "text", output: str = "output", restored: str | None = None,
    marks: Sequence[str] = MARKS, seed: int = 1, plain_from: int = 90, spm_below: int = 20,
) -> DataFrame:
    """``df`` with ``output``, ``form``, ``n`` (code points), ``prefix_chars`` and ``middle_chars`` (null where plain).

    Of a hundred texts ``100 - plain_from`` stay plain, and of the others ``spm_below`` in a hundred are spm. With
    ``restored``, the text rebuilt from output and form goes into that column in the same pass.
    """
    cut = _checked(marks)
    made = [
        T.StructField(output, T.StringType(), False), T.StructField("form", T.StringType(), False),
        T.StructField("n", T.LongType(), False), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
    ]
    if restored:
        made.append(T.StructField(restored, T.StringType(), False))
    at, schema = _with_columns(df, made)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, offsets = text_column(batch.column(text))
            drawn = draws(batch.column(id).to_pylist(), seed)
            out, out_offsets, form, n, prefix, middle = scatter(data, offsets, drawn, cut, plain_from, spm_below)
            columns = [
                _strings(out, out_offsets), pa.array([FORMS[f] for f in form.tolist()], pa.string()), pa.array(n, pa.int64()),
                pa.array(prefix, pa.int64(), mask=prefix < 0), pa.array(middle, pa.int64(), mask=middle < 0),
            ]
            if restored:
                columns.append(_strings(*gather(out, out_offsets, form, cut)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in at] + columns, names=schema.names)

    return df.mapInArrow(run, schema)


def restore(df: DataFrame, output: str = "output", form: str = "form", text: str = "restored", marks: Sequence[str] = MARKS) -> DataFrame:
    """``df`` with the texts that ``transform`` was given; null outputs give empty texts, null forms count as plain."""
    cut = _checked(marks)
    at, schema = _with_columns(df, [T.StructField(text, T.StringType(), False)])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, offsets = text_column(batch.column(output))
            forms = np.array([FORMS.index(f or FORMS[PLAIN]) for f in batch.column(form).to_pylist()], "int64")
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in at] + [_strings(*gather(data, offsets, forms, cut))], names=schema.names
            )

    return df.mapInArrow(run, schema)
