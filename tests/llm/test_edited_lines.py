"""Every pair of lines within the stated bits and edits is linked, whatever its length, against all pairs of lines."""

import random

import xxhash

from chunkloom.llm import lines, queries
from chunkloom.llm.common import ready


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, p in enumerate(a):
        new = [i + 1]
        for j, c in enumerate(b):
            new.append(min(row[j] + (p != c), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def _simhash(line):
    hashes = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in set(line.split())]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _gone(texts):
    """Documents of one line each that are not the first of their group."""
    hashes = {t: _simhash(t) for t in texts}
    label = list(range(len(texts)))
    linked = 0
    for j, b in enumerate(texts):
        for i, a in enumerate(texts[:j]):
            if (hashes[a] ^ hashes[b]).bit_count() <= lines.MAX_BITS and _edits(a, b) <= max(len(a), len(b)) // lines.EDIT_SHARE:
                linked += a != b
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return {i for i, x in enumerate(label) if i != x}, linked


def test_edited_lines(spark):
    made = random.Random(5)
    def word():
        return "".join(made.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(made.randrange(2, 6)))
    texts = []
    for n in [1, 2, 3, 5, 8, 12, 30, 60, 90, 120, 200, 300] * 3:
        words = [word() for _ in range(n)]
        for changed in range(4):
            other = list(words)
            for at in made.sample(range(n), min(n, changed)):
                other[at] = word()
            texts.append(" ".join(other))
        texts.append(" ".join(made.sample(words, n)))       # the same words in another order
    gone, linked = _gone(texts)
    assert linked > 20
    df = ready(spark).createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc for r in lines.repeated_lines(df).collect()} == gone


def test_lines_of_one_document_many_times(spark):
    text = "\n".join(["Again and again.", "once " * 30, "", "--", "x"] * 300)
    df = ready(spark).createDataFrame([(1, text), (2, "x\nAGAIN, and again!\nnew")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in lines.dedup_lines(df).collect()}
    assert got[1].n_removed == 3 * 299 and got[1].text.split("\n")[:5] == text.split("\n")[:5] and got[1].n_lines == 1500
    assert got[2].text == "new" and got[2].n_removed == 2


def test_registered_query(spark, sf):
    import hashlib

    want = {r.doc_id: r for r in lines.dedup_lines(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")).collect()}
    got = queries.op9_line_dedup(spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r.doc_id]
        assert (r.n_lines, r.n_removed, r.text_sha256) == (w.n_lines, w.n_removed, hashlib.sha256((w.text or "").encode()).hexdigest())


def test_near_copies_that_are_not_alike(spark, monkeypatch):
    """Lines of nearly equal hash that too many edits part: all links are found, and no pair that is not a link becomes a row."""
    made = random.Random(11)
    words = ["".join(made.choice("abcdefgh") for _ in range(4)) for _ in range(40)]
    texts = []
    for n in range(22):
        other = list(words)
        for at in made.sample(range(40), n % 5):
            other[at] = "".join(made.choice("abcdefgh") for _ in range(4))
        texts.append(" ".join(other))
    made.shuffle(texts)
    gone, linked = _gone(texts)
    tables = []
    real = lines.written

    def noted(df, name):
        out = real(df, name)
        tables.append((name, out.count() if out.columns == ["a", "b"] else None))
        return out

    monkeypatch.setattr(lines, "written", noted)
    monkeypatch.setattr(lines, "SHARE_LINES", 3, raising=False)
    df = ready(spark).createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc for r in lines.repeated_lines(df).collect()} == gone
    names = [name for name, _ in tables]
    assert "line-pairs" not in names[names.index("open-lines"):]
    assert all(n is None or n <= linked for _, n in tables[names.index("open-lines"):])
