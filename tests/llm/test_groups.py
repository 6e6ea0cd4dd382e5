"""Sharding, near-duplicates, repeated strings, lines, URLs, archives and the pipeline against plain Python."""

import hashlib
import random
from collections import Counter

import pytest

from chunkloom.llm import lines, minhash, repeats, shards, urls, warc
from chunkloom.llm.common import ready
from chunkloom.llm.graph import components


def _frame(spark, rows, extra="component_id"):
    return ready(spark).createDataFrame([(*r, "z") for r in rows], f"doc_id bigint, text string, {extra} string")


def _components(nodes, links):
    label = {n: n for n in nodes}
    while True:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
        if not moved:
            return label


def test_components(spark):
    made = random.Random(1)
    links = [(made.randrange(80), made.randrange(80)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: c for n, c in _components(nodes, [x for x in links if x[0] != x[1]]).items()}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_shards(spark):
    rows = [(i, "x" * (i % 50)) for i in range(400)] + [(None, "n" * 40), (7, None), (8, "y" * 3000), (9, "same" * 50), (9, "same" * 50)]
    df = _frame(spark, rows, "shard")
    placed = shards.assign_shards(df, ["doc_id"], 500).collect()
    assert len(placed) == len(rows)
    sums = Counter()
    for r in placed:
        sums[r.shard] += r.n_bytes
    assert all(r.shard_bytes == sums[r.shard] and r.shard_depth == len(r.shard) for r in placed)
    assert all(r.oversized == (sums[r.shard] > 500) for r in placed) and sum(r.n_bytes for r in placed) == sum(len(t or "") for _, t in rows)
    assert {r.doc_id for r in placed if r.oversized} == {8}
    # No two sibling shards would fit together.
    for r in placed:
        inside = sum(n for s, n in sums.items() if s.startswith(r.shard[:-1]))
        assert not r.shard or inside > 500
    # One key with all rows is split by the second word.
    hot = shards.assign_shards(df.selectExpr("1L AS doc_id", "text", "doc_id AS other"), ["doc_id"], 500)
    assert hot.where("oversized AND n_bytes < 500").count() <= 2 and hot.select("shard").distinct().count() > 10
    assert shards.assign_shards(df.limit(0), ["doc_id"], 500).count() == 0


def _near_rows(made, size):
    base = [[f"w{made.randrange(300)}" for _ in range(60)] for _ in range(12)]
    rows = []
    for i in range(160):
        words = list(made.choice(base))
        for _ in range(made.randrange(5)):
            words[made.randrange(len(words))] = f"v{made.randrange(9)}"
        rows.append((i, " ".join(words)))
    return rows + [(500, None), (501, ""), (502, "one"), (503, "ONE"), (504, " \t\n"), (505, rows[0][1].upper()), (None, rows[0][1]), (3, rows[3][1])]


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, percent, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 20)
    rows = _near_rows(random.Random(size), size)
    sets = {}
    for doc, text in rows:
        words = (text or "").lower().split()
        if doc is not None:
            sets[doc] = {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    label = _components(ids, links)
    got = minhash.near_duplicates(_frame(spark, rows), size=size, percent=percent).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == {d: (len(sets[d]), label[d], label[d] == d) for d in ids}
    assert [(r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None] == [(0, None, True)]
    assert minhash.near_duplicates(_frame(spark, rows).limit(0)).count() == 0


def test_pruning_bounds():
    assert minhash.band_rows(0.85) == 4 or (1 - 0.85 ** minhash.band_rows(0.85)) ** (150 // minhash.band_rows(0.85)) <= minhash.BAND_MISS
    assert list(minhash.least_matches(0.85)) == sorted(minhash.least_matches(0.85)) and minhash.least_matches(0.85)[-1] < 0.85 * 150


def test_repeated_strings(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 900)
    monkeypatch.setattr(repeats, "CONTEXTS_PER_INDEX", 15)
    made = random.Random(4)
    passage = ["".join(made.choice("abé \n") for _ in range(made.randrange(40, 130))) for _ in range(8)] + ["a" * 120, "ab" * 70]
    rows = []
    for i in made.sample(range(200), 60):
        rows.append((i, "".join(made.choice([*passage, "".join(made.choice("cdefgh") for _ in range(30))]) for _ in range(made.randrange(7)))))
    rows += [(300, None), (301, ""), (302, "x" * 49), (303, "x" * 49), (304, rows[0][1]), (None, rows[0][1]), (305, "x" * 50), (306, "x" * 51), (305, "x" * 50)]
    first = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for doc, data in texts:
        for p in range(len(data) - 49):
            if doc is not None:
                first[data[p:p + 50]] = min(doc, first.get(data[p:p + 50], doc))
    wanted = Counter()
    for doc, data in texts:
        gone = [False] * len(data)
        for p in range(len(data) - 49):
            if doc is not None and first[data[p:p + 50]] < doc:
                gone[p:p + 50] = [True] * 50
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        wanted[doc, len(data), sum(gone), spans, bytes(c for c, g in zip(data, gone) if not g)] += 1
    got = repeats.remove_repeats(_frame(spark, rows, "kept")).collect()
    assert Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in got) == wanted
    assert repeats.remove_repeats(_frame(spark, rows).limit(0)).count() == 0


def _simhash(words):
    import xxhash

    hashes = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words]
    return sum(1 << b for b in range(64) if sum(v >> b & 1 for v in hashes) > len(hashes) // 2)


def _lines_by_hand(rows):
    import re

    def words(line):
        return [w for w in re.split(lines._BETWEEN, line.lower()) if w]
    seen, where = {}, {}
    for doc, text in rows:
        for n, line in enumerate(text.split("\n")) if doc is not None and text is not None else ():
            norm = " ".join(words(line))
            if norm:
                where.setdefault(norm, set()).add((doc, n))
                seen[norm] = _simhash(list(dict.fromkeys(words(line))))
    norms = sorted(seen)
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, p in enumerate(a):
            new = [i + 1]
            for j, c in enumerate(b):
                new.append(min(row[j] + (p != c), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]
    links = [
        (a, b) for a in norms for b in norms if a < b
        and bin(seen[a] ^ seen[b]).count("1") <= lines.MAX_BITS and edits(a, b) <= max(len(a), len(b)) // lines.EDIT_SHARE
    ]
    label = _components(norms, links)
    kept = {}
    for norm in norms:
        kept[label[norm]] = min([kept.get(label[norm], min(where[norm])), *where[norm]])
    out = []
    for doc, text in rows:
        if doc is None or text is None:
            out.append((doc, text, len(text.split("\n")) if text is not None else 0, 0))
            continue
        parts = text.split("\n")
        left = [p for n, p in enumerate(parts) if (norm := " ".join(words(p))) not in label or kept[label[norm]] == (doc, n)]
        out.append((doc, "\n".join(left), len(parts), len(parts) - len(left)))
    return out, links


def test_lines(spark):
    made = random.Random(8)
    base = [[f"w{made.randrange(40)}" for _ in range(made.choice([3, 6, 40, 90]))] for _ in range(14)]
    rows = []
    for i in range(40):
        text = []
        for _ in range(made.randrange(1, 6)):
            words = list(made.choice(base))
            for _ in range(made.randrange(2)):
                words[made.randrange(len(words))] = f"v{made.randrange(5)}"
            text.append(made.choice([" ", ", ", "  "]).join(words).capitalize() + made.choice(["", ".", "!"]))
        rows.append((i, "\n".join(text)))
    rows += [(90, None), (91, ""), (92, "short\nshort\n\n"), (None, rows[0][1]), (93, rows[1][1]), (94, "é" * 50_000 + "\n" + "é" * 50_000)]
    rows.append(rows[-2])
    wanted, links = _lines_by_hand(rows)
    got = lines.dedup_lines(_frame(spark, rows, "n_removed")).collect()
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got) == Counter(wanted) and links
    assert lines.dedup_lines(_frame(spark, rows).limit(0)).count() == 0


def test_urls(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("com", "/de/", "block")]
    made = random.Random(2)
    rows = [(i, made.choice(["http://", "x://a://"]) + made.choice(["a.Example.org", "example.org", "org", "notorg", "b.com", "", "a..org"])
             + made.choice(["", "/", "/es/x", "/en/12", "/en/2", "/fr/", "/de/a?/fr/", "?q=/", "#/fr/", "/FR/"])) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "example.org/es/"), (903, rows[0][1]), (903, rows[0][1]), (None, rows[1][1])]
    df = ready(spark).createDataFrame([(*r, "z") for r in rows], "page_id bigint, url string, rule string")
    wanted = Counter()
    for page, url in rows:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        wanted[page, host, path, best and best[3], best[4] if best else "allow"] += 1
    got = urls.filter_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == wanted
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert urls.filter_urls(df, none).where("verdict = 'allow'").count() == len(rows) and urls.filter_urls(df.limit(0), none).count() == 0


def test_archives(spark):
    long = "payload " * 20
    rows = [(5, "http://b.org/x", long), (2, "http://a.org/\r\nx", long), (9, None, "\r\n\r\nWARC/1.1\r\n"), (1, "http://b.org/x", None), (3, "", "é" * 90_000),
            (None, "http://c.org", long), (4, "http://b.org/x", "\r\n\r\nWARC/1.1\r\n"), (2, "http://a.org/\r\nx", long)]
    df = ready(spark).createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, offset int")
    got = warc.capture_history(df.repartition(3)).collect()
    digest = hashlib.sha256(long.encode()).hexdigest()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == Counter([
        (5, "revisit", 2), (2, "response", None), (2, "response", None), (None, "revisit", 2), (9, "response", None), (1, "response", None), (3, "response", None), (4, "response", None)])
    assert {r.payload_digest for r in got if r.page_id in (2, 5)} == {digest} and [r.payload_bytes for r in got if r.page_id == 3] == [180_000]
    order = [(r.url_key, r.timestamp) for r in sorted(got, key=lambda r: (r.range_no, r.position))]
    assert order == sorted(order)
    assert warc.capture_history(df.limit(0)).count() == 0


def test_loser_tree():
    made = random.Random(6)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((("r", made.choice("abc"), str(made.randrange(5)), made.choice([None, 1, 2]), "", "", 0, None, "f", n, 0) for n in range(made.randrange(9))), key=warc._order) for _ in range(k)]
        merged = list(warc.LoserTree(runs))
        assert [warc._order(c) for c in merged] == sorted(warc._order(c) for r in runs for c in r)


def test_histories_in_many_ranges(spark, sf, monkeypatch):
    monkeypatch.setattr(warc, "CAPTURES_PER_RANGE", 20)
    pages = ready(spark).read.parquet(f"{sf}/pages.parquet")
    got = sorted(warc.capture_history(pages).collect(), key=lambda r: (r.range_no, r.position))
    order = [(r.url_key, r.timestamp, r.page_id) for r in got]
    assert len(order) == pages.count() and order == sorted(order) and len({r.range_no for r in got}) > 1


def test_pipeline(spark, sf):
    import corpus_pipeline as pipeline
    from chunkloom.llm import decontaminate, pieces, quality

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    kept = [(d, t) for d, t in docs if not quality.base_failed((m := quality.measure(t))[1]) and not any(r.rejects(*m) for r in quality.RULES)]
    small = [(d, t) for d, t in kept if len(t) < 4000][:60]
    frame = spark.read.parquet(f"{sf}/documents.parquet").where(f"doc_id IN ({','.join(str(d) for d, _ in small)})")
    stage = dict(pipeline.STAGES)
    assert {r.doc_id for r in stage["quality_rules"](spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()} == {d for d, _ in kept}
    lined = {(r.doc_id, r.text, r.n_chars) for r in stage["line_dedup"](spark, frame, sf).collect()}
    assert lined == {(d, t, len(t)) for d, t, _, gone in _lines_by_hand(small)[0] if not gone or t.split()}
    bench = [(r.item_id, decontaminate.normalised(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in stage["decontamination"](spark, spark.createDataFrame(docs, "doc_id bigint, text string"), sf).collect()}
    exact = {d for d, t in docs if any(i in decontaminate.normalised(t) for _, i in bench)}
    assert exact and not clean & exact
    rows = pipeline.run(spark, sf).collect()
    assert rows and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows) and {r.doc_id for r in rows} <= {d for d, _ in kept}


def test_archives_take_less_room_than_their_records(spark, sf, tmp_path):
    pages = ready(spark).read.parquet(f"{sf}/pages.parquet")
    warc.write_archives(pages, str(tmp_path / "archives"))
    runs = warc.read_runs(spark, str(tmp_path / "archives")).collect()
    assert len(runs) == pages.count()
    assert sum(f.stat().st_size for f in (tmp_path / "archives").iterdir()) < sum(r.length for r in runs) / 2
