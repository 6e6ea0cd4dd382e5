"""Phrases, byte-level BPE and fill-in-middle against plain Python and the tokenizers library."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chunkloom.llm import bytepairs, infill, phrases, queries

TEXTS = [
    "The cat sat. the cat sat, THE CAT sat on a mat", None, "", " \t ", "...", "cat", "de la mer de la mer\x0bde la mer\x0cx",
    "the the the the the the the the", "é漢🤦 the cat sat é漢🤦", "the cat sat on a mat " * 40,
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, rank string, n string")


def brute_phrases(rows, least, most, top):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, total = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(most, len(words) - i) + 1):
                    counts[lang, tuple(words[i:i + k])] += 1
    good = {p: f for p, f in counts.items() if f >= least and len(p[1]) > 1}
    out = {}
    for (lang, p), a in good.items():
        if any(f >= a and len(q) > len(p) and g == lang and any(q[i:i + len(p)] == p for i in range(len(q))) for (g, q), f in good.items()):
            continue
        cuts = []
        for k in range(1, len(p)):
            l, r = counts[lang, p[:k]], counts[lang, p[k:]]
            cuts.append((1000 * a * total[lang] // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted(
        (lang, rank, p.decode(), -a, l, r, total[lang], -score)
        for lang, some in out.items() for rank, (score, a, p, l, r) in enumerate(sorted(some)[:top], 1)
    )


@pytest.mark.parametrize("entries", [50, 600_000])
def test_phrases_against_plain_counting(spark, entries, monkeypatch):
    monkeypatch.setattr(phrases, "BURST", 8)
    langs = ["en", None, "fr"]
    rows = [(i, t, langs[i % 3], "a", "b") for i, t in enumerate(TEXTS * 4)]
    rng = random.Random(3)
    rows += [(100 + i, " ".join(rng.choices("a b c d e f. g,".split(), k=rng.randint(0, 60))), rng.choice(langs), None, None) for i in range(60)]
    found = phrases.collocations(frame(spark, rows).repartition(3), least=4, top=30, cells=1 << 16, entries=entries)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == brute_phrases(rows, 4, 5, 30)


def test_phrases_counts_beyond_a_byte_and_64_bits(spark):
    rows = [(i, "x y " * 50, None, None, None) for i in range(20)]
    found = phrases.collocations(frame(spark, rows), least=300, top=5, cells=1 << 16)
    assert sorted(map(tuple, found.collect())) == brute_phrases(rows, 300, 5, 5)
    big = spark.createDataFrame(
        [("en", "", 1, 4 * 10 ** 15), ("en", "a", 1, 3 * 10 ** 15), ("en", "b", 1, 10 ** 15 + 7), ("en", "a b", 2, 10 ** 15)],
        "lang string, phrase string, k int, f bigint",
    )
    row = phrases.score_cuts(big).first()
    assert row["score"] == 1000 * 10 ** 15 * 4 * 10 ** 15 // (3 * 10 ** 15 * (10 ** 15 + 7))


def test_phrases_of_empty_tables(spark):
    assert phrases.collocations(frame(spark, [])).count() == 0
    assert phrases.collocations(frame(spark, [(1, None, None, None, None), (2, " . ", "en", None, None)])).count() == 0


def test_trie_bursts_and_gives_back_what_it_was_given():
    rng, trie, plain = random.Random(5), phrases.Trie(burst=4), Counter()
    for _ in range(3000):
        p = b"".join(rng.randrange(1, 9).to_bytes(4, "little") for _ in range(rng.randint(1, 5)))
        n = rng.randint(1, 3)
        trie.add(p, n)
        plain[p] += n
    assert any(isinstance(node[1], phrases.Level) for node in trie.top.values())
    first = trie.largest(trie.entries // 2)
    assert 0 < len(first) < len(trie.top)
    back = [x for word in list(trie.top) for x in trie.cut_off(word)]
    assert dict(back) == dict(plain) and len(back) == len(plain) and trie.entries == 0


ALPHABET = ["a", "b", " ", "\n", "'s", "é", "漢", "🤦", "́", "1", "²", "!", "  ", "<|endoftext|>", "՘", "\U000107bb", "\x1f", "\x85", "\xa0", "ﬁ", "Ⅷ"]


def odd_texts():
    rng = random.Random(9)
    return [None, "", "<|endoftext|>", "a <|endoftext|><|endoftext|>  b\n\n ", "a" * 5000, "é" * 300 + " " * 40, " 　 x", "ab" * 3000] + [
        "".join(rng.choices(ALPHABET, k=rng.randint(1, 60))) for _ in range(300)
    ] + ["x y"] * 3


def test_byte_bpe_against_the_library(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = odd_texts() + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r for r in bytepairs.encode(rows, path, decoded="decoded").collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids
        assert got[i]["decoded"] == library.decode(ids, skip_special_tokens=False)
    cut = spark.createDataFrame([(1, library.encode("é").ids[:1] + [220, 64000 % 50257]), (2, None)], "k int, ids array<int>")
    back = {r["k"]: r["decoded"] for r in bytepairs.decode(cut, path).collect()}
    assert back == {1: library.decode(cut.first()["ids"], skip_special_tokens=False), 2: ""}
    assert bytepairs.encode(rows.limit(0), path).count() == 0


def test_byte_bpe_long_words_merge_as_short_ones():
    import public_tokenizers

    model, rng = bytepairs.vocabulary(public_tokenizers.path("byte_bpe_50k.json")), random.Random(2)
    for _ in range(300):
        word = bytes(rng.choices(b"abcdetion \xc3\xa9", k=rng.randint(1, 200)))
        assert model._merge_short(word) == model._merge_long(word)


def test_byte_bpe_query(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op12_byte_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def brute_infill(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(text)
    a, z = sorted(x % (n + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return text, "plain", n, None, None
    prefix, middle, suffix = text[:a], text[a:z], text[z:]
    if h[3] % 100 < 20:
        return f"<S>{suffix}<P>{prefix}<M>{middle}", "spm", n, a, z - a
    return f"<P>{prefix}<S>{suffix}<M>{middle}", "psm", n, a, z - a


def test_fill_in_middle_against_plain_python(spark):
    rng = random.Random(4)
    signs = ["a", "é", "漢", "🤦", "<", ">", "P", "S>", "<M", " ", "\n"]
    texts = [None, "", "x", "<P>", "a<S>b", "<M", "é<M>", "🤦" * 3, "z" * 200_000] + ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(400)]
    rows = [(i % 380 if i else None, t, "extra") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, form string").repartition(2)
    made = infill.transform(df, restored="restored").select("doc_id", "text", "output", "form", "n", "prefix_chars", "middle_chars", "restored").collect()
    key = lambda x: (str(x[0]), x[1] or "", str(x))
    expected = [(i, t, *brute_infill(i, t), t or "") for i, t, _ in rows]
    assert sorted(map(tuple, made), key=key) == sorted(expected, key=key)
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}
    back = infill.restore(infill.transform(df).select("doc_id", "text", "output", "form")).where(F.col("restored") != F.coalesce("text", F.lit("")))
    assert back.count() == 0
    assert infill.transform(df.limit(0)).count() == 0


def test_fill_in_middle_refuses_marks_that_overlap():
    for marks in (("<P>", "<P>", "<M>"), ("aba", "x", "y"), ("ab", "bc", "x"), ("", "a", "b"), ("abc", "b", "x")):
        with pytest.raises(ValueError):
            infill._checked(marks)


def test_fill_in_middle_needs_its_marks(spark):
    broken = spark.createDataFrame([("<P>a<S>b", "psm")], "output string, form string")
    with pytest.raises(Exception, match="lacks a mark"):
        infill.restore(broken).collect()
