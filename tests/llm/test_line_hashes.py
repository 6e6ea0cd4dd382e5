"""SimHash of lines against a plain count of bits, also where a line has more words than one packed counter holds."""

import pytest
import xxhash

from chunkloom.llm import lines


def plain_simhash(words):
    hashes = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in set(words)]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return bits - (1 << 64) if bits >> 63 else bits


def test_simhash_of_short_and_long_lines(spark):
    sizes = [1, 2, 4, 5, 6, 126, 127, 128, 254, 255, 1000, 40_000]
    texts = {n: [f"w{n}x{i}" for i in range(n)] for n in sizes}
    df = spark.createDataFrame([(n, " ".join(words)) for n, words in texts.items()], "doc_id bigint, text string")
    found = {r.doc: r.simhash for r in lines.occurrences(df).collect()}
    assert found == {n: plain_simhash(words) for n, words in texts.items()}


@pytest.mark.parametrize("sign", ["-", "¿", " ", "\x00", "×"])
def test_signs_part_words(spark, sign):
    df = spark.createDataFrame([(f"Uno{sign}dos{sign}{sign}tres3 ªµ",)], "text string")
    assert df.select(lines.line_words(df["text"]).alias("w")).first().w == ["uno", "dos", "tres3", "ªµ"]
