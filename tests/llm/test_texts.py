"""Quality rules, pieces, chat templates and benchmark items against plain Python."""

import hashlib
import random
import re

import pytest

from chunkloom.llm import chat, decontaminate, pieces, quality
from chunkloom.llm.common import ready

DOCS = "doc_id bigint, text string, kept string, hits string"
ODD = [
    (1, None, "a", "b"), (2, "", None, None), (None, "word " * 60, "x", "y"), (3, "\n\n \t", "c", "d"),
    (4, " ".join(chr(97 + i % 26) + chr(97 + i // 26) + "x" for i in range(80)), "e", "f"), (4, " ".join(chr(97 + i % 26) + chr(97 + i // 26) + "x" for i in range(80)), "e", "f"),
    (5, "same three words " * 40, None, None), (6, "é" * 30_000 + " 🙂 \x1c\x85 end", None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return ready(spark).createDataFrame(ODD, DOCS)


def _counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, odd, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    texts = [r.text for r in docs if len(r.text) < 6000] + [r[1] for r in ODD]
    for text in texts:
        counts = quality.measure(text or "")[1]
        assert tuple(counts[m] for m in quality.MEASURES) == _counts(text)
    rows = quality.judge(odd)
    assert [c for c in rows.columns if c == "kept"] == ["kept"] and rows.schema["kept"].dataType.simpleString() == "boolean"
    got = [(r.doc_id, r.n_words, r.kept, r.hits) for r in rows.collect()]
    assert len(got) == len(ODD) and (1, 0, False, "b") in got and got.count((4, 80, True, "f")) == 2
    assert quality.judge(odd.limit(0)).count() == 0


def test_order_of_rules_changes_no_verdict(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    one = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    two = {r.doc_id: r.kept for r in quality.judge(docs, tuple(reversed(quality.RULES))).collect()}
    assert one == two and any(one.values()) and not all(one.values())
    ranked = quality.ordered(quality.RULES[:3], {"word_length": (1.0, 0.1), "symbols": (0.1, 0.1), "duplicate_lines": (1.0, 0.5)})
    assert [r.name for r in ranked] == ["symbols", "duplicate_lines", "word_length"]


def _model():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_pieces_equal_the_library(spark, odd, sf):
    model = pieces.vocabulary(_model())
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [r[1] or "" for r in ODD]
    texts += ["  a", "▁x", "a\n\n b", "日本語", "word" * 500, " " * 70, "<s> </s> <0x0A>", "a.b, c-d (x) don't²3", "x\r\ny\t\x00"]
    letters = "ab e.,\n▁é🙂²<(1"
    made = random.Random(3)
    texts += ["".join(made.choice(letters) for _ in range(made.randrange(40))) for _ in range(400)]
    for text in texts:
        ids = list(memoryview(model.encode_batch([text])[0]).cast("i"))
        assert ids == model.library.encode(text) and model.decode([*ids, model.end]) == text.replace("▁", " ")
    for _ in range(500):
        ids = [made.choice([made.randrange(32_000), made.randrange(260)]) for _ in range(6)]
        assert model.decode(ids) == model.library.decode(ids)


def test_pieces_of_odd_rows(spark, odd):
    rows = pieces.encode(odd, _model(), decoded="hits").collect()
    assert len(rows) == len(ODD) and all(r.hits == (r.text or "") for r in rows)
    assert [r.ids for r in rows if not r.text] == [[2], [2]]
    again = pieces.decode(pieces.encode(odd.limit(0), _model()), _model())
    assert again.count() == 0


def test_template_language():
    render = chat.compile_template(
        "{% for m in ms -%} {{ loop.index }}{% if m.a == 'q' and not loop.last %}[{{ m['a'] | upper }}]"
        "{% elif m.a in 'wer' %}{% generation %}{{ m.a }}!{% endgeneration %}{% else %}-{% endif %}{% endfor %}{{ missing }}"
    )
    assert render({"ms": [{"a": "q"}, {"a": "e"}, {"a": "z"}]}) == ("1[Q]2e!3-", [(5, 7)])
    folded = chat.fold_body(chat._Parser("a{{ 'b' ~ 'c' }}{% if 1 == 1 %}d{% else %}{{ x }}{% endif %}").body()[0])
    assert folded == (chat.Output(chat.Const("abcd")),)
    for wrong in ("{{ f(x) }}", "{% for x in y %}", "{{ x | exec }}", "{% import os %}", "{{ x.__class__ }}"):
        with pytest.raises((chat.TemplateError, ValueError)):
            chat.compile_template(wrong)


def test_chat_round_trip(spark):
    turns = [
        (1, 2, "assistant", "b\\n <|end|>\n"), (1, 0, "user", "<|turn|>[INST]"), (1, 1, "assistant", "\\l\\\\"), (2, None, None, None),
        (2, 1, "us\ner<", "x"), (2, 1, "us\ner<", "x"), (None, 0, "assistant", ""), (3, 0, "assistant", "é" * 50_000),
    ]
    df = ready(spark).createDataFrame([(*t, "z") for t in turns], "conv_id bigint, turn bigint, role string, text string, formatted string")
    rows = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert [(t.role, t.text) for t in rows[1].turns] == [("user", "<|turn|>[INST]"), ("assistant", "\\l\\\\"), ("assistant", "b\\n <|end|>\n")]
    assert rows[1].loss == "\\l\\\\b\\n <|end|>\n" and rows[2].n_turns == 3 and rows[2].turns[0].role == ""
    assert [(t.role, t.text) for t in rows[2].turns[1:]] == [("us\ner<", "x")] * 2
    assert rows[None].n_turns == 1 and rows[3].loss == "é" * 50_000
    assert chat.format_conversations(df.limit(0)).count() == 0


def _distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        new = [i + 1]
        for j, c in enumerate(text):
            new.append(min(row[j] + (p != c), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_bit_parallel_distance():
    made = random.Random(5)
    for _ in range(300):
        pattern = "".join(made.choice("abc") for _ in range(made.randrange(1, 90)))
        text = "".join(made.choice("abc") for _ in range(made.randrange(0, 60)))
        assert decontaminate.Pattern(pattern).least_distance(text) == _distance(pattern, text)


def test_items_against_brute_force(spark):
    made = random.Random(9)
    items = [(i, "".join(made.choice("abcde fgh") for _ in range(60 + 20 * i))) for i in range(6)] + [(7, None), (8, "short one"), (None, "x" * 50)]
    items.append((9, items[0][1]))
    docs = [(100, None), (101, ""), (None, items[1][1]), (102, "short one " * 9)]
    for n in range(60):
        text = list(made.choice(items[:6])[1])
        for _ in range(made.randrange(0, 9)):
            at = made.randrange(len(text))
            text[at:at + made.randrange(2)] = made.choice(["", "x", "Q"])
        docs.append((n, "  ".join(["head"] * made.randrange(3)) + "".join(text).upper() + " tail" * made.randrange(3)))
    docs.append(docs[-1])
    frame = ready(spark).createDataFrame([(*d, "h") for d in docs], "doc_id bigint, text string, hits string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((str(r.doc_id), r.text or "", [(h.item_id, h.distance) for h in r.hits]) for r in decontaminate.find_items(frame, bench).collect())
    wanted = []
    usable = [(i, decontaminate.normalised(t)) for i, t in items if i is not None and t and len(decontaminate.normalised(t)) >= 20]
    for doc, text in docs:
        plain = decontaminate.normalised(text or "")
        found = [(i, d) for i, t in usable if (d := _distance(t, plain)) <= len(t) // decontaminate.ERROR_SHARE]
        wanted.append((str(doc), text or "", sorted(found)))
    assert got == sorted(wanted) and any(d for _, _, f in wanted for _, d in f)
    in_blocks = decontaminate.find_items(frame, bench, block_bytes=200)
    assert sorted((str(r.doc_id), r.text or "", [(h.item_id, h.distance) for h in r.hits]) for r in in_blocks.collect()) == got
    assert decontaminate.find_items(frame, bench.limit(0)).where("size(hits) > 0").count() == 0


def test_digests_of_queries(spark, sf):
    from chunkloom.llm.queries import QUERIES

    row = {r.doc_id: r for r in QUERIES["op3_sentencepiece"](spark, sf).collect()}
    library = pieces.vocabulary(_model()).library
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r.text, add_eos=True)
        assert row[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
