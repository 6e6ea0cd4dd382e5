"""Cutting: exact boundaries, overlap, fallback splitter, duplicates, properties of a chunk."""

import random
import re

import pytest
from pyspark.sql import functions as F

from chunkloom.operators.chunking import (
    build_stats, cut_files, dedupe_chunks, describe_chunks, isolate_errors, semantic_bodies, split_text,
)
from chunkloom.operators.metadata import enrich_chunks
from chunkloom.options import Options
from chunkloom.plans.build import build_chunks
from chunkloom.profiles import PROFILES

PIECES = {
    "python": ["class A", "def f", "@dec", "async def g", "import x", "from y", "\n", "\n\n", "  ", "(", ":", "é", "𝒳", " word word word"],
    "android": ["public ", "class A", "fun f", "@Foo", "import a.b", "package q", "\n", "\n\n", " private\n", "static ", "int ", "foo", "(", "data ", "é"],
    "javascript": ["export ", "default ", "class A", "const f = ", "(a,\n b)", "=>", "function g", "\n", "import x from 'y'\n", "require('x')", "type T", "async ", "é"],
    "web": ["component ", "export default ", "Foo", "\n", "@media", ".cls", "#id", "const x = ", "x=>", "import a from b", "<div>"],
    "java": ["public ", "static ", "class A", "void foo", "(", "record R", "\n", "import a.b;", "@Ann", "package p", " word word"],
    "ios": ["public ", "class ", "func f", "struct S", "- (void)foo {", "\n", "import UIKit", "@import X", "override "],
}


def brute(content: str, patterns: list[str], minimum: int) -> list[str]:
    starts = sorted({m.start() for p in patterns for m in re.compile(p, re.M).finditer(content)}) + [len(content)]
    spans = [content[a:b].strip() for a, b in zip(starts, starts[1:])]
    return [s for s in spans if len(s) > minimum]


@pytest.mark.parametrize("name", sorted(PIECES))
def test_boundaries_equal_python_regex(spark, name):
    rng = random.Random(name)
    profile = PROFILES[name]
    texts = ["".join(rng.choice(PIECES[name]) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    bodies = semantic_bodies(F.col("content"), profile, Options(min_chunk_chars=20))
    got = {r.id: r.b for r in df.select("id", bodies.alias("b")).collect()}
    assert all(got[i] == brute(t, profile.boundaries, 20) for i, t in enumerate(texts))


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, content string")


def test_length_limit_and_prefix_dropped(spark):
    head, a, b = "x" * 200, "def a" + "." * 95, "def b" + "." * 96
    out = cut_files(files(spark, ("m.py", f"{head}\n{a}\n{b}")), PROFILES["python"]).collect()
    assert [r.body for r in out] == [b]     # 100 characters is too short, 101 is enough


def test_overlap_uses_plain_neighbours(spark):
    parts = [f"def f{i}" + chr(97 + i) * 150 for i in range(3)]
    out = cut_files(files(spark, ("m.py", "\n".join(parts))), PROFILES["python"]).orderBy("chunk_index").collect()
    assert out[0].content == f"{parts[0]}\n\n{parts[1][:100]}..."
    assert out[1].content == f"...{parts[0][-100:]}\n\n{parts[1]}\n\n{parts[2][:100]}..."
    assert [(r.has_prev_context, r.has_next_context) for r in out] == [(False, True), (True, True), (True, False)]


def test_fallback_splitter_runs_without_boundaries(spark):
    text = "plain words without any boundary. " * 60
    out = cut_files(files(spark, ("notes.py", text)), PROFILES["python"]).orderBy("chunk_index").collect()
    assert [r.body for r in out] == split_text(text, 800, 100) and not any(r.is_semantic for r in out)


def test_split_text_properties():
    assert split_text("", 10, 2) == []
    assert split_text("abc def", 10, 2) == ["abc def"]
    assert split_text("a" * 25, 10, 2) == ["a" * 10, "a" * 10, "a" * 9]     # two characters shared
    assert split_text("one two three four", 10, 4) == ["one two", "two three", "four"]
    assert split_text("para one\n\npara two\n\npara three", 12, 0) == ["para one", "para two", "para three"]
    rng = random.Random(5)
    for _ in range(100):
        words = [f"{n}" + "w" * rng.randint(1, 30) + rng.choice(["", ".", "é", "𝒳"]) for n in range(200)]
        text = "".join(w + rng.choice([" ", "\n", "\n\n", ". "]) for w in words)
        pieces = split_text(text, 100, 20)
        assert all(p in text and len(p) <= 100 for p in pieces)
        at = 0
        for piece in pieces:    # nothing between two pieces is lost but white space
            found = text.index(piece)
            assert found <= at or not text[at:found].strip()
            at = max(at, found + len(piece))


def test_types_names_scores(spark):
    source = "import a.b.C\n" + "class LoginScreen {\n" + "  val x = 1 // " + "." * 120 + "\n}\nfun checkAll(a: Int) {\n" + "." * 120
    out = describe_chunks(cut_files(files(spark, ("app/Login.kt", source)), PROFILES["android"]), PROFILES["android"]).orderBy("chunk_index").collect()
    assert [(r.type, r.name, r.chunk_hierarchy, r.semantic_score) for r in out] == [
        ("class", "LoginScreen", "class:LoginScreen", 2.0), ("function", "checkAll", "func:checkAll", 1.5)]
    assert out[0].summary.startswith("[ANDROID] From Login.kt: class LoginScreen {")


def test_metadata_kotlin_and_javascript(spark):
    kotlin = "class LoginScreen {\n TextField(value = userName) setError(\"x\") .isEmpty() " + "." * 120
    imported = "import com.foo.Bar // " + "." * 120
    js = "function go() {\n const a = require('lodash') // " + "." * 120 + "\n <Button onClick> token next\n"
    linked = "import x from 'y' // " + "." * 120
    got = {}
    for profile, path, text in (("android", "Login.kt", f"{imported}\n{kotlin}"), ("javascript", "go.js", f"{linked}\n{js}")):
        p = PROFILES[profile]
        out = enrich_chunks(describe_chunks(cut_files(files(spark, (path, text)), p), p), p)
        got[path] = out.orderBy("chunk_index").collect()
    (ki, k), (ji, j) = got["Login.kt"], got["go.js"]
    assert k.screen_name == "LoginScreen" and k.class_names == ["LoginScreen"] and k.input_fields == ["userName"]
    assert set(k.validation_rules) == {"required_check", "set_error_triggered"} and k.has_semantic_anchors
    assert (ki.type, ki.dependencies, ji.type, ji.dependencies) == ("import", ["com"], "import", ["'y'", "lodash"])
    assert j.dependencies == ["lodash"] and j.function_names == ["a", "go"] and "Button" in j.ui_elements
    assert set(j.business_logic_indicators) >= {"workflow", "authorization"}


def test_unicode_identifiers(spark):
    text = "class Größe:\n" + "." * 120 + "\ndef données():\n" + "." * 120
    out = build_chunks(files(spark, ("m.py", text)), PROFILES["python"]).orderBy("chunk_index").collect()
    assert [r.name for r in out] == ["Größe", "données"] and out[0].class_names == ["Größe"]


def test_dedupe_and_stats(spark):
    body = "def same():\n" + "." * 120
    rows = files(spark, ("b.py", body), ("a.py", body), ("c.py", "def other():\n" + "," * 120), ("empty.py", ""))
    chunks = enrich_chunks(describe_chunks(cut_files(rows, PROFILES["python"]), PROFILES["python"]), PROFILES["python"])
    kept = dedupe_chunks(chunks)
    assert sorted(r.path for r in kept.collect()) == ["a.py", "c.py"]
    stats = build_stats(rows, chunks, F.col("has_semantic_anchors")).first()
    assert (stats.files_processed, stats.chunks_created, stats.duplicates_skipped, stats.anchorless_chunks) == (4, 2, 1, 0)


def test_isolate_errors(spark):
    good, bad = isolate_errors(files(spark, ("a", "x"), ("b", None)))
    assert [r.path for r in good.collect()] == ["a"] and [r.path for r in bad.collect()] == ["b"]
