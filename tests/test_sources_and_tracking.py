"""Files, ignore rules, stores, change tracking, streams on small trees."""

import fnmatch
import itertools

import pytest
from pyspark.sql import functions as F

from chunkloom.functions.globs import matches_rule
from chunkloom.functions.paths import dotted_ext
from chunkloom.operators import ignore, tracking
from chunkloom.plans.build import build_chunks, full_build, incremental_build
from chunkloom.profiles import PROFILES, UNKNOWN, profile_for
from chunkloom.sources import files as fs, logs, stores
from chunkloom.streaming import ingest, monitor

PY = PROFILES["python"]


def body(name: str, fill: str = ".") -> str:
    return f"def {name}():\n" + fill * 120


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "project"
    for path, content in {
        "requirements.txt": b"x", "pkg/__init__.py": b"def a():\n" + b"." * 120, "pkg/m.py": b"ok \xff\xfe\r\nend",
        "pkg/.gitignore": b"# c\n\n  gen*\n/top.py\n", "pkg/gen1.py": b"x", "pkg/top.py": b"x", "pkg/sub/top.py": b"x",
        "venv/v.py": b"x", "build/deep/b.py": b"x", "pkg/_private/p.py": b"x", "chunkloom-out_x/o.py": b"x",
        ".gitignore": b"build\n",
    }.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content)
    return root


def test_scan_reads_hidden_names_and_lossy_text(spark, tree):
    got = fs.read_text_lossy(fs.scan_files(spark, f"file://{tree}", (".py",), "p")).collect()
    by_path = {r.path: r for r in got}
    assert {"pkg/__init__.py", "pkg/_private/p.py", "venv/v.py"} <= set(by_path)
    assert by_path["pkg/m.py"].content == "ok \nend" and by_path["pkg/m.py"].error is None


def test_scan_holds_the_bytes_of_one_file_once(tmp_path):
    import pyarrow as pa

    sizes = {"a.bin": 48 << 20, "b.bin": 48 << 20, "empty.bin": 0, "longer.bin": 3 << 20}
    for name, size in sizes.items():
        (tmp_path / name).write_bytes(name.encode()[:1] * size)
    listed = {**sizes, "longer.bin": 1, "gone.bin": 5}      # one grew after it was listed, one went
    listing = pa.RecordBatch.from_arrays(
        [pa.array(list(listed)), pa.array(list(listed.values()), pa.int64()), pa.nulls(len(listed), pa.timestamp("us", "UTC"))], ["path", "size", "mtime"])
    before, held, got = pa.total_allocated_bytes(), [], {}
    for row in fs._read_bytes(f"file://{tmp_path}")(iter([listing])):
        held.append(pa.total_allocated_bytes() - before)
        got[row["path"][0].as_py()] = (None if row["raw"].null_count else row["raw"][0].as_buffer().size, row["error"][0].as_py() is None)
        del row
    assert got == {**{n: (size, True) for n, size in sizes.items()}, "gone.bin": (None, False)}
    assert held[0] < 50 << 20 and max(held) < 50 << 20


def test_scan_takes_the_digest_of_a_file_in_pieces(spark, tmp_path):
    import hashlib

    import pyarrow as pa

    from chunkloom.plans.queries_sources import scan_files

    contents = {"a.parquet": b"a" * (24 << 20) + b"z", "empty.parquet": b"", "sub/_b.parquet": b"\xff\x00b"}
    for name, content in contents.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    found = scan_files(spark, f"file://{tmp_path}")
    assert {r.path: (r.size, r.sha256, r.error) for r in found.collect()} == {
        n: (len(x), hashlib.sha256(x).hexdigest(), None) for n, x in contents.items()}
    assert "raw#" not in found._jdf.queryExecution().analyzed().treeString()        # no row holds a whole file
    listed = ["a.parquet", "gone.parquet"]
    listing = pa.RecordBatch.from_arrays([pa.array(listed), pa.array([1, 5], pa.int64()), pa.nulls(2, pa.timestamp("us", "UTC"))], ["path", "size", "mtime"])
    rows = [r.to_pylist()[0] for r in fs._read_digests(f"file://{tmp_path}")(iter([listing]))]
    assert rows[0]["sha256"] == hashlib.sha256(contents["a.parquet"]).hexdigest() and rows[0]["error"] is None
    assert rows[1]["sha256"] is None and rows[1]["error"] is not None


def test_ignore_filter(spark, tree):
    listing = fs.list_tree(spark, f"file://{tree}").select("path")
    texts = fs.read_text_lossy(fs.scan_files(spark, f"file://{tree}", (".gitignore",))).select(
        F.regexp_replace("path", "/?[.]gitignore$", "").alias("dir"), "content")
    kept = {r.path for r in ignore.ignore_filter(listing.filter("path like '%.py'"), texts, PY).collect()}
    assert kept == {"pkg/__init__.py", "pkg/m.py", "pkg/sub/top.py", "pkg/_private/p.py"}
    projects = listing.select(F.lit("p").alias("project"), "path")
    assert ignore.detect_project_type(projects).first().project_type == "python"


def reference_match(path: str, rule: str) -> bool:
    """Plain reading of the five rule shapes."""
    below = lambda folder: path == folder or path.startswith(folder + "/")
    if not rule:
        return False
    if rule[0] == "/":
        return below(rule[1:])
    if rule[-1] == "/":
        return below(rule[:-1])
    if rule[:3] == "**/":
        tail = rule[3:]
        return (path.endswith(tail) or f"/{tail}/" in path or path.startswith(tail + "/")
                or any(fnmatch.fnmatchcase(p, tail) for p in path.split("/")))
    if "**" in rule:
        sides = rule.split("**")
        return len(sides) == 2 and path.startswith(sides[0]) and path.endswith(sides[1])
    return fnmatch.fnmatchcase(path, rule) or fnmatch.fnmatchcase(path.split("/")[-1], rule)


def test_rule_shapes(spark):
    rules = ["/a", "/a/b", "a/", "b/", "**/b", "**/*.py", "a/**.py", "a**b**c", "*.py", "a/*", "?.py", "[ab].py", "[!a].py",
             "a+b.(c)", "[", "a[", "x.y", "", "b"]
    names = ["a", "b", "a.py", "b.py", "c", "a+b.(c)", "[", "x.y", "xzy"]
    paths = names + ["/".join(p) for p in itertools.product(["a", "b", "src"], names)] + ["a/b/c.py", "src/b/a/x.y"]
    pairs = [(p, r) for p in paths for r in rules]
    df = spark.createDataFrame(pairs, "path string, rule string")
    got = df.select("path", "rule", matches_rule(F.col("path"), F.col("rule")).alias("hit")).collect()
    assert [(r.path, r.rule) for r in got if r.hit != reference_match(r.path, r.rule)] == []


def test_profiles():
    assert profile_for("nothing known").name == "android" and profile_for("unknown") is UNKNOWN
    assert list(PROFILES) == ["android", "ios", "java", "javascript", "python", "web"]


def test_dotted_ext(spark):
    df = spark.createDataFrame([("a/b.Tar.GZ",), (".gitignore",), ("x",), ("a.b/c",), ("..x.y",)], "p string")
    assert [r.e for r in df.select(dotted_ext(F.col("p")).alias("e")).collect()] == [".gz", "", "", "", ".y"]


def test_logs(spark, tmp_path):
    (tmp_path / "s.log").write_text("[INFO] 2026-01-02 03:04:05,678 app.py:12 built: ok\nbroken line\n")
    row = logs.read_logs(spark, str(tmp_path)).first()
    assert (row.level, row.file, row.line, row.message, row.log_file) == ("INFO", "app.py", 12, "built: ok", "s.log")


def snapshot(spark, files):
    df = spark.createDataFrame(list(files.items()), "path string, content string")
    return df, df.select("path", F.sha2("content", 256).alias("content_hash"))


def rows(df):
    return sorted((r.path, r.chunk_index, r.fingerprint) for r in df.collect())


def test_incremental_equals_full(spark, tmp_path):
    before = {f"m{i}.py": body(f"f{i}") for i in range(12)}
    after = {**before, "m1.py": body("changed"), "new.py": body("new")}
    for gone in ("m2.py", "m3.py"):
        del after[gone]
    old_files, old = snapshot(spark, before)
    new_files, new = snapshot(spark, after)
    store = str(tmp_path / "store")
    full_build(old_files, PY, store, str(tmp_path / "tracking"))
    incremental_build(spark, store, new_files, new, old, PY)
    assert rows(stores.load_chunks(spark, store)) == rows(build_chunks(new_files, PY))
    assert stores.load_tracking(spark, str(tmp_path / "tracking")).count() == 12
    full_build(new_files, PY, store)                      # a full build replaces everything
    assert rows(stores.load_chunks(spark, store)) == rows(build_chunks(new_files, PY))


def test_changes_and_decision(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, content_hash string")
    feed = {r.path: r.change for r in tracking.change_feed(new, old).collect()}
    assert feed == {"a": "same", "b": "modified", "c": "deleted", "d": "added"}
    changed = tracking.changed_by_hash(new, old)
    none = changed.limit(0)
    decide = lambda s, t, c, **k: tracking.rebuild_decision(s, t, c, **k).first().reason
    assert decide(none, old, changed) == "no_database" and decide(old, none, changed) == "no_tracking"
    assert decide(old, old, changed) == "files_changed" and decide(old, old, none) == "no_changes"
    assert decide(old, old, none, force=True) == "forced"
    blobs = [d.withColumnRenamed("content_hash", "blob_sha") for d in (new, old)]
    edited = spark.createDataFrame([("a",), ("b",)], "path string")
    commit = lambda *c: sorted(r.path for r in tracking.changed_by_commit(*blobs, edited, *c).collect())
    assert commit("c2", None) == ["a", "b", "d"] and commit("c1", "c1") == ["a", "b"] and commit("c2", "c1") == ["a", "b", "d"]


def test_stream_merge_equals_batch(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    for i in range(5):
        (root / f"m{i}.py").write_text(body(f"f{i}"))
    store, track = str(tmp_path / "store"), str(tmp_path / "tracking")

    def run():
        stream = ingest.stream_files(spark, str(root), PY, files_per_batch=2)
        ingest.stream_merge(stream, store, track, PY, str(tmp_path / "ck")).awaitTermination()

    run()
    (root / "n.py").write_text(body("later"))
    run()
    batch = fs.read_text_lossy(fs.scan_files(spark, f"file://{root}", (".py",))).select("path", "content")
    assert rows(stores.load_chunks(spark, store)) == rows(build_chunks(batch, PY, dedupe=False))
    assert stores.load_tracking(spark, track).count() == 6


def test_tail_stream(spark, tmp_path):
    source, out = tmp_path / "lines", []
    df = spark.range(50).select((F.col("id") % 2).cast("string").alias("session"), F.col("id").alias("seq"),
                                F.concat(F.lit("l"), "id").alias("line"))
    df.write.parquet(str(source))
    stream = spark.readStream.schema(df.schema).parquet(str(source))
    q = monitor.tail_stream(stream, 3).writeStream.outputMode("update").foreachBatch(
        lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.session, r.entry) for r in out) == sorted(
        (r.session, r.entry) for r in monitor.log_tail(df, 3).collect())


def test_reports_on_disk(spark, tmp_path):
    results = spark.createDataFrame([("t", "success")], "test_name string, status string")
    summary = spark.createDataFrame([(1, ["a", "b"])], "total int, advice array<string>")
    stores.write_report(results, summary, str(tmp_path))
    assert [r.value for r in spark.read.text(str(tmp_path / "text")).collect()] == ["total: 1", "advice: a; b"]
    stores.write_relationships(spark.createDataFrame([("f", "b"), ("f", "a")], "src string, dep string"), str(tmp_path / "rel"))
    assert spark.read.json(str(tmp_path / "rel")).first().deps == ["a", "b"]
