"""Versioned tables: appends in proportion to the change, atomic commits, compaction under later commits, vacuum."""

import os

import pytest
from pyspark.sql import functions as F

from chunkloom.options import Options
from chunkloom.profiles import PROFILES
from chunkloom.sources import files as fs, stores
from chunkloom.sources.versions import Commit, VersionedTable
from chunkloom.plans.build import build_chunks, full_build, incremental_build, run_build
from chunkloom.streaming import ingest

PY = PROFILES["python"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "project_type string, path string, n int")


def content(df):
    return sorted(map(tuple, df.select("project_type", "path", "n").collect()), key=str)


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def test_replace_merge_and_delete(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.read("a int").count() == 0
    table.replace(frame(spark, [("a", "x", 1), ("a", "x", 2), ("a", "y", 3), ("b", "x", 4)]))
    gone = spark.createDataFrame([("a", "x"), ("a", "z"), ("a", "x")], "project_type string, path string")
    table.merge(frame(spark, [("a", "x", 5), ("a", "z", 6)]), gone)
    assert content(table.read()) == [("a", "x", 5), ("a", "y", 3), ("a", "z", 6), ("b", "x", 4)]
    table.merge(None, gone.where("path = 'z'"))
    assert content(table.read()) == [("a", "x", 5), ("a", "y", 3), ("b", "x", 4)]
    table.replace(frame(spark, [("a", "q", 7)]))
    assert content(table.read()) == [("a", "q", 7), ("b", "x", 4)]
    assert content(table.read().where("project_type = 'b'")) == [("b", "x", 4)]


def test_another_column_and_odd_values(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.replace(frame(spark, [("a=/ %", "x y/é", 1), (None, None, 2)]))
    more = spark.createDataFrame([("c", "x", 3, "new")], "project_type string, path string, n int, extra string")
    table.merge(more, more.select("project_type", "path").limit(0))
    assert sorted((r.n, r.extra) for r in table.read().collect()) == [(1, None), (2, None), (3, "new")]
    table.replace(frame(spark, [("a=/ %", "x y/é", 9)]))
    assert sorted(r.n for r in table.read().collect()) == [2, 3, 9]


def test_a_reader_keeps_its_snapshot_and_half_a_commit_is_not_seen(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.replace(frame(spark, [("a", "x", 1)]))
    before = table.read()
    table._write_rows(frame(spark, [("a", "x", 99)]), "c-failed")              # a writer that died before its commit
    table.replace(frame(spark, [("a", "x", 2)]))
    assert content(before) == [("a", "x", 1)] and content(table.read()) == [("a", "x", 2)]
    assert "rows/c-failed" in table.vacuum(hours=0) and content(table.read()) == [("a", "x", 2)]


def test_two_writers_get_versions_of_their_own(spark, tmp_path):
    one, two = (VersionedTable(spark, str(tmp_path / "t")) for _ in range(2))
    assert one.replace(frame(spark, [("a", "x", 1)])) == 1 and two.merge(frame(spark, [("a", "y", 2)]), None) == 2
    assert one.replace(frame(spark, [("a", "z", 3)]), token="batch 1") == 3
    assert two.replace(frame(spark, [("a", "w", 4)]), token="batch 1") == 3     # done before
    assert content(one.read()) == [("a", "z", 3)]


def test_a_merge_writes_what_changed_only(spark, tmp_path):
    folder = str(tmp_path / "t")
    table = VersionedTable(spark, folder)
    many = spark.range(200_000).select(F.lit("a").alias("project_type"), F.sha2(F.col("id").cast("string"), 256).alias("path"), F.col("id").cast("int").alias("n"))
    table.replace(many)
    full = size(folder)
    few = many.where("n < 20").select("project_type", "path", (F.col("n") + 1_000_000).alias("n"))
    table.merge(few, few.select("project_type", "path"))
    assert size(folder) - full < full / 200
    assert table.read().count() == 200_000 and table.read().where("n >= 1000000").count() == 20


def test_compaction_under_later_commits(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.replace(frame(spark, [("a", f"p{i}", i) for i in range(9)]))
    for i in range(3):
        row = frame(spark, [("a", f"p{i}", 100 + i)])
        table.merge(row, row.select("project_type", "path"))
    want = content(table.read())
    table.compact()
    assert len(table.snapshot().commits) == 1 and content(table.read()) == want
    # A commit made between the reading and the publishing of a compaction stays on top of it.
    seen = table.snapshot()
    row = frame(spark, [("a", "p5", 500)])
    table.merge(row, row.select("project_type", "path"))
    schema = table._write_rows(table.read(snapshot=seen), "c-late")
    table._publish(Commit(0, rows="c-late", schema=schema, as_of=seen.last))
    assert dict((r.path, r.n) for r in table.read().collect())["p5"] == 500 and table.read().count() == 9
    table.vacuum(hours=0)
    assert table.read().count() == 9 and table.compact() > 0 and table.read().count() == 9


def body(name):
    return f"import os\n\n\ndef {name}(x):\n" + "\n".join(f"    x = x + {i}" for i in range(20)) + "\n    return x\n"


def chunk_rows(df):
    return sorted((r.path, r.chunk_index, r.fingerprint) for r in df.collect())


def test_incremental_build_keeps_tracking(spark, tmp_path):
    def state(files):
        df = spark.createDataFrame(list(files.items()), "path string, content string")
        return df, df.select("path", F.sha2("content", 256).alias("content_hash"))
    before = {f"m{i}.py": body(f"f{i}") for i in range(6)}
    after = {k: x for k, x in before.items() if k != "m2.py"} | {"m1.py": body("other"), "new.py": body("new")}
    (old_files, old), (new_files, new) = state(before), state(after)
    store, track = str(tmp_path / "s"), str(tmp_path / "t")
    full_build(old_files, PY, store, track)
    incremental_build(spark, store, new_files, new, stores.load_tracking(spark, track), PY, tracking_table=track)
    assert chunk_rows(stores.load_chunks(spark, store)) == chunk_rows(build_chunks(new_files, PY, dedupe=False))
    told = {r.path: r.content_hash for r in stores.load_tracking(spark, track).collect()}
    assert told == {r.path: r.content_hash for r in new.collect()}
    full_build(old_files, PY, store, track)              # tracking of files that are no more goes
    assert {r.path for r in stores.load_tracking(spark, track).collect()} == set(before)


def test_build_rounds(spark, tmp_path):
    def state(files):
        return spark.createDataFrame(list(files.items()), "path string, content string")
    files = {f"m{i}.py": body(f"f{i}") for i in range(5)}
    store, track, index = (str(tmp_path / n) for n in ("s", "t", "i"))

    def go(files, **more):
        r = run_build(spark, state(files), PY, store, track, index, **more)
        stored = {c.path for c in stores.load_chunks(spark, store).collect()}
        indexed = {c.path for c in stores.load_index(spark, index)["file_level"].collect()}
        assert stored == indexed == {r.path for r in stores.load_tracking(spark, track).collect()} == set(files)
        return r.reason, r.n_files, r.n_deleted

    assert go(files) == ("no_database", None, 0)
    files["m1.py"], files["n.py"] = body("other"), body("new")
    assert go(files) == ("files_changed", 2, 0)
    assert go(files) == ("no_changes", 0, 0)
    del files["m2.py"]
    assert go(files) == ("no_changes", 0, 1)               # nothing to build, but a file to take out
    assert go(files, force=True) == ("forced", None, 0)


def test_tree_rounds_see_hidden_changed_and_deleted_files(spark, tmp_path):
    root = tmp_path / "in"
    (root / "pkg" / "_private").mkdir(parents=True)
    for name in ("pkg/__init__.py", "pkg/.hidden.py", "pkg/_private/a.py", "b.py"):
        (root / name).write_text(body("f" + str(len(name))))
    (root / "skip.bin").write_text("no")
    store, track = str(tmp_path / "s"), str(tmp_path / "t")

    def go(**more):
        return ingest.ingest_tree(spark, f"file://{root}", store, track, PY, **more)

    def same(*names):
        batch = fs.read_text_lossy(fs.scan_files(spark, f"file://{root}", (".py",))).select("path", "content")
        want = build_chunks(batch.where(F.col("path").isin(*names)), PY, dedupe=False)
        assert chunk_rows(stores.load_chunks(spark, store)) == chunk_rows(want)
        assert {r.path for r in stores.load_tracking(spark, track).collect()} == set(names)

    assert go() == {"changed": 4, "deleted": 0}
    same("pkg/__init__.py", "pkg/.hidden.py", "pkg/_private/a.py", "b.py")
    assert go() == {"changed": 0, "deleted": 0}
    (root / "b.py").write_text(body("changed_name"))
    (root / "pkg" / "_private" / "a.py").unlink()
    assert go(compact_after=0) == {"changed": 1, "deleted": 1}
    same("pkg/__init__.py", "pkg/.hidden.py", "b.py")
    # A rule that begins to refuse a file takes it out of the store.
    assert go(keep_file=lambda listing: listing.where("path NOT LIKE '%hidden%'")) == {"changed": 0, "deleted": 1}
    same("pkg/__init__.py", "b.py")
    seen = []
    query = ingest.stream_tree(spark, f"file://{root}", store, track, PY, str(tmp_path / "ck"), every="1 second", on_round=seen.append)
    try:
        for _ in range(600):
            if seen or not query.isActive:
                break
            query.awaitTermination(1)
    finally:
        query.stop()
    assert seen and seen[0] == {"changed": 1, "deleted": 0}
    same("pkg/__init__.py", "pkg/.hidden.py", "b.py")


def test_stream_merge_with_deletes(spark, tmp_path):
    schema = "path string, content string, sha256 string, size bigint, mtime timestamp, deleted boolean"
    source = str(tmp_path / "in")
    at = F.timestamp_seconds
    base = spark.range(8).select(
        F.concat(F.lit("m"), "id", F.lit(".py")).alias("path"), F.lit(body("f")).alias("content"), F.lit("h").alias("sha256"),
        F.lit(5).cast("bigint").alias("size"), at("id").alias("mtime"), F.lit(None).cast("boolean").alias("deleted"))
    store, track = str(tmp_path / "s"), str(tmp_path / "t")

    def go(df):
        df.write.mode("append").parquet(source)
        files = spark.readStream.schema(schema).parquet(source)
        ingest.stream_merge(files, store, track, PY, str(tmp_path / "ck"), Options(), compact_after=1).awaitTermination()
        return {r.path for r in stores.load_chunks(spark, store).collect()}

    assert go(base) == {f"m{i}.py" for i in range(8)}
    assert go(base.where("path = 'm3.py'").withColumn("deleted", F.lit(True))) == {f"m{i}.py" for i in range(8)} - {"m3.py"}
    assert stores.load_tracking(spark, track).count() == 7


def _shuffle_files(spark):
    names = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {n for n in names if "/shuffle_" in n}


def test_run_build_keeps_no_texts_in_shuffle_files(spark, tmp_path):
    import hashlib
    import os
    import time

    from chunkloom.plans.bridges import PROSE
    from chunkloom.plans.build import run_build
    from chunkloom.sources import stores

    def files(start, end, seed):
        texts = ["\n".join("The " + hashlib.sha512(f"{seed} {i} {n}".encode()).hexdigest() for n in range(200)) for i in range(start, end)]
        return spark.createDataFrame([(f"{i}.en", t) for i, t in zip(range(start, end), texts)], "path string, content string")

    store, track = f"file://{tmp_path}/store", f"file://{tmp_path}/track"
    before = _shuffle_files(spark)
    rounds = [run_build(spark, f.repartition(3), PROSE, store, track) for f in (files(0, 6, "old"), files(2, 8, "new"), files(2, 8, "new"))]
    for _ in range(50):             # files go a moment after their query
        left = sum(os.path.getsize(n) for n in _shuffle_files(spark) - before if os.path.exists(n))
        if left < 20_000:
            break
        time.sleep(0.1)
    assert left < 20_000            # hashes and paths; texts of 26,000 characters a file went through several shuffles a round
    assert [(r.reason, r.n_files, r.n_deleted) for r in rounds] == [("no_database", None, 0), ("files_changed", 6, 2), ("no_changes", 0, 0)]
    assert {r.path for r in stores.load_chunks(spark, store).collect()} == {f"{i}.en" for i in range(2, 8)}


def test_long_rows_are_written_by_the_tasks_that_made_them(spark, tmp_path):
    from pathlib import Path

    import pyarrow.parquet as pq

    from chunkloom.sources import stores

    def files(folder):
        return [p for p in Path(folder).rglob("*.parquet") if "/rows/" in str(p)]

    rows = spark.range(300).selectExpr("'a' AS project_type", "concat('p', id) AS path", "repeat(sha2(cast(id AS string), 256), 20) AS content").repartition(3)
    table = stores.chunk_store(spark, f"file://{tmp_path}/store")
    table.merge(rows, rows.select("project_type", "path"))
    assert len(files(tmp_path / "store")) == 3          # one before, after a shuffle of all rows
    assert all(pq.ParquetFile(p).metadata.row_group(0).column(0).compression == "ZSTD" for p in files(tmp_path / "store"))
    table.merge(rows.limit(10), rows.select("project_type", "path").limit(10))
    before = sorted(map(tuple, table.read().select("path", "content").collect()))
    table.compact()
    assert len(table.snapshot().commits) == 1
    assert sorted(map(tuple, table.read().select("path", "content").collect())) == before
    tracked = rows.selectExpr("path", "sha2(content, 256) AS content_hash")
    stores.write_tracking(tracked, f"file://{tmp_path}/track")
    assert len(files(tmp_path / "track")) == 1          # short rows still come together
