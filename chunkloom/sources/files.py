"""Trees of files as DataFrames.

Spark's own file sources skip names that start with ``_`` or ``.``, which would lose
``__init__.py`` and ``.gitignore``; so directories are listed level by level in tasks, and
the bytes are read in tasks, through Arrow's file systems (local mount, HDFS, S3, GCS).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chunkloom.functions import paths
from chunkloom.session import scratch_path

LISTING = "path string, is_dir boolean, size bigint, mtime timestamp"
# Bytes read at a time past the listed size of a file.
READ_ON = 1 << 20


def _list_children(root: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as arrow_fs

        file_system, base = arrow_fs.FileSystem.from_uri(root)
        base = base.rstrip("/")
        for batch in batches:
            for folder in batch["path"]:
                found = file_system.get_file_info(arrow_fs.FileSelector(f"{base}/{folder}".rstrip("/")))
                if not found:                   # Arrow has no type for columns without values
                    continue
                yield pd.DataFrame({
                    "path": [i.path[len(base) + 1:] for i in found],
                    "is_dir": [i.type == arrow_fs.FileType.Directory for i in found],
                    "size": [i.size or 0 for i in found],
                    "mtime": pd.to_datetime([i.mtime for i in found], utc=True),
                })
    return run


def list_tree(
    spark: SparkSession, root: str, keep_dir: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """All files below ``root``: ``path`` (relative), ``size``, ``mtime``.

    One round per directory level, until a level has no directories. ``keep_dir`` filters the directories of a level before
    the walk goes deeper. Each level is written to the shared folder, so it is listed once.
    """
    folder = scratch_path(spark, "listing")
    level = spark.createDataFrame([("",)], "path string")
    for depth in count():
        target = f"{folder}/level={depth}"
        spread = level.repartition(max(spark.sparkContext.defaultParallelism, 1))
        spread.mapInPandas(_list_children(root), LISTING).write.parquet(target)
        here = spark.read.schema(LISTING).parquet(target)
        level = here.filter("is_dir").select("path")
        if keep_dir is not None:
            level = keep_dir(level)
        if level.isEmpty():
            break
    found = spark.read.schema(LISTING + ", level int").parquet(folder)
    return found.filter("not is_dir").select("path", "size", "mtime")


def ends_with_any(path: Column, extensions: tuple[str, ...] | list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.endswith(path, F.lit(e)) for e in extensions], F.lit(False))


def _whole(stream, size: int) -> pa.Buffer:
    """All that a stream holds. Its listed size is read at once and not copied; a stream of another length is read on."""
    parts = [stream.read_buffer(max(size, 1))]
    while parts[-1].size:
        parts.append(stream.read_buffer(READ_ON))
    return parts[0] if len(parts) <= 2 else pa.py_buffer(b"".join(parts))


def _read_bytes(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Listed files with their bytes, a row at a time. A worker holds the bytes of one file, once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as arrow_fs

        file_system, base = arrow_fs.FileSystem.from_uri(root)
        base = base.rstrip("/")

        def read(row: pa.RecordBatch) -> pa.RecordBatch:
            try:
                with file_system.open_input_stream(f"{base}/{row['path'][0].as_py()}") as stream:
                    data = _whole(stream, row["size"][0].as_py())
                ends = pa.py_buffer(np.array([0, data.size], dtype="int32"))
                raw, error = pa.Array.from_buffers(pa.binary(), 1, [None, ends, data]), None
            except OSError as problem:
                raw, error = pa.nulls(1, pa.binary()), str(problem)
            return pa.RecordBatch.from_arrays(
                [row["path"], row["size"], row["mtime"], raw, pa.array([error], pa.string())], ["path", "size", "mtime", "raw", "error"])

        for batch in batches:
            for at in range(batch.num_rows):
                yield read(batch.slice(at, 1))      # no name here holds on to the bytes
    return run


def _read_digests(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Listed files with the SHA-256 of their bytes, which are read a piece at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as arrow_fs

        file_system, base = arrow_fs.FileSystem.from_uri(root)
        base = base.rstrip("/")

        def read(path: str) -> tuple[str | None, str | None]:
            digest = hashlib.sha256()
            try:
                with file_system.open_input_stream(f"{base}/{path}") as stream:
                    while (piece := stream.read_buffer(READ_ON)).size:
                        digest.update(piece)
                return digest.hexdigest(), None
            except OSError as problem:
                return None, str(problem)

        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                digest, error = read(row["path"][0].as_py())
                yield pa.RecordBatch.from_arrays(
                    [row["path"], row["size"], row["mtime"], pa.array([digest], pa.string()), pa.array([error], pa.string())],
                    ["path", "size", "mtime", "sha256", "error"])
    return run


def scan_files(
    spark: SparkSession,
    root: str,
    extensions: tuple[str, ...] | list[str],
    project: str = "",
    keep_dir: Callable[[DataFrame], DataFrame] | None = None,
    keep_file: Callable[[DataFrame], DataFrame] | None = None,
    digest: bool = False,
) -> DataFrame:
    """``files(project, path, ext, raw, size, mtime, error)`` for names with one of the extensions.

    A file that cannot be read keeps its row with a null ``raw`` and the reason in ``error``. With ``digest`` there is
    ``sha256`` of all bytes in place of ``raw``: a task then holds a piece of a file at a time, however large the file is.
    """
    listing = list_tree(spark, root, keep_dir).filter(ends_with_any(F.col("path"), extensions))
    if keep_file is not None:
        listing = keep_file(listing)
    # Shuffling by path spreads neighbouring files, and so the bytes, over the tasks.
    value, reader = ("sha256 string", _read_digests) if digest else ("raw binary", _read_bytes)
    return (
        listing.repartition("path")
        .mapInArrow(reader(root), f"path string, size bigint, mtime timestamp, {value}, error string")
        .select(
            F.lit(project).alias("project"), "path", paths.file_ext(F.col("path")).alias("ext"),
            value.split()[0], "size", "mtime", "error",
        )
    )


def lossy_text(raw: Column) -> Column:
    """UTF-8 text with undecodable bytes dropped and all line ends turned into newlines.

    The repair writes U+FFFD for bad bytes; those that the text has itself are set aside before it, in an escape that
    can be undone whatever the text holds.
    """
    given = raw.cast("string")
    mark, aside = "\ufdd0", [("\ufdd0", "\ufdd0\ufdd1"), ("\ufffd", "\ufdd0\ufdd2")]
    held = reduce(lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])), aside, given)
    bare = F.replace(F.make_valid_utf8(held), F.lit("\ufffd"), F.lit(""))
    back = F.replace(F.replace(bare, F.lit(aside[1][1]), F.lit("\ufffd")), F.lit(aside[0][1]), F.lit(mark))
    text = F.when(F.is_valid_utf8(given), given).otherwise(back)
    return F.regexp_replace(text, "\r\n?", "\n")


def read_text_lossy(files: DataFrame) -> DataFrame:
    """``raw`` bytes to ``content`` text plus the SHA-256 of the bytes."""
    return files.withColumn("sha256", F.sha2("raw", 256)).withColumn("content", lossy_text(F.col("raw"))).drop("raw")
