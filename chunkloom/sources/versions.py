"""Tables of keyed rows that change by commits: append, atomic switch, compaction.

A commit adds one folder of rows and one of keys whose earlier rows end; both are in proportion to the change. The
commit itself is one small file in ``log/``, renamed into place, so readers see all of it or nothing, and a failed
attempt leaves only folders that no commit names. Readers list the log, scan the folders it names, and leave out rows
that a later commit ended: by key, or by whole group. Compaction writes the live rows anew, as of the version it read;
commits that came meanwhile stay valid. Nothing is ever rewritten in place, and old folders go only by ``vacuum``.

    log/00000000000000000007     {"version": 7, "rows": "c-1f..", "gone": "c-1f..", "groups": [], "token": null, ...}
    rows/commit=c-1f../<group>=../*.parquet
    gone/commit=c-1f../*.parquet

The log has one file per commit and is read on the driver; ``compact`` bounds how many of them a reader needs. The file
system must rename atomically and refuse to rename onto a file that exists, as HDFS does; on a local disk one writer at
a time is assumed.

Defined cases: a table that was never written is empty if a schema is given; rows of one commit that share a key all
stay; a commit with a token that is already in the log does nothing; null keys belong to no group and cannot be ended by
key; columns that a commit lacks are null; a commit without rows and keys still counts as one.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


@dataclass
class Commit:
    version: int
    rows: str | None = None             # folder of added rows
    gone: str | None = None             # folder of keys whose earlier rows end
    groups: list[str] = field(default_factory=list)     # groups whose earlier rows end
    schema: str | None = None           # of the added rows, as JSON
    token: str | None = None            # name of the change, against doing it twice
    as_of: int | None = None            # a compaction: its rows replace all commits up to this version


@dataclass
class Snapshot:
    commits: list[Commit]               # what a reader needs, by effective version
    last: int
    tokens: set[str]


class VersionedTable:
    """``group`` and ``key`` name the columns that say which rows a commit replaces.

    ``gather`` brings the rows of a group together before they are written, for few files of short rows. Without it rows are
    written by the tasks that made them, since a shuffle of long rows takes as much disk again as the table.
    """

    def __init__(self, spark: SparkSession, folder: str, group: str = "project_type", key: str = "path", gather: bool = True):
        self.spark, self.folder, self.group, self.key, self.gather = spark, folder.rstrip("/"), group, key, gather

    # -- the log -------------------------------------------------------------------------------

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _read_log(self) -> list[Commit]:
        system, path = self._path("log")
        if not system.exists(path):
            return []
        names = sorted(s.getPath().getName() for s in system.listStatus(path) if s.getPath().getName().isdigit())
        out = []
        for name in names:
            stream = system.open(self._path("log", name)[1])
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            out.append(Commit(**json.loads(text)))
        return out

    def snapshot(self) -> Snapshot:
        log = self._read_log()
        base = max((c.as_of for c in log if c.as_of is not None), default=0)
        newest = max((c for c in log if c.as_of is not None), key=lambda c: (c.as_of, c.version), default=None)
        commits = [c for c in log if c.as_of is None and c.version > base]
        return Snapshot(([newest] if newest else []) + commits, log[-1].version if log else 0, {c.token for c in log if c.token})

    def exists(self) -> bool:
        return bool(self._read_log())

    def _publish(self, commit: Commit) -> Commit:
        """Gives the commit the next free version; another writer's commit only moves it on by one."""
        system, folder = self._path("log")
        system.mkdirs(folder)
        draft = self._path("log", f"_{uuid.uuid4().hex}")[1]
        while True:
            commit.version = 1 + max((c.version for c in self._read_log()), default=0)
            stream = system.create(draft, True)
            try:
                stream.write(json.dumps(asdict(commit)).encode())
            finally:
                stream.close()
            target = self._path("log", f"{commit.version:020d}")[1]
            if not system.exists(target) and system.rename(draft, target):
                return commit

    # -- writing -------------------------------------------------------------------------------

    def _gathered(self, rows: DataFrame) -> DataFrame:
        # Rows of a group come together, so that it gets few files; a large group is written by several tasks.
        return rows.hint("rebalance", self.group) if self.gather else rows

    def _write_rows(self, rows: DataFrame, name: str) -> str:
        rows.write.option("compression", "zstd").partitionBy(self.group).parquet(f"{self.folder}/rows/commit={name}")
        return rows.schema.json()

    def _groups_of(self, name: str) -> list[str]:
        """Groups in a written folder, from the names of its partitions: no scan."""
        system, path = self._path("rows", f"commit={name}")
        unescape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        names = [s.getPath().getName() for s in system.listStatus(path) if s.isDirectory() and "=" in s.getPath().getName()]
        return sorted(unescape(n.split("=", 1)[1]) for n in names)

    def replace(self, rows: DataFrame, token: str | None = None) -> int:
        """New rows in place of all rows of their groups; other groups stay."""
        if token is not None and token in self.snapshot().tokens:
            return self.snapshot().last
        name = f"c-{uuid.uuid4().hex}"
        schema = self._write_rows(self._gathered(rows), name)
        return self._publish(Commit(0, rows=name, groups=self._groups_of(name), schema=schema, token=token)).version

    def merge(self, rows: DataFrame | None, gone: DataFrame | None, token: str | None = None) -> int:
        """Ends the earlier rows of the keys in ``gone`` (group, key) and adds ``rows``."""
        if token is not None and token in self.snapshot().tokens:
            return self.snapshot().last
        name = f"c-{uuid.uuid4().hex}"
        schema = self._write_rows(self._gathered(rows), name) if rows is not None else None
        if gone is not None:
            gone.select(F.col(self.group).cast("string"), F.col(self.key).cast("string")).distinct().write.parquet(f"{self.folder}/gone/commit={name}")
        return self._publish(
            Commit(0, rows=name if rows is not None else None, gone=name if gone is not None else None, schema=schema, token=token)
        ).version

    # -- reading -------------------------------------------------------------------------------

    def _schema(self, commits: list[Commit]) -> T.StructType:
        fields: dict[str, T.StructField] = {}
        for commit in commits:
            for f in T.StructType.fromJson(json.loads(commit.schema)).fields if commit.schema else []:
                fields[f.name] = T.StructField(f.name, f.dataType, True)
        return T.StructType(list(fields.values()))

    def _versions(self, commits: list[Commit]) -> DataFrame:
        """Version by commit: as many rows as a reader needs commits, which compaction bounds."""
        rows = [(n, c.as_of or c.version) for c in commits for n in {c.rows, c.gone} if n]
        return self.spark.createDataFrame(sorted(set(rows)), "commit string, version bigint")

    def read(self, schema: T.StructType | str | None = None, snapshot: Snapshot | None = None) -> DataFrame:
        """The live rows; files of groups that a filter rules out are not opened."""
        commits = (snapshot or self.snapshot()).commits
        filled = [c for c in commits if c.rows]
        if not filled:
            if schema is None and not commits:
                raise FileNotFoundError(f"{self.folder} holds no table")
            return self.spark.createDataFrame([], schema if schema is not None else self._schema(commits))
        known = self._schema(filled)
        columns = [f.name for f in known.fields]
        reader = self.spark.read.schema(T.StructType(known.fields + [T.StructField("commit", T.StringType())]))
        base = f"{self.folder}/rows"
        out = reader.option("basePath", base).parquet(*[f"{base}/commit={c.rows}" for c in filled])
        ended = [c for c in commits if c.gone or c.groups]
        if len(commits) > 1 and ended:
            out = out.join(F.broadcast(self._versions(commits)), "commit")
            for c in ended:                                 # whole groups: a condition per commit that has any
                if c.groups:
                    out = out.where(~(F.col(self.group).isin(c.groups) & (F.col("version") < (c.as_of or c.version))) | F.col(self.group).isNull())
            if any(c.gone for c in ended):
                out = self._without(out, [c for c in ended if c.gone])
        return out.select(*columns)

    def _without(self, rows: DataFrame, ended: list[Commit]) -> DataFrame:
        """Rows that no later commit ended. Only keys touched since the last compaction are joined."""
        base = f"{self.folder}/gone"
        kinds = T.StructType([T.StructField(c, T.StringType()) for c in (self.group, self.key, "commit")])
        gone = self.spark.read.schema(kinds).option("basePath", base).parquet(*[f"{base}/commit={c.gone}" for c in ended])
        until = gone.join(F.broadcast(self._versions(ended)), "commit").groupBy(self.group, self.key).agg(F.max("version").alias("_until"))
        same = [rows[c].cast("string") == until[c] for c in (self.group, self.key)]
        return rows.join(until, [*same, rows["version"] < until["_until"]], "left_anti")

    # -- upkeep --------------------------------------------------------------------------------

    def compact(self) -> int:
        """The live rows as one commit, sorted by key; what was committed meanwhile stays on top of it."""
        snapshot = self.snapshot()
        if len(snapshot.commits) < 2:
            return snapshot.last
        name = f"c-{uuid.uuid4().hex}"
        rows = self._gathered(self.read(snapshot=snapshot))
        schema = self._write_rows(rows.sortWithinPartitions(self.group, self.key), name)
        return self._publish(Commit(0, rows=name, schema=schema, as_of=snapshot.last)).version

    def vacuum(self, hours: float = 24.0) -> list[str]:
        """Deletes folders no reader of the present needs, once they are ``hours`` old: replaced ones and failed attempts."""
        import time

        needed = {n for c in self.snapshot().commits for n in (c.rows, c.gone) if n}
        before, dropped = (time.time() - hours * 3600) * 1000, []
        for kind in ("rows", "gone"):
            system, path = self._path(kind)
            for status in system.listStatus(path) if system.exists(path) else []:
                name = status.getPath().getName().removeprefix("commit=")
                if name not in needed and status.getModificationTime() <= before:
                    system.delete(status.getPath(), True)
                    dropped.append(f"{kind}/{name}")
        return sorted(dropped)
