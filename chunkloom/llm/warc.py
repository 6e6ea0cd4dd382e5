"""WARC archives and an external merge of their capture index.

Pages become WARC/1.1 records, written by Spark's text sink with the record end as line end, so that archives lie in
any store Spark can write and a lost task leaves nothing behind. Archives are compressed with gzip; offsets and lengths
count the bytes inside. Of records with equal payloads the first is a
response, the others revisit it. Reading takes whole archives and walks them by Content-Length; each archive gives a
run of captures sorted by URL key and time. Runs are cut at common range bounds, and per range a loser tree merges the
slices of all runs into one sorted history.

Defined cases: a null html is an empty payload; a null url is an empty one; a null page id is never a first response
where another exists; line ends inside a url are percent-encoded; repeated rows give records of their own, each of the
same type; an empty table gives no archives and an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chunkloom.llm.common import written
from chunkloom.session import scratch_path

REVISIT_BYTES = 100
RECORDS_PER_FILE = 20_000
CAPTURES_PER_RANGE = 5_000
MOST_RANGES = 20_000
KEYS_PER_RANGE = 20

_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CAPTURES = (
    "run string, url_key string, timestamp string, page_id bigint, record_type string, payload_digest string, "
    "payload_bytes bigint, refers_to bigint, archive string, offset bigint, length bigint"
)
HISTORY = "range_no int, position bigint, " + CAPTURES


def typed(pages: DataFrame) -> DataFrame:
    """``pages`` with the payload, its digest, the record's type and what it refers to."""
    rows = pages.select(
        "page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload")
    ).withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": F.sha2("payload", 256)})
    shared = (
        rows.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    )
    revisits = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(shared, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("first")).alias("refers_to"),
    )


def _record_id(page: Column) -> Column:
    name = F.md5(F.coalesce(page.cast("string"), F.lit("")))
    cuts = [F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def records(rows: DataFrame) -> DataFrame:
    """One WARC record per row, as text in column ``value``. The date is made from the page id, as pages have none."""
    moment = F.date_format(
        F.timestamp_seconds(F.lit(1_600_000_000) + F.coalesce(F.col("page_id"), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'"
    )
    response = F.col("record_type") == "response"
    block = F.when(response, F.concat(F.lit(_HTTP), "payload")).otherwise(F.lit(_HTTP))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    return rows.select(F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Date", moment), line("WARC-Target-URI", url),
        F.coalesce(line("X-Page-Id", F.col("page_id").cast("string")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(response, "").otherwise(F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", _record_id(F.col("refers_to"))), line("X-Refers-To-Page", F.col("refers_to").cast("string")),
        )),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block,
    ).alias("value"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Archives in folder ``path``. A file holds what one task has, and so many records at most."""
    (records(typed(pages)).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE)
     .text(path, compression="gzip"))


def url_key(url: str) -> str:
    """Host labels from the right, then the path: neighbours in this order belong together."""
    found = re.match(r"(?s)^.*?://([^/?#]*)(.*)$", url)
    host, rest = found.groups() if found else ("", url)
    return ",".join(reversed(host.lower().split("."))) + ")" + rest


def walk(archive: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Headers, payload, offset and length of every record, in order."""
    at = 0
    while at < len(archive):
        head = archive.index(b"\r\n\r\n", at)
        lines = archive[at:head].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        start = head + 4
        end = start + int(headers["Content-Length"])
        block = archive[start:end]
        if archive[end:end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end where it says")
        yield headers, block[block.index(b"\r\n\r\n") + 4:], at, end + 4 - at
        at = end + 4


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives, one sorted run per archive. Payloads must have the digest and size they claim."""
    arrow_schema = _arrow(CAPTURES)

    def run(batches: Iterator) -> Iterator:
        import gzip
        import hashlib

        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                name, captures = name.as_py().rsplit("/", 1)[-1], []
                for headers, payload, offset, length in walk(gzip.decompress(content.as_py())):
                    digest, size = headers["WARC-Payload-Digest"].split(":")[1], int(headers["X-Payload-Length"])
                    if headers["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, size):
                        raise ValueError(f"the payload at {offset} of {name} is not the one announced")
                    captures.append((
                        name, url_key(headers["WARC-Target-URI"]), headers["WARC-Date"],
                        int(headers["X-Page-Id"]) if "X-Page-Id" in headers else None, headers["WARC-Type"], digest, size,
                        int(headers["X-Refers-To-Page"]) if "X-Refers-To-Page" in headers else None, name, offset, length,
                    ))
                captures.sort(key=_order)
                for i in range(0, len(captures), 5000):
                    yield pa.RecordBatch.from_pylist([dict(zip(arrow_schema.names, c)) for c in captures[i:i + 5000]], schema=arrow_schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select("path", "content")
    return files.mapInArrow(run, CAPTURES)


def _order(capture: tuple) -> tuple:
    """URL key, time, page; a missing page first; then the place, so that the order is total."""
    return capture[1], capture[2], capture[3] is not None, capture[3] or 0, capture[8], capture[9]


class LoserTree:
    """Merges sorted iterables: each inner node remembers the loser of its match, the winner goes up."""

    def __init__(self, runs: list[Iterable[tuple]]):
        self.sources = [iter(r) for r in runs]
        self.heads = [next(s, None) for s in self.sources]
        self.keys = [None if h is None else _order(h) for h in self.heads]
        self.size = max(1, len(runs))
        self.losers = [-1] * self.size
        for leaf in range(len(runs)):
            self._play(leaf, building=True)

    def _before(self, a: int, b: int) -> bool:
        if a < 0 or b < 0:
            return a < 0                        # an empty place lets the other wait while the tree is built
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, winner: int, building: bool = False) -> None:
        node = (winner + self.size) // 2
        while node:
            held = self.losers[node]
            if building and held < 0:
                self.losers[node] = winner
                return
            if self._before(held, winner):
                self.losers[node], winner = winner, held
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.sources:
            winner = self.losers[0]
            head = self.heads[winner]
            if head is None:
                return
            yield head
            self.heads[winner] = following = next(self.sources[winner], None)
            self.keys[winner] = None if following is None else _order(following)
            self._play(winner)


def merge_runs(runs: DataFrame) -> DataFrame:
    """Captures in global order: by ``range_no``, inside it by ``position``.

    Bounds come from a bounded sample of the keys; a key with very many captures is cut at times and pages too.
    """
    spark = runs.sparkSession
    total = runs.count()
    ranges = max(1, min(MOST_RANGES, -(-total // CAPTURES_PER_RANGE)))
    keys = runs.select("run", "url_key", "timestamp", "page_id", F.lit("").alias("t"), F.lit("").alias("d"), F.lit(0).alias("n"), F.lit(0).alias("r"), "archive", "offset")
    sampled = sorted(_order(tuple(r)) for r in keys.sample(min(1.0, KEYS_PER_RANGE * ranges / max(1, total)), seed=7).collect())
    bounds = [sampled[len(sampled) * i // ranges] for i in range(1, ranges)] if sampled else []
    slice_schema = "range_no int, slice binary"
    arrow_slices, arrow_history = _arrow(slice_schema), _arrow(HISTORY)

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            starts = [0] + [i for i in range(1, len(rows)) if rows[i][0] != rows[i - 1][0] or _order(rows[i]) < _order(rows[i - 1])] + [len(rows)]
            numbers, slices = [], []
            for a, z in zip(starts, starts[1:]):
                order = [_order(r) for r in rows[a:z]]
                at = 0
                while at < z - a:
                    number = bisect_left(bounds, order[at])
                    until = bisect_left(order, bounds[number], at) if number < len(bounds) else z - a
                    until = max(until, at + 1)
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, batch.schema) as stream:
                        stream.write_batch(batch.slice(a + at, until - at))
                    numbers.append(number)
                    slices.append(sink.getvalue().to_pybytes())
                    at = until
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(slices, pa.binary())], schema=arrow_slices)

    def merge(slices):
        import pyarrow as pa

        number = slices.column("range_no")[0].as_py()
        tables = [pa.ipc.open_stream(s.as_py()).read_all() for s in slices.column("slice")]
        lists = [list(zip(*(c.to_pylist() for c in t.columns))) for t in tables]
        lists.sort(key=lambda rows: _order(rows[0]))
        merged = list(zip(*((number, i, *capture) for i, capture in enumerate(LoserTree(lists)))))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(merged, arrow_history)], schema=arrow_history)

    return runs.mapInArrow(cut, slice_schema).groupBy("range_no").applyInArrow(merge, HISTORY)


def _arrow(ddl: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def capture_history(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as archives in the shared folder, reads them back and merges their index."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    return merge_runs(written(read_runs(spark, path), "capture-runs"))
