"""Files to chunks. One file is one row until the final explode, so nothing here shuffles
except the removal of duplicates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from chunkloom.functions import paths
from chunkloom.functions.regex import all_captures, capture, match_lines, rlike_with
from chunkloom.functions.text import first_line, head, let, preview, strip
from chunkloom.options import Options
from chunkloom.profiles import (
    CLASS_SYMBOLS, COMMENT_STARTS, FUNCTION_SYMBOLS, NAME_PATTERNS, SCORE_LENGTHS, SCORE_PATTERNS, Profile,
)

SEPARATORS = ("\n\n", "\n", ". ", " ", "")


# -- cutting -----------------------------------------------------------------------------

def semantic_bodies(content: Column, profile: Profile, options: Options = Options()) -> Column:
    """Stripped spans between boundary matches, longer than the minimum, as an array.

    Boundaries always start a line, so a span is a run of whole lines: the text is split
    into lines once and each span is a slice of them. Text before the first boundary is
    not part of any span.
    """
    if not profile.boundaries:
        return F.array().cast("array<string>")
    starts = match_lines(content, profile.boundaries, profile.flags)

    def spans(cut: Column) -> Column:
        return F.transform(
            cut["starts"],
            lambda first, i: strip(F.array_join(
                F.slice(
                    cut["lines"], first + 1,
                    F.coalesce(F.get(cut["starts"], i + 1), F.size(cut["lines"])) - first,
                ),
                "\n",
            )),
        )

    return let(
        F.struct(
            F.sort_array(F.array_distinct(starts)).alias("starts"),
            F.split(content, "\n", -1).alias("lines"),
        ),
        lambda cut: F.filter(spans(cut), lambda body: F.length(body) > options.min_chunk_chars),
    )


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Recursive character splitting with overlap; separators stay at the start of a piece."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    separator, finer = separators[at], separators[at + 1:]
    if separator == "":
        pieces = list(text)
    else:
        first, *rest = text.split(separator)
        pieces = [p for p in [first, *(separator + r for r in rest)] if p]

    out: list[str] = []
    window: list[str] = []
    width = 0

    def emit() -> None:
        joined = "".join(window).strip()
        if joined:
            out.append(joined)

    for piece in pieces:
        if len(piece) >= size:
            emit()
            window, width = [], 0
            out.extend(split_text(piece, size, overlap, finer) if finer else [piece])
            continue
        if window and width + len(piece) > size:
            emit()
            drop = 0
            while width > overlap or (width > 0 and width + len(piece) > size):
                width -= len(window[drop])
                drop += 1
            window = window[drop:]
        window.append(piece)
        width += len(piece)
    emit()
    return out


def recursive_split(content: Column, options: Options = Options()) -> Column:
    """Fallback pieces as an array; null in, null out. Arrow batches, whole texts."""
    size, overlap = options.split_chars, options.split_overlap

    @F.pandas_udf("array<string>")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(
                lambda t: None if t is None else [p for p in split_text(t, size, overlap) if p.strip()]
            )

    return pieces(content)


def overlapped(bodies: Column, options: Options = Options()) -> Column:
    """Bodies with the edges of their neighbours: array<struct<body, content, prev, next>>."""
    n = options.overlap_chars

    def widen(all_: Column) -> Column:
        def one(body: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(all_, i - 1))
            after = F.get(all_, i + 1)
            has_prev = F.coalesce(F.length(before) > n, F.lit(False))
            has_next = F.coalesce(F.length(after) > n, F.lit(False))
            return F.struct(
                body.alias("body"),
                F.concat(
                    F.when(has_prev, F.concat(F.lit("..."), F.right(before, F.lit(n)), F.lit("\n\n"))).otherwise(F.lit("")),
                    body,
                    F.when(has_next, F.concat(F.lit("\n\n"), head(after, n), F.lit("..."))).otherwise(F.lit("")),
                ).alias("content"),
                has_prev.alias("has_prev_context"),
                has_next.alias("has_next_context"),
            )
        return F.transform(all_, one)

    return let(bodies, widen)


def cut_files(
    files: DataFrame,
    profile: Profile,
    options: Options = Options(),
    splitter: Callable[[Column, Options], Column] | None = recursive_split,
) -> DataFrame:
    """``files(path, content, ...)`` to one row per chunk, in file order, without a shuffle.

    Files without a semantic chunk go through ``splitter`` (a column function such as a
    ``pandas_udf``); with ``splitter=None`` they produce no rows. Other columns of
    ``files`` are kept.
    """
    keep = [c for c in files.columns if c != "content"]
    content = F.col("content")
    # A generator is the one place the optimizer does not evaluate again further up.
    cut = files.select(*keep, F.inline(F.array(let(
        semantic_bodies(content, profile, options),
        lambda bodies: F.struct(
            bodies.alias("_all"),
            (F.size(bodies) > 0).alias("is_semantic"),
            F.when((F.size(bodies) == 0) & (content != ""), content).alias("_rest"),
        ),
    ))))
    if splitter is not None:
        cut = cut.withColumn("_split", splitter(F.col("_rest"), options)).withColumn(
            "_all", F.when(F.col("is_semantic"), F.col("_all")).otherwise(F.col("_split"))
        )
    return cut.select(
        *keep, "is_semantic", F.posexplode(overlapped(F.col("_all"), options)).alias("chunk_index", "_chunk")
    ).select(*keep, "is_semantic", "chunk_index", "_chunk.*")


# -- properties of one chunk -------------------------------------------------------------

def by_extension(ext: Column, rules: dict[str, list[str]], build: Callable[[list[str]], Column], other: Column) -> Column:
    """``build(patterns)`` of the rule line that lists the extension, ``other`` without one."""
    if not rules:
        return other
    branches = [(ext.isin(names.split()), build(patterns)) for names, patterns in rules.items()]
    (condition, value), *more = branches
    return reduce(lambda case, b: case.when(*b), more, F.when(condition, value)).otherwise(other)


def chunk_type(body: Column, profile: Profile) -> Column:
    """First type, in profile order, with a pattern matching at the chunk start."""
    unicode = "(?U)" if profile.unicode_classes else ""
    result = F.lit("other")
    for name, patterns in reversed(profile.chunk_types.items()):
        for pattern in reversed(patterns):
            hit = (
                body.rlike(f"{unicode}\\A(?:{pattern[1:]})") if pattern.startswith("^")
                else F.startswith(strip(body), F.lit(pattern))
            )
            result = F.when(hit, F.lit(name)).otherwise(result)
    return result


def first_meaningful_line(text: Column) -> Column:
    """First line that is neither blank nor a comment or import, cut to 80 characters."""
    def meaningful(line: Column) -> Column:
        comment = reduce(lambda a, b: a | b, [F.startswith(line, F.lit(s)) for s in COMMENT_STARTS])
        return (line != "") & ~comment

    stripped = F.transform(F.split(strip(text), "\n", -1), strip)
    return let(F.get(F.filter(stripped, meaningful), F.lit(0)), lambda line: preview(line, 80))


def chunk_name(body: Column, ext: Column, profile: Profile) -> Column:
    named = by_extension(
        ext, NAME_PATTERNS,
        lambda patterns: F.coalesce(*[capture(body, profile.regex(p)) for p in patterns]),
        F.lit(None).cast("string"),
    )
    return F.coalesce(named, first_meaningful_line(body))


def class_symbols(body: Column, profile: Profile) -> Column:
    return all_captures(body, [profile.regex(p) for p in CLASS_SYMBOLS])


def function_symbols(body: Column, profile: Profile) -> Column:
    return all_captures(body, [profile.regex(p) for p in FUNCTION_SYMBOLS])


def semantic_score(body: Column) -> Column:
    points = [F.when(rlike_with(body, words, p), F.lit(v)).otherwise(F.lit(0.0)) for v, words, p in SCORE_PATTERNS]
    points += [F.when(F.length(body) > n, F.lit(v)).otherwise(F.lit(0.0)) for v, n in SCORE_LENGTHS]
    return reduce(lambda a, b: a + b, points)


def chunk_hierarchy(classes: Column, functions: Column) -> Column:
    """``class:X > func:Y`` from the first names; null without any."""
    text = F.concat_ws(
        " > ",
        F.concat(F.lit("class:"), F.get(classes, F.lit(0))),
        F.concat(F.lit("func:"), F.get(functions, F.lit(0))),
    )
    return F.when(text != "", text)


def summarize(content: Column, path: Column, project_type: Column) -> Column:
    """``[TYPE] From <file>: <first line>``, the line cut to 80 characters."""
    first = let(
        first_line(content),
        lambda line: F.when(line == "", F.lit("No content")).otherwise(preview(line, 80)),
    )
    full = F.concat(F.lit("["), F.upper(project_type), F.lit("] From "), paths.basename(path), F.lit(": "), first)
    empty = F.concat(F.lit("From "), path, F.lit(": No content"))
    return F.when(content.isNull() | (content == ""), empty).otherwise(full)


def fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def describe_chunks(chunks: DataFrame, profile: Profile) -> DataFrame:
    """Adds type, name, symbols, score, hierarchy, size and fingerprint to cut chunks."""
    body, ext, semantic = F.col("body"), F.col("file_type"), F.col("is_semantic")
    none = F.array().cast("array<string>")
    return (
        chunks.withColumn("file_type", paths.file_ext(F.col("path")))
        .withColumn("type", F.when(semantic, chunk_type(body, profile)).otherwise(F.lit("text")))
        .withColumn("name", F.when(semantic, chunk_name(body, ext, profile)).otherwise(first_meaningful_line(body)))
        .withColumn("class_symbols", F.when(semantic, class_symbols(body, profile)).otherwise(none))
        .withColumn("function_symbols", F.when(semantic, function_symbols(body, profile)).otherwise(none))
        .withColumn("chunk_hierarchy", chunk_hierarchy(F.col("class_symbols"), F.col("function_symbols")))
        .withColumn("chunk_size", F.when(semantic, F.length(body)))
        .withColumn("semantic_score", F.when(semantic, semantic_score(body)))
        .withColumn("summary", summarize(F.col("content"), F.col("path"), F.lit(profile.name)))
        .withColumn("fingerprint", fingerprint(F.col("content")))
        .withColumn("has_context_overlap", F.col("has_prev_context") | F.col("has_next_context"))
    )


# -- duplicates, statistics, errors --------------------------------------------------------

def dedupe_chunks(chunks: DataFrame, key: str = "fingerprint", order: tuple[str, ...] = ("path", "chunk_index")) -> DataFrame:
    """First chunk per fingerprint in (path, index) order.

    A minimum is combined on the map side, so a text copied into a third of all rows
    reaches the reducer as one row per map task, not as one giant window group.
    """
    rest = [c for c in chunks.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return chunks.groupBy(key).agg(first).select(key, "_first.*").select(*chunks.columns)


def build_stats(files: DataFrame, chunks: DataFrame, anchored: Column) -> DataFrame:
    """One row: files processed, chunks kept, duplicates skipped, anchorless chunks, errors.

    ``chunks`` are all chunks before duplicates are removed; copies share a fingerprint
    and therefore their anchors are taken from the copy that is kept. Copies are counted
    once per fingerprint in a combined aggregate, then summed.
    """
    error = F.col("error").isNotNull() if "error" in files.columns else F.lit(False)
    per_file = files.agg(
        F.count_if(~error).alias("files_processed"), F.count_if(error).alias("errors")
    )
    kept = chunks.groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(anchored, F.struct("path", "chunk_index")).alias("anchored"),
    )
    per_chunk = kept.agg(
        F.count(F.lit(1)).alias("chunks_created"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates_skipped"),
        F.count_if(~F.col("anchored")).alias("anchorless_chunks"),
    )
    return one_row(per_file, per_chunk).select(
        "files_processed", "chunks_created", "duplicates_skipped", "anchorless_chunks", "errors"
    )


def one_row(*aggregates: DataFrame) -> DataFrame:
    """Columns of several one-row aggregates side by side: a union folded to one row, no join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aggregates)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def isolate_errors(files: DataFrame, check: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, bad) files. Bad ones carry a reason in ``error`` and are skipped, not fatal."""
    reason = F.when(F.col("content").isNull(), F.lit("unreadable content"))
    if check is not None:
        reason = F.coalesce(reason, check)
    flagged = files.withColumn("error", reason)
    return flagged.filter(F.col("error").isNull()).drop("error"), flagged.filter(F.col("error").isNotNull())
