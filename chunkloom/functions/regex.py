"""Regular-expression expressions over one text column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from chunkloom.functions.text import contains_any, let, none_if_blank

_BLOCK = 256


def rlike_with(text: Column, words: list[str], pattern: str) -> Column:
    """``text.rlike(pattern)`` for a pattern whose matches contain one of ``words``.

    Plain search is far cheaper than a regular expression. Without regard to case the
    search runs on lower case; the long s, which lower-casing keeps, is always let through.
    """
    if pattern.startswith("(?i"):
        found = let(F.lower(text), lambda low: contains_any(low, words)) | text.contains("\u017f")
    else:
        found = contains_any(text, words)
    return found & text.rlike(pattern)


def capture(text: Column, pattern: str, group: int = 1) -> Column:
    """First capture, null without a match."""
    return none_if_blank(F.regexp_extract(text, pattern, group))


def first_capture(texts_and_patterns: Sequence[tuple[Column, str]]) -> Column:
    if not texts_and_patterns:
        return F.lit(None).cast("string")
    return F.coalesce(*[capture(text, pattern) for text, pattern in texts_and_patterns])


def all_captures(text: Column, patterns: Sequence[str], group: int = 1) -> Column:
    """Captures of every match of every pattern, pattern by pattern, repeats kept."""
    if not patterns:
        return F.array().cast("array<string>")
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(group)) for p in patterns]
    return found[0] if len(found) == 1 else F.concat(*found)


def running_totals(numbers: Column) -> Column:
    """Sum of all elements before each position: [a, b, c] -> [0, a, a + b].

    Growing one array element by element copies it every time, so totals are built
    within blocks and over blocks; the work stays close to linear for long arrays.
    """
    add = lambda total, x: total + x

    def exclusive(values: Column, start: Column) -> Column:
        state = F.aggregate(
            values,
            F.struct(F.array().cast("array<int>").alias("seen"), start.cast("int").alias("total")),
            lambda acc, x: F.struct(
                F.concat(acc["seen"], F.array(acc["total"])).alias("seen"),
                (acc["total"] + x).cast("int").alias("total"),
            ),
        )
        return state["seen"]

    def over_blocks(values: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(_BLOCK))
        blocks = F.transform(starts, lambda s: F.slice(values, s + 1, F.lit(_BLOCK)))
        return let(
            blocks,
            lambda bs: let(
                exclusive(F.transform(bs, lambda b: F.aggregate(b, F.lit(0), add)), F.lit(0)),
                lambda offsets: F.flatten(
                    F.zip_with(bs, offsets, lambda b, offset: exclusive(b, offset))
                ),
            ),
        )

    return let(numbers, over_blocks)


def newline_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def match_lines(text: Column, patterns: Sequence[str], flags: str) -> Column:
    """Zero-based line numbers at which the non-overlapping matches of each pattern start.

    A match may span lines, so lines are counted from the text between the matches and
    the matched texts themselves, never by testing single lines. The patterns are an array
    and the counting is one lambda over it, which keeps the plan small for long profiles.
    """
    def starts(pattern: Column) -> Column:
        gaps = F.split(text, F.concat(F.lit(flags), pattern), -1)
        matched = F.regexp_extract_all(text, F.concat(F.lit(f"{flags}("), pattern, F.lit(")")), F.lit(1))
        counted = F.struct(
            F.transform(gaps, newline_count).alias("g"), F.transform(matched, newline_count).alias("m")
        )
        # One gap more than matches: the last start has no match behind it.
        return let(counted, lambda n: F.slice(
            F.zip_with(
                running_totals(F.zip_with(n["g"], n["m"], lambda g, m: g + F.coalesce(m, F.lit(0)))),
                n["g"],
                lambda before, gap: before + gap,
            ), F.lit(1), F.size(n["m"]),
        ))

    return F.flatten(F.transform(F.array(*[F.lit(p) for p in patterns]), starts))
