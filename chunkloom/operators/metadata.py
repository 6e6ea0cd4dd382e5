"""Chunk to metadata columns. All of it is one projection on the chunk row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from chunkloom.functions import paths
from chunkloom.functions.regex import all_captures, capture, first_capture, rlike_with
from chunkloom.functions.text import (
    contains_any, let, lines_of, none_if_blank, none_if_empty, sorted_set, strip, tag_array, words_of,
)
from chunkloom.operators.chunking import by_extension
from chunkloom.options import Options
from chunkloom.profiles import (
    ANCHORS, CUSTOM_VALIDATOR_WORDS, IMPORT_EXTENSIONS, VALIDATION_PATTERNS, Profile,
)

_NONE = "array<string>"


def _no_items() -> Column:
    return F.array().cast(_NONE)


def screen_name(content: Column, path: Column, profile: Profile) -> Column:
    """First screen capture; each pattern looks in the chunk, then in the path."""
    return first_capture([(text, profile.regex(p)) for p in profile.screens for text in (content, path)])


def component_name(content: Column, profile: Profile) -> Column:
    return first_capture([(content, profile.regex(p)) for p in profile.components])


def function_names(content: Column, body: Column, ext: Column, profile: Profile) -> Column:
    """Distinct names, sorted. Python names come from the chunk without borrowed text."""
    text = F.when(ext == "py", body).otherwise(content)
    return by_extension(
        ext, profile.function_patterns, lambda ps: sorted_set(all_captures(text, [profile.regex(p) for p in ps])), _no_items()
    )


def class_names(content: Column, body: Column, ext: Column, profile: Profile) -> Column:
    text = F.when(ext == "py", body).otherwise(content)
    return by_extension(
        ext, profile.class_patterns, lambda ps: sorted_set(all_captures(text, [profile.regex(p) for p in ps])), _no_items()
    )


def dependencies(content: Column, ext: Column, options: Options = Options()) -> Column:
    """Distinct import tokens of a chunk, sorted.

    ``import .. from x`` gives x, ``import a.b`` gives a (or a.b with
    ``full_import_name``), a line with ``require("x")`` gives x.
    """
    def token(line: Column) -> Column:
        word = F.get(words_of(F.replace(line, F.lit("import "), F.lit(""))), F.lit(0))
        first = word if options.full_import_name else F.get(F.split(word, "\\.", -1), F.lit(0))
        starts = F.startswith(line, F.lit("import"))
        return (
            F.when(starts & line.contains("from"), capture(line, r"(?U)from\s+([^\s]+)"))
            .when(starts, none_if_blank(first))
            .when(line.contains("require("), capture(line, r"""require\(["']([^"']+)["']"""))
        )

    relevant = F.filter(
        F.transform(lines_of(content), strip),
        lambda line: F.startswith(line, F.lit("import")) | line.contains("require("),
    )
    found = sorted_set(F.array_compact(F.transform(relevant, token)))
    return F.when(ext.isin(IMPORT_EXTENSIONS), found).otherwise(_no_items())


def input_fields(content: Column, ext: Column, profile: Profile) -> Column:
    return by_extension(
        ext, profile.input_patterns, lambda ps: sorted_set(all_captures(content, [profile.regex(p) for p in ps])), _no_items()
    )


def ui_elements(content: Column, profile: Profile) -> Column:
    return let(
        F.lower(content), lambda low: tag_array([(tag, low.contains(tag.lower())) for tag in profile.ui_elements])
    )


def validation_rules(content: Column, profile: Profile) -> Column:
    def holds(pattern: str) -> Column:
        if pattern == VALIDATION_PATTERNS["custom_validator"]:
            return rlike_with(content, CUSTOM_VALIDATOR_WORDS, pattern)
        return content.rlike(profile.regex(pattern))

    return tag_array([(tag, holds(p)) for tag, p in profile.validation_patterns.items()])


def business_indicators(content: Column, profile: Profile) -> Column:
    """Tags with any of their words in the lower-cased text; a capital never matches."""
    return let(F.lower(content), lambda low: tag_array(
        [(tag, contains_any(low, words)) for tag, words in profile.indicator_words.items()]
    ))


def drop_empty_fields(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Empty texts and empty lists become null: absent and empty are the same thing."""
    types = dict(df.dtypes)
    names = columns or [c for c in df.columns if types[c] == "string" or types[c].startswith("array<")]
    return df.withColumns({
        c: none_if_blank(F.col(c)) if types[c] == "string" else none_if_empty(F.col(c)) for c in names
    })


def has_value(column: Column, dtype: str) -> Column:
    filled = F.size(column) > 0 if dtype.startswith("array<") else column != ""
    return F.coalesce(filled, F.lit(False))


def has_anchor(df: DataFrame) -> Column:
    """True when any of the four anchors of a chunk row is filled."""
    types = dict(df.dtypes)
    return reduce(lambda a, b: a | b, [has_value(F.col(a), types[a]) for a in ANCHORS])


def enrich_chunks(chunks: DataFrame, profile: Profile, options: Options = Options()) -> DataFrame:
    """All metadata of a described chunk, empty fields dropped, anchors flagged."""
    content, body, path = F.col("content"), F.col("body"), F.col("path")
    ext = paths.file_ext(path)
    fields = {
        "screen_name": screen_name(content, path, profile),
        "component_name": component_name(content, profile),
        "function_names": function_names(content, body, ext, profile),
        "class_names": class_names(content, body, ext, profile),
        "dependencies": dependencies(content, ext, options),
        "input_fields": input_fields(content, ext, profile),
        "ui_elements": ui_elements(content, profile),
        "validation_rules": validation_rules(content, profile),
        "business_logic_indicators": business_indicators(content, profile),
    }
    out = drop_empty_fields(chunks.withColumns(fields), list(fields))
    return out.withColumn("has_semantic_anchors", has_anchor(out))
