"""Ignore-rule matching as an expression over (relative path, rule)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from chunkloom.functions.paths import basename
from chunkloom.functions.text import let


def _glob_regex(glob: Column) -> Column:
    """Shell glob to an anchored regular expression; ``*`` also matches ``/``."""
    literal = F.regexp_replace(glob, r"([.\\^$+(){}|&~])", r"\\$1")
    literal = F.regexp_replace(literal, r"\[(?!!?\]?[^\]]*\])", r"\\[")
    literal = F.regexp_replace(literal, r"\[!", "[^")
    literal = F.replace(F.replace(literal, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit("."))
    return F.concat(F.lit("(?s)^(?:"), literal, F.lit(")$"))


def _below(path: Column, folder: Column) -> Column:
    return (path == folder) | F.startswith(path, F.concat(folder, F.lit("/")))


def matches_rule(path: Column, rule: Column) -> Column:
    """The five rule shapes, first shape wins; there is no negation."""
    slash = F.lit("/")

    def rooted() -> Column:
        return _below(path, F.substring(rule, F.lit(2), F.length(rule)))

    def folder() -> Column:
        return _below(path, F.substring(rule, F.lit(1), F.length(rule) - 1))

    def anywhere() -> Column:
        tail = F.substring(rule, F.lit(4), F.length(rule))
        inside = F.contains(path, F.concat(slash, tail, slash)) | F.startswith(path, F.concat(tail, slash))
        segment = let(
            _glob_regex(tail),
            lambda rx: F.exists(F.split(path, "/", -1), lambda part: F.rlike(part, rx)),
        )
        return F.endswith(path, tail) | inside | segment

    def around() -> Column:
        sides = F.split(rule, r"\*\*", -1)
        return (F.size(sides) == 2) & F.startswith(path, sides[0]) & F.endswith(path, sides[1])

    def simple() -> Column:
        return let(_glob_regex(rule), lambda rx: F.rlike(path, rx) | F.rlike(basename(path), rx))

    return (
        F.when(rule == "", F.lit(False))
        .when(F.startswith(rule, slash), rooted())
        .when(F.endswith(rule, slash), folder())
        .when(F.startswith(rule, F.lit("**/")), anywhere())
        .when(F.contains(rule, F.lit("**")), around())
        .otherwise(simple())
    )
