"""Path expressions on ``/``-separated paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from chunkloom.functions.text import none_if_blank


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def dirname(path: Column) -> Column:
    """Parent directory; empty for a top-level file."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def file_ext(path: Column) -> Column:
    """Text after the last dot, lower-cased; empty without a dot."""
    return F.when(path.contains("."), F.lower(F.element_at(F.split(path, "\\.", -1), -1))).otherwise(F.lit(""))


def dotted_ext(path: Column) -> Column:
    """Extension of the last segment with its dot; leading dots of a name do not count."""
    return F.lower(F.regexp_extract(basename(path), r"^\.*[^.].*?(\.[^.]*)$", 1))


def module_name(path: Column) -> Column:
    """Last segment without its extension; both slash kinds separate segments."""
    name = F.element_at(F.split(path, r"[/\\]", -1), -1)
    return none_if_blank(F.regexp_replace(name, r"\.[^.]*$", ""))


def relative_path(path: Column, root: Column) -> Column:
    """``path`` below ``root``; a path outside the root passes through."""
    prefix = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(
        F.startswith(path, prefix), F.substring(path, F.length(prefix) + 1, F.length(path))
    ).otherwise(path)


def absolute_path(path: Column, root: Column) -> Column:
    """``path`` joined to ``root`` unless it is empty or already absolute."""
    return F.when((path == "") | F.startswith(path, F.lit("/")), path).otherwise(
        F.concat(F.rtrim(root, F.lit("/")), F.lit("/"), path)
    )


def ancestors(path: Column) -> Column:
    """Directories above ``path``, from the top: 'a/b/c.txt' -> ['', 'a', 'a/b']."""
    parts = F.split(path, "/", -1)
    return F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )
