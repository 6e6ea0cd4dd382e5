"""Text expressions: whitespace, lines, previews, array helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The characters stripped from both ends of a text (Unicode white space).
WHITESPACE = (
    "\t\n\u000b\u000c\r\u001c\u001d\u001e\u001f\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK = "\r\n|[\n\u000b\u000c\r\u001c\u001d\u001e\u0085\u2028\u2029]"
WORD_GAP = "[" + WHITESPACE + "]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``.

    The optimizer may inline a projected column into a lambda, where it would be
    evaluated for every element; a lambda variable cannot be inlined.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Both ends without white space. Trimming a set of characters walks the whole text, so
    it is skipped when neither end needs it."""
    def trimmed(t: Column) -> Column:
        ends = F.instr(F.lit(WHITESPACE), F.left(t, F.lit(1))) + F.instr(F.lit(WHITESPACE), F.right(t, F.lit(1)))
        return F.when(ends > 0, F.btrim(t, F.lit(WHITESPACE))).otherwise(t)

    return let(text, trimmed)


def none_if_blank(text: Column) -> Column:
    return F.when(text != "", text)


def none_if_empty(values: Column) -> Column:
    return F.when(F.size(values) > 0, values)


def lines_of(text: Column) -> Column:
    """Lines as a text editor counts them (all Unicode line breaks)."""
    return F.split(text, LINE_BREAK, -1)


def first_line(text: Column) -> Column:
    """First line of the stripped text, without splitting the rest."""
    line = f"[^{WHITESPACE}]{LINE_BREAK.split('|')[1].replace('[', '[^')}*"
    end = F.right(text, F.lit(1))
    kept = F.when(F.instr(F.lit(WHITESPACE), end) > 0, F.rtrim(text, F.lit(WHITESPACE))).otherwise(text)
    return F.regexp_extract(kept, line, 0)


def words_of(text: Column) -> Column:
    """White-space separated words, no empty ones."""
    return F.filter(F.split(text, WORD_GAP, -1), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words_of(text))


def head(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)


def preview(text: Column, chars: int = 200) -> Column:
    """First ``chars`` characters, with an ellipsis when something was cut."""
    return F.when(F.length(text) > chars, F.concat(head(text, chars), F.lit("..."))).otherwise(text)


def contains_any(text: Column, words: list[str]) -> Column:
    """True when any word occurs as a plain substring."""
    if not words:
        return F.lit(False)
    hit = text.contains(words[0])
    for word in words[1:]:
        hit = hit | text.contains(word)
    return hit


def tag_array(tags: list[tuple[str, Column]]) -> Column:
    """Array of the tags whose condition holds, in the given order."""
    if not tags:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(condition, F.lit(tag)) for tag, condition in tags]))


def sorted_set(values: Column) -> Column:
    return F.sort_array(F.array_distinct(values))


def joined(values: Column, separator: str = ", ") -> Column:
    """A list as stored text: items joined, null when there are none."""
    return none_if_blank(F.array_join(values, separator))
