"""Quality rules as a short-circuit cascade.

Every document is measured once; rules are then asked one after another until one rejects. Which rule comes first is
decided on a sample: each rule's cost is timed and its rejections counted there, and rules are ordered by rejections
per cost. The order changes how long a verdict takes, never the verdict, so results do not depend on the sample.

Defined cases: a null or empty text has no words and fails the base rule; repeated rows are judged each for itself;
other columns pass through, those named like a measurement are replaced by it; an empty table gives an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

# The sample that costs and selectivities are estimated on: so many documents at most, none longer than this.
SAMPLE_ROWS = 400
SAMPLE_CHARS = 50_000

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOLS = b"#*$%&|<>"
_SPACES = " \t\n\v\f\r"


@dataclass(frozen=True)
class Rule:
    """``rejects(words, counts, text)`` is true where the document goes; words are UTF-8 bytes, counts the measures."""

    name: str
    rejects: Callable[[list[bytes], dict[str, int], bytes], bool]


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words that lie in a window of ``size`` words found twice or more, its first place included."""
    if len(words) < size:
        return 0
    seen: dict[tuple, int] = {}
    windows = list(zip(*(words[i:] for i in range(size))))
    if len(set(windows)) == len(windows):
        return 0
    for window in windows:
        seen[window] = seen.get(window, 0) + 1
    covered, until = 0, 0
    for i, window in enumerate(windows):
        if seen[window] > 1:
            covered += i + size - max(i, until)
            until = i + size
    return covered


def measure(text: str) -> tuple[list[bytes], dict[str, int], bytes]:
    """Words and counts of one whole text. Words are runs of anything but space and the controls 9 to 13."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()                         # bytes split at exactly those six characters
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    return words, {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, _SPACES)),
        "n_symbols": len(raw) - len(raw.translate(None, _SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(words),
    }, raw


def base_failed(counts: dict[str, int]) -> bool:
    return counts["n_words"] < 50 or 100 * counts["n_repeat_words"] > 50 * counts["n_words"]


# Limits in whole numbers, so that SQL can say the same.
RULES = (
    Rule("word_length", lambda w, c, t: not 2 * c["n_words"] <= c["word_chars"] <= 15 * c["n_words"]),
    Rule("symbols", lambda w, c, t: 10 * c["n_symbols"] > c["n_words"]),
    Rule("duplicate_lines", lambda w, c, t: 10 * c["n_dup_lines"] > 3 * (t.count(b"\n") + 1)),
    Rule("digits", lambda w, c, t: 10 * (len(t) - len(t.translate(None, b"0123456789"))) > 3 * c["word_chars"]),
    Rule("long_word", lambda w, c, t: max(map(len, w), default=0) > 1000),
    Rule("few_words_differ", lambda w, c, t: 20 * len(set(w)) < c["n_words"]),
)


def rule_estimates(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> dict[str, tuple[float, float]]:
    """Seconds per document and share of rejections of each rule, on a bounded sample."""
    sample = df.select(text).where(F.length(text) <= SAMPLE_CHARS).limit(SAMPLE_ROWS).toArrow().column(0).to_pylist()
    documents = [measure(t) for t in sample]
    out = {}
    for rule in rules:
        started = time.perf_counter()
        rejected = sum(rule.rejects(*d) for d in documents)
        out[rule.name] = ((time.perf_counter() - started) / max(1, len(documents)), rejected / max(1, len(documents)))
    return out


def ordered(rules: tuple[Rule, ...], estimates: dict[str, tuple[float, float]]) -> tuple[Rule, ...]:
    """Rules by rejections per cost, the best first; equal ones in the order given."""
    def worth(rule: Rule) -> float:
        cost, share = estimates[rule.name]
        return share / max(cost, 1e-9)
    return tuple(sorted(rules, key=worth, reverse=True))


def judge(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``df`` with the measures, ``base_failed`` and ``kept``."""
    cascade = ordered(rules, rule_estimates(df, rules, text))
    names = [*MEASURES, "base_failed", "kept"]
    schema = T.StructType(
        [f for f in df.schema if f.name not in names]
        + [T.StructField(n, T.LongType(), False) for n in MEASURES]
        + [T.StructField(n, T.BooleanType(), False) for n in names[-2:]]
    )
    at = [f.name for f in schema][:-len(names)]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            columns: dict[str, list] = {n: [] for n in names}
            for value in batch.column(text):
                words, counts, raw = measure(value.as_py() or "")
                failed = base_failed(counts)
                for name in MEASURES:
                    columns[name].append(counts[name])
                columns["base_failed"].append(failed)
                columns["kept"].append(not failed and not any(r.rejects(words, counts, raw) for r in cascade))
            made = [pa.array(columns[n], pa.int64()) for n in MEASURES] + [pa.array(columns[n], pa.bool_()) for n in names[-2:]]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in at] + made, names=[*at, *names])

    return df.mapInArrow(run, schema)
