"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, one occurrence per group.

A line is normalised to its lower-case words (what stands between signs and spaces of Latin-1). Equal normalised lines are one line. Two
lines are linked if their 64-bit SimHashes of words differ in ``MAX_BITS`` at most and the longer one needs no more than one
edit in ``EDIT_SHARE`` characters. The group of a line is its connected component; the first occurrence in the group (smallest document, then
line) stays, every other is taken out. All of it is DataFrame expressions.

Hashes that differ in three bits agree in at least two of five blocks, so lines meet on the ten pairs of blocks, and every
linked pair does. Lines whose sets of neighbouring words differ by more than the edits allowed for can explain are told
apart without an edit distance. In a bucket, lines meet the leader first, whose hash the bucket carries, so that most chance meetings
end there; then, in buckets that are not one component, lines of different
components meet, on the first block pair that they share, and only links come out. Texts are fetched for lines whose hashes are
near, for no others.

Defined cases: lines without a word stay, as do rows without text or id; rows with one id are copies of one document and
keep or lose the same lines; a document may become empty; other columns pass through, those named ``n_lines`` and
``n_removed`` are replaced; a text of one line is a line; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from chunkloom.llm.common import dropped, written
from chunkloom.llm.graph import components, joined_components

MAX_BITS = 3
# Edits allowed for: one in so many characters of the longer line.
EDIT_SHARE = 40
# Pairs of neighbouring words that one edit can take away, by joining two words.
PAIRS_PER_EDIT = 3
# Lines of a bucket that one task compares with the others of the bucket.
SHARE_LINES = 512

# Distinct words that one packed counter can count: eight fields of a long, below 2^7 each.
CHUNK_WORDS = 127

# Two of ``MAX_BITS + 2`` blocks are free of differences: first bit and width of each block.
_BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
_BLOCK_PAIRS = [(i, j) for i in range(5) for j in range(i + 1, 5)]
# The lowest bit of each of eight, four and two equal fields of 64 bits.
_EIGHT_FIELDS, _FOUR_FIELDS, _TWO_FIELDS = (sum(1 << i for i in range(0, 64, width)) for width in (8, 16, 32))


def _or(parts: list[Column]) -> Column:
    return reduce(Column.bitwiseOR, parts)


def _packed(feature: str) -> list[Column]:
    """Sums that count the 64 bits of at most ``CHUNK_WORDS`` hashes: field k of sum j counts bit 8 k + j."""
    return [F.sum(F.shiftrightunsigned(feature, j).bitwiseAND(_EIGHT_FIELDS)).alias(f"p{j}") for j in range(8)]


def _packed_majority(n: str) -> Column:
    """SimHash from the packed sums of ``n`` hashes: the bits that over half of them have.

    A count is over half of n exactly if adding 2^7 - 1 - n div 2 sets its bit of 2^7. Fields are taken in two halves,
    which leaves room for that bit.
    """
    more = (F.lit(CHUNK_WORDS) - F.shiftright(n, 1)) * F.lit(_FOUR_FIELDS)
    def over(j: int, k: int) -> Column:
        fields = F.shiftrightunsigned(f"p{j}", 8 * k).bitwiseAND(F.lit(_FOUR_FIELDS * 0xFF))
        return F.shiftleft(F.shiftrightunsigned(fields + more, 7).bitwiseAND(F.lit(_FOUR_FIELDS)), 8 * k + j)
    return _or([over(j, k) for j in range(8) for k in range(2)])


def _counters() -> list[Column]:
    """Sums over packed sums: field k of sum b counts bit b + 32 k, up to 2^30."""
    return [
        F.sum(F.shiftrightunsigned(f"p{b % 8}", b // 8 * 8).bitwiseAND(F.lit(_TWO_FIELDS * 0xFF))).alias(f"c{b}") for b in range(32)
    ]


def _majority(n: str) -> Column:
    """SimHash from ``_counters`` of ``n`` hashes, as above with 2^30."""
    more = (F.lit((1 << 30) - 1) - F.shiftright(n, 1)) * F.lit(_TWO_FIELDS)
    return _or([
        F.shiftleft(F.shiftrightunsigned(F.col(f"c{b}") + more, 30).bitwiseAND(F.lit(_TWO_FIELDS)), b) for b in range(32)
    ])


# Characters of Latin-1 that are neither letters nor digits, one by one: Java looks such a class up in a table, ranges not.
_BETWEEN = "[" + "".join(
    f"\\x{c:02x}" for c in range(256) if not chr(c).isalpha() and not 0x30 <= c <= 0x39
) + "]++"


def line_words(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), _BETWEEN), "")


def occurrences(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every line with a word: document, line number, key of the normalised line, its SimHash.

    The words come out of the generator, so that no filter repeats the splitting. Each word counts once in the SimHash:
    else the commonest words of a language would make all its lines alike. Bits are counted by sums over rows of words,
    combined per line before the shuffle, so that a line of any length is counted in compiled code and in full. Eight
    sums count up to ``CHUNK_WORDS`` words of a line; the chunks of a longer line are added up by a second aggregation.
    """
    # Rows with one id are counted one by one: together they would have more words than the line.
    rows = df.where(F.col(id).isNotNull() & F.col(text).isNotNull()).withColumn("row", F.monotonically_increasing_id())
    lines = rows.select(
        "row", F.col(id).cast("bigint").alias("doc"), F.posexplode(F.transform(F.split(text, "\n"), line_words)).alias("line", "words")
    )
    words = (
        lines.where(F.size("words") > 0)
        .select("row", "doc", "line", F.inline(F.array(F.struct(
            F.concat_ws(" ", "words").alias("norm"), F.array_distinct(F.transform("words", lambda w: F.xxhash64(w))).alias("features"),
        ))))
        .select("row", "doc", "line", *_keys("norm"), F.size("features").alias("n"), F.posexplode("features").alias("at", "feature"))
    )
    own = [F.max(c).alias(c) for c in ("doc", "key", "key2", "n")]      # one value per line
    chunks = words.groupBy("row", "line", F.expr(f"at div {CHUNK_WORDS}").alias("chunk")).agg(*own, *_packed("feature"))
    short = chunks.where(F.col("n") <= CHUNK_WORDS)
    long = chunks.where(F.col("n") > CHUNK_WORDS).groupBy("row", "line").agg(*own, *_counters())
    return short.select("doc", "line", "key", "key2", _packed_majority("n").alias("simhash")).unionByName(
        long.select("doc", "line", "key", "key2", _majority("n").alias("simhash"))
    )


def _keys(norm: str) -> list[Column]:
    """128 bits that stand for a normalised line."""
    return [F.xxhash64(norm).alias("key"), F.xxhash64(F.lit("second"), norm).alias("key2")]


def _block_keys() -> Column:
    """Ten keys: the number of the block pair above the bits of its two blocks."""
    def block(i: int) -> Column:
        first, width = _BLOCKS[i]
        return F.shiftrightunsigned("simhash", first).bitwiseAND(F.lit((1 << width) - 1))
    return F.array(*[
        F.shiftleft(block(i), 13).bitwiseOR(block(j)).bitwiseOR(F.lit(n << 26)) for n, (i, j) in enumerate(_BLOCK_PAIRS)
    ])


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MAX_BITS


def _line_texts(ids: DataFrame, distinct: DataFrame, df: DataFrame, id: str, text: str) -> DataFrame:
    """``line_id`` and normalised text of the lines in ``ids`` (line_id), taken from their first documents."""
    wanted = distinct.join(ids, "line_id").groupBy("doc").agg(F.collect_list(F.struct("line", "line_id", "key", "key2")).alias("wanted"))
    found = df.select(F.col(id).cast("bigint").alias("doc"), F.col(text).alias("raw")).join(wanted, "doc")
    found = found.select(F.inline(F.array(F.struct(F.split("raw", "\n").alias("raw"), "wanted")))).select("raw", F.explode("wanted").alias("w"))
    norms = found.select("w", F.inline(F.array(F.struct(F.concat_ws(" ", line_words(F.get("raw", F.col("w.line")))).alias("norm")))))
    # Rows with one id may have different texts.
    same = norms.select("w", "norm", *_keys("norm")).where((F.col("key") == F.col("w.key")) & (F.col("key2") == F.col("w.key2")))
    return same.select("w.line_id", "norm").dropDuplicates(["line_id"])


def _word_pairs(norm: str) -> Column:
    words = F.split(norm, " ")
    both = F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.xxhash64(a, b))
    return F.array_distinct(both)


def _alike() -> Column:
    """Whether the lines ``na`` and ``nb`` are alike by edits; ``wa`` and ``wb`` are their neighbouring words. Cheap conditions come first."""
    most = f"greatest(length(na), length(nb)) div {EDIT_SHARE}"
    conditions = [F.expr(f"abs(length(na) - length(nb)) <= {most}")]
    conditions += [F.expr(f"size(array_except({a}, {b})) <= {PAIRS_PER_EDIT} * ({most})") for a, b in (("wa", "wb"), ("wb", "wa"))]
    # A narrow band settles most pairs; only the others need wider ones.
    conditions.append(reduce(Column.__or__, [F.expr(f"levenshtein(na, nb, CAST({most} div {n} AS INT)) >= 0") for n in (64, 16, 4, 1)]))
    return reduce(Column.__and__, conditions)


def _similar(pairs: DataFrame, distinct: DataFrame, df: DataFrame, id: str, text: str) -> DataFrame:
    """Of ``pairs`` (a, b: line ids) those whose normalised lines are alike by edits."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("line_id")).distinct()
    texts = written(_line_texts(ids, distinct, df, id, text).withColumn("beside", _word_pairs("norm")), "line-texts")
    out = written(
        pairs.join(texts.select(F.col("line_id").alias("a"), F.col("norm").alias("na"), F.col("beside").alias("wa")), "a")
        .join(texts.select(F.col("line_id").alias("b"), F.col("norm").alias("nb"), F.col("beside").alias("wb")), "b")
        .where(_alike()).select("a", "b"),
        "line-links",
    )
    dropped(texts)
    return out


def _first_shared(a: str, b: str) -> Column:
    """Number of the first block pair on which two hashes agree: only there are two lines compared."""
    apart = F.col(a).bitwiseXOR(F.col(b))
    same = [F.shiftrightunsigned(apart, first).bitwiseAND(F.lit((1 << width) - 1)) == 0 for first, width in _BLOCKS]
    return F.coalesce(*[F.when(same[i] & same[j], F.lit(n)) for n, (i, j) in enumerate(_BLOCK_PAIRS)])


def _side(rows: DataFrame, n: str) -> DataFrame:
    """Columns of one side of a meeting: line_id, label, simhash, norm, words become ``n`` with the first letter before it."""
    names = {"line_id": n, "label": f"l{n}", "simhash": f"s{n}", "norm": f"n{n}", "words": f"w{n}", "block": f"block_{n}", "share": f"share_{n}"}
    return rows.select(*[F.col(c).alias(names[c]) for c in names if c in rows.columns])


def _centres(rows: DataFrame) -> DataFrame:
    """Per bucket the first line with its commonest hash: most near copies lie around such a line."""
    seen = rows.groupBy("block", "simhash").agg(F.count(F.lit(1)).alias("n"), F.min("line_id").alias("line_id"))
    return seen.groupBy("block").agg(F.max_by("line_id", F.struct("n", -F.col("line_id"))).alias("line_id"))


def _links_between(lines: DataFrame, distinct: DataFrame, df: DataFrame, id: str, text: str) -> DataFrame:
    """Pairs (a, b) of labels whose lines are linked in a bucket; ``lines``: block, line_id, simhash, label.

    Lines that face no near line of another label go first, by a semi-join. The others meet the centre of their bucket with
    their texts, which leaves few labels. Lines of labels that still differ meet in shares of the bucket. Every meeting
    decides by edits itself, so that links come out of it, however many near pairs there are.
    """
    apart = (F.col("la") != F.col("lb")) & _near("sa", "sb")
    together = F.col("block_a") == F.col("block_b")
    facing = written(
        _side(lines, "a").join(_side(lines, "b"), together & apart, "left_semi")
        .select(F.col("block_a").alias("block"), F.col("a").alias("line_id"), F.col("sa").alias("simhash"), F.col("la").alias("label")), "facing-lines",
    )
    texts = _line_texts(facing.select("line_id").distinct(), distinct, df, id, text).withColumn("words", _word_pairs("norm"))
    rows = written(facing.join(texts, "line_id"), "facing-texts")
    middle = rows.join(_centres(facing), ["block", "line_id"], "left_semi")
    met = written(_side(middle, "a").join(_side(rows, "b"), together & apart & _alike()).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "centre-links")
    merged = components(met)
    shares = facing.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / SHARE_LINES).cast("int").alias("shares"))
    left = rows.join(merged.withColumnRenamed("node", "label"), "label", "left").withColumn("label", F.coalesce("component", "label")).join(shares, "block")
    one = _side(left.withColumn("share", F.pmod(F.xxhash64("line_id"), F.col("shares")).cast("int")), "a")
    two = _side(left.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))), "b")
    once = (F.col("a") < F.col("b")) & apart & (_first_shared("sa", "sb") == F.shiftright("block_a", 26))
    rest = written(
        one.join(two, together & (F.col("share_a") == F.col("share_b")) & once & _alike()).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(),
        "label-links",
    )
    dropped(facing, rows)
    return met.unionByName(rest)


def line_links(distinct: DataFrame, df: DataFrame, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of lines, or of the components that the first links make, and the labels of the components of all.

    ``distinct``: line_id, simhash, key, key2 and the place (doc, line) of every distinct line of ``df``.
    """
    blocks = distinct.select("line_id", "simhash", F.explode(_block_keys()).alias("block"))
    buckets = written(
        blocks.groupBy("block").agg(
            F.min("line_id").alias("leader"), F.min_by("simhash", "line_id").alias("led"), F.max("line_id").alias("other"),
            F.max_by("simhash", "line_id").alias("last"), F.count(F.lit(1)).alias("n"),
        ).where((F.col("n") > 2) | (F.col("n") == 2) & _near("led", "last")), "line-buckets",
    )
    members = written(blocks.join(buckets.where("n > 2").select("block", "leader", "led"), "block").where("line_id <> leader"), "line-members")
    pairs = written(
        buckets.where("n = 2").select(F.col("leader").alias("a"), F.col("other").alias("b")).unionByName(
            members.where(_near("simhash", "led")).select(F.col("leader").alias("a"), F.col("line_id").alias("b"))
        ).distinct(), "line-pairs",
    )
    dropped(buckets)
    links = _similar(pairs, distinct, df, id, text)
    dropped(pairs)
    labels = components(links)
    labelled = written(
        members.join(labels.withColumnRenamed("node", "line_id"), "line_id", "left")
        .select("block", "line_id", "simhash", F.coalesce("component", "line_id").alias("label")), "line-labels",
    )
    dropped(members)
    mixed = labelled.groupBy("block").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("block")
    open_lines = written(labelled.join(mixed, "block", "left_semi"), "open-lines")
    dropped(labelled)
    more = _links_between(open_lines, distinct, df, id, text)
    dropped(open_lines)
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = joined_components(labels, more)
    return links, labels


def repeated_lines(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc``, ``line`` of every occurrence that is not the first of its group."""
    occ = written(occurrences(df, id, text), "line-occurrences")
    distinct = written(
        occ.groupBy("key", "key2").agg(F.min(F.struct("doc", "line")).alias("first"), F.max("simhash").alias("simhash"), F.count(F.lit(1)).alias("n"))
        .select("key", "key2", "first.doc", "first.line", "simhash", "n").withColumn("line_id", F.monotonically_increasing_id()), "distinct-lines",
    )
    _, labels = line_links(distinct, df, id, text)
    # Only lines that recur or are linked matter from here on.
    grouped = distinct.join(labels.withColumnRenamed("node", "line_id"), "line_id", "left").where("n > 1 OR component IS NOT NULL").select(
        "key", "key2", "doc", "line", F.coalesce("component", "line_id").alias("group")
    )
    first = grouped.groupBy("group").agg(F.min(F.struct("doc", "line")).alias("first"))
    kept = written(grouped.join(first, "group").select("key", "key2", F.col("first.doc").alias("kept_doc"), F.col("first.line").alias("kept_line")), "kept-lines")
    dropped(distinct)
    return occ.join(kept, ["key", "key2"]).where("doc <> kept_doc OR line <> kept_line").select("doc", "line")


def dedup_lines(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with its text less the repeated lines, ``n_lines`` and ``n_removed``."""
    gone = repeated_lines(df, id, text).groupBy("doc").agg(F.collect_set("line").alias("gone")).withColumnRenamed("doc", "__doc")
    rows = df.drop("n_lines", "n_removed")
    joined = rows.join(gone, rows[id].cast("bigint") == gone["__doc"], "left")
    # The lines come out of a generator: split once, then picked by their numbers.
    parted = joined.select("*", F.inline(F.array(F.struct(F.split(text, "\n").alias("__lines")))))
    numbers = F.sequence(F.lit(0), F.size("__lines") - 1)
    left = F.transform(F.array_except(numbers, "gone"), lambda i: F.get("__lines", i))
    return parted.select(
        *[F.when(F.col("gone").isNull(), F.col(text)).otherwise(F.array_join(left, "\n")).alias(text) if c == text else F.col(c) for c in rows.columns],
        F.coalesce(F.size("__lines"), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
    )
