"""Building blocks of the DuckDB statements that check the queries.

The statements are written independently of the Spark expressions: chunk boundaries, for
instance, are character offsets here and line numbers there.
"""

from __future__ import annotations

from chunkloom.functions.text import WHITESPACE
from chunkloom.plans.bridges import CODE_PROFILES, CODE_RULES, PROSE, QUESTION_FORMS, WEB
from chunkloom.profiles import (
    CLASS_SYMBOLS, COMMENT_STARTS, FUNCTION_SYMBOLS, IMPORT_EXTENSIONS, NAME_PATTERNS, Profile,
)

NL = "chr(10)"
NO_WORD = r"(?:^|$|[^\p{L}\p{N}_])"
WORD = r"[\p{L}\p{N}_]"
SCORE_SQL = [
    (2.0, rf"{NO_WORD}class\s+{WORD}"),
    (1.5, rf"{NO_WORD}(?:fun|def)\s+{WORD}"),
    (1.0, rf"{NO_WORD}(?:import|from)\s"),
    (1.0, rf"(?i){NO_WORD}(?:config|setup){NO_WORD}"),
    (1.5, rf"{NO_WORD}(?:Button|TextView|RecyclerView|Fragment){NO_WORD}"),
]
CUSTOM_VALIDATOR = rf"(?i){NO_WORD}(validate|check|assert)([A-Z][a-zA-Z]+)?{NO_WORD}"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(e: str) -> str:
    return f"trim({e}, {lit(WHITESPACE)})"


def preview(e: str, n: int) -> str:
    return f"CASE WHEN length({e}) > {n} THEN substr({e}, 1, {n}) || '...' ELSE {e} END"


def all_captures(e: str, patterns: list[str], group: int = 1) -> str:
    # DuckDB's expressions have no possessive quantifiers (and do not backtrack).
    plain = [p.replace("++", "+").replace("*+", "*") for p in patterns]
    lists = ", ".join(f"regexp_extract_all({e}, {lit(p)}, {group})" for p in plain)
    return f"list_concat({lists})" if len(patterns) > 1 else lists


def sorted_set(e: str) -> str:
    return f"list_sort(list_distinct({e}))"


def by_ext(ext: str, rules: dict[str, list[str]], build, other: str) -> str:
    cases = " ".join(
        f"WHEN {ext} IN ({', '.join(lit(n) for n in names.split())}) THEN {build(ps)}" for names, ps in rules.items()
    )
    return f"CASE {cases} ELSE {other} END"


def tags(pairs: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {lit(t)} END" for t, c in pairs) + "], lambda x: x IS NOT NULL)"


def joined(e: str, separator: str = ", ") -> str:
    return f"nullif(array_to_string({e}, {lit(separator)}), '')"


PROSE_FILES = "SELECT doc_id, source || '/' || doc_id || '.' || lang AS path, text AS content FROM documents"
WEB_FILES = (
    "SELECT regexp_replace(url, '^https?://', '') || '.html' AS path, replace(html, '>', '>' || chr(10)) AS content FROM pages"
)


def code_files(lang: str) -> str:
    ext, _, rules = CODE_RULES[lang]
    code = "replace(text, '. ', '.' || chr(10))"
    for pattern, form in rules:
        parts = form.replace("{1}", "\\1").replace("{2}", "\\2").split("\n")
        target = f" || {NL} || ".join(lit(p) for p in parts)
        code = f"regexp_replace({code}, {lit(pattern)}, {target}, 'g')"
    path = f"source || '/' || lower(regexp_extract(text, '^([A-Za-z]*)', 1)) || '_' || doc_id || '.{ext}'"
    return f"SELECT {path} AS path, {code} AS content FROM documents WHERE lang = '{lang}'"


def bodies(profile: Profile) -> str:
    """CTE tail: ``files`` to ``spans(path, content, bodies)``."""
    starts = []
    for p in profile.boundaries:
        gaps = f"list_transform(string_split_regex(content, {lit('(?m)' + p)}), lambda x: length(x))"
        hits = f"list_transform(regexp_extract_all(content, {lit('(?m)(' + p + ')')}, 1), lambda x: length(x))"
        starts.append((gaps, hits))
    gaps_and_hits = ", ".join(f"{g} AS g{i}, {h} AS m{i}" for i, (g, h) in enumerate(starts))
    offsets = ", ".join(
        f"list_transform(range(1, len(m{i}) + 1), lambda k: list_sum(g{i}[1:k]) + coalesce(list_sum(m{i}[1:k-1]), 0))"
        for i in range(len(starts))
    )
    merged = f"list_concat({offsets})" if len(starts) > 1 else offsets
    span = strip("substr(content, (b[k] + 1)::BIGINT, (coalesce(b[k + 1], length(content)) - b[k])::BIGINT)")
    return f"""
      parts AS (SELECT path, content, {gaps_and_hits} FROM files),
      starts AS (SELECT path, content, list_sort(list_distinct({merged})) AS b FROM parts),
      spans AS (SELECT path, content, list_filter(list_transform(range(1, len(b) + 1), lambda k: {span}),
                                         lambda s: length(s) > 100) AS bodies FROM starts)"""


SEPARATORS_SQL = f"[{NL} || {NL}, {NL}, '. ', ' ', '']"


def _separator(text: str, first: str) -> str:
    """Number of the first separator from ``first`` on that ``text`` holds; 5 is the cut into characters."""
    tests = " ".join(f"WHEN {first} <= {i} AND contains({text}, {SEPARATORS_SQL}[{i}]) THEN {i}" for i in range(1, 5))
    return f"CASE {tests} ELSE 5 END"


def _pieces(text: str, at: str) -> str:
    """``text`` cut before each separator, without empty pieces."""
    after = f"list_transform(string_split({text}, {SEPARATORS_SQL}[{at}])[2:], lambda x: {SEPARATORS_SQL}[{at}] || x)"
    return (
        f"CASE WHEN {at} = 5 THEN list_transform(range(1, length({text}) + 1), lambda k: substr({text}, k, 1)) "
        f"ELSE list_filter(list_concat([string_split({text}, {SEPARATORS_SQL}[{at}])[1]], {after}), lambda x: x <> '') END"
    )


def generic_split(source: str, size: int = 800, overlap: int = 100) -> str:
    """SELECT of ``(rid, path, bodies)``: the texts of ``source(rid, path, content)`` cut without regard to their content.

    ``nodes`` are texts cut at one separator; a piece that is too long becomes a node at the next one. Runs of short
    pieces are ``runs`` with their prefix sums ``l``. ``windows`` slides over a run: ``s`` is the first piece of a window,
    ``e`` the first one that no longer fits.
    """
    follow = "list_filter(range({k} + 1, n + 1), lambda j: l[j + 1] - l[{s}] > " + str(size) + ")[1]"
    start = (
        f"list_filter(range(s, e + 1), lambda j: l[e] - l[j] <= {overlap} AND (l[e] = l[j] OR l[e + 1] - l[j] <= {size}))[1]"
    )
    return f"""WITH RECURSIVE
      nodes AS (
        SELECT rid, path, []::BIGINT[] AS pos, sep, {_pieces('content', 'sep')} AS pieces
          FROM (SELECT *, {_separator('content', '1')} AS sep FROM {source})
        UNION ALL
        SELECT rid, path, list_append(pos, i) AS pos, sep, {_pieces('piece', 'sep')} AS pieces
          FROM (SELECT rid, path, pos, i, piece, {_separator('piece', 'finer')} AS sep
            FROM (SELECT rid, path, pos, sep + 1 AS finer, unnest(range(1, len(pieces) + 1)) AS i, unnest(pieces) AS piece
              FROM nodes WHERE sep < 5) WHERE length(piece) >= {size})),
      items AS (SELECT rid, path, pos, unnest(range(1, len(pieces) + 1)) AS i, unnest(pieces) AS piece FROM nodes),
      numbered_runs AS (SELECT *, count_if(length(piece) >= {size}) OVER (PARTITION BY rid, pos ORDER BY i) AS run FROM items),
      sums AS (SELECT *, sum(length(piece)) OVER (PARTITION BY rid, pos, run ORDER BY i)::BIGINT AS upto
        FROM numbered_runs WHERE length(piece) < {size}),
      runs AS (SELECT rid, path, pos, min(i) AS first, string_agg(piece, '' ORDER BY i) AS text,
          list_concat([0::BIGINT], list(upto ORDER BY i)) AS l, count(*) AS n FROM sums GROUP BY rid, path, pos, run),
      windows AS (
        SELECT *, 1::BIGINT AS s, {follow.format(k='1', s='1')} AS e FROM runs
        UNION ALL
        SELECT rid, path, pos, first, text, l, n, s2 AS s, {follow.format(k='e', s='s2')} AS e
          FROM (SELECT *, {start} AS s2 FROM windows WHERE e IS NOT NULL)),
      filled AS (SELECT rid, path, list_concat(pos, [first, s]) AS place,
          {strip('substr(text, l[s] + 1, l[coalesce(e, n + 1)] - l[s])')} AS piece FROM windows)
      SELECT rid, path, list(piece ORDER BY place) AS bodies FROM filled WHERE piece <> '' GROUP BY rid, path"""


def cut(profile: Profile) -> str:
    """CTE tail: ``spans`` to ``cut(path, is_semantic, chunk_index, body, content, has_prev_context, has_next_context)``."""
    return f"""{bodies(profile)},
      rest AS (SELECT row_number() OVER () AS rid, path, content FROM spans WHERE len(bodies) = 0 AND content <> ''),
      split_ AS (SELECT * FROM ({generic_split('rest')})),
      numbered AS (SELECT path, true AS is_semantic, bodies, unnest(range(1, len(bodies) + 1)) AS i FROM spans WHERE len(bodies) > 0
        UNION ALL SELECT path, false AS is_semantic, bodies, unnest(range(1, len(bodies) + 1)) AS i FROM split_),
      edges_ AS (SELECT path, is_semantic, i - 1 AS chunk_index, bodies[i] AS body,
                   coalesce(i > 1 AND length(bodies[i - 1]) > 100, false) AS has_prev_context,
                   coalesce(length(bodies[i + 1]) > 100, false) AS has_next_context,
                   right(bodies[i - 1], 100) AS before, substr(bodies[i + 1], 1, 100) AS after FROM numbered),
      cut AS (SELECT path, is_semantic, chunk_index, body, has_prev_context, has_next_context,
                CASE WHEN has_prev_context THEN '...' || before || {NL} || {NL} ELSE '' END || body ||
                CASE WHEN has_next_context THEN {NL} || {NL} || after || '...' ELSE '' END AS content FROM edges_)"""


def first_line(e: str) -> str:
    bad = " OR ".join(f"starts_with(l, {lit(s)})" for s in COMMENT_STARTS)
    line = (
        f"list_filter(list_transform(string_split({strip(e)}, {NL}), lambda l: {strip('l')}), "
        f"lambda l: l <> '' AND NOT ({bad}))[1]"
    )
    return preview(line, 80)


def validation_sql(profile: Profile, e: str) -> str:
    return tags([
        (tag, f"regexp_matches({e}, {lit(CUSTOM_VALIDATOR if '(?iU)' in p else p)})")
        for tag, p in profile.validation_patterns.items()
    ])


def any_word(e: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({e}, {lit(w)})" for w in words) + ")"


def dependency_sql(e: str) -> str:
    # JSON-free list handling: one CASE per stripped line, empties removed.
    token = (
        "CASE WHEN starts_with(l, 'import') AND contains(l, 'from') THEN nullif(regexp_extract(l, 'from\\s+([^\\s]+)', 1), '') "
        "WHEN starts_with(l, 'import') THEN nullif(string_split(list_filter(string_split_regex(replace(l, 'import ', ''), '\\s+'), "
        "lambda w: w <> '')[1], '.')[1], '') "
        "WHEN contains(l, 'require(') THEN nullif(regexp_extract(l, 'require\\([\"'']([^\"'']+)[\"'']', 1), '') END"
    )
    lines = f"list_transform(string_split({e}, {NL}), lambda l: {strip('l')})"
    return sorted_set(f"list_filter(list_transform({lines}, lambda l: {token}), lambda d: d IS NOT NULL)")


def chunks(profile: Profile, files: str) -> str:
    """Full CTE list ending in ``chunks``, the enriched chunk table of ``files`` (a SELECT)."""
    ext = "file_type"
    types = " ".join(
        f"WHEN regexp_matches(body, {lit(chr(92) + 'A(?:' + p[1:] + ')')}) THEN {lit(t)}"
        for t, ps in profile.chunk_types.items() for p in ps
    )
    names = by_ext(
        ext, NAME_PATTERNS,
        lambda ps: "coalesce(" + ", ".join(f"nullif(regexp_extract(body, {lit(p)}, 1), '')" for p in ps) + ")",
        "NULL",
    )
    points = [f"CASE WHEN regexp_matches(body, {lit(p)}) THEN {v} ELSE 0 END" for v, p in SCORE_SQL]
    points += [f"CASE WHEN length(body) > {n} THEN 0.5 ELSE 0 END" for n in (500, 1000)]
    text = f"CASE WHEN {ext} = 'py' THEN body ELSE content END"
    screens = ", ".join(
        f"nullif(regexp_extract({t}, {lit(p)}, 1), '')" for p in profile.screens for t in ("content", "path")
    ) or "NULL, NULL"
    components = ", ".join(f"nullif(regexp_extract(content, {lit(p)}, 1), '')" for p in profile.components) or "NULL, NULL"
    imports = ", ".join(lit(x) for x in IMPORT_EXTENSIONS)
    first = preview(f"string_split({strip('content')}, {NL})[1]", 80)

    def names_of(rules):
        return by_ext(ext, rules, lambda ps: sorted_set(all_captures("txt", ps)), "[]::VARCHAR[]")

    fields = by_ext(ext, profile.input_patterns, lambda ps: sorted_set(all_captures("content", ps)), "[]::VARCHAR[]")
    return f"""files AS ({files}),{cut(profile)},
      typed AS (SELECT *, path || '#' || chunk_index AS id, {text_ext('path')} AS file_type FROM cut),
      described AS (SELECT *, {text} AS txt,
          CASE WHEN NOT is_semantic THEN 'text' {types} ELSE 'other' END AS type,
          coalesce(CASE WHEN is_semantic THEN {names} END, {first_line('body')}) AS name,
          CASE WHEN is_semantic THEN {all_captures('body', CLASS_SYMBOLS)} ELSE [] END AS class_symbols,
          CASE WHEN is_semantic THEN {all_captures('body', FUNCTION_SYMBOLS)} ELSE [] END AS function_symbols,
          CASE WHEN is_semantic THEN ({' + '.join(points)})::DOUBLE END AS semantic_score,
          CASE WHEN is_semantic THEN length(body) END AS chunk_size,
          '[{profile.name.upper()}] From ' || string_split(path, '/')[-1] || ': ' || {first} AS summary,
          sha256(content) AS fingerprint,
          has_prev_context OR has_next_context AS has_context_overlap
        FROM typed),
      enriched AS (SELECT *,
          nullif(concat_ws(' > ', 'class:' || class_symbols[1], 'func:' || function_symbols[1]), '') AS chunk_hierarchy,
          coalesce({screens}) AS screen_name,
          coalesce({components}) AS component_name,
          {names_of(profile.function_patterns)} AS function_names,
          {names_of(profile.class_patterns)} AS class_names,
          CASE WHEN {ext} IN ({imports}) THEN {dependency_sql('content')} ELSE [] END AS dependencies,
          {fields} AS input_fields,
          {tags([(t, f"contains(lower(content), {lit(t.lower())})") for t in profile.ui_elements])} AS ui_elements,
          {validation_sql(profile, 'content')} AS validation_rules,
          {tags([(t, any_word('lower(content)', ws)) for t, ws in profile.indicator_words.items()])} AS business_logic_indicators
        FROM described),
      chunks AS (SELECT *, coalesce(screen_name <> '', false) OR len(class_names) > 0 OR len(function_names) > 0
          OR coalesce(component_name <> '', false) AS has_semantic_anchors FROM enriched)"""


def text_ext(e: str) -> str:
    return f"CASE WHEN contains({e}, '.') THEN lower(string_split({e}, '.')[-1]) ELSE '' END"


def dotted_ext(e: str) -> str:
    return f"lower(regexp_extract(string_split({e}, '/')[-1], '^\\.*[^.].*?(\\.[^.]*)$', 1))"


def prose(select: str) -> str:
    return f"WITH {chunks(PROSE, PROSE_FILES)} {select}"


def code(lang: str, select: str) -> str:
    return f"WITH {chunks(CODE_PROFILES[lang], code_files(lang))} {select}"


def web(select: str) -> str:
    return f"WITH {chunks(WEB, WEB_FILES)} {select}"


_CODE_COLUMNS = (
    "path, chunk_index, id, file_type, content, body, type, name, chunk_hierarchy, semantic_score, screen_name, "
    "component_name, function_names, class_names, dependencies, input_fields, ui_elements, validation_rules, "
    "business_logic_indicators, has_semantic_anchors"
)


def all_code(select: str) -> str:
    """The four code languages as one ``chunks`` table."""
    parts = [
        f"c_{lang} AS (SELECT * FROM (WITH {chunks(CODE_PROFILES[lang], code_files(lang))} SELECT {_CODE_COLUMNS} FROM chunks))"
        for lang in CODE_RULES
    ]
    union = " UNION ALL ".join(f"SELECT * FROM c_{lang}" for lang in CODE_RULES)
    return f"WITH {', '.join(parts)}, chunks AS ({union}) {select}"


def questions_cte() -> str:
    forms = "[" + ", ".join(lit(f) for f in QUESTION_FORMS) + "]"
    return (
        f"questions AS (SELECT conv_id * 1000 + turn AS question_id, conv_id, turn, "
        f"{forms}[((conv_id + turn) % {len(QUESTION_FORMS)}) + 1] || ' ' || text AS question FROM conversations WHERE role = 'user')"
    )


SQUARED = "list_sum(list_transform(range(1, len(a) + 1), lambda i: (a[i]::DOUBLE - b[i]::DOUBLE) * (a[i]::DOUBLE - b[i]::DOUBLE)))"


def topk_cte(query_ids: str, k: int, name: str = "hits", stored: str = "SELECT vec_id FROM embeddings") -> str:
    """``hits(query_id, vec_id, distance, rank)``; ``query_ids`` selects the vectors asked for, ``stored`` those searched."""
    return f"""pairs AS (SELECT q.vec_id AS query_id, s.vec_id, q.embedding AS a, s.embedding AS b
        FROM embeddings q CROSS JOIN embeddings s WHERE q.vec_id IN ({query_ids}) AND s.vec_id IN ({stored})),
      distances AS (SELECT query_id, vec_id, {SQUARED} AS distance FROM pairs),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM distances),
      {name} AS (SELECT query_id, vec_id, distance, rank FROM ranked WHERE rank <= {k})"""
