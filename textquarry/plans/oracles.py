"""Longer counterparts in DuckDB's SQL: splitters as recursive queries, word overlap, stems."""

from __future__ import annotations

from textquarry.operators import overlap as O

#: All that Python strips, as one SQL string.
_BLANK = " || ".join(f"chr({c})" for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))
_NL = "chr(10)"


def _kept(sep: str, text: str = "s") -> str:
    """Parts of a text that is cut before each separator."""
    return f"list_filter(list_concat([string_split({text}, {sep})[1]], list_transform(string_split({text}, {sep})[2:], lambda x: {sep} || x)), lambda x: x <> '')"


def _windows_sql(units: str, keys: str, size: str, overlap: int) -> str:
    """Windows over units (keys, i, p, z): wi(keys, first, e) and the pieces' texts, pt(keys, first, texto), as CTEs."""
    return f"""
w_un AS (SELECT {keys}, list(p ORDER BY i) AS ps, min(i) AS base, list_prepend(0, list(z ORDER BY i)) AS zs, any_value({size}) AS size FROM {units} GROUP BY {keys}),
w_cu AS (SELECT {keys}, list_prepend(0::BIGINT, list(c ORDER BY k)) AS t FROM (SELECT {keys}, k, sum(z) OVER (PARTITION BY {keys} ORDER BY k)::BIGINT AS c FROM (SELECT {keys}, unnest(zs[2:]) AS z, unnest(range(1, len(zs))) AS k FROM w_un)) GROUP BY {keys}),
w_ub AS (SELECT w_un.*, w_cu.t, len(w_cu.t) - 1 AS n FROM w_un JOIN w_cu USING ({keys})),
w_wi AS (SELECT {keys}, 0::BIGINT AS first, greatest(1, len(list_filter(t, lambda x: x <= size)) - 1)::BIGINT AS e FROM w_ub
  UNION ALL SELECT {keys}, f, greatest(f + 1, len(list_filter(t, lambda x: x <= t[f + 1] + size)) - 1)::BIGINT FROM
    (SELECT {keys}, t, size, least(e, len(list_filter(t, lambda x: x < greatest(t[e + 1] - {overlap}, t[e + 2] - size))))::BIGINT AS f FROM w_wi JOIN w_ub USING ({keys}) WHERE e < n)),
w_pt AS (SELECT {keys}, base + first AS ofs, trim(array_to_string(ps[first + 1:e], ''), {_BLANK}) AS texto FROM w_wi JOIN w_ub USING ({keys}))"""


def recursive_sql(source: str, size: int = 1000, overlap: int = 200) -> str:
    """CTEs that end in sp(doc_id, chunk_ix, texto): source (doc_id, texto) by the first separator that occurs."""
    seps = [f"{_NL} || {_NL}", _NL, "'. '", "' '"]
    level = "CASE " + " ".join(f"WHEN lvl <= {k} AND contains(s, {sep}) THEN {k}" for k, sep in enumerate(seps, 1)) + " ELSE 5 END"
    parts = "CASE k " + " ".join(f"WHEN {k} THEN {_kept(f'({sep})')}" for k, sep in enumerate(seps, 1)) + " ELSE string_split(s, '') END"
    return f"""
x_nd AS (SELECT doc_id, []::BIGINT[] AS path, texto AS s, 1 AS lvl FROM {source} WHERE texto <> ''
  UNION ALL SELECT doc_id, list_append(path, i), p, k + 1 FROM (SELECT doc_id, path, k, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, path, k, {parts} AS ps FROM (SELECT doc_id, path, s, {level} AS k FROM x_nd))) WHERE length(p) >= {size}),
x_pc AS (SELECT doc_id, path, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, path, {parts} AS ps FROM (SELECT doc_id, path, s, {level} AS k FROM x_nd))),
x_pr AS (SELECT doc_id, path, p, i, length(p) AS z, sum((length(p) >= {size})::INT) OVER (PARTITION BY doc_id, path ORDER BY i) AS run FROM x_pc),
x_ps AS (SELECT * FROM x_pr WHERE z < {size}),
{_windows_sql("x_ps", "doc_id, path, run", str(size), overlap)},
sp AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY list_append(path, ofs)) - 1)::INT AS chunk_ix, texto FROM w_pt WHERE texto <> '')"""


_SENTENCE = "[^.!?\\n]*[.!?\\n][.!? \\t\\r\\n\\f\\x0B]*|[^.!?\\n]+"
_CLAUSE = "[^,.;。？！]+[,.;。？！]?|[,.;。？！]"


def sentence_sql(source: str, size: int = 1024, overlap: int = 200) -> str:
    """CTEs that end in sp(doc_id, chunk_ix, texto): source (doc_id, texto, told) by sentences; told: tokens of the metadata."""
    ways = [_kept(f"({_NL} || {_NL} || {_NL})"), f"regexp_extract_all(s, '{_SENTENCE}')", f"regexp_extract_all(s, '{_CLAUSE}')", _kept("' '")]
    parts = "CASE " + " ".join(f"WHEN len({w}) > 1 THEN {w}" for w in ways) + " ELSE string_split(s, '') END"
    tokens = lambda s: f"greatest(1, length({s}) // 4)"
    return f"""
x_nd AS (SELECT doc_id, []::BIGINT[] AS path, texto AS s, {size} - told AS room FROM {source} WHERE texto <> ''
  UNION ALL SELECT doc_id, list_append(path, i), p, room FROM (SELECT doc_id, path, room, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, path, room, {parts} AS ps FROM x_nd WHERE {tokens("s")} > room))),
x_ps AS (SELECT doc_id, s AS p, path AS i, {tokens("s")} AS z, room FROM x_nd WHERE {tokens("s")} <= room),
{_windows_sql("x_ps", "doc_id", "room", overlap).replace("base + first AS ofs", "first AS ofs")},
sp AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY ofs) - 1)::INT AS chunk_ix, texto FROM w_pt WHERE texto <> '')"""


def _cv(w: str) -> str:
    """A word with a for its vowels and consonants as they are; y is one after a vowel and at the begin."""
    return f"regexp_replace(regexp_replace({w}, '(^|[aeiou])y', '\\1z', 'g'), '[aeiouy]', 'a', 'g')"


def _measure(w: str) -> str:
    return f"len(regexp_extract_all({_cv(w)}, 'a+[^a]+'))"


def _vowel(w: str) -> str:
    return f"contains({_cv(w)}, 'a')"


def _double(w: str) -> str:
    return f"(length({w}) > 1 AND right({w}, 1) = left(right({w}, 2), 1) AND right({_cv(w)}, 1) <> 'a')"


def _cvc(w: str) -> str:
    return f"(regexp_matches({_cv(w)}, '[^a]a[^a]$') AND right({w}, 1) NOT IN ('w', 'x', 'y'))"


def _less(w: str, n: int) -> str:
    return f"left({w}, length({w}) - {n})"


def _table(w: str, ends: dict[str, str]) -> str:
    """The longest suffix that a word has gives way, where a measure is left before it."""
    rows = [f"WHEN ends_with({w}, '{e}') THEN CASE WHEN {_measure(_less(w, len(e)))} > 0 THEN {_less(w, len(e))} || '{ends[e]}' ELSE {w} END" for e in sorted(ends, key=len, reverse=True)]
    return f"CASE {' '.join(rows)} ELSE {w} END"


def stems_sql(source: str) -> str:
    """CTEs that end in st(w, stem) of the distinct words of source (w)."""
    fixed = "CASE WHEN regexp_matches(x, '(at|bl|iz)$') THEN x || 'e' WHEN {d} AND right(x, 1) NOT IN ('l', 's', 'z') THEN {l} WHEN {m} = 1 AND {c} THEN x || 'e' ELSE x END"
    fixed = fixed.format(d=_double("x"), l=_less("x", 1), m=_measure("x"), c=_cvc("x"))
    four = []
    for e in sorted(O._STEP4, key=len, reverse=True):
        s = _less("v", len(e))
        more = f" AND regexp_matches({s}, '[st]$')" if e == "ion" else ""
        four.append(f"WHEN ends_with(v, '{e}') THEN CASE WHEN {_measure(s)} > 1{more} THEN {s} ELSE v END")
    return f"""
s0 AS (SELECT DISTINCT w FROM {source}),
s1 AS (SELECT w, CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {_less("w", 2)} WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {_less("w", 1)} ELSE w END AS v FROM s0),
s2 AS (SELECT w, v, CASE WHEN ends_with(v, 'eed') THEN NULL WHEN ends_with(v, 'ed') AND {_vowel(_less("v", 2))} THEN {_less("v", 2)} WHEN ends_with(v, 'ing') AND {_vowel(_less("v", 3))} THEN {_less("v", 3)} END AS x FROM s1),
s3 AS (SELECT w, CASE WHEN ends_with(v, 'eed') THEN CASE WHEN {_measure(_less("v", 3))} > 0 THEN {_less("v", 1)} ELSE v END WHEN x IS NOT NULL THEN {fixed} ELSE v END AS v FROM s2),
s4 AS (SELECT w, CASE WHEN ends_with(v, 'y') AND {_vowel(_less("v", 1))} THEN {_less("v", 1)} || 'i' ELSE v END AS v FROM s3),
s5 AS (SELECT w, {_table("v", O._STEP2)} AS v FROM s4),
s6 AS (SELECT w, {_table("v", O._STEP3)} AS v FROM s5),
s7 AS (SELECT w, CASE {' '.join(four)} ELSE v END AS v FROM s6),
s8 AS (SELECT w, CASE WHEN ends_with(v, 'e') AND ({_measure(_less("v", 1))} > 1 OR {_measure(_less("v", 1))} = 1 AND NOT {_cvc(_less("v", 1))}) THEN {_less("v", 1)} ELSE v END AS v FROM s7),
st AS (SELECT w, CASE WHEN {_measure("v")} > 1 AND {_double("v")} AND ends_with(v, 'l') THEN {_less("v", 1)} ELSE v END AS stem FROM s8)"""


def overlap_sql(pairs: str) -> str:
    """CTEs that end in ov(query_id, bleu, rouge_l) of pairs (query_id, resposta, referencia)."""
    grams = "SELECT query_id, n, {side} AS side, array_to_string(w[i:i + n - 1], ' ') AS g, count(*) AS c FROM (SELECT query_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT query_id, {col} AS w, unnest(range(1, 5)) AS n FROM bw)) GROUP BY ALL"
    return f"""
bw AS (SELECT query_id, list_filter(regexp_split_to_array(resposta, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array(referencia, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '') AS r FROM {pairs}),
gr AS ({grams.format(side="'a'", col="a")} UNION ALL {grams.format(side="'r'", col="r")}),
hi AS (SELECT query_id, n, sum(least(x.c, y.c)) AS hits FROM (SELECT * FROM gr WHERE side = 'a') x JOIN (SELECT * FROM gr WHERE side = 'r') y USING (query_id, n, g) GROUP BY ALL),
bn AS (SELECT query_id, a, r, n, coalesce(hits, 0) AS hits, greatest(1, len(a) - n + 1) AS total FROM (SELECT query_id, a, r, unnest(range(1, 5)) AS n FROM bw) LEFT JOIN hi USING (query_id, n)),
bl AS (SELECT query_id, CASE WHEN max(hits) FILTER (n = 1) = 0 THEN 0.0 ELSE (CASE WHEN any_value(len(a) > len(r)) THEN 1.0 ELSE exp(1 - any_value(len(r)) / any_value(len(a))) END) * exp(sum(ln((CASE WHEN hits = 0 THEN 0.1 ELSE hits END) / total) / 4)) END AS bleu FROM bn GROUP BY query_id),
rt AS (SELECT query_id, 'a' AS side, unnest(t) AS w, unnest(range(1, len(t) + 1)) AS i FROM (SELECT query_id, list_filter(regexp_split_to_array(lower(resposta), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM {pairs})
  UNION ALL SELECT query_id, 'r', unnest(t), unnest(range(1, len(t) + 1)) FROM (SELECT query_id, list_filter(regexp_split_to_array(lower(referencia), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM {pairs})),
rl AS (SELECT w FROM rt WHERE length(w) > 3),
{stems_sql("rl")},
rs AS (SELECT query_id, side, i, coalesce(stem, w) AS w FROM rt LEFT JOIN st USING (w)),
ln AS (SELECT query_id, count(*) FILTER (side = 'a') AS na, count(*) FILTER (side = 'r') AS nr FROM rs GROUP BY query_id),
lc AS (SELECT query_id, 0::BIGINT AS step, i, w, 0::BIGINT AS v FROM rs WHERE side = 'a'
  UNION ALL SELECT query_id, step, i, w, max(c) OVER (PARTITION BY query_id ORDER BY i) FROM
    (SELECT l.query_id, l.step + 1 AS step, l.i, l.w, CASE WHEN l.w = r.w THEN 1 + l.p ELSE l.v END AS c FROM (SELECT *, lag(v, 1, 0) OVER (PARTITION BY query_id ORDER BY i) AS p FROM lc) l JOIN (SELECT * FROM rs WHERE side = 'r') r ON r.query_id = l.query_id AND r.i = l.step + 1)),
lm AS (SELECT query_id, max(v) AS m FROM lc GROUP BY query_id),
ov AS (SELECT query_id, round(bleu, 6) AS bleu, round(CASE WHEN coalesce(m, 0) > 0 THEN 2 * m / (na + nr) ELSE 0 END, 6) AS rouge_l FROM bl LEFT JOIN ln USING (query_id) LEFT JOIN lm USING (query_id))"""
