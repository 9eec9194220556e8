"""DuckDB SQL for the operators that SQL can express; the others are tested against brute force."""

from __future__ import annotations

from quarry.llm import linededup, mixing, quality
from quarry.llm.common import LOWER, UPPER

BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {_quoted(pattern)}))"


_FAILS = " OR ".join(
    [
        f"{_count('x', r'[#*$%&<>{}=~^\\_]')} * 10 >= length(x)",
        f"({_count('x', r'[!?]{2,}')} >= 3 AND {_count('x', r'[!?]{2,}')} * 20 >= length(x))",
        f"({_count('x', quality.SEPARATORS)} >= 2 AND {_count('x', quality.SEPARATORS)} * 25 >= length(x))",
        f"(length(x) <= {quality.BOILERPLATE_CHARS} AND regexp_matches(x, {_quoted(quality.BOILERPLATE)}))",
        f"(length(x) <= {quality.FRAGMENT_CHARS} AND NOT regexp_matches(x, {_quoted(quality.TERMINAL)}))",
    ]
)

OP1 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {BLANKS}) <> '') AS lines FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t)),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS k FROM windows) WHERE k > 1) GROUP BY doc_id),
m AS (SELECT t.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, {_count("text", quality.SYMBOLS)}::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
  coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) AS chars, coalesce(list_sum(list_transform(list_filter(lines, lambda x: {_FAILS}), lambda x: length(x))), 0) AS lost
  FROM t LEFT JOIN repeated USING (doc_id)),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * lost <= {quality.MAX_LOST} * chars AS kept FROM b"""

LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
OP7 = rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM t)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_ AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(t.doc_id, coalesce(m, t.doc_id)) AS component_id, t.doc_id <= coalesce(m, t.doc_id) AS kept
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN least_ ON a = t.doc_id"""

_WEIGHTS = "[" + ", ".join(f"{float(w)}::DOUBLE" for w in mixing.WEIGHTS) + "]"
OP9 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, len({WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, {_WEIGHTS}[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1)::INT] AS weight FROM d GROUP BY source),
f AS (SELECT *, {mixing.CEILING}::DOUBLE * source_size AS most, {mixing.CEILING}::DOUBLE * source_size / weight AS fill FROM s),
l AS (SELECT *, ({mixing.SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM f),
g AS (SELECT *, arg_min(CASE WHEN fill > level THEN level END, CASE WHEN fill > level THEN fill END) OVER () AS met FROM l),
t AS (SELECT source, source_size, CASE WHEN met IS NULL THEN most ELSE least(most, met * weight) END AS target FROM g),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || text), 1, 8))::BIGINT / {float(mixing.DRAW_RANGE)}::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM r"""

OP10 = f"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, md5(coalesce(text, '')) AS th, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT row, doc_id, th, pos, line, translate(trim(line, {BLANKS}), '{UPPER}', '{LOWER}') AS key FROM (SELECT row, doc_id, th, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM t)),
k AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT (doc_id, th)) >= {linededup.MIN_DOCS})
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE key IN (SELECT key FROM k)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE key NOT IN (SELECT key FROM k)), '')) AS kept_sha256 FROM l GROUP BY row, doc_id"""

ORACLES = {"op1_quality_rules": OP1, "op7_minhash_dedup": OP7, "op9_mixing": OP9, "op10_line_dedup": OP10}
