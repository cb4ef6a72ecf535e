"""SQL (DuckDB's) that says what some of the operators say, in the plainest way, for tables small enough for it."""

from __future__ import annotations

from .common import LOWER, UPPER
from .licenses import COPYLEFT, RESTRICTED, RULES, SENTENCES, SPDX, normalise
from .quality_rules import GRID

_FOLDED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(items: list[str]) -> str:
    return "[" + ", ".join(map(_text, items)) + "]"


#: All pairs that share a shingle, compared; then everything that can be reached from each document.
NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_FOLDED}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i:i + 1]) WHEN len(w) = 1 THEN [w] ELSE [] END) AS x FROM w),
n AS (SELECT w.doc_id, count(s.x) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY u, v),
e AS (SELECT u, v FROM p JOIN n AS m ON m.doc_id = u JOIN n AS o ON o.doc_id = v WHERE 100 * common >= 80 * (m.n + o.n - common)),
r AS (SELECT doc_id AS u, doc_id AS v FROM n UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
c AS (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)"""

#: Every window of every document joined with every window of every item.
DECONTAMINATION = rf"""
WITH split AS (SELECT doc_id AS id, true AS doc, {_FOLDED} AS t FROM documents UNION ALL SELECT item_id, false, {_FOLDED} FROM benchmark),
w AS (SELECT id, doc, list_filter(regexp_split_to_array(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM split),
k AS (SELECT DISTINCT least(13, len(w)) AS n FROM w WHERE NOT doc AND len(w) > 0),
i AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda p: w[p:p + least(13, len(w)) - 1])) AS x FROM w WHERE NOT doc AND len(w) > 0),
d AS (SELECT id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM w JOIN k ON len(w) >= n WHERE doc),
h AS (SELECT d.id, d.n, d.p, i.id AS item FROM d JOIN i ON d.w[d.p:d.p + d.n - 1] = i.x),
c AS (SELECT id, count(DISTINCT q) AS n_hit FROM (SELECT id, unnest(range(p, p + n)) AS q FROM h) GROUP BY id),
t AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, CAST(item AS VARCHAR) AS item FROM h) GROUP BY id)
SELECT w.id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM w LEFT JOIN c ON w.id = c.id LEFT JOIN t ON w.id = t.id WHERE doc"""


def quality_rules(alpha: float = 0.02, delta: float = 0.05) -> str:
    p = alpha / len(GRID)
    score = {"symbol_share": "n_symbols / word_chars", "dup_line_share": "n_dup_lines / n_lines", "repeat_word_share": "n_repeat_words / n_words", "mean_word_chars": "word_chars / n_words"}
    scores = ", ".join(f"CASE WHEN {s.split(' / ')[1]} = 0 THEN 0 ELSE {s.split(' / ')[0]}::DOUBLE / {s.split(' / ')[1]} END AS {r}" for r, s in score.items())
    grid = ", ".join(f"('{r}', {x}::DOUBLE)" for r, xs in GRID.items() for x in xs)
    value = "CASE rule " + " ".join(f"WHEN '{r}' THEN {r}" for r in GRID) + " END"
    failed = ", ".join(f"CASE WHEN {r} > {r}_cutoff THEN '{r}' END" for r in GRID)
    cuts = ", ".join(f"max(cutoff) FILTER (rule = '{r}') AS {r}_cutoff" for r in GRID)
    return rf"""
WITH w AS (SELECT doc_id, lang AS stratum, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS x FROM w WHERE len(w) >= 3),
f AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS q FROM f) GROUP BY doc_id),
m AS (SELECT w.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(r.n, 0) AS n_repeat_words FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
b AS (SELECT * EXCLUDE (lines), CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
s AS (SELECT *, {scores} FROM b),
held AS (SELECT DISTINCT s.* FROM s SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) l ON s.doc_id = l.doc_id WHERE NOT base_failed),
c AS (SELECT stratum, rule, cutoff, count(*) AS n, count(*) FILTER ({value} > cutoff) AS k FROM held, (VALUES {grid}) AS grid(rule, cutoff) GROUP BY ALL),
q AS (SELECT *, (SELECT count(*) FROM (SELECT DISTINCT stratum, rule FROM c)) AS tests FROM c),
z AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM q WHERE k <= n * {p} AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p})))) <= {delta} / tests GROUP BY stratum, rule),
y AS (SELECT stratum AS of_stratum, {cuts} FROM z GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, stratum, failed_rules
FROM (SELECT *, array_to_string(list_filter([{failed}], lambda x: x IS NOT NULL), ',') AS failed_rules FROM s LEFT JOIN y ON stratum IS NOT DISTINCT FROM of_stratum)"""


def licenses() -> str:
    known = sorted({(normalise(s), i) for i, ss in SENTENCES.items() for s in ss})
    names = "map(" + _list([s for s, _ in known]) + ", " + _list([i for _, i in known]) + ")"
    # dots that no digit follows, then all other noise
    clean = lambda c: rf"trim(regexp_replace(regexp_replace(regexp_replace({c}, '\.+([^0-9.]|$)', ' \1', 'g'), '\.\.+', ' .', 'g'), '[\x00-\x2D\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'))"
    ids = lambda pattern: f"list_filter(list_transform(regexp_split_to_array(t, '{pattern}'), lambda x: k[{clean('x')}]), lambda x: x IS NOT NULL)"
    ends = r"[.!?;:]+[\x20\x09-\x0D]+|"
    rules = ", ".join(f"CASE WHEN {' OR '.join(f'regexp_matches({c}, {_text(''.join(f',{i},.*' if k == len(r) - 1 else f',{i}(?:,.*)?' for k, i in enumerate(r)))})' for c in ('a', 'b'))} THEN {_text(name)} END" for name, r in RULES)
    held = lambda x: f"list_has_any(l, {_list(x)})"
    return rf"""
WITH t AS (SELECT doc_id, replace({_FOLDED}, '{SPDX}', '{SPDX[:-1]} ') AS t, {names} AS k FROM documents),
x AS (SELECT doc_id, {ids(ends + '[\n\r]+')} AS by_line, CASE WHEN contains(t, chr(10)) THEN {ids(ends + r'\n[\x20\x09-\x0D]*\n')} ELSE [] END AS by_text FROM t),
s AS (SELECT *, ',' || array_to_string(by_line, ',') || ',' AS a, ',' || array_to_string(by_text, ',') || ',' AS b, CASE WHEN len(by_text) > len(by_line) THEN by_text ELSE by_line END AS best FROM x),
r AS (SELECT doc_id, best, list_sort(list_distinct(list_filter([{rules}], lambda x: x IS NOT NULL))) AS l FROM s)
SELECT doc_id, CAST(len(best) AS BIGINT) AS n_known, array_to_string(best, ',') AS sentence_ids, array_to_string(l, ',') AS licenses,
    CASE WHEN len(l) = 0 THEN 'none' WHEN {held(RESTRICTED)} THEN 'restricted' WHEN {held(COPYLEFT)} THEN 'copyleft' ELSE 'permissive' END AS license_class FROM r"""


SQL = {
    "op1_minhash_near_dedup": NEAR_DUPLICATES,
    "op3_winnowing_decontamination": DECONTAMINATION,
    "op5_quality_rules": quality_rules(),
    "op6_license_scan": licenses(),
}
