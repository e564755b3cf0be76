"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from blockprism.llm.secrets import BASE, EXTRA

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP8 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
wins AS (SELECT doc_id, unnest(list_transform(range(0, len(w) - 34), lambda i: array_to_string(w[i + 1 : i + 35], ' '))) AS win, unnest(range(0, len(w) - 34)) AS p FROM d WHERE len(w) >= 35),
twice AS (SELECT win FROM wins GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, p + k AS i FROM (SELECT doc_id, p FROM wins SEMI JOIN twice USING (win)), (SELECT unnest(range(0, 35)) AS k)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM d),
kept AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY a.i) AS t, count(*) AS n FROM words a ANTI JOIN gone g ON g.doc_id = a.doc_id AND g.i = a.i GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

_FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP9 = f"""
WITH b AS (SELECT item_id, {_FOLDED} AS w FROM benchmark),
items AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, unnest(list_transform(range(0, len(w) - least(len(w), 10) + 1), lambda i: array_to_string(w[i + 1 : i + least(len(w), 10)], ' '))) AS win FROM b WHERE len(w) > 0),
d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
wins AS (SELECT doc_id, m, unnest(list_transform(range(0, len(w) - m + 1), lambda i: array_to_string(w[i + 1 : i + m], ' '))) AS win, unnest(range(0, len(w) - m + 1)) AS p FROM d, (SELECT DISTINCT m FROM items) WHERE len(w) >= m),
occ AS (SELECT doc_id, p, i.m, item_id FROM wins JOIN items i ON i.m = wins.m AND i.win = wins.win),
hit AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS i FROM occ) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM occ) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN found ON found.doc_id = d.doc_id
"""


def _matches(rank: int, rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, {rank} AS r, '{rule.kind}' AS kind, {rule.least} AS least, {rule.tail} AS tail, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS v FROM d WHERE regexp_matches(t, '{pattern}')"""


_BEFORE = "list_sum(list_transform(g[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0)"

OP6 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({' UNION ALL '.join(_matches(k, r) for k, r in enumerate(BASE + EXTRA))}),
each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found),
placed AS (SELECT doc_id, r, kind, ({_BEFORE})::BIGINT + CASE WHEN tail THEN length(m[i]) - length(v[i]) ELSE 0 END AS s, CASE WHEN tail THEN length(v[i]) ELSE length(m[i]) END AS n FROM each WHERE length(v[i]) >= least),
spans AS (SELECT doc_id, r, s, kind || ':' || s || ':' || (s + n) AS x FROM placed),
sums AS (SELECT doc_id, {', '.join(f"count(CASE WHEN r = {k} THEN 1 END) AS n_{r.kind}" for k, r in enumerate(BASE))}, string_agg(x, ',' ORDER BY s, r) FILTER (r < {len(BASE)}) AS base, string_agg(x, ',' ORDER BY s, r) AS all_ FROM spans GROUP BY 1)
SELECT d.doc_id, {', '.join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(all_, '') AS spans
FROM d LEFT JOIN sums ON sums.doc_id = d.doc_id
"""

ORACLES = {"op6_secrets": OP6, "op8_substring": OP8, "op9_decontaminate": OP9}
