"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from sparktoire.llm import quality

def _windows(n: int) -> str:
    """How often each window of ``n`` words is in its document."""
    return f"SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i + 1 : i + {n}], ' ')) AS c FROM p WHERE i + {n} <= n"


OP1 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, w, unnest(range(len(w))) AS i FROM d),
g5 AS ({_windows(5)}), gr AS ({_windows(quality.REPEAT_WORDS)}), gl AS ({_windows(quality.MAX_LONGEST_WORDS + 1)}),
c5 AS (SELECT doc_id, count(DISTINCT i + k) AS c FROM g5, range(5) r(k) WHERE c > 1 GROUP BY doc_id),
cr AS (SELECT doc_id, count(DISTINCT i + k) AS c FROM gr, range({quality.REPEAT_WORDS}) r(k) WHERE c > 1 GROUP BY doc_id),
cl AS (SELECT DISTINCT doc_id FROM gl WHERE c > 1),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d),
dl AS (SELECT doc_id, count(*) - count(DISTINCT x) AS c FROM l WHERE regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]') GROUP BY doc_id),
b AS (SELECT d.doc_id, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dl.c, 0) AS n_dup_lines,
        coalesce(c5.c, 0) AS n_repeat_words, coalesce(cr.c, 0) AS covered_words, cl.doc_id IS NOT NULL AS too_long
      FROM d LEFT JOIN dl USING (doc_id) LEFT JOIN c5 USING (doc_id) LEFT JOIN cr USING (doc_id) LEFT JOIN cl USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, covered_words,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * covered_words > {quality.MAX_COVERED_PERCENT} * n_words OR too_long) AS kept
FROM b
"""

OP5 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, CAST(octet_length(b) AS BIGINT) AS n FROM d),
w AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 100)) AS g FROM (SELECT doc_id, h, unnest(range(n - 49)) AS i FROM n WHERE n >= 50)),
f AS (SELECT g, min(doc_id) AS least FROM w GROUP BY g HAVING count(*) > 1),
g AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 50, true) AS head FROM w JOIN f USING (g) WHERE doc_id > least),
r AS (SELECT doc_id, i, sum(CAST(head AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
s AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS after FROM s),
t AS (SELECT n.doc_id, sum(k.b - k.a) AS removed, count(*) AS spans,
        string_agg(substr(n.h, 2 * k.before + 1, 2 * (k.a - k.before)), '' ORDER BY k.a) || substr(any_value(n.h), 2 * max(k.b) + 1) AS left_hex
      FROM n JOIN k USING (doc_id) GROUP BY n.doc_id)
SELECT n.doc_id, n.n AS n_bytes, CAST(coalesce(t.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(t.spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(t.left_hex, n.h))) AS kept_sha256
FROM n LEFT JOIN t USING (doc_id)
"""

OP2 = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM benchmark),
ds AS (SELECT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS s FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i + 1 : i + 5], ' ') AS s FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
x AS (SELECT doc_id, item_id, count(DISTINCT s) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles AS containment FROM x JOIN n USING (item_id) WHERE n_shared * 100 >= n_shingles * 80
"""

OP11 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS s FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, s AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, id AS negative_id, positive_score, s AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s AND 100 * s <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s DESC, id) QUALIFY row_number() OVER w <= 3
"""

OP12 = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
lab AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(lab.good, false) AS good, coalesce(lab.toxic, false) AS toxic,
        list_filter(['A', 'B', 'C', 'D', 'E'], lambda x, i: [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > least, false)][i]) AS fails
      FROM d LEFT JOIN lab USING (doc_id)),
l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
r AS (SELECT *, coalesce(list_min(list_transform(fails, lambda x: strpos(filter_order, x))), 6) AS gone FROM f, o),
s AS (SELECT part, filter_order, CAST(step AS INT) AS step, substr(filter_order, step, 1) AS letter,
        count(*) FILTER (gone > step) AS kept, count(*) FILTER (gone = step) AS removed, count(*) FILTER (gone < step AND list_contains(fails, substr(filter_order, step, 1))) AS redundant,
        count(*) FILTER (fails = [substr(filter_order, step, 1)]) AS unique_fails, count(*) FILTER (gone = step AND good) AS good_lost, count(*) FILTER (gone = step AND toxic) AS toxic_lost
      FROM r, generate_series(1, 5) g(step) GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM s
"""

ORACLES: dict[str, str] = {"op1_quality_rules": OP1, "op2_benchmark_decontamination": OP2, "op5_suffix_array_dedup": OP5, "op11_hard_negatives": OP11, "op12_filter_audit": OP12}
