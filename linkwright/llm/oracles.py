"""DuckDB SQL for those corpus queries that it can express on whole tables in reasonable time.

op2, op3, op7, op8 and op10 rest on trained models, propagation, packing or a
tokenizer; op5's 200-byte windows at every byte are too slow there.  Those are tested
against brute force.
"""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE = r"[^\x20\x09-\x0D]+"
_LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWERED}, '{ALNUM}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWERED}, '{ALNUM}') AS w FROM benchmark),
bw AS (SELECT item, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
       FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT rid, dw.n, i, item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hits AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, n, i FROM found)) GROUP BY rid),
items AS (SELECT rid, list_sort(list(DISTINCT item)) AS items FROM found WHERE item IS NOT NULL GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (rid) LEFT JOIN items USING (rid)
"""

OP4 = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
q AS (SELECT vec_id AS query_id, min(e) AS e FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id),
s AS (SELECT query_id, rid, vec_id, list_reduce(list_transform(list_zip(q.e, v.e), lambda x: x[1] * x[2]), lambda a, b: a + b) AS score
      FROM q JOIN v ON len(q.e) = len(v.e) AND v.vec_id <> q.query_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id, rid) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{SPACE}') AS w FROM documents),
win AS (SELECT rid, doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS x
        FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
least_doc AS (SELECT x, min(doc_id) AS first_doc FROM win GROUP BY x),
gone AS (SELECT rid, list(DISTINCT p) AS gone FROM (SELECT rid, unnest(range(i, i + 50)) AS p FROM win JOIN least_doc USING (x) WHERE first_doc < doc_id) GROUP BY rid),
kept AS (SELECT rid, doc_id, len(w) AS n, coalesce(len(gone), 0) AS g,
           CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END AS kept
         FROM d LEFT JOIN gone USING (rid))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(g AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM kept
"""

OP9 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWERED}, '{SPACE}') AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(list_slice(w, i, i + 3), ' ') || '|' || least(len(w), 4) AS x
      FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
common AS (SELECT a.rid AS p, b.rid AS q, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.rid < b.rid GROUP BY a.rid, b.rid),
links AS (SELECT p, q FROM common JOIN n np ON np.rid = p JOIN n nq ON nq.rid = q WHERE 100 * c >= 85 * (np.n + nq.n - c)),
edges AS (SELECT p, q FROM links UNION ALL SELECT q, p FROM links),
reach(rid, other) AS (SELECT rid, rid FROM d UNION SELECT r.rid, e.q FROM reach r JOIN edges e ON e.p = r.other),
least_doc AS (SELECT r.rid, min(d.doc_id) AS component_id FROM reach r JOIN d ON d.rid = r.other GROUP BY r.rid)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id FROM d JOIN least_doc USING (rid) LEFT JOIN n USING (rid)
"""

ORACLES = {"op1_decontaminate": OP1, "op4_vptree": OP4, "op6_substring_dedup": OP6, "op9_jaccard_join": OP9}
