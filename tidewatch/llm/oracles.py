"""DuckDB SQL for the queries that SQL can express."""

from .lines import LINES_SQL

SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
i AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p, len(w) AS n FROM d),
x AS (SELECT doc_id, p, n, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS h FROM i),
v AS (SELECT doc_id, p, h FROM x WHERE p <= n - 49),
m AS (SELECT h, min(doc_id) AS lo FROM v GROUP BY h),
c AS (SELECT DISTINCT doc_id, p + o AS p FROM v JOIN m USING (h), range(0, 50) t(o) WHERE doc_id > lo),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM i ANTI JOIN c USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

VECTOR_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT c.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""

JACCARD_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
i AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p, len(w) AS n FROM d),
x AS (SELECT doc_id, p, n, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) AS h FROM i),
s AS (SELECT DISTINCT doc_id, h FROM x WHERE p <= greatest(1, n - 4)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
q AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT q.a, q.b FROM q JOIN z x ON x.doc_id = q.a JOIN z y ON y.doc_id = q.b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT c.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, component_id FROM c LEFT JOIN z USING (doc_id)
"""

TRIE_SQL = r"""
WITH t AS (SELECT conv_id AS c, list({'r': coalesce(role, ''), 'x': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
s AS (SELECT c, own, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda k: [CAST(ascii(k) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])) AS steps FROM t),
k AS (SELECT c, own, xor(list_reduce(steps, lambda v, x: CASE WHEN x >= 0 THEN xor(v, x) ELSE xor(v >> 1, 3988292384 * (v & 1)) END, CAST(4294967295 AS BIGINT)), 4294967295) % 4 AS h FROM s),
v AS (SELECT k.c, list_concat(coalesce(b.own[1:h], []), k.own[h + 1:]) AS v FROM k LEFT JOIN t b ON b.c = k.c - k.c % 20),
p AS (SELECT c, len(v) AS n, d, CASE WHEN d > 0 THEN v[d].x ELSE '' END AS x, md5(CAST(to_json(v[1:d]) AS VARCHAR)) AS k, CASE WHEN d > 0 THEN md5(CAST(to_json(v[1:d - 1]) AS VARCHAR)) END AS up FROM v, LATERAL (SELECT unnest(range(0, len(v) + 1)) AS d)),
g AS (SELECT k, min(up) AS up, min(d) AS d, min(c) AS c, count(*) AS n, len(list_filter(regexp_split_to_array(min(x), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends FROM p GROUP BY 1),
m AS (SELECT g.k, count(b.k) AS kids FROM g LEFT JOIN g b ON b.up = g.k GROUP BY 1),
a AS (SELECT p.k, count(*) FILTER (m.kids = 0) AS leaves, sum((g.n - 1) * g.words) AS saved FROM g JOIN m ON m.k = g.k JOIN p ON p.c = g.c AND p.d <= g.d GROUP BY 1)
SELECT g.c AS conv_id, CAST(g.d AS BIGINT) AS depth, u.c AS parent_conv_id, CAST(g.n AS BIGINT) AS n_convs, CAST(m.kids AS BIGINT) AS n_children, CAST(a.leaves AS BIGINT) AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, g.ends AS ends_sha256
FROM g JOIN m ON m.k = g.k JOIN a ON a.k = g.k LEFT JOIN g u ON u.k = g.up
"""

ORACLES = {"op6_jaccard_join": JACCARD_SQL, "op7_substring_dedup": SUBSTRING_SQL, "op8_near_vectors": VECTOR_SQL, "op10_line_dedup": LINES_SQL, "op12_conversation_trie": TRIE_SQL}
