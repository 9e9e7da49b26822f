"""SQL for those queries of this subpackage that SQL can express. The others are tested against brute force."""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"

OP3 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>' || role || ' ' || text || '<|im_end|> ') + len(regexp_extract_all(text, '<\\*\|(im_start|im_end)\|>'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""

OP5 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, octet_length(b) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - i % 4 * 5 AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

OP6 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, least(a, min(b)) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.a = w.doc_id"""

OP9 = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, least(a, min(b)) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""

WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10 = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {WORDS} AS w FROM benchmark), d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda k: array_to_string(w[k:k + 9], ' ')) END) AS g FROM i),
size AS (SELECT DISTINCT len(string_split(g, ' ')) AS n FROM win),
place AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS k, w FROM d, size WHERE len(w) >= n),
hit AS (SELECT DISTINCT doc_id, k, n, item_id FROM (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM place) JOIN win USING (g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
own AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hit GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS t, unnest(range(0, len(w))) AS p FROM d), df AS (SELECT t, count(*) AS df FROM word GROUP BY t),
part AS (SELECT g, len(string_split(g, ' ')) AS n, unnest(string_split(g, ' ')) AS t, unnest(range(0, len(string_split(g, ' ')))) AS o FROM (SELECT DISTINCT g FROM win)),
rare AS (SELECT g, t, o FROM part LEFT JOIN df USING (t) QUALIFY row_number() OVER (PARTITION BY g ORDER BY coalesce(df, 0), o) = 1),
cand AS (SELECT DISTINCT g, doc_id, p - o AS k FROM rare JOIN word USING (t)),
close AS (SELECT c.g, c.doc_id, count(DISTINCT part.o) AS met, count(DISTINCT part.o) FILTER (p = c.k + part.o) AS there, any_value(n) AS n
  FROM cand c JOIN part ON part.g = c.g JOIN word ON word.doc_id = c.doc_id AND word.t = part.t AND abs(p - c.k - part.o) <= 2 GROUP BY c.g, c.doc_id, c.k HAVING met = any_value(n)),
near AS (SELECT doc_id, count(*) AS n_near FROM (SELECT g, doc_id FROM close GROUP BY g, doc_id HAVING max(there) < any_value(n)) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN own USING (doc_id) LEFT JOIN near USING (doc_id)"""


OP11 = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.r ORDER BY list_dot_product(q.x, v.x) DESC, v.vec_id NULLS LAST) AS INTEGER) AS rank, v.vec_id, CAST(list_dot_product(q.x, v.x) AS BIGINT) AS score
FROM v q JOIN v ON v.r <> q.r AND len(v.x) = len(q.x) WHERE q.vec_id % 50 = 0 QUALIFY rank <= 5"""


def _op12() -> str:
    """Six rounds, each an assignment and an update."""
    sound = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE {sound})",
        "p AS MATERIALIZED (SELECT r, part, x[part * (len(x) // 8) + 1 : (part + 1) * (len(x) // 8)] AS x FROM (SELECT r, x, unnest(range(0, 8)) AS part FROM v))",
        "c0 AS MATERIALIZED (SELECT part, r - 1 AS e, x AS c FROM p WHERE r <= 16)",
    ]
    for k in range(7):
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, p.part, any_value(x) AS x, min({{'d': list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))), 'e': e}}) AS m FROM p JOIN c{k} c ON c.part = p.part GROUP BY r, p.part)")
        if k < 6:
            steps.append(f"""u{k} AS (SELECT part, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (SELECT part, m.e AS e, i, sum(x[i]) AS s, count(*) AS n FROM (SELECT part, m, x, unnest(range(1, len(x) + 1)) AS i FROM a{k}) GROUP BY ALL) GROUP BY part, e)""")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.part, c.e, coalesce(u.c, c.c) AS c FROM c{k} c LEFT JOIN u{k} u ON u.part = c.part AND u.e = c.e)")
    steps.append("told AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a6 GROUP BY r)")
    return f"""
WITH {", ".join(steps)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) FROM c6) AS codebooks_sha256 FROM told JOIN v USING (r)"""


OP12 = _op12()
