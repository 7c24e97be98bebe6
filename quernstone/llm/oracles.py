"""DuckDB SQL for the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10ffff}}]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, coalesce({WORDS}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark),
s AS (SELECT item, w, least(10, len(w)) AS m FROM b WHERE len(w) > 0),
p AS (SELECT item, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM s),
q AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM p),
x AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM q) WHERE len(w) >= m),
h AS (SELECT doc_id, i, x.m, item FROM (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM x) x JOIN q ON q.m = x.m AND q.win = x.win),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM h) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0d]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, least(3, len(w)) AS k, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
r(doc_id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.node)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(node) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id"""

_BITS = "array_to_string(list_transform(regexp_extract_all(sha1(body), '.'), lambda h: right('000' || bin(instr('0123456789abcdef', h) - 1), 4)), '')"
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages), b AS (SELECT page_id, body, {_BITS} AS bits FROM p),
g AS (SELECT page_id, strlen(body) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('{UPPER}234567', 1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), '') AS payload_digest, min(page_id) OVER (PARTITION BY body) AS first_id FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM g"""


def _encoded(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


#: crc32 by bytes, over a table of 256 remainders that is built from the polynomial.
_CRC = "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS INT) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"
_HEAD = " || ".join(_encoded(c) for c in ("doc_id", "source", "lang", "n_chars"))
MERKLE = f"""
WITH RECURSIVE z AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS v FROM range(256) r(i))),
d AS (SELECT doc_id, lang, sha256({_HEAD} || {_encoded("text")}) AS leaf, CASE WHEN {_CRC} % 3 = 0 THEN sha256({_HEAD} || {_encoded(f"translate(text, '{UPPER}', '{LOWER}')")}) END AS shown FROM documents, z),
k AS (SELECT doc_id, leaf, coalesce(shown, leaf) AS shown, coalesce('=' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM d),
a(tree, lvl, r, n, h) AS (SELECT tree, 0, r, n, leaf FROM k UNION ALL SELECT tree, any_value(lvl) + 1, r // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY r)) FROM a WHERE n > 1 GROUP BY tree, r // 8),
s AS (SELECT tree, h, lvl AS height, row_number() OVER (ORDER BY tree) - 1 AS r, count(*) OVER () AS n FROM a WHERE n = 1),
b(lvl, r, n, h) AS (SELECT 0, r, n, h FROM s UNION ALL SELECT any_value(lvl) + 1, r // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY r)) FROM b WHERE n > 1 GROUP BY r // 8),
w AS (SELECT tree, lvl, r, n, h FROM a WHERE n > 1),
x AS (SELECT p.tree, p.lvl, p.r, string_agg(q.h, '' ORDER BY q.r) FILTER (q.r < p.r) AS lo, string_agg(q.h, '' ORDER BY q.r) FILTER (q.r > p.r) AS hi FROM w p JOIN w q ON p.tree = q.tree AND p.lvl = q.lvl AND p.r // 8 = q.r // 8 GROUP BY ALL),
y AS (SELECT p.lvl, p.r, string_agg(q.h, '' ORDER BY q.r) FILTER (q.r < p.r) AS lo, string_agg(q.h, '' ORDER BY q.r) FILTER (q.r > p.r) AS hi FROM b p JOIN b q ON p.lvl = q.lvl AND p.r // 8 = q.r // 8 WHERE p.n > 1 AND q.n > 1 GROUP BY ALL),
g(id, lvl, node, tree, r, proof) AS (SELECT row_number() OVER (), 0, shown, tree, r, '' FROM k UNION ALL SELECT id, g.lvl + 1, sha256(coalesce(lo, '') || node || coalesce(hi, '')), tree, g.r // 8, proof || coalesce(lo, '') || coalesce(hi, '') FROM g JOIN x USING (tree, lvl, r)),
i AS (SELECT row_number() OVER () AS id, k.* FROM k),
e AS (SELECT g.id, g.node, g.proof, s.r, s.h AS subroot FROM g JOIN s ON s.tree = g.tree AND s.height = g.lvl),
u(id, lvl, node, r, proof, subroot) AS (SELECT id, 0, node, r, proof, subroot FROM e UNION ALL SELECT id, u.lvl + 1, sha256(coalesce(lo, '') || node || coalesce(hi, '')), u.r // 8, proof || coalesce(lo, '') || coalesce(hi, ''), subroot FROM u JOIN y USING (lvl, r)),
o AS (SELECT h AS root, lvl FROM b WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified FROM i JOIN u USING (id) JOIN o ON o.lvl = u.lvl"""


def _centroids(rounds: int, k: int) -> str:
    """Plain k-means: every distance of every round."""
    far = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    parts = [
        "v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS j, x FROM v ORDER BY j LIMIT {k})",
    ]
    for t in range(rounds + 1):
        parts.append(f"a{t} AS (SELECT row, min(struct_pack(d := d, j := j)) AS best FROM (SELECT v.row, c.j, CAST({far} AS BIGINT) AS d FROM v, c{t} c) GROUP BY row)")
        if t < rounds:
            parts.append(f"m{t} AS (SELECT j, list(m ORDER BY i) AS x FROM (SELECT a.best.j AS j, i, CAST(floor(sum(v.x[i]) / count(*)) AS BIGINT) AS m FROM v JOIN a{t} a USING (row), range(1, 65) r(i) GROUP BY ALL) GROUP BY j)")
            parts.append(f"c{t + 1} AS (SELECT j, coalesce(m.x, c.x) AS x FROM c{t} c LEFT JOIN m{t} m USING (j))")
    last = f"SELECT vec_id, CAST(best.j AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.j) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM v JOIN a{rounds} USING (row) JOIN c{rounds} c ON c.j = best.j"
    return "WITH " + ",\n".join(parts) + "\n" + last


CENTROIDS = _centroids(3, 16)
