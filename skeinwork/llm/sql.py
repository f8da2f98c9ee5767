"""SQL over the same tables for the queries that SQL can express."""

P1_FOUND = "SELECT DISTINCT id FROM chunks WHERE length(content) > 2000"

P2_FOUND = """
WITH v AS (SELECT DISTINCT id, embedding::DOUBLE[] AS e FROM chunks
           WHERE len(embedding) = 64 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
near AS (SELECT a.id, b.id AS other, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.id <> b.id
         WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
top AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, other) AS r FROM near)
SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM top WHERE r <= 10
"""

P4_FOUND = r"""
WITH c AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(min(file_path), '[\\/]+', '/', 'g'), '/(\./)+', '/', 'g'), '^(\./)+', '') AS p,
                  regexp_extract_all(lower(min(content)), '[a-z0-9_]+') AS w FROM chunks GROUP BY id),
s AS (SELECT DISTINCT id, p, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT id, p, w, unnest(range(1, len(w) - 1)) AS i FROM c WHERE len(w) >= 20)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
m AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id < b.id AND a.p <> b.p GROUP BY ALL)
SELECT id_a, id_b FROM m JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE k >= 0.7 * (x.n + y.n - k)
"""

P4_GROUPS = r"""
WITH RECURSIVE c AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(trim(min(file_path)), '[\\/]+', '/', 'g'), '/(\./)+', '/', 'g'), '^(\./)+', '') AS p,
                  regexp_extract_all(lower(min(content)), '[a-z0-9_]+') AS w FROM chunks GROUP BY id),
s AS (SELECT DISTINCT id, p, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT id, p, w, unnest(range(1, len(w) - 1)) AS i FROM c WHERE len(w) >= 20)),
r AS (SELECT id, any_value(p) AS p, string_agg(g, chr(10) ORDER BY g) AS runs, count(*) AS n FROM s GROUP BY id),
q AS (SELECT id, p, n, min(id) OVER (PARTITION BY runs) AS class FROM r), k AS (SELECT class, min(p) AS low, max(p) AS high FROM q GROUP BY 1),
m AS (SELECT a.id AS x, b.id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id < b.id WHERE a.id IN (SELECT class FROM q) AND b.id IN (SELECT class FROM q) GROUP BY ALL),
l AS (SELECT x, y FROM m JOIN q a ON a.id = x JOIN q b ON b.id = y JOIN k ka ON ka.class = x JOIN k kb ON kb.class = y WHERE m.k >= 0.7 * (a.n + b.n - m.k) AND least(ka.low, kb.low) <> greatest(ka.high, kb.high)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l), walk AS (SELECT class AS x, class AS y FROM k UNION SELECT walk.x, e.y FROM walk JOIN e ON e.x = walk.y),
g AS (SELECT x AS class, min(y) AS "group" FROM walk GROUP BY 1), d AS (SELECT x AS class, count(*) AS links FROM e GROUP BY 1)
SELECT id, p AS place, q.class, g."group", coalesce(links, 0) AS links FROM q JOIN g ON g.class = q.class LEFT JOIN d ON d.class = q.class
"""

P7_FOUND = r"""
WITH f AS (SELECT id, max(path) AS path, max(language) AS language, max(line_count) AS line_count, max(symbol_count) AS symbol_count FROM files WHERE id IS NOT NULL GROUP BY id),
p AS (SELECT *, regexp_replace(regexp_replace(path, '[\\/]+', '/', 'g'), '^(\./)+', '') AS plain FROM f), q AS (SELECT *, lower(plain) AS low, split_part(plain, '/', -1) AS name FROM p),
t AS (SELECT file_id, string_split(content, chr(10)) AS l, content FROM source_texts WHERE content <> ''),
h AS (SELECT file_id, len(list_filter(list_filter(l, lambda x: trim(x, chr(13) || ' ' || chr(9)) <> '')[1:5], lambda x: regexp_matches(x, '^\s*(//|/\*|\*|#|--|;)') AND
   regexp_matches(x, '(?i)code generated by|do not edit|@generated\b|auto-?generated|automatically generated|generated (file|code|from|by)\b|(produced|created|written) by a tool|edits (are|will be) lost'))) > 0 AS tool,
   list_max(list_transform(l, lambda x: length(x))) >= 1000 AND length(content) / len(l) >= 200 AS packed FROM t)
SELECT id AS file_id FROM q LEFT JOIN h ON h.file_id = id
WHERE regexp_matches(low, '(^|/)(vendor|vendored|third[_-]?party|3rd[_-]?party|external|externals|node_modules|bower_components|deps|godeps|jspm_packages|site-packages|pods|carthage)/')
 OR EXISTS (SELECT 1 FROM vendor_catalog v WHERE v.file_name = name AND v.line_count = q.line_count AND (v.language = q.language OR q.language = 'unknown'))
 OR regexp_matches(low, '(^|/)(__generated__|generated|autogen|auto-generated|autogenerated|codegen-out|gen-out)/')
 OR regexp_matches(low, '(_pb2(_grpc)?\.pyi?|\.pb(\.gw)?\.(go|cc|h|rb|swift|dart|ts|js)|\.(g|gen|generated|designer|freezed)\.[a-z]+|[._-]gen\.[a-z]+|[._-]generated\.[a-z]+)$|(^|/)zz_generated\.[^/]*$|/migrations/\d+_auto_\d[^/]*$')
 OR regexp_matches(plain, '(^|/)Generated[A-Z_][^/]*\.[a-z]+$') OR coalesce(tool, false)
 OR regexp_matches(low, '([._-]min\.(m?js|cjs|css)|\.bundle\.(m?js|cjs|css)|\.[0-9a-f]{8,20}\.(m?js|css))$|(^|/)dist/chunk-[0-9a-f]{6,20}\.m?js$')
 OR (regexp_matches(low, '\.(m?js|cjs|css)$') AND (symbol_count >= 50 AND symbol_count >= 16 * line_count OR coalesce(packed, false)))
 OR (regexp_matches(low, '\.(ts|tsx|mts|cts|js|jsx|mjs|cjs|py|pyi|go|rs|rb|java|kt|c|cc|cpp|h|hpp|cs|php|swift|scala)$') AND line_count >= 5000 AND symbol_count <= 3)
"""

P7_HANDWRITTEN = f"SELECT id AS file_id, max(path) AS path FROM files WHERE id IS NOT NULL AND id NOT IN ({P7_FOUND}) GROUP BY id"


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p2_found": P2_FOUND, "p4_found": P4_FOUND, "p4_groups": P4_GROUPS, "p7_found": P7_FOUND, "p7_handwritten": P7_HANDWRITTEN}
