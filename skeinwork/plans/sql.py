"""SQL over the same tables for the queries of the core."""

from skeinwork.plans import data, graph, index, inputs, store, text

COCHANGE_PARTS = """
WITH s AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS i FROM lineitem),
k AS (SELECT g FROM s GROUP BY g HAVING count(*) BETWEEN 2 AND 20)
SELECT a.i AS item_a, b.i AS item_b, count(*) AS together
FROM s a JOIN s b ON a.g = b.g AND a.i < b.i SEMI JOIN k ON a.g = k.g GROUP BY ALL HAVING count(*) >= 2
"""

_P3 = r"""
WITH e AS (SELECT DISTINCT session_id, project_id, id, data, CASE WHEN timestamp < 100000000000 THEN timestamp * 1000 ELSE timestamp END AS ts,
             CASE WHEN coalesce(trim(type), '') = '' THEN 'unknown' ELSE regexp_replace(lower(trim(replace(type, '-', '_'))), '\s+', '_', 'g') END AS type,
             coalesce(try_cast(regexp_extract(data, '"tokens"\s*:\s*"?([0-9]+)\s*[",}]', 1) AS BIGINT), 0) AS tokens FROM telemetry_events),
r AS (SELECT CASE WHEN timestamp < 100000000000 THEN timestamp * 1000 ELSE timestamp END AS ts FROM telemetry_events),
w AS (SELECT ts // 604800000 AS week, count(*) AS n, max(ts) AS last FROM r GROUP BY 1),
now AS (SELECT max(last) AS now FROM w WHERE n >= (SELECT avg(n) FROM w) / 20),
l AS (SELECT session_id, type, CAST(count(*) AS BIGINT) AS n, (SELECT now FROM now) - max(ts) FILTER (WHERE ts <= (SELECT now FROM now)) AS since_ms,
             CAST(sum(tokens) AS BIGINT) AS tokens, max(project_id) AS project_id FROM e WHERE session_id IS NOT NULL GROUP BY 1, 2)
"""

P3_LONG = _P3 + "SELECT session_id, max(project_id) OVER (PARTITION BY session_id) AS project_id, type, n, since_ms, tokens FROM l"

_P3_WIDE = (
    _P3
    + """
, p AS (SELECT session_id, max(project_id) AS project_id FROM l GROUP BY 1)
SELECT p.session_id, p.project_id, COLUMNS_BY_TYPE FROM p JOIN l ON l.session_id = p.session_id GROUP BY 1, 2
"""
)


def p3_features(folder: str) -> str | None:
    """The wide form, its columns written out from the types in a folder's events; None without them. (A PIVOT that finds
    its columns itself cannot be stored as a view.)"""
    import os

    import duckdb

    at = f"{folder}/telemetry_events.parquet"
    if not os.path.exists(at):
        return None
    kind = "CASE WHEN coalesce(trim(type), '') = '' THEN 'unknown' ELSE regexp_replace(lower(trim(replace(type, '-', '_'))), '\\s+', '_', 'g') END"
    with duckdb.connect() as con:
        found = con.execute(f"SELECT DISTINCT {kind} AS t FROM read_parquet('{at + '/*.parquet' if os.path.isdir(at) else at}') WHERE session_id IS NOT NULL ORDER BY 1").fetchall()
    cols = []
    for (t,) in found:
        one, name = f"FILTER (WHERE l.type = '{t.replace(chr(39), chr(39) * 2)}')", t.replace('"', '""')
        cols.append(f'coalesce(max(n) {one}, 0) AS "{name}__n", max(since_ms) {one} AS "{name}__since_ms", coalesce(max(tokens) {one}, 0) AS "{name}__tokens"')
    return _P3_WIDE.replace("COLUMNS_BY_TYPE", ", ".join(cols)) if cols else None


#: Tables whose event types the SQL of ``p3_features`` names as columns.
TYPES_FROM = "/root/testdata/sf0.01"

_LEVELS = """CASE WHEN w IN ('debug', 'dbg', 'trace', 'd', '20', '10') THEN 'DEBUG' WHEN w IN ('info', 'notice', 'i', '30') THEN 'INFO' WHEN w IN ('warn', 'warning', 'w', '40') THEN 'WARN'
  WHEN w IN ('error', 'err', 'fatal', 'critical', 'e', 'f', '50') THEN 'ERROR' ELSE '' END"""
_US = "epoch_us(CAST({} AS TIMESTAMPTZ)) // 1000"
_ISO = "replace(replace(t, ',', '.'), 'T', ' ')"

_P6 = (
    r"""
WITH l AS (SELECT DISTINCT line_id, log_name, line_no, regexp_replace(regexp_replace(message, chr(27) || '\[[0-9;?]*[A-Za-z]', '', 'g'), '\r+$', '') AS m FROM forge_log),
b AS (SELECT *, regexp_replace(m, '"(?:[^"\\]|\\.)*"', '""', 'g') AS q FROM l),
k AS (SELECT *, CASE WHEN regexp_matches(m, '^\d{9,10}\.\d+ [A-Z]/\w+\([ \d]+\): ') THEN 1 WHEN regexp_matches(m, '^\d+/\w+/\d+:\d+:\d+:\d+ [+-]\d{4} \w+ - ') THEN 2
  WHEN regexp_matches(m, '^\[\d+-\d+-\d+ \d+:\d+:\d+,\d+\] \[\w+\] \w+: ') THEN 3 WHEN regexp_matches(m, '^\d+-\d+-\d+T\d+:\d+:\d+\.\d+Z \w+ \[\w+\] ') THEN 4
  WHEN regexp_matches(m, '^\d+-\d+-\d+T\d+:\d+:\d+\.\d+[+-]\d\d:?\d\d \w+ +\w+ \| ') THEN 5 WHEN regexp_matches(m, '^[A-Z]\d{4} \d+:\d+:\d+\.\d+ +\d+ \w+\.\w+:\d+\] ') THEN 6
  WHEN regexp_matches(m, '^\w+=\d+-\d+-\d+T\S+Z ') THEN 7 WHEN regexp_matches(m, '^\d+-\d+-\d+ \d+:\d+:\d+,\d+ - \w+\.\w+ - \w+ - ') THEN 8
  WHEN regexp_matches(m, '^[A-Z][a-z]{2} +\d+ \d+:\d+:\d+ \S+ \S+\[\d+\]: <\w+> ') THEN 9 WHEN regexp_matches(m, '^\{"') AND regexp_matches(m, '"(time|ts)" ?: ?"?[0-9]') THEN 10
  WHEN regexp_matches(m, '^\d+-\d+-\d+ \d+:\d+:\d+\.\d+ \w+ +\w+ ') THEN 11 END AS k FROM b),
f AS (SELECT *, CASE k WHEN 1 THEN regexp_extract(m, '^([0-9.]+)', 1) WHEN 2 THEN regexp_extract(m, '^(\S+ \S+)', 1) WHEN 3 THEN regexp_extract(m, '^\[([^\]]+)\]', 1) WHEN 6 THEN regexp_extract(m, '^.(\d{4} [0-9:.]+)', 1)
   WHEN 7 THEN regexp_extract(m, '^\w+=(\S+)', 1) WHEN 8 THEN regexp_extract(m, '^(\S+ \S+)', 1) WHEN 9 THEN regexp_replace(regexp_extract(m, '^(\w+ +\d+ [0-9:]+)', 1), ' +', ' ', 'g') WHEN 10 THEN regexp_extract(m, '"(?:time|ts)" ?: ?"?([0-9][^",}]*)', 1)
   WHEN 11 THEN regexp_extract(m, '^(\S+ \S+)', 1) ELSE regexp_replace(regexp_extract(m, '^(\S+)', 1), '([+-]\d\d)(\d\d)$', '\1:\2') END AS t,
  CASE k WHEN 1 THEN regexp_extract(m, '\): ?(.*)$', 1) WHEN 2 THEN regexp_extract(m, ' - (.*)$', 1) WHEN 3 THEN regexp_extract(m, '\] \w+: ?(.*)$', 1) WHEN 4 THEN regexp_extract(m, '\] ?(.*)$', 1) WHEN 5 THEN regexp_extract(m, ' \| ?(.*)$', 1)
   WHEN 6 THEN regexp_extract(m, ':\d+\] ?(.*)$', 1) WHEN 7 THEN regexp_extract(m, '(?:^| )msg="((?:[^"\\]|\\.)*)"', 1) WHEN 8 THEN regexp_extract(m, '^\S+ \S+ - \S+ - \w+ - ?(.*)$', 1) WHEN 9 THEN regexp_extract(m, '<\w+> ?(.*)$', 1)
   WHEN 10 THEN regexp_extract(m, '"(?:msg|message)" ?: ?"((?:[^"\\]|\\.)*)"', 1) ELSE regexp_extract(m, '^\S+ \S+ \w+ +\w+ ?(.*)$', 1) END AS rest,
  lower(CASE k WHEN 1 THEN regexp_extract(m, '^\S+ ([A-Z])/', 1) WHEN 2 THEN '' WHEN 3 THEN regexp_extract(m, '\] \[(\w+)\]', 1) WHEN 6 THEN left(m, 1) WHEN 7 THEN regexp_extract(q, ' level=(\w+)', 1) WHEN 8 THEN regexp_extract(m, ' - \S+ - (\w+) - ', 1)
   WHEN 9 THEN regexp_extract(m, ': <(\w+)>', 1) WHEN 10 THEN regexp_extract(m, '"level" ?: ?"?(\w+)', 1) WHEN 11 THEN regexp_extract(m, '^\S+ \S+ (\w+)', 1) ELSE regexp_extract(m, '^\S+ (\w+)', 1) END) AS w,
  lower(CASE k WHEN 1 THEN regexp_extract(m, '/(\w+)\(', 1) WHEN 2 THEN regexp_extract(m, '^\S+ \S+ (\w+)', 1) WHEN 3 THEN regexp_extract(m, '\] (\w+): ', 1) WHEN 4 THEN regexp_extract(m, '\[(\w+)\]', 1) WHEN 5 THEN regexp_extract(m, '^\S+ \w+ +(\w+)', 1) WHEN 6 THEN regexp_extract(m, ' +\d+ (\w+)\.\w+:\d+\]', 1)
   WHEN 7 THEN regexp_extract(q, ' component=(\S+)', 1) WHEN 8 THEN regexp_extract(m, ' - \w+\.(\w+) - ', 1) WHEN 9 THEN regexp_extract(m, '-(\w+)\[\d+\]: ', 1) WHEN 10 THEN regexp_extract(m, '"(?:component|logger)" ?: ?"(?:\w+\.)*(\w+)"', 1) WHEN 11 THEN regexp_extract(m, '^\S+ \S+ \w+ +(\w+)', 1) END) AS component FROM k),
s AS (SELECT line_id, log_name, line_no, component, m, rest, """
    + _LEVELS
    + " AS level, CASE WHEN k = 1 THEN CAST(floor(CAST(t AS DECIMAL(20, 3)) * 1000) AS BIGINT) WHEN k = 2 THEN epoch_us(strptime(t, '%d/%b/%Y:%H:%M:%S %z')) // 1000 WHEN k = 6 THEN epoch_us(strptime('2026' || left(t, 17), '%Y%m%d %H:%M:%S.%g')) // 1000"
    + " WHEN k = 9 THEN epoch_us(strptime('2026 ' || t, '%Y %b %d %H:%M:%S')) // 1000 WHEN k = 10 AND regexp_matches(t, '^[0-9]+$') THEN CAST(t AS BIGINT) WHEN k IS NOT NULL THEN "
    + _US.format(f"CASE WHEN regexp_matches(t, '(Z|[+-]\\d\\d:\\d\\d)$') THEN {_ISO} ELSE {_ISO} || 'Z' END")
    + """ END AS ts_ms FROM f),
n AS (SELECT *, max(CASE WHEN ts_ms IS NOT NULL THEN line_no END) OVER (PARTITION BY log_name ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS start FROM s)
"""
)
_P6_COLUMNS = "min_by(line_id, line_no) AS first_line_id, max_by(line_id, line_no) AS last_line_id, max(ts_ms) AS ts_ms, min_by(level, line_no) AS level, min_by(component, line_no) AS component"
P6_FOUND = f"{_P6} SELECT {_P6_COLUMNS} FROM n WHERE start IS NOT NULL GROUP BY log_name, start"
P6_ENTRIES = f"{_P6} SELECT log_name, {_P6_COLUMNS}, string_agg(CASE WHEN ts_ms IS NULL THEN coalesce(m, '') ELSE rest END, chr(10) ORDER BY line_no) AS message FROM n WHERE start IS NOT NULL GROUP BY log_name, start"


def oracle_sql() -> dict[str, str]:
    wide = p3_features(TYPES_FROM)
    own = {"cochange_parts": COCHANGE_PARTS, "p3_long": P3_LONG, "p6_found": P6_FOUND, "p6_entries": P6_ENTRIES} | ({"p3_features": wide} if wide else {})
    return own | text.SQL | graph.SQL | data.SQL | index.SQL | inputs.SQL | store.SQL
