"""Expected results of the registered queries as DuckDB SQL.

Where it can be, the expectation is derived from the base columns, not from the written lines.
"""

from __future__ import annotations

from logsluice.plans.catalog import SLICE_ROWS, USER_AGENTS, WORD_REGEX

ORACLES: dict[str, str] = {}

BAD = "event_id % 97 = 0"
AGENTS = "[" + ", ".join(f"'{ua}'" for ua in USER_AGENTS) + "]"
UA = f"{AGENTS}[(user_id % {len(USER_AGENTS)}) + 1]"
SLICE = f"event_id // {SLICE_ROWS}"
WORD = WORD_REGEX.replace("'", "''")


def iso(ts: str) -> str:
    """ISO text with milliseconds, trailing zeros removed."""
    return f"rtrim(rtrim(strftime({ts}, '%Y-%m-%dT%H:%M:%S.%g'), '0'), '.') || 'Z'"


BROWSER = """CASE
  WHEN contains(ua, 'Chrome') OR contains(ua, 'CriOS') THEN 'chrome'
  WHEN contains(ua, 'Firefox') THEN 'firefox'
  WHEN contains(ua, 'Android') THEN 'android'
  WHEN contains(ua, 'Safari') THEN 'safari'
  WHEN contains(ua, 'Trident') OR contains(ua, 'MSIE') THEN 'ie'
  WHEN contains(ua, 'ELB-HealthChecker') THEN 'aws-elb'
  WHEN contains(ua, 'Mozilla') AND contains(ua, 'AppleWebKit') THEN 'ios_cna' END"""
BROWSER_VER = """CASE
  WHEN contains(ua, 'Chrome') THEN regexp_extract(ua, 'Chrome/([^ ;)]*)', 1)
  WHEN contains(ua, 'CriOS') THEN regexp_extract(ua, 'CriOS/([^ ;)]*)', 1)
  WHEN contains(ua, 'Firefox') THEN regexp_extract(ua, 'Firefox/([^ ;)]*)', 1)
  WHEN contains(ua, 'Android') OR contains(ua, 'Safari') THEN regexp_extract(ua, 'Version/([^ ;)]*)', 1)
  WHEN contains(ua, 'Trident') THEN regexp_extract(ua, 'rv:([^ ;)]*)', 1)
  WHEN contains(ua, 'MSIE') THEN regexp_extract(ua, 'MSIE ([^ ;)]*)', 1)
  WHEN contains(ua, 'ELB-HealthChecker') THEN regexp_extract(ua, 'Checker/([^ ;)]*)', 1) END"""
OS = """CASE
  WHEN contains(ua, 'Win') THEN 'windows'
  WHEN contains(ua, 'iPhone OS') THEN 'ios'
  WHEN contains(ua, 'Mac OS X') THEN 'mac'
  WHEN contains(ua, 'Android') THEN 'android'
  WHEN contains(ua, 'X11') THEN 'unix'
  WHEN contains(ua, 'Linux') THEN 'linux'
  WHEN contains(ua, 'ELB-HealthChecker') THEN 'aws-elb' END"""
OS_VER = r"""CASE
  WHEN contains(ua, 'Win') THEN regexp_extract(ua, 'Windows NT ([^ ;)]*)', 1)
  WHEN contains(ua, 'iPhone OS') THEN replace(regexp_extract(ua, 'iPhone OS ([^ ;)]*)', 1), '_', '.')
  WHEN contains(ua, 'Mac OS X')
    THEN regexp_replace(replace(regexp_extract(ua, 'Mac OS X ([^ ;)]*)', 1), '_', '.'), '\.0$', '')
  WHEN contains(ua, 'Android') THEN regexp_extract(ua, 'Android ([^ ;)]*)', 1)
  WHEN contains(ua, 'X11') OR contains(ua, 'Linux') THEN NULL
  WHEN contains(ua, 'ELB-HealthChecker') THEN regexp_extract(ua, 'Checker/([^ ;)]*)', 1) END"""

ORACLES["access_log_regex"] = f"""
WITH e AS (SELECT *, {UA} AS ua FROM events WHERE event_id % 97 <> 0)
SELECT event_id, 'shop' AS app, '2.4' AS app_ver, TIMESTAMP '2024-02-01 12:30:45' AS ingest_datetime,
  date_trunc('second', ts) AS event_datetime, 'web-1' AS hostname, 'access.log' AS filename,
  CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS log_level,
  CAST(NULL AS VARCHAR) AS device_tag, CAST(NULL AS VARCHAR) AS user_tag, '10.0.0.' || user_id AS remote_address,
  CASE WHEN event_id % 7 <> 0 THEN event_id * 3 END AS response_bytes,
  CASE WHEN event_id % 5 <> 0 THEN CAST((event_id % 60) * 1000 + event_id % 1000 AS DOUBLE) END AS response_ms,
  CAST(NULL AS VARCHAR) AS device_type, {OS} AS os, {OS_VER} AS os_ver, {BROWSER} AS browser,
  {BROWSER_VER} AS browser_ver, CAST(NULL AS VARCHAR) AS country, CAST(NULL AS VARCHAR) AS language,
  '- "GET /' || event_type || '?id=' || event_id || ' HTTP/1.1"' AS log_line
FROM e"""

ORACLES["regex_residual"] = rf"""
WITH e AS (
  SELECT event_id,
    repeat(' ', length('10.0.0.' || user_id)) || ' - '
    || repeat(' ', CASE WHEN event_id % 3 = 0 THEN 1 ELSE 1 + length(CAST(user_id AS VARCHAR)) END) || ' ['
    || repeat(' ', 26) || '] "GET /' || event_type || '?id=' || event_id || ' HTTP/1.1" ' || repeat(' ', 3) || ' '
    || repeat(' ', CASE WHEN event_id % 7 = 0 THEN 1 ELSE length(CAST(event_id * 3 AS VARCHAR)) END) || ' "'
    || repeat(' ', 9 + length(event_type)) || '" "' || repeat(' ', strlen({UA})) || '"'
    || CASE WHEN event_id % 5 = 0 THEN ''
       ELSE repeat(' ', 5 + length(CAST(event_id % 60 AS VARCHAR))) END AS blanked
  FROM events WHERE event_id % 97 <> 0)
SELECT event_id, trim(regexp_replace(regexp_replace(blanked, ' {{2,}}', '', 'g'),
  '\[\]|\(\)|- |""|\(ms\)|\\N', '', 'g')) AS log_line
FROM e"""

ORACLES["regex_attributes"] = f"""
SELECT event_id,
  CASE WHEN NOT {BAD} THEN '10.0.0.' || user_id END AS remote_address,
  CASE WHEN NOT {BAD} AND event_id % 3 <> 0 THEN 'u' || user_id END AS remote_user,
  CASE WHEN NOT {BAD} THEN CASE WHEN event_type = 'error' THEN '500' ELSE '200' END END AS log_level,
  CASE WHEN NOT {BAD} AND event_id % 7 <> 0 THEN CAST(event_id * 3 AS VARCHAR) END AS response_bytes,
  CASE WHEN NOT {BAD} THEN 'http://r/' || event_type END AS http_referer,
  CASE WHEN NOT {BAD} AND event_id % 5 <> 0
    THEN (event_id % 60) || '.' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') END AS response_s,
  NOT {BAD} AS parse_ok
FROM events"""

URL = r"^(https?)://([^/:?#]+)(?::\d+)?(/[^?#]*)?(?:\?([^#]*))?(?:#(.*))?$"
TOKEN = "CASE WHEN {0} IN ('', ' ', 'null', 'none', '-', 'empty') THEN NULL ELSE {0} END"


def token(expr: str) -> str:
    return TOKEN.format(expr)


ORACLES["url_parts"] = rf"""
WITH p AS (SELECT page_id, url, regexp_extract(url, '{URL}', ['a', 'b', 'c', 'd', 'e']) AS r FROM pages)
SELECT page_id, {token("r.a")} AS scheme, {token("r.b")} AS host, {token("r.c")} AS path, {token("r.d")} AS query,
  {token("r.e")} AS fragment,
  CASE WHEN regexp_matches(url, '[?&]page=(\d*)') THEN regexp_extract(url, '[?&]page=(\d*)', 1) END AS page,
  regexp_matches(url, '{URL}') AS parse_ok
FROM pages JOIN p USING (page_id, url)"""

ORACLES["nested_residual"] = rf"""
SELECT page_id, CASE WHEN regexp_matches(url, '{URL}') THEN
  '://' || regexp_extract(url, '^https?://[^/:?#]+(:\d+)?', 1)
  || CASE WHEN contains(regexp_extract(url, '^[^#]*'), '?') THEN '?' ELSE '' END
  || CASE WHEN contains(url, '#') THEN '#' ELSE '' END END AS log_line
FROM pages"""

ORACLES["ua_families"] = f"""
WITH e AS (SELECT *, {UA} AS ua FROM events)
SELECT event_id, {BROWSER} AS browser, {BROWSER_VER} AS browser_ver,
  CASE WHEN event_id % 13 = 0 THEN 'plan9' ELSE {OS} END AS os,
  CASE WHEN event_id % 13 <> 0 THEN {OS_VER} END AS os_ver
FROM e"""

ORACLES["ua_functions"] = f"""
WITH e AS (SELECT *, {UA} AS ua FROM events)
SELECT event_id, {BROWSER} AS browser, {BROWSER_VER} AS browser_ver, {OS} AS os, {OS_VER} AS os_ver FROM e"""

# -- JSON

JSON_OK = "event_id % 89 <> 0 AND event_id % 83 <> 0"
NUMBER = r"regexp_replace(CAST(value AS VARCHAR), '\.0$', '')"

ORACLES["json_mapped"] = f"""
SELECT event_id, 'shop' AS app, '2.4' AS app_ver, '2024-02-01T12:30:45Z' AS ingest_datetime,
  {iso("ts")} AS event_datetime, 'web-1' AS hostname, 'access.log' AS filename, event_type AS log_level,
  CASE WHEN event_id % 4 <> 0 THEN 'd-' || event_id END AS device_tag, CAST(user_id AS VARCHAR) AS user_tag,
  '10.0.0.' || user_id AS remote_address,
  CASE WHEN value = floor(value) THEN CAST(value AS BIGINT) END AS response_bytes,
  CAST(NULL AS DOUBLE) AS response_ms, CAST(NULL AS VARCHAR) AS device_type, CAST(NULL AS VARCHAR) AS os,
  CAST(NULL AS VARCHAR) AS os_ver, CAST(NULL AS VARCHAR) AS browser, CAST(NULL AS VARCHAR) AS browser_ver,
  CASE WHEN event_id % 3 <> 0 THEN 'mx' END AS country, CAST(NULL AS VARCHAR) AS language
FROM events WHERE {JSON_OK}"""

ORACLES["json_residual"] = f"""
SELECT event_id, '{{"alpha":' || event_id || ',"message":"m ' || event_id || '","props":' || replace(props, ' ', '')
  || ',"zeta":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || '}}' AS log_line
FROM events WHERE {JSON_OK}"""

JSON_TEXT = f"""'{{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') || '","kind":"' || event_type
  || '","who":' || user_id || ',"addr":"10.0.0.' || user_id || '","device":'
  || CASE WHEN event_id % 4 = 0 THEN 'null' ELSE '"d-' || event_id || '"' END || ',"bytes":' || value
  || ',"country":"' || CASE WHEN event_id % 3 = 0 THEN 'none' ELSE 'mx' END || '","zeta":'
  || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || ',"message":"m ' || event_id || '","alpha":'
  || event_id || ',"props":' || props || '}}'"""
JSON_LINE = f"""CASE WHEN event_id % 89 = 0 THEN left({JSON_TEXT}, 40)
  WHEN event_id % 83 = 0 THEN {JSON_TEXT} || ' {{}}' ELSE {JSON_TEXT} END"""

ORACLES["json_raw"] = f"""
SELECT event_id, CASE WHEN {JSON_OK} THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') END AS event_datetime,
  CASE WHEN {JSON_OK} THEN event_type END AS kind, CAST(NULL AS VARCHAR) AS who,
  CASE WHEN {JSON_OK} AND event_id % 4 <> 0 THEN 'd-' || event_id END AS device,
  CASE WHEN {JSON_OK} THEN CASE WHEN event_id % 3 = 0 THEN 'none' ELSE 'mx' END END AS country,
  {JSON_LINE} AS log_line, {JSON_OK} AS parse_ok
FROM events"""

ORACLES["variadic_json"] = f"""
SELECT event_id, 'shop' AS app, '2.4' AS app_ver, 'web-1' AS hostname, 'access.log' AS filename, {JSON_LINE} AS event,
  '' AS meta, '' AS log_line, true AS parse_ok
FROM events"""

# -- CSV

ORACLES["csv_lines"] = """
SELECT l_orderkey, l_partkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_quantity AS FLOAT) AS l_quantity,
  l_extendedprice, l_discount, l_returnflag,
  CASE l_partkey % 4 WHEN 0 THEN left('say "' || l_partkey || '", now', 12) WHEN 1 THEN ' padded' END AS note,
  strftime(l_shipdate, '%a %b ') || lpad(CAST(day(l_shipdate) AS VARCHAR), 2, ' ')
    || strftime(l_shipdate, ' %H:%M:%S %Y') AS l_shipdate
FROM lineitem WHERE l_partkey % 101 NOT IN (0, 1, 2)"""

ORACLES["csv_rejects"] = r"""
WITH l AS (
  SELECT *, l_orderkey || ',' || l_partkey || ',' || l_linenumber || ',' || l_quantity || ',' || l_extendedprice
    || ',' || l_discount || ',' || l_returnflag || ','
    || CASE l_partkey % 4 WHEN 0 THEN '"say ""' || l_partkey || '"", now"' WHEN 1 THEN ' padded' WHEN 2 THEN 'none'
       ELSE '' END
    || ',' || strftime(l_shipdate, '%Y/%m/%d %H:%M:%S') AS line
  FROM lineitem WHERE l_partkey % 101 IN (0, 1, 2))
SELECT l_orderkey AS k_orderkey, l_linenumber AS k_linenumber,
  CASE l_partkey % 101 WHEN 0 THEN line || ',extra' WHEN 1 THEN '7 "' || line
    ELSE '"' || replace(line, '"', '') END AS line
FROM l"""

ORACLES["csv_residual"] = r"""
WITH o AS (
  SELECT o_orderkey, o_orderpriority, 'done (ms) in  ' || o_custkey AS third,
    '[] ' || o_orderstatus AS second, CASE WHEN o_custkey % 2 = 0 THEN '-' ELSE 'vip  ()' END AS fifth
  FROM orders)
SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS user_tag, o_orderpriority AS log_level, third AS unlisted,
  trim(regexp_replace(regexp_replace(second || ' ' || third || ' ' || fifth || ' ',
    '\[\]|\(\)|- |""|\(ms\)|\\N', '', 'g'), ' {2,}', '', 'g')) AS log_line,
  true AS parse_ok
FROM o"""

# -- key=value

SHORT = "o_orderkey % 71 = 0"
PRIO = "CASE WHEN o_orderkey % 3 = 0 THEN 'again' ELSE o_orderpriority END"
NOTE = "CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE 'ok' END"

ORACLES["kv_lines"] = f"""
SELECT o_orderkey, CASE WHEN NOT {SHORT} THEN o_orderstatus END AS log_level,
  CASE WHEN NOT {SHORT} THEN CAST(o_custkey AS VARCHAR) END AS user_tag,
  CASE WHEN NOT {SHORT} AND o_orderkey % 5 <> 0 THEN 'ok' END AS device_tag,
  CASE WHEN NOT {SHORT} THEN 'order.total-sum=' || o_totalprice || ' prio=' || {PRIO} END AS log_line,
  NOT {SHORT} AS parse_ok
FROM orders"""

ORACLES["kv_json_residual"] = f"""
SELECT o_orderkey, '{{"order.total-sum":"' || o_totalprice || '","prio":"' || {PRIO} || '"}}' AS log_line
FROM orders WHERE NOT {SHORT}"""

ORACLES["kv_custom_regex"] = """
SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS user_tag, 'q ' || o_custkey AS device_tag, 'c=' AS log_line
FROM orders"""

ORACLES["variadic_kv"] = f"""
SELECT o_orderkey, 'shop' AS app,
  CASE WHEN NOT {SHORT} THEN '{{"note":"' || {NOTE} || '","orderTotalSum":"' || o_totalprice || '","prio":"' || {PRIO}
    || '","status":"' || o_orderstatus || '","userId":"' || o_custkey || '"}}' END AS event,
  '' AS meta,
  CASE WHEN NOT {SHORT} THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') || 'status="' || o_orderstatus
    || '" user_id="' || o_custkey || '" prio="' || o_orderpriority || '" note="' || {NOTE} || '" order.total-sum="'
    || o_totalprice || '"' || CASE WHEN o_orderkey % 3 = 0 THEN ' prio="again"' ELSE '' END END AS log_line,
  NOT {SHORT} AS parse_ok
FROM orders"""

# -- times

ORACLES["ts_layouts"] = f"""
WITH e AS (
  SELECT event_id, CASE event_id % 5
    WHEN 0 THEN date_trunc('second', ts)
    WHEN 1 THEN date_trunc('millisecond', ts)
    WHEN 2 THEN date_trunc('millisecond', ts)
    WHEN 3 THEN date_trunc('second', ts) + INTERVAL 5 HOUR
    ELSE date_trunc('minute', ts) END AS t
  FROM events)
SELECT event_id, {iso("t")} AS event_ts, {iso("t")} AS event_datetime FROM e"""

ORACLES["ts_reformat"] = f"""
SELECT o_orderkey, {iso("o_orderdate")} AS iso,
  strftime(o_orderdate, '%a %b ') || lpad(CAST(day(o_orderdate) AS VARCHAR), 2, ' ')
    || strftime(o_orderdate, ' %H:%M:%S %Y') AS ansi,
  strftime(o_orderdate, '%Y/%m/%d') AS day, {iso("o_orderdate")} AS ruby,
  CASE WHEN o_orderkey % 9 <> 0 THEN {iso("o_orderdate")} END AS wrong,
  CASE WHEN o_orderkey % 9 = 0 THEN 'week 7 of 2031' ELSE strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') END AS same
FROM orders"""

ORACLES["epoch_ms"] = f"""
SELECT event_id, CASE WHEN event_id % 17 <> 0 THEN {iso("ts")} END AS event_ts FROM events"""

ORACLES["format_conformance_report"] = """
WITH c AS (
  SELECT count(*) AS n, count(*) FILTER (event_id % 19 <> 0) AS fit_created,
    count(*) FILTER (event_id % 23 = 0 OR event_id % 29 <> 0) AS n_seen,
    count(*) FILTER (event_id % 23 <> 0 AND event_id % 29 <> 0) AS fit_seen
  FROM events)
SELECT 'created' AS attribute, '2006-01-02 15:04:05' AS layout, n AS "values", fit_created AS fitting,
  fit_created / n AS share FROM c
UNION ALL
SELECT 'seen', '2006/01/02', n_seen, fit_seen, fit_seen / n_seen FROM c"""

# -- types

ORACLES["coerce_types"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE l_partkey % 10 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN l_partkey ELSE l_orderkey END AS whole,
  CASE WHEN l_partkey % 10 NOT IN (3, 4) THEN l_extendedprice END AS price,
  CASE WHEN l_partkey % 10 NOT IN (5, 6) THEN CAST(l_discount AS FLOAT) END AS rate,
  CASE WHEN l_partkey % 8 IN (0, 1, 2) THEN true WHEN l_partkey % 8 IN (3, 4, 5) THEN false END AS flag,
  CASE WHEN l_partkey % 10 <> 7 THEN l_linestatus END AS label
FROM lineitem"""

ORACLES["coercion_counts"] = """
WITH c AS (
  SELECT count(*) AS n, count(*) FILTER (l_partkey % 10 IN (0, 1)) AS whole,
    count(*) FILTER (l_partkey % 10 IN (3, 4)) AS price, count(*) FILTER (l_partkey % 10 IN (5, 6)) AS rate,
    count(*) FILTER (l_partkey % 8 IN (6, 7)) AS flag, count(*) FILTER (l_partkey % 10 <> 7) AS labels
  FROM lineitem)
SELECT 'whole' AS attribute, 'integer' AS declared_type, n AS given, whole AS failed FROM c
UNION ALL SELECT 'price', 'double', n, price FROM c
UNION ALL SELECT 'rate', 'float32', n, rate FROM c
UNION ALL SELECT 'flag', 'bool', n, flag FROM c
UNION ALL SELECT 'label', 'string', labels, 0 FROM c"""

ORACLES["plain_numbers"] = r"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity,
  regexp_replace(CAST(l_extendedprice AS VARCHAR), '\.0$', '') AS price,
  '-' || CAST(CAST(l_quantity AS BIGINT) * 1000000000 AS VARCHAR) AS big,
  rtrim(CAST(CAST(l_quantity AS DECIMAL(18, 0)) * CAST(0.00000095367431640625 AS DECIMAL(20, 20)) AS VARCHAR), '0')
    AS small
FROM lineitem"""

ORACLES["fit_text_lengths"] = """
SELECT doc_id, left(text, 64) AS short, md5(text) AS clean_md5 FROM documents"""

ORACLES["fit_bytes_lengths"] = r"""
SELECT doc_id, left(regexp_replace(text, '[^\x00-\x7F]', '?', 'g'), 100) AS head,
  CAST(strlen(text) AS INTEGER) AS whole_bytes
FROM documents"""

ORACLES["line_hashes"] = """
SELECT conv_id, turn, md5(text) AS line_md5, md5(role || chr(10) || text) AS content_md5 FROM conversations"""

# -- row flow

LINES = """lines AS (
  SELECT source, doc_id, CAST(pos - 1 AS BIGINT) AS pos, parts[pos] AS line
  FROM (SELECT source, doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos
        FROM (SELECT source, doc_id, string_split(text, chr(10)) AS parts FROM documents)))"""

ORACLES["rejects"] = f"""
WITH {LINES}
SELECT source, doc_id, pos, line, 'not parsed' AS reason FROM lines WHERE NOT regexp_matches(line, '{WORD}')"""

ORACLES["ingest_counts"] = f"""
WITH {LINES}
SELECT source, count(*) AS lines_read, count(*) FILTER (regexp_matches(line, '{WORD}')) AS lines_parsed,
  count(*) FILTER (NOT regexp_matches(line, '{WORD}')) AS lines_rejected
FROM lines GROUP BY source"""

ORACLES["ingest_log_rows"] = f"""
SELECT '2024-02-01T12:30:45Z' AS "time", CASE WHEN count(*) FILTER ({BAD}) > 0 THEN 'warning' ELSE 'info' END AS level,
  'nginx' AS logfile_name, event_type AS file, 'web' AS stream,
  'streamed ' || count(*) FILTER (NOT {BAD}) || ' lines of ' || count(*) AS message
FROM events GROUP BY event_type"""

TIMED = f"""timed AS (
  SELECT event_type, {SLICE} AS slice, event_id,
    CASE WHEN event_id % 11 <> 0 THEN ts + to_minutes(event_id % 7) END AS event_ts
  FROM events)"""
CURSORS = """cur AS (
  SELECT event_type, arg_max(event_ts, event_id) AS last_event_ts
  FROM timed WHERE event_ts < TIMESTAMP '2024-01-16' AND event_type <> 'view' GROUP BY event_type)"""

ORACLES["age_limit"] = f"""
WITH {TIMED}
SELECT event_type, slice, event_id, {iso("event_ts")} AS event_ts FROM timed
WHERE event_ts IS NULL OR event_ts >= TIMESTAMP '2024-01-20 06:00:00'"""

ORACLES["cursors"] = f"""
WITH {TIMED}, {CURSORS}
SELECT event_type, {iso("last_event_ts")} AS last_event_ts, '2.4' AS app_ver FROM cur"""

ORACLES["resume"] = f"""
WITH {TIMED}, {CURSORS},
flagged AS (
  SELECT t.*, c.last_event_ts IS NULL AS free,
    bool_or(coalesce(t.event_ts > c.last_event_ts, false)) OVER (PARTITION BY t.event_type ORDER BY t.event_id) AS open
  FROM timed t LEFT JOIN cur c USING (event_type))
SELECT event_type, slice, event_id, {iso("event_ts")} AS event_ts FROM flagged WHERE free OR open"""

ORACLES["continuations"] = f"""
WITH RECURSIVE {LINES},
marked AS (
  SELECT *, NOT regexp_matches(line, '{WORD}') AS bad,
    sum(CAST(regexp_matches(line, '{WORD}') AS INTEGER)) OVER (PARTITION BY source ORDER BY doc_id, pos) AS run
  FROM lines),
bad AS (
  SELECT *, row_number() OVER (PARTITION BY source, run ORDER BY doc_id, pos) AS rn, strlen(line) + 2 AS size
  FROM marked WHERE bad),
walk AS (
  SELECT source, run, rn, size AS acc, 0 AS chunk FROM bad WHERE rn = 1
  UNION ALL
  SELECT b.source, b.run, b.rn, CASE WHEN w.acc >= 65535 THEN b.size ELSE w.acc + b.size END,
    CASE WHEN w.acc >= 65535 THEN w.chunk + 1 ELSE w.chunk END
  FROM walk w JOIN bad b ON b.source = w.source AND b.run = w.run AND b.rn = w.rn + 1)
SELECT source, min(doc_id) AS doc_id, arg_min(pos, b.rn) AS pos, string_agg(line || '\\n', '' ORDER BY b.rn) AS log_line,
  count(*) AS lines, CAST(sum(size) AS BIGINT) AS bytes
FROM bad b JOIN walk USING (source, run, rn) GROUP BY source, run, chunk"""

ORACLES["record_split"] = f"""
WITH {LINES},
marked AS (
  SELECT *, sum(CAST(regexp_matches(line, '^[A-M]') AS INTEGER)) OVER (PARTITION BY source ORDER BY doc_id, pos) AS rec
  FROM lines)
SELECT source, min(doc_id) AS doc_id, arg_min(pos, (doc_id, pos)) AS pos, CAST(0 AS BIGINT) AS part,
  string_agg(line, '' ORDER BY doc_id, pos) AS line
FROM marked GROUP BY source, rec"""

ORACLES["app_versions"] = f"""
WITH e AS (
  SELECT *, CASE WHEN event_id % 50 = 7 THEN '3.' || (event_id // 50) END AS ver FROM events)
SELECT event_type, {SLICE} AS slice, event_id,
  CASE WHEN ver IS NOT NULL THEN '---- app_ver: ' || ver ELSE props END AS line,
  coalesce(last_value(ver IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '2.4') AS app_ver
FROM e"""

ORACLES["defaults"] = """
SELECT o_orderkey, 'shop' AS app, '2.4' AS app_ver, '2024-02-01T12:30:45Z' AS ingest_datetime,
  '2024-02-01T12:30:45Z' AS event_datetime, 'web-1' AS hostname, 'orders-' || o_orderkey AS filename,
  CAST(NULL AS VARCHAR) AS log_level, CAST(NULL AS VARCHAR) AS device_tag, CAST(NULL AS VARCHAR) AS user_tag,
  CAST(NULL AS VARCHAR) AS remote_address, CAST(NULL AS BIGINT) AS response_bytes, CAST(NULL AS DOUBLE) AS response_ms,
  CAST(NULL AS VARCHAR) AS device_type, CAST(NULL AS VARCHAR) AS os, CAST(NULL AS VARCHAR) AS os_ver,
  CAST(NULL AS VARCHAR) AS browser, CAST(NULL AS VARCHAR) AS browser_ver, CAST(NULL AS VARCHAR) AS country,
  CAST(NULL AS VARCHAR) AS language, CAST(NULL AS VARCHAR) AS log_line
FROM orders"""

# -- delivery

CSV_LINE = r'''o_orderkey || ',' || o_orderstatus || ',' || regexp_replace(CAST(o_totalprice AS VARCHAR), '\.0$', '')
  || ',' || o_orderpriority || ',' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || ','
  || CASE o_orderkey % 6 WHEN 0 THEN '"a, b"' WHEN 1 THEN '"he said ""no"""' WHEN 2 THEN '" lead"'
     WHEN 3 THEN '"two' || chr(10) || 'lines"' WHEN 4 THEN '"\."' ELSE '\N' END'''

ORACLES["csv_encode"] = f"SELECT o_orderkey, {CSV_LINE} AS csv_line FROM orders"

ORACLES["batches"] = f"""
SELECT o_orderkey // {SLICE_ROWS} AS slice, o_orderkey,
  (row_number() OVER (PARTITION BY o_orderkey // {SLICE_ROWS} ORDER BY o_orderkey) - 1) // 500 AS batch
FROM orders"""


def greedy(limit: int, max_rows: int | None, size: str = "strlen(text) + 1") -> str:
    """Batches of documents per shard of 256, closed by the row that brings them over the limit."""
    full = f"w.acc > {limit}" + (f" OR w.n = {max_rows}" if max_rows else "")
    return f"""docs AS (
  SELECT doc_id // 256 AS shard, doc_id, text, {size} AS size,
    row_number() OVER (PARTITION BY doc_id // 256 ORDER BY doc_id) AS rn FROM documents),
walk AS (
  SELECT shard, rn, size AS acc, 1 AS n, CAST(0 AS BIGINT) AS batch FROM docs WHERE rn = 1
  UNION ALL
  SELECT d.shard, d.rn, CASE WHEN {full} THEN d.size ELSE w.acc + d.size END,
    CASE WHEN {full} THEN 1 ELSE w.n + 1 END, CASE WHEN {full} THEN w.batch + 1 ELSE w.batch END
  FROM walk w JOIN docs d ON d.shard = w.shard AND d.rn = w.rn + 1)"""


ORACLES["batches_by_size"] = f"""
WITH RECURSIVE {greedy(100_000, 500)}
SELECT shard, doc_id, batch FROM walk JOIN docs USING (shard, rn)"""

ORACLES["delivery_batches"] = f"""
WITH RECURSIVE {greedy(100_000, 500)}
SELECT shard, batch, count(*) AS record_count, CAST(sum(size) AS BIGINT) AS batch_bytes,
  md5(string_agg(text, chr(10) ORDER BY doc_id)) AS body_md5
FROM walk JOIN docs USING (shard, rn) GROUP BY shard, batch"""

ORACLES["oversize"] = """
SELECT doc_id, CAST(strlen(text) AS INTEGER) AS bytes, 'record too large' AS reason FROM documents
WHERE strlen(text) + 1 > 10000"""

ACCESS_LINE = f"""'10.0.0.' || user_id || ' - ' || CASE WHEN event_id % 3 = 0 THEN '-' ELSE 'u' || user_id END || ' ['
  || strftime(ts, '%d/%b/%Y:%H:%M:%S +0000') || '] "GET /' || event_type || '?id=' || event_id || ' HTTP/1.1" '
  || CASE WHEN event_type = 'error' THEN '500' ELSE '200' END || ' '
  || CASE WHEN event_id % 7 = 0 THEN '-' ELSE CAST(event_id * 3 AS VARCHAR) END || ' "http://r/' || event_type || '" "'
  || {UA} || '"'
  || CASE WHEN event_id % 5 = 0 THEN ''
     ELSE ' ' || (event_id % 60) || '.' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') END"""

# MD5 over the raw MD5 bytes of the lines and the salt. DuckDB's md5 takes text, so the bytes are
# only comparable through unhex and the blob form of md5.
POSTS = f"""posts AS (
  SELECT event_type, event_id, md5({ACCESS_LINE}) AS hash,
    '{{"http_referer":"http://r/' || event_type || '","log_level":"'
      || CASE WHEN event_type = 'error' THEN '500' ELSE '200' END || '","remote_address":"10.0.0.' || user_id
      || '","remote_user":"' || CASE WHEN event_id % 3 = 0 THEN '\\\\N' ELSE 'u' || user_id END
      || '","response_bytes":"' || CASE WHEN event_id % 7 = 0 THEN '\\\\N' ELSE CAST(event_id * 3 AS VARCHAR) END
      || '"}}' AS event,
    (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 1000 AS batch
  FROM events WHERE NOT {BAD}),
sent AS (
  SELECT event_type, batch, count(*) AS event_count,
    md5(unhex(string_agg(hash, '' ORDER BY event_id) || hex('20160727'))) AS transaction_id,
    string_agg(event, ',' ORDER BY event_id) AS events
  FROM posts GROUP BY event_type, batch)"""

ORACLES["event_batch_payloads"] = f"""
WITH {POSTS}
SELECT event_type, batch, event_count,
  '{{"api_key":"key-1","transaction_id":"' || transaction_id || '","events":[' || events || ']}}' AS payload
FROM sent"""

ORACLES["transaction_ids"] = f"WITH {POSTS} SELECT event_type, batch, transaction_id FROM sent"

ORACLES["dedup"] = f"WITH {POSTS} SELECT event_type, batch, transaction_id FROM sent WHERE batch > 0"

ORACLES["object_keys"] = """
SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'logs/' ELSE '' END || o_orderstatus || '/'
  || strftime(o_orderdate, '%Y/%m/%d/%H/%M') || '/' || md5(o_orderpriority) AS fullpath
FROM orders"""

ORACLES["manifest"] = f"""
WITH RECURSIVE {greedy(199_999, None)}
SELECT 'logs/doc_log/2024/02/01/12/30/' || md5(string_agg(text || chr(10), '' ORDER BY doc_id)) AS fullpath,
  'doc_log' AS table_name, 'v7' AS ddl_version, count(*) AS record_count
FROM walk JOIN docs USING (shard, rn) GROUP BY shard, batch"""

# The objects that the data source writes are those of the manifest.
ORACLES["delivered_objects"] = ORACLES["manifest"]

# -- merging

ORACLES["merged_hosts"] = f"""
SELECT {SLICE} AS slice, 'host-' || (user_id % 4) AS host, event_type, event_id, props AS line,
  row_number() OVER (ORDER BY {SLICE}, user_id % 4, event_type, event_id) AS line_id
FROM events"""

ORACLES["tail_of_source"] = f"""
SELECT event_type, event_id,
  CASE WHEN {BAD} THEN '-- stray output of worker ' || user_id ELSE {ACCESS_LINE} END AS line
FROM events WHERE event_type = 'purchase'"""

ORACLES["sources"] = """
WITH f AS (
  SELECT event_type AS folder, user_id % 3 AS part, '/logs/' || event_type || '/' || (user_id % 3) || '.log' AS file, count(*) AS lines
  FROM events GROUP BY ALL),
owned AS (
  SELECT 'clicks' AS name, file, lines FROM f WHERE folder = 'click'
  UNION ALL SELECT 'trade', file, lines FROM f WHERE folder LIKE 'p%'
  UNION ALL SELECT 'one-file', file, lines FROM f WHERE folder = 'view' AND part = 1
  UNION ALL SELECT 'some', file, lines FROM f WHERE folder IN ('view', 'click') AND part IN (0, 2))
SELECT s.name, s.path, s.stream, s.parse_mode, o.file, coalesce(o.lines, 0) AS lines
FROM (VALUES ('clicks', '/logs/click', 'web', 'regex'), ('trade', '/logs/p*', 'web', 'json'),
  ('one-file', 'file:///logs//view/1.log', 'audit', 'csv'), ('some', '/logs/{view,click}/[02].log', 'audit', 'csv'),
  ('absent', '/logs/cli', 'audit', 'csv')) AS s(name, path, stream, parse_mode)
  LEFT JOIN owned o ON o.name = s.name"""

ORACLES["routed_sources"] = f"""
SELECT event_id, 'shop' AS app, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS event_datetime, 'web-1' AS hostname,
  event_type AS filename, CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS log_level,
  '10.0.0.' || user_id AS remote_address
FROM events WHERE NOT {BAD}
UNION ALL
SELECT event_id, 'shop', {iso("ts")}, 'app-1', event_type, event_type, '10.0.0.' || user_id FROM events
WHERE {JSON_OK}"""
