"""The parity queries in SQL over the driver's tables."""

from __future__ import annotations

START, END = "2024-01-03", "2024-01-24~"
TIME = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
TS = TIME.format("ts")

NAMES = """CASE event_type WHEN 'click' THEN 'HeartRate'
  WHEN 'view' THEN 'HeartRateVariabilitySDNN'
  WHEN 'purchase' THEN 'BloodPressureSystolic'
  WHEN 'signup' THEN 'StepCount' END"""

REC = f"""rec AS (
  SELECT * FROM (
    SELECT user_id::VARCHAR AS user_id, {NAMES} AS record_type, {TS} AS start_date,
      value::VARCHAR AS value, value AS v, 'u' || (event_id % 7) AS unit,
      (event_id % 3)::VARCHAR AS job_id, event_id, ts, props
    FROM events)
  WHERE record_type IS NOT NULL)"""

TRACKS = f"""tracks AS (
  SELECT user_id::VARCHAR AS user_id, strftime(ts, '%Y-%m-%d') AS day,
    min({TS}) AS route_time, count(*)::INTEGER AS waypoint_count,
    arg_min(value, ts)::VARCHAR AS start_lat, arg_min(event_id, ts)::VARCHAR AS start_lon,
    arg_max(value, ts)::VARCHAR AS end_lat, arg_max(event_id, ts)::VARCHAR AS end_lon
  FROM events GROUP BY ALL)"""

JOBS = """jobs AS (
  SELECT o_custkey::VARCHAR AS user_id, lpad(o_orderkey::VARCHAR, 12, '0') AS job_id,
    CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'PROCESSING'
      ELSE 'FAILED' END AS status,
    epoch(o_orderdate)::BIGINT::VARCHAR AS updated_at
  FROM orders)"""

ECG = f"""ecg AS (
  SELECT user_id::VARCHAR AS user_id, {TS} AS ecg_time, props AS classification,
    value::VARCHAR AS average_heart_rate, event_id,
    (event_id % 3)::VARCHAR AS job_id, strftime(ts, '%Y%m%d') AS day
  FROM events WHERE event_type = 'view')"""

# one row per rendered archive, and one per member
EXPORTS = """exports AS (
  SELECT DISTINCT user_id::VARCHAR AS user_id, (event_id % 3)::VARCHAR AS job_id
  FROM events)"""
MEMBERS = f"""{EXPORTS},
days AS (
  SELECT DISTINCT user_id::VARCHAR AS user_id, (event_id % 3)::VARCHAR AS job_id,
    strftime(ts, '%Y%m%d') AS day, event_type = 'view' AS viewed FROM events),
members AS (
  SELECT *, (row_number() OVER (PARTITION BY user_id, job_id ORDER BY part, member)
    - 1)::INTEGER AS member_ordinal
  FROM (
    SELECT user_id, job_id, 0 AS part, 'export/readme.txt' AS member,
      NULL::VARCHAR AS kind FROM exports
    UNION ALL SELECT user_id, job_id, 1, 'export/export.xml', 'xml' FROM exports
    UNION ALL SELECT user_id, job_id, 2,
      'export/electrocardiograms/ecg_' || day || '.csv', 'ecg' FROM days WHERE viewed
    UNION ALL SELECT DISTINCT user_id, job_id, 3,
      'export/workout-routes/route_' || day || '.gpx', 'gpx' FROM days))"""


def stats(condition: str = "true", prefix: str = "") -> str:
    """Average (half up, in cents), minimum, maximum and count of ``v``."""
    rows = f"FILTER (WHERE {condition})"
    cents = f"sum(round(v * 100)::BIGINT) {rows}"
    count = f"count(*) {rows}"
    return f"""(((2 * {cents} + {count}) // (2 * {count}))::DOUBLE / 100) AS "{prefix}avg",
      min(v) {rows} AS "{prefix}min", max(v) {rows} AS "{prefix}max" """


# one archive of every user, with the fault of its remainder
FAULTY = """faulty AS (SELECT DISTINCT user_id, user_id % 5 AS k FROM events)"""


def page(table: str, time: str, limit: int, where: str = "true") -> str:
    return f"""
  SELECT *, count(*) OVER (PARTITION BY user_id) AS page_count FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {time})::INTEGER AS position
    FROM {table} WHERE {time} BETWEEN '{START}' AND '{END}' AND {where})
  WHERE position <= {limit}"""


HEART_RATE = "record_type = 'HeartRate'"
HOURLY = """SELECT user_id, record_type, start_date[1:13] AS start_date, value, job_id,
    unit, row_number() OVER (PARTITION BY user_id, record_type, start_date[1:13]
      ORDER BY job_id DESC, event_id DESC) AS rn FROM rec"""

REQUESTS = """req AS (
  SELECT k AS request_id,
    CASE WHEN k % 41 = 0 THEN '' ELSE (c // 10)::VARCHAR END AS user_id,
    CASE k % 7 WHEN 1 THEN 'HeartRateVariabilitySDNN' WHEN 2 THEN 'StepCount'
      WHEN 4 THEN 'BloodPressureSystolic' WHEN 5 THEN 'SleepAnalysis'
      ELSE 'HeartRate' END AS type,
    DATE '2024-01-01' + (k % 30)::INTEGER AS d0, (k % 100) AS span,
    CASE WHEN k % 43 = 0 THEN 'weekly' WHEN k % 3 = 2 THEN 'raw' ELSE 'daily' END
      AS granularity,
    CASE k % 11 WHEN 0 THEN 100 WHEN 1 THEN 5 WHEN 4 THEN 1000 WHEN 6 THEN 10
      WHEN 7 THEN 7 WHEN 8 THEN 12 WHEN 10 THEN 1000 END AS lim,
    k
  FROM (SELECT o_orderkey AS k, o_custkey AS c FROM orders)),
checked AS (
  SELECT request_id, user_id, type, granularity,
    strftime(d0, '%Y-%m-%d') AS s, strftime(d0 + span::INTEGER, '%Y-%m-%d') AS e,
    CASE WHEN granularity = 'raw' THEN lim END::INTEGER AS "limit",
    CASE WHEN user_id = '' THEN 'UNAUTHORIZED'
      WHEN k % 37 = 0 THEN 'MISSING_PARAMETER'
      WHEN type = 'SleepAnalysis' THEN 'INVALID_METRIC_TYPE'
      WHEN k % 29 = 0 OR k % 31 = 0 OR k % 23 = 0 THEN 'INVALID_DATE'
      WHEN span > 90 THEN 'DATE_RANGE_EXCEEDED'
      WHEN granularity = 'weekly' THEN 'INVALID_GRANULARITY'
      WHEN granularity = 'raw' AND lim IS NULL THEN 'INVALID_LIMIT' END AS error_code
  FROM req),
listed AS (
  SELECT request_id, user_id, strftime(d0, '%Y-%m-%d') AS s,
    strftime(d0 + span::INTEGER, '%Y-%m-%d') AS e,
    CASE WHEN k % 11 = 0 THEN 50 WHEN lim > 200 THEN 200 ELSE lim END::INTEGER AS "limit",
    CASE WHEN user_id = '' THEN 'UNAUTHORIZED'
      WHEN k % 37 = 0 THEN 'MISSING_PARAMETER'
      WHEN k % 29 = 0 OR k % 31 = 0 OR k % 23 = 0 THEN 'INVALID_DATE'
      WHEN span > 90 THEN 'DATE_RANGE_EXCEEDED'
      WHEN lim IS NULL THEN 'INVALID_LIMIT' END AS error_code
  FROM req)"""

USER_COLUMNS = """c_custkey::VARCHAR AS id, c_name || '@example.com' AS email,
  c_acctbal > 0 AS email_verified"""

DAILY = f"""WITH {REC} SELECT user_id, record_type, start_date[1:10] AS date, {stats()},
  count(*) AS "count" FROM rec GROUP BY ALL"""

ECG_ROWS = f"""WITH {ECG} SELECT user_id, job_id, ecg_time,
  row_number() OVER (PARTITION BY user_id, job_id ORDER BY day, event_id) - 1 AS ordinal,
  'export/electrocardiograms/ecg_' || day || '.csv' AS source_file, classification,
  average_heart_rate, '1706745600' AS created_at,
  row_number() OVER (PARTITION BY user_id, job_id, day ORDER BY event_id) - 1
    AS row_in_file FROM ecg"""

ROUTE_ROWS = f"""SELECT *, row_number() OVER (PARTITION BY user_id, job_id
    ORDER BY source_file) - 1 AS ordinal FROM (
  SELECT user_id::VARCHAR AS user_id, (event_id % 3)::VARCHAR AS job_id,
    arg_min({TS}, event_id) AS route_time,
    'export/workout-routes/route_' || strftime(ts, '%Y%m%d') || '.gpx' AS source_file,
    count(*)::INTEGER AS waypoint_count,
    arg_min(value, event_id)::VARCHAR AS start_lat, min(event_id)::VARCHAR AS start_lon,
    arg_max(value, event_id)::VARCHAR AS end_lat, max(event_id)::VARCHAR AS end_lon,
    '1706745600' AS created_at
  FROM events GROUP BY user_id, event_id % 3, strftime(ts, '%Y%m%d'))"""

# Hourly records, those of one type put once more with another unit.
PUT_TWICE = f"""WITH {REC} SELECT user_id, record_type, start_date, value,
  CASE WHEN {HEART_RATE} THEN 'v' ELSE unit END AS unit, job_id
FROM ({HOURLY}) WHERE rn = 1"""

ORACLE: dict[str, str] = {
    "metric_daily": DAILY,
    "metric_daily_fine": f"""WITH {REC} SELECT user_id, record_type, start_date[1:10] AS date,
  round(sum((v / 1024)::DECIMAL(28,12)) / count(*), 2) AS avg, round(min(v / 1024), 2) AS min,
  round(max(v / 1024), 2) AS max, count(*) AS "count" FROM rec GROUP BY ALL""",
    "ecg_page_next": f"""WITH {ECG} SELECT user_id, ecg_time, classification,
  (position - 5)::INTEGER AS position, count(*) OVER (PARTITION BY user_id) AS page_count
FROM ({page("ecg", "ecg_time", 10)}) WHERE position > 5""",
    "workout_page_next": f"""WITH {TRACKS} SELECT user_id, route_time, waypoint_count,
  (position - 5)::INTEGER AS position, count(*) OVER (PARTITION BY user_id) AS page_count
FROM ({page("tracks", "route_time", 10)}) WHERE position > 5""",
    "health_summary_stored": f"""WITH {REC}, {ECG}, {EXPORTS},
one AS (SELECT user_id, record_type, {stats()}, count(*) AS n FROM rec
  WHERE start_date BETWEEN '2024-01-13' AND '2024-01-20~' GROUP BY ALL),
listed AS (SELECT user_id, count(*) AS ecg_count FROM ecg
  WHERE ecg_time BETWEEN '2024-01-13' AND '2024-01-20~' GROUP BY ALL)
SELECT u.user_id,
  {", ".join(f"max(CASE WHEN record_type = '{name}' THEN {part} END) AS {field}_{out}"
             for field, name in [("heart_rate", "HeartRate"), ("hrv", "HeartRateVariabilitySDNN"),
                                 ("blood_pressure", "BloodPressureSystolic")]
             for part, out in [("avg", "avg"), ('"min"', "min"), ('"max"', "max"), ("n", "count")])},
  coalesce(any_value(ecg_count), 0) AS ecg_count
FROM (SELECT DISTINCT user_id FROM exports) u LEFT JOIN one ON one.user_id = u.user_id
LEFT JOIN listed ON listed.user_id = u.user_id GROUP BY u.user_id""",
    "faulty_exports": f"""WITH {FAULTY}
SELECT CASE WHEN k <> 3 THEN user_id::VARCHAR END AS user_id, CASE WHEN k <> 3 THEN k::VARCHAR END AS job_id,
  [0, 2, 2, 0, 4][k + 1]::BIGINT AS file_count, k = 4 AS valid,
  ['not a valid archive', 'no export XML', 'XML is not well-formed', 'malformed key', NULL][k + 1] AS reason,
  ['ValidateFile', 'ValidateFile', 'ParallelParsing', 'ParseInput', NULL][k + 1] AS error_step
FROM faulty""",
    "faulty_jobs": f"""WITH {FAULTY}
SELECT user_id::VARCHAR AS user_id, k::VARCHAR AS job_id,
  CASE k WHEN 4 THEN 'COMPLETED' ELSE 'FAILED' END AS status, '1706745600' AS updated_at,
  ['ValidateFile', 'ValidateFile', 'ParallelParsing', NULL, NULL][k + 1] AS error_step
FROM faulty WHERE k <> 3""",
    "job_lifecycle": f"""WITH {FAULTY},
last AS (SELECT *, user_id % 7 AS g, k < 2 AS refused FROM faulty WHERE k <> 3),
state AS (SELECT *, CASE WHEN g = 0 THEN 'PENDING' WHEN g = 1 OR g = 2 AND refused THEN 'VALIDATING'
    WHEN g = 2 THEN 'PROCESSING' WHEN k = 4 THEN 'COMPLETED' ELSE 'FAILED' END AS status,
  CASE WHEN refused THEN 'ValidateFile' WHEN k = 2 THEN 'ParallelParsing' END AS step FROM last)
SELECT user_id::VARCHAR AS user_id, k::VARCHAR AS job_id, status,
  CASE WHEN g > 0 THEN '1706745600' END AS updated_at, CASE WHEN g > 2 THEN step END AS error_step,
  concat_ws(',', 'PENDING', CASE WHEN g > 0 THEN 'VALIDATING' END,
    CASE WHEN g > 1 AND NOT refused THEN 'PROCESSING' END, CASE WHEN g > 2 THEN status END) AS states,
  CASE WHEN g IN (1, 2) THEN 'FAILED' ELSE status END AS "end",
  CASE WHEN status = 'VALIDATING' THEN 'ValidateFile' WHEN status = 'PROCESSING' THEN 'ParallelParsing'
    WHEN g > 2 THEN step END AS end_step
FROM state""",
    "faulty_counts": f"""WITH {FAULTY}
SELECT user_id::VARCHAR AS user_id, k::VARCHAR AS job_id, c.* EXCLUDE (of) FROM faulty JOIN (VALUES
  (0, 0, 0, 0, 0, 0, 0, 0, 0), (1, 2, 0, 1, 1, 0, 0, 0, 0), (2, 2, 1, 0, 1, 0, 0, 0, 0),
  (4, 4, 1, 1, 2, 2, 0, 2, 1)) AS c(of, file_count, xml_members, ecg_members, gpx_members,
  records_kept, records_skipped, ecg_rows, routes) ON c.of = k""",
    "faulty_rows": f"""WITH {FAULTY}
SELECT user_id::VARCHAR AS user_id, family, n::BIGINT AS "rows"
FROM faulty, (VALUES ('records', 2), ('ecg', 2), ('routes', 1)) AS stored(family, n) WHERE k = 4""",
    "faulty_rejects": f"""WITH {FAULTY}
SELECT user_id::VARCHAR AS user_id, k::VARCHAR AS job_id, 'export/' || source_file AS source_file, line::BIGINT AS line, reason
FROM faulty, (VALUES ('electrocardiograms/e.csv', 3, 'line is no CSV'),
  ('workout-routes/q.gpx', NULL, 'GPX is not well-formed')) AS refused(source_file, line, reason) WHERE k = 4""",
    "pending_exports": f"""WITH {EXPORTS} SELECT user_id, job_id FROM exports WHERE job_id = '1'""",
    "metric_daily_range": f"""WITH {REC} SELECT user_id, record_type,
  start_date[1:10] AS date, {stats()}, count(*) AS "count" FROM rec
  WHERE {HEART_RATE} AND start_date BETWEEN '{START}' AND '{END}' GROUP BY ALL""",
    "metric_summary": f"""WITH {REC} SELECT user_id, record_type, {stats()},
  count(*) AS "count" FROM rec
  WHERE start_date BETWEEN '{START}' AND '{END}' GROUP BY ALL""",
    "first_unit": f"""WITH {REC} SELECT user_id, record_type,
  arg_min(unit, start_date) AS unit FROM rec
  WHERE start_date BETWEEN '{START}' AND '{END}' GROUP BY ALL""",
    "count_in_range": f"""WITH {ECG}, {TRACKS}
SELECT user_id, count(*) AS "count", 'ECG' AS family FROM ecg
  WHERE ecg_time BETWEEN '{START}' AND '{END}' GROUP BY ALL
UNION ALL SELECT user_id, count(*), 'GPX' FROM tracks
  WHERE route_time BETWEEN '{START}' AND '{END}' GROUP BY ALL""",
    "health_summary": f"""WITH {REC}, {ECG}, {TRACKS}, {JOBS},
m AS (SELECT user_id,
    {stats("record_type = 'HeartRate'", "heart_rate_")},
    nullif(count(*) FILTER (WHERE record_type = 'HeartRate'), 0) AS heart_rate_count,
    {stats("record_type = 'HeartRateVariabilitySDNN'", "hrv_")},
    nullif(count(*) FILTER (WHERE record_type = 'HeartRateVariabilitySDNN'), 0)
      AS hrv_count,
    {stats("record_type = 'BloodPressureSystolic'", "blood_pressure_")},
    nullif(count(*) FILTER (WHERE record_type = 'BloodPressureSystolic'), 0)
      AS blood_pressure_count
  FROM rec WHERE start_date BETWEEN '2024-01-13' AND '2024-01-20~'
    AND record_type <> 'StepCount' GROUP BY user_id),
e AS (SELECT user_id, count(*) AS n FROM ecg
  WHERE ecg_time BETWEEN '2024-01-13' AND '2024-01-20~' GROUP BY user_id),
w AS (SELECT user_id, count(*) AS n FROM tracks
  WHERE route_time BETWEEN '2024-01-13' AND '2024-01-20~' GROUP BY user_id),
j AS (SELECT user_id, string_agg(job_id || ':' || status, ','
    ORDER BY updated_at DESC, job_id DESC) AS recent_jobs
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY job_id DESC) AS rn
    FROM jobs) WHERE rn <= 5 GROUP BY user_id),
u AS (SELECT user_id FROM m UNION SELECT user_id FROM e UNION SELECT user_id FROM w
  UNION SELECT user_id FROM j)
SELECT u.user_id, '2024-01-13' AS period_start, '2024-01-20' AS period_end,
  m.* EXCLUDE (user_id), coalesce(e.n, 0) AS ecg_count, coalesce(w.n, 0) AS workout_count,
  coalesce(recent_jobs, '') AS recent_jobs
FROM u LEFT JOIN m USING (user_id) LEFT JOIN e USING (user_id)
  LEFT JOIN w USING (user_id) LEFT JOIN j USING (user_id)""",
    "map_record_type": f"""WITH {REC}
SELECT user_id, record_type, start_date, value FROM rec""",
    "project_record": f"""WITH {REC} SELECT user_id, record_type, start_date, value, unit,
  '' AS creation_date, job_id, v AS value_num, 0::BIGINT AS _ingested, event_id AS _pos
FROM rec""",
    "dedupe_last": f"""WITH {REC} SELECT user_id, record_type, start_date, value, job_id
FROM ({HOURLY}) WHERE rn = 1""",
    "timeline": f"""WITH {REC}, {ECG}, {TRACKS}, {JOBS}
SELECT user_id, 'RECORD#' || record_type || '#' || start_date AS sk,
  record_type || '#' || start_date AS type_time_key, value, NULL AS status,
  NULL AS waypoint_count FROM rec
UNION ALL SELECT user_id, 'RECORD#ECG#' || ecg_time || '#' || event_id,
  'ECG#' || ecg_time, NULL, NULL, NULL FROM ecg
UNION ALL SELECT user_id, 'RECORD#GPX#' || route_time || '#0', 'GPX#' || route_time,
  NULL, NULL, waypoint_count FROM tracks
UNION ALL SELECT user_id, 'JOB#' || job_id, 'JOB#' || job_id, NULL, status, NULL
  FROM jobs""",
    "user_scope": f"""WITH {REC}
SELECT user_id, record_type, start_date, value FROM rec WHERE user_id = '42'""",
    "date_range": f"""WITH {REC} SELECT user_id, start_date FROM rec
WHERE {HEART_RATE} AND start_date BETWEEN '{START}' AND '{END}'""",
    "type_filter": f"""WITH {REC} SELECT user_id, record_type, start_date FROM rec
WHERE record_type IN ('HeartRate', 'StepCount')""",
    "parse_number": """SELECT event_id, CASE event_id % 8 WHEN 0 THEN value
  WHEN 1 THEN value WHEN 2 THEN ('10' || value::VARCHAR)::DOUBLE
  WHEN 3 THEN (value::VARCHAR || 'e1')::DOUBLE END AS number FROM events""",
    "key_prefix": f"""WITH {JOBS} SELECT user_id, 'JOB#' || job_id AS sk, status
FROM jobs""",
    "order_by_start": f"""WITH {REC}
SELECT user_id, start_date, value FROM rec ORDER BY user_id, start_date""",
    "metric_page": f"""WITH {REC} SELECT user_id, start_date, value, position, page_count
FROM ({page("rec", "start_date", 100, HEART_RATE)})""",
    "metric_page_next": f"""WITH {REC} SELECT user_id, start_date, value,
  (position - first)::INTEGER AS position,
  count(*) OVER (PARTITION BY user_id) AS page_count
FROM (SELECT *, 7 AS first FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_date) AS position,
    count(*) OVER (PARTITION BY user_id) AS total
  FROM rec WHERE {HEART_RATE} AND start_date BETWEEN '{START}' AND '{END}'))
WHERE position > first AND position <= first + 7""",
    "page_count": f"""WITH {REC} SELECT DISTINCT user_id, page_count
FROM ({page("rec", "start_date", 7, HEART_RATE)})""",
    "next_cursor": f"""WITH {REC} SELECT user_id, CASE WHEN any_value(page_count) = 7 THEN
  replace(replace(base64(encode(arg_max('{{"start_date":"' || start_date || '","_pos":'
    || event_id || '}}', position))), '+', '-'), '/', '_') END AS next_cursor
FROM ({page("rec", "start_date", 7, HEART_RATE)}) GROUP BY user_id""",
    "decode_cursor": f"""WITH {REC} SELECT user_id, start_date, event_id AS _pos
FROM rec""",
    "ecg_page": f"""WITH {ECG} SELECT user_id, ecg_time, classification, position,
  page_count FROM ({page("ecg", "ecg_time", 5)})""",
    "workout_page": f"""WITH {TRACKS} SELECT user_id, route_time, waypoint_count,
  start_lat, start_lon, end_lat, end_lon, position, page_count
FROM ({page("tracks", "route_time", 5)})""",
    "recent_jobs": f"""WITH {JOBS} SELECT user_id, job_id, status, updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY job_id DESC) AS rn
  FROM jobs) WHERE rn <= 20 ORDER BY user_id, updated_at DESC, job_id DESC""",
    "latest_by_key": f"""WITH {JOBS} SELECT user_id, job_id, status, updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id
    ORDER BY updated_at DESC, job_id DESC) AS rn FROM jobs) WHERE rn = 1""",
    "normalise_users": f"""SELECT {USER_COLUMNS},
  '2024-02-01T00:00:00.000000' AS created_at, '2024-02-01T00:00:00.000000' AS updated_at,
  'active' AS status, split_part(c_name, '#', 1) AS given_name,
  split_part(c_name, '#', 2) AS family_name, c_name AS name FROM customer""",
    "upsert_users": f"""SELECT {USER_COLUMNS},
  CASE WHEN c_acctbal > 0 THEN '2024-02-01' ELSE '2024-01-01' END
    || 'T00:00:00.000000' AS updated_at, 'active' AS status FROM customer""",
    "check_requests": f"""WITH {REQUESTS}
SELECT request_id, granularity, "limit", error_code FROM checked""",
    "answer_daily": f"""WITH {REC}, {REQUESTS},
hit AS (SELECT c.request_id, r.* FROM checked c JOIN rec r ON r.user_id = c.user_id
  AND r.record_type = c.type AND r.start_date BETWEEN c.s AND c.e || '~'
  WHERE c.error_code IS NULL AND c.granularity = 'daily'),
units AS (SELECT request_id, arg_min(unit, start_date) AS unit FROM hit GROUP BY ALL)
SELECT request_id, user_id, record_type, start_date[1:10] AS date, {stats()},
  count(*) AS "count", any_value(units.unit) AS unit
FROM hit JOIN units USING (request_id)
GROUP BY request_id, user_id, record_type, start_date[1:10]""",
    "answer_raw": f"""WITH {REC}, {REQUESTS}
SELECT request_id, user_id, record_type, start_date, value, position FROM (
  SELECT c.request_id, r.*, c."limit", row_number() OVER (PARTITION BY c.request_id
    ORDER BY r.start_date)::INTEGER AS position
  FROM checked c JOIN rec r ON r.user_id = c.user_id AND r.record_type = c.type
    AND r.start_date BETWEEN c.s AND c.e || '~'
  WHERE c.error_code IS NULL AND c.granularity = 'raw')
WHERE position <= "limit" """,
    "answer_raw_next": f"""WITH {REC}, {REQUESTS}
SELECT request_id, user_id, record_type, start_date, value, (place - "limit")::INTEGER AS position FROM (
  SELECT c.request_id, r.*, c."limit", row_number() OVER (PARTITION BY c.request_id
    ORDER BY r.start_date) AS place
  FROM checked c JOIN rec r ON r.user_id = c.user_id AND r.record_type = c.type
    AND r.start_date BETWEEN c.s AND c.e || '~'
  WHERE c.error_code IS NULL AND c.granularity = 'raw')
WHERE place > "limit" AND place <= 2 * "limit" """,
    "answer_ecg_next": f"""WITH {ECG}, {REQUESTS}
SELECT request_id, user_id, ecg_time, classification, (place - "limit")::INTEGER AS position FROM (
  SELECT c.request_id, r.*, c."limit", row_number() OVER (PARTITION BY c.request_id
    ORDER BY r.ecg_time) AS place
  FROM listed c JOIN ecg r ON r.user_id = c.user_id
    AND r.ecg_time BETWEEN c.s AND c.e || '~' WHERE c.error_code IS NULL)
WHERE place > "limit" AND place <= 2 * "limit" """,
    "check_requests_ecg": f"""WITH {REQUESTS}
SELECT request_id, "limit", error_code FROM listed""",
    "answer_ecg": f"""WITH {ECG}, {REQUESTS}
SELECT request_id, user_id, ecg_time, classification, position FROM (
  SELECT c.request_id, r.*, c."limit", row_number() OVER (PARTITION BY c.request_id
    ORDER BY r.ecg_time)::INTEGER AS position
  FROM listed c JOIN ecg r ON r.user_id = c.user_id
    AND r.ecg_time BETWEEN c.s AND c.e || '~' WHERE c.error_code IS NULL)
WHERE position <= "limit" """,
    "answer_workouts": f"""WITH {TRACKS}, {REQUESTS}
SELECT request_id, user_id, route_time, waypoint_count, position FROM (
  SELECT c.request_id, r.*, c."limit", row_number() OVER (PARTITION BY c.request_id
    ORDER BY r.route_time)::INTEGER AS position
  FROM listed c JOIN tracks r ON r.user_id = c.user_id
    AND r.route_time BETWEEN c.s AND c.e || '~' WHERE c.error_code IS NULL)
WHERE position <= "limit" """,
    "export_arrivals": f"""WITH {EXPORTS}
SELECT user_id || '/' || job_id || '.zip' AS name, true AS filled FROM exports""",
    "parse_export_key": f"""WITH {EXPORTS}
SELECT user_id, job_id, NULL::VARCHAR AS reason FROM exports""",
    "list_members": f"""WITH {MEMBERS}
SELECT user_id, job_id, member, member_ordinal, kind, NULL::VARCHAR AS reason
FROM members""",
    "export_manifest": f"""WITH {MEMBERS}
SELECT user_id, job_id, member, member_ordinal, kind FROM members
WHERE kind IS NOT NULL""",
    "validate_exports": f"""WITH {MEMBERS}
SELECT user_id, job_id, count(*) AS file_count, true AS valid,
  NULL::VARCHAR AS reason FROM members GROUP BY ALL""",
    "unpack_members": f"""WITH {MEMBERS}
SELECT user_id, job_id, member, CASE WHEN kind = 'xml' THEN
  'kind=xml/user_id=' || user_id || '/job_id=' || job_id || '/'
  || lpad(member_ordinal::VARCHAR, 8, '0') || '.xml' END AS staged,
  CASE WHEN kind <> 'xml' THEN true END AS whole
FROM members WHERE kind IS NOT NULL""",
    "ingest_stream": f"""WITH {MEMBERS}
SELECT user_id, job_id, member, kind, NULL::VARCHAR AS reason FROM members""",
    "pick_export_xml": f"""WITH {EXPORTS}
SELECT user_id, job_id, 'export/export.xml' AS member FROM exports""",
    "ingest_counts": f"""WITH {MEMBERS},
f AS (SELECT user_id, job_id, count(*) AS file_count,
    count(*) FILTER (WHERE kind = 'xml') AS xml_members,
    count(*) FILTER (WHERE kind = 'ecg') AS ecg_members,
    count(*) FILTER (WHERE kind = 'gpx') AS gpx_members FROM members GROUP BY ALL),
r AS (SELECT user_id::VARCHAR AS user_id, (event_id % 3)::VARCHAR AS job_id,
    count(*) FILTER (WHERE event_type <> 'error') AS records_kept,
    count(*) FILTER (WHERE event_type = 'error') AS records_skipped,
    count(*) FILTER (WHERE event_type = 'view') AS ecg_rows,
    count(DISTINCT strftime(ts, '%Y%m%d')) AS routes FROM events GROUP BY ALL)
SELECT * FROM f JOIN r USING (user_id, job_id)""",
    "scan_health_xml": f"""SELECT user_id::VARCHAR AS user_id,
  (event_id % 3)::VARCHAR AS job_id,
  CASE event_type WHEN 'click' THEN 'HKQuantityTypeIdentifierHeartRate'
    WHEN 'view' THEN 'HKQuantityTypeIdentifierHeartRateVariabilitySDNN'
    WHEN 'purchase' THEN 'HKQuantityTypeIdentifierBloodPressureSystolic'
    WHEN 'signup' THEN 'HKQuantityTypeIdentifierStepCount' ELSE 'Untracked' END AS type,
  'u' AS unit, value::VARCHAR AS value, {TS} AS start_date, '' AS creation_date
FROM events""",
    "scan_ecg_csv": f"""WITH {ECG} SELECT user_id, job_id, ecg_time, classification,
  'export/electrocardiograms/ecg_' || day || '.csv' AS source_file,
  average_heart_rate, row_number() OVER (PARTITION BY user_id, job_id, day
    ORDER BY event_id) - 1 AS row_in_file FROM ecg""",
    "scan_gpx_routes": f"""SELECT user_id::VARCHAR AS user_id,
  (event_id % 3)::VARCHAR AS job_id,
  string_agg(value::VARCHAR || '|' || event_id || '|1|' || {TS}, ';' ORDER BY event_id)
    AS waypoints
FROM events GROUP BY user_id, event_id % 3, strftime(ts, '%Y%m%d')""",
    "ecg_projection": ECG_ROWS,
    "row_ordinal": f"""WITH {ECG} SELECT user_id, job_id, ecg_time,
  row_number() OVER (PARTITION BY user_id, job_id ORDER BY day, event_id) - 1 AS ordinal
FROM ecg""",
    "route_projection": ROUTE_ROWS,
    "job_status": f"""WITH {EXPORTS} SELECT user_id, job_id, 'COMPLETED' AS status,
  '1706745600' AS updated_at, NULL::VARCHAR AS error_step FROM exports""",
    "scan_table_records": f"""WITH {REC} SELECT user_id, record_type, start_date, value,
  'u' AS unit, '' AS creation_date, job_id, v AS value_num FROM rec""",
    "scan_table_ecg": ECG_ROWS,
    "scan_table_routes": ROUTE_ROWS,
    "scan_table_jobs": f"""WITH {EXPORTS} SELECT user_id, job_id, 'COMPLETED' AS status,
  '1706745600' AS updated_at, NULL::VARCHAR AS error_step FROM exports""",
    "upsert_records": PUT_TWICE,
    "compact_records": DAILY,
    "scan_newer": PUT_TWICE,
    "compact_twice": PUT_TWICE,
}
