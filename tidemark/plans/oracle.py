"""SQL equivalents of the registered queries, for an independent engine.

The texts follow the meaning of each query step by step (recipient lists are built pair by pair, the
recent window compares texts), not the way Spark computes it.
"""

# Logical tables over the given ones; FIXTURES.md explains the cases they contain.
TABLES = r"""
users AS (
  SELECT CAST(n_nationkey AS BIGINT) AS user_id, n_name AS username, lower(n_name) || '@example.com' AS email
  FROM nation),
devices AS (
  SELECT c_custkey AS device_id, CAST(c_nationkey AS BIGINT) AS user_id,
         CASE WHEN c_custkey % 10 = 0 THEN 'Shared' ELSE c_name END AS device_name,
         md5('a' || c_custkey::VARCHAR) AS api_key,
         CASE WHEN c_custkey % 50 = 7 THEN NULL WHEN c_custkey % 50 = 8 THEN ''
              ELSE md5('s' || c_custkey::VARCHAR) END AS secret_key,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'dev-' || c_custkey::VARCHAR END AS public_slug
  FROM customer),
sensor_data AS (
  SELECT event_id + 1 AS data_id, CASE WHEN event_id % 53 = 0 THEN user_id + 1000000000 ELSE user_id END AS device_id,
         event_type AS sensor_type,
         CASE WHEN event_type = 'error' THEN CASE WHEN value >= 25 THEN 'true' ELSE 'false' END
              WHEN event_id % 97 = 0 THEN '' ELSE CAST(value AS VARCHAR) END AS value, ts
  FROM events),
kinds AS (
  SELECT * FROM (VALUES (1, 'signup', 'text', 'string'), (2, 'purchase', 'gauge', 'integer'),
    (3, 'error', 'toggle', 'boolean'), (4, 'view', 'slider', 'integer'), (5, 'click', 'graph', 'float'),
    (6, 'view', 'gauge', 'float')) AS k(idx, sensor_type, widget_type, data_type)),
widgets AS (
  SELECT c_custkey * 10 + idx AS widget_id,
         CAST(CASE WHEN idx = 6 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END AS BIGINT) AS user_id,
         c_custkey AS device_id, sensor_type, widget_type, data_type,
         CASE widget_type WHEN 'toggle' THEN 'false' WHEN 'slider' THEN '0' ELSE '' END AS current_value
  FROM customer CROSS JOIN kinds
  WHERE NOT (c_mktsegment = 'FURNITURE' AND idx = 1) AND NOT (c_mktsegment = 'HOUSEHOLD' AND idx = 5)
    AND (idx < 6 OR c_mktsegment = 'MACHINERY')),
connections AS (
  SELECT o_orderkey AS conn_key,
         CASE o_orderkey % 4 WHEN 0 THEN 'dashboard' WHEN 3 THEN 'public' ELSE 'device' END AS conn_type,
         device_id, user_id, public_slug AS slug, opened_at,
         CASE WHEN o_orderstatus <> 'P' THEN opened_at + to_seconds(o_orderkey % 30) END AS auth_at,
         CASE WHEN o_orderstatus = 'F' THEN opened_at + INTERVAL 1 HOUR END AS closed_at
  FROM (SELECT *, TIMESTAMP '2024-01-01' + to_seconds(
          date_diff('day', DATE '1992-01-01', o_orderdate::DATE) % 30 * 86400 + o_orderkey * 7919 % 86400) AS opened_at FROM orders)
  JOIN devices ON o_custkey = device_id),
messages AS (
  SELECT event_id AS msg_id, ts,
         CASE WHEN event_id % 41 = 0 THEN 'no-such-key' ELSE md5('s' || user_id::VARCHAR) END AS secret_key,
         CASE event_id % 12
           WHEN 0 THEN '{"sensor_type":"' || event_type || '","value":"' || value::VARCHAR || '"}'
           WHEN 1 THEN '{"var":"' || event_type || '"}'
           WHEN 2 THEN '{"var":"' || event_type || '","val":null,"value":3}'
           WHEN 3 THEN '{"var":"","sensor_type":"' || event_type || '","val":1}'
           WHEN 4 THEN 'not json ' || event_type
           WHEN 5 THEN '{"device_id":' || user_id::VARCHAR || ',"var":"' || event_type || '","val":"true"}'
           WHEN 6 THEN '{"device_id":' || (user_id + 1)::VARCHAR || ',"var":"' || event_type || '","val":"true"}'
           WHEN 7 THEN '{"type":"command","var":"' || event_type || '","val":' || value::VARCHAR || '}'
           WHEN 8 THEN '{"var":null,"sensor_type":"' || event_type || '","val":true}'
           WHEN 9 THEN '{"device_id":"","var":"' || event_type || '","val":' || value::VARCHAR || '}'
           WHEN 10 THEN '{"device_id":' || user_id::VARCHAR || ',"sensor_type":"' || event_type
                        || '","current_value":"true"}'
           ELSE '{"var":"' || event_type || '","val":' || value::VARCHAR || '}' END AS raw
  FROM events),
clock AS (SELECT max(ts) AS as_of FROM sensor_data),
recent AS (
  SELECT s.* FROM sensor_data s, clock
  WHERE strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') >= strftime(as_of - INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S')),
latest AS (
  SELECT device_id, sensor_type, value, ts, data_id FROM (
    SELECT *, row_number() OVER (PARTITION BY device_id, sensor_type ORDER BY ts DESC, data_id DESC) AS n
    FROM sensor_data) WHERE n = 1),
live_widgets AS (
  SELECT w.* REPLACE (CASE WHEN l.data_id IS NOT NULL THEN l.value ELSE w.current_value END AS current_value)
  FROM widgets w LEFT JOIN latest l USING (device_id, sensor_type)),
registry AS (
  SELECT secret_key, device_id, device_name, user_id FROM devices WHERE secret_key IS NOT NULL AND secret_key <> ''),
newest AS (
  SELECT device_id, conn_key, auth_at FROM (
    SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY auth_at DESC, conn_key DESC) AS n
    FROM connections WHERE conn_type = 'device' AND auth_at IS NOT NULL) WHERE n = 1),
updates AS (
  SELECT data_id AS update_id, s.device_id, user_id, device_name, public_slug, sensor_type, value, ts,
         n.conn_key AS sender_key
  FROM sensor_data s JOIN devices d USING (device_id) LEFT JOIN newest n USING (device_id)),
opened AS (
  SELECT c.* FROM connections c, clock
  WHERE opened_at <= as_of AND (closed_at IS NULL OR closed_at > as_of)),
subs AS (
  SELECT conn_key, conn_type, device_id, user_id, slug FROM opened, clock
  WHERE CASE conn_type WHEN 'public' THEN slug IS NOT NULL ELSE coalesce(auth_at <= as_of, FALSE) END)
"""

# Payload fields by JSON functions: SQL NULL type = missing, the text NULL = JSON null.
MESSAGES = r"""
parsed AS (
  SELECT *, CASE WHEN json_valid(raw) AND json_type(raw) <> 'NULL' THEN raw END AS j FROM messages),
extracted AS (
  SELECT *,
    CASE WHEN coalesce(json_type(j, '$.var'), 'NULL') <> 'NULL' THEN j ->> '$.var'
         WHEN coalesce(json_type(j, '$.sensor_type'), 'NULL') <> 'NULL' THEN j ->> '$.sensor_type' END AS name,
    json_type(j, '$.val') IS NOT NULL OR json_type(j, '$.value') IS NOT NULL AS value_present,
    CASE WHEN json_type(j, '$.val') IS NOT NULL THEN json_type(j, '$.val') ELSE json_type(j, '$.value') END AS vtype,
    CASE WHEN json_type(j, '$.val') IS NOT NULL THEN j ->> '$.val' ELSE j ->> '$.value' END AS vtext,
    nullif(CASE WHEN coalesce(json_type(j, '$.device_id'), 'NULL') <> 'NULL' THEN j ->> '$.device_id' END, '') AS target,
    coalesce(j ->> '$.type' = 'command', FALSE) AS typed
  FROM parsed),
fields AS (
  SELECT msg_id, ts, secret_key, raw, j IS NOT NULL AS is_json, coalesce(name <> '', FALSE) AS name_ok,
    name AS sensor_type, value_present,
    CASE WHEN vtype = 'NULL' THEN NULL WHEN vtype = 'DOUBLE' THEN regexp_replace(vtext, '\.0$', '') ELSE vtext END AS value,
    target, typed OR target IS NOT NULL AS is_command
  FROM extracted),
live AS (
  SELECT conn_key, device_id, greatest(opened_at, auth_at) AS since, closed_at AS until FROM connections
  WHERE conn_type = 'device' AND auth_at IS NOT NULL AND (closed_at IS NULL OR closed_at > greatest(opened_at, auth_at))),
-- The connection of the device that started last before the message, if it is still open.
senders AS (
  SELECT msg_id, CASE WHEN until IS NULL OR until > ts THEN conn_key END AS sender_key FROM (
    SELECT f.msg_id, f.ts, l.conn_key, l.until,
      row_number() OVER (PARTITION BY f.msg_id ORDER BY l.since DESC, l.conn_key DESC) AS n
    FROM fields f JOIN registry r ON f.secret_key = r.secret_key JOIN live l ON l.device_id = r.device_id AND l.since <= f.ts)
  WHERE n = 1),
from_device AS (
  SELECT f.*, r.device_id AS auth_id, r.device_name, r.user_id, s.sender_key,
    coalesce(f.target, CAST(r.device_id AS VARCHAR)) AS target_text,
    CASE WHEN r.device_id IS NULL THEN 'unauthenticated' WHEN NOT is_json THEN 'malformed'
         WHEN NOT name_ok OR NOT value_present THEN 'invalid'
         WHEN is_command AND coalesce(f.target, CAST(r.device_id AS VARCHAR)) <> CAST(r.device_id AS VARCHAR)
           THEN 'cross_device'
         WHEN is_command THEN 'command' ELSE 'data' END AS outcome
  FROM fields f LEFT JOIN registry r ON f.secret_key = r.secret_key LEFT JOIN senders s USING (msg_id)),
from_dashboard AS (
  SELECT f.*, r.user_id, CAST(NULL AS BIGINT) AS sender_key, f.target AS target_text,
    CASE WHEN NOT is_json THEN 'malformed'
         WHEN f.target IS NULL OR f.target = '0' OR NOT name_ok OR NOT value_present THEN 'invalid'
         ELSE 'command' END AS outcome
  FROM fields f JOIN registry r ON f.secret_key = r.secret_key),
commands AS (
  SELECT 'device' AS origin, msg_id, ts, target_text, sensor_type, value, sender_key
  FROM from_device WHERE outcome = 'command'
  UNION ALL
  SELECT 'dashboard', msg_id, ts, target_text, sensor_type, value, sender_key
  FROM from_dashboard WHERE outcome = 'command'),
acks AS (
  SELECT origin, msg_id, TRY_CAST(target_text AS BIGINT) AS target_id, 'ack' AS status, target_text AS device_id,
    sensor_type AS var,
    CASE WHEN count(i.conn_key) > 0 THEN coalesce(value, 'null') ELSE value END AS val,
    CASE WHEN count(i.conn_key) = 0 THEN 'Nilai disimpan (device offline)' END AS message,
    count(i.conn_key) AS n_sent
  FROM commands c LEFT JOIN live i
    ON i.device_id = TRY_CAST(target_text AS BIGINT) AND (c.sender_key IS NULL OR i.conn_key <> c.sender_key)
    AND i.since <= c.ts AND (i.until IS NULL OR i.until > c.ts)
  GROUP BY origin, msg_id, target_text, sensor_type, value)
"""

REQUESTS = r"""
registrations AS (
  SELECT request_id, username, lower(username) || '@example.com' AS email, password_length, password_match FROM (
    SELECT c_custkey AS request_id,
      CASE WHEN c_acctbal < 0 THEN '' WHEN c_acctbal > 8000 THEN 'NATION_' || c_nationkey::VARCHAR
           ELSE lower(c_mktsegment) || '-' || c_nationkey::VARCHAR END AS username,
      c_custkey % 9 + 3 AS password_length, c_custkey % 13 <> 0 AS password_match
    FROM customer)),
form_checked AS (
  SELECT *, CASE WHEN NOT password_match THEN 'mismatch' WHEN password_length < 6 THEN 'short'
                 WHEN username = '' OR email = '' THEN '400'
                 WHEN username IN (SELECT username FROM users) OR email IN (SELECT email FROM users) THEN '409'
            END AS refused FROM registrations),
registered AS (
  SELECT request_id, username, email, coalesce(refused, CASE WHEN row_number() OVER (
      PARTITION BY refused IS NULL, username ORDER BY request_id) = 1 THEN '201' ELSE '409' END) AS status
  FROM form_checked),
device_requests AS (
  SELECT c_custkey AS request_id, CAST(c_nationkey AS BIGINT) AS user_id,
    CASE WHEN c_acctbal < 0 THEN '' WHEN c_acctbal > 9500 THEN NULL ELSE c_name END AS device_name
  FROM customer),
widget_requests AS (
  SELECT o_orderkey AS request_id, o_orderkey % 25 AS user_id,
    CASE WHEN o_totalprice > 490000 THEN NULL ELSE o_custkey END AS device_id,
    CASE WHEN o_totalprice < 10000 THEN '' ELSE o_orderpriority END AS sensor_type,
    CASE o_orderkey % 5 WHEN 0 THEN 'toggle' WHEN 1 THEN 'slider' WHEN 2 THEN 'gauge' WHEN 3 THEN 'graph'
         ELSE 'text' END AS widget_type,
    CASE WHEN o_orderstatus = 'P' THEN 'integer' ELSE 'string' END AS data_type
  FROM orders),
widget_results AS (
  SELECT *, CAST(CASE WHEN coalesce(device_id, 0) = 0 OR coalesce(sensor_type, '') = ''
                 THEN 400 ELSE 201 END AS BIGINT) AS status FROM widget_requests),
owned_requests AS (
  SELECT o.*, CAST(CASE WHEN o_orderstatus = 'P' THEN (c_nationkey + 1) % 25 ELSE c_nationkey END AS BIGINT) AS user_id
  FROM orders o JOIN customer ON o_custkey = c_custkey),
slug_requests AS (
  SELECT o_orderkey AS request_id, o_custkey AS device_id, user_id,
    CASE o_orderkey % 6 WHEN 0 THEN 'dev-' || o_custkey::VARCHAR
         WHEN 1 THEN 'page_' || CAST(floor(o_totalprice / 100) AS BIGINT)::VARCHAR
         WHEN 2 THEN 'bad slug' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE 'ok-' || o_orderkey::VARCHAR END AS custom_slug
  FROM owned_requests),
delete_requests AS (
  SELECT o_orderkey AS request_id, o_custkey AS device_id,
    CASE WHEN o_orderpriority = '1-URGENT' THEN user_id ELSE (user_id + 2) % 25 END AS user_id
  FROM owned_requests),
delete_results AS (
  SELECT r.request_id, r.device_id, r.user_id,
    CAST(CASE WHEN d.device_id IS NOT NULL AND row_number() OVER (
      PARTITION BY d.device_id ORDER BY r.request_id) = 1 THEN 200 ELSE 404 END AS BIGINT) AS status
  FROM delete_requests r LEFT JOIN devices d ON r.device_id = d.device_id AND r.user_id = d.user_id),
deleted AS (SELECT device_id FROM delete_results WHERE status = 200),
handshakes AS (
  SELECT o_orderkey AS conn_key, o_orderdate AS opened_at, o_orderdate + to_seconds(o_orderkey % 30) AS ts,
    o_orderstatus <> 'P' AS is_auth, device_id, device_name
  FROM orders LEFT JOIN registry ON o_orderstatus <> 'P' AND o_totalprice <= 400000
    AND secret_key = md5('s' || o_custkey::VARCHAR))
"""

# Slug requests taken one by one: a table by key of who holds which slug, which slug a device has, and who won.
SLUGS = r"""
slug_asks AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY request_id) AS n, request_id, r.device_id, custom_slug
  FROM slug_requests r JOIN devices d ON r.device_id = d.device_id AND r.user_id = d.user_id
  WHERE regexp_full_match(custom_slug, '[a-zA-Z0-9_-]+')),
taken(key, id, slug) USING KEY (key) AS (
  SELECT 'slug ' || public_slug, device_id, NULL::VARCHAR FROM devices WHERE public_slug IS NOT NULL
  UNION SELECT 'own ' || device_id::VARCHAR, NULL, public_slug FROM devices WHERE public_slug IS NOT NULL
  UNION SELECT 'last', 0, NULL
  UNION (
    WITH ask AS (
      SELECT a.*, h.id AS holder, o.slug AS old FROM slug_asks a JOIN taken t ON t.key = 'last' AND a.n = t.id + 1
      LEFT JOIN recurring.taken h ON h.key = 'slug ' || a.custom_slug
      LEFT JOIN recurring.taken o ON o.key = 'own ' || a.device_id::VARCHAR),
    won AS (SELECT * FROM ask WHERE holder IS NULL OR holder = device_id)
    SELECT 'last', n, NULL FROM ask
    UNION ALL SELECT 'won ' || request_id::VARCHAR, request_id, NULL FROM won
    UNION ALL SELECT 'slug ' || old, NULL, NULL FROM won WHERE old <> custom_slug
    UNION ALL SELECT 'slug ' || custom_slug, device_id, NULL FROM won
    UNION ALL SELECT 'own ' || device_id::VARCHAR, NULL, custom_slug FROM won)),
slug_results AS MATERIALIZED (
  SELECT request_id, device_id, user_id, custom_slug, status, status = 200 AND owned AS applies,
    CASE WHEN status = 200 THEN '/' || custom_slug END AS url
  FROM (SELECT r.*, d.device_id IS NOT NULL AS owned, CAST(
          CASE WHEN NOT coalesce(regexp_full_match(r.custom_slug, '[a-zA-Z0-9_-]+'), FALSE) THEN 400
               WHEN d.device_id IS NOT NULL AND w.id IS NULL THEN 409 ELSE 200 END AS BIGINT) AS status
        FROM slug_requests r LEFT JOIN devices d ON r.device_id = d.device_id AND r.user_id = d.user_id
        LEFT JOIN (SELECT id FROM taken WHERE starts_with(key, 'won ')) w ON w.id = r.request_id))
"""

ORACLE: dict[str, str] = {}


def add(name: str, sql: str, more: str = "") -> None:
    """Register a query; the shared tables, and ``more``, are put in front of it."""
    ORACLE[name] = f"WITH {'RECURSIVE ' if more else ''}{TABLES}, {MESSAGES}, {REQUESTS}{', ' if more else ''}{more}\n{sql.strip()}"


J1 = """SELECT user_id, device_id, device_name, sensor_type, value, ts, data_id
FROM {readings} JOIN devices USING (device_id)"""
add("J1_readings_24h", J1.format(readings="recent"))
add("J1_readings_24h_exact", J1.format(
    readings="(SELECT s.* FROM sensor_data s, clock WHERE ts >= as_of - INTERVAL 1 DAY)"))
add("P2_device_readings_24h", "SELECT data_id, device_id, sensor_type, value, ts FROM recent")
add("J2_device_export", """
SELECT user_id, device_id, ts, sensor_type, value, data_id FROM sensor_data JOIN devices USING (device_id)""")
add("J2_requested_exports", """
SELECT d.user_id, s.device_id, ts, sensor_type, value, data_id FROM sensor_data s JOIN devices d USING (device_id)
WHERE EXISTS (SELECT 1 FROM widgets w WHERE w.device_id = d.device_id AND w.user_id = d.user_id)""")
add("J3_widgets_with_device", """
SELECT w.user_id, widget_id, w.device_id, sensor_type, widget_type, data_type, current_value, device_name
FROM widgets w JOIN devices d ON w.device_id = d.device_id""")
add("J4_public_lookup", """
SELECT request_id, r.username, r.device_name,
  CASE WHEN coalesce(r.username, '') = '' OR coalesce(r.device_name, '') = '' THEN 400
       WHEN min(d.device_id) IS NULL THEN 404 ELSE 200 END AS status,
  CASE WHEN r.device_name <> '' THEN min(d.device_id) END AS device_id
FROM (SELECT c_custkey AS request_id,
        CASE WHEN c_acctbal > 9800 THEN NULL ELSE 'NATION_' || c_nationkey::VARCHAR END AS username,
        CASE WHEN c_acctbal < -900 THEN '' WHEN c_mktsegment = 'FURNITURE' THEN 'Shared' ELSE c_name END AS device_name
      FROM customer) r
LEFT JOIN (devices d JOIN users u ON d.user_id = u.user_id)
  ON u.username = r.username AND d.device_name = r.device_name
GROUP BY request_id, r.username, r.device_name""")
add("J5_slug_lookup", """
SELECT o_orderkey AS request_id, 'dev-' || o_custkey::VARCHAR AS slug, device_id, device_name,
  CASE WHEN device_id IS NULL THEN 404 ELSE 200 END AS status
FROM orders LEFT JOIN devices ON public_slug = 'dev-' || o_custkey::VARCHAR""")
add("P1_devices_of_users", "SELECT user_id, device_id, device_name, secret_key FROM devices")
add("P1_user_by_name", "SELECT user_id, username, email FROM users WHERE username = 'NATION_7'")
add("P1_widgets_of_devices",
    "SELECT device_id, widget_id, sensor_type, widget_type, data_type, current_value FROM widgets")
add("S3_registry", "SELECT secret_key, device_id, device_name, user_id FROM registry")
add("P4_missing_keys", "SELECT device_id, secret_key FROM devices WHERE secret_key IS NULL OR secret_key = ''")
add("F14_query_fields", r"""
SELECT page_id, nullif(regexp_extract(q, '(?:^|&)utm_source=([^&]*)', 1), '') AS utm_source,
  nullif(regexp_extract(q, '(?:^|&)page=([^&]*)', 1), '') AS page,
  nullif(regexp_extract(q, '(?:^|&)ref=([^&]*)', 1), '') AS ref
FROM (SELECT page_id, CASE WHEN contains(split_part(url, '#', 1), '?')
        THEN split_part(split_part(url, '#', 1), '?', 2) ELSE '' END AS q FROM pages)""")
add("A2_counts", """
SELECT u.user_id, count(r.data_id) AS n_rows
FROM users u LEFT JOIN (devices d JOIN recent r ON r.device_id = d.device_id) ON d.user_id = u.user_id
GROUP BY u.user_id""")

add("A2_registry_counts", """
SELECT user_id, CAST(count(*) FILTER (secret_key <> '') AS BIGINT) AS n_keys,
  CAST(count(*) FILTER (coalesce(secret_key, '') = '') AS BIGINT) AS n_missing FROM devices GROUP BY user_id""")

add("A1_current_values", "SELECT device_id, sensor_type, value, ts, data_id FROM latest")
add("K2_widget_snapshot", """
SELECT widget_id, user_id, device_id, sensor_type, widget_type, data_type, current_value FROM live_widgets""")
W1 = """SELECT * FROM (SELECT data_id, device_id, sensor_type, value, ts, row_number() OVER (
  PARTITION BY device_id, sensor_type ORDER BY ts DESC, data_id DESC) AS rank FROM sensor_data) WHERE rank <= {n}"""
add("W1_last_40_points", W1.format(n=40))
add("W1_last_10_points", W1.format(n=10))
add("W4_visible_widgets", """
SELECT * FROM widgets w WHERE widget_id = (
  SELECT min(widget_id) FROM widgets v WHERE v.device_id = w.device_id AND v.sensor_type = w.sensor_type)""")
add("J13_widget_readings", """
SELECT widget_id, device_id, sensor_type, widget_type, data_id, value, ts
FROM widgets LEFT JOIN recent USING (device_id, sensor_type)""")
add("A4_series_rows", """
SELECT widget_id, device_id, sensor_type, data_id, ts, strftime(ts, '%H:%M:%S') AS label, value
FROM widgets JOIN recent USING (device_id, sensor_type) WHERE widget_type = 'graph'""")
add("T6_live_series_rows", """
SELECT device_id, sensor_type, row_number() OVER (PARTITION BY device_id, sensor_type ORDER BY ts, data_id) - 1 AS pos,
  strftime(ts, '%H:%M:%S') AS label, value
FROM (SELECT *, row_number() OVER (PARTITION BY device_id, sensor_type ORDER BY ts DESC, data_id DESC) AS n
      FROM sensor_data) WHERE n <= 40""")
add("D1_widget_display", r"""
SELECT widget_id, device_id, sensor_type, widget_type, data_type,
  CASE widget_type WHEN 'toggle' THEN CASE WHEN current_value = 'true' THEN 'NYALA' ELSE 'MATI' END
    WHEN 'slider' THEN number::VARCHAR WHEN 'gauge' THEN number::VARCHAR
    WHEN 'graph' THEN CASE WHEN current_value <> '' THEN current_value ELSE '-' END
    ELSE CASE WHEN current_value <> '' THEN current_value ELSE coalesce(newest, '-') END END AS shown,
  widget_type = 'text' AS is_text,
  CASE WHEN widget_type = 'toggle' THEN coalesce(current_value = 'true', FALSE) END AS is_on,
  CASE WHEN widget_type = 'gauge' THEN number END AS gauge_value,
  CASE WHEN widget_type = 'gauge' THEN 100 - number END AS gauge_rest,
  CASE WHEN widget_type = 'slider' THEN number END AS slider_value,
  CAST(CASE WHEN widget_type = 'slider' THEN 0 END AS INTEGER) AS slider_min,
  CAST(CASE WHEN widget_type = 'slider' THEN 255 END AS INTEGER) AS slider_max
FROM (SELECT w.*, coalesce(TRY_CAST(nullif(regexp_extract(current_value, '^\s*([+-]?[0-9]+)', 1), '') AS BIGINT), 0)
        AS number, n.value AS newest
      FROM live_widgets w LEFT JOIN (
        SELECT device_id, sensor_type, value FROM recent r WHERE NOT EXISTS (
          SELECT 1 FROM recent q WHERE q.device_id = r.device_id AND q.sensor_type = r.sensor_type
            AND (q.ts, q.data_id) > (r.ts, r.data_id))) n
      USING (device_id, sensor_type))""")
add("A5_bundle_rows", """
, pages_wanted AS (SELECT DISTINCT device_id, device_name FROM orders JOIN devices
                   ON public_slug = 'dev-' || o_custkey::VARCHAR)
SELECT device_id, 'device' AS part, CAST(NULL AS TIMESTAMP) AS ts, CAST(0 AS BIGINT) AS item_id, device_name,
  NULL::VARCHAR AS sensor_type, NULL::VARCHAR AS widget_type, NULL::VARCHAR AS data_type,
  NULL::VARCHAR AS current_value, NULL::VARCHAR AS value FROM pages_wanted
UNION ALL
SELECT device_id, 'widget', NULL, widget_id, NULL, sensor_type, widget_type, data_type, current_value, NULL
FROM widgets JOIN pages_wanted USING (device_id)
UNION ALL
SELECT device_id, 'reading', ts, data_id, NULL, sensor_type, NULL, NULL, NULL, value
FROM recent JOIN pages_wanted USING (device_id)""".strip())

add("J6_authenticated_messages", """
SELECT msg_id, device_id AS auth_device_id, device_name, user_id FROM messages JOIN registry USING (secret_key)""")
add("J6_rejected_messages", """
SELECT msg_id, secret_key FROM messages WHERE secret_key NOT IN (SELECT secret_key FROM registry)""")
add("M1_normalised_messages", """
SELECT msg_id, is_json, name_ok, sensor_type, value_present, value, target AS target_text, is_command FROM fields""")
add("M2_message_class", """
SELECT msg_id, CASE WHEN is_command THEN 'device-command' ELSE 'device-data' END AS message_class,
  CAST(CASE WHEN is_command THEN 1 ELSE 0 END AS BIGINT) AS priority FROM fields WHERE is_json""")
add("M5_auto_routed", """
SELECT msg_id, routed AS auto_routed, is_command OR routed AS is_command,
  CASE WHEN routed THEN auth_id::VARCHAR ELSE target END AS target_text, sensor_type, value
FROM (SELECT f.*, is_json AND auth_id IS NOT NULL AND json_type(j, '$.var') IS NOT NULL
        AND json_type(j, '$.val') IS NOT NULL AND json_type(j, '$.device_id') IS NULL
        AND (json_type(j, '$.type') IS NULL OR j ->> '$.type' = 'command') AS routed
      FROM (SELECT *, CASE WHEN is_json THEN raw END AS j FROM from_device) f)""")
add("M6_frame_class", """
SELECT 'device' AS origin, msg_id, CASE WHEN is_json THEN 'JSON' ELSE 'RAW' END AS frame_class FROM fields
UNION ALL
SELECT 'reply', msg_id, CASE WHEN outcome = 'cross_device' THEN 'ERROR' ELSE 'ACK' END
FROM from_device WHERE outcome IN ('data', 'command', 'cross_device')
UNION ALL
SELECT 'outbox', update_id, 'JSON' FROM updates
UNION ALL
SELECT 'outbox', update_id, 'DATA' FROM updates
UNION ALL
SELECT 'outbox', update_id, 'DATA' FROM updates WHERE public_slug IS NOT NULL""")
add("M3_dashboard_class", """
SELECT msg_id, 'dashboard-command' AS message_class, CAST(1 AS BIGINT) AS priority FROM from_dashboard WHERE is_json""")
add("M7_command_text", """
SELECT msg_id, CASE msg_id % 6 WHEN 0 THEN 'CONNECT' WHEN 1 THEN 'STATUS' WHEN 2 THEN 'CLEAR' WHEN 3 THEN NULL
    ELSE 'SEND' END AS word,
  CASE msg_id % 6 WHEN 0 THEN 'ws://hub.example.com/?key=' || secret_key WHEN 4 THEN raw WHEN 5 THEN raw END AS argument
FROM messages""")
add("V6_cross_device", """
SELECT msg_id, auth_id AS auth_device_id, target_text FROM from_device WHERE outcome = 'cross_device'""")
add("T1_device_outcomes", """
SELECT msg_id, outcome, auth_id AS auth_device_id, TRY_CAST(target_text AS BIGINT) AS target_id, sensor_type, value
FROM from_device""")
add("K1_new_readings", """
SELECT msg_id + 1 AS data_id, auth_id AS device_id, sensor_type, value, ts
FROM from_device WHERE outcome IN ('data', 'command') AND value IS NOT NULL""")
add("T2_dashboard_commands", """
SELECT msg_id, m.user_id, outcome, TRY_CAST(target_text AS BIGINT) AS target_id, sensor_type, value,
  coalesce(d.user_id = m.user_id, FALSE) AS is_owner
FROM from_dashboard m LEFT JOIN devices d ON d.device_id = TRY_CAST(target_text AS BIGINT)""")
ACKS = "SELECT msg_id, target_id, status, device_id, var, val, message, n_sent FROM acks WHERE origin = '{origin}'"
add("T3_controller_commands", ACKS.format(origin="device"))
add("J11_command_acks", ACKS.format(origin="dashboard"))
add("T8_replies", """
SELECT origin, msg_id, status, NULL AS type, device_id, var, val, NULL AS timestamp, message FROM acks
UNION ALL
SELECT 'device', msg_id, 'ack', 'dataReceived', NULL, sensor_type, value, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ'),
  'Data berhasil diterima' FROM from_device WHERE outcome = 'data'
UNION ALL
SELECT 'device', msg_id, 'error', NULL, NULL, NULL, NULL, NULL, 'Tidak diizinkan mengontrol device lain'
FROM from_device WHERE outcome = 'cross_device'
UNION ALL
SELECT 'dashboard', msg_id, 'error', NULL, NULL, NULL, NULL, NULL, 'Format pesan tidak valid'
FROM from_dashboard WHERE outcome = 'invalid'""")

add("J7_update_enriched", """
SELECT update_id, user_id, device_name AS device, device_id, sensor_type AS var, value AS val,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp FROM updates""")
add("J8_public_updates", """
SELECT update_id, public_slug, 'dataUpdate' AS type, sensor_type, value AS current_value,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp FROM updates WHERE public_slug IS NOT NULL""")
add("P7_subscriptions", """
SELECT conn_key, conn_type, CASE conn_type WHEN 'dashboard' THEN 'user:' || user_id::VARCHAR
  WHEN 'device' THEN 'devices' ELSE 'slug:' || slug END AS audience FROM subs""")
add("K8_outbox", """
, stamped AS (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp FROM updates)
SELECT update_id, 'user:' || user_id::VARCHAR AS audience, CAST(NULL AS BIGINT) AS skip_conn_key, NULL AS type,
  device_name AS device, device_id::VARCHAR AS device_id, NULL AS device_name, sensor_type AS var, NULL AS sensor_type,
  value AS val, NULL AS current_value, timestamp FROM stamped
UNION ALL
SELECT update_id, 'slug:' || public_slug, NULL, 'dataUpdate', NULL, NULL, NULL, NULL, sensor_type, NULL, value, timestamp
FROM stamped WHERE public_slug IS NOT NULL
UNION ALL
SELECT update_id, 'devices', sender_key, 'dataUpdate', NULL, device_id::VARCHAR, device_name, sensor_type, NULL, value,
  NULL, timestamp FROM stamped""".strip())
RECEIVERS = """SELECT c.conn_key, {extra}, count(u.update_id) AS n_updates,
  CAST(coalesce(sum(u.update_id), 0) AS VARCHAR) AS id_sum
FROM subs c LEFT JOIN updates u ON {match} WHERE c.conn_type = '{kind}' GROUP BY ALL"""
add("J9_dashboard_recipients", RECEIVERS.format(
    extra="c.user_id", kind="dashboard", match="u.user_id = c.user_id"))
add("J10_device_recipients", RECEIVERS.format(
    extra="c.user_id", kind="device", match="u.sender_key IS DISTINCT FROM c.conn_key"))
add("J10_device_recipients_owner", RECEIVERS.format(
    extra="c.user_id", kind="device", match="u.user_id = c.user_id AND u.sender_key IS DISTINCT FROM c.conn_key"))
add("J12_public_recipients", RECEIVERS.format(
    extra="'slug:' || c.slug AS audience", kind="public", match="u.public_slug = c.slug"))
add("A3_delivery_counts", """
SELECT u.update_id, u.device_id,
  count(c.conn_key) FILTER (WHERE c.conn_type = 'dashboard' AND c.user_id = u.user_id) AS n_dashboards,
  count(c.conn_key) FILTER (WHERE c.conn_type = 'device' AND u.sender_key IS DISTINCT FROM c.conn_key) AS n_devices,
  count(c.conn_key) FILTER (WHERE c.conn_type = 'public' AND c.slug = u.public_slug) AS n_public
FROM updates u LEFT JOIN subs c ON TRUE GROUP BY u.update_id, u.device_id""")

add("T5_connection_state", """
, steps AS (
  SELECT conn_key, 0 AS seq, 'open' AS state, opened_at AS since FROM connections
  UNION ALL SELECT conn_key, 1, 'authenticated', auth_at FROM connections WHERE auth_at IS NOT NULL
  UNION ALL SELECT conn_key, 2, 'closed', closed_at FROM connections WHERE closed_at IS NOT NULL)
SELECT conn_key, state, since FROM (
  SELECT *, row_number() OVER (PARTITION BY conn_key ORDER BY since DESC, seq DESC) AS n FROM steps)
WHERE n = 1""".strip())
add("W5_newest_connection", """
SELECT device_id, conn_key, auth_at FROM (
  SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY auth_at DESC, conn_key DESC) AS n
  FROM opened WHERE conn_type = 'device' AND auth_at IS NOT NULL) WHERE n = 1""")
add("W5_coexisting_connections", """
SELECT device_id, conn_key, auth_at FROM opened WHERE conn_type = 'device' AND auth_at IS NOT NULL""")
add("T4_handshake", """
SELECT conn_key, opened_at,
  CASE WHEN is_auth AND ts < opened_at + INTERVAL 20 SECOND
       THEN CASE WHEN device_id IS NULL THEN 'bad_key' ELSE 'accepted' END ELSE 'timeout' END AS verdict,
  CASE WHEN is_auth AND ts < opened_at + INTERVAL 20 SECOND THEN ts ELSE opened_at + INTERVAL 20 SECOND END AS decided_at
FROM handshakes""")
add("T4_handshake_replies", """
SELECT conn_key, ts, CASE WHEN device_id IS NOT NULL THEN 'success' ELSE 'error' END AS status,
  CASE WHEN device_id IS NOT NULL THEN 'Terauthentikasi sebagai "' || device_name || '"'
       WHEN is_auth THEN 'Secret key tidak valid'
       ELSE 'Kirim {"action":"auth","key":"..."} untuk authenticating' END AS message, device_id
FROM handshakes WHERE ts < opened_at + INTERVAL 20 SECOND""")
add("K4_delete_results", "SELECT request_id, device_id, user_id, CAST(status AS INTEGER) AS status FROM delete_results")
add("J14_after_device_delete", """
SELECT device_id, user_id, device_name FROM devices WHERE device_id NOT IN (SELECT device_id FROM deleted)""")
add("J14_revoked_keys", """
SELECT device_id, secret_key FROM registry WHERE device_id IN (SELECT device_id FROM deleted)""")
add("T9_close_events", """
SELECT conn_key, 'close' AS event, as_of AS ts, device_id FROM subs, clock
WHERE conn_type = 'device' AND device_id IN (SELECT device_id FROM deleted)""")

add("A6_duplicate_keys", """
, named AS (
  SELECT 'username' AS column_name, username AS key, 1 AS fresh FROM registrations
  UNION ALL SELECT 'email', email, 1 FROM registrations
  UNION ALL SELECT 'username', username, 0 FROM users UNION ALL SELECT 'email', email, 0 FROM users)
SELECT column_name, key, CAST(sum(fresh) AS BIGINT) AS n_new, CAST(count(*) - sum(fresh) AS BIGINT) AS n_existing
FROM named GROUP BY column_name, key
HAVING sum(fresh) > 1 OR (sum(fresh) > 0 AND count(*) > sum(fresh))""".strip())
add("V1_registrations", "SELECT request_id, username, email, status FROM registered")
add("K3_inserted_users", """
SELECT 1000 + row_number() OVER (ORDER BY request_id) AS user_id, username, email FROM registered WHERE status = '201'""")
add("V2_devices", """
SELECT *, CAST(CASE WHEN coalesce(device_name, '') = '' THEN 400 ELSE 201 END AS BIGINT) AS status FROM device_requests""")
add("K3_inserted_devices", """
SELECT device_id, user_id, device_name, sha256('test:api:' || device_id::VARCHAR) AS api_key,
  sha256('test:secret:' || device_id::VARCHAR) AS secret_key, NULL::VARCHAR AS public_slug
FROM (SELECT *, 1000000 + row_number() OVER (ORDER BY request_id) AS device_id FROM device_requests
      WHERE device_name <> '')""")
add("V3_widgets", """
SELECT request_id, user_id, device_id, sensor_type, widget_type, data_type, status FROM widget_results""")
add("K3_inserted_widgets", """
SELECT 1000000 + row_number() OVER (ORDER BY request_id) AS widget_id, user_id, device_id, sensor_type, widget_type,
  data_type, CASE widget_type WHEN 'toggle' THEN 'false' WHEN 'slider' THEN '0' ELSE '' END AS current_value
FROM widget_results WHERE status = 201""")
add("V4_slugs", "SELECT request_id, device_id, user_id, custom_slug, status, applies, url FROM slug_results", SLUGS)
add("K5_slug_updates", """
SELECT d.device_id, d.user_id, device_name, api_key, secret_key,
  coalesce((SELECT custom_slug FROM slug_results r WHERE r.device_id = d.device_id AND applies
            ORDER BY request_id DESC LIMIT 1), public_slug) AS public_slug FROM devices d""", SLUGS)
BACKFILL = """SELECT device_id, user_id, device_name, api_key, {key} AS secret_key, public_slug FROM devices"""
add("K6_backfill", BACKFILL.format(
    key="CASE WHEN coalesce(secret_key, '') = '' THEN sha256('test:secret:' || device_id::VARCHAR) ELSE secret_key END"))
add("K6_added_column", BACKFILL.format(key="sha256('test:secret:' || device_id::VARCHAR)"))

# Streams end with the same rows as their batch forms.
add("T1_ingest_stream", """
SELECT msg_id + 1 AS data_id, auth_id AS device_id, sensor_type, value, ts
FROM from_device WHERE outcome IN ('data', 'command') AND value IS NOT NULL""")
add("T1_ingest_replies", """
SELECT msg_id, status, NULL AS type, device_id, var, val, NULL AS timestamp, message FROM acks WHERE origin = 'device'
UNION ALL
SELECT msg_id, 'ack', 'dataReceived', NULL, sensor_type, value, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ'),
  'Data berhasil diterima' FROM from_device WHERE outcome = 'data'
UNION ALL
SELECT msg_id, 'error', NULL, NULL, NULL, NULL, NULL, 'Tidak diizinkan mengontrol device lain'
FROM from_device WHERE outcome = 'cross_device'""")
add("T6_live_series_stream", """
, stored AS (SELECT msg_id, auth_id AS device_id, sensor_type, value, ts
             FROM from_device WHERE outcome IN ('data', 'command') AND value IS NOT NULL)
SELECT device_id, sensor_type, row_number() OVER (PARTITION BY device_id, sensor_type ORDER BY ts, msg_id) - 1 AS pos,
  strftime(ts, '%H:%M:%S') AS label, value
FROM (SELECT *, row_number() OVER (PARTITION BY device_id, sensor_type ORDER BY ts DESC, msg_id DESC) AS n
      FROM stored) WHERE n <= 40""".strip())
add("T2_shared_store", """
SELECT msg_id + 1 AS data_id, auth_id AS device_id, sensor_type, value, ts
FROM from_device WHERE outcome IN ('data', 'command') AND value IS NOT NULL
UNION ALL
SELECT msg_id + 1, TRY_CAST(target_text AS BIGINT), sensor_type, value, ts
FROM from_dashboard WHERE outcome = 'command' AND value IS NOT NULL""")
add("T9_delete_stream", """
SELECT 'deleted' AS kind, device_id, NULL::VARCHAR AS detail FROM deleted
UNION ALL
SELECT 'close', device_id, conn_key::VARCHAR FROM subs WHERE conn_type = 'device' AND device_id IN (SELECT device_id FROM deleted)
UNION ALL
SELECT 'revoked', device_id, secret_key FROM registry WHERE device_id IN (SELECT device_id FROM deleted)""")
add("T4_timer_stream", """
SELECT conn_key,
  CASE WHEN is_auth AND ts < opened_at + INTERVAL 20 SECOND
       THEN CASE WHEN device_id IS NULL THEN 'bad_key' ELSE 'accepted' END ELSE 'timeout' END AS verdict,
  CASE WHEN is_auth AND ts < opened_at + INTERVAL 20 SECOND THEN ts ELSE opened_at + INTERVAL 20 SECOND END AS decided_at
FROM handshakes""")
add("K7_export_files", """
SELECT device_id, ts, sensor_type, value,
  row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, data_id DESC) AS position
FROM sensor_data JOIN devices USING (device_id)""")
add("O1_history_order", """
SELECT data_id, row_number() OVER (ORDER BY ts, data_id) AS position FROM recent JOIN devices USING (device_id)""")
add("O2_export_order", """
SELECT data_id, row_number() OVER (ORDER BY ts DESC, data_id DESC) AS position FROM sensor_data JOIN devices USING (device_id)""")
for batch, stream in [("T1_ingest_stream", "S2_message_lines"), ("T1_ingest_stream", "K1_history_sink"), ("A1_current_values", "T7_current_values_stream"),
                      ("T5_connection_state", "T5_connection_stream"), ("T4_handshake", "T4_handshake_stream")]:
    ORACLE[stream] = ORACLE[batch]
