"""DuckDB SQL for the catalogue's queries, with equal names, columns and values."""

from __future__ import annotations

_MESSAGES = """
m AS (
  SELECT event_id AS seq, event_type, user_id,
         coalesce(nullif(CASE WHEN event_type <> 'signup' THEN event_type END, ''), 'default') AS batcher,
         coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN 'k' || (event_id % 7) WHEN event_id % 3 = 1 THEN '' END, ''), 'default') AS k,
         CASE WHEN event_id % 11 <> 0 THEN CAST(user_id AS VARCHAR) ELSE '' END AS partition_key
  FROM events),
routed AS (
  SELECT *, CASE WHEN partition_key <> '' AND k = 'default' THEN partition_key ELSE k END AS batch_key FROM m)"""

_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(key, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"

_KEYS = f"keys AS (SELECT DISTINCT 'user-' || user_id AS key FROM events), hashed AS (SELECT key, {_FNV} AS h FROM keys)"

_RING = f"""{_KEYS},
nodes AS (SELECT node, {_FNV.replace('key', 'node')} AS nh FROM (SELECT unnest(['alpha', 'bravo', 'charlie', 'delta', 'echo']) AS node)),
owned AS (
  SELECT key, coalesce(min_by(node, nh) FILTER (WHERE nh >= h), min_by(node, nh)) AS owner
  FROM hashed CROSS JOIN nodes GROUP BY key)"""

_BY_USER = """
b AS (
  SELECT event_id AS seq, 'default' AS batcher, CAST(user_id AS VARCHAR) AS batch_key,
         CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) / 10) AS BIGINT) AS batch_no
  FROM events)"""

_ACTIVITY = """
a AS (
  SELECT event_id AS seq, user_id, ts, value AS amount,
         CASE event_type WHEN 'signup' THEN 'login' WHEN 'error' THEN 'logout' WHEN 'view' THEN 'view_page' WHEN 'click' THEN 'click_button' ELSE event_type END AS action
  FROM events)"""

_SESSION = f"""WITH {_ACTIVITY}
SELECT user_id,
       coalesce(max_by(action = 'login', CASE WHEN action IN ('login', 'logout') THEN seq END) FILTER (WHERE action IN ('login', 'logout')), false) AS is_logged_in,
       strftime(max_by(ts, seq), '%Y-%m-%d %H:%M:%S') AS last_activity,
       count(*) FILTER (WHERE action = 'view_page') AS page_views,
       count(*) FILTER (WHERE action = 'purchase') AS purchase_count,
       round(coalesce(sum(amount) FILTER (WHERE action = 'purchase'), 0), 2) AS total_purchase_amount
FROM a GROUP BY user_id"""

_CHUNKS = """
c AS (
  SELECT 'public.orders' AS "table", o_orderkey AS pk, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 1000) AS BIGINT) AS chunk_id FROM orders),
p AS (SELECT "table", chunk_id, count(*) AS size, min(pk) AS lo, max(pk) AS hi FROM c GROUP BY ALL)"""

_LOG = """
w AS (
  SELECT 'public.orders' AS "table", event_id * 7919 % (SELECT count(*) FROM orders) AS pk, event_id AS xid, event_id AS lsn, value,
         CASE event_id % 3 WHEN 0 THEN 'INSERT' WHEN 1 THEN 'UPDATE' ELSE 'DELETE' END AS op
  FROM events)"""

_MERGED = f"""{_CHUNKS},
r AS (SELECT * FROM (SELECT "table", chunk_id, lag(hi) OVER (ORDER BY chunk_id) AS low, hi AS high, chunk_id * 500 AS xmin FROM p) WHERE chunk_id % 5 <> 4),
{_LOG},
v AS (
  SELECT w.*, r.chunk_id, CASE WHEN r.chunk_id IS NULL THEN 'discard_unscanned' WHEN w.xid >= r.xmin THEN 'emit' ELSE 'discard_stale' END AS verdict
  FROM w LEFT JOIN r ON w."table" = r."table" AND (r.low IS NULL OR w.pk > r.low) AND w.pk <= r.high)"""

_STREAM = f"""{_MERGED},
s AS (
  SELECT "table", pk, 'READ' AS op, CAST(NULL AS BIGINT) AS lsn FROM c WHERE chunk_id % 5 <> 4
  UNION ALL SELECT "table", pk, op, lsn FROM v WHERE verdict = 'emit')"""

_DONE = f"""{_CHUNKS},
acked AS (SELECT chunk_id, count(*) AS acked FROM c WHERE NOT (chunk_id % 7 = 5 AND pk % 1000 = 17) GROUP BY chunk_id),
done AS (SELECT p."table", p.chunk_id, p.size, p.hi, coalesce(acked, 0) AS acked, coalesce(acked, 0) >= size AS complete FROM p LEFT JOIN acked USING (chunk_id))"""

_DASHED = lambda n: "(" + " || '-' || ".join(f"substr(md5(CAST({n} AS VARCHAR)), {a}, {k})" for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + ")"

_UUIDS = f"""
c AS (
  SELECT 'public.orders' AS "table", {_DASHED("o_orderkey")} AS pk, CAST(floor((row_number() OVER (ORDER BY {_DASHED("o_orderkey")}) - 1) / 1000) AS BIGINT) AS chunk_id FROM orders),
p AS (SELECT "table", chunk_id, count(*) AS size, min(pk) AS lo, max(pk) AS hi FROM c GROUP BY ALL)"""

_DIGIT = "CAST(md5(CAST(event_id AS VARCHAR)) AS VARCHAR)"

ORACLE: dict[str, str] = {
    "envelope_routing": f"WITH {_MESSAGES} SELECT seq, batcher, batch_key, partition_key FROM routed",
    "process_ok": "SELECT event_id AS seq, event_type FROM events WHERE event_id % 2 <> 0",
    "process_failed": "SELECT event_id AS seq, 'even' AS error FROM events WHERE event_id % 2 = 0",
    "process_rows": """SELECT event_id AS seq,
  CASE WHEN event_type = 'signup' THEN '' WHEN event_type = 'click' AND event_id % 5 <> 0 THEN 'clicks' ELSE event_type END AS batcher,
  CASE WHEN event_id % 5 = 0 THEN 'ValueError: fifth' ELSE '' END AS error FROM events""",
    "outcome_counts": "SELECT CASE WHEN event_id % 2 = 0 THEN 'failed' ELSE 'ok' END AS status, count(*) AS n FROM events GROUP BY 1",
    "outcome_unacked": "SELECT event_id AS seq FROM events WHERE event_id % 4 = 3",
    "route_counts": f"WITH {_MESSAGES} SELECT batcher, count(*) AS n FROM routed WHERE batcher IN ('view', 'click', 'default') GROUP BY batcher",
    "route_unknown": f"WITH {_MESSAGES} SELECT seq, batcher, 'unknown batcher: ' || batcher AS error FROM routed WHERE batcher NOT IN ('view', 'click', 'default')",
    "pipeline_outcomes": """SELECT event_id AS seq,
  CASE WHEN event_id % 2 = 0 OR event_type NOT IN ('view', 'click', 'signup') OR (event_type = 'click' AND event_id % 13 = 0) THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN event_id % 2 = 0 THEN 'even' WHEN event_type NOT IN ('view', 'click', 'signup') THEN 'unknown batcher: ' || event_type
       WHEN event_type = 'click' AND event_id % 13 = 0 THEN 'not returned by its batch' ELSE '' END AS error
FROM events""",
    "fnv1a32": f"WITH {_KEYS} SELECT key, h AS hash FROM hashed",
    "ring_owner": f"WITH {_RING} SELECT key, owner FROM owned",
    "ring_affinity": f"WITH {_RING} SELECT owner, count(DISTINCT key) AS keys, count(*) AS messages FROM events JOIN owned ON key = 'user-' || user_id GROUP BY owner",
    "partition_affinity": "SELECT CAST(user_id AS VARCHAR) AS partition_key, count(*) AS n, CAST(1 AS BIGINT) AS parts, CAST(0 AS BIGINT) AS falls FROM events WHERE event_id % 11 <> 0 GROUP BY user_id",
    "demand_greedy": """WITH d AS (SELECT i AS request, 90 - i % 3 * 10 AS demand FROM range(12) t(i)),
e AS (SELECT request, sum(demand) OVER (ORDER BY request) AS stop, sum(demand) OVER (ORDER BY request) - demand AS start FROM d)
SELECT request, count(*) AS n, min(event_id) AS lo, max(event_id) AS hi FROM events JOIN e ON event_id >= start AND event_id < stop GROUP BY request""",
    "demand_total": "SELECT CAST(sum(s_suppkey % 10) AS BIGINT) AS demand FROM supplier",
    "batch_assign": f"WITH {_BY_USER} SELECT batcher, batch_key, batch_no, count(*) AS n, min(seq) AS lo, max(seq) AS hi FROM b GROUP BY ALL",
    "batch_multi": f"""WITH {_MESSAGES},
sized AS (SELECT *, CASE batcher WHEN 'view' THEN 50 WHEN 'click' THEN 20 ELSE 100 END AS size FROM routed WHERE batcher IN ('view', 'click', 'default')),
numbered AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY batcher, batch_key ORDER BY seq) - 1) / size) AS BIGINT) AS batch_no FROM sized)
SELECT batcher, batch_key, batch_no, count(*) AS n, min(seq) AS lo, max(seq) AS hi FROM numbered GROUP BY ALL""",
    "ordered_lists": f"WITH {_BY_USER} SELECT batcher, batch_key, batch_no, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) AS seqs FROM b GROUP BY ALL",
    "group_handler": f"""WITH {_BY_USER} SELECT seq, CASE WHEN batch_no = 3 OR seq % 7 = 0 THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN batch_no = 3 THEN 'RuntimeError: third' WHEN seq % 7 = 0 THEN 'not returned by its batch' ELSE '' END AS error FROM b""",
    "session_fold": _SESSION,
    "session_after_batch": f"""WITH {_ACTIVITY},
n AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1) / 10) AS BIGINT) AS batch_no FROM a),
s AS (
  SELECT user_id, seq, batch_no, ts,
         coalesce(last_value(CASE WHEN action = 'login' THEN true WHEN action = 'logout' THEN false END IGNORE NULLS) OVER o, false) AS is_logged_in,
         count(*) FILTER (WHERE action = 'view_page') OVER o AS page_views, count(*) FILTER (WHERE action = 'purchase') OVER o AS purchase_count,
         round(coalesce(sum(amount) FILTER (WHERE action = 'purchase') OVER o, 0), 2) AS total_purchase_amount
  FROM n WINDOW o AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT user_id, batch_no, is_logged_in, strftime(ts, '%Y-%m-%d %H:%M:%S') AS last_activity, page_views, purchase_count, total_purchase_amount
FROM s QUALIFY row_number() OVER (PARTITION BY user_id, batch_no ORDER BY seq DESC) = 1""",
    "chunk_plan": f'WITH {_CHUNKS} SELECT * FROM p',
    "keyset_page": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey > 499 ORDER BY o_orderkey LIMIT 250",
    "snapshot_multi": """SELECT 0 AS ordinal, 'public.orders' AS "table", o_orderkey AS pk, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 1000) AS BIGINT) AS chunk_id FROM orders WHERE o_orderkey > 1234
UNION ALL SELECT 1, 'public.customer', c_custkey, CAST(floor((row_number() OVER (ORDER BY c_custkey) - 1) / 1000) AS BIGINT) FROM customer""",
    "pk_in_range": """WITH k AS (SELECT CASE WHEN o_orderkey % 97 <> 0 THEN o_orderkey END AS pk FROM orders),
r(range_id, low, high) AS (VALUES (0, NULL, 100), (1, 100, 500), (2, 500, NULL), (3, NULL, NULL)),
i AS (SELECT range_id, pk IS NOT NULL AND (low IS NULL OR pk > low) AND (high IS NULL OR pk <= high) AS inside FROM k CROSS JOIN r)
SELECT range_id, count(*) FILTER (WHERE inside) AS n_inside, count(*) FILTER (WHERE NOT inside) AS n_outside FROM i GROUP BY range_id""",
    "merge_verdict": f"WITH {_MERGED} SELECT xid, pk, coalesce(chunk_id, -1) AS chunk_id, verdict FROM v",
    "chunk_plan_uuid": f"WITH {_UUIDS} SELECT * FROM p",
    "merge_verdict_uuid": f"""WITH {_UUIDS},
r AS (SELECT * FROM (SELECT chunk_id, lag(hi) OVER (ORDER BY chunk_id) AS low, hi AS high, chunk_id * 500 AS xmin FROM p) WHERE chunk_id % 5 <> 4),
{_LOG},
k AS (SELECT xid, {_DASHED("pk")} AS pk FROM w)
SELECT k.xid, k.pk, coalesce(r.chunk_id, -1) AS chunk_id, CASE WHEN r.chunk_id IS NULL THEN 'discard_unscanned' WHEN k.xid >= r.xmin THEN 'emit' ELSE 'discard_stale' END AS verdict
FROM k LEFT JOIN r ON (r.low IS NULL OR k.pk > r.low) AND k.pk <= r.high""",
    "apply_transactions": f"""WITH {_LOG}, e AS (SELECT "table", pk % 50 AS pk, op, lsn // 8 * 8 + 7 AS lsn, lsn AS place FROM w)
SELECT "table", pk, op, lsn, place FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY "table", pk ORDER BY lsn DESC, place DESC) = 1) WHERE op <> 'DELETE'""",
    "stream_stop": "SELECT event_type, count(*) AS n, true AS idle FROM events GROUP BY event_type",
    "merge_in_progress": f"""WITH {_MERGED} SELECT CASE WHEN chunk_id IS NULL AND pk > 3999 AND pk <= 4999 THEN 'buffer' ELSE verdict END AS verdict, count(*) AS n FROM v GROUP BY 1""",
    "merge_stream": f'WITH {_STREAM} SELECT "table", pk, op, coalesce(lsn, -1) AS lsn FROM s',
    "merge_overflow": f"WITH {_CHUNKS}, {_LOG} SELECT xid, pk FROM w WHERE pk > (SELECT max(hi) FROM p WHERE chunk_id < 3)",
    "merge_replay": f"""WITH {_CHUNKS}, {_LOG},
x AS (SELECT lsn AS place, lsn - lsn % 5 * 150 AS xid, pk FROM w),
r AS (
  SELECT chunk_id * 400 AS begin, chunk_id * 400 + 300 AS stop, lag(hi) OVER (ORDER BY chunk_id) AS low, hi AS high, hi + 500 AS est, chunk_id * 400 AS xmin  FROM p),
j AS (
  SELECT x.*, i.begin AS its_begin, i.stop AS its_stop, i.xmin, n.begin AS now_begin
  FROM x LEFT JOIN r i ON (i.low IS NULL OR pk > i.low) AND pk <= i.high
         LEFT JOIN r n ON n.begin < place AND place < n.stop AND (n.low IS NULL OR pk > n.low) AND pk <= n.est)
SELECT place, xid, pk,
       CASE WHEN its_stop < place THEN CASE WHEN xid >= xmin THEN 'emit' ELSE 'discard_stale' END WHEN now_begin IS NULL THEN 'discard_unscanned'
            WHEN its_begin >= now_begin THEN CASE WHEN xid >= xmin THEN 'emit' ELSE 'discard_stale' END ELSE 'buffer' END AS verdict FROM j""",
    "tx_assemble": f"""WITH {_LOG}, t AS (SELECT CAST(floor(lsn / 4) AS BIGINT) AS xid, lsn, op FROM w)
SELECT xid, lsn, op, max(lsn) OVER (PARTITION BY xid) + 1 AS commit_lsn FROM t WHERE xid % 9 <> 8""",
    "relation_lookup": f"""WITH {_LOG} SELECT CASE WHEN lsn % 4 = 0 THEN 'public.orders' WHEN lsn % 4 = 2 THEN 'part' WHEN lsn >= 500 THEN 'sales.customer' ELSE 'public.customer' END AS "table", count(*) AS n
FROM w WHERE lsn % 4 <> 3 GROUP BY 1""",
    "wal_op_counts": f"WITH {_LOG} SELECT op, count(*) AS n FROM w GROUP BY op",
    "wal_op_filter": f"WITH {_LOG} SELECT xid, pk, op FROM w WHERE op IN ('READ', 'INSERT')",
    "wal_decode_ops": f"""WITH {_LOG} SELECT op, op IN ('UPDATE', 'DELETE') AND xid % 2 = 0 AND value IS NOT NULL AS has_before, op IN ('INSERT', 'UPDATE') AND value IS NOT NULL AS has_after, count(*) AS n FROM w GROUP BY ALL""",
    "text_decode": """WITH t AS (
  SELECT event_id AS seq, event_id % 5 AS kind, event_id % 35 = 0 AS junk, user_id, ts, event_type FROM events)
SELECT seq, CASE WHEN kind <> 2 THEN '' WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END AS b, CASE WHEN kind = 0 AND NOT junk THEN user_id ELSE -1 END AS i,
       CASE WHEN kind = 1 THEN user_id / 4.0::DOUBLE ELSE -1 END AS f, CASE WHEN kind = 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE '' END AS ts,
       CASE WHEN junk THEN 'junk' WHEN kind = 4 THEN event_type ELSE '' END AS s FROM t""",
    "pk_codec": f"""WITH t AS (SELECT event_id AS seq, event_id % 4 AS k, {_DIGIT} AS d FROM events)
SELECT seq, CASE k WHEN 0 THEN 'int' WHEN 3 THEN 'unset' ELSE 'uuid' END AS kind, CASE WHEN k = 0 THEN seq ELSE -1 END AS pk_int,
       CASE WHEN k IN (1, 2) THEN substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-' || substr(d, 13, 4) || '-' || substr(d, 17, 4) || '-' || substr(d, 21, 12) ELSE '' END AS pk_uuid,
       CASE WHEN k = 0 THEN seq + 1000 ELSE -1 END AS next_int FROM t""",
    "row_parse": "SELECT event_id AS seq, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "qualify_split": """WITH t AS (
  SELECT CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'public' ELSE 'a' END AS s, CASE WHEN n_nationkey % 2 = 0 THEN 'x"y.' ELSE '' END || n_name AS name FROM nation),
q AS (SELECT name, CASE WHEN s = '' THEN name ELSE s || '.' || name END AS qualified FROM t)
SELECT qualified, CASE WHEN strpos(qualified, '.') > 0 THEN substr(qualified, 1, strpos(qualified, '.') - 1) ELSE '' END AS schema_part,
       CASE WHEN strpos(qualified, '.') > 0 THEN substr(qualified, strpos(qualified, '.') + 1) ELSE qualified END AS table_part,
       '"' || replace(name, '"', '""') || '"' AS quoted FROM q""",
    "xmin_parse": "SELECT event_id AS seq, CAST(CASE WHEN event_id % 3 = 0 THEN event_id WHEN event_id % 3 = 1 AND event_id + 4294967290 <= 4294967295 THEN event_id + 4294967290 ELSE 0 END AS BIGINT) AS xmin FROM events",
    "chunk_ack_complete": f"WITH {_DONE} SELECT * FROM done",
    "snapshot_cursor": f"""WITH {_DONE},
o AS (SELECT "table", max_by(hi, chunk_id) FILTER (WHERE chunk_id < coalesce((SELECT min(chunk_id) FROM done WHERE NOT complete), 9223372036854775807)) AS cursor FROM done GROUP BY "table")
SELECT "table", cursor IS NOT NULL AS is_set, coalesce(cursor, -1) AS cursor FROM o
UNION ALL
SELECT 'public.customer', q.hi IS NOT NULL, coalesce(q.hi, -1) FROM (
  SELECT max(hi) FILTER (WHERE chunk_id < coalesce(pending, 9223372036854775807)) AS hi FROM (
    SELECT chunk_id, max(c_custkey) AS hi, min(CASE WHEN bool_or(c_custkey = 3) THEN chunk_id END) OVER () AS pending
    FROM (SELECT c_custkey, CAST(floor((row_number() OVER (ORDER BY c_custkey) - 1) / 1000) AS BIGINT) AS chunk_id FROM customer) GROUP BY chunk_id)) q""",
    "confirmed_lsn": f"WITH {_STREAM} SELECT greatest(10, max(lsn) FILTER (WHERE op <> 'READ')) AS confirmed_lsn FROM s WHERE pk % 2 = 0",
    "phase_state": f"""WITH {_DONE}
SELECT "table", count(*) FILTER (WHERE NOT complete) AS pending, count(*) FILTER (WHERE complete) AS completed,
       CASE WHEN count(*) FILTER (WHERE NOT complete) = 0 THEN 'streaming' ELSE 'snapshot' END AS phase FROM done GROUP BY "table"
UNION ALL
SELECT 'public.full', count(*) FILTER (WHERE n < size), count(*) FILTER (WHERE n >= size), CASE WHEN count(*) FILTER (WHERE n < size) = 0 THEN 'streaming' ELSE 'snapshot' END
FROM p JOIN (SELECT chunk_id, count(*) AS n FROM c GROUP BY chunk_id) USING (chunk_id)""",
    "connector_state": f"""WITH {_DONE},
f AS (SELECT min(chunk_id) AS pending FROM done WHERE NOT complete)
SELECT 'slot-1' AS slot, CASE WHEN (SELECT pending FROM f) IS NULL THEN 'streaming' ELSE 'snapshot' END AS phase, (SELECT max(event_id) FROM events) AS confirmed_lsn,
       'public.orders' AS current_snapshot_table, (SELECT max(hi) FROM done WHERE chunk_id < coalesce((SELECT pending FROM f), 9223372036854775807)) AS cursor,
       (SELECT count(*) FROM p WHERE chunk_id % 5 <> 4) AS ranges""",
    "offset_latest": "SELECT 'slot-' || user_id AS slot, max(event_id) AS saved_at, max_by(props, event_id) AS state FROM events GROUP BY user_id",
    "apply_changes": f"""WITH {_CHUNKS}, {_LOG},
e AS (SELECT "table", pk, 'READ' AS op, CAST(NULL AS BIGINT) AS lsn FROM c UNION ALL SELECT "table", pk, op, lsn FROM w)
SELECT "table", pk, op, coalesce(lsn, -1) AS lsn FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY "table", pk ORDER BY coalesce(lsn, -1) DESC) = 1) WHERE op <> 'DELETE'""",
    "stream_outcomes": "SELECT CASE WHEN event_id % 2 = 0 THEN 'failed' ELSE 'ok' END AS status, count(*) AS n FROM events GROUP BY 1",
    "stream_resume": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_distinct FROM events GROUP BY event_type",
}
ORACLE["stream_merge"] = f"""WITH {_CHUNKS}, {_LOG},
q AS (
  SELECT 'public.customer' AS "table", chunk_id, max(pk) AS hi
  FROM (SELECT c_custkey AS pk, CAST(floor((row_number() OVER (ORDER BY c_custkey) - 1) / 1000) AS BIGINT) AS chunk_id FROM customer) GROUP BY chunk_id),
k AS (
  SELECT "table", chunk_id, hi, lag(hi) OVER (PARTITION BY "table" ORDER BY chunk_id) AS low, (SELECT max(chunk_id) FROM p) AS last
  FROM (SELECT "table", chunk_id, hi FROM p UNION ALL SELECT * FROM q)),
r AS (
  SELECT "table", CASE WHEN "table" = 'public.orders' THEN 0 ELSE 800 * (last + 1) END + chunk_id * 800 AS begin, low, hi, hi + 500 AS est,
         CASE WHEN "table" = 'public.orders' THEN CASE WHEN chunk_id < last THEN chunk_id * 800 + 600 END ELSE 800 * (last + 1) + chunk_id * 800 + 600 END AS stop,
         CASE WHEN "table" = 'public.orders' THEN chunk_id // 3 * 900 ELSE chunk_id * 400 + 2000 END AS xmin, 800 * last + 700 AS over FROM k),
x AS (SELECT CASE WHEN lsn % 4 = 3 THEN 'public.customer' ELSE 'public.orders' END AS "table", lsn * 2 + 1 AS place, pk, lsn - lsn % 5 * 150 AS xid FROM w),
j AS (
  SELECT x.*, i.begin AS its_begin, i.stop AS its_stop, i.xmin, n.begin AS now_begin, CASE WHEN x."table" = 'public.orders' THEN (SELECT any_value(over) FROM r) END AS over
  FROM x LEFT JOIN r i ON i."table" = x."table" AND i.stop IS NOT NULL AND (i.low IS NULL OR pk > i.low) AND pk <= i.hi
         LEFT JOIN r n ON n."table" = x."table" AND n.begin < place AND (n.stop IS NULL OR place < n.stop) AND (n.low IS NULL OR pk > n.low) AND pk <= n.est),
v AS (
  SELECT *, CASE WHEN place > over THEN 'emit' WHEN its_stop < place THEN CASE WHEN xid >= xmin THEN 'emit' ELSE 'discard_stale' END
                 WHEN now_begin IS NULL THEN 'discard_unscanned' WHEN its_begin >= now_begin THEN CASE WHEN xid >= xmin THEN 'emit' ELSE 'discard_stale' END
                 WHEN over IS NOT NULL THEN 'emit' ELSE 'buffer' END AS verdict,
         CASE WHEN place > over OR its_stop < place OR now_begin IS NULL THEN place WHEN its_begin >= now_begin THEN its_stop ELSE coalesce(over, -1) END AS settled_at FROM j)
SELECT "table", place, pk, xid, verdict, settled_at FROM v"""
ORACLE["chunk_plan_sparse"] = """
WITH k AS (
  SELECT CASE WHEN o_orderkey % 1000 = 999 THEN o_orderkey * 4000000000000 WHEN o_orderkey % 2 = 0 THEN o_orderkey * 100003 ELSE -o_orderkey * 7 END AS pk FROM orders),
c AS (SELECT pk, CAST(floor((row_number() OVER (ORDER BY pk) - 1) / 1000) AS BIGINT) AS chunk_id FROM k)
SELECT 'public.orders' AS "table", chunk_id, count(*) AS size, min(pk) AS lo, max(pk) AS hi FROM c GROUP BY chunk_id"""
ORACLE["stream_bounded"] = "SELECT event_id // 2500 AS batch_id, count(*) AS n, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY 1"
ORACLE["stream_transactions"] = ORACLE["tx_assemble"]
ORACLE["stream_sessions"] = ORACLE["session_fold"]
ORACLE["stream_batches"] = ORACLE["batch_assign"]
ORACLE["stream_pipeline"] = ORACLE["pipeline_outcomes"]

ORACLE["stream_watermark"] = f"""WITH {_CHUNKS},
k AS (
  SELECT 'public.customer' AS "table", c_custkey AS pk, CAST(floor((row_number() OVER (ORDER BY c_custkey) - 1) / 1000) AS BIGINT) AS chunk_id FROM customer),
a AS (
  SELECT "table" AS name, pk, chunk_id, row_number() OVER (PARTITION BY "table" ORDER BY pk) AS n,
         "table" = 'public.orders' AND chunk_id % 7 = 5 AND pk % 1000 = 17 OR "table" = 'public.customer' AND pk = 3 AS missing
  FROM (SELECT * FROM c UNION ALL SELECT * FROM k)),
x AS (
  SELECT name, chunk_id, n, pk AS mark, missing FROM a
  UNION ALL SELECT 'slot-1', event_id, event_id + 1, event_id, event_id >= 4000 AND event_id % 997 = 12 FROM events),
g AS (SELECT name, coalesce(min(n) FILTER (WHERE missing) - 1, max(n)) AS upto FROM x GROUP BY name),
e AS (SELECT name, chunk_id, max(n) AS n, max(mark) AS mark FROM x GROUP BY ALL)
SELECT name, any_value(upto) AS upto, coalesce(max_by(mark, n) FILTER (WHERE n <= upto), -1) AS mark, true AS as_kept FROM g JOIN e USING (name) GROUP BY name"""

_THREES = """
t AS (SELECT CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 50) AS BIGINT) AS chunk_id, o_orderkey AS pk FROM orders),
b AS (SELECT chunk_id, lag(max(pk)) OVER (ORDER BY chunk_id) AS low, max(pk) AS high, chunk_id // 3 * 100 AS xmin FROM t GROUP BY chunk_id),
s AS (SELECT * FROM b WHERE chunk_id % 10 <> 9)"""

ORACLE["range_coalesce"] = f"""WITH {_THREES},
v AS (SELECT chunk_id, low, high, greatest(xmin, 500) AS xmin FROM s),
i AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (ORDER BY chunk_id) AS run FROM (
  SELECT *, coalesce(lag(high) OVER (ORDER BY chunk_id) <> low OR lag(xmin) OVER (ORDER BY chunk_id) <> xmin, true) AS new FROM v))
SELECT 'public.orders' AS "table", min(chunk_id) AS chunk_id, coalesce(min_by(low, chunk_id) FILTER (WHERE new), -1) AS low, max(high) AS high, any_value(xmin) AS xmin FROM i GROUP BY run"""

ORACLE["merge_coalesced"] = f"""WITH {_THREES}, {_LOG}
SELECT xid, w.pk, CASE WHEN s.chunk_id IS NULL THEN 'discard_unscanned' WHEN xid >= xmin THEN 'emit' ELSE 'discard_stale' END AS verdict
FROM w LEFT JOIN s ON (low IS NULL OR w.pk > low) AND w.pk <= high WHERE xid >= 500"""

_KILLED = """
h AS (SELECT CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 100) AS BIGINT) AS chunk_id, o_orderkey AS pk FROM orders),
cur AS (SELECT max(pk) AS reached FROM h WHERE chunk_id < (SELECT chunk_id FROM h WHERE pk = 517))"""

ORACLE["snapshot_resume"] = f"""WITH {_KILLED},
u AS (SELECT md5(CAST(s_suppkey AS VARCHAR)) AS m FROM supplier)
SELECT 'public.customer' AS "table", CAST(c_custkey AS VARCHAR) AS key, 1 AS run FROM customer
UNION ALL SELECT 'public.orders', CAST(pk AS VARCHAR), CASE WHEN pk <= (SELECT reached FROM cur) THEN 1 ELSE 2 END FROM h
UNION ALL SELECT 'public.supplier', concat_ws('-', m[1:8], m[9:12], m[13:16], m[17:20], m[21:32]), 2 FROM u"""

ORACLE["merge_resume"] = f"""WITH {_KILLED}, {_LOG},
x AS (SELECT h.pk, CASE WHEN h.pk <= (SELECT reached FROM cur) THEN chunk_id // 3 * 1000 ELSE 3500 END AS xmin FROM h)
SELECT xid, w.pk, xmin, CASE WHEN xid >= xmin THEN 'emit' ELSE 'discard_stale' END AS verdict FROM w JOIN x USING (pk) WHERE lsn > 40"""

ORACLE["stream_ledger"] = """
SELECT CASE WHEN event_id % 2 = 0 THEN 'failed' ELSE 'ok' END AS status, count(*) AS n, count(DISTINCT event_id) AS n_distinct, count(*) AS n_acknowledged FROM events GROUP BY ALL"""
