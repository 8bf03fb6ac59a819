"""DuckDB oracle SQL for the registered queries (same column names and types)."""

from __future__ import annotations

from ..operators.audit import DATA_MARKER, SCHEMA_MARKER

_V = "strftime(ts, '%Y%m%d%H%M%S')"
_CUT = "'20240115000000'"
_TRIM = r"[\t\n\x{0B}\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"

_CLASS = ("CASE event_type WHEN 'click' THEN 'schema' WHEN 'view' THEN 'data' WHEN 'purchase' THEN 'mixed' "
          "ELSE 'unknown' END")

ORACLE = {
    "dump_row_counts": """
SELECT 'public.region' AS target, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT r_regionkey // 100) AS BIGINT) AS n_statements FROM region
UNION ALL SELECT 'public.nation', count(*), count(DISTINCT n_nationkey // 100) FROM nation
UNION ALL SELECT 'public.supplier', count(*), count(DISTINCT s_suppkey // 100) FROM supplier
UNION ALL SELECT 'public.customer', count(*), count(DISTINCT c_custkey // 100) FROM customer
UNION ALL SELECT 'public.part', count(*), count(DISTINCT p_partkey // 100) FROM part
UNION ALL SELECT 'public.orders', count(*), count(DISTINCT o_orderkey // 100) FROM orders
""",
    "rows_per_insert": """
SELECT target, CAST((rn - 1) // 200 + 1 AS BIGINT) AS chunk_no, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(min(o_orderkey) AS BIGINT) AS first_key, CAST(max(o_orderkey) AS BIGINT) AS last_key
FROM (SELECT o_orderpriority AS target, o_orderkey,
             row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn FROM orders)
GROUP BY 1, 2
""",
    "chunk_by_bytes": """
WITH RECURSIVE t AS (
  SELECT source, doc_id,
         strlen('(' || doc_id || ', ''' || replace(text, '''', '''''') || ''')') + 2 AS w,
         strlen('INSERT INTO public.' || source || ' (doc_id, text) VALUES') + 2 AS h,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn
  FROM documents),
r AS (
  SELECT source, rn, doc_id, w, h, 1 AS chunk_no, 1 AS cnt, h + w AS bytes FROM t WHERE rn = 1
  UNION ALL
  SELECT t.source, t.rn, t.doc_id, t.w, t.h,
         CASE WHEN r.cnt >= 8 OR r.bytes + t.w > 16384 THEN r.chunk_no + 1 ELSE r.chunk_no END,
         CASE WHEN r.cnt >= 8 OR r.bytes + t.w > 16384 THEN 1 ELSE r.cnt + 1 END,
         CASE WHEN r.cnt >= 8 OR r.bytes + t.w > 16384 THEN t.h + t.w ELSE r.bytes + t.w END
  FROM r JOIN t ON t.source = r.source AND t.rn = r.rn + 1)
SELECT source, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(min(doc_id) AS BIGINT) AS first_doc, CAST(max(doc_id) AS BIGINT) AS last_doc,
       CAST(sum(w) + max(h) AS BIGINT) AS chunk_bytes
FROM r GROUP BY source, chunk_no
""",
    "pack_files": """
WITH RECURSIVE s AS (
  SELECT 'public.' || source AS target, doc_id, len(string_split(text, chr(10))) AS l, strlen(text) AS b,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn
  FROM documents),
tot AS (SELECT target, sum(l) AS tl, count(*) AS ts, sum(b) AS tb, min(doc_id) AS fs FROM s GROUP BY target),
tn AS (SELECT target, row_number() OVER (ORDER BY fs) + 1 AS table_no,
              (tl > 600 OR ts > 60 OR tb > 150000) AS needs FROM tot),
r AS (
  SELECT target, rn, doc_id, l, b, 1 AS part_no, 1 AS cnt, l AS lines, b AS bytes FROM s WHERE rn = 1
  UNION ALL
  SELECT s.target, s.rn, s.doc_id, s.l, s.b,
         CASE WHEN r.lines + s.l > 600 OR r.cnt >= 60 OR r.bytes + s.b > 150000 THEN r.part_no + 1 ELSE r.part_no END,
         CASE WHEN r.lines + s.l > 600 OR r.cnt >= 60 OR r.bytes + s.b > 150000 THEN 1 ELSE r.cnt + 1 END,
         CASE WHEN r.lines + s.l > 600 OR r.cnt >= 60 OR r.bytes + s.b > 150000 THEN s.l ELSE r.lines + s.l END,
         CASE WHEN r.lines + s.l > 600 OR r.cnt >= 60 OR r.bytes + s.b > 150000 THEN s.b ELSE r.bytes + s.b END
  FROM r JOIN s ON s.target = r.target AND s.rn = r.rn + 1),
f AS (SELECT r.*, tn.table_no, tn.needs, CASE WHEN tn.needs THEN r.part_no END AS pn FROM r JOIN tn USING (target))
SELECT printf('%03d_%s', table_no, replace(target, '.', '_'))
         || CASE WHEN needs THEN printf('_%02d', pn) ELSE '' END || '.sql' AS file_name,
       target, CAST(table_no AS BIGINT) AS table_no, CAST(pn AS BIGINT) AS part_no,
       CAST(count(*) AS BIGINT) AS n_statements, CAST(sum(l) AS BIGINT) AS n_lines, CAST(sum(b) AS BIGINT) AS n_bytes,
       CAST(min(doc_id) AS BIGINT) AS first_doc, CAST(max(doc_id) AS BIGINT) AS last_doc
FROM f GROUP BY target, table_no, needs, pn
""",
    "limit_overrides": """
WITH rules(target, max_lines, max_statements, max_rows, max_bytes, skip) AS (VALUES
  ('1-URGENT', NULL, NULL, 50, NULL, false), ('2-HIGH', NULL, NULL, NULL, NULL, true),
  ('3-MEDIUM', 100, NULL, NULL, 0, false), ('4-NOT SPECIFIED', NULL, 5, -3, NULL, false)),
t AS (SELECT o_orderpriority AS target, count(*) AS n_rows,
             sum(strlen('(' || o_orderkey || ', ' || o_custkey || ', ''' || o_orderstatus || ''')')) AS total_bytes
      FROM orders GROUP BY 1),
e AS (SELECT t.*,
        CASE WHEN r.max_lines > 0 THEN r.max_lines ELSE 2000 END AS ml,
        CASE WHEN r.max_statements > 0 THEN r.max_statements ELSE 20 END AS ms,
        CASE WHEN r.max_rows > 0 THEN r.max_rows ELSE 200 END AS mr,
        CASE WHEN r.max_bytes > 0 THEN r.max_bytes ELSE 2097152 END AS mb
      FROM t LEFT JOIN rules r USING (target) WHERE NOT coalesce(r.skip, false))
SELECT target, CAST(ml AS BIGINT) AS max_lines, CAST(ms AS BIGINT) AS max_statements, CAST(mr AS BIGINT) AS max_rows,
       CAST(mb AS BIGINT) AS max_bytes, CAST(n_rows AS BIGINT) AS n_rows, CAST(total_bytes AS BIGINT) AS total_bytes,
       CAST(ceil(n_rows / mr) AS BIGINT) AS n_chunks, total_bytes > mb AS exceeds_bytes
FROM e
""",
    "reconcile_counts": """
WITH l AS (SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY 1),
r AS (SELECT c_custkey AS key, count(o_orderkey) AS n FROM customer
      LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus <> 'P'
      WHERE c_mktsegment <> 'AUTOMOBILE' GROUP BY 1)
SELECT CAST(coalesce(l.key, r.key) AS BIGINT) AS key, CAST(l.n AS BIGINT) AS n_left, CAST(r.n AS BIGINT) AS n_right,
       CASE WHEN r.n IS NULL THEN 'missing' WHEN l.n IS NULL THEN 'extra' WHEN l.n <> r.n THEN 'mismatch' ELSE 'ok' END AS status
FROM l FULL OUTER JOIN r ON l.key = r.key
""",
    "fingerprint_by_group": f"""
WITH d AS (SELECT source, lang, doc_id, text,
                  regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '{_TRIM}+$', '') || chr(10) AS norm
           FROM documents)
SELECT source, lang, CAST(count(*) AS BIGINT) AS n_members, CAST(sum(strlen(text)) AS BIGINT) AS total_bytes,
       CAST(sum(CAST(CAST('0x' || substr(md5(doc_id || ':' || md5(norm)), 1, 13) AS BIGINT) AS DECIMAL(38,0))) AS VARCHAR)
         AS fingerprint
FROM d GROUP BY source, lang
""",
    "first_difference": """
WITH o AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                  unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents),
e AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS line_no,
             replace(line, ' the ', ' teh ') AS line FROM o WHERE NOT starts_with(line, 'The')),
d AS (SELECT coalesce(o.doc_id, e.doc_id) AS doc_id, coalesce(o.line_no, e.line_no) AS line_no,
             o.line AS original, e.line AS edited
      FROM o FULL OUTER JOIN e ON o.doc_id = e.doc_id AND o.line_no = e.line_no
      WHERE o.line IS DISTINCT FROM e.line),
m AS (SELECT doc_id, min(struct_pack(l := line_no, o := original, e := edited)) AS s FROM d GROUP BY doc_id)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(s.l AS BIGINT) AS first_diff_line, s.o AS original, s.e AS edited FROM m
""",
    "version_max": """
WITH v AS (SELECT user_id, CASE WHEN event_type = 'error' THEN 'v' || event_id
                               WHEN event_type = 'view' THEN '0' || event_id
                               ELSE CAST(event_id AS VARCHAR) END AS v FROM events)
SELECT CAST(user_id AS BIGINT) AS user_id,
       arg_max(v, (length(v), v)) FILTER (WHERE regexp_full_match(v, '[0-9]+')) AS latest_version,
       CAST(count(*) FILTER (WHERE regexp_full_match(v, '[0-9]+')) AS BIGINT) AS n_valid,
       CAST(count(*) FILTER (WHERE NOT regexp_full_match(v, '[0-9]+')) AS BIGINT) AS n_invalid
FROM v GROUP BY user_id
""",
    "ledger_alignment": f"""
WITH e AS (SELECT user_id, {_V} AS v, event_type, value FROM events),
loc AS (SELECT DISTINCT user_id, v FROM e WHERE value >= 10 AND event_type <> 'signup'),
rem AS (SELECT DISTINCT user_id, v FROM e WHERE value <= 40 AND event_type <> 'error'),
u AS (SELECT DISTINCT user_id FROM e WHERE value >= 10 OR (value <= 40 AND event_type <> 'error')),
both_ AS (SELECT user_id, v FROM loc INTERSECT SELECT user_id, v FROM rem),
a AS (SELECT u.user_id,
        (SELECT max(v) FROM loc WHERE loc.user_id = u.user_id) AS latest_local,
        (SELECT max(v) FROM rem WHERE rem.user_id = u.user_id) AS latest_remote,
        (SELECT max(v) FROM both_ WHERE both_.user_id = u.user_id) AS latest_aligned
      FROM u)
SELECT CAST(user_id AS BIGINT) AS user_id, latest_local, latest_remote, latest_aligned,
       CASE WHEN latest_local IS NULL AND latest_remote IS NULL THEN 'empty'
            WHEN latest_local IS NOT DISTINCT FROM latest_remote THEN 'ok' ELSE 'blocked' END AS gate_status
FROM a
""",
    "cutoff_resolve": f"""
WITH e AS (SELECT user_id, {_V} AS v, event_type, value FROM events),
loc AS (SELECT DISTINCT user_id, v FROM e WHERE value >= 10 AND event_type <> 'signup'),
rem AS (SELECT DISTINCT user_id, v FROM e WHERE value <= 40 AND event_type <> 'error'),
al AS (SELECT user_id, max(v) AS aligned FROM (SELECT user_id, v FROM loc INTERSECT SELECT user_id, v FROM rem) GROUP BY 1),
p AS (SELECT user_id,
        max(v) FILTER (WHERE event_type = 'signup' AND value > 45) AS argument,
        max(v) FILTER (WHERE event_type = 'purchase' AND value < 5) AS env_config,
        min(v || CASE WHEN value > 48 THEN 'x' ELSE '' END) FILTER (WHERE event_type = 'view') AS config
      FROM e GROUP BY 1)
SELECT CAST(p.user_id AS BIGINT) AS user_id,
       CASE WHEN argument IS NOT NULL THEN argument WHEN aligned IS NOT NULL THEN aligned
            WHEN regexp_full_match(env_config, '[0-9]+') THEN env_config
            WHEN regexp_full_match(config, '[0-9]+') THEN config END AS cutoff,
       CASE WHEN argument IS NOT NULL THEN 'argument' WHEN aligned IS NOT NULL THEN 'linked'
            WHEN regexp_full_match(env_config, '[0-9]+') THEN 'config'
            WHEN regexp_full_match(config, '[0-9]+') THEN 'config' END AS source
FROM p LEFT JOIN al USING (user_id)
""",
    "cutoff_grid": f"""
WITH e AS (SELECT user_id, {_CLASS} AS c, CASE WHEN {_V} <= {_CUT} THEN 'pre' ELSE 'post' END AS phase FROM events)
SELECT CAST(user_id AS BIGINT) AS user_id, phase,
       CAST(count(*) FILTER (WHERE c = 'schema') AS BIGINT) AS schema,
       CAST(count(*) FILTER (WHERE c = 'data') AS BIGINT) AS data,
       CAST(count(*) FILTER (WHERE c = 'mixed') AS BIGINT) AS mixed,
       CAST(count(*) FILTER (WHERE c = 'unknown') AS BIGINT) AS unknown,
       CAST(count(*) AS BIGINT) AS total
FROM e GROUP BY user_id, phase
""",
    "replay_plan": f"""
WITH e AS (SELECT user_id, event_id, {_V} AS version, {_CLASS} AS classification FROM events),
p AS (SELECT *, CASE WHEN version <= {_CUT} THEN 'pre' ELSE 'post' END AS phase FROM e),
a AS (SELECT *, CASE WHEN phase = 'pre' AND classification = 'data' THEN 'skip' WHEN phase = 'pre' THEN 'rebuild'
                     ELSE 'replay' END AS action,
             CASE WHEN classification = 'mixed' AND phase = 'post' THEN 'needs_split'
                  WHEN classification = 'mixed' THEN 'warn' ELSE 'ok' END AS policy_status FROM p),
s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY length(version), version, event_id) AS rs
      FROM a WHERE action = 'replay')
SELECT CAST(a.user_id AS BIGINT) AS user_id, CAST(a.event_id AS BIGINT) AS event_id, version, classification, phase,
       action, policy_status, CAST(s.rs AS BIGINT) AS replay_seq
FROM a LEFT JOIN s USING (user_id, event_id)
""",
    "snapshot_replay": f"""
WITH e AS (SELECT user_id, event_id, event_type, value, {_V} AS version, event_type = 'error' AS is_delete FROM events),
snap AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY user_id
           ORDER BY length(version) DESC, version DESC, event_id DESC) AS rn
         FROM e WHERE version <= {_CUT}) WHERE rn = 1 AND NOT is_delete),
u AS (SELECT * FROM snap UNION ALL SELECT * FROM e WHERE version > {_CUT}),
w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY length(version) DESC, version DESC, event_id DESC) AS rn FROM u)
SELECT CAST(user_id AS BIGINT) AS user_id, CAST(event_id AS BIGINT) AS event_id, event_type, value, version
FROM w WHERE rn = 1 AND NOT is_delete
""",
    "kind_segments": """
WITH k AS (SELECT user_id, event_id, event_type,
                  CASE event_type WHEN 'click' THEN 'schema' WHEN 'signup' THEN 'schema'
                                  WHEN 'view' THEN 'data' WHEN 'purchase' THEN 'data' END AS kind FROM events),
f AS (SELECT *, coalesce(last_value(kind IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'schema') AS filled FROM k),
g AS (SELECT *, CASE WHEN lag(filled) OVER (PARTITION BY user_id ORDER BY event_id) IS NULL
                       OR lag(filled) OVER (PARTITION BY user_id ORDER BY event_id) <> filled THEN 1 ELSE 0 END AS chg FROM f),
s AS (SELECT *, sum(chg) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg FROM g)
SELECT CAST(user_id AS BIGINT) AS user_id, CAST(seg AS BIGINT) AS segment_no, min(filled) AS kind,
       CAST(count(*) AS BIGINT) AS n_events, CAST(min(event_id) AS BIGINT) AS first_event,
       CAST(max(event_id) AS BIGINT) AS last_event,
       string_agg(event_type || ':' || event_id, chr(10) || chr(10) ORDER BY event_id) AS content
FROM s GROUP BY user_id, seg
""",
    "renumber": f"""
WITH e AS (SELECT user_id, event_id, event_type, {_V} AS version FROM events),
n AS (SELECT *, version || '_' || event_type || '_' || event_id || '.sql' AS name FROM e),
ear AS (SELECT user_id, min(version) AS earliest FROM e WHERE event_type = 'purchase' GROUP BY 1),
seg(segment_no) AS (VALUES (1), (2)),
outs AS (SELECT n.*, ear.earliest, seg.segment_no,
           CASE WHEN event_type = 'purchase' THEN 'split' ELSE 'renumber' END AS kind,
           CASE WHEN event_type = 'purchase'
                THEN event_type || '_' || event_id || '_' || CASE seg.segment_no WHEN 1 THEN 'schema' ELSE 'data' END
                     || '_' || seg.segment_no || '.sql'
                ELSE event_type || '_' || event_id || '.sql' END AS suffix
         FROM n JOIN ear USING (user_id) JOIN seg ON seg.segment_no = 1 OR n.event_type = 'purchase'
         WHERE n.version >= ear.earliest),
pos AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY length(version), version, name, segment_no) AS p FROM outs),
nv AS (SELECT *, CAST(CAST(earliest AS DECIMAL(38,0)) + p - 1 AS DECIMAL(38,0)) AS v FROM pos)
SELECT CAST(user_id AS BIGINT) AS user_id, name,
       CASE WHEN bool_or(kind = 'split') THEN 'split' ELSE 'renumber' END AS kind,
       string_agg(CAST(v AS VARCHAR) || '_' || suffix, ',' ORDER BY v) AS after_names
FROM nv GROUP BY user_id, name
""",
    "pattern_evidence": """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                  unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents),
p(pattern, pattern_no) AS (VALUES ('the', 1), ('que', 2), ('und', 3), ('ion', 4), ('ent', 5)),
m AS (SELECT doc_id, line_no, line, pattern, pattern_no, len(regexp_extract_all(line, '(?i)' || pattern)) AS n FROM l, p),
x AS (SELECT doc_id, line_no, line, pattern, pattern_no, unnest(range(1, n + 1)) AS k FROM m WHERE n > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pattern_no, line_no, k) AS rank FROM x)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(rank AS BIGINT) AS rank, pattern, CAST(line_no AS BIGINT) AS line,
       CASE WHEN length(trim(line)) > 180 THEN substr(trim(line), 1, 177) || '...' ELSE trim(line) END AS snippet
FROM r WHERE rank <= 3
""",
    "script_classes": """
SELECT CAST(user_id AS BIGINT) AS user_id, CAST(event_id AS BIGINT) AS event_id,
       CASE event_type WHEN 'click' THEN 'schema' WHEN 'view' THEN 'data' WHEN 'purchase' THEN 'mixed'
                       WHEN 'error' THEN 'unknown' WHEN 'signup' THEN 'data' END AS classification,
       CASE WHEN event_type = 'signup' THEN 'marker' ELSE 'heuristic' END AS source,
       CASE event_type WHEN 'click' THEN 'schema' WHEN 'view' THEN 'data' END AS recommended_marker,
       CAST(CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS BIGINT) AS n_ddl,
       CAST(CASE WHEN event_type IN ('view', 'purchase', 'signup') THEN 1 ELSE 0 END AS BIGINT) AS n_dml
FROM events
""",
    "load_queue": r"""
WITH f AS (SELECT DISTINCT regexp_replace(url, '^https?://', '') AS path FROM pages),
p(pattern_no, rx) AS (VALUES (1, '[^/]*\.example\.com/en/[^/]*'), (2, '[^/]*\.example\.org/[^/]*/[^/]*'),
                             (3, 'blog\.[^/]*/[^/]*/[^/]*')),
m AS (SELECT path, min(pattern_no) AS pattern_no FROM f JOIN p ON regexp_full_match(path, rx) GROUP BY path)
SELECT CAST(row_number() OVER (ORDER BY pattern_no, path) AS BIGINT) AS queue_no, CAST(pattern_no AS BIGINT) AS pattern_no,
       path, string_split(path, '/')[-1] AS base_name
FROM m
""",
    "ignore_filter": r"""
WITH f AS (SELECT DISTINCT regexp_replace(url, '^https?://', '') AS path FROM pages),
b AS (SELECT path, string_split(path, '/')[-1] AS base_name FROM f)
SELECT path, base_name FROM b
WHERE (regexp_full_match(path, '.*\.example\.org.*') OR regexp_full_match(base_name, '.*\.example\.org.*')
       OR regexp_full_match(path, '.*utm_source=feed') OR regexp_full_match(base_name, '.*utm_source=feed'))
  AND NOT (regexp_full_match(base_name, '.*\.html') OR regexp_full_match(base_name, '.*#top')
           OR base_name = 'fr' OR ends_with('fr', '/' || base_name))
""",
    "redact_literals": """
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn,
       replace(replace(replace(text, 'the', '[REDACTED]'), 'de', '[REDACTED]'), 'la', '[REDACTED]') AS text
FROM conversations
""",
    "deploy_phrase": f"""
WITH e AS (SELECT user_id, {_CLASS} AS c, {_V} <= {_CUT} AS pre FROM events),
g AS (SELECT user_id,
        count(*) FILTER (WHERE pre AND c = 'schema') AS a_s, count(*) FILTER (WHERE pre AND c = 'data') AS a_d,
        count(*) FILTER (WHERE pre AND c = 'mixed') AS a_m, count(*) FILTER (WHERE pre AND c = 'unknown') AS a_u,
        count(*) FILTER (WHERE NOT pre AND c = 'schema') AS b_s, count(*) FILTER (WHERE NOT pre AND c = 'data') AS b_d,
        count(*) FILTER (WHERE NOT pre AND c = 'mixed') AS b_m, count(*) FILTER (WHERE NOT pre AND c = 'unknown') AS b_u,
        count(*) FILTER (WHERE pre) AS a_t, count(*) FILTER (WHERE NOT pre) AS b_t
      FROM e GROUP BY user_id)
SELECT CAST(user_id AS BIGINT) AS user_id, 'Jan 15 2024' AS last_deploy,
       CAST(a_t AS BIGINT) AS pre_total, CAST(b_t AS BIGINT) AS post_total,
       concat_ws(' · ', CASE WHEN a_s > 0 THEN a_s || ' schema' END, CASE WHEN a_m > 0 THEN a_m || ' schema+data' END,
                 CASE WHEN a_u > 0 THEN a_u || ' unrecognized' END) AS ran_during_rebuild,
       concat_ws(' · ', CASE WHEN a_d > 0 THEN a_d || ' data' END) AS skipped_in_snapshot,
       concat_ws(' · ', CASE WHEN b_s > 0 THEN b_s || ' schema' END, CASE WHEN b_d > 0 THEN b_d || ' data' END,
                 CASE WHEN b_m > 0 THEN b_m || ' schema+data' END, CASE WHEN b_u > 0 THEN b_u || ' unrecognized' END)
         AS applied_after,
       '≤ Jan 15' AS pre_label
FROM g
""",
    "resumable_load": """
SELECT CAST(doc_id AS BIGINT) AS doc_id, text, lang, source, CAST(n_chars AS BIGINT) AS n_chars FROM documents
""",
}

ORACLE["audit_summary"] = """
SELECT CAST(user_id AS BIGINT) AS user_id, CAST(count(*) AS BIGINT) AS total,
       CAST(count(*) FILTER (WHERE event_type IN ('view', 'signup')) AS BIGINT) AS data,
       CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS schema,
       CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS mixed,
       CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS unknown,
       CAST(count(*) FILTER (WHERE event_type IN ('click', 'view')) AS BIGINT) AS suggested_updates
FROM events GROUP BY user_id
"""

ORACLE["split_plan"] = f"""
WITH e AS (SELECT user_id, event_id, event_type, {_V} AS version FROM events),
n AS (SELECT *, version || '_' || event_type || '_' || event_id || '.sql' AS name,
        CASE event_type
          WHEN 'click' THEN 'CREATE TABLE t_' || event_id || ' (id bigint);' || chr(10)
          WHEN 'view' THEN 'INSERT INTO t VALUES (' || event_id || ');' || chr(10)
          WHEN 'error' THEN 'SELECT ' || event_id || ';' || chr(10)
          WHEN 'signup' THEN 'UPDATE u SET n = ' || event_id || ';' || chr(10) END AS text FROM e),
ear AS (SELECT user_id, min(version) AS earliest FROM e WHERE event_type = 'purchase' GROUP BY 1),
seg(segment_no) AS (VALUES (1), (2)),
outs AS (
  SELECT n.user_id, n.name, n.version, seg.segment_no, ear.earliest,
         CASE WHEN event_type = 'purchase' THEN 'split' ELSE 'renumber' END AS kind,
         CASE WHEN event_type = 'purchase'
              THEN 'purchase_' || event_id || CASE seg.segment_no WHEN 1 THEN '_schema_1.sql' ELSE '_data_2.sql' END
              ELSE event_type || '_' || event_id || '.sql' END AS suffix,
         CASE WHEN event_type = 'purchase'
              THEN 'BEGIN;' || chr(10)
                   || CASE seg.segment_no WHEN 1 THEN 'CREATE TABLE p_' || event_id || ' (id bigint);'
                                          ELSE 'INSERT INTO p_' || event_id || ' VALUES (1);' END
                   || chr(10) || chr(10) || 'COMMIT;' || chr(10)
              ELSE text END AS content
  FROM n JOIN ear USING (user_id) JOIN seg ON seg.segment_no = 1 OR n.event_type = 'purchase'
  WHERE n.version >= ear.earliest),
pos AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY length(version), version, name, segment_no) AS p FROM outs)
SELECT CAST(user_id AS BIGINT) AS user_id, name,
       CAST(CAST(CAST(earliest AS DECIMAL(38,0)) + p - 1 AS DECIMAL(38,0)) AS VARCHAR) || '_' || suffix AS new_name,
       kind, content, CAST(NULL AS VARCHAR) AS error
FROM pos
"""

ORACLE["rechunk_statements"] = """
WITH RECURSIVE hh AS (SELECT strlen('INSERT INTO public.orders (o_orderkey, o_orderpriority) VALUES') + 2 AS h),
t AS (SELECT o_orderkey // 100 + 1 AS stmt_no, o_orderkey,
             strlen('(' || o_orderkey || ', ''' || o_orderpriority || ''')') + 2 AS w,
             row_number() OVER (PARTITION BY o_orderkey // 100 ORDER BY o_orderkey) AS rn
      FROM orders),
s AS (SELECT stmt_no, count(*) AS n, sum(w + 1) AS sw FROM t GROUP BY stmt_no),
g AS (SELECT s.stmt_no, (s.n <= 100 AND hh.h - 2 + s.sw <= 2100) AS whole, hh.h FROM s, hh),
r AS (
  SELECT t.stmt_no, t.rn, t.o_orderkey, t.w, g.h, g.whole, 1 AS chunk_no, 1 AS cnt, g.h + t.w AS bytes
  FROM t JOIN g USING (stmt_no) WHERE t.rn = 1
  UNION ALL
  SELECT t.stmt_no, t.rn, t.o_orderkey, t.w, r.h, r.whole,
         CASE WHEN NOT r.whole AND (r.cnt >= 100 OR r.bytes + t.w > 2100) THEN r.chunk_no + 1 ELSE r.chunk_no END,
         CASE WHEN NOT r.whole AND (r.cnt >= 100 OR r.bytes + t.w > 2100) THEN 1 ELSE r.cnt + 1 END,
         CASE WHEN NOT r.whole AND (r.cnt >= 100 OR r.bytes + t.w > 2100) THEN r.h + t.w ELSE r.bytes + t.w END
  FROM r JOIN t ON t.stmt_no = r.stmt_no AND t.rn = r.rn + 1)
SELECT CAST(stmt_no AS BIGINT) AS stmt_no, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(sum(w) + max(h) AS BIGINT) AS chunk_bytes, CAST(min(o_orderkey) AS BIGINT) AS first_key,
       CAST(max(o_orderkey) AS BIGINT) AS last_key
FROM r GROUP BY stmt_no, chunk_no
"""



_PART_TEXTS = r"""
parts AS (SELECT p_partkey, p_partkey % 14 AS t, CAST(p_partkey AS VARCHAR) AS k, CAST(p_size AS VARCHAR) AS z FROM part),
texts AS (SELECT *, CASE t
    WHEN 0 THEN 'CREATE TABLE public.part_' || k || ' (' || chr(10) || '  id bigint' || chr(10) || ');'
    WHEN 1 THEN 'CREATE INDEX idx_part_' || k || ' ON public.part (p_size);'
    WHEN 2 THEN 'CREATE OR REPLACE FUNCTION public.fn_' || k || '()' || chr(10) || 'RETURNS int AS $$' || chr(10) || 'BEGIN' || chr(10)
        || '  -- CREATE TYPE in a body' || chr(10) || '  RETURN ' || z || ';' || chr(10) || 'END;' || chr(10) || '$$ LANGUAGE plpgsql;'
    WHEN 3 THEN 'ALTER TABLE ONLY public.part' || chr(10) || '    ADD CONSTRAINT part_pk_' || k || ' PRIMARY KEY (p_partkey);'
    WHEN 4 THEN 'GRANT SELECT ON public.part TO role_' || k || ';'
    WHEN 5 THEN '-- promo part' || chr(10) || 'CREATE VIEW public.v_' || k || ' AS SELECT 1;'
    WHEN 6 THEN 'CREATE EXTENSION IF NOT EXISTS "ext_' || k || '";'
    WHEN 7 THEN 'SET lock_timeout = ' || z || ';'
    WHEN 8 THEN 'CREATE TYPE public.kind_' || k || ' AS ENUM (''a'', ''b;'');'
    WHEN 9 THEN 'ALTER TABLE public.part ADD CONSTRAINT "fk_' || k || '" FOREIGN KEY (a) REFERENCES b (c);'
    WHEN 10 THEN 'CREATE POLICY "p ' || k || '" ON public.part;'
    WHEN 11 THEN 'ALTER TABLE public.part OWNER TO owner_' || k || ';'
    WHEN 12 THEN '/* a; comment */' || chr(10) || 'TRUNCATE part_' || k || ';'
    ELSE 'ALTER TABLE part_' || k || ' ENABLE ROW LEVEL SECURITY;' END AS body FROM parts),
sized AS (SELECT *, len(string_split(body, chr(10))) AS n FROM texts),
placed AS (SELECT *, coalesce(sum(n) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS line_start FROM sized)
"""

ORACLE["category_sequence"] = f"""
WITH {_PART_TEXTS},
c AS (SELECT *, CASE t WHEN 0 THEN 'tables' WHEN 1 THEN 'indexes' WHEN 2 THEN 'functions' WHEN 3 THEN 'constraints' WHEN 4 THEN 'permissions'
    WHEN 5 THEN 'views' WHEN 6 THEN 'extensions' WHEN 7 THEN 'setup' WHEN 8 THEN 'types' WHEN 9 THEN 'foreign_keys' WHEN 10 THEN 'rls'
    WHEN 11 THEN 'ownership' WHEN 12 THEN 'others' ELSE 'rls' END AS category FROM placed),
f(category, folder) AS (VALUES ('extensions', '00_extensions'), ('setup', '01_setup'), ('types', '02_types'), ('functions', '03_functions'),
    ('tables', '04_tables'), ('views', '05_views'), ('constraints', '06_constraints'), ('indexes', '07_indexes'), ('foreign_keys', '08_foreign_keys'),
    ('rls', '09_rls'), ('permissions', '10_permissions'), ('ownership', '11_ownership'), ('others', '12_others')),
s AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY p_partkey) AS cat_seq FROM c JOIN f USING (category)),
n AS (SELECT *, CASE t WHEN 0 THEN 'part_' || k WHEN 1 THEN 'idx_part_' || k WHEN 2 THEN 'fn_' || k WHEN 3 THEN 'part_pk_' || k WHEN 4 THEN 'grant_' || cat_seq
    WHEN 5 THEN 'v_' || k WHEN 6 THEN 'ext_' || k WHEN 7 THEN 'setup_' || cat_seq WHEN 8 THEN 'kind_' || k WHEN 9 THEN 'fk_' || k WHEN 10 THEN 'p ' || k
    WHEN 11 THEN 'ownership_' || cat_seq WHEN 12 THEN 'other_' || cat_seq ELSE 'rls_enable' END AS object_name FROM s)
SELECT CAST(line_start AS BIGINT) AS line_start, CAST(line_start + n - 1 AS BIGINT) AS line_end, category, object_name, CAST(cat_seq AS BIGINT) AS cat_seq,
       folder || '/' || printf('%04d', cat_seq) || '_' || lower(regexp_replace(object_name, '[^a-zA-Z0-9_]', '_', 'g')) || '.sql' AS file_name,
       md5(body || chr(10)) AS text_md5
FROM n
"""

ORACLE["schema_roundtrip"] = f"""
WITH {_PART_TEXTS}
SELECT 'schema.sql' AS file_id, CAST(count(*) AS BIGINT) AS n_statements, CAST(sum(n) AS BIGINT) AS n_lines,
       CAST(sum(n) AS BIGINT) AS n_lines_back, true AS fingerprint_equal, CAST(NULL AS BIGINT) AS first_diff_line
FROM sized
"""

ORACLE["markers_roundtrip"] = f"""
WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN chr(65279) ELSE '' END AS bom FROM documents)
SELECT CAST(doc_id AS BIGINT) AS doc_id, bom || '-- {DATA_MARKER}' || chr(10) || chr(10) || text AS marked,
       md5(bom || chr(10) || text) AS unmarked_md5, true AS removed
FROM d
"""

ORACLE["marker_facts"] = f"""
WITH d AS (SELECT doc_id, doc_id % 9 AS m, replace(text, '--', '') AS text FROM documents),
h(m, head, bare, is_data, is_schema, n, removed) AS (VALUES
    (0, '', '', false, false, 0, false),
    (1, '-- {DATA_MARKER}' || chr(10), '', true, false, 1, true),
    (2, chr(65279) || '-- {DATA_MARKER}' || chr(10) || chr(10), chr(65279) || chr(10), true, false, 1, true),
    (3, '--{SCHEMA_MARKER}' || chr(13) || chr(10), '', false, true, 1, true),
    (4, '  --   {SCHEMA_MARKER} and more' || chr(10), '  --   {SCHEMA_MARKER} and more' || chr(10), false, true, 1, false),
    (5, '', '', true, true, 2, true),
    (6, '', '-- {DATA_MARKER}x' || chr(10), false, false, 0, false),
    (7, '', 'SELECT 1; -- {DATA_MARKER}' || chr(10), false, false, 0, false),
    (8, '', '-- ' || upper('{SCHEMA_MARKER}') || chr(10), false, true, 1, false))
SELECT CAST(doc_id AS BIGINT) AS doc_id, is_data AS has_data_marker, is_schema AS has_schema_marker, CAST(n AS BIGINT) AS n_markers,
       CAST(CASE WHEN n > 0 THEN 1 END AS BIGINT) AS first_line, removed, md5(bare || text) AS left_md5
FROM d JOIN h USING (m)
"""

ORACLE["script_evidence"] = """
WITH d AS (SELECT doc_id, len(string_split(text, chr(10))) - 1 AS n FROM documents),
dml AS (SELECT doc_id, n, list_slice(list_concat(list_transform(range(1, n + 1), lambda k: 'INSERT INTO@L' || (5 + 2 * k)),
               ['UPDATE@L5', 'UPDATE@L' || (7 + 2 * n)]), 1, 3) AS top FROM d)
SELECT CAST(doc_id AS BIGINT) AS doc_id, 'ddl' AS family, CAST(2 AS BIGINT) AS n, CAST(12 + 2 * n AS BIGINT) AS lines,
       CAST(NULL AS VARCHAR) AS last_update, 'CREATE TABLE@L4, DROP TABLE@L' || (8 + 2 * n) AS phrase
FROM d
UNION ALL
SELECT CAST(doc_id AS BIGINT), 'dml', CAST(n + 2 AS BIGINT), CAST(5 * n + n * (n + 1) + 12 + 2 * n AS BIGINT),
       'UPDATE v SET c = 2;', array_to_string(top, ', ')
FROM dml
"""


def _quoted(column: str) -> str:
    return f"coalesce(chr(39) || replace(CAST({column} AS VARCHAR), chr(39), chr(39) || chr(39)) || chr(39), 'NULL')"


_DOC_TEXT = "replace(text, '.', '.'';--')"
_DOC_REST = " || ', ' || ".join(_quoted(c) for c in (_DOC_TEXT, "lang", "source", "n_chars"))

ORACLE["dump_roundtrip"] = f"""
WITH r AS (
  SELECT 'public.nation' AS target, n_nationkey AS k, {_quoted("n_name")} || ', ' || {_quoted("n_regionkey")} AS rest FROM nation
  UNION ALL SELECT 'public.region', r_regionkey, {_quoted("r_name")} FROM region
  UNION ALL SELECT 'public.documents', doc_id, {_DOC_REST} FROM documents)
SELECT target, CAST(k AS BIGINT) AS row_key, md5(rest) AS values_md5, CAST(length(rest) AS BIGINT) AS n_chars FROM r
"""

ORACLE["dump_split_validate"] = """
WITH o AS (SELECT o_orderkey // 50 AS g, count(*) AS n FROM orders GROUP BY 1),
d AS (SELECT doc_id // 50 AS g, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT 'rows' AS what, 'public.documents' AS target, count(*) AS n FROM documents
      UNION ALL SELECT 'rows', 'public.orders', count(*) FROM orders
      UNION ALL SELECT 'statements', 'public.documents', sum(ceil(n / 7)) FROM d
      UNION ALL SELECT 'statements', 'public.orders', sum(ceil(n / 30)) FROM o
      UNION ALL SELECT 'sequence lines', NULL, 4)
SELECT what, target, CAST(n AS BIGINT) AS n_left, CAST(n AS BIGINT) AS n_right, 'ok' AS status FROM r
"""

ORACLE["dump_file_plan"] = f"""
WITH nat AS (SELECT 'INSERT INTO public.zeta (n_nationkey, n_name) VALUES' || string_agg(chr(10) || chr(9) || '(' || n_nationkey || ', ' || {_quoted("n_name")} || ')', ',' ORDER BY n_nationkey) || ';' AS text FROM nation),
reg AS (SELECT 'INSERT INTO public.alpha (r_regionkey, r_name) VALUES' || string_agg(chr(10) || chr(9) || '(' || r_regionkey || ', ' || {_quoted("r_name")} || ')', ',' ORDER BY r_regionkey) || ';' AS text FROM region),
o AS (SELECT o_orderkey, o_orderkey // 50 AS g, '(' || o_orderkey || ', ' || {_quoted("o_orderpriority")} || ')' AS tup FROM orders),
c AS (SELECT *, (row_number() OVER (PARTITION BY g ORDER BY o_orderkey) - 1) // 30 AS c FROM o),
ch AS (SELECT g, c, 'INSERT INTO public.mid (o_orderkey, o_orderpriority) VALUES' || string_agg(chr(10) || chr(9) || tup, ',' ORDER BY o_orderkey) || ' ON CONFLICT DO NOTHING;' AS text FROM c GROUP BY g, c),
n AS (SELECT *, row_number() OVER (ORDER BY g, c) - 1 AS i FROM ch),
seq(i, t) AS (VALUES (0, 'public.zeta'), (1, 'public.mid'), (2, 'public.beta'), (3, 'public.alpha')),
sl AS (SELECT 2 * i + 1 AS p, 'SELECT pg_catalog.setval(' || chr(39) || t || '_id_seq' || chr(39) || ', 1, true);' AS text FROM seq
       UNION ALL SELECT 2 * i + 2, '-- Name: ' || string_split(t, '.')[2] || '_id_seq; Type: SEQUENCE SET' FROM seq),
r AS (
  SELECT 0 AS section, 1 AS table_no, NULL AS part_no, 1 AS position, '001_setup.sql' AS file_name,
         '-- Initial setup' || chr(10) || 'SET session_replication_role = ' || chr(39) || 'replica' || chr(39) || ';' AS text
  UNION ALL SELECT 1, 2, NULL, 1, '002_public_zeta.sql', text FROM nat
  UNION ALL SELECT 1, 3, NULL, 1, '003_public_copied.sql', 'INSERT INTO public.copied SELECT *' || chr(10) || 'FROM public.zeta;'
  UNION ALL SELECT 1, 4, i // 20 + 1, i % 20 + 1, '004_public_mid_' || printf('%02d', i // 20 + 1) || '.sql', text FROM n
  UNION ALL SELECT 1, 5, NULL, 1, '005_public_alpha.sql', text FROM reg
  UNION ALL SELECT 2, 6, NULL, 1, '006_sequences.sql', '-- Sequence values'
  UNION ALL SELECT 2, 6, NULL, p + 1, '006_sequences.sql', text FROM sl
  UNION ALL SELECT 3, 999, NULL, 1, '999_cleanup.sql', '-- Cleanup' || chr(10) || 'RESET ALL;')
SELECT CAST(section AS INTEGER) AS section, CAST(table_no AS BIGINT) AS table_no, CAST(part_no AS BIGINT) AS part_no, CAST(position AS BIGINT) AS position,
       file_name, md5(text) AS text_md5
FROM r
"""

ORACLE["schema_members"] = ORACLE["category_sequence"].rsplit("SELECT CAST(line_start", 1)[0] + """
SELECT f.file_id, folder || '/' || printf('%04d', cat_seq) || '_' || lower(regexp_replace(object_name, '[^a-zA-Z0-9_]', '_', 'g')) || '.sql' AS file_name,
       CAST(line_start AS BIGINT) AS line_start, CAST(line_start + n - 1 AS BIGINT) AS line_end, CAST(line_start + n - 1 AS BIGINT) AS index_end,
       md5(body || chr(10)) AS text_md5, category AS folder_class
FROM n AS named CROSS JOIN (VALUES ('schema.sql'), ('copy.sql')) f(file_id)
"""

ORACLE["split_plan_errors"] = """
WITH s AS (SELECT user_id, event_id, event_type, event_id + 1 AS v,
                  CASE WHEN event_id % 2 = 0 THEN '000' ELSE '' END || (event_id + 1) || '_' || event_type || '.sql' AS name,
                  event_id % 3 <> 0 AS asked FROM events),
ear AS (SELECT user_id, min(v) AS earliest FROM s WHERE asked GROUP BY 1),
seg(segment_no) AS (VALUES (1), (2)),
outs AS (SELECT s.*, earliest, segment_no, asked AND event_type = 'purchase' AS splits FROM s JOIN ear USING (user_id)
         JOIN seg ON segment_no = 1 OR (asked AND event_type = 'purchase') WHERE v >= earliest),
p AS (SELECT *, earliest + row_number() OVER (PARTITION BY user_id ORDER BY v, name, segment_no) - 1 AS nv FROM outs)
SELECT CAST(user_id AS BIGINT) AS user_id, name, CAST(segment_no AS BIGINT) AS segment_no,
       nv || '_' || CASE WHEN splits THEN event_type || CASE segment_no WHEN 1 THEN '_schema_1' ELSE '_data_2' END ELSE event_type END || '.sql' AS new_name,
       CASE WHEN asked THEN 'split' ELSE 'renumber' END AS kind,
       CASE WHEN NOT asked OR splits THEN NULL WHEN event_type = 'click' THEN 'no separable schema/data groups' WHEN event_type = 'view' THEN 'unbalanced BEGIN/COMMIT'
            WHEN event_type = 'error' THEN 'top-level ROLLBACK' ELSE 'transaction statements inside the script' END AS error
FROM p
UNION ALL
SELECT CAST(user_id AS BIGINT), 'ghost_' || name, NULL, NULL, 'split', 'script not found' FROM s WHERE event_id % 50 = 0
"""

ORACLE["split_blocked"] = f"""
WITH e AS (SELECT user_id, event_id, event_type, {_V} AS version FROM events),
ear AS (SELECT user_id, min(version) AS earliest FROM e WHERE event_type = 'purchase' GROUP BY 1),
t AS (SELECT e.*, version || '_' || event_type || '_' || event_id || '.sql' AS name FROM e JOIN ear USING (user_id) WHERE version >= earliest),
rem AS (SELECT DISTINCT user_id, version, true AS blocked FROM e WHERE event_type = 'click')
SELECT CAST(user_id AS BIGINT) AS user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY length(version), version, name) AS BIGINT) AS change_no, name,
       CASE WHEN event_type = 'purchase' THEN 'split' ELSE 'renumber' END AS kind, CAST(CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END AS BIGINT) AS n_after,
       coalesce(blocked, false) AS blocked,
       CASE event_type WHEN 'purchase' THEN 'mixed' WHEN 'view' THEN 'data' WHEN 'signup' THEN 'data' ELSE 'unknown' END AS classification
FROM t LEFT JOIN rem USING (user_id, version)
"""

ORACLE["resume_points"] = r"""
WITH f AS (SELECT DISTINCT regexp_replace(url, '^https?://', '') AS path FROM pages),
p(pattern_no, rx) AS (VALUES (1, '[^/]*\.example\.com/en/[^/]*'), (2, '[^/]*\.example\.org/[^/]*/[^/]*'), (3, 'blog\.[^/]*/[^/]*/[^/]*')),
m AS (SELECT path, string_split(path, '/')[2] AS lang, min(pattern_no) AS pattern_no FROM f JOIN p ON regexp_full_match(path, rx) GROUP BY path),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY pattern_no, path) AS queue_no FROM m)
SELECT lang, CAST(min(CASE WHEN string_split(path, '/')[-1] = 'index.html' OR path = 'index.html' OR ends_with(path, '/index.html') THEN queue_no END) AS BIGINT) AS resume_no
FROM q GROUP BY lang
"""

ORACLE["first_mismatches"] = f"""
SELECT * FROM ({ORACLE["reconcile_counts"]}) WHERE status <> 'ok' ORDER BY key LIMIT 10
"""

ORACLE["quoted_entries"] = """
SELECT CAST(page_id AS BIGINT) AS page_id, CAST(2 AS BIGINT) AS n, './' || url || '|seed/' || page_id || '_*.sql' AS entries FROM pages
"""

ORACLE["split_scope"] = f"""
SELECT CAST(user_id AS BIGINT) AS user_id, CAST(event_id AS BIGINT) AS event_id, {_V} > {_CUT} AS after_cutoff, 'fail' AS strict_policy
FROM events WHERE event_type = 'purchase'
"""

ORACLE["reassembled_stream"] = """
WITH c AS (SELECT c_custkey % 1200 AS k, c_custkey, c_name, c_mktsegment FROM customer),
q AS (SELECT chr(39) AS q),
l AS (
  SELECT 1 AS section, 0 AS k, 0 AS i, '-- Initial setup' AS line
  UNION ALL SELECT 1, 0, 1, 'SET session_replication_role = ' || q || 'replica' || q || ';' FROM q
  UNION ALL SELECT DISTINCT 2, k, -1, '' FROM c
  UNION ALL SELECT DISTINCT 2, k, 0, 'INSERT INTO public.t' || k || ' (c_custkey, c_name, c_mktsegment) VALUES' FROM c
  UNION ALL SELECT 2, k, c_custkey, chr(9) || '(' || c_custkey || ', ' || q || replace(c_name, q, q || q) || q || ', ' || q || replace(c_mktsegment, q, q || q) || q || ')'
                   || CASE WHEN c_custkey = max(c_custkey) OVER (PARTITION BY k) THEN ';' ELSE ',' END FROM c, q
  UNION ALL SELECT 3, -1, 0, '' WHERE EXISTS (SELECT 1 FROM c WHERE k % 100 = 7)
  UNION ALL SELECT 3, -1, 1, '-- Sequence values' WHERE EXISTS (SELECT 1 FROM c WHERE k % 100 = 7)
  UNION ALL SELECT DISTINCT 3, k, 0, 'SELECT pg_catalog.setval(' || q || 'public.t' || k || '_id_seq' || q || ', 1, true);' FROM c, q WHERE k % 100 = 7
  UNION ALL SELECT 4, 0, 0, '' UNION ALL SELECT 4, 0, 1, '-- Cleanup' UNION ALL SELECT 4, 0, 2, 'RESET ALL;')
SELECT CAST(row_number() OVER (ORDER BY section, k, i) AS BIGINT) AS line_no, line FROM l
"""

# the first line whose upper form differs: of a customer's key ending in 97, as the name has small letters
ORACLE["stream_text"] = ORACLE["reassembled_stream"].replace("SELECT CAST(row_number()", ", s AS (SELECT CAST(row_number()", 1) + r""")
SELECT copy, (SELECT count(*) FROM s) AS n_left, (SELECT count(*) FROM s) AS n_right, CASE copy WHEN 'changed' THEN d.n END AS first_diff_line,
       CASE WHEN copy = 'changed' AND d.n IS NOT NULL THEN 'mismatch' ELSE 'ok' END AS status
FROM (VALUES ('read'), ('changed')) v(copy),
     (SELECT min(line_no) AS n FROM s WHERE regexp_matches(line, '^\t\([0-9]*97, ') AND upper(line) <> line) d
"""

ORACLE["tree_difference"] = ORACLE["first_difference"]

_HALF = "CAST('0x' || substr(md5(line_no || ':' || line), {}, 15) AS BIGINT)"
ORACLE["digest_tree"] = f"""
WITH RECURSIVE o AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                  unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents),
e AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS line_no,
             replace(line, ' the ', ' teh ') AS line FROM o WHERE NOT starts_with(line, 'The')),
l AS (SELECT 'original' AS copy, doc_id, line_no, line FROM o UNION ALL SELECT 'edited', doc_id, line_no, line FROM e),
x AS (SELECT copy, doc_id, (line_no - 1) // 4 AS leaf, octet_length(encode(line)) AS n, {_HALF.format(1)} AS a, {_HALF.format(16)} AS b FROM l),
h AS (SELECT 0 AS level, 1::BIGINT AS span, max(leaf) AS top FROM x UNION ALL SELECT level + 1, span * 3, top // 3 FROM h WHERE top > 0)
SELECT copy, CAST(doc_id AS BIGINT) AS doc_id, CAST(level AS BIGINT) AS level, CAST(leaf // span AS BIGINT) AS block, count(*) AS n_lines,
       CAST(sum(n) AS BIGINT) AS n_bytes, bit_xor(a) AS a, bit_xor(b) AS b
FROM x, h GROUP BY ALL
"""

ORACLE["load_commits"] = """
WITH d AS (SELECT coalesce(source, '') AS path,
                  CAST('0x' || substr(md5(concat_ws(chr(31), doc_id, text, lang, n_chars)), 1, 8) AS BIGINT) AS h FROM documents),
f AS (SELECT path, count(*) AS n, sum(h) AS s, row_number() OVER (ORDER BY path) AS no FROM d GROUP BY path)
SELECT path, CAST(n AS BIGINT) AS rows, CAST(s AS BIGINT) AS checksum, CAST(CASE WHEN no <= (SELECT count(*) // 3 FROM f) THEN 1 ELSE 3 END AS BIGINT) AS wave, 'ok' AS status
FROM f
"""

ORACLE["stream_load"] = """
WITH d AS (SELECT coalesce(source, 'none') || '.sql' AS file_name, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
p AS (SELECT *, coalesce(sum(len(ls)) OVER (PARTITION BY file_name ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
l AS (SELECT file_name, unnest(list_transform(ls, lambda x, i: (before + i) || chr(31) || x)) AS t FROM p)
SELECT file_name, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CAST('0x' || substr(md5(t), 1, 8) AS BIGINT)) AS BIGINT) AS checksum, CAST(1 AS BIGINT) AS n_logged
FROM l GROUP BY file_name
"""

ORACLE["reset_outcome"] = f"""
WITH d AS ({ORACLE["deploy_phrase"]}),
o AS (SELECT user_id, CASE WHEN max(event_id) % 2 = 0 THEN 'reset' ELSE 'start' END AS mode,
        CASE WHEN count(*) FILTER (WHERE event_type = 'error') % 3 = 1 THEN 'failure' ELSE 'success' END AS status,
        count(*) % 5 AS step, 'load ' || max(event_type) AS step_label, 'first line|last version ' || max({_V}) AS error_lines,
        count(*) % 2 = 0 AS restored, min(event_id) % 2 = 0 AS applied_new FROM events GROUP BY user_id),
j AS (SELECT *, status = 'success' AS done, CASE mode WHEN 'reset' THEN 'Reset' ELSE 'Start' END AS verb FROM o JOIN d USING (user_id))
SELECT CAST(user_id AS BIGINT) AS user_id, mode, status,
       CASE WHEN done THEN verb || ' complete' ELSE verb || ' failed at step ' || step || ' (' || step_label || ')' END AS headline,
       CASE WHEN NOT done THEN error_lines END AS error_lines,
       CASE WHEN NOT done THEN CASE WHEN restored THEN 'scripts restored' ELSE 'scripts not restored' END END AS restore_note,
       last_deploy, pre_total + post_total AS n_scripts, pre_label, pre_total,
       CASE WHEN done THEN ran_during_rebuild ELSE concat_ws(' · ', nullif(ran_during_rebuild, ''), nullif(skipped_in_snapshot, '')) END AS pre_phrase,
       CASE WHEN done THEN skipped_in_snapshot END AS skipped_phrase, '> Jan 15' AS post_label, post_total,
       CASE WHEN done OR applied_new THEN applied_after WHEN post_total > 0 THEN 'not applied' ELSE '' END AS post_phrase
FROM j
"""

ORACLE["cutoff_report"] = f"""
WITH a AS (SELECT * FROM ({ORACLE["ledger_alignment"]}) WHERE user_id % 3 > 0),
s AS (SELECT user_id,
        max(' ' || {_V} || CASE WHEN event_id % 2 = 0 THEN 'z' ELSE '' END) FILTER (WHERE event_type = 'signup' AND value > 45) AS argument,
        CASE WHEN min(event_id) % 2 = 0 THEN 'staging' END AS env,
        max({_V}) FILTER (WHERE event_type = 'purchase' AND value < 5) AS env_config,
        min({_V}) FILTER (WHERE event_type = 'view') AS config FROM events GROUP BY user_id),
r AS (SELECT s.user_id, env, coalesce(trim(argument), latest_aligned, env_config, config) AS cutoff,
        CASE WHEN argument IS NOT NULL THEN 'argument' WHEN latest_aligned IS NOT NULL THEN 'linked' WHEN coalesce(env_config, config) IS NOT NULL THEN 'config' END AS source,
        latest_local, latest_remote, latest_aligned, a.user_id IS NULL AS unlinked FROM s LEFT JOIN a USING (user_id))
SELECT CAST(user_id AS BIGINT) AS user_id, cutoff, try_cast(cutoff AS BIGINT) AS cutoff_number, source,
       CASE source WHEN 'argument' THEN 'given as an argument' WHEN 'linked' THEN 'latest version on both sides' WHEN 'config' THEN 'configured fallback' END AS source_label,
       env, latest_local, latest_remote, latest_aligned, CASE WHEN unlinked THEN 'no ledger rows' END AS alignment_error,
       CASE WHEN cutoff IS NULL THEN 'no cutoff' WHEN ends_with(cutoff, 'z') THEN 'not a number' END AS cutoff_error
FROM r
"""

# what a mask leaves of the scripts' strings; a marker's match takes the line feed after it, and so the next line
_STRING_1, _STRING_2 = " " * len("'insert into x'"), " " * len("'it''s; drop table y'")
ORACLE["audit_report"] = f"""
WITH c AS (SELECT *, CASE event_type WHEN 'click' THEN 'schema' WHEN 'view' THEN 'data' WHEN 'purchase' THEN 'mixed' WHEN 'error' THEN 'unknown' ELSE 'data' END AS class,
        CASE event_type WHEN 'click' THEN 'schema' WHEN 'view' THEN 'data' END AS rec FROM events),
x AS (SELECT *,
        CASE event_type WHEN 'click' THEN [{{'pattern': 'CREATE TABLE', 'line': 1, 'snippet': 'CREATE TABLE public.t_' || event_id || ' (id bigint, note text DEFAULT {_STRING_1});'}}]
             WHEN 'purchase' THEN [{{'pattern': 'CREATE TABLE', 'line': 1, 'snippet': 'CREATE TABLE public.p_' || event_id || ' (id bigint);'}}] ELSE [] END AS ddl,
        CASE event_type WHEN 'view' THEN [{{'pattern': 'INSERT INTO', 'line': 2, 'snippet': 'INSERT INTO public.t VALUES (' || event_id || ', {_STRING_2});'}}]
             WHEN 'purchase' THEN [{{'pattern': 'INSERT INTO', 'line': 2, 'snippet': 'INSERT INTO public.p VALUES (1);'}}]
             WHEN 'signup' THEN [{{'pattern': 'UPDATE', 'line': 2, 'snippet': 'UPDATE public.users SET n = ' || event_id || ';'}}] ELSE [] END AS dml,
        CASE event_type WHEN 'signup' THEN [{{'pattern': '{DATA_MARKER}', 'line': 1, 'snippet': '-- {DATA_MARKER}' || chr(10) || 'UPDATE public.users SET n = ' || event_id || ';'}}] ELSE [] END AS marker FROM c)
SELECT CAST(user_id AS BIGINT) AS user_id, 1 AS section, CAST(event_id AS BIGINT) AS event_id, CAST(to_json({{
         'event_id': event_id, 'classification': class, 'source': CASE event_type WHEN 'signup' THEN 'marker' ELSE 'heuristic' END,
         'reasons': [CASE event_type WHEN 'click' THEN 'schema statements found' WHEN 'view' THEN 'data statements found'
                          WHEN 'purchase' THEN 'schema statements and data statements found' WHEN 'error' THEN 'no marker and no recognised statement'
                          ELSE 'marker -- {DATA_MARKER}' END],
         'recommendation': CASE event_type WHEN 'click' THEN 'add -- {SCHEMA_MARKER}' WHEN 'view' THEN 'add -- {DATA_MARKER}'
                                WHEN 'purchase' THEN 'split into schema-only and data-only scripts' WHEN 'error' THEN 'review manually' ELSE 'none' END,
         'recommended_marker': rec, 'has_data_marker': event_type = 'signup', 'has_schema_marker': false,
         'evidence': {{'ddl': ddl, 'dml': dml, 'marker': marker}}}}) AS VARCHAR) AS json FROM x
UNION ALL
SELECT CAST(user_id AS BIGINT), 0, NULL, CAST(to_json({{
         'metadata': {{'user_id': user_id, 'data_marker': '{DATA_MARKER}', 'schema_marker': '{SCHEMA_MARKER}', 'verbose': true}},
         'summary': {{'data': count(*) FILTER (WHERE class = 'data'), 'schema': count(*) FILTER (WHERE class = 'schema'), 'mixed': count(*) FILTER (WHERE class = 'mixed'),
                      'unknown': count(*) FILTER (WHERE class = 'unknown'), 'suggested_updates': count(rec)}}}}) AS VARCHAR) FROM x GROUP BY user_id
"""

ORACLE["sync_split"] = """
WITH s AS (SELECT count(*) AS n, count(DISTINCT s_suppkey // 50) AS g FROM supplier),
l AS (SELECT max(strftime(ts, '%Y%m%d%H%M%S')) FILTER (WHERE month(ts) < 2) IS NOT DISTINCT FROM max(strftime(ts, '%Y%m%d%H%M%S')) AS same FROM events WHERE event_type = 'view'),
r AS (SELECT 'gate' AS what, 'region.sql' AS target, 13 AS n_left, 13 AS n_right, 'ok' AS status
      UNION ALL SELECT 'gate', 'nation.sql', 33, CASE WHEN same THEN 33 ELSE 0 END, CASE WHEN same THEN 'ok' ELSE 'blocked' END FROM l
      UNION ALL SELECT 'gate', 'supplier.sql', 6 + 2 * g + n, 6 + 2 * g + n, 'ok' FROM s
      UNION ALL SELECT 'gate', 'customer.sql', 0, 0, 'no_dump' UNION ALL SELECT 'gate', 'part.sql', 0, 0, 'empty'
      UNION ALL SELECT 'rows', 'public.region', 5, 5, 'ok' UNION ALL SELECT 'statements', 'public.region', 1, 1, 'ok'
      UNION ALL SELECT 'rows', 'public.supplier', n, n, 'ok' FROM s UNION ALL SELECT 'statements', 'public.supplier', g, g, 'ok' FROM s
      UNION ALL SELECT 'rows', 'public.nation', 25, 25, 'ok' FROM l WHERE same UNION ALL SELECT 'statements', 'public.nation', 1, 1, 'ok' FROM l WHERE same
      UNION ALL SELECT 'sequence lines', NULL, 4 + 2 * same::INT, 4 + 2 * same::INT, 'ok' FROM l)
SELECT what, target, CAST(n_left AS BIGINT) AS n_left, CAST(n_right AS BIGINT) AS n_right, status FROM r
"""

ORACLE["script_corpus"] = """
WITH f AS (SELECT doc_id // 20 AS no, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) || chr(10) AS text FROM documents GROUP BY 1),
k AS (SELECT lpad(CAST(no AS VARCHAR), 8, '0') AS version, text FROM f WHERE no % 10 NOT IN (3, 4)),
bad AS (SELECT count(*) > 0 AS any_bad FROM f WHERE no % 10 IN (3, 4))
SELECT c.corpus_id, version || '_docs_1.sql' AS name, version, c.corpus_id = 'loose' AND any_bad AS strict_fails, md5(text) AS text_md5
FROM k, bad, (VALUES ('loose'), ('strict')) AS c(corpus_id)
"""

ORACLE["replay_stubs"] = f"""
SELECT CAST(event_id AS BIGINT) AS event_id,
       '-- skipped: ' || {_V} || '_' || event_id || '.sql' || chr(10) || '-- already contained in the snapshot taken at ' || {_CUT} || chr(10) || 'SELECT 1;' || chr(10) AS stub
FROM events WHERE event_type = 'view' AND {_V} <= {_CUT}
"""

ORACLE["many_patterns"] = r"""
WITH f AS (SELECT DISTINCT regexp_replace(url, '^https?://', '') AS path FROM pages),
a AS (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyz0123456789', '')) AS x, unnest(range(36)) AS i),
t(top, j) AS (VALUES ('com', 0), ('org', 1)),
p AS (SELECT 1 + b.i * 72 + a.i * 2 + j AS pattern_no, '[^/]*\.example\.' || top || '/' || a.x || b.x || '[^/]*' AS rx FROM a, a b, t WHERE b.i < 6
      UNION ALL SELECT 433 + a.i * 12 + b.i * 2 + j, '[^/]*\.example\.' || top || '/' || a.x || '[^/]*/' || b.x || '[^/]*' FROM a, a b, t WHERE b.i < 6
      UNION ALL VALUES (865, '[^/]*/[^/]*'), (866, '[^/]*/[^/]*/[^/]*')),
m AS (SELECT path, min(pattern_no) AS pattern_no FROM f JOIN p ON regexp_full_match(path, rx) GROUP BY path)
SELECT CAST(row_number() OVER (ORDER BY pattern_no, path) AS BIGINT) AS queue_no, CAST(pattern_no AS BIGINT) AS pattern_no,
       path, string_split(path, '/')[-1] AS base_name
FROM m
"""

ORACLE["redact_many"] = """
WITH a AS (SELECT string_split('abcdefghijklmnopqrstuvwxyz', '') AS x),
s AS (SELECT ['tion', 'tio'] || flatten(list_transform(x, lambda p: list_transform(x, lambda q: p || q || 'e'))) || ['d[', 'REDA', 'ACTED]s', 'the ', ']]'] AS l FROM a)
SELECT CAST(doc_id AS BIGINT) AS doc_id, list_reduce([text] || l, lambda t, c: replace(t, c, '[REDACTED]')) AS text FROM documents, s
"""
