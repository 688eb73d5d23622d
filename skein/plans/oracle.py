"""DuckDB twins of the views, as common table expressions to put before a query."""

from __future__ import annotations


def half_up(value: str, places: int) -> str:
    """SQL for a double rounded by its shortest decimal text, ties away from zero, as Spark rounds."""
    return f"round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38, 18)), {places})"


RAW = """
raw_ev AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(event_id AS VARCHAR) AS event_id,
         event_id AS seq, ts, value AS duration_ms, event_type, props,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos
  FROM events)
"""

FLAT = (
    RAW
    + """,
tf AS (
  SELECT session_id, event_id, seq, ts, duration_ms, pos,
         CASE event_type WHEN 'signup' THEN 'question' WHEN 'view' THEN 'read'
              WHEN 'click' THEN 'grep' WHEN 'purchase' THEN 'edit' WHEN 'error' THEN 'bash'
              ELSE event_type END AS tool_name, props AS tool_input, k
  FROM raw_ev)
"""
)

LINKED = (
    RAW
    + """,
link1 AS (
  SELECT *, CASE WHEN pos = 1 OR k % 9 = 0 THEN NULL
                 ELSE greatest(pos - 1 - k % 3, 1) END AS pp1
  FROM raw_ev),
link2 AS (
  SELECT *, CASE WHEN pp1 IS NOT NULL AND k % 5 = 0 AND pos - 2 - k % 4 >= 1
                      AND pos - 2 - k % 4 <> pp1 THEN pos - 2 - k % 4 END AS pp2
  FROM link1)
"""
)

NATIVE = (
    LINKED
    + """,
tn AS (SELECT session_id, event_id, seq, ts, duration_ms, pos, event_type AS tool_name,
              props AS tool_input, pp1, pp2, k FROM link2),
ne AS (
  SELECT c.session_id, c.pos AS cpos, p.pos AS ppos, c.event_id AS child, p.event_id AS parent,
         c.tool_name AS child_tool, p.tool_name AS parent_tool, 0 AS parent_idx
  FROM tn c JOIN tn p ON p.session_id = c.session_id AND p.pos = c.pp1
  UNION ALL
  SELECT c.session_id, c.pos, p.pos, c.event_id, p.event_id, c.tool_name, p.tool_name, 1
  FROM tn c JOIN tn p ON p.session_id = c.session_id AND p.pos = c.pp2),
deg AS (
  SELECT n.session_id, n.pos, n.event_id, n.tool_name, n.ts,
         coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) AS fan_out
  FROM tn n
  LEFT JOIN (SELECT session_id, cpos, count(*) c FROM ne GROUP BY 1, 2) i
    ON i.session_id = n.session_id AND i.cpos = n.pos
  LEFT JOIN (SELECT session_id, ppos, count(*) c FROM ne GROUP BY 1, 2) o
    ON o.session_id = n.session_id AND o.ppos = n.pos)
"""
)

DIRTY = (
    LINKED
    + """,
td AS (
  SELECT l.session_id, l.event_id, l.pos, l.ts, l.event_type AS tool_name, l.k,
         CASE WHEN l.k = 7 THEN ['ext_7'] WHEN l.k = 8 THEN ['root_8']
              WHEN l.k = 13 THEN [coalesce(n.nxt, 'ext_13')]
              ELSE list_filter([p1.event_id, p2.event_id], lambda x: x IS NOT NULL) END AS parents
  FROM link2 l
  LEFT JOIN (SELECT session_id, pos - 1 AS pos, event_id AS nxt FROM raw_ev) n
    ON n.session_id = l.session_id AND n.pos = l.pos
  LEFT JOIN raw_ev p1 ON p1.session_id = l.session_id AND p1.pos = l.pp1
  LEFT JOIN raw_ev p2 ON p2.session_id = l.session_id AND p2.pos = l.pp2),
dp AS (SELECT session_id, event_id, pos, unnest(parents) AS parent FROM td)
"""
)

META = """
sm AS (
  SELECT CAST(c_custkey AS VARCHAR) AS session_id,
         CASE WHEN c_custkey % 5 <> 0 THEN 'native' END AS data_origin,
         c_mktsegment AS runtime,
         (['bug_fix','feature_add','refactor','exploration','debug_test','doc_gen','migration',
           'project_init','review','unknown'])[c_nationkey % 10 + 1] AS task_type,
         CASE WHEN c_custkey % 7 = 0 THEN 'routed_prompt_intervention' ELSE 'real_work' END AS task_source,
         CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal >= 0 END AS success,
         c_custkey % 13 = 0 AS human_intervention
  FROM customer WHERE c_custkey IN (SELECT user_id FROM events))
"""
