"""Queries on inferred links and on repeated patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import edges as E
from skein.operators import inference as C
from skein.operators import patterns as P
from skein.plans.catalog import query
from skein.plans.oracle import FLAT, NATIVE
from skein.plans.views import trace_flat, trace_native

# The literal look-back rule, written as SQL over the 20 events before each write.
INFER = (
    FLAT
    + """,
turns AS (
  SELECT *, sum(CASE WHEN tool_name = 'question' AND pos > 1 THEN 1 ELSE 0 END)
              OVER (PARTITION BY session_id ORDER BY pos) AS turn,
         sum(CASE WHEN tool_name = 'question' THEN 1 ELSE 0 END)
              OVER (PARTITION BY session_id ORDER BY pos) AS seg
  FROM tf),
seqp AS (
  SELECT *, CASE WHEN tool_name <> 'question'
                  AND lag(tool_name) OVER (PARTITION BY session_id ORDER BY pos) <> 'question'
                 THEN lag(event_id) OVER (PARTITION BY session_id ORDER BY pos) END AS seq_parent
  FROM turns),
back AS (
  SELECT w.session_id, w.event_id, w.pos, w.tool_name AS wt, w.seq_parent,
         r.event_id AS rid, r.pos AS rpos,
         CASE WHEN r.tool_name IN ('read', 'grep') THEN 1 ELSE 0 END AS is_read
  FROM seqp w JOIN seqp r ON r.session_id = w.session_id AND r.seg = w.seg
       AND r.pos < w.pos AND r.pos >= w.pos - 20 AND r.tool_name <> 'question'
  WHERE w.tool_name IN ('edit', 'bash')),
gapped AS (
  SELECT *, pos - rpos - 1
            - coalesce(max(CASE WHEN is_read = 1 THEN pos - rpos END)
                OVER (PARTITION BY session_id, pos ORDER BY rpos DESC
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap
  FROM back),
ok AS (
  SELECT *, max(CASE WHEN gap > 3 OR (gap = 3 AND is_read = 0) THEN 1 ELSE 0 END)
            OVER (PARTITION BY session_id, pos ORDER BY rpos DESC) AS stop
  FROM gapped),
picked AS (
  SELECT *, row_number() OVER (PARTITION BY session_id, pos ORDER BY rpos DESC) AS nth
  FROM ok WHERE is_read = 1 AND stop = 0),
fan AS (
  SELECT session_id, event_id, list(rid ORDER BY rpos DESC) AS reads, max(wt) AS wt
  FROM picked WHERE nth <= 5 GROUP BY 1, 2
  HAVING count(*) >= 2 OR max(wt) = 'bash'),
linked AS (
  SELECT s.session_id, s.event_id, s.pos, s.tool_name, s.turn, s.seq_parent,
         coalesce(f.reads, []) AS reads,
         CASE WHEN s.seq_parent IS NULL THEN coalesce(f.reads, [])
              ELSE list_concat([s.seq_parent], list_filter(coalesce(f.reads, []), lambda x: x <> s.seq_parent))
         END AS parents
  FROM seqp s LEFT JOIN fan f ON f.session_id = s.session_id AND f.event_id = s.event_id)
"""
)


@query(
    "turns",
    f"WITH {INFER} SELECT session_id, turn::BIGINT AS turn, count(*) AS events, min(pos) AS first_pos "
    "FROM linked GROUP BY 1, 2",
)
def turns(spark, sf):
    return (
        C.detect_turns(trace_flat(spark, sf))
        .groupBy("session_id", "turn")
        .agg(F.count("*").alias("events"), F.min("pos").alias("first_pos"))
    )


@query(
    "seq_links",
    f"WITH {INFER} SELECT session_id, event_id, seq_parent FROM linked WHERE seq_parent IS NOT NULL",
)
def seq_links(spark, sf):
    return (
        C.link_sequential(trace_flat(spark, sf))
        .filter("seq_parent IS NOT NULL")
        .select("session_id", "event_id", "seq_parent")
    )


@query(
    "fan_in_links",
    f"WITH {INFER} SELECT session_id, event_id, array_to_string(reads, ',') AS reads "
    "FROM linked WHERE len(reads) > 0",
)
def fan_in_links(spark, sf):
    return (
        C.detect_fan_in(trace_flat(spark, sf))
        .filter("size(fan_in) > 0")
        .select("session_id", "event_id", F.array_join("fan_in", ",").alias("reads"))
    )


@query(
    "infer_edges",
    f"WITH {INFER} SELECT session_id, event_id, "
    "nullif(array_to_string(parents, ','), '') AS parent_event_id FROM linked",
)
def infer_edges(spark, sf):
    return C.infer_relations(trace_flat(spark, sf)).select(
        "session_id", "event_id", "parent_event_id"
    )


@query(
    "subtask_links",
    f"""WITH {FLAT}, nx AS (
  SELECT session_id, event_id, pos,
         CASE WHEN tool_name = 'question' AND pos % 2 = 0 THEN 'invalid'
              WHEN tool_name = 'edit' THEN 'task' ELSE tool_name END AS tool_name
  FROM tf),
lg AS (SELECT *, lag(tool_name) OVER w AS pt, lag(event_id) OVER w AS pid FROM nx
       WINDOW w AS (PARTITION BY session_id ORDER BY pos))
SELECT session_id, event_id, pid AS task_parent FROM lg
WHERE pt = 'task' AND tool_name = 'invalid'""",
)
def subtask_links(spark, sf):
    renamed = trace_flat(spark, sf).withColumn(
        "tool_name",
        F.when((F.col("tool_name") == "question") & (F.col("pos") % 2 == 0), "invalid")
        .when(F.col("tool_name") == "edit", "task")
        .otherwise(F.col("tool_name")),
    )
    return (
        C.link_subtasks(C.link_lookback(renamed))
        .filter("task_parent IS NOT NULL")
        .select("session_id", "event_id", "task_parent")
    )


@query(
    "inferred_transitions",
    f"""WITH {INFER}, pe AS (SELECT session_id, tool_name, unnest(parents) AS pid FROM linked)
SELECT p.tool_name AS from_tool, c.tool_name AS to_tool, count(*) AS count
FROM pe c JOIN tf p ON p.session_id = c.session_id AND p.event_id = c.pid
GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 15""",
)
def inferred_transitions(spark, sf):
    return P.corpus_transitions(C.infer_relations(trace_flat(spark, sf)))


@query(
    "fidelity",
    f"""WITH {INFER},
link1 AS (
  SELECT *, CASE WHEN pos = 1 OR k % 9 = 0 THEN NULL ELSE greatest(pos - 1 - k % 3, 1) END AS pp1
  FROM raw_ev),
link2 AS (
  SELECT *, CASE WHEN pp1 IS NOT NULL AND k % 5 = 0 AND pos - 2 - k % 4 >= 1
                      AND pos - 2 - k % 4 <> pp1 THEN pos - 2 - k % 4 END AS pp2
  FROM link1),
nat AS (
  SELECT c.session_id, c.event_id AS child, p.event_id AS parent
  FROM link2 c JOIN raw_ev p ON p.session_id = c.session_id AND p.pos IN (c.pp1, c.pp2)),
inf AS (SELECT DISTINCT session_id, event_id AS child, unnest(parents) AS parent FROM linked),
pairs AS (
  SELECT coalesce(n.session_id, i.session_id) AS session_id, coalesce(n.child, i.child) AS child,
         n.parent AS np, i.parent AS ip
  FROM nat n FULL JOIN inf i ON i.session_id = n.session_id AND i.child = n.child AND i.parent = n.parent),
ch AS (SELECT session_id, child, count(np) AS n, count(ip) AS i,
              count(*) FILTER (np IS NOT NULL AND ip IS NOT NULL) AS m FROM pairs GROUP BY 1, 2),
per AS (
  SELECT session_id, count(*) AS children_compared,
         count(*) FILTER (n = m AND i = m) AS ex, sum(n)::BIGINT AS native_edges,
         sum(i)::BIGINT AS inferred_edges, sum(m)::BIGINT AS matched_edges,
         count(*) FILTER (n > 1) AS fan_in_native, count(*) FILTER (i > 1) AS fan_in_claimed,
         count(*) FILTER (n > 1 AND n = m AND i = m) AS fan_in_reproduced
  FROM ch GROUP BY 1)
SELECT p.session_id, e.event_count, children_compared, native_edges, inferred_edges, matched_edges,
       fan_in_native, fan_in_claimed, fan_in_reproduced,
       round(ex / children_compared, 6) AS child_exact_agreement,
       round((native_edges - matched_edges) / native_edges, 6) AS missed_edge_rate,
       round((inferred_edges - matched_edges) / inferred_edges, 6) AS spurious_edge_rate,
       round(matched_edges / native_edges, 6) AS edge_recall,
       round(matched_edges / inferred_edges, 6) AS edge_precision,
       round(2 * matched_edges / (native_edges + inferred_edges), 6) AS edge_f1
FROM per p JOIN (SELECT session_id, count(*) AS event_count FROM raw_ev GROUP BY 1) e USING (session_id)
WHERE native_edges > 0""",
)
def fidelity(spark, sf):
    flat = trace_flat(spark, sf)
    native = trace_native(spark, sf).select("session_id", "event_id", "parents", "parent_event_id")
    both = flat.drop("parents", "parent_event_id").join(native, ["session_id", "event_id"])
    out = C.measure_fidelity(both)
    rates = [c for c, t in out.dtypes if t == "double"]
    return out.select(*[F.round(c, 6).alias(c) if c in rates else F.col(c) for c in out.columns])


@query(
    "transitions",
    f"""WITH {NATIVE}, c AS (
  SELECT session_id, parent_tool AS from_tool, child_tool AS to_tool, count(*) AS count
  FROM ne GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY count DESC, from_tool, to_tool) AS rank FROM c)
SELECT * FROM r WHERE rank <= 15""",
)
def transitions(spark, sf):
    return P.transitions(trace_native(spark, sf))


@query(
    "corpus_transitions",
    f"""WITH {NATIVE} SELECT parent_tool AS from_tool, child_tool AS to_tool, count(*) AS count
FROM ne GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 15""",
)
def corpus_transitions(spark, sf):
    return P.corpus_transitions(trace_native(spark, sf))


TRANS_COUNTS = f"""WITH {NATIVE}, c AS (
  SELECT session_id, parent_tool AS a, child_tool AS b, count(*) AS n FROM ne GROUP BY 1, 2, 3)"""


@query(
    "transition_entropy",
    f"""{TRANS_COUNTS}, t AS (SELECT *, n / sum(n) OVER (PARTITION BY session_id) AS p FROM c)
SELECT s.session_id, round(coalesce(-sum(p * log2(p)), 0.0), 6) AS transition_entropy
FROM (SELECT DISTINCT session_id FROM tn) s LEFT JOIN t USING (session_id) GROUP BY 1""",
)
def transition_entropy(spark, sf):
    return P.transition_entropy(trace_native(spark, sf)).withColumn(
        "transition_entropy", F.round("transition_entropy", 6)
    )


@query(
    "fan_in_points",
    f"""WITH {NATIVE} SELECT session_id, child AS event_id, child_tool AS tool_name,
count(*) AS parent_count, string_agg(parent_tool, ',' ORDER BY parent_idx) AS parent_tools
FROM ne GROUP BY 1, 2, 3 HAVING count(*) >= 2""",
)
def fan_in_points(spark, sf):
    return E.fan_in_points(trace_native(spark, sf))


def paths_sql(longest: int) -> str:
    return f"""WITH RECURSIVE {NATIVE},
walk(session_id, pos, pattern, len, ids) AS (
  SELECT session_id, cpos, parent_tool || '>' || child_tool, 2, [ppos, cpos] FROM ne
  UNION ALL
  SELECT w.session_id, ne.cpos, w.pattern || '>' || ne.child_tool, w.len + 1, list_append(w.ids, ne.cpos)
  FROM walk w JOIN ne ON ne.session_id = w.session_id AND ne.ppos = w.pos
  WHERE w.len < {longest} AND NOT list_contains(w.ids, ne.cpos)),
pc AS (SELECT session_id, pattern, len, count(*) AS occurrences FROM walk GROUP BY 1, 2, 3)
"""


@query(
    "repeated_paths",
    paths_sql(5)
    + "SELECT session_id, pattern, len AS length, occurrences FROM pc WHERE occurrences >= 2",
)
def repeated_paths(spark, sf):
    return P.repeated_paths(trace_native(spark, sf))


@query(
    "path_reuse",
    paths_sql(10)
    + """SELECT s.session_id, coalesce(sum(occurrences), 0)::BIGINT AS total_paths,
       count(pattern) AS unique_paths,
       round(CASE WHEN sum(occurrences) > 0 THEN 1 - count(pattern) / sum(occurrences) ELSE 0 END, 6) AS reuse_ratio
FROM (SELECT DISTINCT session_id FROM tn) s LEFT JOIN pc USING (session_id) GROUP BY 1""",
)
def path_reuse(spark, sf):
    return P.path_reuse_ratio(trace_native(spark, sf)).withColumn(
        "reuse_ratio", F.round("reuse_ratio", 6)
    )


RETRY_SQL = (
    paths_sql(5)
    + """, tc AS (SELECT session_id, parent_tool a, child_tool b, count(*) n FROM ne GROUP BY 1, 2, 3),
t AS (SELECT session_id, sum(n - 1) / sum(n) AS transition_repetition,
             sum(CASE WHEN a = b THEN n ELSE 0 END) / sum(n) AS local_loop_density FROM tc GROUP BY 1),
r AS (SELECT session_id, 1 - count(*) / sum(occurrences) AS path_reuse_ratio FROM pc GROUP BY 1),
rd AS (
SELECT s.session_id, coalesce(transition_repetition, 0) AS transition_repetition,
       coalesce(path_reuse_ratio, 0) AS path_reuse_ratio,
       coalesce(local_loop_density, 0) AS local_loop_density,
       (coalesce(transition_repetition, 0) + coalesce(path_reuse_ratio, 0) + coalesce(local_loop_density, 0)) / 3
         AS retry_density
FROM (SELECT DISTINCT session_id FROM tn) s LEFT JOIN t USING (session_id) LEFT JOIN r USING (session_id))
"""
)


@query(
    "retry_density",
    RETRY_SQL
    + """SELECT session_id, round(transition_repetition, 6) AS transition_repetition,
round(path_reuse_ratio, 6) AS path_reuse_ratio, round(local_loop_density, 6) AS local_loop_density,
round(retry_density, 6) AS retry_density FROM rd""",
)
def retry_density(spark, sf):
    out = P.retry_density(trace_native(spark, sf))
    return out.select("session_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])
