"""Queries on windows, drift, durations and session comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import durations as D
from skein.operators import windows as W
from skein.plans.catalog import query
from skein.plans.graphs import rounded
from skein.plans.oracle import NATIVE, half_up
from skein.plans.views import trace_native

@query(
    "count_windows",
    f"""WITH {NATIVE}, x AS (
  SELECT *, unnest(range(greatest(0, CAST(floor((pos - 1 - 50) / 30.0) AS BIGINT) + 1),
                         CAST(floor((pos - 1) / 30.0) AS BIGINT) + 1)) AS w FROM tn)
SELECT session_id, w AS "window", count(*) AS events, min(pos) AS first_pos, max(pos) AS last_pos
FROM x GROUP BY 1, 2""",
)
def count_windows(spark, sf):
    return (
        W.count_windows(trace_native(spark, sf), 50, 20)
        .groupBy("session_id", "window")
        .agg(
            F.count("*").alias("events"),
            F.min("pos").alias("first_pos"),
            F.max("pos").alias("last_pos"),
        )
    )


@query(
    "time_windows",
    f"""WITH {NATIVE},
z AS (SELECT *, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY session_id) AS rel FROM tn),
x AS (SELECT *, unnest(range(greatest(0, CAST(floor((rel - 172800000000) / 86400000000.0) AS BIGINT) + 1),
                             CAST(floor(rel / 86400000000.0) AS BIGINT) + 1)) AS w FROM z),
g AS (SELECT session_id, w, count(*) AS events, min(pos) AS first_pos FROM x GROUP BY 1, 2)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY w) - 1 AS "window", events, first_pos FROM g""",
)
def time_windows(spark, sf):
    return (
        W.time_windows(trace_native(spark, sf), 172800, 86400)
        .groupBy("session_id", "window")
        .agg(F.count("*").alias("events"), F.min("pos").alias("first_pos"))
    )


@query(
    "root_spawning",
    f"""WITH {NATIVE} SELECT session_id, (pos - 1) // 50 AS "window", count(*) FILTER (pp1 IS NULL) AS root_count,
count(*) AS event_count FROM tn GROUP BY 1, 2""",
)
def root_spawning(spark, sf):
    return W.root_spawning(trace_native(spark, sf), 50)


@query(
    "root_spawning_summary",
    f"""WITH {NATIVE}, r AS (SELECT session_id, (pos - 1) // 20 AS w, count(*) FILTER (pp1 IS NULL) AS c FROM tn GROUP BY 1, 2)
SELECT session_id, count(*) AS windows, round(avg(c), 6) AS avg_roots, max(c) AS max_roots FROM r GROUP BY 1""",
)
def root_spawning_summary(spark, sf):
    return rounded(W.root_spawning_summary(trace_native(spark, sf), 20))


def window_sql(size: int) -> str:
    return f"""WITH RECURSIVE {NATIVE},
wn AS (SELECT *, (pos - 1) // {size} AS w FROM tn),
we AS (SELECT ne.*, (cpos - 1) // {size} AS w FROM ne WHERE (cpos - 1) // {size} = (ppos - 1) // {size}),
wd AS (SELECT n.session_id, n.w, n.pos, coalesce(i.c, 0) AS up, coalesce(o.c, 0) AS fo FROM wn n
  LEFT JOIN (SELECT session_id, cpos, count(*) c FROM we GROUP BY 1, 2) i ON i.session_id = n.session_id AND i.cpos = n.pos
  LEFT JOIN (SELECT session_id, ppos, count(*) c FROM we GROUP BY 1, 2) o ON o.session_id = n.session_id AND o.ppos = n.pos),
lp(session_id, pos, d) AS (
  SELECT session_id, pos, 0 FROM wd WHERE up = 0
  UNION SELECT lp.session_id, we.cpos, lp.d + 1 FROM lp JOIN we ON we.session_id = lp.session_id AND we.ppos = lp.pos),
dep AS (SELECT session_id, pos, max(d) AS depth FROM lp GROUP BY 1, 2),
bas AS (SELECT wd.session_id, wd.w, count(*) AS event_count, count(*) FILTER (up = 0) AS root_count,
   max(depth) AS max_depth, avg(depth) AS avg_depth,
   coalesce(avg(fo) / nullif(avg(depth), 0), 0) AS avg_branch_density,
   coalesce(max(fo) / nullif(max(depth), 0), 0) AS max_branch_density
   FROM wd JOIN dep USING (session_id, pos) GROUP BY 1, 2),
tc AS (SELECT session_id, w, parent_tool a, child_tool b, count(*) n FROM we GROUP BY 1, 2, 3, 4),
tp AS (SELECT *, n / sum(n) OVER (PARTITION BY session_id, w) AS p FROM tc),
en AS (SELECT session_id, w, -sum(p * log2(p)) AS e FROM tp GROUP BY 1, 2),
walk(session_id, w, pos, pattern, len) AS (
  SELECT session_id, w, cpos, parent_tool || '>' || child_tool, 2 FROM we
  UNION ALL
  SELECT k.session_id, k.w, we.cpos, k.pattern || '>' || we.child_tool, k.len + 1
  FROM walk k JOIN we ON we.session_id = k.session_id AND we.ppos = k.pos WHERE k.len < 10),
pc AS (SELECT session_id, w, pattern, count(*) AS c FROM walk GROUP BY 1, 2, 3),
ru AS (SELECT session_id, w, 1 - count(*) / sum(c) AS r FROM pc GROUP BY 1, 2),
wm AS (SELECT b.session_id, b.w AS "window", event_count, root_count, max_depth, avg_depth,
   coalesce(e, 0) AS transition_entropy, coalesce(r, 0) AS path_reuse_ratio, avg_branch_density, max_branch_density
   FROM bas b LEFT JOIN en ON en.session_id = b.session_id AND en.w = b.w
   LEFT JOIN ru ON ru.session_id = b.session_id AND ru.w = b.w)
"""


@query(
    "window_metrics",
    window_sql(20)
    + """SELECT session_id, "window", event_count, root_count, max_depth, round(avg_depth, 6) AS avg_depth,
round(transition_entropy, 6) AS transition_entropy, round(path_reuse_ratio, 6) AS path_reuse_ratio,
round(avg_branch_density, 6) AS avg_branch_density, round(max_branch_density, 6) AS max_branch_density FROM wm""",
)
def window_metrics(spark, sf):
    return rounded(W.window_metrics(trace_native(spark, sf), 20))


SHIFTING = ("transition_entropy", "path_reuse_ratio", "avg_branch_density")


@query(
    "topology_shift",
    window_sql(10)
    + f""",
lg AS (  -- in ten-thousandths, whole numbers
  SELECT session_id, "window", event_count, 'root_count' AS metric, CAST(root_count * 10000 AS HUGEINT) AS v FROM wm
  {' '.join(f"UNION ALL SELECT session_id, \"window\", event_count, '{m}', CAST({half_up(m, 4)} * 10000 AS HUGEINT) FROM wm" for m in SHIFTING)}),
sc AS (SELECT *, count(*) OVER x * v - sum(v) OVER x AS apart,
              count(*) OVER x * sum(v * v) OVER x - (sum(v) OVER x) * (sum(v) OVER x) AS spread
  FROM lg WINDOW x AS (PARTITION BY session_id, metric ORDER BY "window" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
zs AS (SELECT *, CASE WHEN spread > 0 THEN apart::DOUBLE / sqrt(spread::DOUBLE) END AS z FROM sc WHERE "window" >= 3)
SELECT session_id, "window", "window" * 10 AS event_index_start, "window" * 10 + event_count AS event_index_end, metric,
  {half_up('z', 4)}::DOUBLE AS z FROM zs WHERE abs(z) >= 2.0""",
)
def topology_shift(spark, sf):
    return rounded(W.topology_shift(trace_native(spark, sf), 10, 2.0), 4)


@query(
    "timeline_anomalies",
    f"""WITH {NATIVE}, m AS (SELECT session_id, count(duration_ms) n, avg(duration_ms) a, stddev_pop(duration_ms) s FROM tn GROUP BY 1)
SELECT tn.session_id, pos, event_id, tool_name, substr(tool_input, 1, 80) AS input_preview, duration_ms,
 n >= 3 AND duration_ms <> 0 AND duration_ms > a + 2 * s AS anomaly FROM tn JOIN m USING (session_id)""",
)
def timeline_anomalies(spark, sf):
    return D.timeline(trace_native(spark, sf))


@query(
    "replay_rows",
    f"""WITH {NATIVE} SELECT c.session_id, c.pos, c.event_id, c.tool_name, substr(c.tool_input, 1, 80) AS input_preview,
c.duration_ms, p.tool_name AS parent_tool, substr(p.tool_input, 1, 80) AS parent_input, NULL AS caused_by
FROM tn c LEFT JOIN tn p ON p.session_id = c.session_id AND p.pos = c.pp1 AND c.pp2 IS NULL""",
)
def replay_rows(spark, sf):
    return D.replay_rows(trace_native(spark, sf))


@query(
    "replay_summary",
    f"""WITH {NATIVE} SELECT session_id, tool_name, count(*) AS calls, round(sum(duration_ms) / 1000, 6) AS total_s
FROM tn GROUP BY 1, 2""",
)
def replay_summary(spark, sf):
    return rounded(D.replay_summary(trace_native(spark, sf)))


@query(
    "duration_profile",
    f"""WITH {NATIVE}, t AS (SELECT session_id, tool_name, count(*) AS calls, avg(duration_ms) AS tool_avg_ms FROM tn GROUP BY 1, 2),
s AS (SELECT session_id, avg(duration_ms) AS session_avg_ms, max(duration_ms) AS session_max_ms FROM tn GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY tool_avg_ms DESC, tool_name) AS rank FROM t)
SELECT session_id, tool_name, calls, round(tool_avg_ms, 8) AS tool_avg_ms, rank,
round(session_avg_ms, 8) AS session_avg_ms, session_max_ms FROM r JOIN s USING (session_id) WHERE rank <= 3""",
)
def duration_profile(spark, sf):
    return rounded(D.duration_profile(trace_native(spark, sf)), 8)


@query(
    "top_tools",
    f"""WITH {NATIVE}, t AS (SELECT session_id, tool_name, count(*) AS calls FROM tn GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY calls DESC, tool_name) AS rank FROM t QUALIFY rank <= 10""",
)
def top_tools(spark, sf):
    return D.top_tools(trace_native(spark, sf))


@query(
    "slow_calls",
    f"""WITH {NATIVE}, d AS (SELECT *, CAST({half_up('duration_ms', 6)} * 1000000 AS HUGEINT) AS ns FROM tn),
t AS (SELECT session_id, tool_name, sum(ns) AS s, count(ns) AS n FROM d GROUP BY 1, 2)
SELECT session_id, event_id, tool_name, duration_ms, {half_up('s::DOUBLE / (n * 1000000)::DOUBLE', 6)}::DOUBLE AS tool_avg_ms
FROM d JOIN t USING (session_id, tool_name) WHERE ns * n > 3 * s AND s > 5000000 * n::HUGEINT""",
)
def slow_calls(spark, sf):
    return rounded(D.slow_calls(trace_native(spark, sf), floor_ms=5.0))


def attributed(spark, sf):
    """Native trace with agent, provider and model names from the event kinds."""
    k = F.col("_k")
    return (
        trace_native(spark, sf)
        .withColumn("_k", F.regexp_extract("tool_input", "([0-9]+)", 1).cast("int"))
        .withColumn("agent", F.when(k % 4 == 0, F.concat(F.lit("Agent-"), F.col("tool_name"))))
        .withColumn("provider", F.when(k % 3 == 0, F.concat(F.lit("prov-"), (k % 2).cast("string"))))
        .withColumn("model", F.when(k % 2 == 0, F.concat(F.lit("m-"), (k % 5).cast("string"))))
        .drop("_k")
    )


ATTR = f"""WITH {NATIVE}, atr AS (SELECT *, CASE WHEN k % 4 = 0 THEN 'Agent-' || tool_name END AS agent,
CASE WHEN k % 3 = 0 THEN 'prov-' || (k % 2) END AS provider, CASE WHEN k % 2 = 0 THEN 'm-' || (k % 5) END AS model FROM tn)
"""


@query(
    "session_attribution",
    ATTR
    + """SELECT session_id, coalesce(string_agg(DISTINCT model, ',' ORDER BY model), '') AS models,
coalesce(string_agg(DISTINCT provider, ',' ORDER BY provider), '') AS providers,
coalesce(string_agg(DISTINCT agent, ',' ORDER BY agent), '') AS agents FROM atr GROUP BY 1""",
)
def session_attribution(spark, sf):
    return D.session_attribution(attributed(spark, sf))


@query(
    "list_sessions",
    ATTR
    + """SELECT session_id, count(*) AS event_count, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS duration_s,
coalesce(arg_min(coalesce(agent, provider), pos) FILTER (coalesce(agent, provider) IS NOT NULL), 'unknown') AS agent,
count(pp1) * 100 // count(*) AS linked_pct FROM atr GROUP BY 1""",
)
def list_sessions(spark, sf):
    return D.list_sessions(attributed(spark, sf))
