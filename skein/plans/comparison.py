"""Queries that set sessions side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import compare as P
from skein.operators import structure as S
from skein.operators.lineage import cut
from skein.plans.catalog import query
from skein.plans.causal import RETRY_SQL, TRANS_COUNTS
from skein.plans.corpora import after_views
from skein.plans.graphs import BRANCHES, FRONTIER, SHAPE_CASE, STATS, rounded
from skein.plans.labels import sidecar
from skein.plans.oracle import half_up
from skein.plans.views import trace_native


def neighbours_of(events):
    """Each session with the one that has the next number."""
    ids = events.select("session_id").distinct()
    nxt = ids.select(
        F.col("session_id").alias("b"),
        (F.col("session_id").cast("bigint") - 1).cast("string").alias("session_id"),
    )
    return ids.join(nxt, "session_id").select(F.col("session_id").alias("a"), "b")


PAIRS = """pr AS (SELECT x.session_id AS a, y.session_id AS b FROM (SELECT DISTINCT session_id FROM tn) x
JOIN (SELECT DISTINCT session_id FROM tn) y ON y.session_id::BIGINT = x.session_id::BIGINT + 1)"""


def _gap(c: str) -> str:
    return f"abs(x.{c} - y.{c}) / greatest(abs(x.{c}), abs(y.{c}), 1.0)"


@query(
    "topology_distance",
    STATS
    + f", {PAIRS} SELECT a, b, round(({' + '.join(_gap(c) for c in P.DISTANCE_STATS)}) / 7, 6) AS distance "
    "FROM pr JOIN st x ON x.session_id = a JOIN st y ON y.session_id = b",
)
def topology_distance(spark, sf):
    ev = cut(trace_native(spark, sf))
    return rounded(P.topology_distance(cut(S.session_stats(ev)), neighbours_of(ev)))


@query(
    "transition_divergence",
    TRANS_COUNTS
    + f""", {PAIRS},
sh AS (SELECT session_id, a AS f, b AS t, n / sum(n) OVER (PARTITION BY session_id) AS s FROM c),
u AS (SELECT pr.a, pr.b, sh.f, sh.t, sh.s AS x, 0 AS y FROM pr JOIN sh ON sh.session_id = pr.a
      UNION ALL SELECT pr.a, pr.b, sh.f, sh.t, 0, sh.s FROM pr JOIN sh ON sh.session_id = pr.b),
v AS (SELECT a, b, f, t, abs(sum(x) - sum(y)) AS d FROM u GROUP BY 1, 2, 3, 4)
SELECT a, b, round(sum(d) / 2, 6) AS divergence FROM v GROUP BY 1, 2""",
)
def transition_divergence(spark, sf):
    ev = cut(trace_native(spark, sf))
    return rounded(P.transition_divergence(ev, neighbours_of(ev)))


SUMMARY = (
    FRONTIER
    + ", "
    + after_views(RETRY_SQL, "walk(")
    + """,
bl AS (SELECT bp.session_id, bp.start, count(*) - 1 AS d, (epoch_us(max(n.ts)) - epoch_us(min(n.ts))) / 1000000.0 AS l
  FROM bp JOIN tn n ON n.session_id = bp.session_id AND n.pos = bp.pos GROUP BY 1, 2),
b1 AS (SELECT session_id, count(*) AS branch_count, avg(d) AS avg_descendants, max(l) AS max_lifespan FROM bl GROUP BY 1),
b2 AS (SELECT session_id, max(width) AS frontier_max, avg(width) AS frontier_avg FROM fw GROUP BY 1),
bsum AS (SELECT b1.*, frontier_max, frontier_avg, retry_density FROM b1 JOIN b2 USING (session_id) JOIN rd USING (session_id))
"""
)


@query(
    "branch_summary",
    SUMMARY
    + """SELECT session_id, branch_count, round(avg_descendants, 6) AS avg_descendants, round(max_lifespan, 6) AS max_lifespan,
frontier_max, round(frontier_avg, 6) AS frontier_avg, round(retry_density, 6) AS retry_density FROM bsum""",
)
def branch_summary(spark, sf):
    return rounded(P.branch_summary(cut(trace_native(spark, sf))))


_COUNTS = [
    *("event_count", "tool_count", "root_count", "leaf_count", "max_depth", "fan_out_max", "multi_parent_count"),
    *("branch_count", "frontier_max", "windows", "max_roots"),
]
_MEANS = [
    *("avg_depth", "fan_out_avg", "chain_length_avg", "link_ratio", "time_span_s", "avg_descendants", "max_lifespan"),
    *("frontier_avg", "retry_density", "avg_roots"),
]
_AS_TEXT = {m: f"{m}::VARCHAR" for m in _COUNTS} | {m: f"{half_up(f'{m}::DOUBLE', 4)}::DECIMAL(28, 4)::VARCHAR" for m in _MEANS} | {"shape": "shape"}


@query(
    "compare_sessions",
    STATS
    + ", "
    + after_views(BRANCHES, "bs AS")
    + ", "
    + after_views(SUMMARY, "iv AS").replace("t AS (SELECT session_id, sum(n - 1)", "tq AS (SELECT session_id, sum(n - 1)").replace("LEFT JOIN t USING", "LEFT JOIN tq USING")
    + f""", {PAIRS},
wr AS (SELECT session_id, (pos - 1) // 50 AS w, count(*) FILTER (pp1 IS NULL) AS c FROM tn GROUP BY 1, 2),
rs AS (SELECT session_id, count(*) AS windows, avg(c) AS avg_roots, max(c) AS max_roots FROM wr GROUP BY 1),
al AS (SELECT *, {SHAPE_CASE} AS shape FROM st JOIN bsum USING (session_id) JOIN rs USING (session_id)),
lm AS ({' UNION ALL '.join(f"SELECT session_id, '{m}' AS metric, {t} AS value FROM al" for m, t in _AS_TEXT.items())}),
ct AS (SELECT session_id, parent_tool AS f, child_tool AS t, count(*) AS n FROM ne GROUP BY 1, 2, 3),
cr AS (SELECT session_id, f || '->' || t AS metric, n::VARCHAR AS value FROM ct
       QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, f, t) <= 10),
rw AS (SELECT * FROM lm UNION ALL SELECT * FROM cr),
pa AS (SELECT pr.a, pr.b, metric, value FROM pr JOIN rw ON rw.session_id = pr.a),
pb AS (SELECT pr.a, pr.b, metric, value FROM pr JOIN rw ON rw.session_id = pr.b)
SELECT coalesce(pa.a, pb.a) AS a, coalesce(pa.b, pb.b) AS b, coalesce(pa.metric, pb.metric) AS metric,
 coalesce(pa.value, '0') AS value_a, coalesce(pb.value, '0') AS value_b, coalesce(pa.value, '0') <> coalesce(pb.value, '0') AS differs
FROM pa FULL JOIN pb ON pa.a = pb.a AND pa.b = pb.b AND pa.metric = pb.metric""",
)
def compare_sessions(spark, sf):
    ev = cut(trace_native(spark, sf))
    return P.compare_sessions(ev, neighbours_of(ev))


@query("session_report")
def session_report(spark, sf):
    ev = cut(trace_native(spark, sf))
    return P.session_report(ev, sidecar(spark, sf), window=20)
