"""Queries on the shape of causal graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import edges as E
from skein.operators import structure as S
from skein.plans.catalog import query
from skein.plans.oracle import DIRTY, NATIVE
from skein.plans.views import trace_dirty, trace_native


def rounded(df, places: int = 6):
    return df.select(
        *[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


# Recursive pieces shared by several twins.
DEPTHS = f"""WITH RECURSIVE {NATIVE},
lp(session_id, pos, d) AS (
  SELECT session_id, pos, 0 FROM deg WHERE in_degree = 0
  UNION
  SELECT lp.session_id, ne.cpos, lp.d + 1 FROM lp JOIN ne ON ne.session_id = lp.session_id AND ne.ppos = lp.pos),
dep AS (SELECT session_id, pos, max(d) AS depth FROM lp GROUP BY 1, 2)
"""

HEIGHTS = (
    DEPTHS
    + """,
hp(session_id, pos, h) AS (
  SELECT session_id, pos, 0 FROM deg WHERE fan_out = 0
  UNION
  SELECT hp.session_id, ne.ppos, hp.h + 1 FROM hp JOIN ne ON ne.session_id = hp.session_id AND ne.cpos = hp.pos),
hei AS (SELECT session_id, pos, max(h) AS height FROM hp GROUP BY 1, 2)
"""
)

ROOT_PAIRS = (
    HEIGHTS
    + """,
rp(session_id, root, pos) AS (
  SELECT session_id, pos, pos FROM deg WHERE in_degree = 0
  UNION
  SELECT rp.session_id, rp.root, ne.cpos FROM rp JOIN ne ON ne.session_id = rp.session_id AND ne.ppos = rp.pos)
"""
)

BRANCHES = f"""WITH RECURSIVE {NATIVE},
bs AS (
  SELECT session_id, pos, event_id FROM deg WHERE in_degree = 0
  UNION
  SELECT ne.session_id, ne.cpos, ne.child FROM ne JOIN deg ON deg.session_id = ne.session_id
     AND deg.pos = ne.ppos WHERE deg.fan_out > 1),
bp(session_id, start, pos) AS (
  SELECT session_id, pos, pos FROM bs
  UNION
  SELECT bp.session_id, bp.start, ne.cpos FROM bp JOIN ne ON ne.session_id = bp.session_id AND ne.ppos = bp.pos)
"""

STATS = (
    ROOT_PAIRS
    + """,
bas AS (
  SELECT session_id, count(*) AS event_count, count(DISTINCT tool_name) AS tool_count,
         CASE WHEN count(*) > 1 THEN (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 ELSE 0.0 END AS time_span_s
  FROM tn GROUP BY 1),
shp AS (
  SELECT deg.session_id, count(*) FILTER (in_degree = 0) AS root_count,
         count(*) FILTER (fan_out = 0) AS leaf_count, max(depth)::BIGINT AS max_depth,
         avg(depth) AS avg_depth, avg(fan_out) AS fan_out_avg, max(fan_out) AS fan_out_max,
         avg(CASE WHEN in_degree = 0 THEN height + 1 END) AS chain_length_avg,
         avg(CASE WHEN in_degree > 0 THEN 1.0 ELSE 0.0 END) AS link_ratio,
         count(*) FILTER (in_degree >= 2) AS multi_parent_count
  FROM deg JOIN dep USING (session_id, pos) JOIN hei USING (session_id, pos) GROUP BY 1),
st AS (SELECT * FROM bas JOIN shp USING (session_id))
"""
)


@query(
    "edges",
    f"WITH {NATIVE} SELECT session_id, child, parent, parent_idx, child_tool, parent_tool FROM ne",
)
def edges(spark, sf):
    return E.edges(trace_native(spark, sf)).select(
        "session_id", "child", "parent", "parent_idx", "child_tool", "parent_tool"
    )


@query("roots", f"WITH {NATIVE} SELECT session_id, event_id, tool_name FROM deg WHERE in_degree = 0")
def roots(spark, sf):
    return E.roots(trace_native(spark, sf))


@query("leaves", f"WITH {NATIVE} SELECT session_id, event_id, tool_name FROM deg WHERE fan_out = 0")
def leaves(spark, sf):
    return E.leaves(trace_native(spark, sf))


@query(
    "fan_out",
    f"WITH {NATIVE} SELECT session_id, round(avg(fan_out), 6) AS fan_out_avg, "
    "max(fan_out) AS fan_out_max FROM deg GROUP BY 1",
)
def fan_out(spark, sf):
    return rounded(E.fan_out(trace_native(spark, sf)))


@query(
    "fan_out_distribution",
    f"WITH {NATIVE} SELECT session_id, fan_out AS children, count(*) AS events FROM deg GROUP BY 1, 2",
)
def fan_out_distribution(spark, sf):
    return E.fan_out_distribution(trace_native(spark, sf))


@query(
    "graph_edges",
    f"""WITH {DIRTY}, li AS (
  SELECT session_id, event_id, tool_name, unnest(parents) AS parent,
         unnest(range(len(parents))) AS parent_idx FROM td)
SELECT li.session_id, li.event_id, li.tool_name, parent_idx, parent,
       coalesce(p.tool_name, '?') AS parent_tool
FROM li LEFT JOIN td p ON p.session_id = li.session_id AND p.event_id = li.parent
UNION ALL
SELECT session_id, event_id, tool_name, NULL, NULL, NULL FROM td WHERE len(parents) = 0""",
)
def graph_edges(spark, sf):
    return E.graph_edges(trace_dirty(spark, sf))


@query("branch_starts", BRANCHES + "SELECT session_id, event_id, pos FROM bs")
def branch_starts(spark, sf):
    return E.branch_starts(trace_native(spark, sf))


@query(
    "node_depths",
    DEPTHS + "SELECT session_id, event_id, depth FROM dep JOIN deg USING (session_id, pos)",
)
def node_depths(spark, sf):
    return S.node_depths(trace_native(spark, sf))


@query(
    "find_roots",
    ROOT_PAIRS
    + """SELECT session_id, event_id, tool_name, substr(tool_input, 1, 60) AS tool_input_preview,
       c - 1 AS downstream_count, height AS max_subtree_depth
FROM (SELECT session_id, root AS pos, count(*) AS c FROM rp GROUP BY 1, 2)
JOIN hei USING (session_id, pos) JOIN tn USING (session_id, pos)""",
)
def find_roots(spark, sf):
    return S.find_roots(trace_native(spark, sf))


STAT_COLS = """session_id, event_count, tool_count, root_count, leaf_count, max_depth,
round(avg_depth, 6) AS avg_depth, round(fan_out_avg, 6) AS fan_out_avg, fan_out_max,
round(chain_length_avg, 6) AS chain_length_avg, round(link_ratio, 6) AS link_ratio, multi_parent_count,
round(time_span_s, 6) AS time_span_s"""


@query("session_stats", STATS + f"SELECT {STAT_COLS} FROM st")
def session_stats(spark, sf):
    return rounded(S.session_stats(trace_native(spark, sf)))


@query(
    "tool_freq",
    f"WITH {NATIVE} SELECT session_id, tool_name, count(*) AS uses FROM tn GROUP BY 1, 2",
)
def tool_freq(spark, sf):
    return S.tool_freq(trace_native(spark, sf))


TOPOLOGY_CASE = """CASE WHEN root_count <= 2 AND max_depth / event_count > 0.3 AND round(fan_out_avg, 2) < 1.5 THEN 'dominant_chain'
WHEN root_count <= 3 AND fan_out_max >= 4 AND round(fan_out_avg, 2) >= 1.5 THEN 'fan_out_heavy'
WHEN multi_parent_count >= 3 AND multi_parent_count / event_count > 0.05 THEN 'collapsed_repair'
WHEN root_count >= 5 AND round(avg_depth, 2) < 3 THEN 'multi_root_exploration' ELSE 'mixed' END"""

SHAPE_CASE = """CASE WHEN root_count <= 2 AND max_depth > event_count * 0.3 THEN 'dominant chain'
WHEN root_count > 10 AND round(chain_length_avg, 2) < 20 THEN 'exploratory forest' ELSE 'mixed' END"""


@query(
    "topology_class",
    STATS + f"SELECT session_id, {TOPOLOGY_CASE} AS topology, {SHAPE_CASE} AS shape FROM st",
)
def topology_class(spark, sf):
    stats = S.session_stats(trace_native(spark, sf))
    return S.topology_shape(S.topology_class(stats)).select("session_id", "topology", "shape")


@query(
    "branch_density",
    DEPTHS
    + """SELECT session_id, round(coalesce(avg(fan_out) / nullif(avg(depth), 0), 0), 6) AS avg_branch_density,
round(coalesce(max(fan_out) / nullif(max(depth), 0), 0), 6) AS max_branch_density
FROM deg LEFT JOIN dep USING (session_id, pos) GROUP BY 1""",
)
def branch_density(spark, sf):
    return rounded(S.branch_density(trace_native(spark, sf)))


@query(
    "critical_path",
    HEIGHTS
    + """,
nx AS (
  SELECT ne.session_id, ne.ppos, min(ne.cpos) AS cpos FROM ne
  JOIN hei a ON a.session_id = ne.session_id AND a.pos = ne.ppos
  JOIN hei b ON b.session_id = ne.session_id AND b.pos = ne.cpos AND b.height = a.height - 1
  GROUP BY 1, 2),
r1 AS (
  SELECT session_id, pos, row_number() OVER (PARTITION BY session_id ORDER BY height DESC, pos) AS rn
  FROM hei JOIN deg USING (session_id, pos) WHERE in_degree = 0),
wk(session_id, step, pos) AS (
  SELECT session_id, 0, pos FROM r1 WHERE rn = 1
  UNION ALL
  SELECT wk.session_id, wk.step + 1, nx.cpos FROM wk JOIN nx ON nx.session_id = wk.session_id AND nx.ppos = wk.pos)
SELECT session_id, step, event_id, tool_name FROM wk JOIN tn USING (session_id, pos)""",
)
def critical_path(spark, sf):
    return S.critical_path(trace_native(spark, sf))


PIECES = f"""WITH RECURSIVE {NATIVE},
un AS (SELECT session_id, cpos AS a, ppos AS b FROM ne UNION SELECT session_id, ppos, cpos FROM ne),
cc(session_id, a, b) AS (
  SELECT session_id, pos, pos FROM tn
  UNION
  SELECT cc.session_id, cc.a, un.b FROM cc JOIN un ON un.session_id = cc.session_id AND un.a = cc.b),
lab AS (SELECT session_id, a AS pos, min(b) AS label FROM cc GROUP BY 1, 2)
"""


@query(
    "components",
    PIECES
    + """SELECT l.session_id, n.event_id AS component, count(*) AS size, count(*) FILTER (d.in_degree = 0) AS root_count
FROM lab l JOIN tn n ON n.session_id = l.session_id AND n.pos = l.label
JOIN deg d ON d.session_id = l.session_id AND d.pos = l.pos GROUP BY 1, 2""",
)
def components(spark, sf):
    return S.components(trace_native(spark, sf))


@query(
    "component_members",
    PIECES
    + """SELECT l.session_id, n.event_id AS component, m.event_id
FROM lab l JOIN tn n ON n.session_id = l.session_id AND n.pos = l.label
JOIN tn m ON m.session_id = l.session_id AND m.pos = l.pos""",
)
def component_members(spark, sf):
    return S.component_members(trace_native(spark, sf))


TREE = f"""WITH RECURSIVE {NATIVE},
tr(session_id, pos, parent_pos, depth) AS (
  SELECT session_id, pos, NULL::BIGINT, 0 FROM tn WHERE pp1 IS NULL
  UNION ALL
  SELECT tn.session_id, tn.pos, tn.pp1, tr.depth + 1 FROM tr JOIN tn ON tn.session_id = tr.session_id AND tn.pp1 = tr.pos)
"""


@query(
    "tree",
    TREE
    + """SELECT t.session_id, n.event_id, p.event_id AS parent, t.depth,
  row_number() OVER (PARTITION BY t.session_id, t.parent_pos ORDER BY t.pos) - 1 AS sibling
FROM tr t JOIN tn n USING (session_id, pos)
LEFT JOIN tn p ON p.session_id = t.session_id AND p.pos = t.parent_pos""",
)
def tree(spark, sf):
    return S.build_tree(trace_native(spark, sf))


@query(
    "compressed_runs",
    TREE
    + """,
kid AS (SELECT session_id, pp1 AS pos, count(*) AS kids FROM tn WHERE pp1 IS NOT NULL GROUP BY 1, 2),
mk AS (
  SELECT c.session_id, c.pos, c.pp1, c.event_id, c.tool_name, coalesce(k.kids, 0) AS sib,
         coalesce(k.kids = 1 AND p.tool_name = c.tool_name, false) AS merged
  FROM tn c LEFT JOIN tn p ON p.session_id = c.session_id AND p.pos = c.pp1
  LEFT JOIN kid k ON k.session_id = c.session_id AND k.pos = c.pp1),
rh(session_id, pos, head) AS (
  SELECT session_id, pos, pos FROM mk WHERE NOT merged
  UNION ALL
  SELECT mk.session_id, mk.pos, rh.head FROM rh JOIN mk ON mk.session_id = rh.session_id AND mk.pp1 = rh.pos AND mk.merged),
ru AS (SELECT session_id, head, count(*) AS n FROM rh GROUP BY 1, 2),
kp AS (SELECT ru.*, h.event_id, h.tool_name, n = 1 OR n >= 3 OR h.sib > 1 AS keep
       FROM ru JOIN mk h ON h.session_id = ru.session_id AND h.pos = ru.head)
SELECT session_id, event_id AS run_id, tool_name, n AS run_length FROM kp WHERE keep
UNION ALL
SELECT kp.session_id, mk.event_id, mk.tool_name, 1 FROM kp JOIN rh ON rh.session_id = kp.session_id AND rh.head = kp.head
JOIN mk ON mk.session_id = rh.session_id AND mk.pos = rh.pos WHERE NOT keep""",
)
def compressed_runs(spark, sf):
    return S.compress_tree(trace_native(spark, sf))


@query(
    "causal_chain",
    f"""WITH RECURSIVE {NATIVE},
ch(session_id, target, pos, d) AS (
  SELECT session_id, pos, pos, 0 FROM deg WHERE fan_out = 0
  UNION ALL
  SELECT ch.session_id, ch.target, tn.pp1, ch.d + 1 FROM ch JOIN tn ON tn.session_id = ch.session_id AND tn.pos = ch.pos
  WHERE tn.pp1 IS NOT NULL)
SELECT ch.session_id, t.event_id AS target, max(d) OVER (PARTITION BY ch.session_id, target) - d AS step,
       n.event_id, n.tool_name
FROM ch JOIN tn t ON t.session_id = ch.session_id AND t.pos = ch.target
JOIN tn n ON n.session_id = ch.session_id AND n.pos = ch.pos""",
)
def causal_chain(spark, sf):
    ev = trace_native(spark, sf)
    return S.causal_chain(ev, E.leaves(ev))


def _spread_sql(a: str, b: str, name: str) -> str:
    return f"""WITH RECURSIVE {NATIVE},
re(session_id, start, pos, d) AS (
  SELECT session_id, pos, pos, 0 FROM deg WHERE fan_out > 1
  UNION
  SELECT re.session_id, re.start, ne.{b}, re.d + 1 FROM re JOIN ne ON ne.session_id = re.session_id AND ne.{a} = re.pos)
SELECT re.session_id, s.event_id AS start, n.event_id AS {name}, min(d) AS distance
FROM re JOIN tn s ON s.session_id = re.session_id AND s.pos = re.start
JOIN tn n ON n.session_id = re.session_id AND n.pos = re.pos
WHERE d > 0 GROUP BY 1, 2, 3"""


@query("descendants", _spread_sql("ppos", "cpos", "descendant"))
def descendants(spark, sf):
    ev = trace_native(spark, sf)
    return S.descendants(ev, E.degrees(ev).filter("fan_out > 1"))


@query("ancestors", _spread_sql("cpos", "ppos", "ancestor"))
def ancestors(spark, sf):
    ev = trace_native(spark, sf)
    return S.ancestors(ev, E.degrees(ev).filter("fan_out > 1"))


@query(
    "branch_persistence",
    BRANCHES
    + """SELECT bp.session_id, s.event_id AS branch_id,
  round((epoch_us(max(n.ts)) - epoch_us(min(n.ts))) / 1000000.0, 6) AS lifespan, count(*) - 1 AS descendants
FROM bp JOIN tn s ON s.session_id = bp.session_id AND s.pos = bp.start
JOIN tn n ON n.session_id = bp.session_id AND n.pos = bp.pos GROUP BY 1, 2""",
)
def branch_persistence(spark, sf):
    return rounded(S.branch_persistence(trace_native(spark, sf)))


FRONTIER = (
    BRANCHES
    + """,
iv AS (SELECT session_id, start, min(pos) AS lo, max(pos) AS hi FROM bp GROUP BY 1, 2),
fw AS (SELECT n.session_id, n.event_id, n.pos, count(iv.start) AS width FROM tn n
       LEFT JOIN iv ON iv.session_id = n.session_id AND n.pos BETWEEN iv.lo AND iv.hi GROUP BY 1, 2, 3)
"""
)


@query("frontier_width", FRONTIER + "SELECT session_id, event_id, width FROM fw")
def frontier_width(spark, sf):
    return S.frontier_width(trace_native(spark, sf))


@query(
    "frontier_summary",
    FRONTIER
    + "SELECT session_id, max(width) AS max_width, round(avg(width), 6) AS avg_width FROM fw GROUP BY 1",
)
def frontier_summary(spark, sf):
    return rounded(S.frontier_summary(trace_native(spark, sf)))


@query(
    "branch_collapse",
    ROOT_PAIRS
    + """SELECT session_id, event_id, tool_name, c AS incoming_branches
FROM (SELECT session_id, pos, count(*) AS c FROM rp GROUP BY 1, 2 HAVING count(*) >= 2)
JOIN tn USING (session_id, pos)""",
)
def branch_collapse(spark, sf):
    return S.branch_collapse(trace_native(spark, sf))


@query(
    "branch_collapse_pairs",
    ROOT_PAIRS
    + """, mm AS (SELECT session_id, pos FROM rp GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT rp.session_id, n.event_id, r.event_id AS root_id FROM rp JOIN mm USING (session_id, pos)
JOIN tn n ON n.session_id = rp.session_id AND n.pos = rp.pos
JOIN tn r ON r.session_id = rp.session_id AND r.pos = rp.root""",
)
def branch_collapse_pairs(spark, sf):
    return S.branch_collapse_pairs(trace_native(spark, sf))


@query(
    "collapsed_sessions",
    ROOT_PAIRS
    + "SELECT DISTINCT session_id FROM (SELECT session_id, pos FROM rp GROUP BY 1, 2 HAVING count(*) >= 2)",
)
def collapsed_sessions(spark, sf):
    return S.collapsed_sessions(trace_native(spark, sf))
