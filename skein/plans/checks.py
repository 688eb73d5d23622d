"""Queries on integrity of event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import inference as C
from skein.operators import integrity as V
from skein.operators import structure as S
from skein.plans.catalog import query
from skein.plans.graphs import HEIGHTS, rounded
from skein.plans.oracle import DIRTY
from skein.plans.views import trace_dirty, trace_native

CYCLES = f"""WITH RECURSIVE {DIRTY},
de AS (SELECT c.session_id, c.event_id AS child, c.pos AS cpos, p.pos AS ppos
       FROM dp c JOIN td p ON p.session_id = c.session_id AND p.event_id = c.parent),
fwd AS (SELECT DISTINCT session_id FROM de WHERE ppos >= cpos),
cl(session_id, a, b) AS (
  SELECT session_id, cpos, ppos FROM de WHERE session_id IN (SELECT session_id FROM fwd)
  UNION
  SELECT cl.session_id, cl.a, de.ppos FROM cl JOIN de ON de.session_id = cl.session_id AND de.cpos = cl.b),
cyc AS (SELECT td.session_id, td.event_id, td.tool_name, td.pos FROM cl JOIN td ON td.session_id = cl.session_id AND td.pos = cl.a
        WHERE cl.a = cl.b),
brk AS (SELECT dp.session_id, dp.event_id, dp.parent FROM dp LEFT JOIN td p
          ON p.session_id = dp.session_id AND p.event_id = dp.parent
        WHERE p.event_id IS NULL AND NOT starts_with(dp.parent, 'root_')),
orp AS (SELECT dp.session_id, dp.event_id FROM dp LEFT JOIN td p
          ON p.session_id = dp.session_id AND p.event_id = dp.parent
        GROUP BY 1, 2 HAVING count(p.event_id) = 0)
"""

#: A reference closes a cycle if its event leads to that parent over events from itself on.
FORWARD = """,
fw AS (
  SELECT session_id, cpos AS a, cpos AS b FROM de WHERE ppos >= cpos
  UNION
  SELECT fw.session_id, fw.a, de.cpos FROM fw JOIN de ON de.session_id = fw.session_id AND de.ppos = fw.b AND de.cpos >= fw.a)
"""


@query("broken_refs", CYCLES + "SELECT session_id, event_id, parent FROM brk")
def broken_refs(spark, sf):
    return V.broken_refs(trace_dirty(spark, sf))


@query("orphans", CYCLES + "SELECT session_id, event_id FROM orp")
def orphans(spark, sf):
    return V.orphans(trace_dirty(spark, sf))


@query("cycle_nodes", CYCLES + "SELECT session_id, event_id, tool_name FROM cyc")
def cycle_nodes(spark, sf):
    return S.cycle_nodes(trace_dirty(spark, sf))


@query(
    "broken_cycles",
    CYCLES
    + FORWARD
    + """
SELECT de.session_id, count(DISTINCT (de.cpos, de.ppos)) AS dropped FROM de
JOIN fw ON fw.session_id = de.session_id AND fw.a = de.cpos AND fw.b = de.ppos WHERE de.ppos >= de.cpos GROUP BY 1""",
)
def broken_cycles(spark, sf):
    ev = trace_dirty(spark, sf)
    kept = S.break_cycles(ev)
    return (
        ev.select("session_id", F.size("parents").alias("n"))
        .unionByName(kept.select("session_id", (-F.size("parents")).alias("n")))
        .groupBy("session_id")
        .agg(F.sum("n").alias("dropped"))
        .filter("dropped > 0")
    )


@query(
    "closing_links",
    CYCLES.replace("WITH", "WITH RECURSIVE", 1).replace("RECURSIVE RECURSIVE", "RECURSIVE", 1)
    + """,
fw AS (  -- what an event leads to over events from itself on
  SELECT session_id, cpos AS a, cpos AS b FROM de WHERE ppos >= cpos
  UNION
  SELECT fw.session_id, fw.a, de.cpos FROM fw JOIN de ON de.session_id = fw.session_id AND de.ppos = fw.b AND de.cpos >= fw.a)
SELECT DISTINCT de.session_id, c.event_id, p.event_id AS parent FROM de
JOIN fw ON fw.session_id = de.session_id AND fw.a = de.cpos AND fw.b = de.ppos
JOIN td c ON c.session_id = de.session_id AND c.pos = de.cpos JOIN td p ON p.session_id = de.session_id AND p.pos = de.ppos
WHERE de.ppos >= de.cpos""",
)
def closing_links(spark, sf):
    return S.closing_links(trace_dirty(spark, sf))


@query(
    "duplicate_ids",
    """SELECT CAST(user_id AS VARCHAR) AS session_id, props AS event_id, count(*) AS copies
FROM events GROUP BY 1, 2 HAVING count(*) > 1""",
)
def duplicate_ids(spark, sf):
    return V.duplicate_ids(trace_native(spark, sf).withColumn("event_id", F.col("tool_input")))


@query(
    "bad_timestamps",
    """SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(event_id AS VARCHAR) AS event_id,
'not a time ' || event_type AS timestamp FROM events WHERE event_type = 'error'""",
)
def bad_timestamps(spark, sf):
    stamped = trace_native(spark, sf).withColumn(
        "timestamp",
        F.when(
            F.col("tool_name") == "error", F.concat(F.lit("not a time "), F.col("tool_name"))
        ).otherwise(F.col("timestamp")),
    )
    return V.bad_timestamps(stamped)


def raw_lines(spark, sf):
    """Event lines of a log in which some lines are cut off or lack fields."""
    k = F.regexp_extract("tool_input", "([0-9]+)", 1).cast("int")
    full = F.concat(
        F.lit('{"event_id": "'), F.col("event_id"), F.lit('", "tool_name": "'), F.col("tool_name"), F.lit('"}')
    )
    return trace_native(spark, sf).select(
        "session_id",
        F.col("pos").alias("line_no"),
        F.when(k == 3, F.expr("substring(event_id, 1, 1) || '{\"event_id\": '"))
        .when(k == 4, F.lit('{"event_id": "x"}'))
        .when(k == 5, F.lit("  "))
        .when(k == 6, F.lit("[1, 2]"))
        .otherwise(full)
        .alias("value"),
    )


ISSUES = """li AS (SELECT session_id, pos AS line_no,
  CASE WHEN k = 3 THEN 'malformed' WHEN k IN (4, 6) THEN 'schema' END AS issue FROM raw_ev WHERE k IN (3, 4, 6))"""


@query("line_issues", f"WITH {DIRTY}, {ISSUES} SELECT * FROM li")
def line_issues(spark, sf):
    return V.line_issues(raw_lines(spark, sf))


@query(
    "validate_sessions",
    CYCLES
    + f""", {ISSUES},
r AS (SELECT session_id, 'e' AS w FROM td UNION ALL SELECT session_id, 'b' FROM brk
      UNION ALL SELECT session_id, 'o' FROM orp UNION ALL SELECT session_id, 'c' FROM cyc
      UNION ALL SELECT session_id, CASE issue WHEN 'malformed' THEN 'm' ELSE 's' END FROM li)
SELECT session_id, count(*) FILTER (w = 'e') AS event_count, count(*) FILTER (w = 'b') AS broken_refs,
  count(*) FILTER (w = 'o') AS orphan_count, count(*) FILTER (w = 'c') AS cyclic_events,
  count(*) FILTER (w = 't') AS bad_timestamps, count(*) FILTER (w = 'm') AS malformed_lines,
  count(*) FILTER (w = 's') AS schema_errors, count(*) FILTER (w IN ('c', 'm', 's')) = 0 AS valid
FROM r GROUP BY 1""",
)
def validate_sessions(spark, sf):
    return V.validate_sessions(trace_dirty(spark, sf), raw_lines(spark, sf))


@query(
    "check_invariants",
    CYCLES
    + """,
nm AS (SELECT unnest(['unique_ids', 'acyclicity', 'local_references', 'root_definition']) AS "check"),
v AS (SELECT session_id, 'acyclicity' AS "check" FROM cyc UNION ALL SELECT session_id, 'local_references' FROM brk)
SELECT s.session_id, nm."check", count(v.session_id) AS violations, count(v.session_id) = 0 AS valid
FROM (SELECT DISTINCT session_id FROM td) s CROSS JOIN nm
LEFT JOIN v ON v.session_id = s.session_id AND v."check" = nm."check" GROUP BY 1, 2""",
)
def check_invariants(spark, sf):
    return V.check_invariants(trace_dirty(spark, sf))


@query(
    "causal_quality",
    HEIGHTS
    + """SELECT session_id, count(*) AS total_events, count(pp1) AS linked_events,
 count(*) - count(pp1) AS root_events, count(pp2) AS multi_parent_events,
 max(CASE WHEN pp1 IS NULL THEN height END) AS max_depth,
 round(avg(CASE WHEN pp1 IS NULL THEN height END), 6) AS avg_chain_length, 0 AS cyclic_events,
 round(least(1.0, 0.5 * count(pp1) / count(*) + 0.5 * least(1.0, max(CASE WHEN pp1 IS NULL THEN height END) / 20.0)), 6) AS score
FROM tn JOIN hei USING (session_id, pos) GROUP BY 1""",
)
def causal_quality(spark, sf):
    return rounded(C.causal_quality(trace_native(spark, sf)))


def _batches(spark, sf):
    """A stored half and an incoming batch that repeats part of it under new ids."""
    ev = trace_native(spark, sf)
    k = F.regexp_extract("tool_input", "([0-9]+)", 1).cast("int")
    stored = ev.filter(k % 2 == 0)

    def renamed(col):
        return F.transform(col, lambda p: F.concat(F.lit("n"), p))

    first = ev.filter(k % 3 != 0)
    again = ev.filter(k % 10 == 1)
    incoming = first.unionByName(
        again.withColumn("ingest_seq", F.col("ingest_seq") + 1_000_000_000_000)
        .withColumn("event_id", F.concat(F.lit("d"), F.col("event_id")))
    )
    incoming = (
        incoming.withColumn("event_id", F.concat(F.lit("n"), F.col("event_id")))
        .withColumn("parents", renamed(F.col("parents")))
        .withColumn("parent_event_id", F.nullif(F.array_join("parents", ","), F.lit("")))
    )
    return stored, incoming


UPSERT = f"""WITH {DIRTY},
nt AS (SELECT l.session_id, l.event_id, l.seq, l.k, l.event_type || chr(31) || l.props || chr(31) || CAST(l.ts AS VARCHAR) AS fp,
              list_filter([p1.event_id, p2.event_id], lambda x: x IS NOT NULL) AS ps
       FROM link2 l LEFT JOIN raw_ev p1 ON p1.session_id = l.session_id AND p1.pos = l.pp1
       LEFT JOIN raw_ev p2 ON p2.session_id = l.session_id AND p2.pos = l.pp2),
sto AS (SELECT * FROM nt WHERE k % 2 = 0),
inc AS (SELECT session_id, 'n' || event_id AS event_id, seq, fp, ps FROM nt WHERE k % 3 <> 0
        UNION ALL
        SELECT session_id, 'nd' || event_id, seq + 1000000000000, fp, ps FROM nt WHERE k % 10 = 1),
mp AS (
  SELECT i.*, s.event_id AS sid, min(i.seq) OVER (PARTITION BY i.session_id, i.fp) AS first_seq,
         first(i.event_id) OVER (PARTITION BY i.session_id, i.fp ORDER BY i.seq) AS first_id
  FROM inc i LEFT JOIN (SELECT session_id, fp, max(event_id) AS event_id FROM sto GROUP BY 1, 2) s
    ON s.session_id = i.session_id AND s.fp = i.fp),
mk AS (SELECT *, sid IS NULL AND seq = first_seq AS fresh, coalesce(sid, first_id) AS kept FROM mp)
"""


@query(
    "upsert_missing",
    UPSERT
    + """,
ps AS (SELECT session_id, event_id, seq, 'n' || unnest(ps) AS parent, unnest(range(len(ps))) AS idx FROM mk WHERE fresh),
rs AS (SELECT p.session_id, p.event_id, p.idx,
              coalesce(max(m.kept) FILTER (NOT m.fresh AND m.seq < p.seq), p.parent) AS parent
       FROM ps p LEFT JOIN mk m ON m.session_id = p.session_id AND m.event_id = p.parent
       GROUP BY p.session_id, p.event_id, p.idx, p.parent)
SELECT mk.session_id, mk.event_id, string_agg(rs.parent, ',' ORDER BY rs.idx) AS parent_event_id
FROM mk LEFT JOIN rs ON rs.session_id = mk.session_id AND rs.event_id = mk.event_id
WHERE fresh GROUP BY 1, 2""",
)
def upsert_missing(spark, sf):
    stored, incoming = _batches(spark, sf)
    return V.upsert_missing(stored, incoming).select("session_id", "event_id", "parent_event_id")


@query(
    "upsert_summary",
    UPSERT
    + """SELECT mk.session_id, count(*) AS incoming, count(*) FILTER (fresh) AS added,
count(*) FILTER (NOT fresh) AS skipped, coalesce(any_value(s.n), 0) AS existing
FROM mk LEFT JOIN (SELECT session_id, count(*) AS n FROM sto GROUP BY 1) s ON s.session_id = mk.session_id
GROUP BY 1""",
)
def upsert_summary(spark, sf):
    stored, incoming = _batches(spark, sf)
    return V.upsert_summary(stored, incoming)
