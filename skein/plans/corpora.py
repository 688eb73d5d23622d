"""Queries on the corpus, its benchmarks and comparable subsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import corpus as K
from skein.operators import metadata as M
from skein.operators import subsets as X
from skein.operators import structure as S
from skein.operators.graph import TraceGraph
from skein.operators.lineage import cut, fresh_path
from skein.operators.manifests import FAN
from skein.plans.catalog import query
from skein.plans.causal import RETRY_SQL
from skein.plans.graphs import BRANCHES, FRONTIER, STATS, TOPOLOGY_CASE, rounded
from skein.plans.labels import LABELS, annotation, sidecar
from skein.plans.timing import attributed
from skein.plans.views import table
from skein.schema import METADATA_FIELDS


def records(spark, sf):
    """Structure, topology and effective metadata per session."""
    ev = cut(attributed(spark, sf))
    return cut(K.session_records(ev, sidecar(spark, sf), annotation(spark, sf)))


def after_views(cte: str, first: str) -> str:
    """The part of a WITH clause from expression ``first`` on."""
    return cte[cte.index(f"\n{first}") + 1 :]


REC = (
    STATS
    + ", "
    + LABELS
    + f""",
tp AS (SELECT *, {TOPOLOGY_CASE} AS topology FROM st),
rec AS (SELECT t.session_id, t.topology, t.event_count, e.data_origin, e.runtime, e.task_type, e.task_source, e.success,
        e.human_intervention, e.duration, e.intervention_lane, e.repo_language
        FROM tp t LEFT JOIN ef e USING (session_id))
"""
)

FEAT = (
    REC
    + ", "
    + after_views(BRANCHES, "bs AS")
    + ", "
    + after_views(FRONTIER, "iv AS")
    + ", "
    + after_views(RETRY_SQL, "walk(")
    .replace("tc AS (", "rtc AS (")
    .replace("FROM tc GROUP", "FROM rtc GROUP")
    .replace("t AS (SELECT session_id, sum(n - 1)", "rt_ AS (SELECT session_id, sum(n - 1)")
    .replace("LEFT JOIN t USING", "LEFT JOIN rt_ USING")
    .replace("r AS (SELECT session_id, 1 - count(*)", "rr AS (SELECT session_id, 1 - count(*)")
    .replace("LEFT JOIN r USING", "LEFT JOIN rr USING")
    + """,
co AS (SELECT DISTINCT session_id FROM (SELECT session_id, pos FROM rp GROUP BY 1, 2 HAVING count(*) >= 2)),
ft AS (
  SELECT t.*, b.branches, f.max_width, round(d.retry_density, 4) AS retry, co.session_id IS NOT NULL AS collapsed
  FROM tp t LEFT JOIN (SELECT session_id, count(*) AS branches FROM bs GROUP BY 1) b USING (session_id)
  LEFT JOIN (SELECT session_id, max(width) AS max_width FROM fw GROUP BY 1) f USING (session_id)
  LEFT JOIN rd d USING (session_id) LEFT JOIN co USING (session_id)),
tg0 AS (SELECT session_id, topology, list_filter([
   CASE WHEN topology = 'dominant_chain' AND max_depth >= 4 AND round(fan_out_avg, 2) < 1.5 THEN 'deep_linear' END,
   CASE WHEN topology = 'fan_out_heavy' OR fan_out_max >= 4 OR max_width >= 4 THEN 'branchy' END,
   CASE WHEN topology = 'collapsed_repair' OR collapsed THEN 'branch_collapse' END,
   CASE WHEN multi_parent_count > 0 THEN 'fan_in' END, CASE WHEN retry >= 0.2 THEN 'retry_heavy' END,
   CASE WHEN topology = 'multi_root_exploration' OR root_count >= 5 THEN 'multi_root_exploration' END,
   CASE WHEN event_count >= 100 THEN 'long_session' END], lambda x: x IS NOT NULL) AS tags FROM ft),
tx AS (SELECT session_id, topology, CASE WHEN len(tags) = 0 THEN [topology] ELSE tags END AS tags,
   coalesce(list_filter(['branch_collapse', 'fan_in', 'retry_heavy', 'multi_root_exploration', 'branchy', 'deep_linear', 'long_session'],
                        lambda p: list_contains(tags, p))[1], topology) AS primary_taxonomy FROM tg0)
"""
)

FACTS = (
    FEAT
    + """,
hr AS (SELECT session_id, arg_min(coalesce(a, p), pos) AS heuristic FROM (
   SELECT session_id, pos, CASE WHEN k % 4 = 0 THEN 'Agent-' || tool_name END AS a, CASE WHEN k % 3 = 0 THEN 'prov-' || (k % 2) END AS p FROM tn)
   WHERE coalesce(a, p) IS NOT NULL GROUP BY 1),
fb AS (
 SELECT f.*, s.session_id AS own, s.runtime, s.task_type AS st_, s.task_source AS ss_, s.success AS su_, s.duration AS du_, s.human_intervention AS hi_,
        e.task_type AS et, e.task_source AS es, e.noted, hr.heuristic
 FROM ft f LEFT JOIN sc s USING (session_id) LEFT JOIN ef e USING (session_id) LEFT JOIN hr USING (session_id)),
fr AS (
 SELECT 'session_count' AS fact, '' AS key, count(*) AS value FROM fb
 UNION ALL SELECT 'event_count', '', sum(event_count)::BIGINT FROM fb
 UNION ALL SELECT 'metadata_sessions', '', count(own) FROM fb
 UNION ALL SELECT 'annotated_sessions', '', count(noted) FROM fb
 UNION ALL SELECT 'research_grade_sessions', '', count(*) FILTER (runtime IS NOT NULL AND st_ IS NOT NULL AND ss_ IS NOT NULL AND su_ IS NOT NULL) FROM fb
 UNION ALL SELECT 'explicit_runtime_sessions', '', count(runtime) FROM fb
 UNION ALL SELECT 'heuristic_runtime_sessions', '', count(heuristic) FROM fb
 UNION ALL SELECT 'task_type_sessions', '', count(et) FROM fb
 UNION ALL SELECT 'source_sessions', '', count(es) FROM fb
 UNION ALL SELECT 'long_sessions_100', '', count(*) FILTER (event_count >= 100) FROM fb
 UNION ALL SELECT 'branchy_sessions', '', count(*) FILTER (branches > 1) FROM fb
 UNION ALL SELECT 'frontier_wide_sessions', '', count(*) FILTER (max_width >= 4) FROM fb
 UNION ALL SELECT 'retry_heavy_sessions', '', count(*) FILTER (retry >= 0.2) FROM fb
 UNION ALL SELECT 'fan_in_sessions', '', count(*) FILTER (multi_parent_count > 0) FROM fb
 UNION ALL SELECT 'branch_collapse_sessions', '', count(*) FILTER (collapsed) FROM fb
 UNION ALL SELECT 'multi_root_sessions', '', count(*) FILTER (root_count >= 5) FROM fb
 UNION ALL SELECT 'runtime_counts', runtime, count(*) FROM fb WHERE runtime IS NOT NULL GROUP BY 2
 UNION ALL SELECT 'heuristic_runtime_counts', heuristic, count(*) FROM fb WHERE heuristic IS NOT NULL GROUP BY 2
 UNION ALL SELECT 'task_type_counts', et, count(*) FROM fb WHERE et IS NOT NULL GROUP BY 2
 UNION ALL SELECT 'source_counts', es, count(*) FROM fb WHERE es IS NOT NULL GROUP BY 2
 UNION ALL SELECT 'topology_counts', topology, count(*) FROM fb GROUP BY 2
 UNION ALL SELECT 'structural_counts', x, count(*) FROM (SELECT unnest(list_filter([
     CASE WHEN multi_parent_count > 0 THEN 'fan_in' END, CASE WHEN collapsed THEN 'branch_collapse' END,
     CASE WHEN max_width >= 4 THEN 'frontier_width_ge_4' END, CASE WHEN retry >= 0.2 THEN 'retry_density_ge_0.2' END,
     CASE WHEN root_count >= 5 THEN 'multi_root_ge_5' END], lambda z: z IS NOT NULL)) AS x FROM fb) GROUP BY 2
 UNION ALL SELECT CASE WHEN g THEN 'explicit_metadata_field_counts' ELSE 'metadata_missing_counts' END, f, count(*) FROM (
   SELECT 'runtime' AS f, runtime IS NOT NULL AS g FROM fb UNION ALL SELECT 'model', false FROM fb
   UNION ALL SELECT 'task_type', st_ IS NOT NULL FROM fb UNION ALL SELECT 'task_source', ss_ IS NOT NULL FROM fb
   UNION ALL SELECT 'repo_language', false FROM fb UNION ALL SELECT 'repo_size', false FROM fb
   UNION ALL SELECT 'success', su_ IS NOT NULL FROM fb UNION ALL SELECT 'duration', du_ IS NOT NULL FROM fb
   UNION ALL SELECT 'human_intervention', hi_ IS NOT NULL FROM fb) GROUP BY 1, 2
 UNION ALL SELECT 'metadata_provenance_counts', source, count(*) FROM fl JOIN pv USING (session_id, field)
   WHERE r = 1 AND field NOT IN ('data_origin', 'intervention_lane', 'trace_tags') GROUP BY 2)
"""
)


def set_digest_sql(text: str) -> str:
    """DuckDB twin of ``set_digest`` over the texts of a group."""
    sums = ", ".join(f"sum(('0x' || substr(sha256({text}), {at}, 15))::BIGINT)::VARCHAR" for at in (1, 16, 31, 46))
    return f"sha256(concat_ws('/', count(*)::VARCHAR, {sums}))"


def _field_rows(source: str, part: str, fields: dict[str, str]) -> str:
    rows = ", ".join(
        f"({i}, sha256(coalesce('{name}=' || {sql}, '{name}-')))" for i, (name, sql) in enumerate(sorted(fields.items()), 1)
    )
    return f"SELECT session_id, '{part}' AS part, v.pos, v.leaf FROM {source}, (VALUES {rows}) v(pos, leaf)"


#: Fields of an event as its content text has them; ``-`` stands for null.
CONTENT = """cx AS (SELECT session_id, pos, concat_ws(chr(31), '=' || event_id, coalesce('=' || nullif(pe, ''), '-'), '=tool_call', '-', '=' || tool_name,
  '=' || tool_input, '-', '=' || t, coalesce('=' || m, '-'), coalesce('=' || p, '-'), coalesce('=' || a, '-'), coalesce('=' || duration_ms::VARCHAR, '-'), '=' || pos) AS t
  FROM (SELECT n.session_id, n.pos, n.event_id, n.duration_ms, concat_ws(',', p1.event_id, p2.event_id) AS pe, n.tool_name, n.tool_input,
    strftime(n.ts, '%Y-%m-%dT%H:%M:%S.%f') AS t, CASE WHEN n.k % 2 = 0 THEN 'm-' || (n.k % 5) END AS m,
    CASE WHEN n.k % 3 = 0 THEN 'prov-' || (n.k % 2) END AS p, CASE WHEN n.k % 4 = 0 THEN 'Agent-' || n.tool_name END AS a
    FROM tn n LEFT JOIN tn p1 ON p1.session_id = n.session_id AND p1.pos = n.pp1
    LEFT JOIN tn p2 ON p2.session_id = n.session_id AND p2.pos = n.pp2))"""

SIZES = """sz AS (
  SELECT session_id, sum(octet_length(encode(concat_ws(chr(31), event_id, coalesce(pe, ''), 'tool_call', '', tool_name, tool_input, '', t, m, p, a))) + 1)::BIGINT AS session_bytes
  FROM (SELECT n.session_id, n.event_id, concat_ws(',', p1.event_id, p2.event_id) AS pe, n.tool_name, n.tool_input,
        strftime(n.ts, '%Y-%m-%dT%H:%M:%S.%f') AS t, CASE WHEN n.k % 2 = 0 THEN 'm-' || (n.k % 5) ELSE '' END AS m,
        CASE WHEN n.k % 3 = 0 THEN 'prov-' || (n.k % 2) ELSE '' END AS p, CASE WHEN n.k % 4 = 0 THEN 'Agent-' || n.tool_name ELSE '' END AS a
        FROM tn n LEFT JOIN tn p1 ON p1.session_id = n.session_id AND p1.pos = n.pp1
        LEFT JOIN tn p2 ON p2.session_id = n.session_id AND p2.pos = n.pp2) GROUP BY 1)"""

SESSION_HASH = f"sh_ AS (SELECT session_id, {set_digest_sql('t')} AS session_hash FROM cx GROUP BY 1)"


@query(
    "session_records",
    f"""{REC}, {SIZES}, {CONTENT}, {SESSION_HASH}
SELECT session_id, session_hash, topology, event_count, runtime, task_type, task_source, success, repo_language, session_bytes
FROM rec JOIN sz USING (session_id) JOIN sh_ USING (session_id)""",
)
def session_records(spark, sf):
    return records(spark, sf).select(
        "session_id",
        "session_hash",
        "topology",
        "event_count",
        "runtime",
        "task_type",
        "task_source",
        "success",
        "repo_language",
        "session_bytes",
    )


_COUNTS = ("event_count", "tool_count", "root_count", "leaf_count", "max_depth", "fan_out_max", "multi_parent_count", "session_bytes")
_MEANS = ("avg_depth", "fan_out_avg", "chain_length_avg", "link_ratio", "time_span_s")
_STRUCTURE = {c: f"{c}::VARCHAR" for c in _COUNTS + _MEANS} | {"session_hash": "session_hash", "topology": "topology"}
_GIVEN = ("data_origin", "runtime", "task_type", "task_source", "success", "duration", "human_intervention", "intervention_lane", "repo_language")
_METADATA = {c: f"{c}::VARCHAR" if c in _GIVEN else "NULL::VARCHAR" for c in METADATA_FIELDS} | {
    "trace_tags": """'["' || tags || '"]'"""
}


def _level(source: str, at: str, leaf: str, rows: str) -> str:
    node = f"CASE WHEN count(*) = 1 THEN min({leaf}) ELSE sha256(string_agg({leaf}, '' ORDER BY {at})) END"
    place = f"({at} - 1) // {FAN}" if source == "lv" else f"{at} // {FAN}"
    return f"SELECT session_id, part, {place} AS up, {node} AS node, {rows}::BIGINT AS rows FROM {source} GROUP BY 1, 2, 3"


#: Three levels are enough for sessions of 4,096 events.
PARTS = f"""{REC}, {SIZES}, {CONTENT}, {SESSION_HASH},
wide AS (SELECT tp.*, session_bytes, session_hash FROM tp JOIN sz USING (session_id) JOIN sh_ USING (session_id)),
mfull AS (SELECT tp.session_id, ef.* EXCLUDE (session_id), sc.tags FROM tp LEFT JOIN ef USING (session_id) LEFT JOIN sc USING (session_id)),
lv AS (SELECT session_id, 'events' AS part, pos, sha256(t) AS leaf FROM cx
UNION ALL {_field_rows("wide", "structure", _STRUCTURE)}
UNION ALL {_field_rows("mfull", "metadata", _METADATA)}),
l1 AS ({_level("lv", "pos", "leaf", "count(*)")}),
l2 AS ({_level("l1", "up", "node", "sum(rows)")}),
l3 AS ({_level("l2", "up", "node", "sum(rows)")}),
parts AS (SELECT session_id, part, rows, sha256(rows || ':' || node) AS digest FROM l3)
"""


def _parts(spark, sf):
    ev = cut(attributed(spark, sf))
    return K.session_parts(ev, cut(K.session_records(ev, sidecar(spark, sf), annotation(spark, sf))))


@query("snapshot_parts", PARTS + "SELECT * FROM parts")
def snapshot_parts(spark, sf):
    """Roots of the hash trees over each session's events, structure and metadata."""
    return _parts(spark, sf)


def _features(spark, sf):
    return K.session_features(cut(attributed(spark, sf)))


def _labels(spark, sf):
    """Sidecars and annotations, written once as several tables are made from them."""
    return cut(sidecar(spark, sf)), cut(annotation(spark, sf))


def _facts(spark, sf, labels=None):
    own, noted = labels or _labels(spark, sf)
    ev = cut(attributed(spark, sf))
    features = cut(K.session_features(ev))
    return cut(K.corpus_facts(ev, own, noted, features))


@query("corpus_facts", FACTS + "SELECT * FROM fr")
def corpus_facts(spark, sf):
    return _facts(spark, sf)


def targets_sql(rules) -> str:
    parts = []
    for k, lab, t, f, m in rules:
        col, fact = ("total", f) if f else ("kinds", m)
        parts.append(
            f"SELECT '{k}' AS key, '{lab}' AS label, coalesce((SELECT {col} FROM cu WHERE fact = '{fact}'), 0) AS current, {t} AS target"
        )
    return (
        FACTS
        + ", cu AS (SELECT fact, sum(value)::BIGINT AS total, count(*) AS kinds FROM fr GROUP BY 1), ta AS ("
        + " UNION ALL ".join(parts)
        + ") "
    )


@query(
    "milestones",
    targets_sql(K.MILESTONES)
    + "SELECT key, label, current, target, greatest(target - current, 0) AS remaining FROM ta",
)
def milestones(spark, sf):
    return K.milestones(_facts(spark, sf))


@query(
    "readiness",
    targets_sql(K.READINESS)
    + "SELECT key, label, current, target, greatest(target - current, 0) AS remaining, current >= target AS passed FROM ta",
)
def readiness(spark, sf):
    return K.readiness(_facts(spark, sf))


@query(
    "taxonomy",
    FEAT + "SELECT session_id, topology, array_to_string(tags, ',') AS tags, primary_taxonomy FROM tx",
)
def taxonomy(spark, sf):
    return K.taxonomy(_features(spark, sf)).select(
        "session_id", "topology", F.array_join("tags", ",").alias("tags"), "primary_taxonomy"
    )


def _hints_sql() -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.LANE_HINTS.items())
    return f"CASE task_source {cases} ELSE '{K.NO_HINT}' END"


@query(
    "taxonomy_manifest",
    FEAT
    + """, ty AS (SELECT tx.*, e.runtime, e.task_type FROM tx LEFT JOIN ef e USING (session_id)),
tz AS (SELECT primary_taxonomy AS label, * EXCLUDE (primary_taxonomy) FROM ty UNION ALL SELECT '*', * EXCLUDE (primary_taxonomy) FROM ty)
SELECT label, 'sessions' AS section, '' AS key, count(*) AS value FROM tz GROUP BY 1
UNION ALL SELECT label, 'runtime', runtime, count(*) FROM tz WHERE runtime IS NOT NULL GROUP BY 1, 3
UNION ALL SELECT label, 'topology', topology, count(*) FROM tz GROUP BY 1, 3
UNION ALL SELECT label, 'task_type', task_type, count(*) FROM tz WHERE task_type IS NOT NULL GROUP BY 1, 3
UNION ALL SELECT label, 'tag', t, count(*) FROM (SELECT label, unnest(tags) AS t FROM tz) GROUP BY 1, 3""",
)
def taxonomy_manifest(spark, sf):
    rows = K.taxonomy(_features(spark, sf))
    meta = M.effective_metadata(sidecar(spark, sf), annotation(spark, sf))
    rows = rows.join(meta.select("session_id", "runtime", "task_type"), "session_id", "left")
    return K.taxonomy_manifest(rows)


@query(
    "source_facts",
    REC
    + f""",
sr AS (SELECT r.*, p.source FROM rec r LEFT JOIN (SELECT * FROM pv WHERE field = 'data_origin') p USING (session_id))
SELECT 'session_count' AS fact, '' AS key, count(*) AS value FROM sr
UNION ALL SELECT 'missing_data_origin', '', count(*) FROM sr WHERE data_origin IS NULL HAVING count(*) > 0
UNION ALL SELECT 'data_origin_counts', data_origin, count(*) FROM sr WHERE data_origin IS NOT NULL GROUP BY 2
UNION ALL SELECT 'data_origin_provenance_counts', coalesce(source, 'unknown'), count(*) FROM sr WHERE data_origin IS NOT NULL GROUP BY 2
UNION ALL SELECT 'task_source_counts', task_source, count(*) FROM sr WHERE task_source IS NOT NULL GROUP BY 2
UNION ALL SELECT 'lane_hint_counts', {_hints_sql()}, count(*) FROM sr WHERE task_source IS NOT NULL GROUP BY 2""",
)
def source_facts(spark, sf):
    prov = M.field_provenance(sidecar(spark, sf), annotation(spark, sf))
    return K.source_facts(records(spark, sf), prov)


@query(
    "missing_origin",
    REC
    + """SELECT session_id, runtime, task_type, task_source, success, topology,
(runtime IS NOT NULL)::INT + (task_type IS NOT NULL)::INT + (task_source IS NOT NULL)::INT + (success IS NOT NULL)::INT AS score
FROM rec WHERE data_origin IS NULL ORDER BY score DESC, session_id LIMIT 10""",
)
def missing_origin(spark, sf):
    return K.missing_origin(records(spark, sf))


@query(
    "group_sessions",
    REC + "SELECT coalesce(task_type, 'unknown') AS label, session_id FROM rec",
)
def group_sessions(spark, sf):
    return K.group_sessions(records(spark, sf))


BENCH = (
    REC
    + """, lb AS (SELECT *, coalesce(task_type, 'unknown') AS label FROM rec), lc AS (SELECT * FROM lb UNION ALL SELECT * REPLACE ('*' AS label) FROM lb),
bm AS (SELECT 'sessions' AS section, label, '' AS key, count(*) AS value FROM lc GROUP BY 2
UNION ALL SELECT 'runtime', label, runtime, count(*) FROM lc WHERE runtime IS NOT NULL GROUP BY 2, 3
UNION ALL SELECT 'topology', label, topology, count(*) FROM lc GROUP BY 2, 3)
"""
)


@query("benchmark_manifest", BENCH + "SELECT * FROM bm")
def benchmark_manifest(spark, sf):
    return K.benchmark_manifest(records(spark, sf))


@query(
    "benchmark_hash",
    BENCH
    + f""", bt AS (SELECT concat_ws(chr(31), section, label, key, value::VARCHAR) AS t FROM bm
UNION ALL SELECT concat_ws(chr(31), label, session_id) FROM lb)
SELECT {set_digest_sql("t")} AS benchmark_hash FROM bt""",
)
def benchmark_hash(spark, sf):
    rec = records(spark, sf)
    return K.benchmark_hash(K.benchmark_manifest(rec), K.group_sessions(rec))


@query(
    "verify_benchmark",
    REC
    + """, lb AS (SELECT session_id, coalesce(task_type, 'unknown') AS label, session_id::BIGINT % 10 AS k FROM rec),
me AS (SELECT * FROM lb WHERE k <> 0 UNION ALL SELECT * FROM lb WHERE k = 1)
SELECT 'group_size' AS "check", coalesce(a.label, b.label) AS subject, a.n AS expected, b.n AS actual
FROM (SELECT label, count(*) AS n FROM lb GROUP BY 1) a FULL JOIN (SELECT label, count(*) AS n FROM me GROUP BY 1) b ON a.label = b.label
WHERE a.n IS DISTINCT FROM b.n
UNION ALL SELECT 'duplicate_session', session_id, 1, count(*) FROM me GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT * FROM (SELECT 'total', '*', (SELECT count(*) FROM lb) AS e, (SELECT count(*) FROM me) AS a) WHERE e <> a""",
)
def verify_benchmark(spark, sf):
    rec = records(spark, sf)
    members = K.group_sessions(rec)
    k = F.col("session_id").cast("bigint") % 10
    tampered = members.filter(k != 0).unionByName(members.filter(k == 1))
    return K.verify_benchmark(K.benchmark_manifest(rec), tampered)


@query(
    "compare_benchmarks",
    REC
    + """, lb AS (SELECT *, coalesce(task_type, 'unknown') AS label, session_id::BIGINT AS k FROM rec),
ba AS (SELECT * FROM lb WHERE k % 3 <> 0), bb AS (SELECT * FROM lb WHERE k % 3 <> 1),
sd AS (SELECT CASE WHEN b.session_id IS NULL THEN 'only_a' WHEN a.session_id IS NULL THEN 'only_b' ELSE 'shared' END AS side
       FROM ba a FULL JOIN bb b ON a.session_id = b.session_id),
ld AS (SELECT CASE WHEN b.label IS NULL THEN 'only_a' WHEN a.label IS NULL THEN 'only_b' ELSE 'shared' END AS side
       FROM (SELECT DISTINCT label FROM ba) a FULL JOIN (SELECT DISTINCT label FROM bb) b ON a.label = b.label),
dr AS (SELECT 'runtime_distance' AS what, coalesce(a.s, 0) AS x, coalesce(b.s, 0) AS y FROM
   (SELECT runtime AS v, count(*) / (SELECT count(runtime) FROM ba) AS s FROM ba WHERE runtime IS NOT NULL GROUP BY 1) a FULL JOIN
   (SELECT runtime AS v, count(*) / (SELECT count(runtime) FROM bb) AS s FROM bb WHERE runtime IS NOT NULL GROUP BY 1) b ON a.v = b.v
 UNION ALL SELECT 'topology_distance', coalesce(a.s, 0), coalesce(b.s, 0) FROM
   (SELECT topology AS v, count(*) / (SELECT count(*) FROM ba) AS s FROM ba GROUP BY 1) a FULL JOIN
   (SELECT topology AS v, count(*) / (SELECT count(*) FROM bb) AS s FROM bb GROUP BY 1) b ON a.v = b.v)
SELECT 'sessions' AS what, side, count(*)::DOUBLE AS value FROM sd GROUP BY 2
UNION ALL SELECT 'labels', side, count(*)::DOUBLE FROM ld GROUP BY 2
UNION ALL SELECT what, '', round(sum(abs(x - y)) / 2, 4) FROM dr GROUP BY 1""",
)
def compare_benchmarks(spark, sf):
    rec = records(spark, sf)
    k = F.col("session_id").cast("bigint")
    a, b = rec.filter(k % 3 != 0), rec.filter(k % 3 != 1)  # every session is in one of them, a third in both
    return K.compare_benchmarks(
        K.benchmark_manifest(a), K.group_sessions(a), K.benchmark_manifest(b), K.group_sessions(b)
    )


AUDIT = (
    LABELS
    + """,
se AS (SELECT session_id, unnest(['runtime', 'task_type', 'task_source', 'success', 'model', 'repo_language', 'repo_size', 'duration', 'human_intervention']) AS field FROM ef),
au AS (SELECT se.*, p.source FROM se LEFT JOIN pv p USING (session_id, field)),
gp AS (SELECT session_id,
  coalesce(string_agg(field, ',' ORDER BY field) FILTER (source IS NULL AND field IN ('runtime', 'task_type', 'task_source', 'success')), '') AS missing_strict,
  '' AS untrusted_strict,
  coalesce(string_agg(field, ',' ORDER BY field) FILTER (source IS NULL AND field NOT IN ('runtime', 'task_type', 'task_source', 'success')), '') AS missing_optional,
  count(*) FILTER (source IS NULL AND field IN ('runtime', 'task_type', 'task_source', 'success')) AS n1,
  count(*) FILTER (source IS NULL) AS n FROM au GROUP BY 1)
"""
)


@query(
    "provenance_audit",
    f"WITH {AUDIT} SELECT field, coalesce(source, 'missing') AS source, count(*) AS sessions FROM au GROUP BY 1, 2",
)
def provenance_audit(spark, sf):
    own, noted = sidecar(spark, sf), annotation(spark, sf)
    return K.provenance_audit(M.effective_metadata(own, noted), M.field_provenance(own, noted))


@query(
    "near_misses",
    f"""WITH {AUDIT} SELECT session_id, missing_strict, untrusted_strict, missing_optional, n AS missing_total
FROM gp WHERE n1 > 0 ORDER BY n, n1, session_id LIMIT 10""",
)
def near_misses(spark, sf):
    own, noted = sidecar(spark, sf), annotation(spark, sf)
    return K.near_misses(M.effective_metadata(own, noted), M.field_provenance(own, noted))


@query(
    "research_grade",
    f"WITH {AUDIT} SELECT count(*) FILTER (n1 = 0) AS strict_research_grade_sessions, count(*) AS sessions FROM gp",
)
def research_grade(spark, sf):
    own, noted = sidecar(spark, sf), annotation(spark, sf)
    return K.research_grade(M.effective_metadata(own, noted), M.field_provenance(own, noted))


def _report_tables(spark, sf):
    own, noted = _labels(spark, sf)
    meta, prov = M.effective_metadata(own, noted), M.field_provenance(own, noted)
    return {
        "facts": _facts(spark, sf, (own, noted)),
        "near_misses": K.near_misses(meta, prov),
        "strict": K.research_grade(meta, prov),
        "audit": K.provenance_audit(meta, prov),
    }


@query("health_report")
def health_report(spark, sf):
    return K.corpus_report("health", **_report_tables(spark, sf))


@query("readiness_report")
def readiness_report(spark, sf):
    return K.corpus_report("readiness", **_report_tables(spark, sf))


@query("origin_report")
def origin_report(spark, sf):
    rec = records(spark, sf)
    prov = M.field_provenance(sidecar(spark, sf), annotation(spark, sf))
    return K.corpus_report(
        "origin", source_facts=K.source_facts(rec, prov), missing=K.missing_origin(rec)
    )


@query(
    "verify_snapshot",
    """SELECT CAST(user_id AS VARCHAR) AS subject, 'session hash mismatch' AS issue FROM events
WHERE event_type = 'signup' GROUP BY 1""",
)
def verify_snapshot(spark, sf):
    """A snapshot whose event files were altered after writing."""
    home = fresh_path(spark, "snapshot")
    K.snapshot(attributed(spark, sf), lambda ev: K.session_records(ev, sidecar(spark, sf), annotation(spark, sf)), home)
    changed = spark.read.parquet(f"{home}/events").withColumn(
        "tool_name",
        F.when(F.col("tool_name") == "signup", "signin").otherwise(F.col("tool_name")),
    )
    changed.write.parquet(f"{home}/altered/events")
    for part in ("records", "parts", "manifest"):
        spark.read.parquet(f"{home}/{part}").write.parquet(f"{home}/altered/{part}")
    return K.verify_snapshot(spark, f"{home}/altered")


@query(
    "verify_snapshot_edits",
    """SELECT CAST(user_id AS VARCHAR) AS subject,
CASE user_id % 6 WHEN 2 THEN 'missing session events' WHEN 3 THEN 'metadata mismatch' WHEN 4 THEN 'structure mismatch'
  ELSE 'session hash mismatch' END AS issue
FROM (SELECT user_id FROM events GROUP BY user_id HAVING count(*) > 1 OR user_id % 6 >= 2) WHERE user_id % 6 <> 5""",
)
def verify_snapshot_edits(spark, sf):
    """By session: a duration changed, two events swapped, all events gone, a task type changed, a count changed, nothing.

    Sessions of one event are left alone where the edit is to their events.
    """
    home = fresh_path(spark, "snapshot")
    K.snapshot(attributed(spark, sf), lambda ev: K.session_records(ev, sidecar(spark, sf), annotation(spark, sf)), home)
    kind, pos = F.col("session_id").cast("bigint") % 6, F.col("pos")
    stored, kept = spark.read.parquet(f"{home}/events"), spark.read.parquet(f"{home}/records")
    several = stored.groupBy("session_id").agg((F.count("*") > 1).alias("several"))
    edited = stored.join(several, "session_id").filter(kind != 2)
    duration = F.when((kind == 0) & (pos == 1) & F.col("several"), F.coalesce("duration_ms", F.lit(0.0)) + 1).otherwise(F.col("duration_ms"))
    swapped = F.when((kind == 1) & (pos <= 2) & F.col("several"), 3 - pos).otherwise(pos)
    edited.withColumns({"duration_ms": duration, "pos": swapped}).drop("several").write.parquet(f"{home}/altered/events")
    other = F.when(kind == 3, F.concat(F.coalesce("task_type", F.lit("")), F.lit("?"))).otherwise(F.col("task_type"))
    count = F.when(kind == 4, F.col("event_count") + 1).otherwise(F.col("event_count"))
    kept.withColumns({"task_type": other, "event_count": count}).write.parquet(f"{home}/altered/records")
    for part in ("parts", "manifest"):
        spark.read.parquet(f"{home}/{part}").write.parquet(f"{home}/altered/{part}")
    return K.verify_snapshot(spark, f"{home}/altered")


# -- subsets -----------------------------------------------------------------

UNITS = (
    REC
    + """,
un0 AS (SELECT session_id, coalesce(runtime, '') AS runtime, coalesce(task_type, '') AS task_type, coalesce(task_source, '') AS task_source,
   coalesce(data_origin, '') AS data_origin, coalesce(intervention_lane, '') AS intervention_lane, success, human_intervention, duration, topology, event_count FROM rec),
un AS (SELECT *, coalesce(human_intervention, false) OR intervention_lane NOT IN ('', 'direct_prompt_native')
   OR task_source IN ('routed_prompt_intervention', 'superpowers_workflow_intervention', 'controlled_prompt_morphology') AS iv,
   runtime <> '' AND task_type <> '' AND task_source <> '' AND success IS NOT NULL AS full4 FROM un0),
rk AS (SELECT session_id, row_number() OVER (PARTITION BY runtime ORDER BY session_id) AS nth,
   count(*) OVER (PARTITION BY runtime) AS cnt FROM un WHERE full4),
mb AS (
  SELECT *, 'strict_research_grade' AS subset_id, CASE WHEN NOT full4 THEN 'missing_required_metadata' END AS reason FROM un
  UNION ALL SELECT *, 'failure_enriched', CASE WHEN runtime = '' OR task_type = '' OR success IS NULL THEN 'missing_required_metadata'
     WHEN NOT (success = false OR coalesce(human_intervention, false)) THEN 'not_failure_or_near_failure' END FROM un
  UNION ALL SELECT *, 'intervention_lane', CASE WHEN runtime = '' OR task_type = '' OR task_source = '' THEN 'missing_required_metadata'
     WHEN NOT iv THEN 'not_intervention_lane' END FROM un
  UNION ALL SELECT un.*, 'balanced_cross_runtime', CASE WHEN NOT full4 THEN 'missing_required_metadata'
     WHEN nth > (SELECT min(cnt) FROM rk) THEN 'runtime_cap_excluded' END FROM un LEFT JOIN rk USING (session_id)),
ms AS (SELECT * FROM mb WHERE reason IS NULL),
dl AS (SELECT subset_id, 'runtime' AS dimension, runtime AS v FROM ms UNION ALL SELECT subset_id, 'task_type', task_type FROM ms
  UNION ALL SELECT subset_id, 'task_source', task_source FROM ms UNION ALL SELECT subset_id, 'data_origin', data_origin FROM ms
  UNION ALL SELECT subset_id, 'intervention_lane', intervention_lane FROM ms UNION ALL SELECT subset_id, 'topology', topology FROM ms),
ec AS (SELECT subset_id, dimension, v, count(*) AS n FROM dl WHERE v <> '' GROUP BY 1, 2, 3),
ep AS (SELECT *, n / sum(n) OVER (PARTITION BY subset_id, dimension) AS p FROM ec),
en AS (SELECT subset_id, dimension, CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END AS e FROM ep GROUP BY 1, 2),
cm AS (SELECT subset_id,
  round(avg(CASE subset_id WHEN 'failure_enriched' THEN ((runtime <> '')::INT + (task_type <> '')::INT + (success IS NOT NULL)::INT) / 3
     WHEN 'intervention_lane' THEN ((runtime <> '')::INT + (task_type <> '')::INT + (task_source <> '')::INT) / 3 ELSE full4::INT END), 4) AS metadata_completeness,
  round(least(count(*) FILTER (success = false) / count(*) / 0.1, 1), 4) AS failure_density,
  round(least(count(*) FILTER (iv) / count(*) / 0.1, 1), 4) AS intervention_density, 1.0::DOUBLE AS reproducibility, count(*) AS selected_count FROM ms GROUP BY 1),
cs AS (SELECT c.subset_id, metadata_completeness, failure_density, intervention_density, reproducibility, selected_count,
  round(coalesce(r.e, 0), 4) AS runtime_diversity, round(coalesce(t.e, 0), 4) AS task_variance, round(coalesce(o.e, 0), 4) AS topology_variance
  FROM cm c LEFT JOIN en r ON r.subset_id = c.subset_id AND r.dimension = 'runtime'
  LEFT JOIN en t ON t.subset_id = c.subset_id AND t.dimension = 'task_type' LEFT JOIN en o ON o.subset_id = c.subset_id AND o.dimension = 'topology'),
sc_ AS (SELECT *, round((metadata_completeness + failure_density + intervention_density + reproducibility + runtime_diversity + task_variance + topology_variance) / 7, 4) AS score FROM cs),
ga0 AS (SELECT m.subset_id, count(*) FILTER (m.reason IS NULL) AS current_sessions,
   CASE m.subset_id WHEN 'strict_research_grade' THEN 150 WHEN 'balanced_cross_runtime' THEN 20 WHEN 'failure_enriched' THEN 50 ELSE 15 END AS target_sessions
   FROM mb m GROUP BY 1),
ga AS (SELECT g.*, coalesce(s.score, 0) AS comparability_score, greatest(target_sessions - current_sessions, 0) AS missing_sessions,
   CASE WHEN target_sessions <= current_sessions THEN 'met' ELSE 'under_target' END AS status,
   CASE WHEN target_sessions <= current_sessions THEN 'none' WHEN (target_sessions - current_sessions) / target_sessions >= 0.75 THEN 'high'
        WHEN (target_sessions - current_sessions) / target_sessions >= 0.35 THEN 'medium' ELSE 'low' END AS severity
   FROM ga0 g LEFT JOIN sc_ s USING (subset_id))
"""
)


def units(spark, sf):
    return X.experimental_units(records(spark, sf))


def membership(spark, sf, rec=None):
    return cut(X.subset_membership(units(spark, sf) if rec is None else X.experimental_units(rec)))


@query("experimental_units", UNITS + "SELECT * FROM un0")
def experimental_units(spark, sf):
    return units(spark, sf)


def _subset_sql(name: str) -> str:
    return UNITS + f"SELECT subset_id, session_id, runtime, task_type FROM ms WHERE subset_id = '{name}'"


def _subset(spark, sf, name):
    return X.build_subset(units(spark, sf), name).select("subset_id", "session_id", "runtime", "task_type")


@query("subset_strict_research_grade", _subset_sql("strict_research_grade"))
def subset_strict(spark, sf):
    return _subset(spark, sf, "strict_research_grade")


@query("subset_failure_enriched", _subset_sql("failure_enriched"))
def subset_failure(spark, sf):
    return _subset(spark, sf, "failure_enriched")


@query("subset_intervention_lane", _subset_sql("intervention_lane"))
def subset_intervention(spark, sf):
    return _subset(spark, sf, "intervention_lane")


@query("subset_balanced_cross_runtime", _subset_sql("balanced_cross_runtime"))
def subset_balanced(spark, sf):
    return _subset(spark, sf, "balanced_cross_runtime")


@query(
    "subset_exclusions",
    UNITS + "SELECT subset_id, reason, count(*) AS sessions FROM mb WHERE reason IS NOT NULL GROUP BY 1, 2",
)
def subset_exclusions(spark, sf):
    return X.subset_exclusions(membership(spark, sf))


@query(
    "distributions",
    UNITS
    + "SELECT subset_id, dimension, CASE WHEN v = '' THEN 'unknown' ELSE v END AS value, count(*) AS sessions FROM dl GROUP BY 1, 2, 3",
)
def distributions(spark, sf):
    return X.distributions(membership(spark, sf).filter("reason IS NULL"))


@query("comparability", UNITS + "SELECT * EXCLUDE (selected_count) FROM sc_")
def comparability(spark, sf):
    return X.comparability(membership(spark, sf).filter("reason IS NULL"))


@query(
    "bias_register",
    UNITS
    + """,
bb AS (SELECT subset_id, count(*) AS a, count(*) FILTER (reason IS NULL) AS n, count(*) FILTER (reason IS NULL AND success = false) AS f,
  count(*) FILTER (reason IS NULL AND iv) AS h, count(*) FILTER (reason IS NULL AND (runtime = '' OR task_type = '' OR success IS NULL)) AS u,
  count(*) FILTER (reason IS NULL AND duration IS NULL) AS t FROM mb GROUP BY 1),
tops AS (SELECT subset_id, max(c) FILTER (dimension = 'runtime') AS r, max(c) FILTER (dimension = 'task_type') AS k
  FROM (SELECT subset_id, dimension, v, count(*) AS c FROM dl GROUP BY 1, 2, 3) GROUP BY 1),
bt AS (SELECT * FROM bb JOIN tops USING (subset_id))
SELECT subset_id, 'unlabeled_majority' AS flag, n < a AS present, n::DOUBLE AS value FROM bt
UNION ALL SELECT subset_id, 'failure_scarcity', f < 10, f FROM bt UNION ALL SELECT subset_id, 'intervention_scarcity', h < 10, h FROM bt
UNION ALL SELECT subset_id, 'runtime_imbalance', r / n > 0.6, round(r / n, 6) FROM bt UNION ALL SELECT subset_id, 'task_imbalance', k / n > 0.6, round(k / n, 6) FROM bt
UNION ALL SELECT subset_id, 'success_label_scarcity', u > 0, u FROM bt UNION ALL SELECT subset_id, 'duration_absence', t > 0, t FROM bt
UNION ALL SELECT subset_id, 'post_hoc_parsing', true, NULL FROM bt""",
)
def bias_register(spark, sf):
    return rounded(X.bias_register(membership(spark, sf)))


@query(
    "compile_subsets",
    UNITS
    + f""", mt AS (SELECT subset_id, concat_ws(chr(31), session_id, coalesce(reason, '+')) AS t FROM mb
UNION ALL SELECT subset_id, concat_ws(chr(31), dimension, coalesce(nullif(v, ''), 'unknown'), count(*)::VARCHAR) FROM dl
  GROUP BY subset_id, dimension, coalesce(nullif(v, ''), 'unknown')),
mh AS (SELECT subset_id, {set_digest_sql("t")} AS manifest_hash FROM mt GROUP BY 1)
SELECT subset_id, count(*) AS source_sessions, count(*) FILTER (reason IS NULL) AS selected_count,
count(reason) AS excluded_count, any_value(s.score) AS score, any_value(manifest_hash) AS manifest_hash
FROM mb JOIN sc_ s USING (subset_id) JOIN mh USING (subset_id) GROUP BY 1""",
)
def compile_subsets(spark, sf):
    return X.compile_subsets(membership(spark, sf)).select(
        "subset_id", "source_sessions", "selected_count", "excluded_count", "score", "manifest_hash"
    )


@query("analyze_gaps", UNITS + "SELECT * FROM ga")
def analyze_gaps(spark, sf):
    return X.analyze_gaps(membership(spark, sf))


def _share_values() -> str:
    rows = [
        f"('{s}', '{d}', '{label}', {w})"
        for s, dims in X.DISTRIBUTION_TARGETS.items()
        for d, labels in dims.items()
        for label, w in labels.items()
    ]
    return "(VALUES " + ", ".join(rows) + ") AS w(subset_id, dimension, label, share)"


@query(
    "plan_sampling",
    UNITS
    + f"""SELECT subset_id, dimension, label, share::DOUBLE AS share, missing_sessions AS required_sessions,
round(missing_sessions * share, 6)::DOUBLE AS wanted_sessions FROM ga JOIN {_share_values()} USING (subset_id)""",
)
def plan_sampling(spark, sf):
    return rounded(X.plan_sampling(X.analyze_gaps(membership(spark, sf))))


def _scenario_values() -> str:
    rows = [f"('{s}', {i}, '{n}')" for s, names in X.SCENARIOS.items() for i, n in enumerate(names)]
    return "(VALUES " + ", ".join(rows) + ") AS w(subset_id, ord, scenario_id)"


@query(
    "plan_scenarios",
    UNITS
    + f"SELECT subset_id, ord, scenario_id FROM ga JOIN {_scenario_values()} USING (subset_id) WHERE missing_sessions > 0",
)
def plan_scenarios(spark, sf):
    return X.plan_scenarios(X.analyze_gaps(membership(spark, sf)))


def plans(spark, sf):
    """One sampling plan per customer, some of them broken or alike."""
    k = F.col("c_custkey")
    subset = F.get(F.array(*[F.lit(s) for s in X.SUBSETS]), (k % 4).cast("int"))
    scenario = F.struct(
        F.lit("s1").alias("scenario_id"), (k % 6 != 0).alias("descriptor_only")
    )
    doc = F.struct(
        F.concat(F.lit("exp_"), k.cast("string")).alias("experiment_id"),
        subset.alias("target_subset"),
        (k % 97).alias("required_sessions"),
        F.when(k % 10 == 0, "local").otherwise("external_only").alias("execution_mode"),
        F.when(k % 15 == 0, False).otherwise(True).alias("must_not_execute"),
        F.lit("planned_not_observed").alias("evidence_status"),
        F.lit(0).alias("observed_session_count"),
        F.lit("none").alias("phase4_grade_effect"),
        F.array(scenario).alias("bde_scenarios"),
        F.when(k % 21 == 0, F.struct(F.struct(F.lit("ls").alias("shell")).alias("deep"))).alias("extra"),
        F.concat(F.lit('{"command": '), (k % 2).cast("string")).alias("note"),
        F.struct(F.struct(k.alias("run")).alias("of"), F.lit("ok").alias("state")).alias("validation"),
        F.when(k % 14 == 0, F.array(F.create_map(F.lit("cmd"), F.lit("a")), F.create_map(F.lit("shell"), F.lit("b")))).alias("steps"),
    )
    text = F.to_json(doc)
    escaped = F.concat(F.expr("left(plan, length(plan) - 1)"), F.lit(',"\\u0062ash":1}'))
    named = table(spark, sf, "customer").select(k.cast("string").alias("plan_id"), text.alias("plan"), k.alias("k"))
    return named.select("plan_id", F.when(F.col("k") % 26 == 0, escaped).otherwise(F.col("plan")).alias("plan"))


PLANS = """
pk AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS plan_id,
  (['strict_research_grade', 'balanced_cross_runtime', 'failure_enriched', 'intervention_lane'])[c_custkey % 4 + 1] AS subset_id,
  c_custkey % 97 AS required_sessions FROM customer),
li AS (SELECT plan_id, 'execution_mode must be external_only' AS issue FROM pk WHERE k % 10 = 0
  UNION ALL SELECT plan_id, 'must_not_execute must be true' FROM pk WHERE k % 15 = 0
  UNION ALL SELECT plan_id, 'scenario s1 must be descriptor_only' FROM pk WHERE k % 6 = 0
  UNION ALL SELECT plan_id, 'prohibited execution key: $.extra.deep.shell' FROM pk WHERE k % 21 = 0
  UNION ALL SELECT plan_id, 'prohibited execution key: $.steps' || unnest(['[0].cmd', '[1].shell']) FROM pk WHERE k % 14 = 0
  UNION ALL SELECT plan_id, 'prohibited execution key: $.bash' FROM pk WHERE k % 26 = 0)
"""


@query("lint_plans", f"WITH {PLANS} SELECT * FROM li")
def lint_plans(spark, sf):
    return X.lint_plans(plans(spark, sf))


@query(
    "validate_plans",
    UNITS
    + f""", {PLANS},
sg AS (SELECT *, count(*) OVER (PARTITION BY k % 4, k % 97, k % 10 = 0, k % 15 = 0, k % 6 = 0, k % 21 = 0, k % 2, k % 14 = 0, k % 26 = 0) - 1 AS duplicates FROM pk),
pv_ AS (SELECT s.plan_id, s.subset_id, s.required_sessions, g.missing_sessions, s.duplicates, coalesce(l.n, 0) AS issues,
   g.missing_sessions > 0 AND s.required_sessions > 0 AS sampling_needed
   FROM sg s JOIN ga g USING (subset_id) LEFT JOIN (SELECT plan_id, count(*) AS n FROM li GROUP BY 1) l USING (plan_id))
SELECT *, issues = 0 AND duplicates = 0 AND sampling_needed AS valid,
CASE WHEN issues = 0 AND duplicates = 0 AND sampling_needed THEN 'ready' WHEN duplicates > 0 THEN 'duplicate' ELSE 'not_needed' END AS status FROM pv_""",
)
def validate_plans(spark, sf):
    return X.validate_plans(plans(spark, sf), X.analyze_gaps(membership(spark, sf)))


def observations(spark, sf):
    """Observed sessions of four experiments, partly labelled, some with unusable ids."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.concat(F.lit("exp"), (k % 4).cast("string")).alias("experiment_id"),
        F.get(F.array(*[F.lit(s) for s in X.SUBSETS]), (k % 4).cast("int")).alias("target_subset"),
        F.when(k % 23 == 0, F.concat(F.lit("bad id "), k.cast("string")))
        .otherwise(k.cast("string"))
        .alias("session_id"),
        F.when(k % 5 == 0, "observed_runtime").alias("runtime"),
        F.when(k % 6 == 0, F.lit(False)).alias("success"),
    )


FEEDBACK = """
ob AS (SELECT 'exp' || (c_custkey % 4) AS experiment_id,
  (['strict_research_grade', 'balanced_cross_runtime', 'failure_enriched', 'intervention_lane'])[c_custkey % 4 + 1] AS target_subset,
  CASE WHEN c_custkey % 23 = 0 THEN 'bad id ' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS session_id,
  CASE WHEN c_custkey % 5 = 0 THEN 'observed_runtime' END AS runtime, CASE WHEN c_custkey % 6 = 0 THEN false END AS success, c_custkey % 23 <> 0 AS resolved FROM customer),
fe AS (SELECT o.experiment_id, o.target_subset, o.session_id, coalesce(o.runtime, r.runtime, '') AS runtime, coalesce(r.task_type, '') AS task_type,
  coalesce(r.task_source, '') AS task_source, coalesce(r.data_origin, '') AS data_origin, coalesce(r.intervention_lane, '') AS intervention_lane,
  coalesce(r.topology, CASE WHEN resolved THEN 'mixed' END, '') AS topology, coalesce(o.success, r.success) AS success, r.human_intervention,
  coalesce(r.event_count, 0) AS event_count, resolved FROM ob o LEFT JOIN rec r USING (session_id)),
fp AS (SELECT experiment_id, target_subset, count(*) AS observed_count, count(*) FILTER (resolved) AS resolved_count,
  coalesce(bool_or(success = false), false) AS has_failures,
  bool_or(coalesce(human_intervention, false) OR intervention_lane NOT IN ('', 'direct_prompt_native') OR task_source = 'routed_prompt_intervention') AS has_interventions,
  CASE target_subset WHEN 'strict_research_grade' THEN 150 WHEN 'balanced_cross_runtime' THEN 20 WHEN 'failure_enriched' THEN 50 ELSE 15 END AS target_sessions
  FROM fe GROUP BY 1, 2),
fq AS (SELECT experiment_id, target_subset, observed_count, resolved_count, round(resolved_count / observed_count, 4) AS resolved_ratio, has_failures, has_interventions,
  target_sessions, greatest(target_sessions - observed_count, 0) AS remaining_sessions, round(observed_count / target_sessions, 4) AS progress_ratio FROM fp)
"""


def feedback(spark, sf, rec=None):
    return X.ingest_feedback(observations(spark, sf), records(spark, sf) if rec is None else rec)


@query("ingest_feedback", UNITS + f", {FEEDBACK} SELECT * FROM fe")
def ingest_feedback(spark, sf):
    return feedback(spark, sf)


@query("feedback_report", UNITS + f", {FEEDBACK} SELECT * FROM fq")
def feedback_report(spark, sf):
    return X.feedback_report(feedback(spark, sf))


@query(
    "update_gaps",
    UNITS
    + f""", {FEEDBACK} SELECT experiment_id, target_subset, observed_count, remaining_sessions, current_sessions, missing_sessions,
CASE WHEN remaining_sessions = 0 THEN 'met' ELSE 'under_target' END AS status, CASE WHEN remaining_sessions > 0 THEN 'reprioritize' ELSE 'hold' END AS priority_hint
FROM fq JOIN ga ON ga.subset_id = fq.target_subset""",
)
def update_gaps(spark, sf):
    rec = records(spark, sf)
    report = X.feedback_report(feedback(spark, sf, rec))
    return X.update_gaps(report, X.analyze_gaps(membership(spark, sf, rec)))


@query(
    "reprioritize",
    UNITS
    + f""", {FEEDBACK} SELECT experiment_id, subset_id, current_sessions, ga.target_sessions, missing_sessions, severity,
missing_sessions + CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END
 + CASE WHEN subset_id = target_subset AND remaining_sessions > 0 THEN 1 ELSE 0 END AS priority_score, subset_id = target_subset AS feedback_target
FROM fq CROSS JOIN ga""",
)
def reprioritize(spark, sf):
    rec = records(spark, sf)
    report = X.feedback_report(feedback(spark, sf, rec))
    return X.reprioritize(X.analyze_gaps(membership(spark, sf, rec)), report)


_PART_TEXT = """concat_ws(chr(31), '{"digest":"' || digest || '"}', '{"part":"' || part || '"}', '{"rows":' || rows || '}', '{"session_id":"' || session_id || '"}')"""


@query("snapshot_digest", PARTS + f"SELECT {set_digest_sql(_PART_TEXT)} AS digest, count(*) AS rows FROM parts")
def snapshot_digest(spark, sf):
    """Digest of the parts of all sessions, independent of their order."""
    return K.manifest_digest(_parts(spark, sf))


@query("graph_profile", STATS.replace("st AS (SELECT * FROM bas JOIN shp USING (session_id))", "st AS (SELECT 1)")
    + """SELECT session_id, event_id, in_degree AS up, fan_out AS "out", depth AS level, height
FROM deg JOIN dep USING (session_id, pos) JOIN hei USING (session_id, pos)""")
def graph_profile(spark, sf):
    ev = attributed(spark, sf)
    g = TraceGraph(ev)
    names = S._ids(g).select("session_id", "pos", "event_id")
    return g.profile.join(names, ["session_id", "pos"]).drop("pos")
