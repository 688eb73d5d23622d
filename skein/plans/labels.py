"""Queries on session labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import metadata as M
from skein.plans.catalog import query
from skein.plans.graphs import rounded
from skein.plans.oracle import META, NATIVE
from skein.plans.timing import ATTR, attributed
from skein.plans.views import session_meta, table, trace_native


def key():
    return F.col("session_id").cast("bigint")


def sidecar(spark, sf):
    """Explicit metadata of the sessions whose number is no multiple of four."""
    return (
        session_meta(spark, sf)
        .filter(key() % 4 != 0)
        .withColumn("duration", F.when(key() % 3 == 1, key().cast("double")))
        .withColumn(
            "intervention_lane", F.when(key() % 17 == 0, "superpowers_workflow_intervention")
        )
        .withColumn("runtime", F.when(key() % 9 != 0, F.col("runtime")))
        .withColumn("trace_tags", F.when(key() % 14 == 0, F.array(F.lit("prompt-routing"))))
    )


def annotation(spark, sf):
    """Manual labels of every third session."""
    return (
        session_meta(spark, sf)
        .filter(key() % 3 == 0)
        .select(
            "session_id",
            "task_type",
            F.lit("demo").alias("source"),
            F.when(key() % 2 == 0, True).alias("success"),
            F.lit("python").alias("repo_language"),
        )
    )


LABELS = (
    META
    + """,
sc AS (
  SELECT session_id, data_origin, CASE WHEN k % 9 <> 0 THEN runtime END AS runtime, task_type, task_source, success,
         human_intervention, CASE WHEN k % 3 = 1 THEN k::DOUBLE END AS duration,
         CASE WHEN k % 17 = 0 THEN 'superpowers_workflow_intervention' END AS intervention_lane,
         CASE WHEN k % 14 = 0 THEN 'prompt-routing' END AS tags
  FROM (SELECT *, session_id::BIGINT AS k FROM sm) WHERE k % 4 <> 0),
an AS (SELECT session_id, task_type, 'demo' AS task_source, CASE WHEN session_id::BIGINT % 2 = 0 THEN true END AS success,
              'python' AS repo_language FROM sm WHERE session_id::BIGINT % 3 = 0),
ef AS (
  SELECT coalesce(s.session_id, a.session_id) AS session_id, s.data_origin, s.runtime,
         coalesce(s.task_type, a.task_type) AS task_type, coalesce(s.task_source, a.task_source) AS task_source,
         coalesce(s.success, a.success) AS success, s.human_intervention, s.duration, s.intervention_lane,
         a.repo_language, s.session_id AS own, a.session_id AS noted
  FROM sc s FULL JOIN an a ON a.session_id = s.session_id),
fl AS (
  SELECT session_id, 'data_origin' AS field, 1 AS r FROM sc WHERE data_origin IS NOT NULL
  UNION ALL SELECT session_id, 'runtime', 1 FROM sc WHERE runtime IS NOT NULL
  UNION ALL SELECT session_id, 'task_type', 1 FROM sc WHERE task_type IS NOT NULL
  UNION ALL SELECT session_id, 'task_source', 1 FROM sc WHERE task_source IS NOT NULL
  UNION ALL SELECT session_id, 'success', 1 FROM sc WHERE success IS NOT NULL
  UNION ALL SELECT session_id, 'human_intervention', 1 FROM sc WHERE human_intervention IS NOT NULL
  UNION ALL SELECT session_id, 'duration', 1 FROM sc WHERE duration IS NOT NULL
  UNION ALL SELECT session_id, 'intervention_lane', 1 FROM sc WHERE intervention_lane IS NOT NULL
  UNION ALL SELECT session_id, 'trace_tags', 1 FROM sc WHERE tags IS NOT NULL
  UNION ALL SELECT session_id, 'task_type', 2 FROM an UNION ALL SELECT session_id, 'task_source', 2 FROM an
  UNION ALL SELECT session_id, 'success', 2 FROM an WHERE success IS NOT NULL
  UNION ALL SELECT session_id, 'repo_language', 2 FROM an),
pv AS (SELECT session_id, field, CASE min(r) WHEN 1 THEN 'explicit_sidecar' ELSE 'annotation' END AS source FROM fl GROUP BY 1, 2)
"""
)


@query(
    "validate_metadata",
    """SELECT CAST(c_custkey AS VARCHAR) AS session_id,
CASE WHEN c_mktsegment <> 'MACHINERY' THEN 'bug_fix' END AS task_type,
CASE c_nationkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS success,
CASE WHEN c_acctbal >= 0 AND c_nationkey % 5 <> 0 THEN c_acctbal END AS duration,
array_to_string(list_filter([
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'unknown task_type: MACHINERY' END,
  CASE WHEN c_nationkey % 4 IN (2, 3) THEN 'success must be a boolean' END,
  CASE WHEN c_nationkey % 5 = 0 THEN 'duration must be a number of seconds' END,
  CASE WHEN c_nationkey % 5 <> 0 AND c_acctbal < 0 THEN 'duration must be non-negative' END], lambda x: x IS NOT NULL), '; ') AS violations
FROM customer""",
)
def validate_metadata(spark, sf):
    word = F.get(F.array(*[F.lit(w) for w in ("Yes", "0", "maybe", "2")]), (F.col("c_nationkey") % 4).cast("int"))
    raw = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("session_id"),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.col("c_mktsegment"))
        .otherwise("bug_fix")
        .alias("task_type"),
        word.alias("success"),
        F.when(F.col("c_nationkey") % 5 == 0, "soon")
        .otherwise(F.col("c_acctbal").cast("string"))
        .alias("duration"),
    )
    return M.validate_metadata(raw).withColumn("violations", F.array_join("violations", "; "))


EFFECTIVE = (
    "session_id",
    "data_origin",
    "runtime",
    "task_type",
    "task_source",
    "success",
    "human_intervention",
    "duration",
    "intervention_lane",
    "repo_language",
)


@query("effective_metadata", f"WITH {LABELS} SELECT {', '.join(EFFECTIVE)} FROM ef")
def effective_metadata(spark, sf):
    return M.effective_metadata(sidecar(spark, sf), annotation(spark, sf)).select(*EFFECTIVE)


@query(
    "merge_metadata",
    f"""WITH {LABELS} SELECT session_id, coalesce(a.task_type, s.task_type) AS task_type,
coalesce(a.success, s.success) AS success, s.runtime, a.repo_language
FROM sc s FULL JOIN an a USING (session_id)""",
)
def merge_metadata(spark, sf):
    merged = M.merge_metadata(sidecar(spark, sf), annotation(spark, sf))
    return merged.select("session_id", "task_type", "success", "runtime", "repo_language")


@query("field_provenance", f"WITH {LABELS} SELECT * FROM pv")
def field_provenance(spark, sf):
    return M.field_provenance(sidecar(spark, sf), annotation(spark, sf))


def tagged(spark, sf):
    """Native trace where some inputs and outputs carry a tag block."""
    k = F.regexp_extract("tool_input", "([0-9]+)", 1).cast("int")
    block = F.concat(
        F.lit("note\ntrace_tags:\n  - "),
        F.when(k == 2, "prompt-pilot").when(k == 3, "routed-prompt").otherwise("other"),
        F.lit("\n  - extra\nintervention_lane: lane"),
        (k % 3).cast("string"),
        F.lit("\nevidence_level: strong\n"),
    )
    return (
        trace_native(spark, sf)
        .withColumn("tool_input", F.when(k.isin(2, 3), block).otherwise(F.col("tool_input")))
        .withColumn(
            "tool_output",
            F.when(k == 4, F.replace(F.concat(F.lit('{"a": "'), block, F.lit('"}')), F.lit("\n"), F.lit("\\n"))),
        )
    )


TAGS = f"""WITH {NATIVE}, tg AS (
  SELECT session_id, pos, k, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS rn FROM tn WHERE k IN (2, 3, 4)),
ft AS (SELECT session_id, CASE k WHEN 2 THEN 'prompt-pilot,extra' WHEN 3 THEN 'routed-prompt,extra' ELSE 'other,extra' END AS tags,
  'lane' || (k % 3) AS intervention_lane, 'strong' AS evidence_level, k FROM tg WHERE rn = 1)
"""


@query("detect_tags", TAGS + "SELECT session_id, tags, intervention_lane, evidence_level FROM ft")
def detect_tags(spark, sf):
    return M.detect_tags(tagged(spark, sf)).withColumn("tags", F.array_join("tags", ","))


@query(
    "auto_lane",
    TAGS
    + """SELECT session_id, CASE k WHEN 2 THEN 'controlled_prompt_morphology' ELSE 'routed_prompt_intervention' END AS task_source,
CASE k WHEN 2 THEN 'controlled_prompt_morphology' ELSE 'routed_prompt_intervention' END AS intervention_lane,
tags AS trace_tags, evidence_level AS intervention_evidence_level, 'auto-detected' AS intervention_evidence_source
FROM ft WHERE k <> 4""",
)
def auto_lane(spark, sf):
    return M.auto_lane_updates(tagged(spark, sf)).withColumn("trace_tags", F.array_join("trace_tags", ","))


@query(
    "unannotated",
    f"""WITH {LABELS} SELECT DISTINCT CAST(user_id AS VARCHAR) AS session_id FROM events
WHERE CAST(user_id AS VARCHAR) NOT IN (SELECT session_id FROM an)""",
)
def unannotated(spark, sf):
    sessions = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("session_id"))
    return M.unannotated(sessions, annotation(spark, sf))


@query(
    "lane_counts",
    f"""WITH {LABELS}, n AS (SELECT CAST(user_id AS VARCHAR) AS session_id, count(*) AS n FROM events GROUP BY 1)
SELECT CASE WHEN task_source = 'routed_prompt_intervention' THEN task_source
            WHEN data_origin = 'native' AND task_source = 'real_work' THEN 'direct_prompt_native' ELSE 'unlabeled' END AS lane,
count(*) AS sessions, coalesce(sum(n), 0)::BIGINT AS events FROM sc LEFT JOIN n USING (session_id) GROUP BY 1""",
)
def lane_counts(spark, sf):
    return M.lane_counts(sidecar(spark, sf), trace_native(spark, sf))


CLASSIFY = f"""WITH {LABELS}, cl AS (
  SELECT session_id, coalesce(data_origin, '') AS o, task_source AS s, runtime AS rt, tags FROM sc
  WHERE task_source <> 'routed_prompt_intervention' AND intervention_lane IS NULL),
pr AS (SELECT session_id, CASE WHEN o = 'native' AND tags IS NULL THEN 'direct_prompt_native' END AS proposed_lane,
  CASE WHEN o = 'native' AND tags IS NULL THEN 'high' END AS confidence,
  CASE WHEN o = 'native' AND tags IS NULL THEN 'native_real_work_unmarked' END AS evidence,
  CASE WHEN o = 'native' AND tags IS NOT NULL THEN 'marked'
       WHEN o <> 'native' THEN 'no_rule' END AS skip_reason,
  nullif(o, '') AS data_origin, s AS task_source, rt AS runtime
  FROM cl)
"""


@query("classify_unlabeled", CLASSIFY + "SELECT * FROM pr")
def classify_unlabeled(spark, sf):
    return M.classify_unlabeled(sidecar(spark, sf))


@query(
    "classify_summary",
    CLASSIFY
    + """SELECT a.n AS scanned, b.n AS unlabeled, b.p AS proposed, b.p AS applicable,
round((a.n - b.n) / a.n, 6) AS coverage_before, round((a.n - b.n + b.p) / a.n, 6) AS coverage_after
FROM (SELECT count(*) AS n FROM sc) a, (SELECT count(*) AS n, count(proposed_lane) AS p FROM pr) b""",
)
def classify_summary(spark, sf):
    return rounded(M.classify_summary(sidecar(spark, sf)))


@query(
    "gate_status",
    TAGS
    + f""", {LABELS},
h AS (SELECT DISTINCT session_id FROM tg)
SELECT l.lane, count(s.tags) AS tagged, count(h.session_id) AS event_hits, 5 AS required,
CASE WHEN count(s.tags) >= 5 THEN 'OPEN' ELSE 'BLOCKED' END AS gate
FROM (SELECT unnest(['routed_prompt_intervention', 'superpowers_workflow_intervention', 'controlled_prompt_morphology']) AS lane) l
LEFT JOIN sc s ON s.task_source = l.lane LEFT JOIN h ON h.session_id = s.session_id GROUP BY 1""",
)
def gate_status(spark, sf):
    return M.gate_status(sidecar(spark, sf), tagged(spark, sf))


@query(
    "trigger_status",
    f"""WITH {LABELS},
x AS (SELECT *, CASE WHEN task_source = 'routed_prompt_intervention' THEN 'r' ELSE 'n' END AS lane FROM sc),
st AS (SELECT * FROM x WHERE lane = 'n' AND tags IS NULL AND intervention_lane IS NULL),
rc AS (SELECT runtime, count(*) AS n FROM st WHERE runtime IS NOT NULL GROUP BY 1),
c AS (SELECT (SELECT count(*) FROM st) AS strict, count(*) FILTER (lane = 'n' AND success = false) AS failed,
  count(*) FILTER (lane = 'n' AND human_intervention) AS helped, count(*) FILTER (lane = 'n' AND tags IS NOT NULL) AS noted,
  count(*) FILTER (lane = 'r') AS routed, (SELECT 100.0 * max(n) / sum(n) FROM rc) AS share, (SELECT count(*) FROM rc WHERE n >= 5) AS rt5 FROM x)
SELECT 1 AS trigger, 'Native strict growth' AS name, strict::DOUBLE AS current, NULL::DOUBLE AS current_2, strict >= 150 AS met FROM c
UNION ALL SELECT 2, 'Failure/near-failure threshold', failed, helped, failed >= 10 AND helped >= 10 FROM c
UNION ALL SELECT 3, 'Routed-prompt gate', routed, NULL, routed >= 5 FROM c
UNION ALL SELECT 4, 'Controlled prompt expansion', 0, NULL, false FROM c
UNION ALL SELECT 5, 'Workflow lane growth', 0, 0, false FROM c
UNION ALL SELECT 6, 'Safety-control annotation', noted, NULL, noted >= 10 FROM c
UNION ALL SELECT 7, 'Runtime balance', round(share, 6), rt5, share < 60 AND rt5 >= 4 FROM c
UNION ALL SELECT 8, 'Metadata density', 100, NULL, true FROM c""",
)
def trigger_status(spark, sf):
    return rounded(M.trigger_status(sidecar(spark, sf)))


RUNTIME = ATTR + """, lb AS (SELECT session_id, pos, lower(coalesce(agent, provider)) AS l FROM atr WHERE coalesce(agent, provider) IS NOT NULL),
lc AS (SELECT session_id, l, count(*) AS n, min(pos) AS p FROM lb GROUP BY 1, 2),
ir AS (SELECT session_id, l AS runtime FROM lc QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, p) = 1)
"""


@query("infer_runtime", RUNTIME + "SELECT session_id, runtime FROM ir")
def infer_runtime(spark, sf):
    return M.infer_runtime(attributed(spark, sf))


MATERIAL = (
    RUNTIME
    + ", "
    + LABELS
    + """,
mt AS (SELECT u.session_id, coalesce(e.runtime, i.runtime) AS runtime, e.task_type, e.task_source, e.success, e.repo_language,
   e.duration, e.human_intervention, e.runtime IS NULL AND i.runtime IS NOT NULL AS runtime_inferred,
   e.noted IS NOT NULL AS from_annotation, e.own, e.noted
 FROM (SELECT DISTINCT session_id FROM tn) u LEFT JOIN ef e USING (session_id) LEFT JOIN ir i USING (session_id))
"""
)


@query(
    "materialize_metadata",
    MATERIAL
    + """SELECT session_id, runtime, task_type, task_source, success, repo_language, runtime_inferred, from_annotation,
runtime_inferred OR from_annotation AS changed FROM mt""",
)
def materialize_metadata(spark, sf):
    out = M.materialize_metadata(attributed(spark, sf), sidecar(spark, sf), annotation(spark, sf))
    return out.select(
        "session_id",
        "runtime",
        "task_type",
        "task_source",
        "success",
        "repo_language",
        "runtime_inferred",
        "from_annotation",
        "changed",
    )


@query(
    "materialized_provenance",
    MATERIAL
    + """,
f AS (
  SELECT session_id, 'runtime' AS field, CASE WHEN runtime_inferred THEN 'inferred_from_runtime_adapter' ELSE 'explicit_sidecar' END AS source FROM mt WHERE runtime IS NOT NULL
  UNION ALL SELECT m.session_id, 'task_type', CASE WHEN s.task_type IS NOT NULL THEN 'explicit_sidecar' ELSE 'materialized' END FROM mt m LEFT JOIN sc s USING (session_id) WHERE m.task_type IS NOT NULL
  UNION ALL SELECT m.session_id, 'task_source', CASE WHEN s.task_source IS NOT NULL THEN 'explicit_sidecar' ELSE 'materialized' END FROM mt m LEFT JOIN sc s USING (session_id) WHERE m.task_source IS NOT NULL
  UNION ALL SELECT m.session_id, 'success', CASE WHEN s.success IS NOT NULL THEN 'explicit_sidecar' ELSE 'materialized' END FROM mt m LEFT JOIN sc s USING (session_id) WHERE m.success IS NOT NULL
  UNION ALL SELECT session_id, 'repo_language', 'materialized' FROM mt WHERE repo_language IS NOT NULL
  UNION ALL SELECT session_id, 'duration', 'explicit_sidecar' FROM mt WHERE duration IS NOT NULL
  UNION ALL SELECT session_id, 'human_intervention', 'explicit_sidecar' FROM mt WHERE human_intervention IS NOT NULL)
SELECT * FROM f""",
)
def materialized_provenance(spark, sf):
    own = sidecar(spark, sf)
    out = M.materialize_metadata(attributed(spark, sf), own, annotation(spark, sf))
    return M.materialized_provenance(out, own)


@query(
    "materialize_summary",
    MATERIAL
    + """SELECT count(*) AS selected, count(*) FILTER (runtime_inferred OR from_annotation) AS updated,
count(*) FILTER (runtime_inferred) AS runtime_inferred, count(*) FILTER (from_annotation) AS from_annotation FROM mt""",
)
def materialize_summary(spark, sf):
    return M.materialize_summary(
        M.materialize_metadata(attributed(spark, sf), sidecar(spark, sf), annotation(spark, sf))
    )
