"""Comparable subsets of sessions, their gaps, sampling plans and feedback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein import schema
from skein.functions.columns import valid_session_id
from skein.operators.corpus import set_digest
from skein.operators.lineage import cut
from skein.operators.metadata import complete, present
from skein.operators.ordering import with_position

# Subset definitions and targets.
SUBSETS = {
    "strict_research_grade": ("runtime", "task_type", "task_source", "success"),
    "balanced_cross_runtime": ("runtime", "task_type", "task_source", "success"),
    "failure_enriched": ("runtime", "task_type", "success"),
    "intervention_lane": ("runtime", "task_type", "task_source"),
}
TARGETS = {
    "strict_research_grade": 150,
    "balanced_cross_runtime": 20,
    "failure_enriched": 50,
    "intervention_lane": 15,
}
DIMENSIONS = ("runtime", "task_type", "task_source", "data_origin", "intervention_lane", "topology")
SCENARIOS = {
    "failure_enriched": (
        "partial_context_v1",
        "ambiguous_requirements_v1",
        "tool_failure_observation_v1",
    ),
    "intervention_lane": ("superpowers_workflow_prompt_v1", "human_checkpoint_v1"),
    "balanced_cross_runtime": ("cross_runtime_matched_task_v1",),
    "strict_research_grade": ("metadata_complete_native_run_v1",),
}
DISTRIBUTION_TARGETS = {
    "failure_enriched": {
        "runtime": {"codex": 0.4, "claude": 0.4, "aider": 0.2},
        "task_type": {"bug_fix": 0.5, "refactor": 0.3, "review": 0.2},
    },
    "intervention_lane": {
        "runtime": {"claude": 0.5, "codex": 0.3, "opencode": 0.2},
        "task_type": {"exploration": 0.4, "feature_add": 0.4, "review": 0.2},
        "intervention_lane": {
            "superpowers_workflow_intervention": 0.5,
            "routed_prompt_intervention": 0.25,
            "controlled_prompt_morphology": 0.25,
        },
    },
    "balanced_cross_runtime": {
        "runtime": {"claude": 0.25, "codex": 0.25, "opencode": 0.25, "aider": 0.25},
        "task_type": {"bug_fix": 0.25, "feature_add": 0.25, "refactor": 0.25, "review": 0.25},
    },
    "strict_research_grade": {
        "runtime": {"claude": 0.35, "codex": 0.35, "opencode": 0.2, "aider": 0.1},
        "task_type": {"bug_fix": 0.3, "feature_add": 0.3, "refactor": 0.2, "review": 0.2},
    },
}
PROHIBITED_KEYS = (
    "api_call",
    "agent_command",
    "bash",
    "cmd",
    "command",
    "execute",
    "shell",
    "subprocess",
)
VOLATILE_KEYS = ("experiment_id", "generated_at", "output_dir", "queue_hash", "validation")
DENSITY_TARGET = 0.1
SCARCE = 10
DOMINANT_SHARE = 0.6


def experimental_units(records: DataFrame) -> DataFrame:
    """Comparison dimensions of each session."""
    fields = ("runtime", "task_type", "task_source", "data_origin", "intervention_lane")
    extra = records.select("session_id", "topology", "event_count")
    return (
        complete(records)
        .join(extra, "session_id")
        .select(
            "session_id",
            *[F.coalesce(F.col(f), F.lit("")).alias(f) for f in fields],
            "success",
            "human_intervention",
            "duration",
            "topology",
            "event_count",
        )
    )


def _has(fields: Sequence[str]) -> Column:
    cond = F.lit(True)
    for f in fields:
        cond = cond & present(f)
    return cond


def is_intervention() -> Column:
    return (
        F.coalesce(F.col("human_intervention"), F.lit(False))
        | ~F.col("intervention_lane").isin("", "direct_prompt_native")
        | F.col("task_source").isin(*schema.INTERVENTION_SOURCES)
    )


def subset_membership(units: DataFrame, subset_ids: Sequence[str] | None = None) -> DataFrame:
    """Every unit once per subset with ``reason``: null when selected, else why not."""
    ids = list(subset_ids or SUBSETS)
    failed = F.coalesce(~F.col("success") | F.col("human_intervention"), F.col("human_intervention"), ~F.col("success"), F.lit(False))
    rules = {
        "strict_research_grade": F.lit(None).cast("string"),
        "failure_enriched": F.when(~failed, "not_failure_or_near_failure"),
        "intervention_lane": F.when(~is_intervention(), "not_intervention_lane"),
    }
    plain = [s for s in ids if s in rules]
    entries = [
        F.struct(
            F.lit(s).alias("subset_id"),
            F.when(~_has(SUBSETS[s]), "missing_required_metadata").otherwise(rules[s]).alias("reason"),
        )
        for s in plain
    ]
    out = units.select("*", F.inline(F.array(*entries))) if entries else None
    if "balanced_cross_runtime" in ids:
        even = _balanced(units)
        out = even if out is None else out.unionByName(even)
    return out


def _balanced(units: DataFrame, prefix: int = 4) -> DataFrame:
    """The first sessions of each runtime, as many as the smallest runtime has."""
    name = "balanced_cross_runtime"
    fit = _has(SUBSETS[name])
    able = units.filter(fit)
    sizes = able.groupBy("runtime").agg(F.count("*").alias("n"))
    breadth = sizes.agg(F.count("*")).scalar()
    target = sizes.agg(F.min("n")).scalar()
    ranked = with_position(
        able.withColumn("_key", F.col("session_id")), ["runtime"], "_key", "session_id", "_nth", prefix
    ).drop("_key")
    reason = F.when(breadth < 2, "insufficient_runtime_breadth").when(
        F.col("_nth") > target, "runtime_cap_excluded"
    )
    kept = ranked.select(
        *units.columns, F.lit(name).alias("subset_id"), reason.alias("reason")
    )
    rest = units.filter(~fit).select(
        "*", F.lit(name).alias("subset_id"), F.lit("missing_required_metadata").alias("reason")
    )
    return kept.unionByName(rest)


def build_subset(units: DataFrame, subset_id: str) -> DataFrame:
    """Units of one named subset."""
    if subset_id not in SUBSETS:
        raise ValueError(f"unknown subset: {subset_id}")
    return subset_membership(units, [subset_id]).filter("reason IS NULL").drop("reason")


def subset_exclusions(membership: DataFrame) -> DataFrame:
    return (
        membership.filter("reason IS NOT NULL")
        .groupBy("subset_id", "reason")
        .agg(F.count("*").alias("sessions"))
    )


def distributions(members: DataFrame, by: Sequence[str] = ("subset_id",)) -> DataFrame:
    """Counts per dimension and value, ``unknown`` for empty."""
    entries = F.array(
        *[
            F.struct(
                F.lit(d).alias("dimension"),
                F.coalesce(F.nullif(F.col(d), F.lit("")), F.lit("unknown")).alias("value"),
            )
            for d in DIMENSIONS
        ]
    )
    return (
        members.select(*by, F.inline(entries))
        .groupBy(*by, "dimension", "value")
        .agg(F.count("*").alias("sessions"))
    )


def _evenness(members: DataFrame, by: list[str]) -> DataFrame:
    """Entropy over its maximum for runtime, task type and topology; empty values left out."""
    dims = ("runtime", "task_type", "topology")
    entries = F.array(*[F.struct(F.lit(d).alias("d"), F.col(d).alias("v")) for d in dims])
    counts = (
        members.select(*by, F.inline(entries))
        .filter("v <> ''")
        .groupBy(*by, "d", "v")
        .agg(F.count("*").alias("n"))
    )
    n, total = F.col("n"), F.sum("n")
    entropy = F.log(total) - F.sum(n * F.log(n)) / total
    per = counts.groupBy(*by, "d").agg(
        F.when(F.count("*") > 1, entropy / F.log(F.count("*"))).otherwise(0.0).alias("e")
    )
    return per.groupBy(*by).agg(
        *[F.coalesce(F.max(F.when(F.col("d") == d, F.col("e"))), F.lit(0.0)).alias(f"e_{d}") for d in dims]
    )


def comparability(members: DataFrame, by: Sequence[str] = ("subset_id",)) -> DataFrame:
    """Seven bounded measures of how comparable a set of sessions is, and their mean.

    ``members`` may hold several sets told apart by ``by``; completeness looks at the
    fields the set's subset requires.
    """
    by = list(by)
    if "subset_id" in members.columns:
        share = F.lit(None).cast("double")
        for s, fields in SUBSETS.items():
            share = F.when(F.col("subset_id") == s, _share(fields)).otherwise(share)
    else:
        share = _share(("runtime", "task_type", "task_source", "success"))

    def dense(cond: Column) -> Column:
        return F.least(F.count_if(cond) / F.count("*") / DENSITY_TARGET, F.lit(1.0))

    base = members.groupBy(*by).agg(
        F.avg(share).alias("metadata_completeness"),
        dense(F.col("success") == F.lit(False)).alias("failure_density"),
        dense(is_intervention()).alias("intervention_density"),
    )
    parts = {
        "metadata_completeness": "metadata_completeness",
        "runtime_diversity": "e_runtime",
        "task_variance": "e_task_type",
        "failure_density": "failure_density",
        "intervention_density": "intervention_density",
        "topology_variance": "e_topology",
    }
    df = base.join(_evenness(members, by), by, "left").select(
        *by,
        *[F.round(F.coalesce(F.col(c), F.lit(0.0)), 4).alias(n) for n, c in parts.items()],
        F.lit(1.0).alias("reproducibility"),
    )
    names = [*parts, "reproducibility"]
    return df.withColumn("score", F.round(sum((F.col(n) for n in names), F.lit(0.0)) / len(names), 4))


def _share(fields: Sequence[str]) -> Column:
    return sum((present(f).cast("double") for f in fields), F.lit(0.0)) / len(fields)


def bias_register(membership: DataFrame) -> DataFrame:
    """Eight named bias flags per subset with the number behind each."""
    picked = F.col("reason").isNull()
    unknown = (F.col("runtime") == "") | (F.col("task_type") == "") | F.col("success").isNull()
    base = membership.groupBy("subset_id").agg(
        F.count("*").alias("all"),
        F.count_if(picked).alias("n"),
        F.count_if(picked & (F.col("success") == F.lit(False))).alias("failed"),
        F.count_if(picked & is_intervention()).alias("helped"),
        F.count_if(picked & unknown).alias("unknown"),
        F.count_if(picked & F.col("duration").isNull()).alias("untimed"),
    )
    top = (
        distributions(membership.filter(picked))
        .filter("dimension IN ('runtime', 'task_type')")
        .groupBy("subset_id")
        .agg(
            F.max(F.when(F.col("dimension") == "runtime", F.col("sessions"))).alias("top_runtime"),
            F.max(F.when(F.col("dimension") == "task_type", F.col("sessions"))).alias("top_task"),
        )
    )
    df = base.join(top, "subset_id", "left").fillna(0, ["top_runtime", "top_task"])
    size = F.greatest(F.col("n"), F.lit(1))

    def flag(name: str, present_: Column, value: Column) -> Column:
        return F.struct(
            F.lit(name).alias("flag"), present_.alias("present"), value.cast("double").alias("value")
        )

    c = F.col
    flags = F.array(
        flag("unlabeled_majority", c("n") < c("all"), c("n")),
        flag("failure_scarcity", c("failed") < SCARCE, c("failed")),
        flag("intervention_scarcity", c("helped") < SCARCE, c("helped")),
        flag("runtime_imbalance", c("top_runtime") / size > DOMINANT_SHARE, c("top_runtime") / size),
        flag("task_imbalance", c("top_task") / size > DOMINANT_SHARE, c("top_task") / size),
        flag("success_label_scarcity", c("unknown") > 0, c("unknown")),
        flag("duration_absence", c("untimed") > 0, c("untimed")),
        flag("post_hoc_parsing", F.lit(True), F.lit(None)),
    )
    return df.select("subset_id", F.inline(flags))


def compile_subsets(membership: DataFrame) -> DataFrame:
    """One row per subset: sizes, comparability and a digest of its members and counts."""
    members = membership.filter("reason IS NULL")
    sizes = membership.groupBy("subset_id").agg(
        F.count("*").alias("source_sessions"),
        F.count_if(F.col("reason").isNull()).alias("selected_count"),
        F.count_if(F.col("reason").isNotNull()).alias("excluded_count"),
    )
    text = membership.select(
        "subset_id",
        F.concat_ws("\u001f", "session_id", F.coalesce("reason", F.lit("+"))).alias("t"),
    ).unionByName(
        distributions(members).select(
            "subset_id",
            F.concat_ws("\u001f", "dimension", "value", F.col("sessions").cast("string")).alias("t"),
        )
    )
    digest = text.groupBy("subset_id").agg(set_digest(F.col("t")).alias("manifest_hash"))
    scores = comparability(members)
    return (
        sizes.join(scores, "subset_id", "left")
        .fillna(0.0, [n for n, t in scores.dtypes if t == "double"])
        .join(digest, "subset_id")
    )


def write_subsets(membership: DataFrame, path: str) -> None:
    """Members as JSON lines in one folder per subset, with an index of the manifests."""
    membership.filter("reason IS NULL").drop("reason").write.mode("overwrite").partitionBy(
        "subset_id"
    ).json(f"{path}/members")
    compile_subsets(membership).write.mode("overwrite").json(f"{path}/index")


# -- gaps and plans ----------------------------------------------------------


def analyze_gaps(membership: DataFrame, targets: dict[str, int] | None = None) -> DataFrame:
    """Current against target size of each subset, with status and severity."""
    goals = {**TARGETS, **(targets or {})}
    spark = membership.sparkSession
    goal = spark.createDataFrame(list(goals.items()), "subset_id string, target bigint")
    done = compile_subsets(membership).select(
        "subset_id", F.col("selected_count").alias("current_sessions"), F.col("score").alias("comparability_score")
    )
    df = done.join(goal, "subset_id", "left").withColumn(
        "target_sessions", F.coalesce("target", "current_sessions")
    )
    missing = F.greatest(F.col("target_sessions") - F.col("current_sessions"), F.lit(0))
    ratio = F.col("missing_sessions") / F.greatest(F.col("target_sessions"), F.lit(1))
    return (
        df.withColumn("missing_sessions", missing)
        .withColumn("status", F.when(F.col("missing_sessions") == 0, "met").otherwise("under_target"))
        .withColumn(
            "severity",
            F.when(F.col("missing_sessions") <= 0, "none")
            .when(ratio >= 0.75, "high")
            .when(ratio >= 0.35, "medium")
            .otherwise("low"),
        )
        .drop("target")
    )


def plan_sampling(gaps: DataFrame) -> DataFrame:
    """Sessions wanted per subset, dimension and label: missing sessions times the target share."""
    spark = gaps.sparkSession
    shares = [
        (s, d, label, w)
        for s, dims in DISTRIBUTION_TARGETS.items()
        for d, labels in dims.items()
        for label, w in labels.items()
    ]
    wanted = spark.createDataFrame(
        shares, "subset_id string, dimension string, label string, share double"
    )
    return gaps.join(F.broadcast(wanted), "subset_id").select(
        "subset_id",
        "dimension",
        "label",
        "share",
        F.col("missing_sessions").alias("required_sessions"),
        (F.col("missing_sessions") * F.col("share")).alias("wanted_sessions"),
    )


def plan_scenarios(gaps: DataFrame) -> DataFrame:
    """Scenario descriptors of the subsets that miss sessions."""
    spark = gaps.sparkSession
    rows = [(s, i, name) for s, names in SCENARIOS.items() for i, name in enumerate(names)]
    table = spark.createDataFrame(rows, "subset_id string, ord int, scenario_id string")
    return gaps.filter("missing_sessions > 0").join(F.broadcast(table), "subset_id").select(
        "subset_id", "ord", "scenario_id"
    )


def lint_plans(plans: DataFrame) -> DataFrame:
    """Rule violations of plans given as (plan_id, plan JSON): rows (plan_id, issue).

    Prohibited keys are looked for at any depth; each place that has one is an issue. A plan
    that is no JSON breaks every rule on fields.
    """
    def get(path: str, dtype: str) -> Column:
        return F.try_variant_get("_v", path, dtype)

    def when(cond: Column, text: str) -> Column:
        return F.when(F.coalesce(cond, F.lit(True)), F.array(F.lit(text))).otherwise(F.array())

    checks = [
        when(get("$.execution_mode", "string") != "external_only", "execution_mode must be external_only"),
        when(~get("$.must_not_execute", "boolean"), "must_not_execute must be true"),
        when(
            get("$.evidence_status", "string") != "planned_not_observed",
            "evidence_status must be planned_not_observed",
        ),
        when(
            get("$.observed_session_count", "bigint") != 0,
            "observed_session_count must be 0 for planned queues",
        ),
        when(get("$.phase4_grade_effect", "string") != "none", "phase4_grade_effect must be none"),
    ]
    scenarios = F.coalesce(
        get("$.bde_scenarios", "array<variant>"), F.expr("cast(array() as array<variant>)")
    )
    loose = F.filter(
        scenarios,
        lambda s: ~F.coalesce(F.try_variant_get(s, "$.descriptor_only", "boolean"), F.lit(False)),
    )
    loose = F.transform(
        loose,
        lambda s: F.concat(
            F.lit("scenario "),
            F.coalesce(F.try_variant_get(s, "$.scenario_id", "string"), F.lit("<unknown>")),
            F.lit(" must be descriptor_only"),
        ),
    )
    empty = F.expr("cast(array() as array<string>)")
    read = _dealt(plans).select("plan_id", F.try_parse_json("plan").alias("_v"))
    fields = read.select("plan_id", F.explode(F.concat(empty, *checks, loose)).alias("issue"))
    hits = plan_entries(plans).filter(F.col("key").isin(*PROHIBITED_KEYS))
    return fields.unionByName(hits.select("plan_id", F.concat(F.lit("prohibited execution key: "), "path").alias("issue")))


def _dealt(plans: DataFrame) -> DataFrame:
    """Plans over all tasks: a table of few bytes lies in few files, yet opening a plan takes long."""
    return plans.repartition(int(plans.sparkSession.conf.get("spark.sql.shuffle.partitions")), "plan_id")


def _plan_hash() -> Column:
    return F.unhex(F.sha2("plan", 256)).alias("plan_hash")


def plan_entries(plans: DataFrame, skipped: Sequence[str] = ()) -> DataFrame:
    """Every value inside each plan: ``plan_id, plan_hash, path, steps, key, leaf``.

    ``plan_hash`` is the SHA-256 of the plan's text: no row carries the text itself.
    Objects and arrays are opened level by level, as deep as the deepest plan goes. ``path``
    reads like ``$.a[0].b``, ``steps`` tells keys from places; ``key`` is null in arrays and
    ``leaf`` (JSON text) in objects and arrays that hold something. What lies under a
    ``skipped`` key is left out.
    """
    spark = plans.sparkSession
    level = _dealt(plans).select(
        "plan_id", _plan_hash(), F.lit("$").alias("path"), F.expr("cast(array() AS array<string>)").alias("steps"), F.try_parse_json("plan").alias("v")
    )
    found = None
    while True:
        inside = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("plan_id", "plan_hash", "path", "steps", "pos", "key", "value")
        if skipped:
            inside = inside.filter(F.col("key").isNull() | ~F.col("key").isin(*skipped))
        in_array = F.col("key").isNull()
        kind = F.schema_of_variant("value")
        full = kind.rlike("^(OBJECT<[^>]|ARRAY<(?!VOID>$))")
        inside = inside.select(
            "plan_id",
            "plan_hash",
            F.when(in_array, F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat("path", F.lit("."), "key")).alias("path"),
            F.array_append("steps", F.when(in_array, F.format_string("[%09d", "pos")).otherwise(F.concat(F.lit("."), "key"))).alias("steps"),
            "key",
            F.when(~full, F.to_json("value")).alias("leaf"),
            F.when(full, F.to_json("value")).alias("rest"),
        )
        inside = cut(inside)
        rows = inside.drop("rest")
        found = rows if found is None else found.unionByName(rows)
        deeper = inside.filter("rest IS NOT NULL")
        if deeper.isEmpty():
            return found
        level = deeper.select("plan_id", "plan_hash", "path", "steps", F.parse_json("rest").alias("v"))


def plan_signatures(plans: DataFrame) -> DataFrame:
    """``plan_id, plan, signature``: digest of each plan without volatile fields at any depth; key order does not matter."""
    leaves = plan_entries(plans, VOLATILE_KEYS).filter("leaf IS NOT NULL")
    # A plan's leaves come from one text, so they fit where the text did.
    own = leaves.groupBy("plan_id", "plan_hash").agg(F.sha2(F.to_json(F.sort_array(F.collect_set(F.struct("steps", "leaf")))), 256).alias("signature"))
    bare = F.sha2(F.lit(""), 256)
    given = plans.select("plan_id", "plan", _plan_hash())
    return given.join(own, ["plan_id", "plan_hash"], "left").select("plan_id", "plan", F.coalesce("signature", bare).alias("signature"))


def validate_plans(plans: DataFrame, gaps: DataFrame) -> DataFrame:
    """Is each plan well formed, unique and still needed?"""
    v = F.try_parse_json("plan")
    df = plan_signatures(plans).select(
        "plan_id",
        F.coalesce(F.try_variant_get(v, "$.target_subset", "string"), F.lit("unknown")).alias("subset_id"),
        F.coalesce(F.try_variant_get(v, "$.required_sessions", "bigint"), F.lit(0)).alias("required_sessions"),
        "signature",
    )
    copies = df.groupBy("signature").agg((F.count("*") - 1).alias("duplicates"))
    bad = lint_plans(plans).groupBy("plan_id").agg(F.count("*").alias("issues"))
    need = gaps.select("subset_id", "missing_sessions")
    out = (
        df.join(copies, "signature")
        .join(bad, "plan_id", "left")
        .join(need, "subset_id", "left")
        .fillna(0, ["issues"])
        .withColumn("missing_sessions", F.coalesce("missing_sessions", "required_sessions"))
    )
    needed = (F.col("missing_sessions") > 0) & (F.col("required_sessions") > 0)
    ok = (F.col("issues") == 0) & (F.col("duplicates") == 0) & needed
    return out.select(
        "plan_id",
        "subset_id",
        "required_sessions",
        "missing_sessions",
        "duplicates",
        "issues",
        needed.alias("sampling_needed"),
        ok.alias("valid"),
        F.when(ok, "ready").when(F.col("duplicates") > 0, "duplicate").otherwise("not_needed").alias("status"),
    )


# -- feedback ----------------------------------------------------------------


def ingest_feedback(observations: DataFrame, records: DataFrame) -> DataFrame:
    """Observed sessions with gaps filled from the corpus.

    ``observations`` has ``experiment_id``, ``target_subset``, ``session_id`` and any of
    the comparison fields. A well-formed session id counts as resolved.
    """
    texts = ("runtime", "task_type", "task_source", "data_origin", "intervention_lane", "topology")
    known = complete(records).join(records.select("session_id", "topology", "event_count"), "session_id")
    known = known.select(
        "session_id",
        *[F.col(c).alias(f"_{c}") for c in (*texts, "success", "human_intervention", "event_count")],
    )
    ok = valid_session_id("session_id")

    def own(name: str, dtype: str) -> Column:
        return F.col(name).cast(dtype) if name in observations.columns else F.lit(None).cast(dtype)

    def text(name: str) -> Column:
        last = F.when(ok, F.lit("mixed")) if name == "topology" else F.lit(None)
        return F.coalesce(F.nullif(own(name, "string"), F.lit("")), F.col(f"_{name}"), last, F.lit(""))

    return observations.join(known, "session_id", "left").select(
        "experiment_id",
        "target_subset",
        "session_id",
        *[text(c).alias(c) for c in texts],
        F.coalesce(own("success", "boolean"), F.col("_success")).alias("success"),
        F.coalesce(own("human_intervention", "boolean"), F.col("_human_intervention")).alias(
            "human_intervention"
        ),
        F.coalesce(F.nullif(own("event_count", "bigint"), F.lit(0)), F.col("_event_count"), F.lit(0)).alias(
            "event_count"
        ),
        ok.alias("resolved"),
    )


def feedback_report(feedback: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """Per experiment: observed, resolved, quality flags and progress against the target.

    ``plans`` may give ``experiment_id`` and ``required_sessions``.
    """
    spark = feedback.sparkSession
    goal = spark.createDataFrame(list(TARGETS.items()), "target_subset string, _default bigint")
    per = feedback.groupBy("experiment_id", "target_subset").agg(
        F.count("*").alias("observed_count"),
        F.count_if("resolved").alias("resolved_count"),
        F.max(F.coalesce(F.col("success") == F.lit(False), F.lit(False))).alias("has_failures"),
        F.max(is_intervention()).alias("has_interventions"),
    )
    df = per.join(goal, "target_subset", "left")
    target = F.coalesce("_default", F.lit(0))
    if plans is not None:
        want = plans.select("experiment_id", F.col("required_sessions").alias("_planned"))
        df = df.join(want, "experiment_id", "left")
        target = F.coalesce(F.when(F.col("_planned") >= 0, F.col("_planned")), target)
    n = F.col("observed_count")
    return df.withColumn("target_sessions", target).select(
        "experiment_id",
        "target_subset",
        "observed_count",
        "resolved_count",
        F.round(F.col("resolved_count") / n, 4).alias("resolved_ratio"),
        "has_failures",
        "has_interventions",
        "target_sessions",
        F.greatest(F.col("target_sessions") - n, F.lit(0)).alias("remaining_sessions"),
        F.when(F.col("target_sessions") > 0, F.round(n / F.col("target_sessions"), 4))
        .otherwise(0.0)
        .alias("progress_ratio"),
    )


def feedback_distributions(feedback: DataFrame) -> DataFrame:
    return distributions(feedback, ["experiment_id"])


def update_gaps(report: DataFrame, gaps: DataFrame) -> DataFrame:
    """Projected gap of each experiment's subset next to the corpus gap."""
    left = F.col("remaining_sessions")
    return report.join(
        gaps.select(F.col("subset_id").alias("target_subset"), "current_sessions", "missing_sessions"),
        "target_subset",
        "left",
    ).select(
        "experiment_id",
        "target_subset",
        "observed_count",
        "remaining_sessions",
        "current_sessions",
        "missing_sessions",
        F.when(left == 0, "met").otherwise("under_target").alias("status"),
        F.when(left > 0, "reprioritize").otherwise("hold").alias("priority_hint"),
    )


def reprioritize(gaps: DataFrame, report: DataFrame) -> DataFrame:
    """Order of subsets for the next sampling round, per experiment feedback."""
    weight = (
        F.when(F.col("severity") == "high", 3)
        .when(F.col("severity") == "medium", 2)
        .when(F.col("severity") == "low", 1)
        .otherwise(0)
    )
    aimed = F.col("subset_id") == F.col("target_subset")
    boost = F.when(aimed & (F.col("remaining_sessions") > 0), 1).otherwise(0)
    subsets = F.array(*[F.lit(s) for s in SUBSETS])
    told = report.select(
        "experiment_id", "target_subset", "remaining_sessions", F.explode(subsets).alias("subset_id")
    )
    # ``gaps`` has one row per named subset.
    return told.join(gaps, "subset_id").select(
        "experiment_id",
        "subset_id",
        "current_sessions",
        "target_sessions",
        "missing_sessions",
        "severity",
        (F.col("missing_sessions") + weight + boost).alias("priority_score"),
        aimed.alias("feedback_target"),
    )
