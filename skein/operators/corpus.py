"""Corpus level: session records, facts, benchmarks, taxonomy, readiness, snapshots."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import schema
from skein.operators.edges import branch_starts
from skein.operators.graph import TraceGraph
from skein.operators.lineage import cut
from skein.operators.manifests import differing_parts, field_leaves, tree_roots
from skein.operators.metadata import (
    CANONICAL_FIELDS,
    OPTIONAL_FIELDS,
    STRICT_FIELDS,
    TRUSTED_SOURCES,
    complete,
    effective_metadata,
    field_provenance,
    long_fields,
    present,
)
from skein.operators.patterns import retry_density
from skein.operators.structure import collapsed_sessions, frontier_summary, session_stats, topology_class

EVENT_TEXT_FIELDS = (
    "event_id",
    "parent_event_id",
    "event_type",
    "caused_by",
    "tool_name",
    "tool_input",
    "tool_output",
    "timestamp",
    "model",
    "provider",
    "agent",
)

# Tag priority when one label must stand for a session.
TAXONOMY_PRIORITY = (
    "branch_collapse",
    "fan_in",
    "retry_heavy",
    "multi_root_exploration",
    "branchy",
    "deep_linear",
    "long_session",
)

MILESTONES = (
    ("scale_1000", "Corpus scale", 1000, "session_count", None),
    ("research_100", "Research-ready labeled corpus", 100, "metadata_sessions", None),
    ("runtime_4", "Explicit runtime fingerprint set", 4, None, "runtime_counts"),
    ("task_4", "Task taxonomy breadth", 4, None, "task_type_counts"),
    ("fan_in_10", "Fan-in exemplars", 10, "fan_in_sessions", None),
    ("branch_collapse_10", "Branch-collapse exemplars", 10, "branch_collapse_sessions", None),
    ("multi_root_10", "Multi-root exemplars", 10, "multi_root_sessions", None),
)

READINESS = (
    ("session_scale", "Corpus scale", 100, "session_count", None),
    ("metadata_sessions", "Explicit metadata sidecars", 100, "metadata_sessions", None),
    ("explicit_runtime_sessions", "Explicit runtime labels", 100, "explicit_runtime_sessions", None),
    ("task_type_sessions", "Task labels", 100, "task_type_sessions", None),
    ("runtime_breadth", "Runtime family breadth", 4, None, "runtime_counts"),
    ("task_breadth", "Task taxonomy breadth", 4, None, "task_type_counts"),
    ("fan_in_sessions", "Fan-in exemplars", 10, "fan_in_sessions", None),
    ("branch_collapse_sessions", "Branch-collapse exemplars", 10, "branch_collapse_sessions", None),
    ("multi_root_sessions", "Multi-root exemplars", 10, "multi_root_sessions", None),
    ("long_sessions", "Long sessions (>=100 events)", 10, "long_sessions_100", None),
    ("retry_heavy_sessions", "Retry-heavy sessions", 10, "retry_heavy_sessions", None),
)

SCALAR_FACTS = (
    "session_count",
    "event_count",
    "metadata_sessions",
    "annotated_sessions",
    "research_grade_sessions",
    "explicit_runtime_sessions",
    "heuristic_runtime_sessions",
    "task_type_sessions",
    "source_sessions",
    "long_sessions_100",
    "branchy_sessions",
    "frontier_wide_sessions",
    "retry_heavy_sessions",
    "fan_in_sessions",
    "branch_collapse_sessions",
    "multi_root_sessions",
)

# Which lane a task source points to.
LANE_HINTS = {
    "demo": "demo",
    "real_work": "native",
    "proxy": "proxy",
    "routed_prompt_intervention": "routed_prompt",
    "superpowers_workflow_intervention": "superpowers_workflow",
    "controlled_prompt_morphology": "prompt_morphology",
}
NO_HINT = "by_hand"


# -- digests -----------------------------------------------------------------


def set_digest(text: Column) -> Column:
    """Aggregate digest of a bag of texts that does not depend on their order.

    Each text's SHA-256 is cut into four numbers; the sums and the count are hashed
    again. Sums combine on the map side, so no group is ever collected or sorted.
    """
    h = F.sha2(text, 256)

    def total(at: int) -> Column:
        # 60 bits in two halves, room for 2^33 rows: sums of whole numbers are cheaper than those of decimals.
        n = F.conv(F.substring(h, at, 15), 16, 10).cast("bigint")
        high, low = F.sum(F.shiftright(n, 30)), F.sum(n.bitwiseAND(F.lit((1 << 30) - 1)))
        return (high.cast("decimal(20,0)") * F.lit(1 << 30).cast("decimal(10,0)") + low.cast("decimal(20,0)")).cast("string")

    parts = [total(at) for at in (1, 16, 31, 46)]
    return F.sha2(F.concat_ws("/", F.count("*").cast("string"), *parts), 256)


def event_text(events: DataFrame) -> Column:
    """An event's stored fields as one text."""
    fields = [F.coalesce(F.col(f), F.lit("")) for f in EVENT_TEXT_FIELDS]
    return F.concat_ws("\u001f", *fields)


def content_text(events: DataFrame) -> Column:
    """All that a session digest must see of an event: every field, its place, and which fields are null."""
    columns = [*EVENT_TEXT_FIELDS, "duration_ms", *(c for c in ("pos",) if c in events.columns)]
    fields = [F.coalesce(F.concat(F.lit("="), F.col(f).cast("string")), F.lit("-")) for f in columns]
    return F.concat_ws("\u001f", *fields)


def row_text(df: DataFrame, skip: Sequence[str] = ()) -> Column:
    cols = [F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in sorted(df.columns) if c not in skip]
    return F.concat_ws("\u001f", *cols)


# -- records and features ----------------------------------------------------


def session_records(
    events: DataFrame,
    sidecar: DataFrame,
    annotation: DataFrame,
    graph: TraceGraph | None = None,
) -> DataFrame:
    """One row per session: content digest, size, structure, topology and metadata."""
    g = graph or TraceGraph(events)
    content = events.groupBy("session_id").agg(
        set_digest(content_text(events)).alias("session_hash"),
        F.sum(F.octet_length(event_text(events)) + 1).alias("session_bytes"),
    )
    stats = topology_class(session_stats(events, graph=g))
    return content.join(stats, "session_id").join(
        effective_metadata(sidecar, annotation), "session_id", "left"
    )


def session_features(events: DataFrame, graph: TraceGraph | None = None) -> DataFrame:
    """Structure of each session plus the signals behind its taxonomy."""
    g = graph or TraceGraph(events)
    stats = topology_class(session_stats(events, graph=g))
    starts = branch_starts(events, links=g.edges).groupBy("session_id").agg(F.count("*").alias("branches"))
    collapsed = collapsed_sessions(events, graph=g).withColumn("collapsed", F.lit(True))
    return (
        stats.join(starts, "session_id", "left")
        .join(frontier_summary(events, graph=g), "session_id")
        .join(retry_density(events, graph=g).select("session_id", "retry_density"), "session_id")
        .join(collapsed, "session_id", "left")
        .fillna(False, ["collapsed"])
        .fillna(0, ["branches"])
    )


def _signals() -> dict[str, Column]:
    return {
        "long_sessions_100": F.col("event_count") >= 100,
        "multi_root_sessions": F.col("root_count") >= 5,
        "fan_in_sessions": F.col("multi_parent_count") > 0,
        "branch_collapse_sessions": F.col("collapsed"),
        "branchy_sessions": F.col("branches") > 1,
        "frontier_wide_sessions": F.col("max_width") >= 4,
        "retry_heavy_sessions": F.round("retry_density", 4) >= 0.2,
    }


def corpus_facts(
    events: DataFrame,
    sidecar: DataFrame,
    annotation: DataFrame,
    features: DataFrame | None = None,
    provenance: DataFrame | None = None,
) -> DataFrame:
    """Counts about the corpus as rows (fact, key, value); plain counts have key ''.

    Every session turns into the facts it supports and the facts are counted once.
    """
    features = session_features(events) if features is None else features
    own = complete(sidecar)
    label = F.coalesce(F.nullif("agent", F.lit("")), F.nullif("provider", F.lit("")))
    heuristic = events.groupBy("session_id").agg(
        F.min_by(label, F.when(label.isNotNull(), F.col("pos"))).alias("heuristic")
    )
    eff = effective_metadata(sidecar, annotation).select(
        "session_id", F.col("task_type").alias("eff_task"), F.col("task_source").alias("eff_source")
    )
    noted = annotation.select("session_id", F.lit(True).alias("annotated"))
    any_field = F.coalesce(*[F.when(F.col(n).isNotNull(), True) for n in schema.METADATA_FIELDS])
    base = (
        features.join(own.withColumn("has_sidecar", any_field), "session_id", "left")
        .join(heuristic, "session_id", "left")
        .join(eff, "session_id", "left")
        .join(noted, "session_id", "left")
    )
    strict = F.lit(True)
    for f in STRICT_FIELDS:
        strict = strict & present(f)

    def hit(fact: str, cond: Column, key: Column | str = "") -> Column:
        key = F.lit(key) if isinstance(key, str) else key
        pair = F.struct(F.lit(fact).alias("fact"), key.cast("string").alias("key"))
        return F.when(F.coalesce(cond, F.lit(False)), pair)

    def named(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) != ""

    signals = _signals()
    pairs = [
        hit("session_count", F.lit(True)),
        hit("metadata_sessions", F.col("has_sidecar")),
        hit("annotated_sessions", F.col("annotated")),
        hit("research_grade_sessions", strict),
        hit("explicit_runtime_sessions", named("runtime")),
        hit("runtime_counts", named("runtime"), F.col("runtime")),
        hit("heuristic_runtime_sessions", named("heuristic")),
        hit("heuristic_runtime_counts", named("heuristic"), F.col("heuristic")),
        hit("task_type_sessions", named("eff_task")),
        hit("task_type_counts", named("eff_task"), F.col("eff_task")),
        hit("source_sessions", named("eff_source")),
        hit("source_counts", named("eff_source"), F.col("eff_source")),
        hit("topology_counts", F.lit(True), F.col("topology")),
        hit("structural_counts", signals["fan_in_sessions"], "fan_in"),
        hit("structural_counts", signals["branch_collapse_sessions"], "branch_collapse"),
        hit("structural_counts", signals["frontier_wide_sessions"], "frontier_width_ge_4"),
        hit("structural_counts", signals["retry_heavy_sessions"], "retry_density_ge_0.2"),
        hit("structural_counts", signals["multi_root_sessions"], "multi_root_ge_5"),
    ]
    pairs += [hit(name, cond) for name, cond in signals.items()]
    for f in CANONICAL_FIELDS:
        pairs.append(hit("metadata_missing_counts", ~present(f), f))
        pairs.append(hit("explicit_metadata_field_counts", present(f), f))
    base = cut(base)
    counted = base.select(F.inline(F.array_compact(F.array(*pairs)))).withColumn(
        "value", F.lit(1).cast("bigint")
    )
    total = base.select(
        F.lit("event_count").alias("fact"), F.lit("").alias("key"), F.col("event_count").alias("value")
    )
    source = field_provenance(sidecar, annotation) if provenance is None else provenance
    trusted = (
        long_fields(sidecar, CANONICAL_FIELDS)
        .filter("given")
        .join(features.select("session_id"), "session_id", "left_semi")
        .join(source, ["session_id", "field"], "left")
        .select(
            F.lit("metadata_provenance_counts").alias("fact"),
            F.coalesce("source", F.lit("unknown")).alias("key"),
            F.lit(1).cast("bigint").alias("value"),
        )
    )
    zero = _constants(events.sparkSession, [(f, "", 0) for f in SCALAR_FACTS], "fact string, key string, value bigint")
    return (
        counted.unionByName(total)
        .unionByName(trusted)
        .unionByName(zero)
        .groupBy("fact", "key")
        .agg(F.sum("value").alias("value"))
    )


def _constants(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


def _against(facts: DataFrame, rules: Sequence[tuple]) -> DataFrame:
    """Fixed targets next to the current value: a plain fact or a number of distinct keys."""
    targets = _constants(
        facts.sparkSession,
        [(i, k, lab, t, f or m, f is None) for i, (k, lab, t, f, m) in enumerate(rules)],
        "ord int, key string, label string, target bigint, fact string, breadth boolean",
    )
    current = facts.groupBy("fact").agg(
        F.sum("value").alias("total"), F.count("*").alias("kinds")
    )
    value = F.coalesce(F.when(F.col("breadth"), F.col("kinds")).otherwise(F.col("total")), F.lit(0))
    return (
        targets.join(current, "fact", "left")
        .withColumn("current", value)
        .withColumn("remaining", F.greatest(F.col("target") - F.col("current"), F.lit(0)))
        .select("ord", "key", "label", "current", "target", "remaining")
    )


def milestones(facts: DataFrame) -> DataFrame:
    return _against(facts, MILESTONES).drop("ord")


def readiness(facts: DataFrame, targets: dict[str, int] | None = None) -> DataFrame:
    """Eleven criteria with target, remaining and verdict. The corpus is ready when all pass."""
    targets = targets or {}
    rules = [(k, lab, targets.get(k, t), f, m) for k, lab, t, f, m in READINESS]
    return _against(facts, rules).withColumn("passed", F.col("current") >= F.col("target")).drop("ord")


def ready(criteria: DataFrame) -> DataFrame:
    return criteria.agg(
        F.bool_and("passed").alias("ready"), F.count_if(~F.col("passed")).alias("blockers")
    )


def source_facts(records: DataFrame, provenance: DataFrame) -> DataFrame:
    """Origin, origin provenance, task source and lane hint counts as (fact, key, value)."""
    origin = provenance.filter("field = 'data_origin'").select("session_id", "source")
    df = records.join(origin, "session_id", "left")
    has, src = present("data_origin"), present("task_source")
    hint = F.lit(NO_HINT)
    for name, text in LANE_HINTS.items():
        hint = F.when(F.col("task_source") == name, text).otherwise(hint)

    def hit(fact: str, cond: Column, key: Column) -> Column:
        return F.when(cond, F.struct(F.lit(fact).alias("fact"), key.alias("key")))

    pairs = F.array(
        hit("session_count", F.lit(True), F.lit("")),
        hit("missing_data_origin", ~has, F.lit("")),
        hit("data_origin_counts", has, F.col("data_origin")),
        hit("data_origin_provenance_counts", has, F.coalesce("source", F.lit("unknown"))),
        hit("task_source_counts", src, F.col("task_source")),
        hit("lane_hint_counts", src, hint),
    )
    return (
        df.select(F.inline(F.array_compact(pairs)))
        .groupBy("fact", "key")
        .agg(F.count("*").alias("value"))
    )


def missing_origin(records: DataFrame, limit: int = 10) -> DataFrame:
    """Sessions without data origin, those with most core fields first."""
    score = sum((present(f).cast("int") for f in STRICT_FIELDS), F.lit(0))
    return (
        records.filter(~present("data_origin"))
        .withColumn("score", score)
        .select("session_id", "runtime", "task_type", "task_source", "success", "topology", "score")
        .orderBy(F.desc("score"), "session_id")
        .limit(limit)
    )


# -- groups and benchmarks ---------------------------------------------------


def label_column(label: str) -> Column:
    """Metadata label with ``unknown`` for empty (and, as a label, for false)."""
    if schema.METADATA_FIELDS.get(label) == "boolean":
        return F.when(F.col(label), "True").otherwise("unknown")
    return F.coalesce(F.nullif(F.col(label).cast("string"), F.lit("")), F.lit("unknown"))


def group_sessions(records: DataFrame, label: str = "task_type") -> DataFrame:
    """(label, session_id) rows."""
    return records.select(label_column(label).alias("label"), "session_id")


def benchmark_manifest(records: DataFrame, label: str = "task_type") -> DataFrame:
    """Rows (section, label, key, value): sizes, runtime and topology counts per label.

    Label ``*`` stands for the whole benchmark.
    """
    def hit(section: str, lab: Column, key: Column, cond: Column | None = None) -> Column:
        s = F.struct(F.lit(section).alias("section"), lab.alias("label"), key.alias("key"))
        return s if cond is None else F.when(cond, s)

    lab, every = label_column(label), F.lit("*")
    rt, topo = present("runtime"), F.coalesce("topology", F.lit("")) != ""
    pairs = []
    for who in (lab, every):
        pairs += [
            hit("sessions", who, F.lit("")),
            hit("runtime", who, F.col("runtime"), rt),
            hit("topology", who, F.col("topology"), topo),
        ]
    return (
        records.select(F.inline(F.array_compact(F.array(*pairs))))
        .groupBy("section", "label", "key")
        .agg(F.count("*").alias("value"))
    )


def benchmark_hash(manifest: DataFrame, members: DataFrame) -> DataFrame:
    """One digest over the counts and the members, independent of row order."""
    rows = manifest.select(
        F.concat_ws("\u001f", "section", "label", "key", F.col("value").cast("string")).alias("t")
    ).unionByName(members.select(F.concat_ws("\u001f", "label", "session_id").alias("t")))
    return rows.agg(set_digest(F.col("t")).alias("benchmark_hash"))


def verify_benchmark(manifest: DataFrame, members: DataFrame, expected_hash: str | None = None) -> DataFrame:
    """Rows (check, subject, expected, actual) for everything that does not add up."""
    sizes = members.groupBy("label").agg(F.count("*").alias("actual"))
    groups = (
        manifest.filter("section = 'sessions' AND label <> '*'")
        .select("label", F.col("value").alias("expected"))
        .join(sizes, "label", "full")
        .filter("NOT (expected <=> actual)")
        .select(F.lit("group_size").alias("check"), F.col("label").alias("subject"), "expected", "actual")
    )
    twice = (
        members.groupBy("session_id")
        .agg(F.count("*").alias("actual"))
        .filter("actual > 1")
        .select(
            F.lit("duplicate_session").alias("check"),
            F.col("session_id").alias("subject"),
            F.lit(1).cast("bigint").alias("expected"),
            "actual",
        )
    )
    stated = manifest.filter("section = 'sessions' AND label = '*'").select(
        F.col("value").alias("expected"), F.lit(0).cast("bigint").alias("actual")
    )
    counted = members.agg(F.count("*").alias("actual")).select(
        F.lit(0).cast("bigint").alias("expected"), "actual"
    )
    total = (
        stated.unionByName(counted)
        .agg(F.sum("expected").alias("expected"), F.sum("actual").alias("actual"))
        .filter("expected <> actual")
        .select(F.lit("total").alias("check"), F.lit("*").alias("subject"), "expected", "actual")
    )
    out = groups.unionByName(twice).unionByName(total)
    if expected_hash is not None:
        bad = benchmark_hash(manifest, members).filter(F.col("benchmark_hash") != expected_hash)
        out = out.unionByName(
            bad.select(
                F.lit("hash").alias("check"),
                F.lit("*").alias("subject"),
                F.lit(1).cast("bigint").alias("expected"),
                F.lit(0).cast("bigint").alias("actual"),
            )
        )
    return out


def distribution_distance(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Half the L1 distance of two count tables (``by``, key, n); 1 if just one is empty."""
    both = a.select(*by, "key", F.col("n").alias("na")).join(
        b.select(*by, "key", F.col("n").alias("nb")), [*by, "key"], "full"
    )
    both = both.fillna(0, ["na", "nb"])
    totals = both.groupBy(*by).agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    joined = both.join(totals, list(by))
    share = F.abs(
        F.col("na") / F.greatest("ta", F.lit(1)) - F.col("nb") / F.greatest("tb", F.lit(1))
    )
    empty = (F.min("ta") == 0) | (F.min("tb") == 0)
    return joined.groupBy(*by).agg(
        F.when(empty, F.when(F.min("ta") == F.min("tb"), 0.0).otherwise(1.0))
        .otherwise(F.sum(share) / 2)
        .alias("distance")
    )


def compare_benchmarks(
    manifest_a: DataFrame, members_a: DataFrame, manifest_b: DataFrame, members_b: DataFrame
) -> DataFrame:
    """Rows (what, side, value): shared and one-sided sessions and labels, distances."""
    def overlap(a: DataFrame, b: DataFrame, key: str, what: str) -> DataFrame:
        both = (
            a.select(key).distinct().withColumn("a", F.lit(1))
            .join(b.select(key).distinct().withColumn("b", F.lit(1)), key, "full")
        )
        side = F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").otherwise("shared")
        return both.groupBy(side.alias("side")).agg(F.count("*").cast("double").alias("value")).select(
            F.lit(what).alias("what"), "side", "value"
        )

    def counts(m: DataFrame) -> DataFrame:
        return m.filter("label = '*' AND section IN ('runtime', 'topology')").select(
            "section", "key", F.col("value").alias("n")
        )

    distance = distribution_distance(counts(manifest_a), counts(manifest_b), ["section"]).select(
        F.concat("section", F.lit("_distance")).alias("what"),
        F.lit("").alias("side"),
        F.round("distance", 4).alias("value"),
    )
    return (
        overlap(members_a, members_b, "session_id", "sessions")
        .unionByName(overlap(members_a, members_b, "label", "labels"))
        .unionByName(distance)
    )


def benchmark_overlap(members_a: DataFrame, members_b: DataFrame) -> dict[str, DataFrame]:
    """The session ids themselves: shared, only in the first, only in the second."""
    a, b = members_a.select("session_id"), members_b.select("session_id")
    return {"shared": a.intersect(b), "only_a": a.exceptAll(b), "only_b": b.exceptAll(a)}


# -- taxonomy ----------------------------------------------------------------


def taxonomy(features: DataFrame) -> DataFrame:
    """Structural tags of each session and the one that names it best."""
    topo, s = F.col("topology"), _signals()
    fan_avg = F.round("fan_out_avg", 2)
    rules = [
        ("deep_linear", (topo == "dominant_chain") & (F.col("max_depth") >= 4) & (fan_avg < 1.5)),
        ("branchy", (topo == "fan_out_heavy") | (F.col("fan_out_max") >= 4) | s["frontier_wide_sessions"]),
        ("branch_collapse", (topo == "collapsed_repair") | F.col("collapsed")),
        ("fan_in", s["fan_in_sessions"]),
        ("retry_heavy", s["retry_heavy_sessions"]),
        ("multi_root_exploration", (topo == "multi_root_exploration") | s["multi_root_sessions"]),
        ("long_session", s["long_sessions_100"]),
    ]
    tags = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]))
    df = features.withColumn("tags", tags).withColumn(
        "tags", F.when(F.size("tags") == 0, F.array(topo)).otherwise(F.col("tags"))
    )
    primary = F.coalesce(
        *[F.when(F.array_contains("tags", name), F.lit(name)) for name in TAXONOMY_PRIORITY], topo
    )
    return df.withColumn("primary_taxonomy", primary)


def taxonomy_manifest(rows: DataFrame) -> DataFrame:
    """Rows (label, section, key, value) per primary label and, as ``*``, overall.

    ``rows`` is ``taxonomy`` joined with ``runtime`` and ``task_type``.
    """
    def hit(who: Column, section: str, key: Column, cond: Column) -> Column:
        return F.when(
            cond, F.struct(who.alias("label"), F.lit(section).alias("section"), key.alias("key"))
        )

    pairs = []
    for who in (F.col("primary_taxonomy"), F.lit("*")):
        pairs.append(hit(who, "sessions", F.lit(""), F.lit(True)))
        for f in ("runtime", "topology", "task_type"):
            pairs.append(hit(who, f, F.col(f), F.coalesce(F.col(f), F.lit("")) != ""))
    flat = F.array_compact(F.array(*pairs))

    def tagged(who: Column) -> Column:
        return F.transform(
            "tags", lambda t: F.struct(who.alias("label"), F.lit("tag").alias("section"), t.alias("key"))
        )

    full = F.concat(flat, tagged(F.col("primary_taxonomy")), tagged(F.lit("*")))
    return rows.select(F.inline(full)).groupBy("label", "section", "key").agg(F.count("*").alias("value"))


def manifest_digest(rows: DataFrame) -> DataFrame:
    """Order-independent digest of any manifest-like table."""
    return rows.select(row_text(rows).alias("t")).agg(
        set_digest(F.col("t")).alias("digest"), F.count("*").alias("rows")
    )


# -- coverage ----------------------------------------------------------------


def provenance_audit(metadata: DataFrame, provenance: DataFrame) -> DataFrame:
    """Per field how many sessions have it from which source, ``missing`` included."""
    rows = long_fields(metadata, [*STRICT_FIELDS, *OPTIONAL_FIELDS])
    source = F.when(~F.col("given"), "missing").otherwise(F.coalesce("source", F.lit("unknown")))
    return (
        rows.join(provenance, ["session_id", "field"], "left")
        .groupBy("field", source.alias("source"))
        .agg(F.count("*").alias("sessions"))
    )


def research_gaps(metadata: DataFrame, provenance: DataFrame) -> DataFrame:
    """Missing and untrusted core fields and missing optional fields of each session."""
    rows = long_fields(metadata, [*STRICT_FIELDS, *OPTIONAL_FIELDS]).join(
        provenance, ["session_id", "field"], "left"
    )
    strict = F.col("field").isin(*STRICT_FIELDS)
    trusted = F.coalesce(F.col("source").isin(*TRUSTED_SOURCES), F.lit(False))
    kind = (
        F.when(strict & ~F.col("given"), "missing_strict")
        .when(strict & ~trusted, "untrusted_strict")
        .when(~strict & ~F.col("given"), "missing_optional")
    )

    def listed(name: str) -> Column:
        fields = F.sort_array(F.collect_list(F.when(kind == name, F.col("field"))))
        return F.array_join(fields, ",").alias(name)

    names = ("missing_strict", "untrusted_strict", "missing_optional")
    return rows.groupBy("session_id").agg(
        *[F.count_if(kind == n).alias(f"n_{n}") for n in names], *[listed(n) for n in names]
    )


def research_grade(metadata: DataFrame, provenance: DataFrame) -> DataFrame:
    """Number of sessions whose core fields are all given and trusted."""
    ok = (F.col("n_missing_strict") == 0) & (F.col("n_untrusted_strict") == 0)
    return research_gaps(metadata, provenance).agg(
        F.count_if(ok).alias("strict_research_grade_sessions"), F.count("*").alias("sessions")
    )


def near_misses(metadata: DataFrame, provenance: DataFrame, limit: int = 10) -> DataFrame:
    """Sessions closest to research grade, by number of gaps."""
    n = [F.col(f"n_{k}") for k in ("missing_strict", "untrusted_strict", "missing_optional")]
    return (
        research_gaps(metadata, provenance)
        .filter((n[0] > 0) | (n[1] > 0))
        .withColumn("missing_total", n[0] + n[1] + n[2])
        .orderBy("missing_total", *n, "session_id")
        .limit(limit)
        .select("session_id", "missing_strict", "untrusted_strict", "missing_optional", "missing_total")
    )


def corpus_report(kind: str, **tables: DataFrame) -> DataFrame:
    """Rows (section, key, value) behind the ``health``, ``origin`` or ``readiness`` report."""
    def rows(df: DataFrame, section: str | Column, key: Column, value: Column) -> DataFrame:
        section = F.lit(section) if isinstance(section, str) else section
        return df.select(section.alias("section"), key.alias("key"), value.cast("string").alias("value"))

    if kind == "origin":
        return rows(tables["source_facts"], F.col("fact"), F.col("key"), F.col("value")).unionByName(
            rows(tables["missing"], "missing_candidates", F.col("session_id"), F.col("score"))
        )
    facts, misses, strict = tables["facts"], tables["near_misses"], tables["strict"]
    parts = [
        rows(facts, F.col("fact"), F.col("key"), F.col("value")),
        rows(misses, "near_misses", F.col("session_id"), F.col("missing_total")),
        rows(
            strict,
            "strict_research_grade_sessions",
            F.lit(""),
            F.col("strict_research_grade_sessions"),
        ),
    ]
    if kind == "health":
        audit = tables["audit"]
        parts.append(rows(milestones(facts), "milestones", F.col("key"), F.col("remaining")))
        parts.append(
            rows(audit, F.concat(F.lit("audit."), F.col("field")), F.col("source"), F.col("sessions"))
        )
    elif kind == "readiness":
        criteria = readiness(facts)
        parts.append(rows(criteria, "criteria", F.col("key"), F.col("passed")))
        parts.append(
            rows(criteria.filter("NOT passed"), "blockers", F.col("key"), F.col("remaining"))
        )
        parts.append(rows(ready(criteria), "ready", F.lit(""), F.col("ready")))
    else:
        raise ValueError(f"unknown report kind: {kind}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# -- snapshots ---------------------------------------------------------------


def session_parts(events: DataFrame, records: DataFrame) -> DataFrame:
    """Roots of each session's hash trees: ``session_id, part, rows, digest``.

    Part ``events`` covers every event in order, ``structure`` and ``metadata`` the fields of its record.
    """
    meta = [c for c in schema.METADATA_FIELDS if c in records.columns]
    rest = [c for c in records.columns if c not in meta and c != "session_id"]
    leaves = events.select("session_id", F.lit("events").alias("part"), "pos", F.sha2(content_text(events), 256).alias("leaf"))
    for part, fields in (("structure", rest), ("metadata", meta)):
        if fields:
            leaves = leaves.unionByName(field_leaves(records, part, fields))
    return tree_roots(leaves)


def snapshot(events: DataFrame, records: DataFrame | Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """Write events, records, their parts' digests and a one-row manifest under ``path``; return the manifest.

    ``records`` may be a function of the written events, so that they need not be written twice.
    """
    spark = events.sparkSession
    if callable(records):
        events.write.mode("overwrite").parquet(f"{path}/events")
        records = cut(records(spark.read.parquet(f"{path}/events")))
    else:
        records = cut(records)
        events.write.mode("overwrite").parquet(f"{path}/events")
    records.write.mode("overwrite").parquet(f"{path}/records")
    parts = session_parts(spark.read.parquet(f"{path}/events"), records)
    parts.write.mode("overwrite").parquet(f"{path}/parts")
    manifest = manifest_digest(spark.read.parquet(f"{path}/parts")).withColumnRenamed("digest", "snapshot_hash")
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def export_dataset(records: DataFrame, path: str) -> None:
    """Session records as JSON lines."""
    records.write.mode("overwrite").json(path)


def verify_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Recompute a snapshot's digests; rows (subject, issue), empty when it is intact.

    An issue names the session and the part that differs; ``*`` stands for the manifest itself.
    """
    stated = spark.read.parquet(f"{path}/parts")
    found = session_parts(spark.read.parquet(f"{path}/events"), spark.read.parquet(f"{path}/records"))
    of_events, change = F.col("part") == "events", F.col("change")
    issue = (
        F.when(of_events & (change == "removed"), "missing session events")
        .when(of_events & (change == "added"), "events without a record")
        .when(of_events, "session hash mismatch")
        .otherwise(F.concat_ws(" ", "part", F.when(change == "changed", "mismatch").otherwise(change)))
    )
    per = differing_parts(stated, found).select(F.col("session_id").alias("subject"), issue.alias("issue"))
    whole = (
        manifest_digest(stated)
        .join(spark.read.parquet(f"{path}/manifest").select(F.col("snapshot_hash").alias("digest")), "digest", "left_anti")
        .select(F.lit("*").alias("subject"), F.lit("manifest hash mismatch").alias("issue"))
    )
    return per.unionByName(whole)
