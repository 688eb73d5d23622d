"""Session labels: validation, merging, provenance, tags and lanes.

A sidecar table holds explicit metadata, an annotation table holds manual labels. Both
have one row per session; a null means the field was not given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein import schema
from skein.functions.columns import is_empty

# Fields an annotation may supply, and the comparable core fields.
ANNOTATION_FIELDS = (
    "data_origin",
    "runtime",
    "model",
    "task_type",
    "task_source",
    "repo_language",
    "repo_size",
    "success",
    "duration",
    "human_intervention",
)
CANONICAL_FIELDS = (
    "runtime",
    "model",
    "task_type",
    "task_source",
    "repo_language",
    "repo_size",
    "success",
    "duration",
    "human_intervention",
)
STRICT_FIELDS = ("runtime", "task_type", "task_source", "success")
OPTIONAL_FIELDS = ("model", "repo_language", "repo_size", "duration", "human_intervention")
TRUSTED_SOURCES = ("explicit_sidecar", "annotation")
TRUE_WORDS = ("1", "true", "yes", "y")
FALSE_WORDS = ("0", "false", "no", "n")
GATE_SESSIONS = 5


def complete(df: DataFrame) -> DataFrame:
    """Add the metadata fields a table lacks as typed nulls."""
    cols = [
        (F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n)
        for n, t in schema.METADATA_FIELDS.items()
    ]
    return df.select("session_id", *cols)


def present(name: str) -> Column:
    return ~is_empty(name, schema.METADATA_FIELDS[name])


def validate_metadata(raw: DataFrame) -> DataFrame:
    """Typed metadata from text columns plus the list of rules each row breaks.

    A value that breaks its rule becomes null.
    """
    df = raw
    problems = []
    enums = {
        "data_origin": schema.DATA_ORIGINS,
        "task_type": schema.TASK_TYPES,
        "task_source": schema.TASK_SOURCES,
        "intervention_lane": schema.INTERVENTION_LANES,
    }
    for name, values in enums.items():
        if name in raw.columns:
            bad = F.col(name).isNotNull() & ~F.col(name).isin(*values)
            problems.append(F.when(bad, F.concat(F.lit(f"unknown {name}: "), F.col(name))))
            df = df.withColumn(f"_{name}", F.when(~bad, F.col(name)))
    for name in ("success", "human_intervention", "bde_generated"):
        if name in raw.columns:
            word = F.lower(F.col(name).cast("string"))
            value = F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)
            bad = F.col(name).isNotNull() & value.isNull()
            problems.append(F.when(bad, F.lit(f"{name} must be a boolean")))
            df = df.withColumn(f"_{name}", value)
    if "duration" in raw.columns:
        number = F.expr("try_cast(duration AS double)")
        bad = F.col("duration").isNotNull() & number.isNull()
        problems.append(F.when(bad, F.lit("duration must be a number of seconds")))
        problems.append(F.when(number < 0, F.lit("duration must be non-negative")))
        df = df.withColumn("_duration", F.when(number >= 0, number))
    issues = F.array_compact(F.array(*problems)) if problems else F.array()
    df = df.withColumn("violations", issues)
    return df.select(
        *[F.col(f"_{n}").alias(n) if f"_{n}" in df.columns else F.col(n) for n in raw.columns],
        "violations",
    )


def mapped_annotation(annotation: DataFrame) -> DataFrame:
    """Annotation in metadata terms; ``source`` stands in for a missing task source."""
    df = annotation
    if "source" in df.columns:
        own = F.col("task_source") if "task_source" in df.columns else F.lit(None)
        df = df.withColumn("task_source", F.coalesce(own.cast("string"), F.col("source")))
    keep = [c for c in ANNOTATION_FIELDS if c in df.columns]
    return complete(df.select("session_id", *keep))


def merge_metadata(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Fields of ``updates`` that are given win over the current ones."""
    cur, new = complete(current).alias("c"), complete(updates).alias("u")
    return cur.join(new, "session_id", "full").select(
        "session_id",
        *[F.coalesce(F.col(f"u.{n}"), F.col(f"c.{n}")).alias(n) for n in schema.METADATA_FIELDS],
    )


def effective_metadata(sidecar: DataFrame, annotation: DataFrame) -> DataFrame:
    """Metadata in force: the sidecar field where given, else the annotation's."""
    return merge_metadata(mapped_annotation(annotation), sidecar)


def long_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows (session_id, field, given) for the named metadata fields."""
    entries = F.array(
        *[F.struct(F.lit(f).alias("field"), present(f).alias("given")) for f in fields]
    )
    return complete(df).select("session_id", F.inline(entries))


def normal_source(col: Column | str) -> Column:
    value = F.lower(F.trim(F.col(col) if isinstance(col, str) else col))
    return F.when(value.isin(*schema.PROVENANCE_VALUES), value).otherwise("unknown")


def field_provenance(
    sidecar: DataFrame, annotation: DataFrame, stored: DataFrame | None = None
) -> DataFrame:
    """Rows (session_id, field, source): recorded provenance, else derived from presence."""
    fields = list(schema.METADATA_FIELDS)

    def given(df: DataFrame) -> DataFrame:
        entries = F.array(
            *[
                F.struct(F.lit(f).alias("field"), F.col(f).isNotNull().alias("given"))
                for f in fields
            ]
        )
        return df.select("session_id", F.inline(entries)).filter("given").drop("given")

    own = given(complete(sidecar)).withColumn("rank", F.lit(1))
    noted = given(mapped_annotation(annotation)).withColumn("rank", F.lit(2))
    derived = (
        own.unionByName(noted)
        .groupBy("session_id", "field")
        .agg(F.min("rank").alias("rank"))
        .select(
            "session_id",
            "field",
            F.when(F.col("rank") == 1, "explicit_sidecar").otherwise("annotation").alias("source"),
        )
    )
    if stored is None:
        return derived
    kept = stored.filter(F.col("field").isin(*fields)).select(
        "session_id", "field", normal_source("source").alias("source")
    )
    return kept.unionByName(derived.join(kept.select("session_id"), "session_id", "left_anti"))


def merge_provenance(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Per field the updated source where given, normalised."""
    new = updates.select("session_id", "field", normal_source("source").alias("_new"))
    return current.join(new, ["session_id", "field"], "full").select(
        "session_id", "field", F.coalesce("_new", "source").alias("source")
    )


def provenance_map(rows: DataFrame) -> DataFrame:
    """One map per session from field to source."""
    return rows.groupBy("session_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "source")))).alias(
            "provenance"
        )
    )


# -- tags and lanes ----------------------------------------------------------

LINE = "\n"


def _tag_fields(text: Column, key: str) -> Column:
    block = F.regexp_extract(text, rf"(?i){key}:\s*\n((?:\s+-\s+\S+\n?)+)", 1)
    lines = F.transform(F.split(F.trim(block), LINE), lambda x: F.trim(x))
    tags = F.transform(
        F.filter(lines, lambda x: F.startswith(x, F.lit("- "))),
        lambda x: F.trim(F.substring(x, 3, 1 << 30)),
    )
    lane = F.nullif(F.regexp_extract(text, r"(?i)intervention_lane:\s*(\S+)", 1), F.lit(""))
    level = F.nullif(F.regexp_extract(text, r"(?i)evidence_level:\s*(\S+)", 1), F.lit(""))
    return F.struct(tags.alias("tags"), lane.alias("intervention_lane"), level.alias("evidence_level"))


def detect_tags(events: DataFrame, key: str = "trace_tags") -> DataFrame:
    """First tag block of each session; an event's input is read before its output."""
    both = F.array(
        F.struct(F.lit(0).alias("side"), F.col("tool_input").alias("raw")),
        F.struct(F.lit(1).alias("side"), F.col("tool_output").alias("raw")),
    )
    rows = events.select("session_id", "pos", F.inline(both)).filter(F.col("raw").contains(key))
    text = F.replace(F.col("raw"), F.lit("\\n"), F.lit(LINE))
    found = rows.select("session_id", "pos", "side", _tag_fields(text, key).alias("f")).filter(
        (F.size("f.tags") > 0)
        | F.col("f.intervention_lane").isNotNull()
        | F.col("f.evidence_level").isNotNull()
    )
    return (
        found.groupBy("session_id")
        .agg(F.min_by("f", F.col("pos") * 2 + F.col("side")).alias("f"))
        .select("session_id", "f.*")
    )


def auto_lane(tags: Column | str) -> Column:
    """Lane implied by a tag list; workflow tags before routing tags before prompt tags."""
    tags = F.col(tags) if isinstance(tags, str) else tags

    def has(*names: str) -> Column:
        return F.arrays_overlap(tags, F.array(*[F.lit(n) for n in names]))

    return (
        F.when(
            has("superpowers-workflow", "workflow-intervention"), "superpowers_workflow_intervention"
        )
        .when(has("prompt-routing", "routed-prompt"), "routed_prompt_intervention")
        .when(has("controlled-prompt-morphology", "prompt-pilot"), "controlled_prompt_morphology")
    )


def auto_lane_updates(events: DataFrame, key: str = "trace_tags") -> DataFrame:
    """Metadata updates for the sessions whose tags imply a lane."""
    lane = auto_lane("tags")
    return (
        detect_tags(events, key)
        .withColumn("lane", lane)
        .filter("lane IS NOT NULL")
        .select(
            "session_id",
            F.col("lane").alias("task_source"),
            F.col("lane").alias("intervention_lane"),
            F.col("tags").alias("trace_tags"),
            F.col("evidence_level").alias("intervention_evidence_level"),
            F.lit("auto-detected").alias("intervention_evidence_source"),
        )
    )


def unannotated(sessions: DataFrame, annotation: DataFrame) -> DataFrame:
    return sessions.select("session_id").distinct().join(annotation, "session_id", "left_anti")


NATIVE_ORIGINS = ("native", "real_work", "direct_prompt_native")


def lane_counts(sidecar: DataFrame, events: DataFrame) -> DataFrame:
    """Sessions and events per intervention lane."""
    source, origin = F.col("task_source"), F.col("data_origin")
    lane = (
        F.when(source.isin(*schema.INTERVENTION_SOURCES), source)
        .when(origin.isin(*NATIVE_ORIGINS) & (source == "real_work"), "direct_prompt_native")
        .otherwise("unlabeled")
    )
    sizes = events.groupBy("session_id").agg(F.count("*").alias("n"))
    return (
        complete(sidecar)
        .join(sizes, "session_id", "left")
        .groupBy(lane.alias("lane"))
        .agg(F.count("*").alias("sessions"), F.coalesce(F.sum("n"), F.lit(0)).alias("events"))
    )


def classify_unlabeled(sidecar: DataFrame, min_confidence: str = "high") -> DataFrame:
    """Proposed lane, confidence and evidence (or the skip reason) of sessions without one, as codes.

    Evidence: ``origin`` alone, ``native_real_work_unmarked`` or ``native_unmarked``. A session
    is skipped as ``marked`` if it carries trace tags, and as ``no_rule`` else; the fields that
    the rules look at are in the row.
    """
    df = complete(sidecar)
    source, origin = F.coalesce("task_source", F.lit("")), F.coalesce("data_origin", F.lit(""))
    lane = F.coalesce("intervention_lane", F.lit(""))
    marked = present("trace_tags")
    open_rows = df.filter(~source.isin(*schema.INTERVENTION_SOURCES) & (lane == ""))
    native = (origin == "native") & (source == "real_work")
    likely = (origin == "native") & (source == "") & F.lit(min_confidence == "medium")
    proposed = (
        F.when(origin == "external_trajectory", "external_trajectory")
        .when(origin == "controlled_benchmark", "controlled_prompt_morphology")
        .when((native | likely) & ~marked, "direct_prompt_native")
    )
    confidence = F.when(
        proposed.isNotNull(), F.when(likely, "medium").otherwise("high")
    )
    evidence = (
        F.when(origin.isin("external_trajectory", "controlled_benchmark"), "origin")
        .when(native & ~marked, "native_real_work_unmarked")
        .when(likely & ~marked, "native_unmarked")
    )
    reason = F.when(proposed.isNull(), F.when(native | likely, "marked").otherwise("no_rule"))
    return open_rows.select(
        "session_id",
        proposed.alias("proposed_lane"),
        confidence.alias("confidence"),
        evidence.alias("evidence"),
        reason.alias("skip_reason"),
        "data_origin",
        "task_source",
        "runtime",
    )


def classify_summary(sidecar: DataFrame, min_confidence: str = "high") -> DataFrame:
    """Coverage before and after applying the high-confidence proposals."""
    proposals = classify_unlabeled(sidecar, min_confidence)
    rows = complete(sidecar).select("session_id").join(proposals, "session_id", "left")
    known = proposals.select("session_id", F.lit(1).alias("open"))
    return (
        rows.join(known, "session_id", "left")
        .agg(
            F.count("*").alias("scanned"),
            F.count("open").alias("unlabeled"),
            F.count("proposed_lane").alias("proposed"),
            F.count_if(F.col("confidence") == "high").alias("applicable"),
        )
        .select(
            "*",
            ((F.col("scanned") - F.col("unlabeled")) / F.col("scanned")).alias("coverage_before"),
            (
                (F.col("scanned") - F.col("unlabeled") + F.col("applicable")) / F.col("scanned")
            ).alias("coverage_after"),
        )
    )


def apply_classification(sidecar: DataFrame) -> DataFrame:
    """Sidecar with the high-confidence lanes filled in."""
    sure = classify_unlabeled(sidecar).filter("confidence = 'high'")
    return merge_metadata(
        sidecar, sure.select("session_id", F.col("proposed_lane").alias("intervention_lane"))
    )


def gate_status(sidecar: DataFrame, events: DataFrame, key: str = "trace_tags") -> DataFrame:
    """Tagged sessions per lane against the required number, and tag mentions in events."""
    spark = sidecar.sparkSession
    lanes = spark.createDataFrame([(s,) for s in schema.INTERVENTION_SOURCES], "lane string")
    mention = F.coalesce(F.col("tool_input"), F.lit("")).contains(key) | F.coalesce(
        F.col("tool_output"), F.lit("")
    ).contains(key)
    hits = events.filter(mention).select("session_id", F.lit(1).alias("hit")).distinct()
    per = (
        complete(sidecar)
        .filter(F.col("task_source").isin(*schema.INTERVENTION_SOURCES))
        .join(hits, "session_id", "left")
        .groupBy(F.col("task_source").alias("lane"))
        .agg(F.count_if(present("trace_tags")).alias("tagged"), F.count("hit").alias("event_hits"))
    )
    return (
        lanes.join(per, "lane", "left")
        .fillna(0, ["tagged", "event_hits"])
        .withColumn("required", F.lit(GATE_SESSIONS))
        .withColumn("gate", F.when(F.col("tagged") >= GATE_SESSIONS, "OPEN").otherwise("BLOCKED"))
    )


def trigger_status(sidecar: DataFrame) -> DataFrame:
    """Eight growth triggers with up to two current values each."""
    source, origin = F.coalesce("task_source", F.lit("")), F.coalesce("data_origin", F.lit(""))
    lane = (
        F.when(source.isin(*schema.INTERVENTION_SOURCES), source)
        .when((source == "real_work") | origin.isin(*NATIVE_ORIGINS), "native")
        .otherwise("unlabeled")
    )
    named = F.coalesce("runtime", F.lit("")) != ""
    df = complete(sidecar).withColumn("_lane", lane)
    strict = (
        (F.col("_lane") == "native")
        & ~present("trace_tags")
        & ~F.coalesce("intervention_lane", F.lit("")).isin(*schema.INTERVENTION_SOURCES)
    )
    per = (
        df.withColumn("_strict", strict)
        .groupBy("_lane", "_strict", F.when(named, F.col("runtime")).alias("rt"))
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("success") == F.lit(False)).alias("failed"),
            F.count_if(F.col("human_intervention")).alias("helped"),
            F.count_if(present("trace_tags") | present("intervention_evidence_source")).alias("noted"),
        )
    )

    def total(cond: Column, what: str = "n") -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col(what))), F.lit(0))

    is_lane = {name: F.col("_lane") == name for name in (*schema.INTERVENTION_SOURCES, "native", "unlabeled")}
    strict_rt = F.col("_strict") & F.col("rt").isNotNull()
    one = per.agg(
        total(F.col("_strict")).alias("strict"),
        total(is_lane["native"], "failed").alias("failed"),
        total(is_lane["native"], "helped").alias("helped"),
        total(is_lane["native"], "noted").alias("noted"),
        total(is_lane["routed_prompt_intervention"]).alias("routed"),
        total(is_lane["controlled_prompt_morphology"]).alias("controlled"),
        total(is_lane["superpowers_workflow_intervention"]).alias("workflow"),
        F.count_distinct(
            F.when(is_lane["superpowers_workflow_intervention"], F.col("rt"))
        ).alias("workflow_rt"),
        F.max(F.when(strict_rt, F.col("n"))).alias("top_rt"),
        total(strict_rt).alias("all_rt"),
        F.count_if(strict_rt & (F.col("n") >= 5)).alias("rt5"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        total(is_lane["unlabeled"]).alias("unlabeled"),
    )
    share = F.coalesce(F.col("top_rt") / F.col("all_rt") * 100, F.lit(100.0))
    labeled = (F.col("total") - F.col("unlabeled")) / F.greatest(F.col("total"), F.lit(1)) * 100

    def row(i: int, name: str, a: Column, b: Column | None, met: Column) -> Column:
        second = F.lit(None) if b is None else b
        return F.struct(
            F.lit(i).alias("trigger"),
            F.lit(name).alias("name"),
            a.cast("double").alias("current"),
            second.cast("double").alias("current_2"),
            met.alias("met"),
        )

    c = F.col
    rows = F.array(
        row(1, "Native strict growth", c("strict"), None, c("strict") >= 150),
        row(2, "Failure/near-failure threshold", c("failed"), c("helped"), (c("failed") >= 10) & (c("helped") >= 10)),
        row(3, "Routed-prompt gate", c("routed"), None, c("routed") >= 5),
        row(4, "Controlled prompt expansion", c("controlled"), None, c("controlled") >= 10),
        row(5, "Workflow lane growth", c("workflow"), c("workflow_rt"), (c("workflow") >= 15) & (c("workflow_rt") >= 2)),
        row(6, "Safety-control annotation", c("noted"), None, c("noted") >= 10),
        row(7, "Runtime balance", share, c("rt5"), (share < 60) & (c("rt5") >= 4)),
        row(8, "Metadata density", labeled, None, labeled >= 40),
    )
    return one.select(F.inline(rows))


def infer_runtime(events: DataFrame) -> DataFrame:
    """Most frequent agent-or-provider label; the earlier seen wins a tie."""
    label = F.lower(
        F.trim(F.coalesce(F.nullif("agent", F.lit("")), F.nullif("provider", F.lit(""))))
    )
    counts = (
        events.select("session_id", "pos", label.alias("label"))
        .filter("label IS NOT NULL")
        .groupBy("session_id", "label")
        .agg(F.count("*").alias("n"), F.min("pos").alias("seen"))
    )
    return counts.groupBy("session_id").agg(
        F.max_by("label", F.struct("n", -F.col("seen"))).alias("runtime")
    )


def materialize_metadata(events: DataFrame, sidecar: DataFrame, annotation: DataFrame) -> DataFrame:
    """Effective metadata of every session in ``events`` with the runtime filled in.

    ``changed`` marks rows that differ from the sidecar, ``runtime_inferred`` and
    ``from_annotation`` say why.
    """
    own = complete(sidecar)
    eff = effective_metadata(sidecar, annotation)
    sessions = events.select("session_id").distinct()
    names = list(schema.METADATA_FIELDS)
    guess = infer_runtime(events).withColumnRenamed("runtime", "_guess")
    given = own.select("session_id", *[F.col(n).alias(f"_own_{n}") for n in names])
    df = (
        sessions.join(eff, "session_id", "left")
        .join(given, "session_id", "left")
        .join(guess, "session_id", "left")
    )
    filled = ~present("runtime") & F.col("_guess").isNotNull()
    df = df.withColumn("runtime_inferred", F.coalesce(filled, F.lit(False))).withColumn(
        "runtime", F.when(F.col("runtime_inferred"), F.col("_guess")).otherwise(F.col("runtime"))
    )
    noted = [n for n in CANONICAL_FIELDS if n != "runtime"]

    def differs(cols: Sequence[str]) -> Column:
        return F.array_contains(
            F.array(*[F.col(n).isNotNull() & ~F.col(n).eqNullSafe(F.col(f"_own_{n}")) for n in cols]), True
        )

    return df.withColumn("changed", differs(names)).withColumn(
        "from_annotation", differs(noted)
    ).select("session_id", *names, "changed", "runtime_inferred", "from_annotation")


def materialized_provenance(materialized: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Source of each comparable field after materialisation."""
    rows = long_fields(materialized, CANONICAL_FIELDS).filter("given").drop("given")
    own = long_fields(sidecar, CANONICAL_FIELDS).filter("given").withColumnRenamed("given", "own")
    guessed = materialized.filter("runtime_inferred").select(
        "session_id", F.lit("runtime").alias("field"), F.lit(True).alias("guessed")
    )
    source = (
        F.when(F.col("guessed"), "inferred_from_runtime_adapter")
        .when(F.col("own"), "explicit_sidecar")
        .otherwise("materialized")
    )
    return (
        rows.join(own, ["session_id", "field"], "left")
        .join(guessed, ["session_id", "field"], "left")
        .select("session_id", "field", source.alias("source"))
    )


def materialize_summary(materialized: DataFrame) -> DataFrame:
    return materialized.agg(
        F.count("*").alias("selected"),
        F.count_if("changed").alias("updated"),
        F.count_if("runtime_inferred").alias("runtime_inferred"),
        F.count_if("from_annotation").alias("from_annotation"),
    )
