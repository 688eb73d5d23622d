"""Validation, invariants and content-based upsert of event tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.columns import fingerprint, iso_timestamp
from skein.operators.edges import edges
from skein.operators.graph import TraceGraph
from skein.operators.lineage import cut
from skein.operators.structure import cycle_nodes

EXTERNAL_PREFIX = "root_"


def broken_refs(events: DataFrame) -> DataFrame:
    """Listed parents that are neither in the session nor marked as external roots."""
    listed = events.select("session_id", "event_id", F.explode("parents").alias("parent"))
    known = events.select("session_id", F.col("event_id").alias("parent"))
    return listed.filter(~F.col("parent").startswith(EXTERNAL_PREFIX)).join(
        known, ["session_id", "parent"], "left_anti"
    ).select("session_id", "event_id", "parent")


def orphans(events: DataFrame) -> DataFrame:
    """Events that list parents, none of them in the session."""
    linked = edges(events).select("session_id", F.col("child").alias("event_id"))
    return (
        events.filter(F.size("parents") > 0)
        .select("session_id", "event_id")
        .join(linked, ["session_id", "event_id"], "left_anti")
    )


def duplicate_ids(events: DataFrame) -> DataFrame:
    return (
        events.groupBy("session_id", "event_id")
        .agg(F.count("*").alias("copies"))
        .filter("copies > 1")
    )


def bad_timestamps(events: DataFrame) -> DataFrame:
    return events.filter(iso_timestamp("timestamp").isNull()).select(
        "session_id", "event_id", "timestamp"
    )


def line_issues(raw: DataFrame) -> DataFrame:
    """Non-blank lines that are not JSON or lack the required event fields.

    ``raw`` holds ``session_id``, ``line_no`` and ``value``.
    """
    body = raw.filter(F.trim("value") != "").withColumn("_v", F.try_parse_json("value"))
    is_object = F.startswith(F.ltrim("value"), F.lit("{"))
    complete = (
        is_object
        & F.try_variant_get("_v", "$.event_id", "string").isNotNull()
        & F.try_variant_get("_v", "$.tool_name", "string").isNotNull()
    )
    issue = F.when(F.col("_v").isNull(), "malformed").when(
        ~F.coalesce(complete, F.lit(False)), "schema"
    )
    return (
        body.withColumn("issue", issue)
        .filter(F.col("issue").isNotNull())
        .select("session_id", "line_no", "issue")
    )


def validate_sessions(
    events: DataFrame, raw: DataFrame | None = None, graph: TraceGraph | None = None
) -> DataFrame:
    """One row per session: problem counts and whether it is valid.

    Cycles, malformed lines and incomplete lines make a session invalid; broken
    references, orphans and unreadable timestamps are warnings.
    """
    events = cut(events.select("session_id", "event_id", "parents", "pos", "tool_name", "timestamp", "ts"))
    parts = {
        "broken_refs": broken_refs(events),
        "orphan_count": orphans(events),
        "cyclic_events": cycle_nodes(events, graph=graph),
        "bad_timestamps": bad_timestamps(events),
    }
    if raw is not None:
        issues = cut(line_issues(raw))
        parts["malformed_lines"] = issues.filter("issue = 'malformed'")
        parts["schema_errors"] = issues.filter("issue = 'schema'")
    rows = events.select("session_id", F.lit("event_count").alias("what"))
    for name, df in parts.items():
        rows = rows.unionByName(df.select("session_id", F.lit(name).alias("what")))
    names = ["event_count", *parts]
    out = rows.groupBy("session_id").agg(
        *[F.count_if(F.col("what") == n).alias(n) for n in names]
    )
    fatal = [n for n in ("cyclic_events", "malformed_lines", "schema_errors") if n in parts]
    valid = F.lit(True)
    for n in fatal:
        valid = valid & (F.col(n) == 0)
    return out.withColumn("valid", valid)


def _unique_ids(events: DataFrame) -> DataFrame:
    return duplicate_ids(events).select(
        "session_id", F.explode(F.sequence(F.lit(2), F.col("copies"))).alias("nth")
    )


def _root_definition(events: DataFrame) -> DataFrame:
    """Events whose own parent list and the edge table disagree on being a root."""
    known = events.select("session_id", F.col("event_id").alias("parent")).distinct()
    own = (
        events.select("session_id", "event_id", F.explode("parents").alias("parent"))
        .join(known, ["session_id", "parent"], "left_semi")
        .select("session_id", "event_id", F.lit(1).alias("own"))
        .distinct()
    )
    indexed = (
        edges(events)
        .select("session_id", F.col("child").alias("event_id"), F.lit(1).alias("indexed"))
        .distinct()
    )
    return own.join(indexed, ["session_id", "event_id"], "full").filter(
        F.col("own").isNull() | F.col("indexed").isNull()
    )


CHECKS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "unique_ids": _unique_ids,
    "acyclicity": cycle_nodes,
    "local_references": broken_refs,
    "root_definition": _root_definition,
}


def check_invariants(
    events: DataFrame, checks: dict[str, Callable[[DataFrame], DataFrame]] | None = None
) -> DataFrame:
    """Rows (session, check, violations, valid) for a battery of named checks.

    A check maps the event table to one row per violation with a ``session_id``; pass
    your own next to or instead of ``CHECKS``.
    """
    checks = CHECKS if checks is None else checks
    events = cut(events)
    names = F.array(*[F.lit(n) for n in checks])
    rows = (
        events.select("session_id")
        .distinct()
        .select("session_id", F.explode(names).alias("check"), F.lit(0).alias("hit"))
    )
    for name, fn in checks.items():
        rows = rows.unionByName(
            fn(events).select("session_id", F.lit(name).alias("check"), F.lit(1).alias("hit"))
        )
    return (
        rows.groupBy("session_id", "check")
        .agg(F.sum("hit").alias("violations"))
        .withColumn("valid", F.col("violations") == 0)
    )


def with_fingerprint(events: DataFrame) -> DataFrame:
    return events.withColumn("fingerprint", fingerprint())


def upsert_missing(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming events whose content is new, ready to append.

    Content stored already, or seen earlier in the batch, is skipped. Parents of new
    events that point to a skipped earlier event are redirected to the kept twin.
    ``incoming`` is ordered by ``ingest_seq``.
    """
    mapped = _mapped(stored, incoming)
    fresh = mapped.filter("fresh")
    listed = fresh.select(
        "session_id", "ingest_seq", F.posexplode("parents").alias("idx", "parent")
    )
    moved = mapped.filter("NOT fresh").select(
        "session_id",
        F.col("event_id").alias("parent"),
        F.col("ingest_seq").alias("_seq"),
        "kept_id",
    )
    target = (
        listed.join(moved, ["session_id", "parent"])
        .filter("_seq < ingest_seq")
        .groupBy("session_id", "ingest_seq", "idx")
        .agg(F.max_by("kept_id", "_seq").alias("to"))
    )
    parents = (
        listed.join(target, ["session_id", "ingest_seq", "idx"], "left")
        .groupBy("session_id", "ingest_seq")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("idx", F.coalesce("to", "parent").alias("parent")))
            ).alias("_new")
        )
    )
    out = fresh.join(parents, ["session_id", "ingest_seq"], "left")
    joined = F.array_join(F.col("_new.parent"), ",")
    return out.withColumn("parent_event_id", F.coalesce(joined, "parent_event_id")).withColumn(
        "parents", F.coalesce(F.col("_new.parent"), F.col("parents"))
    ).select(*incoming.columns)


def _mapped(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming events with the id that stands for their content and whether it is new."""
    key = ["session_id", "fingerprint"]
    have = (
        with_fingerprint(stored)
        .groupBy(*key)
        .agg(F.max_by("event_id", "ingest_seq").alias("stored_id"))
    )
    batch = with_fingerprint(incoming)
    lead = batch.groupBy(*key).agg(
        F.min("ingest_seq").alias("_first"), F.min_by("event_id", "ingest_seq").alias("_first_id")
    )
    return (
        batch.join(lead, key)
        .join(have, key, "left")
        .withColumn("fresh", F.col("stored_id").isNull() & (F.col("ingest_seq") == F.col("_first")))
        .withColumn("kept_id", F.coalesce("stored_id", "_first_id"))
    )


def upsert_summary(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Dry run: incoming, existing, added and skipped events per session."""
    mapped = _mapped(stored, incoming).groupBy("session_id").agg(
        F.count("*").alias("incoming"),
        F.count_if("fresh").alias("added"),
        F.count_if(~F.col("fresh")).alias("skipped"),
    )
    have = stored.groupBy("session_id").agg(F.count("*").alias("existing"))
    return mapped.join(have, "session_id", "left").fillna(0, ["existing"])
