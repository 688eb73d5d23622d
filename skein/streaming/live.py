"""Structured Streaming forms of append, pairing, chaining, dedup and counting."""

from __future__ import annotations

import hashlib

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.columns import fingerprint, iso_timestamp, parse_parents
from skein.operators.lineage import fresh_path
from skein.schema import EVENT_FIELDS, EVENT_SCHEMA, conform_events
from skein.sources.hooks import hook_input, hook_output, hook_time
from skein.sources.raw import write_events
from skein.streaming import state
from skein.streaming.state import Chaining, Pairing

# Executors need not have this package installed: state classes travel with the task.
cloudpickle.register_pickle_by_value(state)


def stream_events(spark: SparkSession, path: str, fmt: str = "json", schema=EVENT_SCHEMA) -> DataFrame:
    """Append-only event files as a stream."""
    return spark.readStream.schema(schema).format(fmt).load(path)


def append_events(stream: DataFrame, path: str, checkpoint: str):
    """Writer that appends a stream of events to a store; start it with a trigger of your own.

    Each micro-batch is one commit of the store. A batch that is repeated after a restart
    takes the place of its first attempt, so no line is there twice (see
    :func:`skein.sources.raw.write_events`).
    """
    writer = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def commit(batch: DataFrame, number: int) -> None:
        write_events(batch, path, writer=f"{writer}.{number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).outputMode("append").foreachBatch(commit)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process all available input once and return the written result as a table."""
    spark = stream.sparkSession
    out, state = fresh_path(spark, "drained"), fresh_path(spark, "state")
    writer = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", out).start()
    else:
        # The last micro-batch of a complete result replaces the ones before.
        query = (
            writer.outputMode(mode)
            .foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
            .start()
        )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


PAIR_OUT = (
    "session_id string, event_id string, parent_event_id string, tool_name string, tool_input string, "
    "tool_output string, timestamp string, duration_ms double, agent string"
)


def _keeps_state(spark: SparkSession) -> None:
    """The state store that named states, timers and TTL need."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def stream_pair_hooks(raw: DataFrame, ttl_ms: int | None = None, delay: str | None = "1 minute") -> DataFrame:
    """Completed calls from a stream of hook records, as whole events.

    Input columns and results as for the batch form. Records of one micro-batch are taken in
    arrival order. A before-record that waits longer than ``ttl_ms`` is forgotten: by arrival
    time, once the watermark (``delay`` behind the latest arrival) has passed it, or by the
    clock where ``delay`` is None. Records later than the watermark are dropped.
    """
    spark = raw.sparkSession
    _keeps_state(spark)
    by_event_time = delay is not None
    rows = raw.filter(F.col("hook_event_name").isin("PreToolUse", "PostToolUse")).select(
        "session_id",
        "line_no",
        "arrived_ms",
        "hook_event_name",
        "tool_name",
        hook_input("tool_input").alias("tool_input"),
        hook_output("tool_result").alias("tool_output"),
        hook_time("arrived_ms").alias("timestamp"),
        F.lit("claude-code").alias("agent"),
    )
    if by_event_time and ttl_ms is not None:
        rows = rows.withColumn("arrived", F.timestamp_millis("arrived_ms")).withWatermark("arrived", delay)
    mode = "None" if ttl_ms is None else "EventTime" if by_event_time else "ProcessingTime"
    paired = rows.groupBy("session_id").transformWithStateInPandas(
        Pairing(ttl_ms, by_event_time), PAIR_OUT, "Append", mode
    )
    return conform_events(paired)


def stream_chain(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Give arriving events the session's previous event as parent; events stay whole.

    A recorded parent wins. ``new_group`` starts a new chain at its event, and so does an
    event that comes more than ``idle_ms`` (by the clock) after the session's last one.
    """
    _keeps_state(events.sparkSession)
    known = conform_events(events)
    rows = known.select(*EVENT_FIELDS, F.col("ingest_seq").cast("bigint").alias("ingest_seq"), "new_group")
    columns = [*EVENT_FIELDS, "ingest_seq"]
    schema = ", ".join(f"{c} {t}" for c, t in EVENT_FIELDS.items()) + ", ingest_seq bigint"
    return rows.groupBy("session_id").transformWithStateInPandas(
        Chaining(columns, idle_ms), schema, "Append", "None" if idle_ms is None else "ProcessingTime"
    )


def stream_dedup(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop events whose content was seen before within the delay."""
    return (
        events.withColumn("ts", iso_timestamp("timestamp"))
        .withColumn("fingerprint", fingerprint())
        .withWatermark("ts", delay)
        .dropDuplicatesWithinWatermark(["session_id", "fingerprint"])
    )


def stream_links(events: DataFrame, delay: str = "1 day", horizon: str = "1 day") -> DataFrame:
    """Recorded links between events of one stream: time and tool of the child, tool of the parent.

    A parent may arrive before or after its child. Both sides wait for each other as long as
    their times differ by at most ``horizon``; after that, and the ``delay`` of the
    watermark, their state ends.
    """
    timed = events.withColumn("ts", iso_timestamp("timestamp"))
    # The watermark stands before the links are taken, so events without parents move it, too.
    child = timed.withWatermark("ts", delay).select(
        "session_id",
        "ts",
        F.col("tool_name").alias("to_tool"),
        F.explode(parse_parents("parent_event_id")).alias("parent"),
    )
    parents = timed.select(
        F.col("session_id").alias("parent_session"),
        F.col("event_id").alias("parent_id"),
        F.col("tool_name").alias("from_tool"),
        F.col("ts").alias("parent_ts"),
    ).withWatermark("parent_ts", delay)
    near = F.expr(f"parent_ts >= ts - INTERVAL {horizon} AND parent_ts <= ts + INTERVAL {horizon}")
    same = (F.col("session_id") == F.col("parent_session")) & (F.col("parent") == F.col("parent_id"))
    return child.join(parents, same & near).select("session_id", "ts", "from_tool", "to_tool")


def stream_transitions(
    events: DataFrame, window: str = "1 day", delay: str = "1 day", horizon: str = "1 day"
) -> DataFrame:
    """Counts of (parent tool, tool) per time window of the child; parents come from the same stream.

    In append mode a window appears once no link can fall into it any more.
    """
    return (
        stream_links(events, delay, horizon)
        .groupBy(F.window("ts", window).alias("w"), "from_tool", "to_tool")
        .agg(F.count("*").alias("count"))
        .select(F.col("w.start").alias("window_start"), "from_tool", "to_tool", "count")
    )
