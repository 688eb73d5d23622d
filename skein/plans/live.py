"""Queries that run the streaming operators over all available input."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators.lineage import cut, fresh_path
from skein.operators.ordering import with_position
from skein.plans.catalog import query
from skein.plans.ingest import HOOKS_WHOLE, hook_records
from skein.plans.oracle import NATIVE, RAW
from skein.plans.views import trace_native
from skein.schema import EVENT_FIELDS
from skein.sources.raw import read_events
from skein.streaming import live


def _stream(df, label="arriving"):
    """Write a table as files and read them as a stream."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return live.stream_events(spark, path, "parquet", df.schema)


def _events(spark, sf):
    return trace_native(spark, sf).select(*EVENT_FIELDS, "ingest_seq", "pos")


@query(
    "stream_events",
    f"WITH {RAW} SELECT session_id, event_id, event_type AS tool_name FROM raw_ev",
)
def stream_events(spark, sf):
    return live.drain(_stream(_events(spark, sf)).select("session_id", "event_id", "tool_name"))


@query("stream_pair_hooks", HOOKS_WHOLE)
def stream_pair_hooks(spark, sf):
    paired = live.drain(live.stream_pair_hooks(_stream(hook_records(spark, sf))))
    return paired.select("session_id", "event_id", "parent_event_id", "event_type", "tool_name", "tool_input", "tool_output", "timestamp", "duration_ms", "agent")


@query(
    "stream_chain",
    f"""WITH {NATIVE} SELECT n.session_id, n.event_id, 'tool_call' AS event_type, n.tool_name, n.tool_input, n.duration_ms, n.seq AS ingest_seq,
strftime(n.ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp,
CASE WHEN p.event_id IS NOT NULL THEN p.event_id WHEN n.tool_name <> 'signup' THEN lag(n.event_id) OVER (PARTITION BY n.session_id ORDER BY n.seq) END AS parent_event_id
FROM tn n LEFT JOIN tn p ON p.session_id = n.session_id AND p.pos = n.pp1 AND n.k % 10 = 0""",
)
def stream_chain(spark, sf):
    k = F.regexp_extract("tool_input", "([0-9]+)", 1).cast("int")
    first = F.split_part("parent_event_id", F.lit(","), F.lit(1))
    ev = (
        _events(spark, sf)
        .withColumn("new_group", F.col("tool_name") == "signup")
        .withColumn("parent_event_id", F.when(k % 10 == 0, first))
    )
    chained = live.drain(live.stream_chain(_stream(ev)))
    return chained.select("session_id", "event_id", "event_type", "tool_name", "tool_input", "duration_ms", "ingest_seq", "timestamp", "parent_event_id")


@query(
    "append_events",
    f"""WITH {RAW} SELECT session_id, event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp,
row_number() OVER (PARTITION BY session_id ORDER BY twice, ts, seq) AS place
FROM (SELECT *, 1 AS twice FROM raw_ev UNION ALL SELECT * REPLACE (event_id || '+' AS event_id), 2 FROM raw_ev)""",
)
def append_events(spark, sf):
    """Two streams append the same events, the second under other ids; the store keeps one after the other."""
    store, ev = fresh_path(spark, "store"), cut(_events(spark, sf))
    for batch in (ev, ev.withColumn("event_id", F.concat("event_id", F.lit("+")))):
        writer = live.append_events(_stream(batch), store, fresh_path(spark, "state"))
        writer.trigger(availableNow=True).start().awaitTermination()
    back = with_position(read_events(spark, store).withColumn("same", F.lit("")), ts_col="same", out="place")
    return back.select("session_id", "event_id", "timestamp", "place")


@query(
    "stream_dedup",
    f"WITH {RAW} SELECT session_id, count(*) AS events FROM raw_ev GROUP BY 1",
)
def stream_dedup(spark, sf):
    ev = _events(spark, sf)
    twice = ev.unionByName(ev.withColumn("event_id", F.concat(F.lit("copy-"), F.col("event_id"))))
    kept = live.drain(live.stream_dedup(_stream(twice)))
    return kept.groupBy("session_id").agg(F.count("*").alias("events"))


@query(
    "stream_transitions",
    f"""WITH {NATIVE} SELECT date_trunc('day', c.ts) AS window_start, parent_tool AS from_tool, child_tool AS to_tool, count(*) AS count
FROM ne JOIN tn c ON c.session_id = ne.session_id AND c.pos = ne.cpos GROUP BY 1, 2, 3""",
)
def stream_transitions(spark, sf):
    """Parents and children of one stream; a last event far ahead closes all windows."""
    ev = _events(spark, sf)
    given = {"timestamp": "2100-01-01T00:00:00.000000", "session_id": "end", "event_id": "end", "tool_name": "end"}
    ahead = ev.limit(1).select(*[F.lit(given.get(c)).cast(t).alias(c) for c, t in ev.dtypes])
    out = live.drain(live.stream_transitions(_stream(ev.unionByName(ahead)), horizon="4000 days"))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
