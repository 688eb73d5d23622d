"""Event store and raw logs: order, repeated outputs."""

import json
import random

from pyspark.sql import functions as F

from skein.operators.corpus import content_text, set_digest
from skein.operators.ordering import prepare, with_position
from skein.schema import conform_events
from skein.sources.agents import ingest_codex
from skein.sources.raw import read_events, write_events


def test_tied_timestamps_keep_their_order(spark, tmp_path):
    rows = [("s", f"e{i}", None if i == 0 else f"e{i - 1}", "Read", "2026-01-01T00:00:00", i) for i in range(3000)]
    rows += [("t", f"x{i}", None, "Bash", "2026-01-01T00:00:00", i) for i in range(5)]
    random.Random(2).shuffle(rows)
    schema = "session_id string, event_id string, parent_event_id string, tool_name string, timestamp string, ingest_seq bigint"
    events = prepare(conform_events(spark.createDataFrame(rows, schema).repartition(7)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_events(events, str(tmp_path / "store"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "store").glob("commit=*/session=s/*.json"))) > 1
    back = prepare(read_events(spark, str(tmp_path / "store")))
    places = lambda df: {(r.session_id, r.event_id): r.pos for r in df.select("session_id", "event_id", "pos").collect()}
    assert places(back) == places(events)


def test_appends_follow_each_other(spark, tmp_path):
    """Two writes of tied events are read back one after the other."""
    schema = "session_id string, event_id string, timestamp string, ingest_seq bigint"
    for name in "ab":
        rows = [("s", f"{name}{i:03d}", "2026-01-01T00:00:00", i) for i in range(10)]
        write_events(prepare(conform_events(spark.createDataFrame(rows, schema))), str(tmp_path / "store"))
    back = prepare(read_events(spark, str(tmp_path / "store"))).orderBy("pos").collect()
    assert [r.event_id for r in back] == [f"{name}{i:03d}" for name in "ab" for i in range(10)]
    # Files of other writers have no order of their own: they follow their lines.
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "other.jsonl").write_text('{"event_id": "z"}\n\n{"event_id": "y", "session_id": "given"}\n')
    found = read_events(spark, str(tmp_path / "plain" / "*.jsonl")).orderBy("ingest_seq").collect()
    assert [(r.session_id, r.event_id) for r in found] == [("other", "z"), ("given", "y")]


def test_crowded_slices_are_ranked_by_several_tasks(spark):
    """200,000 tied events, next to sessions of a few."""
    n = 200_000
    base = spark.range(n).select(F.lit("hot").alias("session_id"), F.lit("2026-01-01T00:00:00").alias("timestamp"), ((F.col("id") * 7919) % n).alias("ingest_seq"))
    few = spark.range(50).select(F.concat(F.lit("s"), (F.col("id") % 5).cast("string")), F.lit("2026-01-01T00:00:00"), F.col("id"))
    more = spark.createDataFrame([("hot", "2025-01-01T00:00:00", -1), ("hot", "2027-01-01T00:00:00", n)], base.schema)
    ranked = with_position(base.union(few).union(more).repartition(8))
    wrong = ranked.filter((F.col("session_id") == "hot") & (F.col("pos") != F.col("ingest_seq") + 2))
    assert wrong.count() == 0 and ranked.count() == n + 52
    assert {r.session_id: r.m for r in ranked.groupBy("session_id").agg(F.max("pos").alias("m")).collect()} == {"hot": n + 2, **{f"s{i}": 10 for i in range(5)}}
    tasks = ranked.filter("session_id = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1


def test_digest_sees_durations_order_and_nulls(spark):
    base = dict(session_id="s", event_id="a", tool_name="Read", timestamp="t", duration_ms=1.0, tool_output="", pos=1)
    other = base | dict(event_id="b", pos=2)

    def digest(*rows):
        events = conform_events(spark.createDataFrame([tuple(r.values()) for r in rows], "session_id string, event_id string, tool_name string, timestamp string, duration_ms double, tool_output string, pos bigint"))
        return events.groupBy("session_id").agg(set_digest(content_text(events)).alias("d")).first().d

    whole = digest(base, other)
    assert whole == digest(other, base)
    assert whole != digest(base | dict(duration_ms=2.0), other)
    assert whole != digest(base | dict(pos=2), other | dict(pos=1))
    assert whole != digest(base | dict(tool_output=None), other)


def test_codex_second_output_is_kept(spark):
    def item(kind, **payload):
        return json.dumps({"timestamp": "2026-01-01T00:00:00Z", "type": "response_item", "payload": {"type": kind, **payload}})

    lines = [
        item("function_call", name="shell", arguments="{}", call_id="c1"),
        item("function_call_output", call_id="c1", output="first"),
        item("function_call_output", call_id="c1", output="second"),
        item("function_call_output", call_id="none", output="lost"),
    ]
    raw = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "session_id string, line_no bigint, value string")
    got = [(r.tool_name, r.tool_output) for r in ingest_codex(raw).orderBy("ingest_seq").collect()]
    assert got == [("shell", "first"), ("unknown", "second"), ("unknown", "lost")]
