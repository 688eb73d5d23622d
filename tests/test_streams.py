"""Streams over several micro-batches, restarts and expiry."""

import json

import pytest
from pyspark.sql import functions as F

from skein.operators.lineage import fresh_path
from skein.schema import EVENT_FIELDS, conform_events
from skein.sources.hooks import pair_hooks
from skein.sources.raw import commits, read_events
from skein.streaming import live

HOOKS = "session_id string, line_no bigint, arrived_ms bigint, hook_event_name string, tool_name string, tool_input string, tool_result string"


class Feed:
    """A folder that a stream reads one file a micro-batch; a query that can be stopped and started again."""

    def __init__(self, spark, schema):
        self.spark, self.schema, self.path = spark, schema, fresh_path(spark, "feed")
        self.out, self.state = fresh_path(spark, "out"), fresh_path(spark, "state")
        self.files = 0

    def add(self, rows):
        self.files += 1
        df = self.spark.createDataFrame(rows, self.schema).coalesce(1)
        df.write.json(f"{self.path}/{self.files:03d}")

    def run(self, build, once=False):
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).json(f"{self.path}/*")
        built = build(stream)
        query = (
            built.writeStream.option("checkpointLocation", self.state)
            .trigger(**({"once": True} if once else {"availableNow": True}))
            .outputMode("append").format("parquet").option("path", self.out).start()
        )
        query.awaitTermination()
        return self.spark.read.schema(built.schema).parquet(self.out).collect()


def hook(session, line, ms, kind, tool, **given):
    return (session, line, ms, kind + "ToolUse", tool, json.dumps({"command": tool, "drop": 1} | given), json.dumps({"output": "o" * 600}))


def test_pairs_across_batches_and_restart(spark):
    feed = Feed(spark, HOOKS)
    batches = [
        [hook("s", 1, 1000, "Pre", "Bash"), hook("s", 2, 1500, "Pre", "Read"), hook("t", 1, 1000, "Post", "Bash")],
        [hook("s", 3, 2000, "Post", "Bash"), hook("s", 4, 2500, "Pre", "Edit"), hook("t", 2, 1100, "Pre", "Bash")],
        [hook("s", 6, 4000, "Post", "Edit"), hook("s", 5, 3000, "Post", "Read"), hook("t", 3, 5000, "Pre", "Bash")],
        [hook("t", 4, 5500, "Post", "Bash"), hook("t", 5, 5600, "Post", "Bash")],
    ]
    for batch in batches[:2]:
        feed.add(batch)
    feed.run(live.stream_pair_hooks)
    for batch in batches[2:]:
        feed.add(batch)
    got = feed.run(live.stream_pair_hooks)  # goes on from the checkpoint
    raw = spark.createDataFrame([r for b in batches for r in b], HOOKS)
    want = pair_hooks(raw).collect()
    fields = list(EVENT_FIELDS)
    assert sorted(tuple(r[f] for f in fields) for r in got) == sorted(tuple(r[f] for f in fields) for r in want)
    assert len(got) == 4 and {r.event_id: r.parent_event_id for r in got}["s:6"] == "s:3"


def test_wait_ends_by_event_time(spark):
    """The watermark ends a wait without further records of its session."""
    feed = Feed(spark, HOOKS)
    feed.add([hook("s", 1, 1_000, "Pre", "Bash"), hook("s", 2, 1_000, "Pre", "Read")])
    feed.add([hook("other", 1, 400_000, "Pre", "Bash")])
    feed.add([hook("s", 3, 900_000, "Post", "Bash"), hook("s", 4, 900_000, "Pre", "Grep")])
    feed.add([hook("s", 5, 950_000, "Post", "Grep"), hook("s", 6, 950_001, "Post", "Read")])
    got = feed.run(lambda df: live.stream_pair_hooks(df, ttl_ms=60_000, delay="1 second"))
    assert [(r.event_id, r.duration_ms) for r in got] == [("s:5", 50_000.0)]


def test_wait_ends_by_the_clock(spark):
    feed = Feed(spark, HOOKS)
    pairing = lambda df: live.stream_pair_hooks(df, ttl_ms=600_000, delay=None)
    feed.add([hook("s", 1, 1_000, "Pre", "Bash")])
    feed.run(pairing, once=True)  # by the clock, a run over all that is there would wait for the clock
    feed.add([hook("s", 2, 1_500, "Post", "Bash")])
    got = feed.run(pairing, once=True)
    assert [r.event_id for r in got] == ["s:2"]


EVENTS = ", ".join(f"{c} {t}" for c, t in EVENT_FIELDS.items()) + ", ingest_seq bigint, new_group boolean"


def event(session, eid, seq, parent=None, tool="Bash", at="2026-01-01T00:00:00", new_group=False):
    given = dict(session_id=session, event_id=eid, parent_event_id=parent, event_type="tool_call", tool_name=tool, tool_input="{}", timestamp=at)
    return (*(given.get(f) for f in EVENT_FIELDS), seq, new_group)


def test_chain_across_batches(spark):
    feed = Feed(spark, EVENTS)
    feed.add([event("s", "b", 2), event("s", "a", 1), event("t", "x", 1)])
    feed.add([event("s", "c", 3), event("s", "d", 4, parent="a"), event("s", "e", 5, parent="")])
    feed.run(live.stream_chain)
    feed.add([event("s", "f", 6, new_group=True), event("s", "g", 7), event("t", "y", 2)])
    got = {r.event_id: r for r in feed.run(lambda df: live.stream_chain(df))}
    assert {k: r.parent_event_id for k, r in got.items()} == {
        "a": None, "b": "a", "c": "b", "d": "a", "e": "d", "f": None, "g": "f", "x": None, "y": "x",
    }
    assert got["g"].tool_input == "{}" and got["g"].ingest_seq == 7


def test_links_find_parents_before_and_after(spark):
    feed = Feed(spark, EVENTS)
    feed.add([event("s", "child", 1, parent="late,early", tool="Edit", at="2026-01-01T10:00:00")])
    feed.add([event("s", "early", 2, tool="Read", at="2026-01-01T09:00:00"), event("t", "late", 3, tool="Wrong")])
    feed.add([event("s", "late", 4, tool="Grep", at="2026-01-01T12:00:00")])
    feed.add([event("s", "next", 5, parent="child,far", tool="Bash", at="2026-01-01T13:00:00"), event("s", "far", 6, at="2025-12-01T00:00:00")])
    got = feed.run(lambda df: live.stream_links(df, "40 days", "1 day"))
    assert sorted((r.from_tool, r.to_tool) for r in got) == [("Edit", "Bash"), ("Grep", "Edit"), ("Read", "Edit")]


def test_counts_of_closed_windows(spark):
    feed = Feed(spark, EVENTS)
    feed.add([event("s", "a", 1, tool="Read", at="2026-01-01T10:00:00"), event("s", "b", 2, parent="a", at="2026-01-01T11:00:00")])
    feed.add([event("s", "c", 3, parent="a", at="2026-01-01T12:00:00"), event("s", "d", 4, parent="c", at="2026-01-02T00:30:00")])
    feed.add([event("end", "z", 5, at="2026-02-01T00:00:00")])
    got = feed.run(lambda df: live.stream_transitions(df, "1 day", "1 hour", "1 day"))
    assert sorted((str(r.window_start), r.from_tool, r.to_tool, r["count"]) for r in got) == [
        ("2026-01-01 00:00:00", "Read", "Bash", 2),
        ("2026-01-02 00:00:00", "Bash", "Bash", 1),
    ]


def test_append_survives_a_restart(spark, monkeypatch):
    """A batch that fails after its files are written is repeated, and is there once."""
    feed = Feed(spark, EVENTS)
    store = fresh_path(spark, "store")

    def run():
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(f"{feed.path}/*")
        live.append_events(stream, store, feed.state).trigger(availableNow=True).start().awaitTermination()

    feed.add([event("s", "a", 1), event("s", "b", 2)])
    run()
    feed.add([event("s", "c", 1), event("t", "x", 1)])
    whole = live.write_events

    def failing(*args, **kwargs):
        whole(*args, **kwargs)
        raise RuntimeError("lost")

    monkeypatch.setattr(live, "write_events", failing)
    with pytest.raises(Exception, match="lost"):
        run()
    assert len(commits(spark, store)) == 2
    monkeypatch.setattr(live, "write_events", whole)
    run()
    feed.add([event("s", "d", 1)])
    run()
    back = read_events(spark, store).orderBy("ingest_seq").collect()
    assert [r.event_id for r in back if r.session_id == "s"] == ["a", "b", "c", "d"] and len(back) == 5
    # A commit without its success mark does not count.
    unfinished = f"{store}/commit=000000000009.lost"
    conform_events(spark.createDataFrame([event("s", "q", 1)], EVENTS)).drop("new_group").write.json(unfinished)
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{unfinished}/_SUCCESS")
    mark.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(mark, False)
    assert read_events(spark, store).count() == 5


def test_dedup(spark):
    feed = Feed(spark, EVENTS)
    feed.add([event("s", "a", 1), event("s", "copy", 2)])
    feed.add([event("s", "later", 3), event("t", "a", 1)])
    got = feed.run(lambda df: live.stream_dedup(df).select("session_id", F.col("fingerprint")))
    assert sorted(r.session_id for r in got) == ["s", "t"]
