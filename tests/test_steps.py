"""Steps that many queries share: positions, checks, plans, state of streams."""

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.operators import corpus as K
from skein.operators import integrity as V
from skein.operators import subsets as X
from skein.operators import windows as W
from skein.operators.ordering import with_position
from skein.plans import checks, ingest, views
from skein.sources import textlogs

SMALL = "/root/testdata/sf0.001"


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_values_of_a_plan_do_not_carry_its_text(spark):
    plans = spark.createDataFrame([("a", '{"x": [1, {"y": 2}]}'), ("b", None)], "plan_id string, plan string")
    entries = X.plan_entries(plans)
    assert "plan" not in entries.columns
    assert sorted(r.path for r in entries.filter("leaf IS NOT NULL").collect()) == ["$.x[0]", "$.x[1].y"]
    assert X.plan_signatures(plans).count() == 2


def test_plans_are_dealt_to_all_tasks(spark):
    plans = spark.range(100).coalesce(1).select(F.col("id").cast("string").alias("plan_id"), F.lit('{"cmd": 1}').alias("plan"))
    assert "RepartitionByExpression [plan_id" in planned(X.lint_plans(plans))
    assert X.lint_plans(plans).filter("issue LIKE 'prohibited%'").count() == 100


def test_positions_of_small_and_large_sessions(spark):
    rows = [(s, f"2026-01-01T{(i * 7) % 24:02d}:{i % 3:02d}", i) for s, n in (("a", 5), ("b", 60), ("c", 8), ("d", 9)) for i in range(n)]
    df = spark.createDataFrame([*rows, (None, "2026", 1)], "session_id string, timestamp string, ingest_seq bigint")
    w = Window.partitionBy("session_id").orderBy("timestamp", "ingest_seq")
    plain = df.dropna(subset=["session_id"]).withColumn("pos", F.row_number().over(w).cast("bigint")).collect()
    assert sorted(with_position(df, slice_rows=8).collect()) == sorted(plain)
    assert sorted(with_position(df).collect()) == sorted(plain)


def test_small_sessions_are_ranked_without_a_join(spark):
    assert "Join" not in planned(views.trace_native(spark, SMALL))
    assert "Join" not in planned(views.trace_dirty(spark, SMALL))


def test_checks_read_the_events_once(spark):
    checked = V.validate_sessions(views.trace_dirty(spark, SMALL), checks.raw_lines(spark, SMALL))
    assert "Window" not in planned(checked)
    assert "Window" not in planned(V.check_invariants(views.trace_dirty(spark, SMALL)))


def test_logs_are_made_from_written_events(spark):
    assert "Window" not in planned(ingest.hook_records(spark, SMALL))


def test_measures_of_windows_meet_without_joins(spark):
    measured = W.window_metrics(views.trace_native(spark, SMALL), 20)
    assert "Join" not in planned(measured)
    assert measured.filter("root_count IS NULL OR transition_entropy IS NULL OR path_reuse_ratio IS NULL OR avg_branch_density IS NULL").isEmpty()


def before_linking(monkeypatch, ingest_log, spark, *values):
    """Plan and rows of a log's events as they go to linking."""
    monkeypatch.setattr(textlogs, "_linked", lambda events: events)
    lines = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "session_id string, line_no bigint, value string")
    events = ingest_log(lines)
    return planned(events), sorted(events.collect(), key=lambda r: r.line_no)


def test_continue_lines_are_parsed_once(spark, monkeypatch):
    values = ['{"tool": {"name": "run", "input": "a"}, "time": 5}', "no json", None, '{"raw": "{\\"function\\": \\"x\\"}", "function_call": 1}', '{"message": "using tool: grep now"}', "null"]
    plan, rows = before_linking(monkeypatch, textlogs.ingest_continue_log, spark, *values)
    assert "parseJson" not in plan
    assert [(r.line_no, r.tool_name, r.tool_input) for r in rows] == [(0, "Bash", "a"), (3, "x", "{}"), (4, "Grep", "using tool: grep now")]


def test_copilot_lines_are_parsed_once(spark, monkeypatch):
    values = ['[tool_call] then tool_use: view', 'x {"name": "open", "args": {"p": 1}, "result": "r"}', "running command: diff", 'a "tool": "b"', "idle", '{"tool": "status", "input": "t"}']
    plan, rows = before_linking(monkeypatch, textlogs.ingest_copilot_log, spark, *values)
    assert "parseJson" not in plan
    assert [(r.line_no, r.tool_name, r.tool_output) for r in rows] == [(1, "Read", "r"), (2, "Read", None), (3, "b", None), (5, "Bash", None)]
    assert [r.tool_input for r in rows if r.line_no in (1, 5)] == ['{"p":1}', '{"text":"t"}']


def test_registry_lines_are_matched_once(spark, monkeypatch):
    steps = [("completed", "a"), ("started", "a"), ("completed", "b"), ("completed", "a"), ("completed", "a"), ("completed", "a"), ("started", "a"), ("started", "a"), ("completed", "a"), ("completed", "a"), ("completed", "a")]
    values = [f"INFO 2026-01-01T00:00:{i:02d} x service=tool.registry status={s} {t}" for i, (s, t) in enumerate(steps)]
    plan, rows = before_linking(monkeypatch, textlogs.ingest_opencode_log, spark, *values)
    assert "regexp_extract" not in plan
    assert plan.count("Relation ") + plan.count("LogicalRDD") <= 3
    assert [(r.line_no, r.duration_ms) for r in rows] == [(0, None), (2, None), (3, 2000.0), (4, None), (5, None), (8, 2000.0), (9, 2000.0), (10, None)]


def test_digests_sum_halves_exactly(spark):
    """The sums of the halves are the sums of the 60-bit numbers; an empty bag has a digest, too."""
    texts = spark.range(3000).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("t"))
    hashes = [hashlib.sha256(f"t{i}".encode()).hexdigest() for i in range(3000)]
    sums = [str(sum(int(h[at : at + 15], 16) for h in hashes)) for at in (0, 15, 30, 45)]
    assert texts.agg(K.set_digest(F.col("t"))).first()[0] == hashlib.sha256("/".join(["3000", *sums]).encode()).hexdigest()
    assert texts.limit(0).agg(K.set_digest(F.col("t"))).first()[0] == hashlib.sha256(b"0").hexdigest()
