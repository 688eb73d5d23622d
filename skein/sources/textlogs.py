"""Plain-text and loosely structured logs to events with inferred links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.columns import iso_timestamp
from skein.operators.inference import infer_relations
from skein.operators.lineage import cut
from skein.operators.ordering import running_sum
from skein.operators.patterns import SESSION
from skein.sources.attribution import canonical_tool
from skein.sources.raw import event_id, finish, first_of, get, json_object, placed, serial_chain

# Line formats of the supported logs.
OPENCODE_LINE = (
    r"INFO\s+(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2}).*?service=tool\.registry\s+"
    r"status=(started|completed)(?:\s+duration=(\d+))?\s+(\S+)"
)
CONTINUE_PATTERNS = (
    r"(?i)Running\s+(?:tool|step)\s*[:=]\s*(.+?)(?:\s|$)",
    r"(?i)tool_call\s*[:=]\s*(.+?)(?:\s|$)",
    r"(?i)function_call\s*[:=]\s*(.+?)(?:\s|$)",
    r"(?i)using\s+tool\s*[:=]\s*(.+?)(?:\s|$)",
)
COPILOT_PATTERNS = (
    r'(?s)\[tool_call\]\s*(?:\{.*?"name"\s*:\s*"(\w+)".*?"input".*?)?',
    r"(?i)(?:tool_call|tool_use|function_call)\s*[:=]\s*(\w+)",
    r'(?i)"tool"\s*:\s*"(\w+)"',
    r"(?i)running\s+(?:tool|command|step)\s*[:\s]+(\w+)",
)
AIDER_PATTERNS = (
    ("Bash", r"^\$\s+(.+)$"),
    ("Edit", r"(?i)^Applied\s+edit\s+to\s+(.+)$"),
    ("Create", r"(?i)^Created\s+(.+)$"),
    ("Read", r"(?i)^Reading\s+(.+)$"),
)


def _linked(events: DataFrame) -> DataFrame:
    """Events in log order with links inferred from it."""
    ordered = placed(events).withColumn("parent_event_id", F.lit(None).cast("string"))
    return finish(infer_relations(ordered))


def _first_copies(raw: DataFrame) -> DataFrame:
    """First occurrence of every distinct line of a session; blanks dropped."""
    line = F.trim("value")
    return (
        raw.filter(line != "")
        .groupBy("session_id", line.alias("value"))
        .agg(F.min("line_no").alias("line_no"))
    )


def ingest_opencode_log(lines: DataFrame) -> DataFrame:
    """Tool registry lines: completions paired first-in-first-out with starts per tool.

    A completion with no open start consumes none. Such orphans are the completions at
    which starts minus completions falls to a new minimum below zero; the n-th other
    completion belongs to the n-th start.
    """
    # Every line is matched once; what follows reads the written fields.
    found = cut(
        lines.select(
            "session_id",
            "line_no",
            F.regexp_extract("value", OPENCODE_LINE, 3).alias("status"),
            F.regexp_extract("value", OPENCODE_LINE, 5).alias("tool"),
            F.nullif(F.regexp_extract("value", OPENCODE_LINE, 4), F.lit("")).cast("double").alias("logged"),
            F.concat(
                F.regexp_extract("value", OPENCODE_LINE, 1), F.lit("T"), F.regexp_extract("value", OPENCODE_LINE, 2)
            ).alias("timestamp"),
        )
    ).filter("status <> '' AND tool <> 'invalid'")
    scope = ["session_id", "tool"]
    df = found.withColumn("at", F.col("line_no") + 1)
    is_start = F.col("status") == "started"
    df = cut(running_sum(df, {"level": F.when(is_start, 1).otherwise(-1), "start_no": is_start.cast("int")}, scope, "at"))
    starts = df.filter(is_start).select(
        *scope, F.col("start_no").alias("done_no"), F.col("timestamp").alias("begun"), F.lit(False).alias("orphan")
    )
    # Levels move by one, so each orphan lowers the minimum by one: its depth is their number.
    lowest = F.coalesce(F.least(F.col("lowest"), F.lit(0)), F.lit(0))
    orphans = -F.least(F.col("level"), lowest)
    done = (
        _running_min(df, scope)
        .filter(~is_start)
        .withColumn("orphan", F.col("level") < lowest)
        .withColumn("done_no", F.col("start_no") - F.col("level") - orphans)
        .join(starts, [*scope, "done_no", "orphan"], "left")
    )
    spent = F.greatest(
        (F.unix_micros(iso_timestamp("timestamp")) - F.unix_micros(iso_timestamp("begun"))) / F.lit(1000.0), F.lit(0.0)
    )
    events = done.select(
        "session_id",
        "line_no",
        F.lit(0).alias("part"),
        event_id().alias("event_id"),
        F.col("tool").alias("tool_name"),
        F.lit("{}").alias("tool_input"),
        "timestamp",
        F.coalesce("logged", F.when(F.col("begun").isNotNull(), spent)).alias("duration_ms"),
    )
    return _linked(events)


def _running_min(df: DataFrame, scope: list[str]) -> DataFrame:
    """Lowest ``level`` before each row, by slices."""
    from pyspark.sql import Window

    from skein.operators.ordering import SLICE_ROWS

    cut_rows = df.withColumn("_slice", F.floor((F.col("at") - 1) / SLICE_ROWS))
    prior = Window.partitionBy(*scope, "_slice").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*scope).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    lows = (
        cut_rows.groupBy(*scope, "_slice")
        .agg(F.min("level").alias("_m"))
        .withColumn("_before", F.min("_m").over(before))
        .drop("_m")
    )
    return (
        cut_rows.withColumn("_in", F.min("level").over(prior))
        .join(lows, [*scope, "_slice"])
        .withColumn("lowest", F.least("_in", "_before"))
        .drop("_slice", "_in", "_before")
    )


def _epoch_or_text(v: str, *paths: str) -> Column:
    from skein.functions.columns import epoch_to_iso

    out = []
    for p in paths:
        number = F.when(get(v, p).rlike(r"^[0-9.]+$"), get(v, p, "double"))
        out.append(F.coalesce(epoch_to_iso(F.nullif(number, F.lit(0.0))), F.nullif(get(v, p), F.lit(""))))
    return F.coalesce(*out)


def ingest_continue_log(lines: DataFrame) -> DataFrame:
    """JSON log lines that are tool calls by field or by message text."""
    df = _first_copies(lines).select("session_id", "line_no", F.try_parse_json("value").alias("v"))
    tool = F.coalesce(F.try_variant_get("v", "$.tool", "variant"), F.try_variant_get("v", "$.tool_call", "variant"))
    has_field = F.lit(False)
    for k in ("tool", "tool_call", "function_call"):
        has_field = has_field | F.try_variant_get("v", f"$.{k}", "variant").isNotNull()
    df = df.select(
        "session_id",
        "line_no",
        F.coalesce(get("v", "$.message"), F.lit("")).alias("message"),
        F.try_parse_json(get("v", "$.raw")).alias("raw"),
        tool.alias("tool"),
        has_field.alias("has_field"),
        _epoch_or_text("v", "$.timestamp", "$.time", "$.createdAt").alias("timestamp"),
    )

    def named(x: str, n: int) -> list[Column]:
        return [
            first_of(get(x, "$.name"), get(x, "$.function")).alias(f"n{n}"),
            first_of(get(x, "$.input"), get(x, "$.arguments")).alias(f"i{n}"),
            first_of(get(x, "$.output"), get(x, "$.result")).alias(f"o{n}"),
        ]

    in_text = first_of(*[F.regexp_extract("message", p, 1) for p in CONTINUE_PATTERNS])
    # Every line is parsed once: a filter on values of the parsed line would parse it again for each.
    df = cut(
        df.select(
            "session_id", "line_no", "message", "has_field", "timestamp", in_text.alias("in_text"), *named("tool", 1), *named("raw", 2)
        )
    )
    word = F.trim(F.split_part(F.split_part("in_text", F.lit(":"), F.lit(1)), F.lit(" "), F.lit(1)))
    name = F.coalesce("n1", "n2", word)
    of_tool, of_raw = F.col("n1").isNotNull(), F.col("n2").isNotNull()
    events = df.filter(F.col("in_text").isNotNull() | F.col("has_field")).filter(name.isNotNull()).select(
        "session_id",
        "line_no",
        F.lit(0).alias("part"),
        event_id().alias("event_id"),
        canonical_tool(name, "continue").alias("tool_name"),
        F.coalesce(
            F.substring(F.when(of_tool, F.col("i1")).when(of_raw, F.col("i2")).otherwise(F.substring("message", 1, 300)), 1, 2000),
            F.lit("{}"),
        ).alias("tool_input"),
        F.substring(F.when(of_tool, F.col("o1")).when(of_raw, F.col("o2")), 1, 2000).alias("tool_output"),
        "timestamp",
        F.lit("continue").alias("agent"),
    )
    return _linked(events)


def ingest_copilot_log(lines: DataFrame) -> DataFrame:
    """Editor log lines: an embedded JSON object, else one of four line patterns."""
    df = _first_copies(lines)
    df = df.withColumn("v", F.try_parse_json(F.regexp_extract("value", r"(\{.*\})", 1)))
    given = F.coalesce(
        *[F.try_variant_get("v", f"$.{k}", "variant") for k in ("input", "arguments", "args")]
    )
    # Only the first pattern can match without a word.
    first, *rest = COPILOT_PATTERNS
    hit = F.when(F.col("value").rlike(first), F.regexp_extract("value", first, 1)).otherwise(
        first_of(*[F.regexp_extract("value", p, 1) for p in rest])
    )
    df = df.select(
        "session_id",
        "line_no",
        "value",
        first_of(get("v", "$.name"), get("v", "$.tool"), get("v", "$.function")).alias("name"),
        given.alias("given"),
        first_of(get("v", "$.output"), get("v", "$.result")).alias("out"),
    )
    name, text = F.col("name"), F.try_variant_get("given", "$", "string")
    is_object = F.schema_of_variant("given").startswith("OBJECT")
    # Every line is parsed once: a filter on values of the parsed line would parse it again for each.
    df = cut(
        df.select(
            "session_id",
            "line_no",
            "value",
            name,
            F.coalesce(name, F.nullif(hit, F.lit(""))).alias("tool"),
            F.when(name.isNull(), json_object(raw=F.substring("value", 1, 300)))
            .when(is_object, F.to_json("given"))
            .when(text.isNotNull(), json_object(text=F.substring(text, 1, 2000)))
            .otherwise("{}")
            .alias("tool_input"),
            F.when(name.isNotNull(), F.substring("out", 1, 2000)).alias("tool_output"),
        )
    )
    stamp = F.regexp_extract("value", r"^\[(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})", 1)
    events = df.filter("tool IS NOT NULL").select(
        "session_id",
        "line_no",
        F.lit(0).alias("part"),
        event_id().alias("event_id"),
        canonical_tool(F.col("tool"), "copilot").alias("tool_name"),
        "tool_input",
        "tool_output",
        F.nullif(F.regexp_replace(stamp, r"\s+", "T"), F.lit("")).alias("timestamp"),
        F.lit("copilot").alias("agent"),
    )
    return _linked(events)


def ingest_codex_log(lines: DataFrame) -> DataFrame:
    """Older and newer call records of one log, ordered by time, with inferred links."""
    df = lines.filter(F.trim("value") != "").withColumn("v", F.try_parse_json("value")).filter("v IS NOT NULL")
    kind = get("v", "$.payload.type")
    new = (get("v", "$.type") == "response_item") & kind.isin(
        "function_call", "function_call_output", "custom_tool_call", "custom_tool_call_output"
    )
    fresh = df.filter(new).select(
        "session_id", "line_no", "v", kind.alias("kind"), F.coalesce(get("v", "$.payload.call_id"), F.lit("")).alias("call_id")
    )
    outputs = (
        fresh.filter(F.col("kind").endswith("_output"))
        .groupBy("session_id", "call_id")
        .agg(F.max_by(get("v", "$.payload.output"), "line_no").alias("out"))
    )
    calls = (
        fresh.filter(~F.col("kind").endswith("_output"))
        .groupBy("session_id", "call_id")
        .agg(F.max_by(F.struct("line_no", "kind", F.to_json("v").alias("j")), "line_no").alias("c"))
        .select("session_id", "call_id", "c.line_no", "c.kind", F.parse_json("c.j").alias("v"))
        .join(outputs, ["session_id", "call_id"], "left")
    )
    args = F.coalesce(
        get("v", "$.payload.arguments"),
        F.lit("{}"),
    )
    parsed_args = F.when(F.try_parse_json(args).isNotNull(), args).otherwise(json_object(raw=args))
    custom = F.coalesce(get("v", "$.payload.input"), get("v", "$.payload.arguments"), F.lit("{}"))
    modern = calls.select(
        "session_id",
        "line_no",
        canonical_tool(F.coalesce(get("v", "$.payload.name"), F.lit("")), "codex").alias("tool_name"),
        F.when(F.col("kind") == "function_call", parsed_args).otherwise(custom).alias("tool_input"),
        F.nullif("out", F.lit("")).alias("tool_output"),
        F.nullif(get("v", "$.timestamp"), F.lit("")).alias("timestamp"),
    )
    old = df.filter(~F.coalesce(new, F.lit(False)))
    old = (
        old.withColumn("_h", F.sha1(F.to_json("v")))
        .groupBy("session_id", "_h")
        .agg(F.min_by(F.struct("line_no", "value"), "line_no").alias("c"))
        .select("session_id", "c.line_no", F.parse_json("c.value").alias("v"))
    )
    act = F.coalesce(F.try_variant_get("v", "$.action", "variant"), F.try_variant_get("v", "$.content", "variant"))
    obs = F.coalesce(F.try_variant_get("v", "$.observation", "variant"), F.try_variant_get("v", "$.content", "variant"))
    tool = F.coalesce(F.try_variant_get("v", "$.tool", "variant"), F.try_variant_get("v", "$.tool_call", "variant"))
    items = F.filter(
        F.when(get("v", "$.role") == "assistant", F.try_variant_get("v", "$.content", "array<variant>")),
        lambda b: first_of(get(b, "$.type"), get(b, "$.name")).isNotNull(),
    )
    item = F.get(items, 0)

    def text(x: Column, *keys: str) -> Column:
        return first_of(*[get(x, f"$.{k}") for k in keys])

    is_act, is_obs = get("v", "$.type") == "action", get("v", "$.type") == "observation"
    an = F.when(is_act, text(act, "name", "function", "tool"))
    on = F.when(is_obs, text(obs, "name", "function"))
    rn = first_of(get(item, "$.type"), get(item, "$.name"))
    tn = text(tool, "name", "function")
    name = F.coalesce(an, on, rn, tn)
    legacy = old.filter(name.isNotNull()).select(
        "session_id",
        "line_no",
        canonical_tool(name, "codex").alias("tool_name"),
        F.coalesce(
            F.when(an.isNotNull(), text(act, "input", "arguments", "args"))
            .when(on.isNotNull(), F.lit(None))
            .when(rn.isNotNull(), text(item, "input", "arguments"))
            .otherwise(text(tool, "input", "arguments", "args")),
            F.lit("{}"),
        ).alias("tool_input"),
        F.when(an.isNotNull(), F.lit(None))
        .when(on.isNotNull(), text(obs, "output", "result", "content"))
        .when(rn.isNotNull(), F.lit(None))
        .otherwise(text(tool, "output", "result"))
        .alias("tool_output"),
        _epoch_or_text("v", "$.timestamp", "$.time", "$.createdAt", "$.ts").alias("timestamp"),
    )
    events = (
        legacy.unionByName(modern)
        .filter("timestamp IS NOT NULL")
        .withColumn("event_id", event_id())
        .withColumn("agent", F.lit("codex"))
    )
    from skein.operators.ordering import with_position

    ordered = with_position(events, list(SESSION), "timestamp", "line_no")
    return finish(infer_relations(ordered.withColumn("parent_event_id", F.lit(None).cast("string"))))


def ingest_aider_log(lines: DataFrame) -> DataFrame:
    """Transcript lines that show a command, edit, new file or read file, in a chain."""
    line = F.trim("value")
    tool = F.coalesce(*[F.when(line.rlike(p), F.lit(name)) for name, p in AIDER_PATTERNS])
    arg = F.coalesce(*[F.when(line.rlike(p), F.regexp_extract(line, p, 1)) for _, p in AIDER_PATTERNS])
    events = lines.filter(tool.isNotNull()).select(
        "session_id",
        "line_no",
        F.lit(0).alias("part"),
        event_id().alias("event_id"),
        tool.alias("tool_name"),
        F.substring(F.trim(arg), 1, 500).alias("tool_input"),
        F.lit("aider").alias("agent"),
    )
    return finish(serial_chain(events))
