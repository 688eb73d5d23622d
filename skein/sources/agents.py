"""Structured agent logs and tables to events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.columns import epoch_to_iso
from skein.operators.lineage import cut
from skein.operators.ordering import running_last
from skein.sources.attribution import canonical_tool, infer_provider
from skein.sources.raw import (
    arguments,
    blank,
    event_id,
    finish,
    first_of,
    get,
    json_object,
    parsed,
    serial_chain,
)

TEXT_LIMIT = 2000
REPLY_LIMIT = 500

# Tool arguments kept from project logs.
PROJECT_INPUT_KEYS = (
    "command",
    "file_path",
    "pattern",
    "url",
    "query",
    "old_string",
    "new_string",
    "content",
    "description",
    "name",
    "arguments",
)


def clip(col: Column, limit: int = TEXT_LIMIT) -> Column:
    return F.substring(col, 1, limit)


def kept_keys(obj: Column, keys: tuple[str, ...]) -> Column:
    """JSON object reduced to the named keys."""
    fields = F.try_variant_get(obj, "$", "map<string,variant>")
    return F.to_json(F.map_filter(fields, lambda k, _: k.isin(*keys)))


def ingest_codex(raw: DataFrame) -> DataFrame:
    """Rollout records: messages, reasoning and function calls in one serial chain.

    The first output of a call goes to it; a further one, and an output without a call,
    becomes an ``unknown`` call.
    """
    blocks = F.filter(
        get("v", "$.payload.content", "array<variant>"), lambda b: get(b, "$.type") == "output_text"
    )
    text = F.array_join(F.transform(blocks, lambda b: F.coalesce(get(b, "$.text"), F.lit(""))), "\n")
    named = ("message", "role", "name", "arguments", "output", "model", "model_provider")
    # Every line is parsed once; what follows reads the written fields.
    rows = cut(
        parsed(raw).select(
            "session_id", "line_no",
            get("v", "$.type").alias("type"),
            get("v", "$.payload.type").alias("kind"),
            get("v", "$.payload.call_id").alias("call_id"),
            get("v", "$.timestamp").alias("at"),
            text.alias("text"),
            *[get("v", f"$.payload.{n}").alias(f"p_{n}") for n in named],
        )
    )
    df = running_last(
        rows.withColumn("pos", F.col("line_no") + 1),
        {
            "provider": F.when(F.col("type") == "session_meta", F.coalesce("p_model_provider", F.lit(""))),
            "model": F.when(F.col("type") == "turn_context", F.coalesce("p_model", F.lit(""))),
        },
    )
    item, msg = F.col("type") == "response_item", F.col("type") == "event_msg"
    thinking = msg & (F.col("kind") == "agent_message") & ~blank(F.col("p_message"))
    call = item & (F.col("kind") == "function_call")
    output = item & (F.col("kind") == "function_call_output")
    reply = item & (F.col("kind") == "message") & (F.col("p_role") == "assistant") & ~blank(F.col("text"))
    called = rows.filter(call).select("session_id", F.coalesce("call_id", F.lit("")).alias("call_id"), F.col("line_no").alias("call_line"))
    results = (
        rows.filter(output)
        .select(
            "session_id",
            "line_no",
            F.coalesce("call_id", F.lit("")).alias("call_id"),
            clip(F.nullif("p_output", F.lit(""))).alias("out"),
        )
        .join(called, ["session_id", "call_id"], "left")
        .groupBy("session_id", "line_no", "call_id", "out")
        .agg(F.max(F.when(F.col("call_line") < F.col("line_no"), F.col("call_line"))).alias("call_line"))
    )
    # Outputs of one call are few; only the first one takes the call, the others have none.
    nth = F.row_number().over(Window.partitionBy("session_id", "call_line").orderBy("line_no"))
    told = results.filter("call_line IS NOT NULL").withColumn("call_line", F.when(nth == 1, F.col("call_line")))
    results = told.unionByName(results.filter("call_line IS NULL"))
    paired = results.filter("call_line IS NOT NULL").groupBy("session_id", "call_line").agg(
        F.min_by("out", "line_no").alias("out")
    )
    lost = results.filter("call_line IS NULL").select("session_id", "line_no", F.col("out").alias("lost"), F.lit(True).alias("orphan"))
    df = df.join(
        paired.withColumnRenamed("call_line", "line_no"), ["session_id", "line_no"], "left"
    ).join(lost, ["session_id", "line_no"], "left")
    orphan = F.coalesce("orphan", F.lit(False))
    events = df.filter(thinking | call | reply | orphan).select(
        "session_id",
        "line_no",
        F.lit(0).alias("part"),
        event_id().alias("event_id"),
        F.when(call | orphan, "tool_call").otherwise("reasoning").alias("event_type"),
        F.when(thinking, "Thinking")
        .when(call, F.coalesce("p_name", F.lit("unknown")))
        .when(reply, "Response")
        .otherwise("unknown")
        .alias("tool_name"),
        F.when(thinking, json_object(content=clip(F.col("p_message"))))
        .when(call, arguments(F.col("p_arguments")))
        .when(reply, json_object(text=clip(F.col("text"), REPLY_LIMIT)))
        .alias("tool_input"),
        F.coalesce("out", "lost").alias("tool_output"),
        F.regexp_replace("at", "Z$", "+00:00").alias("timestamp"),
        F.nullif("model", F.lit("")).alias("model"),
        F.nullif("provider", F.lit("")).alias("provider"),
        F.lit("codex").alias("agent"),
    )
    return finish(serial_chain(events))


def ingest_claude_project(raw: DataFrame) -> DataFrame:
    """Project records: the content blocks of every message in one serial chain."""
    blocks = parsed(raw).select(
        "session_id",
        "line_no",
        get("v", "$.timestamp").alias("timestamp"),
        get("v", "$.message.model").alias("model"),
        F.posexplode(get("v", "$.message.content", "array<variant>")).alias("part", "b"),
    )
    kind = get("b", "$.type")
    thinking, use = kind == "thinking", kind == "tool_use"
    text = (kind == "text") & ~blank(get("b", "$.text"))
    events = blocks.filter(thinking | use | text).select(
        "session_id",
        "line_no",
        "part",
        event_id(F.col("part").cast("string")).alias("event_id"),
        F.when(use, "tool_call").otherwise("reasoning").alias("event_type"),
        F.when(thinking, "Thinking")
        .when(use, F.coalesce(get("b", "$.name"), F.lit("")))
        .otherwise("Response")
        .alias("tool_name"),
        F.when(thinking, json_object(content=F.coalesce(get("b", "$.thinking"), F.lit(""))))
        .when(
            use,
            F.coalesce(
                kept_keys(F.try_variant_get("b", "$.input", "variant"), PROJECT_INPUT_KEYS), F.lit("{}")
            ),
        )
        .otherwise(json_object(text=clip(get("b", "$.text"), REPLY_LIMIT)))
        .alias("tool_input"),
        "timestamp",
        "model",
        infer_provider(F.col("model"), "prefix", F.lit("anthropic")).alias("provider"),
        F.lit("claude-code").alias("agent"),
    )
    return finish(serial_chain(events))


def ingest_opencode(part: DataFrame, message: DataFrame) -> DataFrame:
    """Parts of assistant messages in creation order, attributed to the user's message."""
    m = message.select(
        F.col("id").alias("message_id"), "session_id", F.try_parse_json("data").alias("m")
    )
    users = m.filter(get("m", "$.role") == "user").select(
        "session_id",
        F.col("message_id").alias("asked"),
        get("m", "$.model.modelID").alias("model"),
        get("m", "$.model.providerID").alias("provider"),
        get("m", "$.agent").alias("agent"),
    )
    replies = m.filter(get("m", "$.role") == "assistant").select(
        "session_id", "message_id", get("m", "$.parentID").alias("asked")
    )
    p = part.select(
        "session_id", "message_id", F.col("id").alias("part_id"), F.col("time_created"), F.try_parse_json("data").alias("p")
    )
    df = p.join(replies, ["session_id", "message_id"]).join(users, ["session_id", "asked"], "left")
    kind = get("p", "$.type")
    tool, patch = kind == "tool", kind == "patch"
    text = (kind == "text") & ~blank(get("p", "$.text"))
    stamp = F.coalesce(
        F.nullif(get("p", "$.time.start", "double"), F.lit(0.0)),
        F.nullif(get("p", "$.state.time.start", "double"), F.lit(0.0)),
        F.nullif(F.col("time_created").cast("double"), F.lit(0.0)),
    )
    begin, end = get("p", "$.state.time.start", "double"), get("p", "$.state.time.end", "double")
    spent = F.when((begin != 0) & (end != 0), ((end - begin) / 1000).cast("bigint").cast("double"))
    given = F.try_variant_get("p", "$.state.input", "variant")
    tool_input = (
        F.when(F.schema_of_variant(given).startswith("OBJECT"), F.to_json(given))
        .when(first_of(get("p", "$.state.input")).isNotNull(), json_object(text=clip(get("p", "$.state.input"))))
        .otherwise("{}")
    )
    keep = (kind == "reasoning") | text | tool | patch
    events = df.filter(keep).select(
        "session_id",
        F.col("time_created").alias("line_no"),
        F.col("part_id").alias("part"),
        F.concat("session_id", F.lit(":"), "part_id").alias("event_id"),
        F.when(tool | patch, "tool_call").otherwise("reasoning").alias("event_type"),
        F.when(tool, canonical_tool(first_of(get("p", "$.tool"), F.lit("Unknown")), "opencode"))
        .when(patch, "Edit")
        .when(text, "Response")
        .otherwise("Thinking")
        .alias("tool_name"),
        F.when(tool, tool_input)
        .when(patch, json_object(files=F.coalesce(get("p", "$.files", "array<string>"), F.array())))
        .when(text, json_object(text=clip(get("p", "$.text"), REPLY_LIMIT)))
        .otherwise(json_object(content=clip(F.coalesce(get("p", "$.text"), F.lit("")))))
        .alias("tool_input"),
        F.when(tool, clip(first_of(get("p", "$.state.output")))).alias("tool_output"),
        epoch_to_iso(stamp).alias("timestamp"),
        F.when(tool, spent).alias("duration_ms"),
        F.when(~patch, F.nullif("model", F.lit(""))).alias("model"),
        F.when(~patch, F.nullif("provider", F.lit(""))).alias("provider"),
        F.when(patch, "opencode").otherwise(first_of(F.col("agent"), F.lit("opencode"))).alias("agent"),
    )
    return finish(serial_chain(events))


def ingest_hermes(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Assistant messages: reasoning, then each tool call with the tool message's output."""
    live = messages.filter("active = 1")
    outputs = (
        live.filter("role = 'tool' AND coalesce(tool_call_id, '') <> '' AND coalesce(content, '') <> ''")
        .groupBy("session_id", F.col("tool_call_id").alias("call_id"))
        .agg(F.max_by("content", F.struct("timestamp", "id")).alias("out"))
    )
    said = live.filter("role = 'assistant'").join(
        sessions.select(F.col("id").alias("session_id"), F.coalesce("model", F.lit("")).alias("model")), "session_id"
    )
    base = [
        "session_id",
        F.round(F.col("timestamp") * 1000000).cast("bigint").alias("line_no"),
        F.col("id").alias("_id"),
        "timestamp",
        "model",
    ]
    thinking = said.filter(~blank(F.col("reasoning"))).select(
        *base,
        F.lit(-1).alias("nth"),
        F.lit("Thinking").alias("tool_name"),
        F.lit("reasoning").alias("event_type"),
        json_object(content=clip(F.col("reasoning"))).alias("tool_input"),
        F.lit("").alias("call_id"),
    )
    calls = said.select(
        *base,
        F.posexplode(F.try_variant_get(F.try_parse_json("tool_calls"), "$", "array<variant>")).alias("nth", "tc"),
    ).select(
        "session_id",
        "line_no",
        "_id",
        "timestamp",
        "model",
        "nth",
        F.coalesce(get("tc", "$.function.name"), F.lit("unknown")).alias("tool_name"),
        F.lit("tool_call").alias("event_type"),
        arguments(get("tc", "$.function.arguments")).alias("tool_input"),
        first_of(get("tc", "$.call_id"), get("tc", "$.id"), F.lit("-")).alias("call_id"),
    )
    rows = thinking.unionByName(calls).join(outputs, ["session_id", "call_id"], "left")
    events = rows.select(
        "session_id",
        "line_no",
        F.struct("_id", "nth").alias("part"),
        F.concat("session_id", F.lit(":"), F.concat_ws(".", F.col("_id").cast("string"), F.col("nth").cast("string"))).alias("event_id"),
        "event_type",
        "tool_name",
        "tool_input",
        clip(F.col("out")).alias("tool_output"),
        epoch_to_iso(F.col("timestamp")).alias("timestamp"),
        F.nullif("model", F.lit("")).alias("model"),
        F.nullif(infer_provider(F.col("model"), "substring"), F.lit("")).alias("provider"),
        F.lit("hermes").alias("agent"),
    )
    return finish(serial_chain(events))
