"""Queries on ingest: raw agent logs are written from the test events and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import structure as S
from skein.operators.lineage import cut, fresh_path
from skein.operators.ordering import prepare
from skein.plans.catalog import query
from skein.plans.oracle import NATIVE, RAW
from skein.plans.timing import ATTR, attributed
from skein.plans.views import numbered, table, trace_native
from skein.sources import agents, attribution, dsh, hooks, raw, textlogs


def _src(spark, sf):
    """Events with session, position and the number ``k`` that shapes the log record."""
    src = numbered(spark, sf).select(
        "session_id",
        "event_id",
        "pos",
        F.col("event_type").alias("kind"),
        "timestamp",
        "ts",
        "duration_ms",
        "k",
    )
    # A log is read more than once; its events are ranked only here.
    return cut(src)


def obj(**fields):
    return F.struct(*[(c if not isinstance(c, str) else F.lit(c)).alias(n) for n, c in fields.items()])


def lines_of(src, *records):
    """Raw lines: record i of the event at position p is line p * n + i."""
    n = len(records)
    entries = F.array(
        *[F.struct((F.col("pos") * n + i).alias("line_no"), r.alias("value")) for i, r in enumerate(records)]
    )
    return src.select("session_id", F.inline(entries)).filter("value IS NOT NULL")


EV = f"WITH {RAW}, sx AS (SELECT session_id, event_id, pos, event_type AS kind, k, ts, duration_ms FROM raw_ev)"


def slim(df, *extra):
    return df.select("session_id", "event_id", "parent_event_id", "tool_name", *extra)


@query(
    "ingest_codex",
    EV
    + """,
ln AS (SELECT *, k % 10 AS r FROM sx),
cr AS (SELECT *, last_value(CASE WHEN r = 0 THEN 'm' || k END IGNORE NULLS) OVER w AS model,
   last_value(CASE WHEN r = 1 THEN 'p' || k END IGNORE NULLS) OVER w AS provider FROM ln
   WINDOW w AS (PARTITION BY session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
em AS (SELECT session_id, pos, session_id || ':' || (pos * 2) AS event_id, CASE WHEN r IN (2, 3) THEN 'Thinking' WHEN r IN (4, 5, 6) THEN kind WHEN r = 7 THEN 'unknown' ELSE 'Response' END AS tool_name,
   CASE WHEN r IN (4, 5) THEN 'out ' || k WHEN r = 7 THEN 'lost' END AS tool_output, model, provider FROM cr WHERE r BETWEEN 2 AND 8)
SELECT session_id, event_id, lag(event_id) OVER (PARTITION BY session_id ORDER BY pos) AS parent_event_id, tool_name, tool_output, model, provider FROM em""",
)
def ingest_codex(spark, sf):
    r, k = F.col("k") % 10, F.col("k").cast("string")
    item = {
        "agent_message": obj(type="agent_message", message=F.concat(F.lit("note "), k)),
        "call": obj(
            type="function_call", name=F.col("kind"), call_id=F.col("event_id"), arguments=F.concat(F.lit('{"k": '), k, F.lit("}"))
        ),
        "lost": obj(type="function_call_output", call_id=F.concat(F.lit("x"), F.col("event_id")), output="lost"),
        "reply": obj(
            type="message", role="assistant", content=F.array(obj(type="output_text", text="hi"), obj(type="other", text="no"))
        ),
        "output": obj(type="function_call_output", call_id=F.col("event_id"), output=F.concat(F.lit("out "), k)),
    }

    def rec(kind, payload):
        return F.to_json(F.struct(F.col("timestamp"), F.lit(kind).alias("type"), payload.alias("payload")))

    first = (
        F.when(r == 0, rec("turn_context", obj(model=F.concat(F.lit("m"), k))))
        .when(r == 1, rec("session_meta", obj(model_provider=F.concat(F.lit("p"), k))))
        .when(r.isin(2, 3), rec("event_msg", item["agent_message"]))
        .when(r.isin(4, 5, 6), rec("response_item", item["call"]))
        .when(r == 7, rec("response_item", item["lost"]))
        .when(r == 8, rec("response_item", item["reply"]))
        .otherwise(rec("compacted", obj(a="b")))
    )
    second = F.when(r.isin(4, 5), rec("response_item", item["output"]))
    lines = lines_of(_src(spark, sf), first, second)
    return slim(agents.ingest_codex(lines), "tool_output", "model", "provider")


@query(
    "ingest_claude_project",
    EV
    + """,
bl AS (
  SELECT *, 0 AS part, 'Thinking' AS tool_name FROM sx WHERE k % 3 = 0
  UNION ALL SELECT *, 1, kind FROM sx WHERE k % 2 = 0
  UNION ALL SELECT *, 3, 'Response' FROM sx WHERE k % 5 = 0),
em AS (SELECT session_id, session_id || ':' || pos || '.' || part AS event_id, tool_name, pos, part,
  CASE k % 4 WHEN 0 THEN 'claude-x' WHEN 1 THEN 'gpt-4' WHEN 2 THEN 'other' END AS model,
  CASE WHEN tool_name = kind THEN '{"command":"c' || k || '"}' END AS input,
  CASE WHEN k % 4 = 1 THEN 'openai' ELSE 'anthropic' END AS provider FROM bl)
SELECT session_id, event_id, lag(event_id) OVER (PARTITION BY session_id ORDER BY pos, part) AS parent_event_id, tool_name, input, model, provider FROM em""",
)
def ingest_claude_project(spark, sf):
    k = F.col("k")
    ks = k.cast("string")
    none = F.lit(None).cast("string")
    shape = dict(type=none, thinking=none, name=none, input=F.lit(None).cast("struct<command:string,secret:string>"), text=none)

    def block(**fields):
        full = {**shape, **fields}
        return F.struct(*[(c if not isinstance(c, str) else F.lit(c)).alias(n) for n, c in full.items()])

    content = F.array(
        F.when(k % 3 == 0, block(type="thinking", thinking="hm")).otherwise(block(type="tool_result")),
        F.when(k % 2 == 0, block(type="tool_use", name=F.col("kind"), input=F.struct(F.concat(F.lit("c"), ks).alias("command"), F.lit("s").alias("secret"))))
        .otherwise(block(type="tool_result")),
        block(type="text", text="  "),
        F.when(k % 5 == 0, block(type="text", text="done")).otherwise(block(type="tool_result")),
    )
    model = F.when(k % 4 == 0, "claude-x").when(k % 4 == 1, "gpt-4").when(k % 4 == 2, "other")
    line = F.to_json(F.struct(F.col("timestamp"), F.struct(model.alias("model"), content.alias("content")).alias("message")))
    out = agents.ingest_claude_project(lines_of(_src(spark, sf), line))
    use = (F.col("event_type") == "tool_call")
    return slim(out, F.when(use, F.col("tool_input")).alias("input"), "model", "provider")


@query(
    "ingest_opencode",
    EV
    + """,
em AS (SELECT session_id, pos, session_id || ':' || lpad(pos::VARCHAR, 8, '0') AS event_id,
  CASE k % 5 WHEN 0 THEN 'Thinking' WHEN 1 THEN 'Response' WHEN 2 THEN CASE kind WHEN 'view' THEN 'Read' WHEN 'click' THEN 'Bash' ELSE 'custom' END WHEN 4 THEN 'Edit' END AS tool_name,
  CASE WHEN k % 5 = 2 THEN k::DOUBLE END AS duration_ms, CASE WHEN k % 5 <> 4 THEN 'mod' || session_id END AS model,
  CASE WHEN k % 5 = 4 THEN 'opencode' ELSE 'build' END AS agent FROM sx WHERE k % 5 <> 3)
SELECT session_id, event_id, lag(event_id) OVER (PARTITION BY session_id ORDER BY pos) AS parent_event_id, tool_name, duration_ms, model, agent FROM em""",
)
def ingest_opencode(spark, sf):
    src = _src(spark, sf)
    k, us = F.col("k"), F.unix_micros("ts")
    tool = F.when(F.col("kind") == "view", "read").when(F.col("kind") == "click", "bash").otherwise("custom")
    data = (
        F.when(k % 5 == 0, F.to_json(obj(type="reasoning", text="why")))
        .when(k % 5 == 1, F.to_json(obj(type="text", text="answer")))
        .when(
            k % 5 == 2,
            F.to_json(
                obj(
                    type="tool",
                    tool=tool,
                    state=obj(input=obj(a="b"), output="out", time=F.struct(us.alias("start"), (us + k * 1000 + 7).alias("end"))),
                )
            ),
        )
        .when(k % 5 == 3, F.to_json(obj(type="step-start", text="x")))
        .otherwise(F.to_json(obj(type="patch", files=F.array(F.lit("f.py")))))
    )
    part = src.select(
        F.lpad(F.col("pos").cast("string"), 8, "0").alias("id"),
        F.concat(F.lit("a"), F.col("session_id")).alias("message_id"),
        "session_id",
        F.unix_millis("ts").alias("time_created"),
        data.alias("data"),
    )
    ids = src.select("session_id").distinct()
    user = ids.select(
        F.concat(F.lit("u"), F.col("session_id")).alias("id"),
        "session_id",
        F.to_json(obj(role="user", agent="build", model=obj(modelID=F.concat(F.lit("mod"), F.col("session_id")), providerID="prov"))).alias("data"),
    )
    reply = ids.select(
        F.concat(F.lit("a"), F.col("session_id")).alias("id"),
        "session_id",
        F.to_json(obj(role="assistant", parentID=F.concat(F.lit("u"), F.col("session_id")))).alias("data"),
    )
    return slim(agents.ingest_opencode(part, user.unionByName(reply)), "duration_ms", "model", "agent")


@query(
    "ingest_hermes",
    EV
    + """,
bl AS (SELECT *, -1 AS nth, 'Thinking' AS tool_name, NULL AS tool_output FROM sx WHERE k % 4 = 0 AND k % 6 <> 5
  UNION ALL SELECT *, 0, kind, CASE WHEN k % 3 = 0 THEN 'res' || event_id END FROM sx WHERE k % 2 = 0 AND k % 6 <> 5
  UNION ALL SELECT *, 1, 'second', NULL FROM sx WHERE k % 2 = 0 AND k % 6 <> 5)
SELECT session_id, session_id || ':' || event_id || '.' || nth AS event_id,
  lag(session_id || ':' || event_id || '.' || nth) OVER (PARTITION BY session_id ORDER BY pos, nth) AS parent_event_id,
  tool_name, tool_output, 'gpt-x' AS model, 'openai' AS provider FROM bl""",
)
def ingest_hermes(spark, sf):
    src = _src(spark, sf)
    k = F.col("k")
    calls = F.to_json(
        F.array(
            obj(id=F.concat(F.lit("c"), F.col("event_id")), function=obj(name=F.col("kind"), arguments='{"a": 1}')),
            obj(id=F.concat(F.lit("d"), F.col("event_id")), function=obj(name="second", arguments="not json")),
        )
    )
    none = F.lit(None).cast("string")
    secs = F.unix_micros("ts") / F.lit(1e6)
    said = src.select(
        F.col("event_id").cast("bigint").alias("id"), "session_id", F.lit("assistant").alias("role"), none.alias("content"),
        none.alias("tool_call_id"), F.when(k % 2 == 0, calls).alias("tool_calls"), secs.alias("timestamp"),
        F.when(k % 4 == 0, "thought").alias("reasoning"), F.when(k % 6 == 5, 0).otherwise(1).alias("active"),
    )
    told = src.filter(k % 3 == 0).select(
        (F.col("event_id").cast("bigint") + 1_000_000_000).alias("id"), "session_id", F.lit("tool").alias("role"),
        F.concat(F.lit("res"), F.col("event_id")).alias("content"), F.concat(F.lit("c"), F.col("event_id")).alias("tool_call_id"),
        none.alias("tool_calls"), secs.alias("timestamp"), none.alias("reasoning"), F.lit(1).alias("active"),
    )
    sessions = src.select(F.col("session_id").alias("id")).distinct().withColumn("model", F.lit("gpt-x"))
    return slim(agents.ingest_hermes(said.unionByName(told), sessions), "tool_output", "model", "provider")


@query(
    "ingest_dsh",
    """WITH ch AS (SELECT CAST(conv_id AS VARCHAR) AS s, turn AS t, role, text FROM conversations),
sg AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY s ORDER BY t) AS seg FROM ch),
us AS (SELECT s, seg, min(t) AS ut FROM sg WHERE role = 'user' GROUP BY 1, 2),
an AS (SELECT g.s, g.seg, g.t, g.text, lag(g.t) OVER (PARTITION BY g.s, g.seg ORDER BY g.t) AS pt FROM sg g WHERE role = 'assistant'),
ap AS (SELECT a.*, CASE WHEN pt IS NOT NULL THEN a.s || ':' || (pt * 10 + 1) || ',' || a.s || ':' || (pt * 10 + 2)
        WHEN u.ut IS NOT NULL THEN a.s || ':' || (u.ut * 10) END AS cause FROM an a LEFT JOIN us u ON u.s = a.s AND u.seg = a.seg)
SELECT s AS session_id, s || ':' || (t * 10) AS event_id, NULL AS parent_event_id, 'Prompt' AS tool_name, 'user' AS caused_by, NULL AS tool_output, NULL::DOUBLE AS duration_ms, left(text, 2000) AS said, t > 0 AND t % 4 < 2 AS mid_turn FROM sg WHERE role = 'user' AND text <> ''
UNION ALL SELECT s, s || ':' || (t * 10) || '.0', cause, 'Thinking', NULL, NULL, NULL, 'think', false FROM ap
UNION ALL SELECT s, s || ':' || (t * 10) || '.2', s || ':' || (t * 10) || '.0', 'Response', NULL, NULL, NULL, left(text, 500), false FROM ap
UNION ALL SELECT s, s || ':' || (t * 10 + i), s || ':' || (t * 10) || '.0', CASE i WHEN 1 THEN 'read' ELSE 'run_code' END, 'reasoning', CASE i WHEN 1 THEN 'ok' || chr(10) || '[isError=true]' END, CASE i WHEN 1 THEN 2.0 END, NULL, false FROM ap, (SELECT unnest([1, 2]) AS i)
UNION ALL SELECT s, s || ':' || (t * 10 + 3), s || ':' || (t * 10 + 2), 'inner', NULL, 'deep', 1.0, NULL, false FROM ap
UNION ALL SELECT s, s || ':' || (t * 10 + 6), cause, '/compact', 'user', 'done', NULL, NULL, false FROM ap""",
)
def ingest_dsh(spark, sf):
    """Chat turns as a step-structured log: each reply thinks, answers and makes two calls.

    System turns are messages of a plugin, which cause nothing. Every second pair of user turns is
    announced as inserted into the running step, the others as the next turn.
    """
    chat = table(spark, sf, "conversations")
    t = F.col("turn")
    ms = (F.lit(1_700_000_000_000) + t * 1000).cast("bigint")
    call = F.concat_ws("-", F.lit("c"), "conv_id", "turn")

    def rec(kind, data, late=0):
        return F.to_json(F.struct(F.lit(kind).alias("type"), (ms + late).alias("time"), data.alias("data")))

    step = {"turn": t.cast("int"), "step": F.lit(1)}
    is_user, is_reply = F.col("role") == "user", ~F.col("role").isin("user", "system")
    sender = F.when(is_user, "user").otherwise("plugin")
    said = {"id": F.concat(F.lit("m"), t.cast("string")), "source": obj(kind=sender)}
    user = rec("user/message", obj(**said, content=F.array(obj(type="text", text=F.col("text")))))
    target = F.when(t % 4 < 2, "next-step").otherwise("next-turn")
    spliced = rec("agent/inbox/spliced", obj(target=target, inserted=F.array(obj(**said))))
    reply = rec(
        "assistant/message",
        obj(
            **step,
            message=obj(content=F.array(obj(type="reasoning", text="think"), obj(type="text", text=" "), obj(type="text", text=F.col("text")))),
        ),
    )
    result = obj(
        message=obj(
            source=obj(callId=call),
            content=F.array(obj(type="tool-result", isError=F.lit(True), content=F.array(obj(type="text", text="ok")))),
        )
    )
    rows = [
        (-1, F.when(t > 0, spliced)),
        (0, F.when(is_reply, reply).otherwise(user)),
        (1, rec("tool/call", obj(**step, callId=call, name="read", arguments='{"a": 1}'))),
        (2, rec("tool/call", obj(**step, callId=F.concat(call, F.lit("b")), name="run_code", arguments="[1]"))),
        (3, rec("tool/code-dispatch-start", obj(subCallId=F.concat(call, F.lit("s")), parentCallId=F.concat(call, F.lit("b")), name="inner", arguments="{}"))),
        (4, rec("tool/result", result, 2)),
        (5, rec("tool/code-dispatch", obj(subCallId=F.concat(call, F.lit("s")), parentCallId=F.concat(call, F.lit("b")), content="deep"), 1)),
        (6, rec("command/run", obj(name="compact", commandId=call, args="now"))),
        (7, rec("command/done", obj(commandId=call, text="done"))),
        (8, rec("turn/end", obj(a="b"))),
    ]
    entries = F.array(
        *[
            F.struct((t * 10 + i).alias("line_no"), (v if i == 0 else F.when(~is_reply if i < 0 else is_reply, v)).alias("value"))
            for i, v in rows
        ]
    )
    lines = chat.select(F.col("conv_id").cast("string").alias("session_id"), F.inline(entries)).filter("value IS NOT NULL")
    events = dsh.ingest_dsh(lines)
    words, mid = (F.get_json_object("tool_input", f"$.{name}") for name in ("text", "mid_turn"))
    thought = F.get_json_object("tool_input", "$.content")
    is_said = F.col("tool_name").isin("Prompt", "Thinking", "Response")
    said = F.when(is_said, F.coalesce(words, thought)).alias("said")
    return slim(events, "caused_by", "tool_output", "duration_ms", said, F.coalesce(mid == "true", F.lit(False)).alias("mid_turn"))


def headers(spark, sf):
    """Session headers: every session but the first of each dozen is delegated."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.concat(F.lit("session-"), k.cast("string")).alias("id"),
        F.when(k % 12 == 5, F.concat(F.lit("gone-"), k.cast("string")))
        .when(k % 3 == 0, F.concat(F.lit("session-"), F.floor(k / 12).cast("string")))
        .when(k % 12 != 1, F.floor(k / 12).cast("string"))
        .alias("parent_session"),
        F.lpad(k.cast("string"), 9, "0").alias("created"),
    )


FOREST = """WITH RECURSIVE hd AS (SELECT c_custkey AS k, 'session-' || c_custkey AS session_id, lpad(c_custkey::VARCHAR, 9, '0') AS created,
  CASE WHEN c_custkey % 12 IN (5, 1) OR c_custkey = 0 THEN NULL ELSE 'session-' || (c_custkey // 12) END AS parent FROM customer)
"""


@query("session_forest", FOREST + "SELECT session_id, parent, created, parent IS NULL AS is_root FROM hd")
def session_forest(spark, sf):
    return dsh.session_forest(headers(spark, sf))


@query(
    "session_lineage",
    FOREST
    + """,
up(o, r, l) AS (SELECT session_id, session_id, 0 FROM hd UNION ALL SELECT o, hd.parent, l - 1 FROM up JOIN hd ON hd.session_id = up.r WHERE hd.parent IS NOT NULL),
dn(o, r, l) AS (SELECT session_id, session_id, 0 FROM hd UNION ALL SELECT o, hd.session_id, l + 1 FROM dn JOIN hd ON hd.parent = dn.r)
SELECT o AS "of", r AS relative, l AS level FROM up UNION ALL SELECT o, r, l FROM dn WHERE l > 0""",
)
def session_lineage(spark, sf):
    forest = cut(dsh.session_forest(headers(spark, sf)))
    return dsh.session_lineage(forest, forest)


@query(
    "ingest_opencode_log",
    EV
    + """,
mv AS (SELECT *, kind || (k % 2) AS tool, CASE WHEN k % 5 < 2 THEN 1 ELSE -1 END AS d FROM sx WHERE k % 7 <> 0),
lv AS (SELECT *, sum(d) OVER (PARTITION BY session_id, tool ORDER BY pos) AS lev FROM mv),
mn AS (SELECT *, d = -1 AND lev < least(0, coalesce(min(lev) OVER (PARTITION BY session_id, tool ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS orp FROM lv),
nu AS (SELECT *, count(*) FILTER (d = 1) OVER (PARTITION BY session_id, tool ORDER BY pos) AS sn,
  count(*) FILTER (d = -1 AND NOT orp) OVER (PARTITION BY session_id, tool ORDER BY pos) AS dn FROM mn)
SELECT c.session_id, c.session_id || ':' || c.pos AS event_id, c.tool AS tool_name,
  CASE WHEN c.k % 3 = 0 THEN c.k::DOUBLE WHEN NOT c.orp THEN (epoch_ms(date_trunc('second', c.ts)) - epoch_ms(date_trunc('second', s.ts)))::DOUBLE END AS duration_ms
FROM nu c LEFT JOIN nu s ON s.session_id = c.session_id AND s.tool = c.tool AND s.d = 1 AND s.sn = c.dn AND NOT c.orp WHERE c.d = -1""",
)
def ingest_opencode_log(spark, sf):
    k = F.col("k")
    status = F.when(k % 5 < 2, "started").otherwise("completed")
    took = F.when((k % 5 >= 2) & (k % 3 == 0), F.concat(F.lit(" duration="), k.cast("string"))).otherwise("")
    tool = F.when(k % 7 == 0, "invalid").otherwise(F.concat("kind", (k % 2).cast("string")))
    line = F.concat(
        F.lit("INFO  "), F.substring("timestamp", 1, 19), F.lit(" +1ms service=tool.registry status="), status, took, F.lit(" "), tool
    )
    out = textlogs.ingest_opencode_log(lines_of(_src(spark, sf), line))
    return out.select("session_id", "event_id", "tool_name", "duration_ms")


@query(
    "ingest_continue_log",
    EV
    + """,
em AS (SELECT *, k % 6 AS r FROM sx WHERE k % 6 < 4)
SELECT session_id, session_id || ':' || pos AS event_id,
CASE r WHEN 0 THEN 'Bash' WHEN 1 THEN kind WHEN 2 THEN 'Grep' ELSE 'Read' END AS tool_name, CASE WHEN r = 0 THEN 'o' || k END AS tool_output,
strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp FROM em""",
)
def ingest_continue_log(spark, sf):
    k = F.col("k")
    r = k % 6
    stamp = F.col("timestamp").alias("timestamp")
    line = (
        F.when(r == 0, F.to_json(F.struct(stamp, obj(name="terminal", input="ls", output=F.concat(F.lit("o"), k.cast("string"))).alias("tool"))))
        .when(r == 1, F.to_json(F.struct(stamp, obj(function=F.col("kind"), arguments="x").alias("tool_call"))))
        .when(r == 2, F.to_json(F.struct(stamp, F.lit("t").alias("function_call"), F.lit('{"name": "file search"}').alias("raw"))).alias("x"))
        .when(r == 3, F.to_json(F.struct(stamp, F.lit("Running tool: readFile now").alias("message"))))
        .when(r == 4, F.to_json(F.struct(stamp, F.lit("nothing").alias("message"))))
        .otherwise(F.lit("not json"))
    )
    line = F.when(r == 2, F.replace(line, F.lit("file search"), F.lit("file-search"))).otherwise(line)
    again = F.when(k % 4 == 0, F.concat(F.lit(" "), line))
    out = textlogs.ingest_continue_log(lines_of(_src(spark, sf), line, again))
    first = F.split_part("event_id", F.lit(":"), F.lit(2)).cast("bigint")
    return out.select(
        "session_id",
        F.concat("session_id", F.lit(":"), (first / 2).cast("bigint").cast("string")).alias("event_id"),
        "tool_name",
        "tool_output",
        "timestamp",
    )


@query(
    "ingest_copilot_log",
    EV
    + """,
em AS (SELECT *, k % 5 AS r FROM sx WHERE k % 5 < 4)
SELECT session_id, session_id || ':' || pos AS event_id,
CASE r WHEN 0 THEN 'Read' WHEN 1 THEN CASE kind WHEN 'view' THEN 'Read' ELSE kind END WHEN 2 THEN 'Bash' ELSE 'Glob' END AS tool_name,
CASE WHEN r = 0 THEN '{"path":"p' || k || '"}' END AS input, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp FROM em""",
)
def ingest_copilot_log(spark, sf):
    k = F.col("k")
    r = k % 5
    head = F.concat(F.lit("["), F.translate(F.substring("timestamp", 1, 19), "T", " "), F.lit(".123] [info] "), F.col("pos").cast("string"), F.lit(" "))
    body = (
        F.when(r == 0, F.to_json(obj(name="read_file", input=obj(path=F.concat(F.lit("p"), k.cast("string"))))))
        .when(r == 1, F.concat(F.lit("tool_call: "), F.col("kind")))
        .when(r == 2, F.lit("running command: bash"))
        .when(r == 3, F.lit('{"broken": "tool": "list_dir"'))
        .otherwise("idle")
    )
    body = F.when(r == 3, F.lit('partial "tool": "list_dir"')).otherwise(body)
    out = textlogs.ingest_copilot_log(lines_of(_src(spark, sf), F.concat(head, body)))
    read = F.when(F.col("tool_input").startswith('{"path"'), F.col("tool_input"))
    return out.select("session_id", "event_id", "tool_name", read.alias("input"), "timestamp")


@query(
    "ingest_codex_log",
    EV
    + """,
em AS (SELECT *, k % 6 AS r FROM sx WHERE k % 6 < 5)
SELECT session_id, session_id || ':' || (pos * 2) AS event_id,
CASE r WHEN 0 THEN 'Bash' WHEN 1 THEN 'Edit' WHEN 2 THEN 'Read' WHEN 3 THEN CASE kind WHEN 'view' THEN 'Read' ELSE kind END ELSE 'Grep' END AS tool_name,
CASE WHEN r = 0 THEN 'out' || k WHEN r = 3 THEN 'seen' END AS tool_output FROM em""",
)
def ingest_codex_log(spark, sf):
    k = F.col("k")
    r = k % 6
    stamp = F.col("timestamp")
    line = (
        F.when(
            r == 0,
            F.to_json(F.struct(stamp, F.lit("response_item").alias("type"), obj(type="function_call", name="shell", arguments="{}", call_id=F.col("event_id")).alias("payload"))),
        )
        .when(
            r == 1,
            F.to_json(F.struct(stamp, F.lit("response_item").alias("type"), obj(type="custom_tool_call", name="apply_patch", input="diff", call_id=F.col("event_id")).alias("payload"))),
        )
        .when(r == 2, F.to_json(F.struct(stamp, F.lit("action").alias("type"), obj(name="view", input=obj(a="b")).alias("action"))))
        .when(r == 3, F.to_json(F.struct(stamp, F.lit("observation").alias("type"), obj(name=F.col("kind"), output="seen").alias("observation"))))
        .when(r == 4, F.to_json(F.struct(stamp, F.lit("assistant").alias("role"), F.array(obj(type="grep", input="x")).alias("content"))))
        .otherwise(F.to_json(F.struct(F.lit("action").alias("type"), obj(name="no time").alias("action"))))
    )
    second = F.when(
        r == 0,
        F.to_json(obj(type="response_item", payload=obj(type="function_call_output", call_id=F.col("event_id"), output=F.concat(F.lit("out"), k.cast("string"))))),
    ).when(r == 2, line)
    return textlogs.ingest_codex_log(lines_of(_src(spark, sf), line, second)).select(
        "session_id", "event_id", "tool_name", "tool_output"
    )


@query(
    "ingest_aider_log",
    EV
    + """,
em AS (SELECT *, session_id || ':' || pos AS id, k % 5 AS r FROM sx WHERE k % 5 < 4)
SELECT session_id, id AS event_id, lag(id) OVER (PARTITION BY session_id ORDER BY pos) AS parent_event_id,
CASE r WHEN 0 THEN 'Bash' WHEN 1 THEN 'Edit' WHEN 2 THEN 'Create' ELSE 'Read' END AS tool_name, 'f' || k || '.py' AS tool_input FROM em""",
)
def ingest_aider_log(spark, sf):
    k = F.col("k")
    verb = F.get(
        F.array(*[F.lit(x) for x in ("$ ", "Applied edit to ", "created ", "Reading ", "talk about ")]), (k % 5).cast("int")
    )
    line = F.concat(F.lit("  "), verb, F.lit("f"), k.cast("string"), F.lit(".py "))
    return slim(textlogs.ingest_aider_log(lines_of(_src(spark, sf), line)), "tool_input")


HOOKS = (
    EV
    + """,
hk AS (SELECT *, k % 3 <> 0 AS pre, epoch_us(ts) // 1000 AS ms FROM sx),
bf AS (SELECT *, lag(pre) OVER w AS op, lag(pos) OVER w AS ppos, lag(ms) OVER w AS pms FROM hk WINDOW w AS (PARTITION BY session_id, kind ORDER BY pos)),
dn AS (SELECT *, CASE WHEN NOT pre AND coalesce(op, false) THEN session_id || ':' || pos END AS eid FROM bf),
ld AS (SELECT *, last_value(eid IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_done FROM dn)
SELECT d.session_id, d.eid AS event_id, p.last_done AS parent_event_id, d.kind AS tool_name, (d.ms - d.pms)::DOUBLE AS duration_ms
FROM ld d JOIN ld p ON p.session_id = d.session_id AND p.pos = d.ppos WHERE d.eid IS NOT NULL"""
)
HOOKS_WHOLE = HOOKS.replace(
    "d.kind AS tool_name,",
    """d.kind AS tool_name, 'tool_call' AS event_type, '{"command":"ls"}' AS tool_input, 'fine' AS tool_output, 'claude-code' AS agent,
strftime(make_timestamp(d.ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') AS timestamp,""",
)


def hook_records(spark, sf):
    """Before and after records in arrival order, some unmatched."""
    k = F.col("k")
    return _src(spark, sf).select(
        "session_id",
        F.col("pos").alias("line_no"),
        F.unix_millis("ts").alias("arrived_ms"),
        F.when(k % 3 != 0, "PreToolUse").otherwise("PostToolUse").alias("hook_event_name"),
        F.col("kind").alias("tool_name"),
        F.lit('{"command": "ls", "other": 1}').alias("tool_input"),
        F.lit('{"output": "fine"}').alias("tool_result"),
    )


@query("pair_hooks", HOOKS)
def pair_hooks(spark, sf):
    return slim(hooks.pair_hooks(hook_records(spark, sf)), "duration_ms")


@query(
    "chat_events",
    """WITH ch AS (SELECT CAST(conv_id AS VARCHAR) AS s, turn, role, text FROM conversations),
g AS (SELECT *, lag(s || ':' || turn) OVER (PARTITION BY s ORDER BY turn) AS prev FROM ch)
SELECT s AS session_id, s || ':' || turn AS event_id, CASE WHEN role <> 'user' THEN prev END AS parent_event_id,
CASE role WHEN 'user' THEN 'Prompt' WHEN 'assistant' THEN 'Response' ELSE 'context' END AS tool_name FROM g""",
)
def chat_events(spark, sf):
    """Chat turns in a serial chain that starts anew at each user turn."""
    from skein.plans.views import chat_trace

    chat = chat_trace(spark, sf)
    rows = chat.select(
        "session_id",
        F.col("turn").alias("line_no"),
        F.lit(0).alias("part"),
        F.concat("session_id", F.lit(":"), F.col("turn").cast("string")).alias("event_id"),
        "role",
        F.when(F.col("role") == "user", "Prompt").when(F.col("role") == "assistant", "Response").otherwise("context").alias("tool_name"),
    )
    out = raw.serial_chain(rows)
    return out.withColumn(
        "parent_event_id", F.when(F.col("role") != "user", F.col("parent_event_id"))
    ).select("session_id", "event_id", "parent_event_id", "tool_name")


@query(
    "normalize_tool",
    """SELECT CASE event_type WHEN 'view' THEN 'Read' ELSE event_type END AS tool_name, count(*) AS n FROM events GROUP BY 1""",
)
def normalize_tool(spark, sf):
    named = trace_native(spark, sf).select("tool_name")
    return attribution.normalize_tool(named, "copilot").groupBy("tool_name").agg(F.count("*").alias("n"))


MODELS = ("claude-3", "DeepSeek-v2", "doubao-pro", "o3-mini", "my-gpt-4", "qwen2", "none")


@query(
    "infer_provider",
    f"""WITH m AS (SELECT ({list(MODELS)!r})[user_id % 7 + 1] AS model FROM events)
SELECT model, count(*) AS n, CASE model WHEN 'claude-3' THEN 'anthropic' WHEN 'DeepSeek-v2' THEN 'deepseek' WHEN 'doubao-pro' THEN 'bytedance' WHEN 'o3-mini' THEN 'openai' ELSE '' END AS by_prefix,
CASE model WHEN 'claude-3' THEN 'anthropic' WHEN 'DeepSeek-v2' THEN 'deepseek' WHEN 'doubao-pro' THEN 'bytedance' WHEN 'o3-mini' THEN 'openai' WHEN 'my-gpt-4' THEN 'openai' WHEN 'qwen2' THEN 'alibaba' ELSE '' END AS by_part,
CASE model WHEN 'claude-3' THEN 'anthropic' WHEN 'DeepSeek-v2' THEN 'deepseek' WHEN 'doubao-pro' THEN 'bytedance' WHEN 'o3-mini' THEN 'openai' WHEN 'my-gpt-4' THEN 'openai' WHEN 'qwen2' THEN 'alibaba' ELSE 'router' END AS by_route
FROM m GROUP BY 1""",
)
def infer_provider(spark, sf):
    model = F.get(F.array(*[F.lit(m) for m in MODELS]), (F.col("user_id") % 7).cast("int"))
    m = F.col("model")
    return (
        table(spark, sf, "events")
        .groupBy(model.alias("model"))
        .agg(F.count("*").alias("n"))
        .select(
            "model",
            "n",
            attribution.infer_provider(m, "prefix").alias("by_prefix"),
            attribution.infer_provider(m, "substring").alias("by_part"),
            attribution.infer_provider(m, "route", F.lit("router")).alias("by_route"),
        )
    )


@query(
    "backfill_attribution",
    ATTR
    + """,
f AS (SELECT session_id, arg_min(coalesce(agent, ''), pos) AS a, arg_min(coalesce(provider, ''), pos) AS p,
   arg_min(agent, pos) FILTER (agent IS NOT NULL) AS named FROM atr GROUP BY 1),
g AS (SELECT session_id, CASE WHEN a <> '' THEN a ELSE coalesce(named, 'claude-code') END AS fa,
   CASE WHEN p <> '' THEN p WHEN a = '' THEN 'deepseek' ELSE '' END AS fp FROM f)
SELECT session_id, count(*) AS events, count(*) FILTER (agent IS NULL OR (provider IS NULL AND fp <> '')) AS fixed FROM atr JOIN g USING (session_id) GROUP BY 1""",
)
def backfill_attribution(spark, sf):
    return attribution.backfill_report(attribution.backfill(attributed(spark, sf)))


@query(
    "read_events",
    f"""WITH {NATIVE} SELECT session_id, event_id, tool_name, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, duration_ms,
concat_ws(',', p1, p2) AS parents FROM (SELECT n.*, a.event_id AS p1, b.event_id AS p2 FROM tn n
LEFT JOIN tn a ON a.session_id = n.session_id AND a.pos = n.pp1 LEFT JOIN tn b ON b.session_id = n.session_id AND b.pos = n.pp2)""",
)
def read_events(spark, sf):
    """Events written as JSON lines and read back."""
    path = fresh_path(spark, "events")
    raw.write_events(trace_native(spark, sf), path)
    back = raw.read_events(spark, path)
    return back.select(
        "session_id", "event_id", "tool_name", "timestamp", "duration_ms", F.coalesce("parent_event_id", F.lit("")).alias("parents")
    )


@query(
    "ingested_depths",
    EV
    + """,
em AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS n FROM sx WHERE k % 5 < 4)
SELECT session_id, max(n) - 1 AS max_depth, count(*) AS events FROM em GROUP BY 1""",
)
def ingested_depths(spark, sf):
    """A serial log from raw lines to depth: the chain is as deep as it is long."""
    k = F.col("k")
    verb = F.when(k % 5 < 4, "$ ").otherwise("talk ")
    lines = lines_of(_src(spark, sf), F.concat(verb, k.cast("string")))
    stamped = textlogs.ingest_aider_log(lines).withColumn("timestamp", F.lit("2024-01-01T00:00:00"))
    ev = cut(prepare(stamped))
    return S.node_depths(ev).groupBy("session_id").agg(
        F.max("depth").alias("max_depth"), F.count("*").alias("events")
    )

