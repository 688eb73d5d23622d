import json
import random

from skein.operators import graph, lineage
from skein.sources.dsh import _records, ingest_dsh, session_lineage


def told(spark, *records):
    rows = [("s", i, json.dumps({"type": kind, "time": 1_700_000_000_000 + i, "data": data})) for i, (kind, data) in enumerate(records, 1)]
    return ingest_dsh(spark.createDataFrame(rows, "session_id string, line_no bigint, value string")).orderBy("ingest_seq").collect()


def message(mid, text, kind="user", **source):
    return "user/message", {"id": mid, "source": {"kind": kind, **source}, "content": [{"type": "text", "text": text}]}


def splice(target, *inserted):
    return "agent/inbox/spliced", {"target": target, "inserted": [{"id": i, "source": {"kind": k, **rest}} for i, k, rest in inserted]}


def test_insertions_into_a_running_step_are_marked(spark):
    events = told(
        spark,
        message("m1", "start"),
        ("assistant/message", {"turn": 1, "step": 1, "message": {"content": [{"type": "reasoning", "text": "plan"}]}}),
        splice("next-step", ("m2", "user", {}), ("", "user", {"rpcId": "r4"}), ("m6", "plugin", {})),
        message("m2", "use the other one"),
        splice("next-turn", ("m3", "user", {})),
        message("m3", "something new"),
        message("m4", "told by its call", rpcId="r4"),
        message("m5", "told too late"),
        splice("next-step", ("m5", "user", {})),
        message("m6", "of a plugin as user"),
        message("m2", "from a plugin", kind="plugin"),
        message("m2", "  "),
    )
    prompts = {json.loads(e.tool_input)["text"]: json.loads(e.tool_input).get("mid_turn") for e in events if e.tool_name == "Prompt"}
    assert prompts == {
        "start": None,
        "use the other one": True,
        "something new": None,
        "told by its call": True,
        "told too late": None,
        "of a plugin as user": None,
    }
    assert [e.tool_name for e in events].count("Thinking") == 1


def test_a_plugin_message_causes_nothing_and_an_insertion_is_a_new_root(spark):
    def call(step, name):
        return "tool/call", {"turn": 1, "step": step, "callId": name, "name": name, "arguments": "{}"}

    events = told(
        spark,
        message("m1", "start"),
        message("p", "context", kind="plugin"),
        call(1, "first"),
        splice("next-step", ("m2", "user", {})),
        message("m2", "wait"),
        call(2, "second"),
    )
    ids = {json.loads(e.tool_input).get("text"): e.event_id for e in events if e.tool_name == "Prompt"}
    parents = {e.tool_name: e.parent_event_id for e in events if e.tool_name in ("first", "second")}
    assert parents == {"first": ids["start"], "second": ids["wait"]}


def test_lines_are_parsed_once(spark):
    """What is carried along a session comes from written records, without their content."""
    kinds = ("request/header", {"header": {"config": {"model": "m", "provider": "p"}}}), message("m1", "go"), ("tool/call", {"turn": 1, "step": 1, "name": "x"})
    rows = [("s", i, json.dumps({"type": kind, "time": i, "data": data})) for i, (kind, data) in enumerate(kinds)] + [("s", 3, "no json"), (None, 0, "{}")]
    found = _records(spark.createDataFrame(rows, "session_id string, line_no bigint, value string"))
    assert "parseJson" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.line_no, r.t, r.seg, r.model, r.route, r.root_id, r.visit) for r in found.collect())
    assert got == [(0, "request/header", 0, "m", "p", None, 0), (1, "user/message", 1, "m", "p", "s:1", 0), (2, "tool/call", 1, "m", "p", "s:1", 1)]


def relatives(parents, asked):
    """Lineage by walking parents from every session until one is met again."""
    found = set()
    for start in parents:
        at, level, seen = start, 0, set()
        while at in parents and at not in seen:
            seen.add(at)
            found |= {(start, at, -level)} if start in asked else set()
            found |= {(at, start, level)} if at in asked else set()
            at, level = parents[at], level + 1
    return sorted(found)


def lineage_of(spark, parents, asked):
    forest = spark.createDataFrame([(s, p, f"{i:04}") for i, (s, p) in enumerate(parents.items())], "session_id string, parent string, created string")
    return session_lineage(forest, forest.filter(forest.session_id.isin(*asked)))


def test_lineage_takes_few_rounds_and_meets_pairs_once(spark, monkeypatch):
    """A chain of 32 sessions in blocks of 2: rounds grow with the logarithm of its depth, and no pair is shuffled again."""
    written = []
    fresh_path = lineage.fresh_path
    monkeypatch.setattr(lineage, "fresh_path", lambda *args: written.append(fresh_path(*args)) or written[-1])
    monkeypatch.setattr(graph, "BLOCK_ROWS", 2)
    chain = {f"s{i}": f"s{i - 1}" if i else None for i in range(32)}
    found = lineage_of(spark, chain, list(chain))
    assert sorted(tuple(r) for r in found.collect()) == relatives(chain, chain)
    assert len(written) < 24
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_lineage_of_some_sessions_in_trees_and_on_rings(spark):
    draw = random.Random(4)
    trees = {f"t{i}": draw.choice([None, "gone", *(f"t{j}" for j in range(i))]) for i in range(40)}
    rings = {f"r{i}": f"r{draw.randrange(20)}" for i in range(20)} | {"own": "own", "under": "own", "alone": None}
    both = trees | rings
    for parents, asked in ((trees, list(trees)[::3]), (both, list(both)), (both, ["alone", "t5", "r1", "own", "nobody"])):
        got = lineage_of(spark, parents, asked).collect()
        assert sorted(tuple(r) for r in got) == relatives(parents, asked)
