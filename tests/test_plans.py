"""Plans given as JSON: keys at any depth, signatures."""

import json

from skein.operators import subsets as X


def table(spark, **plans):
    return spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in plans.items()], "plan_id string, plan string")


def test_prohibited_keys_at_any_depth(spark):
    plans = table(
        spark,
        a={"x": [{"y": {"shell": {"cmd": 1}}}, {"shell": 2}], "text": '{"command": 1}', "bash": None},
        b='{"\\u0063md": 1, "deep": [[{"execute": []}]], "api_call": {}}',
        c={},
        d="no json",
        e={"shell_": 1, "run": ["shell"]},
    )
    got = {}
    for r in X.lint_plans(plans).filter("issue LIKE 'prohibited%'").collect():
        got.setdefault(r.plan_id, set()).add(r.issue.rpartition(" ")[2])
    assert got == {
        "a": {"$.x[0].y.shell", "$.x[0].y.shell.cmd", "$.x[1].shell", "$.bash"},
        "b": {"$.cmd", "$.deep[0][0].execute", "$.api_call"},
    }
    assert X.lint_plans(plans).filter("plan_id = 'd'").count() == 5


def test_signatures(spark):
    base = {"goal": {"n": 1, "tags": ["a", "b"]}, "steps": [{"id": 1}, {}], "none": None}
    plans = table(
        spark,
        same={"steps": base["steps"], "none": None, "goal": {"tags": ["a", "b"], "n": 1}},
        base=base,
        stamped=base | {"validation": {"ok": {"deep": [1, {"x": 2}]}}, "generated_at": "now", "goal": base["goal"] | {"queue_hash": "q,}"}},
        order=base | {"goal": {"n": 1, "tags": ["b", "a"]}},
        longer=base | {"steps": [{"id": 1}, {}, {}]},
        dotted={"goal.n": 1},
        nested={"goal": {"n": 1}},
        text={"goal": {"n": "1"}},
        nothing={},
        broken="no json",
    )
    got = {r.plan_id: r.signature for r in X.plan_signatures(plans).collect()}
    assert got["same"] == got["base"] == got["stamped"]
    assert len({got[k] for k in ("base", "order", "longer", "dotted", "nested", "text", "nothing")}) == 7
