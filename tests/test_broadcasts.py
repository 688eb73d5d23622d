"""Tables with a row per event never travel through the driver."""

from skein.operators import structure as S
from skein.sources import dsh


def test_critical_path_merges_its_tables(make):
    events = make({"s": [("a", "Read", None), ("b", "Edit", "a"), ("c", "Bash", "a"), ("d", "Read", "c")], "t": [("x", "Read", None)]})
    path = S.critical_path(events)
    got = sorted(tuple(r) for r in path.select("session_id", "step", "event_id").collect())
    assert got == [("s", 0, "a"), ("s", 1, "c"), ("s", 2, "d"), ("t", 0, "x")]
    assert "Broadcast" not in path._jdf.queryExecution().executedPlan().toString()


def test_session_lineage_merges_its_tables(spark):
    forest = spark.createDataFrame([("a", None, "1"), ("b", "a", "2"), ("c", "b", "3")], "session_id string, parent string, created string")
    found = dsh.session_lineage(forest, forest.filter("session_id = 'b'"))
    assert sorted(tuple(r) for r in found.collect()) == [("b", "a", -1), ("b", "b", 0), ("b", "c", 1)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
