import csv
import glob
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from skein.operators import corpus as K
from skein.operators.manifests import differing_parts, field_leaves, tree_roots
from skein.operators.metadata import complete
from skein.operators.patterns import corpus_transitions, transitions, write_transitions_csv


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def root(leaves, fan):
    nodes = list(leaves)
    while len(nodes) > 1:
        groups = [nodes[i : i + fan] for i in range(0, len(nodes), fan)]
        nodes = [g[0] if len(g) == 1 else sha("".join(g)) for g in groups]
    return sha(f"{len(leaves)}:{nodes[0]}")


@pytest.mark.parametrize("fan", [2, 3, 16])
def test_roots_at_every_size(spark, fan):
    sizes = [1, 2, 3, 4, 9, 10, 16, 17, 33, 82]
    rows = [(str(n), "events", i + 1, sha(f"{n}/{i}")) for n in sizes for i in range(n)]
    leaves = spark.createDataFrame(rows, "session_id string, part string, pos bigint, leaf string")
    found = {r.session_id: (r.rows, r.digest) for r in tree_roots(leaves.repartition(5), fan=fan).collect()}
    assert found == {str(n): (n, root([sha(f"{n}/{i}") for i in range(n)], fan)) for n in sizes}
    # A root does not depend on the other sessions.
    alone = tree_roots(leaves.filter("session_id = '3'"), fan=fan).first()
    assert (alone.rows, alone.digest) == found["3"]
    assert tree_roots(leaves.limit(0), fan=fan).count() == 0
    with pytest.raises(ValueError):
        tree_roots(leaves, fan=1)


def test_null_fields_differ_from_texts(spark):
    rows = [("a", None, None), ("b", "", None), ("c", "-", ["x"]), ("d", "null", [])]
    table = spark.createDataFrame(rows, "session_id string, label string, tags array<string>")
    digests = [r.digest for r in tree_roots(field_leaves(table, "metadata", ["label", "tags"])).collect()]
    assert len(set(digests)) == 4
    swapped = tree_roots(field_leaves(table.select("tags", "session_id", "label"), "metadata", ["tags", "label"]))
    assert differing_parts(tree_roots(field_leaves(table, "metadata", ["label", "tags"])), swapped).count() == 0


@pytest.fixture
def stored(spark, make, tmp_path):
    events = make({s: [(f"{s}{i}", "read" if i % 2 else "edit", f"{s}{i - 1}" if i else "") for i in range(n)] for s, n in (("a", 1), ("b", 20), ("c", 3), ("d", 2))})
    notes = spark.createDataFrame([("a", "X"), ("b", "Y"), ("c", None)], "session_id string, runtime string")
    none = spark.createDataFrame([], "session_id string, task_type string, source string, success boolean, repo_language string")
    K.snapshot(events, K.session_records(events, complete(notes), none), str(tmp_path / "whole"))
    return tmp_path


def altered(spark, home, **edits):
    for part in ("events", "records", "parts", "manifest"):
        table = spark.read.parquet(str(home / "whole" / part))
        edits.get(part, lambda t: t)(table).write.parquet(str(home / "altered" / part))
    return {(r.subject, r.issue) for r in K.verify_snapshot(spark, str(home / "altered")).collect()}


def test_an_intact_snapshot_has_no_issue(spark, stored):
    assert altered(spark, stored) == set()


def test_records_are_made_from_the_written_events(spark, make, tmp_path):
    events = make({"a": [("1", "read", ""), ("2", "edit", "1")]})
    none = spark.createDataFrame([], "session_id string, task_type string, source string, success boolean, repo_language string")
    notes, read = complete(spark.createDataFrame([("a", "X")], "session_id string, runtime string")), []

    def records(written):
        read.extend(written.inputFiles())
        return K.session_records(written, notes, none)

    made = K.snapshot(events, records, str(tmp_path / "whole")).first()
    assert read and all(f"{tmp_path}/whole/events/" in f for f in read)
    assert made == K.snapshot(events, K.session_records(events, notes, none), str(tmp_path / "other")).first()
    assert altered(spark, tmp_path) == set()


def test_issues_name_session_and_part(spark, stored):
    one = F.col("session_id") == "b"
    issues = altered(
        spark,
        stored,
        events=lambda t: t.filter("session_id <> 'd'").withColumn("pos", F.when(one & F.col("pos").isin(17, 18), 35 - F.col("pos")).otherwise(F.col("pos"))),
        records=lambda t: t.withColumn("runtime", F.when(F.col("session_id") == "c", "Z").otherwise(F.col("runtime"))).withColumn(
            "event_count", F.when(F.col("session_id") == "a", 9).otherwise(F.col("event_count"))
        ),
    )
    assert issues == {("b", "session hash mismatch"), ("d", "missing session events"), ("c", "metadata mismatch"), ("a", "structure mismatch")}


def test_a_lost_record_and_a_changed_manifest_are_found(spark, stored):
    issues = altered(
        spark,
        stored,
        records=lambda t: t.filter("session_id <> 'a'"),
        parts=lambda t: t.filter("NOT (session_id = 'b' AND part = 'events')"),
    )
    assert issues == {("a", "structure removed"), ("a", "metadata removed"), ("b", "events without a record"), ("*", "manifest hash mismatch")}


def test_records_come_back_from_json_lines(spark, stored, tmp_path):
    records = spark.read.parquet(str(stored / "whole" / "records"))
    K.export_dataset(records, str(tmp_path / "out"))
    lines = [json.loads(x) for f in glob.glob(str(tmp_path / "out" / "*.json")) for x in open(f)]
    assert {x["session_id"]: (x["event_count"], x["session_hash"]) for x in lines} == {
        r.session_id: (r.event_count, r.session_hash) for r in records.collect()
    }


def test_transitions_come_back_from_csv(make, tmp_path):
    events = make({"s": [("1", 'say "hi", all', ""), ("2", "b\nc", "1"), ("3", 'say "hi", all', "2"), ("4", "b\nc", "3")]})
    for name, table in (("one", transitions(events)), ("all", corpus_transitions(events))):
        write_transitions_csv(table, str(tmp_path / name))
        rows = [r for f in glob.glob(str(tmp_path / name / "*.csv")) for r in csv.DictReader(open(f, newline=""))]
        assert sorted((r["from_tool"], r["to_tool"], int(r["count"])) for r in rows) == sorted(
            (r.from_tool, r.to_tool, r["count"]) for r in table.collect()
        )
        assert ('say "hi", all', "b\nc", 2) in {(r["from_tool"], r["to_tool"], int(r["count"])) for r in rows}
