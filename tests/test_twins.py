"""Queries and their SQL on small tables that are made to tell two rules apart."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as given

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
DAY = datetime.datetime(2024, 1, 1)


@pytest.fixture
def both(spark, tmp_path):
    """Sorted rows of a query, after its SQL was found to give the same."""

    def run(name, **tables):
        con = duckdb.connect()
        for table, df in tables.items():
            df.coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        out = given.queries()[name](spark, str(tmp_path))
        got = sorted(tuple(r) for r in out.collect())
        names = ", ".join(f'"{c}"' for c in out.columns)
        assert got == sorted(con.execute(f"SELECT {names} FROM ({given.oracle_sql()[name]})").fetchall())
        return got

    return run


def events(spark, *rows):
    """Event table from (user, k, value) or (user, k, value, microseconds) in order."""
    full = [(i, DAY + datetime.timedelta(microseconds=r[3] if len(r) > 3 else i * 1000), r[0], "view", r[2], f'{{"k": {r[1]}}}') for i, r in enumerate(rows)]
    return spark.createDataFrame(full, EVENTS)


def test_cycles_of_several_forward_links(spark, both):
    """Events 1 to 3 refer to the next, the fourth to 1 and 2: the rings 1-2-3-4 and 2-3-4 fall one by one."""
    ring = [(1, k, 1.0) for k in (13, 13, 13, 20)]
    assert both("broken_cycles", events=events(spark, *ring)) == [("1", 2)]


def test_compared_measures_round_half_up(spark, both):
    """Two branches of 1522314.32805 s: the fifth decimal is a tie that binary fractions miss."""
    long = 1_522_314_328_050
    rows = [(u, k, 1.0, u + t) for u in (1, 2) for k, t in ((9, 0), (1, long))]
    got = {r[2]: r[3] for r in both("compare_sessions", events=events(spark, *rows))}
    assert got["max_lifespan"] == "1522314.3281"


def test_constant_measures_do_not_shift(spark, both):
    """Three windows of one branch density: its spread is zero, not what is left of a difference of squares."""
    ks = [91, 89, 72, 95, 2, 2, 44, 67, 12, 55, 27, 36, 77, 11, 40, 70, 12, 64, 54, 63, 94, 3, 14, 69, 63, 79, 81, 62, 2, 88, 27, 47, 76, 41, 87, 52, 97, 32, 44, 11]
    got = both("topology_shift", events=events(spark, *[(1, k, 1.0) for k in ks]))
    assert all(abs(r[-1]) < 1e6 for r in got)


def test_slow_calls_do_not_depend_on_order(spark, both):
    """Three times the average exactly is not slow, whatever the order of the sum."""
    rows = [(1, 1, 5.14)] * 3 + [(1, 1, 46.26)]  # the last is three times the average exactly
    tie = [(2, 1, v) for v in (0.01,) * 62 + (320.01, 320.02)]  # 640.65 / 64 = 10.01015625: a tie in the last decimals
    got = both("slow_calls", events=events(spark, *rows, *tie))
    assert got == [("2", "66", "view", 320.01, 10.010156), ("2", "67", "view", 320.02, 10.010156)]


def test_phrases_that_end_with_the_text(spark, both):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["of the", "the", "", "the license", None, "a", "by the", "at the"])], "doc_id bigint, text string")
    got = both("redact_text", documents=docs.filter("text IS NOT NULL"))
    assert got[0] == (0, "of THE PM-A-001")
