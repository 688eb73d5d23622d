"""Files of an event store grow with its rows, not with its sessions."""

from pyspark.sql import functions as F

from skein.schema import conform_events
from skein.sources.raw import read_events, write_events


def test_small_sessions_share_a_folder(spark, tmp_path):
    rows = spark.range(6000).select(
        F.concat(F.lit("s"), (F.col("id") % 3000).cast("string")).alias("session_id"),
        F.concat(F.lit("e"), F.col("id").cast("string")).alias("event_id"),
        F.lit("2026-01-01T00:00:00").alias("timestamp"),
        F.floor(F.col("id") / 3000).alias("ingest_seq"),
    )
    store = tmp_path / "store"
    write_events(conform_events(rows), str(store))
    assert len(list(store.glob("commit=*/session=*"))) == 1
    back = read_events(spark, str(store))
    assert back.select("session_id", "event_id").exceptAll(rows.select("session_id", "event_id")).isEmpty()
    assert back.count() == 6000
    assert back.filter("ingest_seq % 2 <> floor(cast(substring(event_id, 2) AS bigint) / 3000)").isEmpty()


def test_lines_without_an_order_follow_their_file(spark, tmp_path):
    rows = [("s", f"e{i}", f"2026-01-01T00:00:{i:02d}") for i in range(10)]
    write_events(conform_events(spark.createDataFrame(rows, "session_id string, event_id string, timestamp string").coalesce(1)), str(tmp_path / "store"))
    back = read_events(spark, str(tmp_path / "store"))
    assert back.filter("ingest_seq IS NULL").isEmpty()
    assert [r.event_id for r in back.orderBy("timestamp", "ingest_seq").collect()] == [f"e{i}" for i in range(10)]
