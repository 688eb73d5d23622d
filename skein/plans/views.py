"""Trace-shaped views over the test tables. Each has a twin in ``oracle.py``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.ordering import neighbours, with_position
from skein.schema import TASK_TYPES

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their position in the session and the number ``k`` of their properties."""
    ev = table(spark, sf_dir, "events")
    return with_position(
        ev.select(
            F.col("user_id").cast("string").alias("session_id"),
            F.col("event_id").cast("string").alias("event_id"),
            F.col("event_id").alias("ingest_seq"),
            F.date_format("ts", ISO).alias("timestamp"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.col("value").alias("duration_ms"),
            "event_type",
            F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
            "props",
        )
    )


def _shape(df: DataFrame, tool, parents) -> DataFrame:
    return df.select(
        "session_id",
        "event_id",
        F.array_join(parents, ",").alias("parent_event_id"),
        F.lit("tool_call").alias("event_type"),
        F.lit(None).cast("string").alias("caused_by"),
        tool.alias("tool_name"),
        F.col("props").alias("tool_input"),
        F.lit(None).cast("string").alias("tool_output"),
        "timestamp",
        "duration_ms",
        F.lit(None).cast("string").alias("model"),
        F.lit(None).cast("string").alias("provider"),
        F.lit(None).cast("string").alias("agent"),
        "ingest_seq",
        "pos",
        "ts",
        parents.alias("parents"),
    ).withColumn("parent_event_id", F.nullif("parent_event_id", F.lit("")))


def trace_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlinked events with agent-like tool names."""
    kind = F.col("event_type")
    tool = (
        F.when(kind == "signup", "question")
        .when(kind == "view", "read")
        .when(kind == "click", "grep")
        .when(kind == "purchase", "edit")
        .when(kind == "error", "bash")
        .otherwise(kind)
    )
    return _shape(numbered(spark, sf_dir), tool, F.expr("cast(array() as array<string>)"))


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = {f"b{n}": ("event_id", n) for n in range(1, 6)}
    df = neighbours(numbered(spark, sf_dir), back)
    one = F.least(1 + F.col("k") % 3, F.col("pos") - 1)
    two = 2 + F.col("k") % 4
    backs = F.array(*[F.col(f"b{n}") for n in range(1, 6)])
    df = df.withColumn(
        "p1", F.when((F.col("pos") > 1) & (F.col("k") % 9 != 0), F.get(backs, one.cast("int") - 1))
    )
    return df.withColumn(
        "p2",
        F.when(
            F.col("p1").isNotNull() & (F.col("k") % 5 == 0) & (F.col("pos") - two >= 1),
            F.get(backs, two.cast("int") - 1),
        ),
    ).withColumn("p2", F.when(F.col("p2") != F.col("p1"), F.col("p2")))


def trace_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a recorded backward-pointing causal graph."""
    parents = F.array_compact(F.array("p1", "p2"))
    return _shape(_linked(spark, sf_dir), F.col("event_type"), parents)


def trace_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``trace_native`` with broken, external and cyclic references."""
    df = _linked(spark, sf_dir)
    # Seen from the end, the next event is the one before.
    df = neighbours(df.withColumn("_from_end", -F.col("pos")), {"nxt": ("event_id", 1)}, pos="_from_end")
    k = F.col("k")
    parents = (
        F.when(k == 7, F.array(F.concat(F.lit("ext_"), k.cast("string"))))
        .when(k == 8, F.array(F.concat(F.lit("root_"), k.cast("string"))))
        .when(k == 13, F.array(F.coalesce("nxt", F.lit("ext_13"))))
        .otherwise(F.array_compact(F.array("p1", "p2")))
    )
    return _shape(df, F.col("event_type"), parents)


def session_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session metadata from the customers that own events."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey")).distinct()
    key = F.col("c_custkey")
    types = F.array(*[F.lit(t) for t in TASK_TYPES])
    return (
        table(spark, sf_dir, "customer")
        .join(users, "c_custkey", "left_semi")
        .select(
            key.cast("string").alias("session_id"),
            F.when(key % 5 != 0, F.lit("native")).alias("data_origin"),
            F.col("c_mktsegment").alias("runtime"),
            F.get(types, (F.col("c_nationkey") % 10).cast("int")).alias("task_type"),
            F.when(key % 7 == 0, "routed_prompt_intervention").otherwise("real_work").alias("task_source"),
            F.when(key % 11 != 0, F.col("c_acctbal") >= 0).alias("success"),
            (key % 13 == 0).alias("human_intervention"),
        )
    )


def chat_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw chat turns in event order."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"),
        F.col("turn"),
        "role",
        "text",
    )
