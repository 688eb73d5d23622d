"""Shared pieces of the ingest jobs.

A raw log is a table with ``session_id``, ``line_no`` (from 0, in file order) and
``value`` (the line). Ids of new events are ``session:line`` or ``session:line.part``,
so a repeated ingest gives the same ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.operators.lineage import cut
from skein.operators.ordering import neighbours, with_position
from skein.schema import EVENT_FIELDS, EVENT_SCHEMA, conform_events

LINE_DIGITS = 20
SLICE_DIGITS = 15  # slices of 100,000 lines


def read_lines(spark: SparkSession, path: str | list[str], only: Column | None = None) -> DataFrame:
    """Lines of text logs with their ``file``; its name without suffix is the session.

    Where ``only`` is given, the other lines are left out and not counted.
    """
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)
    found = spark.read.option("recursiveFileLookup", "true").text(path)
    lines = (found if only is None else found.filter(only)).select(
        name.alias("session_id"),
        F.col("_metadata.file_path").alias("file"),
        "value",
        F.lpad(F.col("_metadata.file_block_start").cast("string"), LINE_DIGITS, "0").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    # Row ids grow inside a block of a file; the block's offset orders the blocks.
    numbered = with_position(lines, ["session_id"], "_block", "_row", "line_no", LINE_DIGITS)
    return numbered.select("session_id", (F.col("line_no") - 1).alias("line_no"), "value", "file")


def parsed(raw: DataFrame) -> DataFrame:
    """Lines that hold a JSON value, as the variant ``v``."""
    return (
        raw.filter(F.trim("value") != "")
        .withColumn("v", F.try_parse_json("value"))
        .filter(F.col("v").isNotNull())
    )


def get(v: Column | str, path: str, dtype: str = "string") -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, dtype)


def first_of(*cols: Column) -> Column:
    """First value that is neither null nor blank."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def blank(col: Column) -> Column:
    return F.coalesce(F.trim(col), F.lit("")) == ""


def event_id(*parts: Column) -> Column:
    line = F.col("line_no").cast("string")
    return F.concat(F.col("session_id"), F.lit(":"), F.concat_ws(".", line, *parts))


def json_object(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def arguments(text: Column) -> Column:
    """Call arguments as JSON: the text itself when it parses, else wrapped as ``raw``."""
    return F.when(text.isNull(), F.lit("{}")).when(
        F.try_parse_json(text).isNotNull(), text
    ).otherwise(json_object(raw=text))


def placed(events: DataFrame) -> DataFrame:
    """Add ``pos`` by (line_no, part) within the session."""
    # Written once, as sessions are counted before they are ranked.
    ordered = cut(events.withColumn("_line", F.lpad(F.col("line_no").cast("string"), LINE_DIGITS, "0")))
    return with_position(ordered, ["session_id"], "_line", "part", "pos", SLICE_DIGITS).drop("_line")


def serial_chain(events: DataFrame) -> DataFrame:
    """Every event's parent is the event before it in the session."""
    return (
        neighbours(placed(events), {"_prev": ("event_id", 1)})
        .withColumn("parent_event_id", F.col("_prev"))
        .drop("_prev")
    )


def finish(events: DataFrame) -> DataFrame:
    """Event fields in model order; ``pos`` becomes the ingest order."""
    keep = [c for c in EVENT_FIELDS if c in events.columns]
    return conform_events(events.select(*keep, F.col("pos").alias("ingest_seq")))


def block_chain(col: str, order: str) -> Column:
    """Previous value within one line's blocks (a single message)."""
    return F.lag(col).over(Window.partitionBy("session_id", "line_no").orderBy(order))


#: Room for the rows of one commit in the order of a store: order = commit * 2^40 + place.
COMMIT_BITS = 40
#: Rows of a commit from which on a session has a folder of its own in it.
FOLDER_ROWS = 1 << 10


def _folder(spark: SparkSession, path: str):
    """Hadoop's file system and path of a folder, wherever it lies."""
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), found


def commits(spark: SparkSession, path: str) -> dict[str, tuple[int, bool]]:
    """Commits of a store by writer: number, and whether its files are complete."""
    fs, folder = _folder(spark, path)
    found = {}
    if fs.exists(folder):
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            if name.startswith("commit="):
                number, _, writer = name.removeprefix("commit=").partition(".")
                done = fs.exists(status.getPath().suffix("/_SUCCESS"))
                found[writer] = (int(number), done)
    return found


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Stored event lines; absent fields are null, the session defaults to the file name.

    ``path`` is a store that :func:`write_events` made, or event files of other writers. The
    order is (commit, stored order) in a store; lines without an order follow their file.
    Commits without their success mark are left out.
    """
    own = commits(spark, path) if not any(c in path for c in "*?[{") else {}
    done = [f"{path.rstrip('/')}/commit={n:012d}.{writer}" for writer, (n, whole) in sorted(own.items()) if whole]
    if own and not done:
        return conform_events(spark.createDataFrame([], EVENT_SCHEMA).withColumn("ingest_seq", F.lit(0).cast("bigint")))
    lines = _ordered_lines(spark, done) if done else read_lines(spark, path)
    fields = F.from_json("value", EVENT_SCHEMA, {"mode": "PERMISSIVE"})
    seq = F.coalesce(F.get_json_object("value", "$.ingest_seq").cast("bigint"), "line_no")
    number = F.coalesce(F.try_to_number(F.regexp_extract("file", r"/commit=([0-9]{12})\.[^/]*/", 1), F.lit("9" * 12)).cast("bigint"), F.lit(0))
    rows = lines.filter(F.trim("value") != "").select(
        F.col("session_id").alias("_file"),
        (F.shiftleft(number, COMMIT_BITS) + seq).alias("line_no"),
        fields.alias("e"),
    )
    return conform_events(
        rows.filter("e.event_id IS NOT NULL").select(
            F.coalesce("e.session_id", "_file").alias("session_id"),
            *[f"e.{f}" for f in EVENT_FIELDS if f != "session_id"],
            F.col("line_no").alias("ingest_seq"),
        )
    )


def _ordered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of a store; only those that carry no order of their own are numbered by their file."""
    own = spark.read.option("recursiveFileLookup", "true").text(paths).select(
        F.lit(None).cast("string").alias("session_id"),
        F.get_json_object("value", "$.ingest_seq").cast("bigint").alias("line_no"),
        "value",
        F.col("_metadata.file_path").alias("file"),
    )
    return own.filter("line_no IS NOT NULL").unionByName(
        read_lines(spark, paths, F.get_json_object("value", "$.ingest_seq").cast("bigint").isNull())
    )


def write_events(events: DataFrame, path: str, writer: str | None = None) -> int:
    """Append events to a store as one commit; JSON lines leave out nulls.

    Sessions of at least ``FOLDER_ROWS`` events in a commit have a folder each, all smaller
    ones share one, so files and folders grow with the rows and not with the sessions.

    Commits are numbered as they come, so what is appended later is later in order, also
    where timestamps are tied. A commit counts once its success mark is written. ``writer``
    names a commit that may be repeated: written again, it keeps its number and replaces what
    is there. One writer appends at a time; two that begin together may take one number, and
    then share its place in order.

    Rows are spread by ranges of (session, order), so a session with very many events is not
    written by one task. The order itself is stored as ``ingest_seq`` (``pos`` where it is
    known). Returns the commit's number.
    """
    spark = events.sparkSession
    known = conform_events(events)
    order = [F.col(c) for c in ("pos", "ingest_seq") if c in known.columns]
    rows = known.select(*EVENT_FIELDS, F.coalesce(*order, F.lit(None).cast("bigint")).alias("ingest_seq"))
    sizes = known.groupBy("session_id").agg(F.count("*").alias("_n"))
    apart = sizes.filter((F.col("_n") >= FOLDER_ROWS) & F.col("session_id").isNotNull()).select("session_id", F.col("session_id").alias("session"))
    rows = rows.join(apart, "session_id", "left")
    rows = rows.withColumn(
        "event_type", F.when(F.col("event_type") != "tool_call", F.col("event_type"))
    )
    rows = rows.repartitionByRange("session_id", "ingest_seq", "timestamp")
    rows = rows.sortWithinPartitions("session_id", "ingest_seq", "timestamp")
    there = commits(spark, path)
    writer = writer or uuid.uuid4().hex
    number = there[writer][0] if writer in there else 1 + max((n for n, _ in there.values()), default=0)
    target = f"{path.rstrip('/')}/commit={number:012d}.{writer}"
    rows.write.mode("overwrite").partitionBy("session").json(target)
    return number
