"""Event order inside a session, computed without pulling a session into one task.

A session may hold a large share of all rows, so nothing here opens a window over a
whole session. Rows are cut into ordered slices (minutes of the timestamp text at
first, fixed position ranges once positions exist). Windows run inside a slice;
what crosses slices travels as one summary row per slice or as a few copied rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.columns import iso_timestamp, parse_parents
from skein.operators.lineage import cut

SLICE_ROWS = 1 << 16
MINUTE_PREFIX = 16  # "YYYY-MM-DDTHH:MM": an order-preserving prefix of ISO text


def with_position(
    events: DataFrame,
    scope: Sequence[str] = ("session_id",),
    ts_col: str = "timestamp",
    seq_col: str = "ingest_seq",
    out: str = "pos",
    prefix: int = MINUTE_PREFIX,
    slice_rows: int | None = None,
) -> DataFrame:
    """Add the 1-based position in (timestamp text, ingest order) within the scope.

    Scopes of at most ``slice_rows`` rows are ranked as a whole. The rows of larger ones are
    sliced by the first ``prefix`` characters of the text; slices of more than ``slice_rows``
    rows, as tied timestamps make them, are ranked over sampled ranges instead.
    """
    scope = list(scope)
    limit = slice_rows or SLICE_ROWS
    known = events.dropna(subset=scope)
    sizes = known.groupBy(*scope).agg(F.count("*").alias("_n"))
    large = cut(sizes.filter(F.col("_n") > limit).select(*scope))
    whole = Window.partitionBy(*scope).orderBy(ts_col, seq_col)
    if large.isEmpty():
        return known.withColumn(out, F.row_number().over(whole).cast("bigint"))
    small = known.join(large, scope, "left_anti").withColumn(out, F.row_number().over(whole).cast("bigint"))
    rest = known.join(large, scope, "left_semi")
    return small.unionByName(_position_by_slices(rest, scope, ts_col, seq_col, out, prefix, limit))


def _position_by_slices(
    events: DataFrame, scope: list[str], ts_col: str, seq_col: str, out: str, prefix: int, limit: int
) -> DataFrame:
    keys = [*scope, "_slice"]
    sliced = events.withColumn("_slice", F.coalesce(F.substring(ts_col, 1, prefix), F.lit("")))
    before = (
        Window.partitionBy(*scope)
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    counts = sliced.groupBy(*keys).agg(F.count("*").alias("_n"))
    offsets = cut(counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    hot = offsets.filter(F.col("_n") > limit).select(*keys)
    crowded = not hot.isEmpty()
    calm = sliced.join(hot, keys, "left_anti") if crowded else sliced
    ranked = calm.withColumn(
        "_rn",
        F.row_number().over(Window.partitionBy(*keys).orderBy(ts_col, seq_col)),
    )
    if crowded:
        ranked = ranked.unionByName(_ranked_over_ranges(sliced.join(hot, keys, "left_semi"), keys, [ts_col, seq_col]))
    return (
        ranked.join(offsets.drop("_n"), keys)
        .withColumn(out, (F.col("_off") + F.col("_rn")).cast("bigint"))
        .drop("_slice", "_rn", "_off")
    )


def _ranked_over_ranges(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``_rn``, the rank by ``order`` within ``keys``, without bringing the rows of a key together.

    Sampled ranges of (keys, order) are written sorted, one file each. A row's place in its
    file, less its key's first place there, plus the key's rows in earlier files is its rank.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    placed = cut(dealt).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    runs = placed.groupBy(*keys, "_file").agg(F.min("_row").alias("_first"), F.count("*").alias("_run"))
    before = Window.partitionBy(*keys).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*keys, "_file", (F.coalesce(F.sum("_run").over(before), F.lit(0)) - F.col("_first") + 1).alias("_to"))
    # A row for each key and file that has it: at most as many as files and keys together.
    return placed.join(runs, [*keys, "_file"]).withColumn("_rn", F.col("_row") + F.col("_to")).drop("_file", "_row", "_to")


def prepare(events: DataFrame) -> DataFrame:
    """Event table with ``pos``, parsed ``parents`` and a timestamp column ``ts``."""
    if "ingest_seq" not in events.columns:
        events = events.withColumn("ingest_seq", F.monotonically_increasing_id())
    return (
        with_position(events)
        .withColumn("parents", parse_parents("parent_event_id"))
        .withColumn("ts", iso_timestamp("timestamp"))
    )


def neighbours(
    df: DataFrame,
    exprs: dict[str, tuple[str, int]],
    scope: Sequence[str] = ("session_id",),
    pos: str = "pos",
    slice_rows: int | None = None,
) -> DataFrame:
    """Add look-back columns ``{name: (column, distance)}`` within the scope."""
    reach = max(n for _, n in exprs.values())
    sliced = _with_halo(df, pos, reach, slice_rows)
    w = Window.partitionBy(*scope, "_slice").orderBy(pos)
    for name, (col, n) in exprs.items():
        sliced = sliced.withColumn(name, F.lag(col, n).over(w))
    return _drop_halo(sliced)


def look_back(
    df: DataFrame,
    item: Column,
    rows: int,
    out: str,
    scope: Sequence[str] = ("session_id",),
    pos: str = "pos",
    slice_rows: int | None = None,
) -> DataFrame:
    """Add an array with ``item`` of the last ``rows`` rows, nearest last."""
    sliced = _with_halo(df, pos, rows, slice_rows)
    w = Window.partitionBy(*scope, "_slice").orderBy(pos).rowsBetween(-rows, -1)
    return _drop_halo(sliced.withColumn(out, F.collect_list(item).over(w)))


def _with_halo(df: DataFrame, pos: str, reach: int, slice_rows: int | None) -> DataFrame:
    size = slice_rows or SLICE_ROWS
    home = F.floor((F.col(pos) - 1) / size)
    into = F.floor((F.col(pos) - 1 + reach) / size)
    return df.withColumn("_home", home).withColumn("_slice", F.explode(F.sequence(home, into)))


def _drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(F.col("_slice") == F.col("_home")).drop("_slice", "_home")


def running_sum(
    df: DataFrame,
    exprs: dict[str, Column],
    scope: Sequence[str] = ("session_id",),
    pos: str = "pos",
    inclusive: bool = True,
    dtype: str = "bigint",
    slice_rows: int | None = None,
) -> DataFrame:
    """Add running sums over the scope: sums in a slice plus slice offsets.

    Exclusive sums leave out the row itself and are zero on a scope's first row.
    """
    size = slice_rows or SLICE_ROWS
    scope = list(scope)
    sliced = df.withColumn("_slice", F.floor((F.col(pos) - 1) / size))
    for name, expr in exprs.items():
        sliced = sliced.withColumn(f"_v_{name}", expr.cast(dtype))
    zero = F.lit(0).cast(dtype)
    w = (
        Window.partitionBy(*scope, "_slice")
        .orderBy(pos)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    before = (
        Window.partitionBy(*scope).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = sliced.groupBy(*scope, "_slice").agg(
        *[F.sum(f"_v_{name}").alias(f"_o_{name}") for name in exprs]
    )
    local = sliced
    for name in exprs:
        local = local.withColumn(name, F.coalesce(F.sum(f"_v_{name}").over(w), zero))
        totals = totals.withColumn(f"_o_{name}", F.coalesce(F.sum(f"_o_{name}").over(before), zero))
    joined = local.join(totals, [*scope, "_slice"])
    for name in exprs:
        joined = joined.withColumn(name, F.col(name) + F.col(f"_o_{name}"))
    return joined.drop("_slice", *[f"_v_{n}" for n in exprs], *[f"_o_{n}" for n in exprs])


def running_last(
    df: DataFrame,
    exprs: dict[str, Column],
    scope: Sequence[str] = ("session_id",),
    pos: str = "pos",
    inclusive: bool = True,
    slice_rows: int | None = None,
) -> DataFrame:
    """Add the latest non-null value of each expression up to (or before) each row."""
    size = slice_rows or SLICE_ROWS
    scope = list(scope)
    sliced = df.withColumn("_slice", F.floor((F.col(pos) - 1) / size))
    for name, expr in exprs.items():
        sliced = sliced.withColumn(f"_v_{name}", expr)
    upto = 0 if inclusive else -1
    w = (
        Window.partitionBy(*scope, "_slice")
        .orderBy(pos)
        .rowsBetween(Window.unboundedPreceding, upto)
    )
    local = sliced
    for name in exprs:
        local = local.withColumn(name, F.last(f"_v_{name}", ignorenulls=True).over(w))
    ends = sliced.groupBy(*scope, "_slice").agg(
        *[
            F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(pos))).alias(f"_o_{n}")
            for n in exprs
        ]
    )
    before = (
        Window.partitionBy(*scope).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    for name in exprs:
        ends = ends.withColumn(f"_o_{name}", F.last(f"_o_{name}", ignorenulls=True).over(before))
    joined = local.join(ends, [*scope, "_slice"])
    for name in exprs:
        joined = joined.withColumn(name, F.coalesce(F.col(name), F.col(f"_o_{name}")))
    return joined.drop("_slice", *[f"_v_{n}" for n in exprs], *[f"_o_{n}" for n in exprs])


def top_rows(
    counts: DataFrame, scope: Sequence[str], order: Sequence[Column], n: int | None, out: str = "rank"
) -> DataFrame:
    """Keep the first ``n`` rows per scope of an already aggregated table."""
    w = Window.partitionBy(*scope).orderBy(*order)
    ranked = counts.withColumn(out, F.row_number().over(w))
    return ranked if n is None else ranked.filter(F.col(out) <= n)
