"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

Documents are dealt into shards of bounded size by a hash of their id; every shard is packed
on its own, longest piece first. Open bins stand in order of their residual room and carry
two bitmaps: the sources and the duplicate clusters they hold. A piece goes into the
tightest bin that has room and neither its source nor its cluster: the search begins at the
smallest sufficient residual and moves on to the next larger one until a bin is compatible.
If none is, a bin is opened.

A document longer than a bin is cut into full pieces, each a bin of its own, and a rest. The
shards' number follows the number of pieces, so the largest task stays the same at any size;
a source or cluster with a third of all rows is spread over all shards like any other.
"""

from __future__ import annotations

import sys
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm.tables import cut, given, ship

#: Documents per shard, on average.
SHARD_ROWS = 4096


class Bins:
    """Open bins of one shard in order of (residual, number)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: list[tuple[int, int]] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def put(self, size: int, source: int, cluster: int) -> int:
        """Number of the tightest compatible bin; ``source`` and ``cluster`` are bitmaps of at most one bit."""
        at = bisect_left(self.open, (size, -1))
        while at < len(self.open):
            room, number = self.open[at]
            if not (self.sources[number] & source or self.clusters[number] & cluster):
                del self.open[at]
                break
            at += 1
        else:
            room, number = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[number] |= source
        self.clusters[number] |= cluster
        if room > size:
            insort(self.open, (room - size, number))
        return number


def _bits(values: list) -> list[int]:
    """One bit per value that occurs more than once; others cannot conflict. Null has none."""
    seen: dict = {}
    for v in values:
        if v is not None:
            seen[v] = seen.get(v, 0) + 1
    number = {v: i for i, v in enumerate(v for v, n in seen.items() if n > 1)}
    return [1 << number[v] if v in number else 0 for v in values]


def pack_shard(table: pa.Table, capacity: int) -> pa.Table:
    """Bins of one shard's rest pieces: longest first, ties by id and row."""
    rows = table.sort_by([("size", "descending"), ("doc_id", "ascending"), ("tie", "ascending")])
    bins = Bins(capacity)
    sources, clusters = (_bits(rows.column(c).to_pylist()) for c in ("source", "cluster"))
    numbers = [bins.put(n, s, c) for n, s, c in zip(rows.column("size").to_pylist(), sources, clusters, strict=True)]
    return rows.drop_columns(["source", "cluster", "tie"]).append_column("bin", pa.array(numbers, pa.int64()))


def best_fit_bins(
    docs: DataFrame,
    size: Column | str,
    capacity: int,
    id_col: str = "doc_id",
    source: Column | str | None = "source",
    cluster: Column | str | None = None,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Pieces of all documents in bins: ``doc_id, piece, begin, size, shard, bin``.

    ``size`` is a document's length in the unit of ``capacity``. ``piece`` counts a
    document's pieces from 0, ``begin`` is where the piece starts. Full pieces have a bin of
    their own, numbered below 0 in their shard. No bin holds two pieces of one source or of
    one cluster; a null source or cluster conflicts with nothing.

    Documents of size 0 or null have one piece of size 0, which takes no room but keeps the
    conflicts. Ids may repeat or be null: every row is packed as a document of its own. An
    empty table gives an empty result; other columns are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity is at least 1")

    def column(c):
        return F.lit(None).cast("string") if c is None else docs[c] if isinstance(c, str) else c

    rows = given(
        docs,
        doc_id=id_col,
        total=F.coalesce(column(size).cast("long"), F.lit(0)),
        source=column(source).cast("string"),
        cluster=column(cluster).cast("string"),
    )
    rows = cut(rows)
    shards = max(1, -(-rows.count() // shard_rows))
    tie = F.xxhash64("doc_id", "total", "source", "cluster")
    dealt = rows.select("*", tie.alias("tie"), F.pmod(F.xxhash64("doc_id", "tie"), F.lit(shards)).cast("int").alias("shard"))
    full = F.when(F.col("total") > capacity, F.floor((F.col("total") - 1) / capacity)).otherwise(0).cast("int")
    dealt = dealt.withColumn("full", full)

    # Rows that are alike in all columns are told apart, or their full pieces would share a bin.
    alike = Window.partitionBy("shard", "doc_id", "tie").orderBy("total")
    whole = dealt.filter("full > 0").withColumn("copy", F.row_number().over(alike)).select(
        "doc_id", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece"), "shard", "tie", "copy"
    )
    whole = whole.select(
        "doc_id",
        "piece",
        (F.col("piece") * F.lit(capacity).cast("long")).alias("begin"),
        F.lit(capacity).cast("long").alias("size"),
        "shard",
        (-1 - F.abs(F.shiftright(F.xxhash64("doc_id", "tie", "copy", "piece"), 1))).alias("bin"),
    )
    begin = F.col("full") * F.lit(capacity).cast("long")
    rest = dealt.select(
        "doc_id", F.col("full").alias("piece"), begin.alias("begin"), (F.col("total") - begin).alias("size"), "shard", "source", "cluster", "tie"
    )
    kind = rest.schema["doc_id"].dataType.simpleString()
    packed = rest.groupBy("shard").applyInArrow(
        lambda t: pack_shard(t, capacity), f"doc_id {kind}, piece int, begin bigint, size bigint, shard int, bin bigint"
    )
    return packed.unionByName(whole)


ship(sys.modules[__name__])
