"""Hash trees over the rows of a session, and manifests of their roots.

Rows of a session and part stand in order of ``pos``. Each level hashes up to ``FAN``
neighbours into one node, so a task holds one node's children whatever the session's size,
and each level has a ``FAN``-th of the rows of the one below. A node without neighbours moves
up as it is: a root does not depend on how large other sessions are. The root is hashed with
the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN = 16
PART = ("session_id", "part")


def tree_roots(leaves: DataFrame, keys: Sequence[str] = PART, fan: int = FAN) -> DataFrame:
    """``keys, rows, digest`` of the leaves (keys, pos from 1, leaf).

    Leaves of one place are ordered by their digest. Keys without leaves have no root.
    """
    if fan < 2:
        raise ValueError("a node has at least two children")
    last = leaves.agg(F.max("pos")).first()[0] or 0
    nodes = leaves.select(*keys, (F.col("pos") - 1).alias("at"), F.col("leaf").alias("node"), F.lit(1).cast("bigint").alias("rows"))
    while True:
        children = F.array_sort(F.collect_list(F.struct("at", "node")))
        level = nodes.groupBy(*keys, F.floor(F.col("at") / fan).alias("up")).agg(children.alias("c"), F.sum("rows").alias("rows"))
        one = F.col("c")[0]["node"]
        hashed = F.sha2(F.array_join(F.col("c.node"), ""), 256)
        nodes = level.select(*keys, F.col("up").alias("at"), F.when(F.size("c") == 1, one).otherwise(hashed).alias("node"), "rows")
        last = -(-last // fan)
        if last <= 1:
            break
    return nodes.select(*keys, "rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), "node"), 256).alias("digest"))


def field_leaves(table: DataFrame, part: str, fields: Sequence[str]) -> DataFrame:
    """The fields of one row per session as leaves in order of their names; null differs from any text."""
    kinds = dict(table.dtypes)

    def text(name: str) -> Column:
        value = F.to_json(name) if kinds[name].startswith(("array", "map", "struct")) else F.col(name).cast("string")
        return F.coalesce(F.concat(F.lit(f"{name}="), value), F.lit(f"{name}-"))

    entries = F.array(
        *[F.struct(F.lit(i).cast("bigint").alias("pos"), F.sha2(text(f), 256).alias("leaf")) for i, f in enumerate(sorted(fields), 1)]
    )
    return table.select("session_id", F.lit(part).alias("part"), F.inline(entries))


def differing_parts(stated: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (session_id, part, change) where two tables of roots differ: ``added``, ``removed`` or ``changed``."""
    a = stated.select(*PART, F.col("rows").alias("rows_a"), F.col("digest").alias("a"))
    b = found.select(*PART, F.col("rows").alias("rows_b"), F.col("digest").alias("b"))
    change = (
        F.when(F.col("a").isNull(), "added")
        .when(F.col("b").isNull(), "removed")
        .when((F.col("a") != F.col("b")) | (F.col("rows_a") != F.col("rows_b")), "changed")
    )
    return a.join(b, list(PART), "full").select(*PART, change.alias("change")).filter("change IS NOT NULL")
