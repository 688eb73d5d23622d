"""Connected components of a link table by label exchange and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.tables import cut

ROWS = 1 << 18


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every end of ``links(u, v)``; the label is the component's smallest node.

    Each round every node takes the smallest label among its neighbours and then the label
    of that label's node, until nothing changes; the driver sees one flag per round. Tables
    are read in tasks of about ROWS rows, so that small ones do not fall into many tasks.
    """
    pairs = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    pairs = cut(pairs)
    width = max(8, -(-pairs.count() // ROWS))
    labels = cut(pairs.groupBy(F.col("u").alias("node")).agg(F.least("u", F.min("v")).alias("label")).coalesce(width))
    while True:
        offered = (
            pairs.join(labels.withColumnRenamed("node", "v"), "v")
            .coalesce(width)
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("label").alias("offer"))
        )
        lowered = labels.join(offered, "node").select("node", F.col("label").alias("old"), F.least("label", "offer").alias("label"))
        lowered = cut(lowered.coalesce(width))
        heads = lowered.select(F.col("node").alias("label"), F.col("label").alias("head"))
        jumped = lowered.join(heads, "label").select("node", F.col("head").alias("label"), (F.col("head") < F.col("old")).alias("moved"))
        jumped = cut(jumped.coalesce(width))
        labels = jumped.select("node", "label")
        if jumped.filter("moved").isEmpty():
            return labels
