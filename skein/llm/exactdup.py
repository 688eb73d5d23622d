"""Exact duplicates by tree-merged runs of digests, in DataFrame operations only.

Documents are dealt into ``2^k`` runs by their id. A run holds one row per different text:
digest, a second check (length and another hash), the identifier that stays, and a count.
Runs then merge in binomial rounds: ``fan_in`` neighbouring runs become one, rows of equal
digest and check fold into one row that keeps the winning identifier. After the last round
each text has one row. The winners return down the same tree, so a text that owns a third
of all rows is met once per run and never in one place. Texts themselves are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.tables import cut, given, power_of_two, split_count

_SAME = ("digest", "check", "size")


def _fold(runs: DataFrame, winner) -> DataFrame:
    return runs.groupBy("run", *_SAME).agg(winner("keep").alias("keep"), F.sum("n").alias("n"))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise=None,
    fan_in: int = 8,
) -> DataFrame:
    """Group of equal texts of every document.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``, one row per document;
    ``keep`` says whether the ``smallest`` or ``largest`` id of a group stays and
    ``normalise`` maps the text column before texts are compared.

    Null and empty texts are equal to each other. Rows that repeat both id and text are one
    document. Rows with one id but different texts are documents of their own. A null id
    stays only where its text has no other id. An empty table gives an empty result; other
    columns are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    if fan_in < 2 or fan_in & (fan_in - 1):
        raise ValueError("fan_in is a power of two from 2 on")
    winner = F.min if keep == "smallest" else F.max
    bits = fan_in.bit_length() - 1
    count = power_of_two(split_count(docs.sparkSession))

    source = given(docs, doc_id=id_col, text=text_col)
    text: Column = F.coalesce(F.col("text"), F.lit(""))
    text = normalise(text) if normalise else text
    rows = (
        source.withColumn("text", text)
        .select(
            "doc_id",
            F.pmod(F.xxhash64("doc_id"), F.lit(count)).cast("int").alias("run"),
            F.unhex(F.sha2("text", 256)).alias("digest"),
            F.xxhash64("text").alias("check"),
            F.octet_length("text").alias("size"),
        )
        .repartition("run", "digest")
        .dropDuplicates(["run", *_SAME, "doc_id"])
        .sortWithinPartitions("run", "digest")
    )
    rows = cut(rows)

    levels = [cut(_fold(rows.select("run", *_SAME, F.col("doc_id").alias("keep"), F.lit(1).cast("long").alias("n")), winner))]
    while count > 1:
        merged = levels[-1].withColumn("run", F.shiftright("run", bits))
        levels.append(cut(_fold(merged, winner)))
        count >>= bits

    result = levels.pop()
    while levels:
        own = levels.pop().select("run", *_SAME)
        above = result.withColumnRenamed("run", "above")
        result = (
            own.withColumn("above", F.shiftright("run", bits)).join(above, ["above", *_SAME]).drop("above")
        )
    return (
        rows.join(result, ["run", *_SAME])
        .select(
            "doc_id",
            F.col("keep").alias("keep_id"),
            F.col("n").alias("group_size"),
            F.col("doc_id").eqNullSafe(F.col("keep")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )
