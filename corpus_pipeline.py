"""Training-data pipeline: stages over ``documents``, each written as Parquet and read again.

Ids of ``documents`` may repeat or be null; every stage works on all rows its predecessor kept.
Verdicts go back to rows by what the row is: by null-safe id and digest of the text where rows
alike in both have one verdict, else by a row number in order of the ids.
Decisions are merged with the documents at every size, as a table of ids is no bounded broadcast.

Tables that a stage keeps for itself are deleted when the next stage begins, so a stage's
result has to be written by then.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.exactdup import exact_groups
from skein.llm.neardup import near_groups
from skein.llm.packing import best_fit_bins
from skein.llm.quality import quality_rules
from skein.llm.substring import repeated_passages
from skein.llm.tables import cut, documents, drop_written, freed, fresh_path, split_count, words

#: Room of a bin in words.
BIN_WORDS = 2048


def _key(doc_id: Column, sha256: Column) -> Column:
    """Null-safe id and digest of the text, in one string."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), sha256)


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``key``; a null text is the empty text, as in the operators."""
    return docs.withColumn("key", _key(F.col("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256)))


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row``, which differs in all rows and grows with the id, null ids first.

    Rows of one id are ordered by their text's digest. The rows are written, so that the
    numbers stay; hot ids are spread over ranges by the digest.
    """
    order = ["doc_id", "digest"]
    dealt = docs.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    dealt = dealt.repartitionByRange(split_count(docs.sparkSession), *order).sortWithinPartitions(*order)
    return cut(dealt.drop("digest").withColumn("row", F.monotonically_increasing_id()))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule."""
    keyed = _keyed(docs)
    judged = cut(quality_rules(keyed, id_col="key").select(F.col("doc_id").alias("key"), "kept"))  # a filter would repeat the measures' expressions
    kept = cut(judged.filter("kept").select("key").distinct())
    return keyed.join(kept.hint("merge"), "key", "left_semi").select(docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, of those with the smallest id; a null id stays only if no other has the text."""
    kept = exact_groups(docs).filter("kept").select(_key(F.col("doc_id"), F.col("text_sha256")).alias("key"))
    # Rows alike in id and text are one document; they fold before the shuffle.
    single = _keyed(docs).groupBy("key").agg(F.min(F.struct(*docs.columns)).alias("doc"))
    return single.join(kept.hint("merge"), "key", "left_semi").select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity of 0.8 or more."""
    rows = _numbered(docs)
    kept = near_groups(rows, id_col="row", shingle_words=5, percent=80).filter("kept").select(F.col("doc_id").alias("row"))
    return rows.join(kept.hint("merge"), "row", "left_semi").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that an earlier row has: one of smaller id, or of the same id.

    Texts that lose nothing stay as they are; the others become their kept words joined by
    one space. A document of which nothing is left goes.
    """
    rows = _numbered(docs)
    shorter = repeated_passages(rows, id_col="row", min_words=50, seed_words=12).filter("n_removed > 0")
    shorter = shorter.select(F.col("doc_id").alias("row"), "n_words", "n_removed", "kept_text")
    text = F.coalesce("kept_text", "text")
    joined = rows.join(shorter.hint("merge"), "row", "left").filter("n_removed IS NULL OR n_removed < n_words")
    return joined.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in bins: ``doc_id, piece, begin, size, shard, bin``."""
    return best_fit_bins(docs, F.size(words(F.coalesce(F.col("text"), F.lit("")))), BIN_WORDS, cluster=F.xxhash64(F.lower("text")))


def _after_others(stage):
    """The stage, which first deletes what earlier stages wrote for themselves: their results are written by now."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_written(docs)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact_dedup),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", packing),
]
STAGES = [(name, _after_others(stage)) for name, stage in STAGES]

#: Near duplicates and packing have no SQL; run() is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each stage's rows are kept in the shared folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        with freed(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
