"""What the operators of this folder share: input columns and tables kept in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import wordspans
from skein.operators.lineage import fresh_path

_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Tables that cut() wrote, by application.
_WRITTEN: dict[str, list[str]] = {}

#: White space of the word rule, as a character class of Java's patterns.
WHITE_CLASS = r"[\x20\x09-\x0D]+"


def ship(*modules) -> None:
    """Send these modules along with the tasks: executors need not have the package."""
    for module in modules:
        cloudpickle.register_pickle_by_value(module)


ship(wordspans)


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a job that runs inside are freed once it is done."""
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there; the job's shuffle files are freed."""
    spark = df.sparkSession
    path = fresh_path(spark)
    with freed(spark):
        df.write.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(docs: DataFrame) -> None:
    """Delete the tables that :func:`cut` wrote so far, but for those that ``docs`` reads.

    For a chain of steps of which each is written before the next begins.
    """
    spark = docs.sparkSession
    written = _WRITTEN.get(spark.sparkContext.applicationId, [])
    read_now = {name.rsplit("/", 2)[-2] for name in docs.inputFiles()} if written else set()
    kept = []
    for path in written:
        if path.rsplit("/", 1)[-1] in read_now:
            kept.append(path)
            continue
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
    written[:] = kept


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def given(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named input columns under the operator's own names, whatever else ``df`` has."""
    return df.select(*[(df[c] if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def split_count(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def power_of_two(least: int) -> int:
    return 1 << max(0, least - 1).bit_length()


def words(text: Column) -> Column:
    """Words of a text in order, unchanged."""
    return F.array_remove(F.split(text, WHITE_CLASS), "")
