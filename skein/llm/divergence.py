"""How far the word use of sources differs, inside each language, in exact integers.

A task turns each text into terms with one ``bytes.translate`` (letters lowered, separators
blanked) and one ``bytes.split``; a Counter per document gives document frequencies and
counts, which the task adds up per (language, source, term) before anything is shuffled.
Spark sums these sparse rows. Pairs of sources are compared in blocks of sources times
chunks of terms: a term that neither source has adds a constant, so a chunk holds only
terms that some source of its two blocks has, and a constant fills the rest.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm.tables import cut, given, ship

#: Bytes that belong to terms keep their place (A-Z lowered), all others become a space.
TERM_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
UNIT = 1_000_000_000
#: Different (language, source, term) that a task holds before it sends them on.
HELD_TERMS = 1 << 19
SOURCES_PER_BLOCK = 64
TERMS_PER_CHUNK = 2048

_ONE_DOC = 1 << 40  # document frequency and count share one integer while a task adds up


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], dict[bytes, int]] = {}
    size = 0

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), sums in held.items():
            packed = np.fromiter(sums.values(), dtype=np.int64, count=len(sums))
            columns = [
                pa.array([lang] * len(sums), pa.string()),
                pa.array([source] * len(sums), pa.string()),
                pa.array(list(sums), pa.binary()).cast(pa.string()),
                pa.array(packed // _ONE_DOC),
                pa.array(packed % _ONE_DOC),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "docs", "n"])

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
            sums = held.setdefault((lang, source), {})
            before = len(sums)
            for term, n in Counter(text.as_py().translate(TERM_BYTES).split()).items():
                sums[term] = sums.get(term, 0) + n + _ONE_DOC
            size += len(sums) - before
            if size > HELD_TERMS:
                yield from sent()
                held, size = {}, 0
    yield from sent()


def _pair_sums(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Sums over one chunk of terms for all pairs of two blocks of sources.

    Rows without a term name the sources of the blocks: ``p`` is a missing term's value and
    ``v`` the number of terms of the language. Values are taken relative to that of a term
    that both lack; the first chunk adds it for all terms.
    """
    lang, left, right, chunk = (k.as_py() for k in key)
    marks = table.column("term").is_null().to_numpy()
    sources = table.column("source").combine_chunks()
    block = table.column("block").to_numpy()
    p = table.column("p").to_numpy()
    names = sources.filter(pa.array(marks))
    order = np.argsort(names.to_numpy(zero_copy_only=False).astype(object), kind="stable") if len(names) else np.zeros(0, int)
    names, base, of_block = names.take(pa.array(order)), p[marks][order], block[marks][order]
    place = pa.compute.index_in(sources.filter(pa.array(~marks)), names).to_numpy(zero_copy_only=False).astype(np.int64)
    terms = table.column("term").combine_chunks().filter(pa.array(~marks)).dictionary_encode()
    values = np.repeat(base[None, :], len(terms.dictionary), axis=0)
    values[terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), place] = p[~marks]
    total = int(table.column("v").to_numpy()[marks][0]) if chunk == 0 else 0
    second = np.flatnonzero(of_block == right)
    out_a, out_b, out_v = [], [], []
    for a in np.flatnonzero(of_block == left):
        gap = values[:, [a]] - values[:, second]
        own = gap * gap // (values[:, [a]] + values[:, second])
        apart = base[a] - base[second]
        missing = apart * apart // (base[a] + base[second])
        out_a.append(np.full(len(second), a))
        out_b.append(second)
        out_v.append(own.sum(axis=0) + (total - len(values)) * missing)
    a, b, v = np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_v)
    if left != right:  # the other way round, too
        a, b, v = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([v, v])
    differ = a != b
    a, b, v = pa.array(a[differ]), pa.array(b[differ]), pa.array(v[differ])
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "source": names.take(a), "item": names.take(b), "value": v})


def _share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(UNIT * (count + 2) / (total + 2 * terms))``; decimals hold counts of any size."""
    whole = F.lit(UNIT).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)")
    return (F.call_function("div", whole, (total + 2 * terms).cast("decimal(20,0)")) + 1).cast("long")


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def source_divergence(
    docs: DataFrame,
    min_docs: int = 10,
    top_terms: int = 10,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every (language, source) that occurs.

    Terms are runs of letters A-Z (lowered) and of characters above U+007F. A language keeps
    the terms that at least ``min_docs`` of its documents have. Part ``pair`` has a row for
    each other source of the language, part ``term`` the ``top_terms`` terms that the source
    uses most beyond its language; ranks are by value, descending, then by item.

    Null texts, languages and sources are empty strings. Each row counts as a document, also
    when it repeats another. A source without kept terms has pairs; a language without kept
    terms has pairs of value 0; a single source has none. An empty table gives an empty
    result; other columns are ignored.
    """
    empty = F.lit("")
    source = given(
        docs,
        lang=F.coalesce(docs[lang_col].cast("string"), empty),
        source=F.coalesce(docs[source_col].cast("string"), empty),
        text=F.coalesce(docs[text_col], empty),
    )
    sparse = source.mapInArrow(_term_rows, "lang string, source string, term string, docs bigint, n bigint")
    counts = sparse.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    # At most one row a source meets in a term's window.
    of_term = Window.partitionBy("lang", "term")
    kept = cut(
        counts.select(
            "lang",
            "source",
            "term",
            "n",
            F.sum("docs").over(of_term).alias("docs"),
            F.sum("n").over(of_term).alias("n_lang"),
            F.row_number().over(of_term.orderBy("source")).alias("place"),
        ).filter(F.col("docs") >= min_docs)
    )
    langs = kept.groupBy("lang").agg(F.sum((F.col("place") == 1).cast("long")).alias("v"), F.sum("n").alias("all_lang"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("all"))
    groups = source.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["all", "v", "all_lang"])
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = cut(groups.withColumn("block", F.floor(number / SOURCES_PER_BLOCK).cast("int")))

    valued = kept.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("all"), F.col("v")))

    over = valued.withColumn("q", _share(F.col("n_lang"), F.col("all_lang"), F.col("v"))).filter("p > q")
    over = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = over.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_terms)

    chunks = F.greatest(F.lit(1), F.ceil(F.col("v") / TERMS_PER_CHUNK)).cast("int")
    blocks = groups.groupBy("lang").agg((F.max("block") + 1).alias("blocks"))
    columns = ["lang", "source", "block", "term", "p", "v", "chunk"]
    present = valued.withColumn("chunk", F.pmod(F.xxhash64("term"), chunks).cast("int")).select(*columns)
    marks = groups.filter(F.col("v") >= 0).select(
        "lang",
        "source",
        "block",
        F.lit(None).cast("string").alias("term"),
        F.when(F.col("v") > 0, _share(F.lit(0), F.col("all"), F.greatest(F.col("v"), F.lit(1)))).otherwise(1).alias("p"),
        "v",
        F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"),
    )
    dealt = present.unionByName(marks).join(blocks, "lang")
    dealt = dealt.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *columns, F.least("block", "partner").alias("left"), F.greatest("block", "partner").alias("right")
    )
    sums = dealt.groupBy("lang", "left", "right", "chunk").applyInArrow(_pair_sums, "lang string, source string, item string, value bigint")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    return pairs.unionByName(over)


ship(sys.modules[__name__])
