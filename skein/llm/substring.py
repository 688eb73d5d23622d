"""Substring dedup by seed and extend over winnowed anchors.

A window is ``min_words`` consecutive words. Inside it the ``seed_words``-gram with the
smallest hash is its anchor, so equal windows always have the same anchor at the same place.

1. Seed: anchors of all documents are joined by hash; anchors of one document only drop out.
2. Extend: from each shared anchor the text is followed both ways over all windows that it
   anchors. First they are taken as one block: where a document of smaller id has the same
   block, all its windows match. Blocks that no smaller id has are then compared window by
   window among themselves; the first document of a block speaks for all others with it.
   Grouping does this for any number of documents at once: a passage that a third of all
   documents share costs each of them its own blocks, and no pair of documents is listed.
   Blocks and windows are told apart by 128 bits, the anchor's hash and their own.
3. Keep maximal repeats: overlapping and touching matches of a document join into spans,
   each at least ``min_words`` long, which are cut out.

Smallest and largest ids per key are taken before shuffles; the
joins back have one row per key on one side, so adaptive execution can split a hot key.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import wordspans
from skein.llm.tables import cut, given, ship
from skein.llm.wordspans import as_long, runs, slices, spans, split_words

#: Stands for a null id: such documents come before all others.
NO_ID = -(1 << 63)


def _anchors(column: pa.Array, min_words: int, seed_words: int):
    """Words, word hashes, seed hashes, and for each whole window (word, anchor word, text number)."""
    words = split_words(column)
    hashes = words.hashes()
    seeds = runs(hashes, seed_words)
    counts = words.counts
    text_of = np.repeat(np.arange(len(counts)), counts)
    n = max(0, len(hashes) - min_words + 1)
    best, offset = seeds[:n].copy(), np.zeros(n, dtype=np.int64)
    for j in range(1, min_words - seed_words + 1):
        other = seeds[j : j + n]
        lower = other < best
        best[lower] = other[lower]
        offset[lower] = j
    begin = np.flatnonzero(np.arange(n) + min_words <= words.first[1:][text_of[:n]])
    return words, hashes, seeds, begin, begin + offset[begin], text_of


def _new(anchor: np.ndarray) -> np.ndarray:
    """Where a window has another anchor than the one before it."""
    fresh = np.ones(len(anchor), dtype=bool)
    fresh[1:] = anchor[1:] != anchor[:-1]
    return fresh


def _seeds(batches: Iterator[pa.RecordBatch], min_words: int, seed_words: int) -> Iterator[pa.RecordBatch]:
    """Seeds of a slice of texts with the smallest and largest id that has each."""
    for batch in batches:
        for part in slices(batch, "text"):
            _, _, seeds, _, anchor, text_of = _anchors(part.column("text"), min_words, seed_words)
            anchor = anchor[_new(anchor)]
            ids = part.column("doc_id").to_numpy()[text_of[anchor]]
            order = np.argsort(seeds[anchor], kind="stable")
            seed, ids = seeds[anchor][order], ids[order]
            first = np.flatnonzero(_new(seed))
            if len(first):
                columns = [as_long(seed[first]), pa.array(np.minimum.reduceat(ids, first)), pa.array(np.maximum.reduceat(ids, first))]
                yield pa.RecordBatch.from_arrays(columns, ["seed", "lo", "hi"])


def _places(batches: Iterator[pa.RecordBatch], min_words: int, seed_words: int) -> Iterator[pa.RecordBatch]:
    """Every anchor of every text: (seed, doc_id, row, word position in the text)."""
    for batch in batches:
        for part in slices(batch, "text"):
            words, _, seeds, _, anchor, text_of = _anchors(part.column("text"), min_words, seed_words)
            anchor = anchor[_new(anchor)]
            text = text_of[anchor]
            ids, rows = (pa.array(part.column(c).to_numpy()[text]) for c in ("doc_id", "row"))
            columns = [as_long(seeds[anchor]), ids, rows, pa.array((anchor - words.first[text]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["seed", "doc_id", "row", "at"])


def _listed(column: pa.ListArray):
    """All list elements in a row (for structs, by field), and the row number of each."""
    sizes = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    if pa.types.is_struct(flat.type):
        values = {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}
    else:
        values = flat.to_numpy(zero_copy_only=False)
    return values, np.repeat(np.arange(len(column)), sizes)


def _blocks(batches: Iterator[pa.RecordBatch], min_words: int, seed_words: int) -> Iterator[pa.RecordBatch]:
    """For each anchor listed in ``at`` all its windows as one block: first window, their number, hash of the words."""
    for batch in batches:
        for part in slices(batch, "text"):
            words, _, seeds, begin, anchor, text_of = _anchors(part.column("text"), min_words, seed_words)
            marked = np.zeros(len(text_of) + 1, dtype=bool)
            at, text = _listed(part.column("at"))
            marked[words.first[text] + at] = True
            first = np.flatnonzero(_new(anchor))
            count = np.diff(np.append(first, len(anchor)))
            use = marked[anchor[first]]
            first, count = first[use], count[use]
            start = begin[first]
            block = spans(words.hashes(seed=1), start, count + (min_words - 1))
            text = text_of[start]
            ids, rows = (part.column(c).to_numpy()[text] for c in ("doc_id", "row"))
            places = [pa.array((start - words.first[text]).astype(np.int32)), pa.array(count.astype(np.int32))]
            columns = [as_long(seeds[anchor[first]]), as_long(block), pa.array(ids), pa.array(rows), *places]
            yield pa.RecordBatch.from_arrays(columns, ["seed", "block", "doc_id", "row", "at", "n"])


def _windows(batches: Iterator[pa.RecordBatch], min_words: int, seed_words: int) -> Iterator[pa.RecordBatch]:
    """The windows that ``at`` lists as (first, number), one by one."""
    for batch in batches:
        for part in slices(batch, "text"):
            words, _, seeds, begin, anchor, text_of = _anchors(part.column("text"), min_words, seed_words)
            listed, text = _listed(part.column("at"))
            edges = np.zeros(len(text_of) + 1, dtype=np.int64)
            start = words.first[text] + listed["at"]
            np.add.at(edges, start, 1)
            np.add.at(edges, start + listed["n"], -1)
            use = np.cumsum(edges)[begin] > 0
            begin, anchor = begin[use], anchor[use]
            window = runs(words.hashes(seed=1), min_words)[begin]
            text = text_of[begin]
            ids, rows = (part.column(c).to_numpy()[text] for c in ("doc_id", "row"))
            place = pa.array((begin - words.first[text]).astype(np.int32))
            columns = [as_long(seeds[anchor]), as_long(window), pa.array(ids), pa.array(rows), place]
            yield pa.RecordBatch.from_arrays(columns, ["seed", "block", "doc_id", "row", "at"])


def spans_of(windows: list[tuple[int, int]], min_words: int) -> list[tuple[int, int]]:
    """Maximal repeats: unions of runs of windows (first, number), as (begin, end) in words."""
    out: list[tuple[int, int]] = []
    for first, count in sorted(windows):
        end = first + count - 1 + min_words
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


def _cut_out(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = split_words(part.column("text"))
            data = words.data.tobytes()
            out: dict[str, list] = {"n_words": [], "n_removed": [], "spans": [], "kept_text": [], "kept_sha256": []}
            for i, windows in enumerate(part.column("at").to_pylist()):
                a, b = int(words.first[i]), int(words.first[i + 1])
                spans = spans_of([(w["at"], w["n"]) for w in windows or ()], min_words)
                keep = np.ones(b - a, dtype=bool)
                for begin, end in spans:
                    keep[begin:end] = False
                kept = np.flatnonzero(keep) + a
                text = b" ".join([data[s:e] for s, e in zip(words.starts[kept].tolist(), words.ends[kept].tolist(), strict=True)])
                out["n_words"].append(b - a)
                out["n_removed"].append(b - a - len(kept))
                out["spans"].append([{"begin": x, "end": y} for x, y in spans])
                out["kept_text"].append(text.decode())
                out["kept_sha256"].append(hashlib.sha256(text).hexdigest())
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.string(), pa.string()]
            columns = [part.column("doc_id"), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *out])


def repeated_passages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 13,
    seed_words: int = 6,
) -> DataFrame:
    """Cut out of every document what an earlier document has too.

    Returns ``doc_id, n_words, n_removed, spans, kept_text, kept_sha256``: ``spans`` are the
    maximal repeats as word ranges (begin, end), ``kept_text`` the other words joined by one
    space. Ids are integers; a smaller id is earlier. A word goes if a window of
    ``min_words`` words over it also starts in a document of smaller id; repeats inside one
    document stay.

    Null and empty texts and texts shorter than a window lose nothing. Documents with a null
    id come first and are one document among themselves, as are rows that share an id, so
    neither removes from the other. An empty table gives an empty result; other columns are
    ignored.
    """
    if not 1 <= seed_words <= min_words:
        raise ValueError("a seed has from one word up to as many as a window")
    source = given(docs, doc_id=docs[id_col].cast("long"), text=F.coalesce(docs[text_col], F.lit("")))
    keyed = source.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    # A text is known by its id and its hash, so texts of different ids are never mixed up.
    keyed, key = keyed.withColumn("row", F.xxhash64("text")), ["doc_id", "row"]

    seeds = keyed.select("doc_id", "text").mapInArrow(
        lambda b: _seeds(b, min_words, seed_words), "seed bigint, lo bigint, hi bigint"
    )
    seeds = seeds.groupBy("seed").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi")
    seeds = cut(seeds.select("seed"))
    places = keyed.select(*key, "text").mapInArrow(
        lambda b: _places(b, min_words, seed_words), "seed bigint, doc_id bigint, row bigint, at int"
    )
    found = cut(places.join(seeds.hint("merge"), "seed").groupBy(*key).agg(F.collect_set("at").alias("at")))

    def earlier(df: DataFrame) -> DataFrame:
        """``df`` with ``later``: whether a smaller id has the same block.

        The blocks of several ids are written first, so that the join can split a hot block.
        """
        shared = df.groupBy("seed", "block").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
        both = df.join(cut(shared.drop("hi")), ["seed", "block"], "left")
        return both.withColumn("later", F.coalesce(F.col("doc_id") > F.col("lo"), F.lit(False))).drop("block", "lo")

    blocks = cut(
        keyed.join(found.hint("merge"), key)
        .select("doc_id", "row", "text", "at")
        .mapInArrow(lambda b: _blocks(b, min_words, seed_words), "seed bigint, block bigint, doc_id bigint, row bigint, at int, n int")
    )
    judged = cut(earlier(blocks))
    # Of equal blocks the first one speaks for all; windows are compared between first ones only.
    firsts = judged.filter("NOT later")
    contested = firsts.groupBy("seed").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
    open_blocks = firsts.join(contested.select("seed"), "seed", "left_semi")
    open_rows = cut(open_blocks.groupBy(*key).agg(F.collect_list(F.struct("at", "n")).alias("at")))
    windows = cut(
        keyed.join(open_rows.hint("merge"), key)
        .select("doc_id", "row", "text", "at")
        .mapInArrow(lambda b: _windows(b, min_words, seed_words), "seed bigint, block bigint, doc_id bigint, row bigint, at int")
    )
    single = earlier(windows).filter("later").select(*key, "at", F.lit(1).alias("n"))
    matches = judged.filter("later").select(*key, "at", "n").union(single)
    matched = cut(matches.groupBy(*key).agg(F.collect_list(F.struct("at", "n")).alias("at")))

    rest = keyed.join(matched.hint("merge"), key, "left").select(F.expr(f"nullif(doc_id, {NO_ID})").alias("doc_id"), "text", "at")
    return rest.mapInArrow(
        lambda b: _cut_out(b, min_words),
        "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<begin:bigint,end:bigint>>, "
        "kept_text string, kept_sha256 string",
    )


ship(wordspans, sys.modules[__name__])
