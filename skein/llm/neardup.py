"""Near duplicates by MinHash with tensored banding, verified on full shingle sets.

Two collections of ``tables`` short signatures are taken of each document, a signature being
``rows`` min-hashes. Every pair of one signature from each collection forms a table key, so
``tables ** 2`` tables of ``2 * rows`` min-hashes come from ``2 * tables * rows`` min-hashes
in all. Documents of similarity s miss each other with a chance of about
``2 (1 - s ** rows) ** tables``.

Links are exact and none between candidates is lost, without listing pairs:

1. Documents with the same shingle set fold into one representative.
2. In each table bucket every representative points to the one of the smallest id, its pivot.
   All that point to one pivot are its family; whoever shares a bucket shares a family.
3. Members are compared with their family's pivot on full sets, which settles a hot group of
   copies in one pass over its members.
4. All other pairs of a family are compared in blocks: members are dealt into blocks of
   about ``BLOCK`` by hash, each pair of blocks is one small group, whose intersections come
   from a matrix product. A group gives back a spanning forest of its links.
5. The components of all links are the result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import wordspans
from skein.llm.components import components
from skein.llm.substring import NO_ID
from skein.llm.tables import cut, given, ship
from skein.llm.wordspans import as_long, mix, runs, slices, split_words

BLOCK = 128
COLUMNS = 4096


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted different shingle hashes of each text; a shorter text is one shingle, an empty one none."""
    words = split_words(column, lower=True)
    hashes = words.hashes()
    grams = runs(hashes, size)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        else:
            out.append(runs(hashes[a:b], int(b - a)) if b > a else grams[:0])
    return out


def _multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return numbers[:count] | np.uint64(1), numbers[count:]


def signatures(sets: list[np.ndarray], rows: int, tables: int) -> np.ndarray:
    """Short signatures of nonempty sets: shape (2, tables, sets)."""
    flat = np.concatenate(sets)
    begins = np.cumsum([0, *map(len, sets)])[:-1]
    factor, shift = _multipliers(2 * tables * rows)
    out = np.zeros((2 * tables, len(sets)), dtype=np.uint64)
    for k in range(2 * tables * rows):
        least = np.minimum.reduceat(flat * factor[k] + shift[k], begins)
        out[k // rows] = mix(out[k // rows] + least)
    return out.reshape(2, tables, len(sets))


def _signed(batches: Iterator[pa.RecordBatch], size: int, rows: int, tables: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            sets = shingle_sets(part.column("text"), size)
            full = [i for i, s in enumerate(sets) if len(s)]
            digest = np.zeros((2, len(sets)), dtype=np.uint64)
            short = np.zeros((2, len(sets), tables), dtype=np.uint64)
            if full:
                flat = np.concatenate([sets[i] for i in full])
                begins = np.cumsum([0, *(len(sets[i]) for i in full)])[:-1]
                digest[0, full] = np.add.reduceat(mix(flat), begins)
                digest[1, full] = np.add.reduceat(mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begins)
                short[:, full] = signatures([sets[i] for i in full], rows, tables).transpose(0, 2, 1)
            bounds = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * tables)
            lists = [pa.ListArray.from_arrays(bounds, as_long(x.ravel())) for x in short]
            columns = [part.column("doc_id"), part.column("h"), pa.array([len(s) for s in sets], pa.int64()), as_long(digest[0]), as_long(digest[1]), *lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "n", "d1", "d2", "a", "b"])


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            sets = [s.tobytes() for s in shingle_sets(part.column("text"), size)]
            yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array(sets, pa.binary())], ["rep", "items"])


def _are_near(common, one, two, percent: int):
    return 100 * common >= percent * (one + two - common)


def _with_head(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Whether each member is near its family's pivot."""
    for batch in batches:
        near = []
        for rep, family, items, head in zip(*(batch.column(c) for c in ("rep", "family", "items", "head")), strict=True):
            one, two = (np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in (items, head))
            fits = 100 * min(len(one), len(two)) >= percent * max(len(one), len(two))
            common = len(np.intersect1d(one, two, assume_unique=True)) if fits else 0
            near.append(rep.as_py() == family.as_py() or bool(fits and _are_near(common, len(one), len(two), percent)))
        columns = [batch.column("rep"), batch.column("family"), pa.array(near), batch.column("items")]
        yield pa.RecordBatch.from_arrays(columns, ["rep", "family", "near", "items"])


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted sets."""
    flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.ones(len(flat), dtype=bool)
    fresh[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column) >= 2 if len(flat) else np.zeros(0, dtype=bool)
    keep = shared[column] if len(flat) else shared
    number = np.cumsum(shared) - 1
    owner, column = owner[keep], number[column[keep]]
    common = np.zeros((len(sets), len(sets)), dtype=np.int64)
    for begin in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, (begin, begin + COLUMNS))
        part = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        part[owner[a:b], column[a:b] - begin] = 1
        common += (part @ part.T).astype(np.int64)
    return common


def _block_links(table: pa.Table, percent: int) -> pa.Table:
    """Spanning forest of the links between the two blocks of a group, or inside its one block."""
    reps = table.column("rep").to_pylist()
    near = table.column("near").to_pylist()
    own = np.array(table.column("own").to_pylist())
    sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table.column("items")]
    sizes = np.array([len(s) for s in sets])
    linked = np.triu(_are_near(intersections(sets), sizes[:, None], sizes[None, :], percent), 1)
    if own.min() != own.max():
        linked &= own[:, None] != own[None, :]
    head = list(range(len(reps)))

    def find(i: int) -> int:
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    first_near = near.index(True) if True in near else None
    for i, x in enumerate(near):
        if x:
            head[i] = first_near
    us, vs = [], []
    for i, j in zip(*map(np.ndarray.tolist, np.nonzero(linked)), strict=True):
        x, y = find(i), find(j)
        if x != y:
            head[y] = x
            us.append(reps[i])
            vs.append(reps[j])
    return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})


def _block_tasks(members: DataFrame) -> DataFrame:
    """Every member once for each group it is compared in: ``family, p, q, own, rep, near, items``.

    Blocks of members near the head come first; two of those need no comparison. A family
    of at most one block is one group, whatever it holds.
    """
    counts = members.groupBy("family").agg(F.count_if("near").alias("n_near"), F.count_if(~F.col("near")).alias("n_far"))
    counts = counts.filter("n_far > 0").select(
        "family",
        F.when(F.col("n_near") + F.col("n_far") <= BLOCK, 0).otherwise(F.ceil(F.col("n_near") / BLOCK)).cast("int").alias("near_blocks"),
        F.when(F.col("n_near") + F.col("n_far") <= BLOCK, 1).otherwise(F.ceil(F.col("n_far") / BLOCK)).cast("int").alias("far_blocks"),
    )
    spot = F.xxhash64("rep")
    own = F.when(F.col("near") & (F.col("near_blocks") > 0), F.pmod(spot, F.greatest("near_blocks", F.lit(1)))).otherwise(
        F.col("near_blocks") + F.pmod(spot, F.col("far_blocks"))
    )
    dealt = members.join(counts, "family").select("*", own.cast("int").alias("own"))
    others = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("near_blocks") + F.col("far_blocks") - 1)).alias("other"))
    return others.filter((F.col("own") >= F.col("near_blocks")) | (F.col("other") >= F.col("near_blocks"))).select(
        "family", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "rep", "near", "items"
    )


def _dealt(members: DataFrame) -> DataFrame:
    """The block tasks, each group by itself: the join by family would keep all blocks of one in a task."""
    return _block_tasks(members).repartition("family", "p", "q")


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    percent: int = 80,
    rows: int = 2,
    tables: int = 10,
) -> DataFrame:
    """Group of near-equal documents of every row: ``doc_id, n_shingles, component_id, kept``.

    Texts are lowered (A-Z) and cut into words; documents are linked where their shingle
    sets have a Jaccard similarity of ``percent`` or more. ``component_id`` is the smallest id
    that can be reached over links, ``kept`` marks the document that has it. ``rows`` and
    ``tables`` set the banding (see above); a larger corpus wants more ``rows``.

    Null and blank texts have no shingles and are linked with nothing. Rows with equal text
    are linked even when they share an id; rows with one id and other texts are judged row by
    row. Null ids come before all others. An empty table gives an empty result; other
    columns are ignored.
    """
    source = given(docs, doc_id=F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)), text=F.coalesce(docs[text_col], F.lit("")))
    signed = cut(
        source.withColumn("h", F.xxhash64("text")).mapInArrow(
            lambda b: _signed(b, shingle_words, rows, tables),
            "doc_id bigint, h bigint, n bigint, d1 bigint, d2 bigint, a array<bigint>, b array<bigint>",
        )
    )
    same = ["n", "d1", "d2"]
    # A node is a shingle set; its number has nothing to do with ids, which may repeat.
    reps = signed.filter("n > 0").groupBy(*same).agg(F.min(F.struct("doc_id", "h", "a", "b")).alias("m"))
    reps = cut(reps.select(*same, "m.doc_id", "m.h", F.monotonically_increasing_id().alias("rep"), "m.a", "m.b"))

    pairs = F.flatten(F.transform("a", lambda x, i: F.transform("b", lambda y, j: F.xxhash64(i, j, x, y))))
    # The pivot is the set of the smallest id: of copies that drift apart, the first is nearest to all.
    keys = reps.select(F.struct("doc_id", "rep").alias("one"), F.explode(pairs).alias("key"))
    shared = keys.groupBy("key").agg(F.min("one").alias("first"), F.max("one").alias("last")).filter("first < last")
    shared = cut(shared.select("key", F.col("first.rep").alias("pivot")))
    keys = keys.select(F.col("one.rep").alias("rep"), "key")
    pointers = keys.join(shared, "key").filter("rep <> pivot").select("rep", F.col("pivot").alias("family")).distinct()
    pointers = cut(pointers)
    pivots = pointers.select("family").distinct()
    families = pointers.union(pivots.select("family", "family"))
    # A merge join at every size: a table of ids is no bounded broadcast.
    wanted = reps.join(families.select("rep").distinct().hint("merge"), "rep", "left_semi").select("doc_id", "h", "rep")
    texts = source.withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"])  # repeated rows fold before they travel
    sets = cut(
        texts.join(wanted.hint("merge"), ["doc_id", "h"])
        .select("rep", "text")
        .mapInArrow(lambda b: _sets(b, shingle_words), "rep bigint, items binary")
    )
    members = sets.join(families.hint("merge"), "rep").select("rep", "family", "items")
    heads = sets.join(pivots.hint("merge"), sets["rep"] == pivots["family"]).groupBy("family").agg(F.min("items").alias("head"))
    heads = cut(heads)  # written, so that the next join can split a hot family
    members = cut(
        members.join(heads.hint("merge"), "family")
        .select("rep", "family", "items", "head")
        .mapInArrow(lambda b: _with_head(b, percent), "rep bigint, family bigint, near boolean, items binary")
    )
    to_head = members.filter("near AND rep <> family").select(F.col("rep").alias("u"), F.col("family").alias("v"))
    in_blocks = _dealt(members).groupBy("family", "p", "q").applyInArrow(lambda t: _block_links(t, percent), "u bigint, v bigint")
    labels = components(cut(to_head.union(in_blocks)))

    named = reps.join(labels, reps["rep"] == labels["node"], "left").select(*same, "doc_id", F.coalesce("label", "rep").alias("label"))
    named = cut(named)
    least = named.groupBy("label").agg(F.min("doc_id").alias("component"))
    named = named.join(least.hint("merge"), "label").select(*same, "component")
    found = signed.select("doc_id", *same).join(named, same, "left")
    component = F.coalesce("component", "doc_id")
    return found.select(
        F.expr(f"nullif(doc_id, {NO_ID})").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.nullif(component, F.lit(NO_ID)).alias("component_id"),
        (component == F.col("doc_id")).alias("kept"),
    )


ship(wordspans, sys.modules[__name__])
