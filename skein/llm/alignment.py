"""Tokens of two tokenizers, aligned by the bytes they cover.

Texts are encoded in full by both. Where a token of both begins with a space mark and the
tokens before it end at the same byte (checked on byte offsets), a document is split; the
windows between are short and few of them differ, so each pair of id tuples is aligned once
and looked up from then on. A task packs the documents of a slice into a block: the
different linked id pairs of the block, with the number of its documents that have each,
and for every document the places of its pairs in that list. Spark sums the blocks' counts,
joins them back to the blocks, and each block hands them to its documents. So what is
shuffled are pairs per block and not pairs per document, and the most frequent pair is met
once per block.
"""

from __future__ import annotations

import hashlib
import os
import sys
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import pretokens, wordspans
from skein.llm.tables import cut, given, ship

BLOCK_BYTES = 16 << 20
SLICE_CHARS = 1 << 20
#: Different pieces whose ids a worker remembers.
HELD_PIECES = 1 << 18
#: Fixed value: the space mark of pieces.
MARK = "▁"
#: Documents have ``part`` 0, blocks 1.
_BLOCK = "block bigint, part int, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, codes array<bigint>, places array<int>, times array<int>"


def byte_letters() -> dict[str, int]:
    """Letters of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the rest for U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(0x100) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class TokenBytes:
    """Bytes of every id of a vocabulary, in a row."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.spaced = np.array([t[:1] == b" " for t in tokens], dtype=bool)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return pretokens.spread(self.flat, self.offsets[ids], self.sizes[ids])


class First:
    """The byte-level tokenizer (A); each different piece is given to the library once."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are plain text
        letters = byte_letters()
        names = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        added = set(self.tokenizer.get_added_tokens_decoder())
        self.bytes = TokenBytes(
            [
                names[i].encode() if i in added or not set(names[i]) <= letters.keys() else bytes(letters[c] for c in names[i])
                for i in range(max(names) + 1)
            ]
        )
        self.pieces = pretokens.PieceIds(pretokens.LibraryPieces(self.tokenizer), HELD_PIECES)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.pieces.ids(texts)


class Second:
    """The piece tokenizer (B), which adds the space before a text itself."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        every = range(self.model.get_piece_size())
        self.bytes = TokenBytes(
            [
                bytes([int(self.model.id_to_piece(i)[3:-1], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace(MARK, " ").encode()
                for i in every
            ]
        )

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = self.model.encode(texts, num_threads=1)
        bounds = np.cumsum([0, *map(len, lists)])
        return np.fromiter((i for x in lists for i in x), dtype=np.int64, count=bounds[-1]), bounds


class Numerals:
    """Ids in decimals with what follows them: comma, bar or semicolon."""

    def __init__(self, count: int):
        written = [f"{i}{mark}".encode() for i in range(count) for mark in ",|;"]
        self.table = TokenBytes(written)

    def joined(self, ids: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        which = 3 * ids + marks
        return self.table.joined(which), self.table.sizes[which]


class Windows:
    """Alignments of the different windows of a slice, and which of them stands where.

    A window is known by its two id tuples: a hash tells them apart and is checked against
    the ids, and each tuple pair is aligned once. All are aligned together: put end to end,
    both sides cover the same bytes, and a stretch between neighbouring token ends of either
    side belongs to one A and one B token, which is a link.
    """

    def __init__(self, a, b, cuts_a, cuts_b, first: TokenBytes, second: TokenBytes, numerals: Numerals):
        self.which, sample = self._known(a, b, cuts_a, cuts_b)
        from_a, from_b = cuts_a[:-1][sample], cuts_b[:-1][sample]
        size_a, size_b = np.diff(cuts_a)[sample], np.diff(cuts_b)[sample]
        a, b = pretokens.spread(a, from_a, size_a), pretokens.spread(b, from_b, size_b)
        of_a = np.repeat(np.arange(len(sample)), size_a)  # window of each A token
        ends_a, ends_b = np.cumsum(first.sizes[a]), np.cumsum(second.sizes[b])
        ends = np.union1d(ends_a, ends_b)
        link_a = np.searchsorted(ends_a, ends)
        self.codes = a[link_a] << 32 | b[np.searchsorted(ends_b, ends)]
        self.n_links = np.bincount(of_a[link_a], minlength=len(sample))
        shared_a = ends_b[np.minimum(np.searchsorted(ends_b, ends_a), max(len(ends_b) - 1, 0))] == ends_a if len(a) else np.zeros(0, bool)
        shared = ends_a[shared_a]
        self.n_groups = np.bincount(of_a[shared_a], minlength=len(sample))
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        # Spelled group by group, A before B.
        at_a = np.arange(len(a)) + np.searchsorted(group_b, group_a, side="left")
        at_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")
        ids, marks = np.empty(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.int64)
        ids[at_a], ids[at_b] = a, b
        marks[at_a[shared_a]] = 1
        last_b = shared[group_b] == ends_b if len(b) else shared_a[:0]
        marks[at_b[last_b]] = 2
        self.text, sizes = numerals.joined(ids, marks)
        total = np.append(0, np.cumsum(sizes))
        ends_at = np.append(0, np.cumsum(size_a + size_b))
        self.text_from, self.text_size = total[ends_at[:-1]], np.diff(total[ends_at])

    @staticmethod
    def _known(a, b, cuts_a, cuts_b) -> tuple[np.ndarray, np.ndarray]:
        sides = [(x, cuts[:-1], np.diff(cuts)) for x, cuts in ((a, cuts_a), (b, cuts_b))]
        seen = [wordspans.spans(wordspans.mix(x.astype(np.uint64) + np.uint64(1)), f, n) for x, f, n in sides]
        _, sample, which = np.unique(wordspans.mix(seen[0]) + seen[1], return_index=True, return_inverse=True)
        like = sample[which]
        if all(np.array_equal(n, n[like]) and np.array_equal(x, pretokens.spread(x, f[like], n)) for x, f, n in sides):
            return which, sample
        every = np.arange(len(which))  # two windows with one hash
        return every, every


def _differs(joined: np.ndarray, ends: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which texts are not their tokens' bytes; ``ends`` bound the tokens' bytes of each text."""
    wrong = np.diff(ends) != np.diff(bounds)
    for d in np.flatnonzero(~wrong) if wrong.any() else ():
        wrong[d] = not np.array_equal(joined[ends[d] : ends[d + 1]], data[bounds[d] : bounds[d + 1]])
    if not wrong.any():
        at = np.flatnonzero(joined != data)
        wrong[np.searchsorted(bounds, at, side="right") - 1] = True
    return wrong


class _Slice:
    """Figures and linked pairs of the documents of one slice; ``doc`` and ``code`` are row and pair, once each."""

    def __init__(self, texts: list[str], first: First, second: Second, numerals: Numerals):
        spaced = [" " + t if t else "" for t in texts]
        a, bound_a = first.ids(spaced)
        b, bound_b = second.ids(texts)
        a, b = a.astype(np.int64), b.astype(np.int64)
        data, bounds = wordspans.text_bytes(pa.array(spaced, pa.large_string()))
        ends_a = np.append(0, np.cumsum(first.bytes.sizes[a]))
        ends_b = np.append(0, np.cumsum(second.bytes.sizes[b]))
        wrong = _differs(first.bytes.joined(a), ends_a[bound_a], data, bounds)
        wrong |= _differs(second.bytes.joined(b), ends_b[bound_b], data, bounds)
        if wrong.any():
            sizes_a, sizes_b = np.diff(bound_a), np.diff(bound_b)
            a, b = a[np.repeat(~wrong, sizes_a)], b[np.repeat(~wrong, sizes_b)]
            bound_a, bound_b = (np.append(0, np.cumsum(np.where(wrong, 0, x))) for x in (sizes_a, sizes_b))
            ends_a = np.append(0, np.cumsum(first.bytes.sizes[a]))
            ends_b = np.append(0, np.cumsum(second.bytes.sizes[b]))
        # A window begins where a text does, or where both have a space-marked token at one byte.
        heads = [x.bytes.spaced[ids] for x, ids in ((first, a), (second, b))]
        for head, bound in zip(heads, (bound_a, bound_b), strict=True):
            head[bound[:-1][np.diff(bound) > 0]] = True
        at_a, at_b = map(np.flatnonzero, heads)
        _, in_a, in_b = np.intersect1d(ends_a[at_a], ends_b[at_b], assume_unique=True, return_indices=True)
        from_a, from_b = at_a[in_a], at_b[in_b]
        windows = Windows(a, b, np.append(from_a, len(a)), np.append(from_b, len(b)), first.bytes, second.bytes, numerals)
        which = windows.which
        of_doc = np.searchsorted(from_a, bound_a)  # first window of each text
        groups, links, chars = (np.append(0, np.cumsum(x[which]))[of_doc] for x in (windows.n_groups, windows.n_links, windows.text_size))
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.diff(x) for x in (bound_a, bound_b, groups, links))
        spelled = memoryview(pretokens.spread(windows.text, windows.text_from[which], windows.text_size[which]))
        self.digests = [
            hashlib.sha256(spelled[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(chars[:-1].tolist(), chars[1:].tolist(), strict=True)
        ]
        different, place = np.unique(windows.codes, return_inverse=True)
        sizes = windows.n_links
        doc = np.repeat(np.repeat(np.arange(len(texts)), np.diff(of_doc)), sizes[which])
        mixed = doc * max(1, len(different)) + pretokens.spread(place, (np.cumsum(sizes) - sizes)[which], sizes[which])
        pairs, self.times = np.unique(mixed, return_counts=True)
        self.doc, self.code = pairs // max(1, len(different)), different[pairs % max(1, len(different))]


def _blocks(batches: Iterator[pa.RecordBatch], spec, block_bytes: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held_here = spec.value  # stays with the worker process, and so do the vocabularies
    if "codec" not in held_here:
        first, second = First(held_here["first"]), Second(held_here["second"])
        held_here["codec"] = first, second, Numerals(max(len(first.bytes.sizes), len(second.bytes.sizes)))
    first, second, numerals = held_here["codec"]
    number = TaskContext.get().partitionId() << 32
    held: list[tuple[pa.Array, _Slice]] = []
    size = 0

    def packed() -> Iterator[pa.RecordBatch]:
        different, place, docs = np.unique(np.concatenate([s.code for _, s in held]), return_inverse=True, return_counts=True)
        done = 0
        for keys, s in held:
            n = len(keys)
            own = place[done : done + len(s.code)]
            done += len(s.code)
            ends = np.searchsorted(s.doc, np.arange(n + 1))
            columns = {
                "block": pa.array(np.full(n, number)),
                "part": pa.array(np.zeros(n, np.int32)),
                "doc_id": keys,
                "n_a": pa.array(s.n_a),
                "n_b": pa.array(s.n_b),
                "n_groups": pa.array(s.n_groups),
                "n_links": pa.array(s.n_links),
                "groups_sha256": pa.array(s.digests, pa.string()),
                "codes": pa.nulls(n, pa.list_(pa.int64())),
                "places": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(own, pa.int32())),
                "times": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(s.times, pa.int32())),
            }
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)
        one = {"block": [number], "part": [1], "codes": [different], "times": [docs.astype(np.int32)]}
        columns = [pa.array(one[f.name], f.type) if f.name in one else pa.nulls(1, f.type) for f in schema]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)

    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for begin, end in pretokens.slices([len(t) for t in texts], SLICE_CHARS):
            held.append((batch.column("doc_id").slice(begin, end - begin), _Slice(texts[begin:end], first, second, numerals)))
            size += sum(map(len, texts[begin:end]))
            if size >= block_bytes:
                yield from packed()
                held, size, number = [], 0, number + 1
    if held:
        yield from packed()


def _counted(key: tuple[pa.Scalar, ...], docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Figures of a block's documents from the counts of its pairs."""
    docs = docs.combine_chunks()
    place = pairs.column("place").to_numpy()
    count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    count[place] = pairs.column("n").to_numpy()
    best[place] = pairs.column("best").cast(pa.int64()).to_numpy()
    lists, weights = (docs.column(c).combine_chunks() for c in ("places", "times"))
    own = lists.flatten().to_numpy(zero_copy_only=False)
    times = weights.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.append(0, np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)))
    sums = [np.append(0, np.cumsum(times * x[own])) for x in (best, count)]
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    for name, total in zip(("n_best", "count_sum"), sums, strict=True):
        out = out.append_column(name, pa.array(np.diff(total[ends]), pa.int64()))
    return out.append_column("groups_sha256", docs.column("groups_sha256"))


def _packed(docs: DataFrame, first_path: str, second_path: str, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    spark = docs.sparkSession
    with open(first_path, encoding="utf-8") as file, open(second_path, "rb") as model:
        spec = spark.sparkContext.broadcast({"first": file.read(), "second": model.read()})
    source = given(docs, doc_id=id_col, text=text_col)
    schema = _BLOCK.format(kind=source.schema["doc_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = next(batches, None)
        if head is None:
            return
        whole, small, many = pa.int64(), pa.int32(), pa.list_
        types = [whole, small, head.schema.field("doc_id").type, whole, whole, whole, whole, pa.string(), many(whole), many(small), many(small)]
        names = [c.split()[0] for c in schema.split(", ")]
        yield from _blocks(chain([head], batches), spec, block_bytes, pa.schema(list(zip(names, types, strict=True))))

    return cut(source.mapInArrow(run, schema))


def _pair_counts(packed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``block, place, code`` of every block, and ``code, n, best``: documents of each pair, and whether its A id has none with more."""
    blocks = packed.filter("part = 1")
    listed = blocks.select("block", F.posexplode(F.arrays_zip("codes", "times")).alias("place", "pair"))
    listed = listed.select("block", "place", F.col("pair.codes").alias("code"), F.col("pair.times").cast("long").alias("docs"))
    counts = cut(listed.groupBy("code").agg(F.sum("docs").alias("n")).withColumn("a", F.shiftright("code", 32)))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row per id of A's vocabulary
    marked = counts.join(most, "a").select("code", "n", (F.col("n") == F.col("most")).alias("best"))
    return listed.drop("docs"), marked


def linked_pairs(docs: DataFrame, first_path: str, second_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``a, b, n, best`` of every linked id pair: the documents that have it, and whether no pair of ``a`` has more."""
    _, marked = _pair_counts(_packed(docs, first_path, second_path, id_col, text_col, block_bytes))
    a, b = F.shiftright("code", 32).cast("int"), F.col("code").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    return marked.select(a.alias("a"), b.alias("b"), "n", "best")


def aligned_tokens(docs: DataFrame, first_path: str, second_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    A encodes space and text by the byte-level file at ``first_path``, B the text by the
    piece model at ``second_path``, both without special tokens. Where an A and a B token end
    at one byte, a group ends. A link is a pair of tokens whose bytes overlap; its count is
    the number of rows that have its ids linked, and it is a best one if no pair with its A
    id has a higher count. The digest is of ``a1,a2|b1;a3|b2,b3``.

    Texts that are null, empty or not spelled again by both tokenizers have no tokens: all
    numbers are 0 and the digest is empty. Rows are documents of their own: ids may repeat or
    be null. An empty table gives an empty result; other columns are ignored. The two
    vocabularies are broadcast, and at most the first one's size in rows of best counts.
    """
    packed = _packed(docs, first_path, second_path, id_col, text_col, block_bytes)
    listed, marked = _pair_counts(packed)
    met = listed.join(marked.hint("merge"), "code").select(F.col("block").alias("of"), "place", "n", "best")
    own = packed.filter("part = 0").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times")
    kind = own.schema["doc_id"].dataType.simpleString()
    figures = ", ".join(f"{c} bigint" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"))
    return (
        own.groupBy("block")
        .cogroup(met.groupBy("of"))
        .applyInArrow(_counted, f"doc_id {kind}, {figures}, groups_sha256 string")
    )


ship(pretokens, wordspans, sys.modules[__name__])
