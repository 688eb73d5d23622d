"""Token ids of documents in range-coded blocks, written and read with Spark.

Documents are range-partitioned by id, encoded, and gathered into blocks of about
``BLOCK_IDS`` ids that hold whole documents (a longer document is a block of its own). A
block is one row of a Parquet table (part, block, documents, ids, payload); its payload
stands alone: it is coded with a model that starts empty and ends in a checksum, see
:mod:`skein.llm.rangecoder`. Spark's committer makes the files whole, so lost executors and
retried tasks leave no half-written output, in any store that Spark writes to.
"""

from __future__ import annotations

import os
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm import pretokens, rangecoder
from skein.llm.tables import given, ship, split_count

BLOCK_IDS = 1 << 20


def _tokenizer(spec: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec)


def _splits_as_bytes(spec: str) -> bool:
    """Whether the tokenizer splits by the byte-level pattern and does nothing across pieces."""
    import json

    setup = json.loads(spec)
    split = setup.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    return bool(plain and not setup.get("normalizer"))


class _Encoder:
    """Ids of texts as the library gives them; each different piece is given to it once.

    Texts that hold the string of an added token go to the library whole.
    """

    def __init__(self, spec: str):
        self.tokenizer = _tokenizer(spec)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = pretokens.PieceIds(pretokens.LibraryPieces(self.tokenizer)) if _splits_as_bytes(spec) else None

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encoded = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        ids, sizes = pretokens.flattened([e.ids for e in encoded])
        return ids, np.append(0, np.cumsum(sizes))

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.pieces:
            return self._whole(texts)
        marked = [any(token in t for token in self.added) for t in texts]
        if not any(marked):
            return self.pieces.ids(texts)
        parts = [(self._whole if mark else self.pieces.ids)([t])[0] for t, mark in zip(texts, marked, strict=True)]
        return np.concatenate(parts).astype(np.uint32), np.cumsum([0, *map(len, parts)])


def _blocks(batches: Iterator[pa.RecordBatch], spec, end_id: int, block_ids: int) -> Iterator[pa.RecordBatch]:
    held_here = spec.value  # stays with the worker process, and so does the encoder's cache of pieces
    encoder = held_here.get("encoder") or _Encoder(held_here["spec"])
    held_here["encoder"] = encoder
    vocabulary = max(encoder.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
    part, block = TaskContext.get().partitionId(), 0
    keys: list[np.ndarray] = []
    known: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    ids: list[np.ndarray] = []

    def pack() -> pa.RecordBatch:
        all_sizes, all_ids = np.concatenate(sizes), np.concatenate(ids)
        payload = rangecoder.pack_block(np.concatenate(keys), np.concatenate(known), all_sizes, all_ids, vocabulary)
        row = [pa.array([part]), pa.array([block]), pa.array([len(all_sizes)]), pa.array([len(all_ids)]), pa.array([payload], pa.binary())]
        for held in (keys, known, sizes, ids):
            held.clear()
        return pa.RecordBatch.from_arrays(row, ["part", "block", "n_docs", "n_ids", "payload"])

    held = 0
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        key = batch.column("doc_id")
        for begin, end in pretokens.slices([len(t) for t in texts]):
            own, bounds = encoder.ids(texts[begin:end])
            closed = np.insert(own, bounds[1:], end_id)
            size = np.diff(bounds) + 1
            run = key.slice(begin, end - begin)
            keys.append(run.fill_null(0).to_numpy())
            known.append(run.is_valid().to_numpy(zero_copy_only=False))
            sizes.append(size)
            ids.append(closed)
            held += len(closed)
            if held >= block_ids:
                yield pack()
                block, held = block + 1, 0
    if sizes:
        yield pack()


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_ids: int = BLOCK_IDS,
) -> None:
    """Write the ids of every document, ``end_id`` after each, in ascending order of integer ids.

    Null and empty texts are only the end id. Null document ids come first; rows of equal
    id follow each other in a fixed order of their texts and stay separate documents. An
    empty table writes an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = spark.sparkContext.broadcast({"spec": file.read()})
    source = given(docs, doc_id=docs[id_col].cast("long"), text=F.coalesce(docs[text_col], F.lit("")))
    ordered = (
        source.withColumn("h", F.xxhash64("text"))
        .repartitionByRange(split_count(spark), "doc_id", "h")
        .sortWithinPartitions("doc_id", "h", "text")
        .select("doc_id", "text")
    )
    blocks = ordered.mapInArrow(
        lambda batches: _blocks(batches, spec, end_id, block_ids),
        "part bigint, block bigint, n_docs bigint, n_ids bigint, payload binary",
    )
    blocks.write.option("compression", "uncompressed").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch], with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, block, payload in zip(*(batch.column(c) for c in ("part", "block", "payload")), strict=True):
            keys, known, sizes, ids = rangecoder.unpack_block(payload.as_py())
            ends = np.cumsum(sizes)
            begins = ends - sizes
            raw = ids.astype("<u4")
            columns = {
                "part": pa.array(np.full(len(keys), part.as_py())),
                "block": pa.array(np.full(len(keys), block.as_py())),
                "doc_id": pa.array(keys, pa.int64(), mask=~known),
                "inside": pa.array(begins),
                "n_tokens": pa.array(sizes),
                "ids_crc32": pa.array([zlib.crc32(raw[a:b].tobytes()) for a, b in zip(begins, ends, strict=True)], pa.int64()),
            }
            if with_ids:
                bounds = np.append(begins, ends[-1:] if len(ends) else 0)
                columns["ids"] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of a token table: ``doc_id, start, n_tokens, ids_crc32`` and, on request, ``ids``.

    ``start`` counts the ids of all documents before this one. A block whose checksum does
    not fit ends the job with an error.
    """
    blocks = spark.read.parquet(path)
    schema = "part bigint, block bigint, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint"
    rows = blocks.select("part", "block", "payload").mapInArrow(
        lambda batches: _documents(batches, with_ids), schema + (", ids array<int>" if with_ids else "")
    )
    # Blocks are counted per part first; only one row per part meets in one place.
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("part", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("block_start"))
    starts = starts.join(parts, "part").select("part", "block", (F.col("part_start") + F.col("block_start")).alias("base"))
    out = ["doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"]
    return rows.join(starts, ["part", "block"]).select(*out, *(["ids"] if with_ids else []))


ship(pretokens, rangecoder, sys.modules[__name__])
