"""WARC archives without repeated payloads.

Headers (id, digest, size) are shuffled by payload digest; of records with equal payloads
one stays a response, the others become revisits that name it. Only the payloads of
responses travel, once, to be written; revisits are written from headers alone. Archives
are written by Spark's text writer with the record end of the format as line separator, so
its committer keeps them whole in any store. The reader parses whole archives by their
content lengths and checks payload digests; revisits then meet their responses in a join.

A digest that a third of all records share is met once per salt and not once per record:
heads fold per (digest, salt) first, and lookups go through the different (key, salt).
"""

from __future__ import annotations

import base64
import hashlib
import sys
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.tables import cut, freed, given, ship, split_count

ARCHIVE_BYTES = 32 << 20
#: Room for the headers of a record, for the size of archives.
HEADER_BYTES = 700
#: Format version, profile of revisits, record end.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LINE = "\r\n"
RECORD_END = "\r\n\r\n"
#: Digits of numbers to the base 32 and of the base32 encoding.
BASE32_FROM, BASE32_TO = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

SCHEMA = (
    "record_id string, warc_type string, page_id string, target_uri string, payload_digest string, "
    "refers_to_id string, payload_bytes bigint"
)


def base32_sha1(value: Column) -> Column:
    """SHA-1 in base32; 20 bits at a time become four digits."""
    digits = F.sha1(value)
    parts = [F.lpad(F.conv(F.substring(digits, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), BASE32_FROM, BASE32_TO)


def _uuid(*parts: Column) -> Column:
    """Record id that a repeated run makes again."""
    h = F.md5(F.concat(*[F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts]))
    pieces = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def _text(c: Column | str) -> Column:
    """Null-safe text of a header value: null and empty differ."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull(), "-").otherwise(F.concat(F.lit("+"), c.cast("string")))


def _met(left: DataFrame, right: DataFrame, key: str, spread: Column) -> DataFrame:
    """``left`` with the columns of ``right``, which has each ``key`` once; a key may be hot in ``left``."""
    salted = left.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(split_count(left.sparkSession))).cast("int"))
    found = salted.select(key, "salt").distinct().join(right, key)
    return salted.join(found.hint("merge"), [key, "salt"], "left").drop("salt")


def _keyed(pages: DataFrame) -> tuple[DataFrame, list[str]]:
    """Pages with a key of (id, url, payload) and what marks equal payloads; and the columns of a head."""
    body = F.encode("html", "UTF-8")
    columns = ["key", "same", "page_id", "url", "digest", "size"]
    digest, size = base32_sha1(body), F.octet_length(body).cast("long")
    same = F.concat_ws(":", digest, F.xxhash64("html").cast("string"), size.cast("string"))
    return pages.select(
        F.unhex(F.sha2(F.concat_ws("\n", same, _text("page_id"), _text("url")), 256)).alias("key"),
        same.alias("same"),
        "page_id",
        "url",
        digest.alias("digest"),
        size.alias("size"),
        "html",
    ), columns


def _decided(heads: DataFrame, min_bytes: int) -> DataFrame:
    """Heads with the page of their payload's response; null ids come last in the choice."""
    page = F.struct("page_id", "url", "key")
    salt = F.pmod(F.xxhash64("key"), F.lit(split_count(heads.sparkSession))).cast("int")
    runs = heads.filter(F.col("size") >= min_bytes).groupBy("same", salt.alias("salt")).agg(F.max(page).alias("best"))
    best = runs.groupBy("same").agg(F.max("best").alias("best"))
    return _met(heads, best, "same", F.col("key"))


def _record(kind: Column, page_id: Column, url: Column, digest: Column, copy: Column, refers: Column, refers_url: Column, date: str, http: Column, body: Column) -> Column:
    """Text of a record without its end; values that could break a header line are percent-encoded."""

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(LINE)), F.lit(""))

    def uri(c: Column) -> Column:
        for bad, code in (("\r", "%0D"), ("\n", "%0A"), ("\t", "%09"), (" ", "%20")):
            c = F.replace(c, F.lit(bad), F.lit(code))
        return c

    block = F.concat(http, F.lit(LINE), body)
    return F.concat(
        F.lit(VERSION + LINE),
        line("WARC-Type", kind),
        line("WARC-Record-ID", _uuid(_text(page_id), _text(url), digest, copy.cast("string"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri(url)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        line("WARC-Profile", F.when(kind == "revisit", PROFILE)),
        line("WARC-Refers-To", refers),
        line("WARC-Refers-To-Target-URI", F.when(refers.isNotNull(), uri(refers_url))),
        line("WARC-Page-ID", F.url_encode(page_id.cast("string"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(LINE),
        block,
    )


def write_archives(
    pages: DataFrame,
    path: str,
    min_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
    date: str = "2000-01-01T00:00:00Z",
    compression: str = "none",
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> None:
    """Write a WARC record per row; of equal payloads of ``min_bytes`` or more, one is a response.

    The response is the row with the largest id, of these the largest url; the others are
    revisits. Smaller payloads are all responses. A null payload is an empty one. Rows alike
    in id, url and payload are records of their own: one may be the response, the others
    revisit it. A null id has no id header and counts as less than all others, a null url
    has no target. An empty table writes an empty archive; other columns are ignored.
    Archives hold about ``archive_bytes``, or one larger record.
    """
    pages = given(pages, page_id=id_col, url=url_col, html=F.coalesce(pages[html_col], F.lit("")))
    keyed, columns = _keyed(pages)
    heads = cut(keyed.groupBy(*columns).agg(F.count("*").alias("n")))
    decided = cut(_decided(heads, min_bytes))

    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "),
        F.col("size").cast("string"),
        F.lit(LINE),
    )

    def records(rows: DataFrame, revisit: bool) -> DataFrame:
        best = F.col("best")
        refers = _uuid(_text(best["page_id"]), _text(best["url"]), F.col("digest"), F.lit("1")) if revisit else F.lit(None).cast("string")
        return rows.select(
            _record(
                F.lit("revisit" if revisit else "response"),
                F.col("page_id"),
                F.col("url"),
                F.col("digest"),
                F.col("copy"),
                refers,
                best["url"] if revisit else F.lit(None).cast("string"),
                date,
                http,
                F.lit("") if revisit else F.col("html"),
            ).alias("record")
        )

    stays = F.col("best").isNull() | (F.col("best.key") == F.col("key"))
    # Repeated rows fold before their payloads are shuffled.
    payloads = keyed.select("key", "html").dropDuplicates(["key"])
    first = F.when(F.col("best").isNull(), F.col("n")).otherwise(1)
    responses = decided.filter(stays).hint("merge").join(payloads, "key").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), first)))
    later = decided.filter(F.col("best").isNotNull() & (~stays | (F.col("n") > 1)))
    later = later.withColumn("copy", F.explode(F.sequence(F.when(stays, 2).otherwise(1).cast("long"), F.col("n"))))
    later = later.repartition(split_count(pages.sparkSession), "key", "copy")

    written = records(responses, False).unionByName(records(later, True))
    mean = decided.filter(stays).agg(F.avg("size")).first()[0] or 0
    writer = written.write.option("lineSep", RECORD_END).option("compression", compression)
    with freed(pages.sparkSession):
        writer.option("maxRecordsPerFile", max(1, int(archive_bytes / (mean + HEADER_BYTES)))).text(path)


def _members(content: bytes) -> bytes:
    """Archive without its compression, be it one gzip stream or one per record."""
    out = []
    while content[:2] == b"\x1f\x8b":
        stream = zlib.decompressobj(31)
        out.append(stream.decompress(content))
        content = stream.unused_data
    return b"".join(out) if out else content


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of every record."""
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if end < 0:
            if content[at:].strip(b"\r\n"):
                raise ValueError("archive ends inside a header")
            return
        lines = content[at:end].decode().lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {}
        name = None
        for text in lines[1:]:
            if text[:1] in " \t" and name:
                fields[name] += " " + text.strip()
                continue
            name, _, value = text.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
        begin = end + 4
        at = begin + int(fields["content-length"])
        if at > len(content):
            raise ValueError("archive ends inside a block")
        yield fields, content[begin:at]
        at += 4


def _payload(fields: dict[str, str], block: bytes) -> bytes:
    if fields.get("content-type", "").startswith("application/http"):
        head, mark, body = block.partition(b"\r\n\r\n")
        return body if mark else b""
    return block


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    from urllib.parse import unquote_plus

    names = ["record_id", "warc_type", "page_id", "target_uri", "payload_digest", "refers_to_id", "payload_bytes"]
    kinds = [pa.string()] * 6 + [pa.int64()]
    if with_payload:
        names, kinds = [*names, "payload"], [*kinds, pa.binary()]
    for batch in batches:
        for i in range(batch.num_rows):
            rows, held = [], 0
            for fields, block in parse(_members(batch.column("content")[i].as_py())):
                kind = fields.get("warc-type", "")
                revisit = kind == "revisit"
                payload = None if revisit else _payload(fields, block)
                told = fields.get("warc-payload-digest")
                digest = told.partition(":")[2] if told and told.lower().startswith("sha1:") else None
                if payload is not None:
                    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if digest not in (None, own):
                        raise ValueError(f"payload of {fields.get('warc-record-id')} does not fit its digest")
                    digest = own
                page = fields.get("warc-page-id")
                size = None if payload is None else len(payload)
                row = (fields.get("warc-record-id"), kind, page if page is None else unquote_plus(page), fields.get("warc-target-uri"), digest, fields.get("warc-refers-to"), size)
                rows.append((*row, payload) if with_payload else row)
                held += (size or 0) if with_payload else 0
                if held > 8 << 20 or len(rows) == 20_000:
                    yield _batch(rows, names, kinds)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, names, kinds)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Records of the archives at ``path``: ids, type, target, digest, ``payload_bytes`` and, on request, ``payload``.

    Plain and gzip archives are read, whole or compressed by record. Revisits have no
    payload (null). A payload that does not fit its digest, or a broken record, ends the job
    with an error. An empty folder of archives gives an empty result.
    """
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("content")
    return files.mapInArrow(lambda batches: _read(batches, with_payload), SCHEMA + (", payload binary" if with_payload else ""))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records with the response of each revisit: ``original`` has its page id, size and, if read, payload.

    A revisit finds its response by the record it names, or by digest where it names none or
    one that is not there; of several responses with the digest, the one with the largest
    record id. A revisit without any response has a null ``original``, and so have responses.
    """
    extra = ["payload"] if "payload" in records.columns else []
    found = F.struct("record_id", "page_id", "payload_bytes", *extra)
    answers = records.filter("warc_type = 'response'").select("record_id", "payload_digest", found.alias("original"))
    by_id = answers.select(F.col("record_id").alias("meet"), "original").dropDuplicates(["meet"])
    one = answers.groupBy("payload_digest").agg(F.max("record_id").alias("record_id")).filter("payload_digest IS NOT NULL")
    revisits = records.withColumn("named", F.when(F.col("warc_type") == "revisit", F.col("refers_to_id")))
    named = _met(revisits.withColumnRenamed("named", "meet"), by_id, "meet", F.coalesce("record_id", F.lit(""))).drop("meet")
    done = named.filter(F.col("original").isNotNull() | (F.col("warc_type") != "revisit"))
    rest = named.filter(F.col("original").isNull() & (F.col("warc_type") == "revisit")).drop("original")
    by_digest = one.select(F.col("payload_digest").alias("meet"), F.col("record_id").alias("named"))
    rest = _met(rest.withColumn("meet", F.col("payload_digest")), by_digest, "meet", F.coalesce("record_id", F.lit(""))).drop("meet")
    rest = _met(rest.withColumnRenamed("named", "meet"), by_id, "meet", F.coalesce("record_id", F.lit(""))).drop("meet")
    return done.unionByName(rest)


def archived_pages(records: DataFrame) -> DataFrame:
    """Responses and revisits as ``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` (and ``payload``)."""
    met = resolve_revisits(cut(records)).filter("warc_type IN ('response', 'revisit')")
    original = F.col("original")
    full = [F.coalesce("payload", original["payload"]).alias("payload")] if "payload" in records.columns else []
    return met.select(
        "page_id",
        F.col("target_uri").alias("url"),
        F.coalesce("payload_bytes", original["payload_bytes"]).alias("payload_bytes"),
        "payload_digest",
        F.col("warc_type").alias("record_type"),
        F.when(F.col("warc_type") == "revisit", original["page_id"]).alias("refers_to"),
        *full,
    )


ship(sys.modules[__name__])
