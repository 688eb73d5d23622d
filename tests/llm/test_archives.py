"""WARC archives against hand-made expectations and a plain reader."""

import base64
import gzip
import hashlib

import pytest

from skein.llm.tables import fresh_path
from skein.llm.warc import archived_pages, parse, read_archives, resolve_revisits, write_archives

SCHEMA = "page_id bigint, url string, html string, record string, best string"
TRAP = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb"
PAGES = [
    (1, "http://a/", "same"),
    (2, "http://b/ x\r\nWARC-Type: bad", "same"),
    (9, "http://c/", "same"),
    (4, None, None),
    (3, "http://d/", ""),
    (5, "http://e/", TRAP),
    (6, "http://e/", TRAP),
    (7, "http://f/", "ünï " * 5000),
    (8, "http://g/", "twice"),
    (8, "http://g/", "twice"),
    (8, "http://h/", "twice"),
    (None, "http://i/", "nobody"),
    (None, "http://i/", "twice"),
    (10, "http://j/", "z"),
    (11, "http://j/", "z"),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(pages, min_bytes=0):
    out, groups = [], {}
    for i, u, h in pages:
        groups.setdefault(h or "", []).append((i is not None, i or 0, u is not None, u or ""))
    for html, rows in groups.items():
        size = len(html.encode())
        rows.sort(reverse=True)
        for k, row in enumerate(rows):
            later = k > 0 and size >= min_bytes
            best = str(rows[0][1]) if rows[0][0] else None
            out.append((str(row[1]) if row[0] else None, size, digest(html), "revisit" if later else "response", best if later else None))
    return sorted(out, key=str)


def written(spark, rows, path, **options):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    write_archives(df, path, **options)
    return archived_pages(read_archives(spark, path))


@pytest.mark.parametrize(("min_bytes", "compression"), [(0, "none"), (3, "gzip")])
def test_records_come_back(spark, min_bytes, compression):
    path = fresh_path(spark, "warc")
    found = written(spark, PAGES, path, min_bytes=min_bytes, compression=compression, archive_bytes=4000)
    got = found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == expected(PAGES, min_bytes)
    urls = {r.page_id: r.url for r in found.collect()}
    assert urls["2"] == "http://b/%20x%0D%0AWARC-Type:%20bad" and urls["4"] is None


def test_revisits_get_their_payloads_back(spark):
    path = fresh_path(spark, "warc")
    written(spark, PAGES, path)
    full = archived_pages(read_archives(spark, path, with_payload=True))
    got = sorted((r.page_id or "", r.payload.decode()) for r in full.collect())
    assert got == sorted(("" if i is None else str(i), h or "") for i, _, h in PAGES)


def test_files_are_archives(spark):
    path = fresh_path(spark, "warc")
    written(spark, PAGES, path)
    blocks = spark.read.format("binaryFile").load(path).collect()
    records = [r for b in blocks for r in parse(bytes(b.content))]
    assert len(records) == len(PAGES)
    ids = [f["warc-record-id"] for f, _ in records]
    assert len(set(ids)) == len(ids)
    assert {f["warc-refers-to"] for f, _ in records if f["warc-type"] == "revisit"} <= set(ids)
    assert all(b.endswith(b"\r\n\r\n") for f, b in records if f["warc-type"] == "revisit")


def test_archives_of_others(spark, tmp_path):
    """Compressed by record, other header spelling, a revisit that names no record, one without response, and other types."""
    body = b"HTTP/1.0 200 OK\r\n\r\npayload"
    told = "sha1:" + digest("payload")

    def record(kind, name, block, *more):
        head = ["WARC/1.0", f"WARC-TYPE: {kind}", f"warc-record-id: {name}", *more, f"content-length: {len(block)}"]
        return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    http = "content-type: application/http; msgtype=response"
    parts = [
        record("warcinfo", "<i>", b"software: x\r\n", "content-type: application/warc-fields"),
        record("response", "<r>", body, http, "WARC-Payload-Digest: " + told),
        record("revisit", "<v>", b"HTTP/1.0 200 OK\r\n\r\n", http, "WARC-Payload-Digest: " + told),
        record("revisit", "<w>", b"", "WARC-Payload-Digest: sha1:" + digest("gone")),
        record("resource", "<s>", b"as is", "WARC-Target-URI: file:/x", "folded: a", "  b"),
    ]
    (tmp_path / "one.warc.gz").write_bytes(b"".join(parts))
    records = read_archives(spark, str(tmp_path))
    found = {r.record_id: r for r in resolve_revisits(records).collect()}
    assert found["<v>"].original.record_id == "<r>" and found["<v>"].original.payload_bytes == 7
    assert found["<w>"].original is None and found["<s>"].payload_bytes == 5 and len(found) == 5
    (tmp_path / "one.warc.gz").write_bytes(parts[1].replace(b"payload", b"payload") + b"rubbish")
    bad = record("response", "<r>", body + b"!", http, "WARC-Payload-Digest: " + told)
    (tmp_path / "one.warc.gz").write_bytes(bad)
    with pytest.raises(Exception, match="does not fit its digest"):
        read_archives(spark, str(tmp_path)).collect()


def test_empty_table(spark):
    assert written(spark, [], fresh_path(spark, "warc")).collect() == []


def test_hot_payload_is_spread(spark):
    rows = [(i, f"http://p/{i}", "hot") for i in range(3000)] + [(5, "http://q/", "cold")]
    found = written(spark, rows, fresh_path(spark, "warc"))
    assert found.filter("record_type = 'revisit' AND refers_to = '2999'").count() == 2999
