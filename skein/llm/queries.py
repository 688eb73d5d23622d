"""One query per operator over its whole table, next to its DuckDB twin where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from skein.llm.alignment import aligned_tokens
from skein.llm.bpe import bpe_digests
from skein.llm.catalog import ORACLES, QUERIES, query
from skein.llm.divergence import source_divergence
from skein.llm.exactdup import exact_groups
from skein.llm.htmltext import extract_text
from skein.llm.neardup import near_groups
from skein.llm.packing import best_fit_bins
from skein.llm.quality import STOP_WORDS, quality_rules
from skein.llm.substring import repeated_passages
from skein.llm.tables import documents, fresh_path, read, words
from skein.llm.tokenbin import read_tokens, write_tokens
from skein.llm.toxicity import fit_toxicity, score_toxicity
from skein.llm.urls import judge_urls
from skein.llm.warc import archived_pages, read_archives, write_archives

__all__ = ["ORACLES", "QUERIES"]

OP1 = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, ws[i:i + 12] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
later AS (SELECT doc_id, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY g) < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM later),
every AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM every ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


@query("op1_substring_dedup", OP1)
def op1(spark, sf):
    return repeated_passages(documents(spark, sf)).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP2 = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 85 * (a.n + b.n - common)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""


@query("op2_minhash_dedup", OP2)
def op2(spark, sf):
    return near_groups(documents(spark, sf), shingle_words=3, percent=85, rows=3, tables=10)


OP3 = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


@query("op3_exact_dedup", OP3)
def op3(spark, sf):
    return exact_groups(documents(spark, sf), keep="largest")


_STOP = ", ".join("'" + w + "'" for w in dict.fromkeys(STOP_WORDS))
OP9 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
c AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_marks,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
    len(list_filter(string_split_regex(translate(lower(t), '.,;:!?"''()', ''), '[\\x20\\x09-\\x0D]+'), lambda x: x IN ({_STOP}))) AS n_stop
  FROM d),
m AS (SELECT c.*, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    greatest(n_words, 1) AS nw FROM c LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2.0 * nw OR word_chars > 20.0 * nw OR n_symbols / nw > 0.1 OR n_marks / nw > 0.5
    OR (n_words >= 50 AND n_stop / nw < 0.02) OR n_dup_lines / greatest(len(lines), 1) > 0.5) AS kept
FROM b
"""


@query("op9_quality_rules", OP9)
def op9(spark, sf):
    judged = quality_rules(documents(spark, sf))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


BIN_WORDS = 2048


@query("op4_best_fit_packing")
def op4(spark, sf):
    size = F.size(words(F.coalesce(F.col("text"), F.lit(""))))
    same_text = F.xxhash64(F.lower("text"))
    return best_fit_bins(documents(spark, sf), size, BIN_WORDS, cluster=same_text)


@query("op5_token_output")
def op5(spark, sf):
    path = fresh_path(spark, "tokens")
    write_tokens(documents(spark, sf), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_tokens(spark, path)


@query("op10_byte_bpe")
def op10(spark, sf):
    return bpe_digests(documents(spark, sf), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query("op6_html_text")
def op6(spark, sf):
    return extract_text(read(spark, sf, "pages"))


TOXIC_AT = 0.3


@query("op7_toxicity")
def op7(spark, sf):
    docs, labels = documents(spark, sf), read(spark, sf, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    fit = fit_toxicity(docs, labels.filter(~held_out))
    return score_toxicity(docs, fit).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


@query("op8_url_filter")
def op8(spark, sf):
    return judge_urls(read(spark, sf, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP11 = """
WITH h AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS d FROM pages),
b AS (SELECT page_id, t, list_transform(range(0, 8), lambda i: CAST('0x' || d[5 * i + 1:5 * i + 5] AS BIGINT)) AS g FROM h),
p AS (SELECT page_id, t, list_transform(range(0, 32), lambda j: ((g[j // 4 + 1] >> (15 - 5 * (j % 4))) & 31) + 1) AS n FROM b)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(n, lambda x: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[x]), '') AS payload_digest,
  CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
FROM p WINDOW w AS (PARTITION BY t)
"""


@query("op11_warc_revisits", OP11)
def op11(spark, sf):
    pages, path = read(spark, sf, "pages"), fresh_path(spark, "warc")
    write_archives(pages, path, min_bytes=0)
    kind = pages.schema["page_id"].dataType
    found = archived_pages(read_archives(spark, path))
    return found.select(
        F.col("page_id").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


@query("op12_token_alignment")
def op12(spark, sf):
    first, second = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return aligned_tokens(documents(spark, sf), first, second)


OP13 = """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
w AS (SELECT lang, source, r, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, count(*) AS nl FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(nl)::HUGEINT AS m FROM k GROUP BY lang),
t AS (SELECT lang, source, sum(n)::HUGEINT AS m FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(t.m, 0) + 2 * v.v) AS p,
    1 + 1000000000::HUGEINT * (k.nl + 2) // (v.m + 2 * v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
y AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM y WHERE part = 'pair' OR rank <= 10
"""


@query("op13_source_divergence", OP13)
def op13(spark, sf):
    return source_divergence(documents(spark, sf), min_docs=10, top_terms=10)
