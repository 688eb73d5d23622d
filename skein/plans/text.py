"""Queries on redaction and on text payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import columns as X
from skein.operators import redaction as T
from skein.plans.catalog import query
from skein.plans.views import table

REPLACEMENTS = (("license", "terms"), ("the ", "THE "), ("@", " at "))
NUMBERS = (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", r"\b[0-9]{4}\b")
TERMS = ("license", "Copyright", "@", "key", "The")


def _with_ids(spark, sf):
    """Documents followed by ids derived from their number."""
    i = F.col("doc_id")
    uid = F.concat(
        F.lit(" 0a1b2c3d-0000-4000-8000-"), F.lpad(F.hex(i), 12, "0"), F.lit(" ")
    )
    return table(spark, sf, "documents").select(
        "doc_id",
        F.concat("text", F.repeat(uid, (i % 7).cast("int")), F.lit(" PM-A-00"), (i % 10).cast("string")).alias("text"),
    )


# With n ids (n = doc_id % 7) the labels run A-001, A-002, B-001, B-002, then the last one;
# the second pattern meets those labels and the trailing id again and goes on counting.
IDS = """
lab AS (SELECT doc_id, text, doc_id % 7 AS n, ['PM-A-001', 'PM-A-002', 'PM-B-001', 'PM-B-002'] AS l FROM documents),
seq AS (SELECT doc_id, text, n, l, range(0, n) AS r, least(n, 4) AS m FROM lab),
-- The blank that follows the text belongs to the phrases that are replaced.
rd AS (SELECT doc_id, replace(replace(replace(text || ' ', 'license', 'terms'), 'the ', 'THE '), '@', ' at ')
  || array_to_string(list_transform(r, lambda i: CASE WHEN i < 4 THEN coalesce(l[n + i + 1], 'PM-ANON') ELSE 'PM-ANON' END || '  '), '')
  || coalesce(l[n + m + 1], 'PM-ANON') AS redacted FROM seq)
"""


@query("redact_text", f"WITH {IDS} SELECT doc_id, redacted AS text FROM rd")
def redact_text(spark, sf):
    return T.redact_text(_with_ids(spark, sf), replacements=REPLACEMENTS)


@query(
    "sensitive_terms",
    """SELECT doc_id, term FROM documents, (SELECT unnest(['license', 'Copyright', '@', 'key', 'The']) AS term)
WHERE CASE WHEN term = lower(term) THEN contains(lower(text), term) ELSE contains(text, term) END""",
)
def sensitive_terms(spark, sf):
    return T.sensitive_terms(table(spark, sf, "documents"), TERMS).select("doc_id", "term")


@query(
    "redaction_drift",
    """SELECT doc_id FROM documents WHERE contains(text, 'license') OR contains(text, 'the ') OR contains(text, '@')
OR regexp_matches(text, '\\b[0-9]{3}-[0-9]{2}-[0-9]{4}\\b')""",
)
def redaction_drift(spark, sf):
    docs = table(spark, sf, "documents")
    return T.redaction_drift(docs, replacements=REPLACEMENTS, patterns=NUMBERS[:1]).select("doc_id")


@query(
    "safe_serialize",
    """SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '...' ELSE text END AS text FROM documents""",
)
def safe_serialize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.safe_serialize("text").alias("text"))


@query(
    "fingerprint_dups",
    """SELECT count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY lang, source,
CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '...' ELSE text END HAVING count(*) > 1""",
)
def fingerprint_dups(spark, sf):
    """Documents as events: copies found by content fingerprint."""
    as_events = table(spark, sf, "documents").select(
        "doc_id",
        F.lit("2024-01-01T00:00:00").alias("timestamp"),
        F.lit("tool_call").alias("event_type"),
        F.col("source").alias("tool_name"),
        F.col("lang").alias("agent"),
        F.lit(None).cast("string").alias("model"),
        F.lit(None).cast("string").alias("provider"),
        F.col("text").alias("tool_input"),
        F.lit(None).cast("string").alias("tool_output"),
    )
    return (
        as_events.groupBy(X.fingerprint().alias("fp"))
        .agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))
        .filter("copies > 1")
        .drop("fp")
    )


@query(
    "valid_session_ids",
    """SELECT source, count(*) AS docs, count(*) FILTER (regexp_full_match(coalesce(split_part(text, ' ', 1), ''), '[a-zA-Z0-9_.-]+')) AS valid
FROM documents GROUP BY 1""",
)
def valid_session_ids(spark, sf):
    first = F.split_part("text", F.lit(" "), F.lit(1))
    return (
        table(spark, sf, "documents")
        .groupBy("source")
        .agg(F.count("*").alias("docs"), F.count_if(X.valid_session_id(first)).alias("valid"))
    )
