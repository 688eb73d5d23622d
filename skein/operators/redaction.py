"""Redaction of text for publication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Id patterns that are replaced, and the labels handed out per text.
ID_PATTERNS = (
    r"(?iU)\b[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}\b",
    r"(?U)\bPM-[AB]-\d{3}\b",
)
LABELS = ("PM-A-001", "PM-A-002", "PM-B-001", "PM-B-002")
LAST_LABEL = "PM-ANON"


def redact(
    text: Column | str,
    replacements: Sequence[tuple[str, str]] = (),
    patterns: Sequence[str] = ID_PATTERNS,
    labels: Sequence[str] = LABELS,
) -> Column:
    """Literal replacements in order, then ids to labels in order of appearance.

    Labels are used up across all patterns of one text; later ids share the last label.
    """
    out = F.col(text) if isinstance(text, str) else text
    for old, new in replacements:
        out = F.replace(out, F.lit(old), F.lit(new))
    names = F.array(*[F.lit(x) for x in labels])
    used = F.lit(0)
    for pattern in patterns:
        pieces = F.split(out, pattern)
        out = F.array_join(F.transform(pieces, _labeller(names, used)), "")
        used = used + F.size(pieces) - 1
    return out


def _labeller(names: Column, used: Column):
    """Put the next label before each piece that follows an id."""

    def label(piece: Column, i: Column) -> Column:
        nth = F.coalesce(F.get(names, used + i - 1), F.lit(LAST_LABEL))
        return F.when(i == 0, piece).otherwise(F.concat(nth, piece))

    return label


def redact_text(df: DataFrame, col: str = "text", **rules) -> DataFrame:
    return df.withColumn(col, redact(col, **rules))


def sensitive_terms(df: DataFrame, terms: Sequence[str], col: str = "text") -> DataFrame:
    """One row per (row, term) hit; lower-case terms match any case, others exactly."""
    def found(term: str) -> Column:
        body = F.lower(col) if term == term.lower() else F.col(col)
        return F.when(body.contains(term), F.lit(term))

    hits = F.array_compact(F.array(*[found(t) for t in terms]))
    return df.withColumn("term", F.explode(hits))


def redaction_drift(df: DataFrame, col: str = "text", **rules) -> DataFrame:
    """Rows whose text redaction would still change."""
    return df.filter(F.col(col) != redact(col, **rules))
