"""Column expressions shared by the operators. Everything here stays JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREVIEW_KEYS = ("command", "file_path", "url", "pattern", "query")

FINGERPRINT_FIELDS = (
    "timestamp",
    "event_type",
    "tool_name",
    "agent",
    "model",
    "provider",
)


def parse_parents(col: Column | str) -> Column:
    """Comma-separated parent ids as a trimmed array without blanks."""
    col = F.col(col) if isinstance(col, str) else col
    parts = F.transform(F.split(F.coalesce(col, F.lit("")), ","), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def safe_serialize(col: Column | str, limit: int = 2000) -> Column:
    """Long text is cut at ``limit`` characters and marked with dots."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(
        F.length(col) > limit, F.concat(F.substring(col, 1, limit), F.lit("..."))
    ).otherwise(col)


def fingerprint(input_col: str = "tool_input", output_col: str = "tool_output") -> Column:
    """Content digest of an event that ignores event and parent ids."""
    fields = [F.coalesce(F.col(f), F.lit("\u0000")) for f in FINGERPRINT_FIELDS]
    fields += [
        F.coalesce(safe_serialize(input_col), F.lit("\u0000")),
        F.coalesce(safe_serialize(output_col), F.lit("\u0000")),
    ]
    return F.sha2(F.concat_ws("\u001f", *fields), 256)


def input_preview(col: Column | str, width: int = 80) -> Column:
    """First of the well-known argument keys as ``key=value``, else the raw text."""
    col = F.col(col) if isinstance(col, str) else col
    picks = []
    for key in PREVIEW_KEYS:
        value = F.get_json_object(col, f"$.{key}")
        picks.append(F.when(value.isNotNull(), F.concat(F.lit(f"{key}="), F.substring(value, 1, width))))
    return F.coalesce(*picks, F.substring(col, 1, width))


def valid_session_id(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col.rlike("^[a-zA-Z0-9_.-]+$"), F.lit(False))


def is_empty(name: str, dtype: str = "string") -> Column:
    """Null, blank text or empty array. ``False`` and zero are values."""
    col = F.col(name)
    if dtype == "string":
        return col.isNull() | (col == "")
    if dtype.startswith("array"):
        return col.isNull() | (F.size(col) == 0)
    return col.isNull()


def iso_timestamp(col: Column | str) -> Column:
    """ISO-8601 text to a timestamp, null when it does not parse."""
    col = F.col(col) if isinstance(col, str) else col
    return F.try_to_timestamp(col)


def seconds(col: Column | str) -> Column:
    """Timestamp as fractional epoch seconds."""
    col = F.col(col) if isinstance(col, str) else col
    return F.unix_micros(col) / F.lit(1e6)


def epoch_to_iso(col: Column) -> Column:
    """Epoch number in s, ms or us (told apart by magnitude) to ISO text."""
    secs = (
        F.when(col > 1e14, col / 1e6).when(col > 1e11, col / 1e3).otherwise(col)
    )
    return F.date_format(
        F.timestamp_micros(F.round(secs * 1e6).cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    )
