"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Every measure is a column expression over the whole text; rules are rows (name, measure,
comparison, bound, least number of words) and become one Boolean column each. Nothing is
shuffled and no user function runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.tables import WHITE_CLASS, given, words

WHITE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MARKS = "!?"
REPEAT_WINDOW = 5

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is that it for was on with as by be this are at from or an not have has but "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an "
    "de la le et les en un du une que pour est dans qui par sur pas au avec ne ce il "
    "el y los se las del con no su para al lo como más o pero sus"
).split()


@dataclass(frozen=True)
class Rule:
    """``measure`` must be at least ``low`` and at most ``high`` in texts of ``from_words`` words or more."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


#: Thresholds beyond the base rules; ratios are per word, per line or per character.
RULES = (
    Rule("word_length", "mean_word_chars", low=2.0, high=20.0),
    Rule("symbols", "symbols_per_word", high=0.1),
    Rule("marks", "marks_per_word", high=0.5),
    Rule("stop_words", "stop_word_ratio", low=0.02, from_words=50),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
)
BASE_RULES = (
    Rule("too_short", "n_words", low=10),
    Rule("repeated_words", "repeat_word_ratio", high=0.2),
)


def _repeats(hashes: Column, n: Column) -> Column:
    """Windows as (hash, position), in hash order, if any hash comes twice; else null."""
    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(pairs))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stop_words=STOP_WORDS) -> DataFrame:
    """Counts and ratios of every text; a null text has none of anything."""
    width = REPEAT_WINDOW
    base = given(docs, doc_id=id_col, text=F.coalesce(docs[text_col], F.lit("")))
    split = base.select(
        "doc_id",
        "text",
        words(F.col("text")).alias("w"),
        F.filter(F.split("text", "\n", -1), lambda x: F.length(F.translate(x, WHITE_CHARS, "")) > 0).alias("lines"),
    )
    hashed = split.select(
        "*",
        F.size("w").cast("long").alias("n_words"),
        F.when(
            F.size("w") >= width,
            F.transform(F.sequence(F.lit(1), F.size("w") - (width - 1)), lambda i: F.xxhash64(F.slice(F.col("w"), i, width))),
        ).alias("win"),
    )
    sorted_windows = hashed.select("*", _repeats(F.col("win"), F.col("n_words")).alias("s")).drop("win")
    places = sorted_windows.select(
        "*",
        F.sort_array(
            F.filter(
                F.transform(
                    "s",
                    lambda x, k: F.when(
                        (F.get("s", k - 1)["h"] == x["h"]) | (F.get("s", k + 1)["h"] == x["h"]), x["i"]
                    ),
                ),
                lambda i: i.isNotNull(),
            )
        ).alias("at"),
    ).drop("s")
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last")),
        lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(width), i - acc["last"])).alias("n"), i.alias("last")
        ),
        lambda acc: acc["n"],
    )
    bare = F.translate(F.lower("text"), ".,;:!?\"'()", "")
    stops = F.size(F.filter(F.split(bare, WHITE_CLASS), lambda x: x.isin(*stop_words)))
    counts = places.select(
        "doc_id",
        "n_words",
        F.length(F.translate("text", WHITE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        stops.cast("long").alias("n_stop_words"),
        (F.length("text") - F.length(F.translate("text", MARKS, ""))).cast("long").alias("n_marks"),
    )
    n, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return counts.select(
        "*",
        (F.col("word_chars") / n).alias("mean_word_chars"),
        (F.col("n_symbols") / n).alias("symbols_per_word"),
        (F.col("n_marks") / n).alias("marks_per_word"),
        (F.col("n_stop_words") / n).alias("stop_word_ratio"),
        (F.col("n_repeat_words") / n).alias("repeat_word_ratio"),
        (F.col("n_dup_lines") / lines).alias("dup_line_ratio"),
    )


def _broken(rule: Rule) -> Column:
    value = F.col(rule.measure)
    out = F.lit(False)
    if rule.low is not None:
        out = out | (value < F.lit(rule.low))
    if rule.high is not None:
        out = out | (value > F.lit(rule.high))
    return out & (F.col("n_words") >= rule.from_words) if rule.from_words else out


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, base_rules=BASE_RULES
) -> DataFrame:
    """Measures, the names of broken rules and the verdict of every row of ``docs``.

    Returns the columns of :func:`measures`, ``failed`` (names of broken rules, base rules
    first), ``base_failed`` and ``kept``. Null and empty texts have zero counts and fail the
    base rule on length. Ids may repeat or be null: every row is judged by its text alone.
    An empty table gives an empty result; other columns are ignored.
    """
    table = measures(docs, id_col, text_col)
    flags = {r.name: _broken(r) for r in (*base_rules, *rules)}
    base = F.lit(False)
    for r in base_rules:
        base = base | flags[r.name]
    failed = F.array_compact(F.array(*[F.when(flag, F.lit(name)) for name, flag in flags.items()]))
    return table.select("*", failed.alias("failed"), base.alias("base_failed")).withColumn(
        "kept", F.size("failed") == 0
    )
