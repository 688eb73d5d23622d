"""URL filter: rules first, then naive Bayes over segmented host and path tokens.

Host labels are split into words by a unigram Viterbi search. Its word counts come from the
pages themselves: words of their text, and parts of host labels that are already set apart
by hyphens or digits. Counts meet the substrings of different labels in a join, so no
dictionary is broadcast. Labels and hosts are handled once each, however many pages they own.

The naive Bayes model learns from weak labels of hosts, by their segmented words: those with a
known word of unwanted sites against those without. Hosts in which such a word is only part
of a longer one are uncertain and teach nothing. Each host counts once, with the different
tokens of its paths, however many pages it owns. Tokens are hashed to a vector of fixed size, which is
all that is broadcast.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.tables import cut, given, ship

#: Words that mark unwanted hosts for the weak labels.
SPAM_WORDS = (
    "ads adserver adult adults bets betting bingo cams casino casinos cialis escort gambling hacked jackpot "
    "keygen lottery nude payday pills poker porn porno roulette sex "
    "slots spam sweepstakes torrent tracker trackers viagra warez webcam xanax xxx"
).split()
LONGEST_WORD = 24
BUCKETS = 1 << 18
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of an address; both empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """``rule, verdict`` of the longest fitting rule, or null; rules are (``host/path``, verdict)."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for text, verdict in sorted(rules, key=lambda r: (len(r[0]), len(r[0].partition("/")[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def best_split(word: str, starts, sizes, counts, total: float) -> list[str]:
    """Most probable words of ``word``; an unknown piece of n letters has probability 10 / (total 10^n)."""
    known: dict[int, list[tuple[int, float]]] = {}
    for s, n, c in zip(starts, sizes, counts, strict=True):
        known.setdefault(s + n, []).append((s, log(c / total)))
    best, back = [0.0], [0]
    for end in range(1, len(word) + 1):
        options = [(best[s] + p, s) for s, p in known.get(end, ())]
        options += [(best[s] + log(10.0) - log(total) - (end - s) * log(10.0), s) for s in range(max(0, end - LONGEST_WORD), end)]
        score, start = max(options)
        best.append(score)
        back.append(start)
    out, end = [], len(word)
    while end:
        out.append(word[back[end] : end])
        end = back[end]
    return out[::-1]


def _split_all(frames: Iterator[pd.DataFrame], total: float) -> Iterator[pd.DataFrame]:
    for frame in frames:
        words = [
            best_split(r.piece, [f["at"] for f in r.found], [f["size"] for f in r.found], [f["n"] for f in r.found], total)
            for r in frame.itertuples()
        ]
        yield pd.DataFrame({"piece": frame["piece"], "words": words})


def _tags_off(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<[^>]*>", " ")


def word_counts(text: Column, pages: DataFrame) -> DataFrame:
    """``word, n`` over all pages: runs of a-z of the lowered text."""
    return (
        pages.select(F.explode(F.split(F.lower(text), r"[^a-z]+")).alias("word"))
        .filter((F.length("word") > 0) & (F.length("word") <= LONGEST_WORD))
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )


def segment_hosts(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """``host, words`` for each different host of ``hosts(host)``, by the counts ``words(word, n)``.

    Pieces of a host are its runs of a-z; each is split on its own, the words follow each
    other. A host without such a run has no words.
    """
    spread = hosts.select("host").distinct().select("host", F.posexplode(F.split("host", r"[^a-z]+")).alias("pos", "piece"))
    spread = cut(spread.filter("piece <> ''"))
    pieces = spread.select("piece").distinct()
    size = F.length("piece")
    cuts = pieces.select("piece", F.explode(F.sequence(F.lit(1), size)).alias("at")).select(
        "piece", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), size - F.col("at") + 1))).alias("size")
    )
    cuts = cuts.withColumn("word", F.substring("piece", F.col("at"), F.col("size")))
    total = float(words.agg(F.sum("n")).first()[0] or 0) + 1.0
    found = cuts.join(words, "word").groupBy("piece").agg(
        F.collect_list(F.struct((F.col("at") - 1).alias("at"), "size", F.col("n").cast("double").alias("n"))).alias("found")
    )
    found = pieces.join(found, "piece", "left").select("piece", F.coalesce("found", F.expr("CAST(array() AS array<struct<at:int,size:int,n:double>>)")).alias("found"))
    split = found.mapInPandas(lambda frames: _split_all(frames, total), "piece string, words array<string>")
    return (
        spread.join(split, "piece")
        .groupBy("host")
        .agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "words"))), lambda x: x["words"])).alias("words"))
    )


def path_tokens(path: Column) -> Column:
    """Runs of letters of the lowered path, and one token for each run of digits."""
    return F.filter(F.split(F.regexp_replace(F.lower(path), r"[0-9]+", " 0 "), r"[^a-z0]+"), lambda x: x != "")


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def fit_weights(counts: DataFrame, block_share: float, smoothing: float = 0.5) -> tuple[np.ndarray, float]:
    """Log-odds of each token bucket and the prior, from ``bucket, blocked, n``; at most 2 BUCKETS rows arrive here."""
    seen = np.zeros((2, BUCKETS))
    rows = counts.toPandas()
    np.add.at(seen, (rows["blocked"].astype(int).to_numpy(), rows["bucket"].to_numpy()), rows["n"].to_numpy())
    kinds = max(1, int((seen.sum(axis=0) > 0).sum()))
    odds = np.log((seen + smoothing) / (seen.sum(axis=1, keepdims=True) + smoothing * kinds))
    share = min(max(block_share, 1e-6), 1 - 1e-6)
    return (odds[1] - odds[0]).astype(np.float32), log(share / (1 - share))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = (),
    id_col: str = "page_id",
    url_col: str = "url",
    text_col: str | None = "html",
    spam_words: Sequence[str] = tuple(SPAM_WORDS),
    threshold: float = 0.0,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, host_words, score`` of every row.

    The verdict is the longest fitting rule's; where none fits, ``block`` if the log-odds
    ``score`` is above ``threshold``. Null addresses and addresses without ``://`` have an
    empty host and path and only the prior as score, so they are allowed unless most hosts
    are spam. Ids and addresses may repeat or be null; an empty table gives an empty
    result; other columns are ignored.
    """
    text = F.col("text") if text_col else F.lit("")
    source = given(pages, page_id=id_col, url=url_col, **({"text": text_col} if text_col else {}))
    host, path = url_parts(F.col("url"))
    parts = source.select("page_id", host.alias("host"), path.alias("path"))
    set_apart = source.select(host.alias("host")).select(
        F.explode(F.split(F.array_join(F.filter(F.split("host", r"\."), lambda x: x.rlike("[^a-z]")), " "), "[^a-z]+")).alias("word")
    )
    counted = word_counts(_tags_off(text), source.filter(text.isNotNull()))
    known = counted.union(set_apart.filter("word <> ''").groupBy("word").agg(F.count("*").alias("n")))
    words = cut(known.groupBy("word").agg(F.sum("n").alias("n")))

    per_host = parts.select("host").distinct()
    split = segment_hosts(per_host, words)
    hosts = per_host.join(split, "host", "left").select(
        "host", F.coalesce("words", F.expr("CAST(array() AS array<string>)")).alias("words")
    )
    named = F.arrays_overlap("words", F.array(*map(F.lit, spam_words)))
    hidden = F.lit(False)
    for word in spam_words:
        hidden = hidden | F.contains("host", F.lit(word))
    hosts = cut(hosts.select("host", "words", F.when(named, True).when(~hidden, False).alias("blocked")))

    labelled = hosts.filter("blocked IS NOT NULL")
    on_paths = parts.select("host", F.explode(F.transform(path_tokens(F.col("path")), lambda x: F.concat(F.lit("/"), x))).alias("token"))
    on_paths = on_paths.distinct().join(labelled.select("host", "blocked"), "host").select("blocked", "token")
    tokens = labelled.select("blocked", F.explode(F.array_distinct("words")).alias("token")).union(on_paths)
    counts = tokens.groupBy(_bucket(F.col("token")).alias("bucket"), "blocked").agg(F.count("*").alias("n"))
    totals = labelled.agg(F.count_if("blocked"), F.count("*")).first()
    weights, prior = fit_weights(counts, (totals[0] or 0) / max(1, totals[1] or 0))
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def log_odds(buckets: pd.Series) -> pd.Series:
        sizes = buckets.map(len).to_numpy()
        flat = np.concatenate(buckets.to_list()).astype(np.int64) if sizes.sum() else np.zeros(0, dtype=np.int64)
        return pd.Series(np.bincount(np.repeat(np.arange(len(sizes)), sizes), shared.value[flat], minlength=len(sizes)))

    by_host = hosts.select("host", F.col("words").alias("host_words"), log_odds(F.transform("words", _bucket)).alias("host_score"))
    slashed = F.transform(path_tokens(F.col("path")), lambda x: _bucket(F.concat(F.lit("/"), x)))
    scored = parts.select("*", log_odds(slashed).alias("path_score")).join(by_host, "host")
    score = F.lit(prior) + F.col("host_score") + F.col("path_score")
    judged = scored.select("*", score.alias("score"), rule_of(F.col("host"), F.col("path"), rules).alias("hit"))
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.verdict"), F.when(F.col("score") > threshold, "block").otherwise("allow")).alias("verdict"),
        "host_words",
        "score",
    )


ship(sys.modules[__name__])
