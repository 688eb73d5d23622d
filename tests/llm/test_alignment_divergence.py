"""Token alignment and source divergence against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from skein.llm import alignment, divergence

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "<|endoftext|> and <s> are </s> plain <unk>",
    "a▁b has the mark",
    "  two  spaces\n\nand\ttabs  ",
    " ",
    "\n",
    "日本語のテキストはスペースがありません" * 40,
    "x" * 3000,
    "é́ \U0001f600 \U0001f468‍\U0001f469‍\U0001f467 ￿",
    "don't they'll 123,456.78 --- ...",
]


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(FIRST), sentencepiece.SentencePieceProcessor(model_file=SECOND)
    first.encode_special_tokens = True
    letters, names = alignment.byte_letters(), {i: t for t, i in first.get_vocab().items()}

    def of_a(i):
        return bytes(letters[c] for c in names[i])

    def of_b(i):
        piece = second.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()

    docs, counts = [], Counter()
    for key, text in rows:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        if b"".join(map(of_a, a)) != whole or b"".join(map(of_b, b)) != whole:
            a, b = [], []
        owner_a = [(i, t) for i, t in enumerate(a) for _ in of_a(t)]
        owner_b = [(i, t) for i, t in enumerate(b) for _ in of_b(t)]
        links = sorted({(x[0], y[0], x[1], y[1]) for x, y in zip(owner_a, owner_b, strict=True)})
        groups, run = [], ([], [])
        for p in range(len(owner_a)):
            ends = [p + 1 == len(o) or o[p + 1][0] != o[p][0] for o in (owner_a, owner_b)]
            for which, o in enumerate((owner_a, owner_b)):
                if ends[which]:
                    run[which].append(str(o[p][1]))
            if all(ends):
                groups.append(",".join(run[0]) + "|" + ",".join(run[1]))
                run = ([], [])
        pairs = [x[2:] for x in links]
        counts.update(set(pairs))
        docs.append((key, len(a), len(b), len(groups), pairs, ";".join(groups)))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for key, n_a, n_b, n_groups, pairs, text in docs:
        best = sum(counts[p] == most[p[0]] for p in pairs)
        sha = hashlib.sha256(text.encode()).hexdigest() if text else ""
        out.append((key, n_a, n_b, n_groups, len(pairs), best, sum(counts[p] for p in pairs), sha))
    return out, counts


def test_alignment(spark, docs, monkeypatch):
    more = [(1000 + i, t) for i, t in enumerate(ODD)] + [(1000, ODD[0]), (None, "a row without id"), (3, "another text of an id")]
    all_docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string")).repartition(3)
    rows = [tuple(r) for r in all_docs.collect()]
    want, counts = brute(rows)
    for block_bytes in (1, 1 << 24):
        found = alignment.aligned_tokens(all_docs, FIRST, SECOND, block_bytes=block_bytes)
        assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    pairs = {(r.a, r.b): r.n for r in alignment.linked_pairs(all_docs, FIRST, SECOND).collect()}
    assert pairs == dict(counts)
    marked = {r[0]: r for r in want}
    assert marked[1001][1] == 0 and marked[1001][7] == ""  # the mark in a text is not spelled again
    assert marked[1000][3] > 5


def test_windows_with_one_hash_are_told_apart(monkeypatch):
    codec = alignment.First(open(FIRST, encoding="utf-8").read()), alignment.Second(open(SECOND, "rb").read())
    numerals = alignment.Numerals(60_000)
    texts = ["one two three " * 9, "four five six", "", "a▁b", "one two"]
    full = alignment._Slice(texts, *codec, numerals)
    monkeypatch.setattr(alignment.wordspans, "spans", lambda h, starts, sizes: (starts * 0).astype("uint64"))
    bare = alignment._Slice(texts, *codec, numerals)
    assert full.digests == bare.digests and full.code.tolist() == bare.code.tolist() and full.times.tolist() == bare.times.tolist()


def test_alignment_of_nothing(spark, empty):
    assert alignment.aligned_tokens(empty, FIRST, SECOND).collect() == []
    bare = spark.createDataFrame([("x", None), ("y", "")], "doc_id string, text string")
    found = sorted(map(tuple, alignment.aligned_tokens(bare, FIRST, SECOND).collect()))
    assert found == [("x", 0, 0, 0, 0, 0, 0, ""), ("y", 0, 0, 0, 0, 0, 0, "")]


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def divergence_brute(rows, min_docs, top):
    groups = defaultdict(Counter)
    docs, langs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = TERM.findall(low)
        groups[lang, source].update(terms)
        docs[lang].update(set(terms))
        langs[lang].update(terms)
    out = []
    for (lang, source), own in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = shares(own)
        scored = []
        for (other_lang, other), counts in groups.items():
            if other_lang == lang and other != source:
                q = shares(counts)
                scored.append((-sum((p[t] - q[t]) ** 2 // (p[t] + q[t]) for t in kept), other))
        q = shares(langs[lang])
        over = [(-((p[t] - q[t]) ** 2 // (p[t] + q[t])), t) for t in kept if own[t] and p[t] > q[t]]
        for part, found, limit in (("pair", scored, None), ("term", over, top)):
            ordered = sorted(found, key=lambda x: (x[0], x[1].encode()))[:limit]
            out += [(lang, source, part, item, -v, k) for k, (v, item) in enumerate(ordered, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def spoken():
    words = "The OF and river stone café ÜBER über naïve paper x y light 東京 don't e-mail".split()
    rows = []
    for i in range(260):
        n = 1 + i * 7 % 23
        text = " ".join(words[(i * 3 + k * k) % len(words)] for k in range(n)) + ("!\x00\x7f;" if i % 3 else "")
        rows.append((text, ("en", "de", None)[i % 3], None if i % 11 == 0 else f"s{i % 5}"))
    rows += [(None, "en", "silent"), ("", "fr", "s0"), ("zz", "fr", "s1"), ("only once", "it", "alone"), (rows[5][0], *rows[5][1:])]
    return rows


@pytest.mark.parametrize(("block", "chunk", "held"), [(64, 2048, 1 << 19), (2, 3, 5)])
def test_divergence(spark, spoken, monkeypatch, block, chunk, held):
    monkeypatch.setattr(divergence, "SOURCES_PER_BLOCK", block)
    monkeypatch.setattr(divergence, "TERMS_PER_CHUNK", chunk)
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    schema = "text string, lang string, source string, term string, p int, rank int"
    df = spark.createDataFrame([(*r, "t", 1, 2) for r in spoken], schema).repartition(4)
    found = divergence.source_divergence(df, min_docs=10, top_terms=4).collect()
    assert sorted(map(tuple, found)) == divergence_brute(spoken, 10, 4)


def test_divergence_of_nothing(spark, empty):
    from pyspark.sql import functions as F

    assert divergence.source_divergence(empty.withColumn("lang", F.lit("en"))).collect() == []
