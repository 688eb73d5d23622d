"""The pipeline, stage by stage, against brute force."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from skein.llm.quality import STOP_WORDS
from tests.llm.test_dedup import SPLIT, near_brute, passages_brute


def quality_brute(text):
    words = SPLIT.findall(text)
    n = max(1, len(words))
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {p for k, g in enumerate(windows) if seen[g] > 1 for p in range(k, k + 5)}
    lines = [x for x in text.split("\n") if SPLIT.search(x)]
    bare = text.lower().translate(str.maketrans("", "", ".,;:!?\"'()"))
    stops = sum(w in STOP_WORDS for w in re.split(r"[\x20\x09-\x0D]+", bare))
    return not (
        len(words) < 10
        or len(covered) > 0.2 * n
        or not 2 <= sum(map(len, words)) / n <= 20
        or sum(c in "#*$%&|<>" for c in text) > 0.1 * n
        or sum(c in "!?" for c in text) > 0.5 * n
        or (len(words) >= 50 and stops < 0.02 * n)
        or (len(lines) - len(set(lines))) > 0.5 * max(1, len(lines))
    )


@pytest.fixture(scope="module")
def table(spark, texts):
    common = "the and of to "
    rows = [(i, t and common * (len(t) // 60) + t, "en", f"src{i % 3}" if i % 5 else None, len(t or "")) for i, t in texts.items()]
    rows = [r for r in rows if r[0] != 119] + [(119, "same line of many words\n" * 40, "en", "src1", 1), (121, None, "en", None, None)]
    rows += [(130, "###word *** " * 30, "en", "src0", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_stages(spark, table, tmp_path):
    now = {r.doc_id: r.text for r in table.collect()}
    whole = now
    docs = table
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        path = str(tmp_path / name)
        stage(spark, docs, "").write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == table.columns
        if k == 0:
            now = {i: t for i, t in now.items() if quality_brute(t or "")}
            assert 0 < len(now) < len(whole)
        elif k == 1:
            first = {}
            for i, t in sorted(now.items()):
                first.setdefault(t, i)
            now = {i: now[i] for i in first.values()}
        elif k == 2:
            now = {i: now[i] for i, (_, _, kept) in near_brute(now, 5, 80).items() if kept}
        else:
            cut = passages_brute(now, 50)
            now = {i: cut[i][2] if cut[i][1] else t for i, t in now.items() if cut[i][1] < cut[i][0] or not cut[i][1]}
        got = {r.doc_id: r for r in docs.collect()}
        assert {i: r.text for i, r in got.items()} == now, name
    assert all(r.n_chars == len(r.text) for r in got.values())

    packed = corpus_pipeline.STAGES[4][1](spark, docs, "").collect()
    for i, t in now.items():
        assert sum(r.size for r in packed if r.doc_id == i) == len(SPLIT.findall(t))
    room = Counter()
    for r in packed:
        room[r.shard, r.bin] += r.size
    assert max(room.values()) <= corpus_pipeline.BIN_WORDS


def test_run_takes_the_table_of_the_folder(spark, table, tmp_path):
    table.limit(30).write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {r.doc_id for r in table.collect()}
    table.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_rows_without_an_id_of_their_own(spark, texts):
    """Null ids, repeated rows and one id with two texts, in every stage."""
    quality, exact, near, substring, packing = (stage for _, stage in corpus_pipeline.STAGES)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"

    def after(stage, rows):
        docs = spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in rows], schema)
        return sorted(((r.doc_id, r.text) for r in stage(spark, docs, "").collect()), key=repr)

    def whole(rows):
        return sorted(rows, key=repr)

    long = [t for t in texts.values() if len(SPLIT.findall(t)) in range(110, 160)][:6]
    a, b, c, d, e, f = ("the and of to that it " + t for t in long)
    near_a, near_b, near_e = (t.rsplit(" ", 1)[0] + " last" for t in (a, b, e))
    bad = "too short"
    rows = [(None, a), (None, a), (None, b), (1, bad), (1, c), (2, d), (2, d), (None, bad), (3, None)]
    assert after(quality, rows) == whole([r for r in rows if r[1] not in (bad, None)])
    rows = [(None, a), (None, a), (4, b), (None, b), (5, c), (5, c), (5, d), (6, d), (6, e), (None, ""), (None, None)]
    left = after(exact, rows)
    assert [r for r in left if r[1]] == whole([(None, a), (4, b), (5, c), (5, d), (6, e)]) and len(left) == 6
    # Null ids and rows of one id are documents of their own, also as near copies of others.
    rows = [(None, a), (7, near_a), (None, b), (8, near_b), (9, c), (9, c), (10, e), (10, near_e), (None, d), (None, f)]
    left = after(near, rows)
    assert [r for r in left if r[0] != 10] == whole([(None, a), (None, b), (9, c), (None, d), (None, f)]) and len(left) == 6
    left = after(substring, [(None, a), (None, a), (11, b), (11, b + " tail"), (12, f"{c} x"), (None, d)])
    assert [r for r in left if r[0] != 11] == whole([(None, a), (12, f"{c} x"), (None, d)])
    assert sum(len(SPLIT.findall(t)) for i, t in left if i == 11) == len(SPLIT.findall(b)) + 1
    docs = spark.createDataFrame([(i, a, "en", None, 1) for i in (None, None, 1, 1)], schema)
    assert sum(r.size for r in packing(spark, docs, "").collect()) == 4 * len(SPLIT.findall(a))
