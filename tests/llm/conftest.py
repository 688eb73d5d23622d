import random

import pytest

WORDS = "the of and to in is that it for was on are with as by be this stone river cloud paper light".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages and odd rows; ids are the keys."""
    rng = random.Random(5)
    passage = prose(rng, 60)
    out = {}
    for i in range(60):
        out[i] = prose(rng, rng.randrange(5, 160))
    for i in range(60, 75):
        out[i] = f"{prose(rng, 20)}\n{passage}\n{prose(rng, 15)}"
    base = out[3] + " " + prose(rng, 80)
    for i in range(75, 105):  # near copies that drift apart
        words = base.split()
        for _ in range(rng.randrange(0, 12)):
            words[rng.randrange(len(words))] = "changed" + str(rng.randrange(9))
        out[i] = " ".join(words)
    for i in range(105, 112):
        out[i] = out[7]
    out |= {112: "", 113: "   \n\t ", 114: "one", 115: "one", 116: "Two Words", 117: "two words", 118: "ünïcödé 日本語   text\x0bhere"}
    out[119] = "same line\n" * 40
    out[120] = prose(rng, 30_000)
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts and a null one, with a column whose name clashes with helper columns."""
    rows = [(i, t, "x", f"src{i % 3}" if i % 5 else None, 1) for i, t in texts.items()] + [(121, None, "x", "src0", 1)]
    schema = "doc_id bigint, text string, row string, source string, n bigint"
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, row string, source string, n bigint")
