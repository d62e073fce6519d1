from __future__ import annotations

import random

import pytest

PATH = "/root/testdata/sf0.001"

DOCS = "doc_id long, text string, lang string, source string, score double, node long, `part.x` string"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{PATH}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{PATH}/labels.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, long, repeated and equal rows, and columns whose names the operators use."""
    rng = random.Random(3)
    long_text = " ".join(rng.choice("alpha beta gamma delta eps zeta".split()) + str(rng.randint(0, 99)) for _ in range(40_000))
    same = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \t\n ", "en", None),
        (4, long_text, "en", "b"),
        (5, long_text + " tail", None, "b"),
        (6, same, "en", "a"),
        (6, same, "en", "a"),
        (6, same + " other", "en", "a"),
        (7, same, None, None),
        (None, same, "en", "a"),
        (None, None, None, None),
        (8, "x", "en", "c"),
        (9, "ünïcödé ﬀ   words\r\n\x0b\x1c \U0001f600 end", "de", "c"),
    ]
    return spark.createDataFrame([(*r, 0.5, 1, "x") for r in rows], DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
