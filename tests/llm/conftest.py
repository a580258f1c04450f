import random

import pytest

KINDS = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, component_id long, row long, slot string"


def rows(texts):
    return [(i, t, "en", "s", len(t) if t is not None else None, 1.0, 2, 3, 4, "x") for i, t in texts]


def prose(seed, n):
    r = random.Random(seed)
    syllables = ["the", "an", "or", "ti", "es", "ble", "ing", "wh", "ed", "ly"]
    words = ["".join(r.choice(syllables) for _ in range(r.choice((1, 1, 2, 3)))) for _ in range(n)]
    return " ".join(w + ("." if k % 9 == 8 else "") for k, w in enumerate(words))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a long text, columns whose names clash with the operators' own."""
    a, long = prose(1, 120), prose(2, 30_000)
    near = a.split(" ")
    near[50] = "changed"
    texts = [(1, a), (2, a), (2, a), (3, " ".join(near)), (4, None), (5, ""), (6, " \t\n "), (None, prose(3, 40)), (None, None), (7, long), (8, long), (9, prose(4, 60)), (10, "one two"), (11, "One TWO"), (12, "é ß 日本 😀 <|endoftext|> end")]
    return spark.createDataFrame(rows(texts), KINDS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], KINDS)


@pytest.fixture(scope="session")
def make(spark):
    return lambda texts: spark.createDataFrame(rows(texts), KINDS)


@pytest.fixture(scope="session")
def text_of():
    return prose
