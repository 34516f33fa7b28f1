from __future__ import annotations

import random

import pytest

pytest.importorskip("sparkwell.llm")

WORDS = "alder birch cedar elm fir hazel larch maple oak pine rowan spruce willow yew ash beech holly ivy moss fern".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(("", "", "s", "y", "er")) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def rng():
    return random.Random(7)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows, clashing columns."""
    r = random.Random(3)
    long = sentence(r, 60_000)
    rows = [
        (1, "", "en", "a", 0, "x", 1),
        (2, None, None, None, None, None, None),
        (None, "no id but some words to read here", "en", "a", 1, "x", 2),
        (3, long, "en", "a", len(long), "x", 3),
        (4, "same row twice with a few words", "en", "a", 5, "x", 4),
        (4, "same row twice with a few words", "en", "a", 5, "x", 4),
        (5, " \t\n\x0b ", "en", "a", 5, "x", 5),
        (6, "ein Wort größer als keines", "de", "b", 5, "x", 6),
        (7, "two", "en", "b", 3, "x", 7),
        (8, "\x00 odd � signs \U0001f600 here", "en", "b", 3, "x", 8),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp string, h long"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
