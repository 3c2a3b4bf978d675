"""Small corpora that every operator is tried on."""

from __future__ import annotations

import random

import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long, quality string, position double"


def row(i, text, lang="en", source="a"):
    """Two more columns have names that operators use themselves."""
    return (i, text, lang, source, len(text or ""), "x", 0.5)


def corpus(seed=3, n=160):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(150)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(8, 80))) for _ in range(12)]
    rows = [row(0, None), row(1, ""), row(2, " \t\n", source=None), row(3, "a" * 4000, lang=None), row(4, "ab " * 500), row(5, "日本語 " * 60, "ja", None), row(6, "one two three"), row(7, "One two THREE")]
    for i in range(8, n):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 4))]
        text = "\n".join(parts)
        if rng.random() < 0.2 and i > 20:
            text = rows[rng.randrange(8, i)][1]  # an exact or near copy
            if rng.random() < 0.6 and text:
                k = rng.randrange(len(text))
                text = text[:k] + "é" + text[k + 1 :]
        rows.append(row(i, text, source=rng.choice(["a", "a", "a", "b", "c", None])))
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, KIND).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], KIND)
