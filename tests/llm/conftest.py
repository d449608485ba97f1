import random

import pytest
from pyspark.sql import functions as F

ODD = [(None, None, None, None), (1, "", "a", 0), (1, "", "a", 0), (2, " \t\n\x0b", None, 4), (3, "one", "b", 3), (3, "one", "b", 3), (4, "x " * 30000, "b", 60000), (5, "naïve Ünïcode 漢字 😀", "c", 20)]


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with those of results."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in ("score", "taken", "component", "value", "line", "fp", "anchor", "chunks", "a", "id")})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("1 = 0")


@pytest.fixture(scope="session")
def corpus():
    """Texts with exact and near copies and shared passages: (doc_id, text)."""
    rng = random.Random(4)
    passage = prose(rng, 80)
    out = []
    for i in range(160):
        words = prose(rng, rng.randrange(5, 160)).split()
        if i % 5 == 0:
            at = rng.randrange(len(words))
            words[at:at] = passage.split()[rng.randrange(10) :]
        if i % 7 == 3 and out:
            words = out[rng.randrange(len(out))][1].split()
            if i % 2:
                words[rng.randrange(len(words))] = "changed"
        text = " ".join(words)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(text) + 1)
            text = text[:at] + "\n" + text[at:]
        out.append((i, text))
    out += [(900 + i, "a b a b " * 40) for i in range(2)] + [(950, "ab" * 700), (951, "é" * 600)]
    return out
