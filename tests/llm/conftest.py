import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, key long, count long"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(7)
    syllables = "ka lo mi ter son ver alt rum pel dis gor han fel bri tun".split()
    return lambda n, seed=None: " ".join("".join((random.Random(f"{seed}{i}") if seed is not None else rng).choices(syllables, k=3)) for i in range(n))


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text), with columns whose names clash with the operators' own."""
    return lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, "x", 1, 2) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def awkward(words):
    long = words(30_000, 1)
    return [(1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, "same words here again and again"), (6, "same words here again and again"), (5, "same words here again and again"), (None, "no id but text enough for a shingle"), (7, long), (8, long + " end"), (9, "日本語 é ü 😀 😀 password=abcdefgh1")]
