import random

import pytest

from corvane.session import ship


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]


@pytest.fixture(scope="session")
def odd(spark, words):
    """Nulls, empty and long texts, ties, repeated rows, near copies, and columns whose names operators use inside."""
    rng = random.Random(11)
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(6)]
    texts = [None, "", " \t\n", "one", "one two", base[0], base[0], base[0].replace(" ", "  "), base[0].upper(), base[1] + " tail", base[1], base[2], "\n".join(base[:4]), "x" * 5000, " ".join(words * 20), "é漢字 \U0001f600 " + base[3], base[3]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, base[0]), (None, base[4]), (None, None)]
    ship(spark)
    return spark.createDataFrame([(i, t, "en" if t else None, "s", 1, 2, 3, "k") for i, t in rows], "doc_id long, text string, lang string, source string, size long, _n int, _rep int, _kept string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
