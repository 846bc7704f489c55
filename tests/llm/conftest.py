import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, shard int, kept boolean, bucket string, n int"


@pytest.fixture(scope="session")
def hard_rows():
    """Nulls, empty and long texts, ties, repeated rows; other columns have names that operators use inside."""
    rng = random.Random(7)
    words = [f"w{k}" for k in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = say(120)
    near = base.split()
    near[60] = "other"
    rows = [(1, base, "en", "a"), (2, base, "en", "b"), (3, " ".join(near), "en", "a"), (4, "", "en", "a"), (5, None, None, None), (6, " \t\n", "de", None), (7, "one", "de", "b"), (8, "One", "de", "b"), (9, say(30_000), "en", "a"), (10, base, "en", "a"), (10, base, "en", "a"), (None, base, "fr", "c"), (None, None, None, "c"), (11, "x " * 12 + "y", "en", "a"), (12, "ĂÉ ß 漢字\n# $ |", "en", "a"), (13, "same line\nsame line\n\n" + say(60), "en", "a")]
    rows += [(100 + k, say(20 + k), "en", "a" if k % 3 else "b") for k in range(60)]
    return [(i, t, la, s, None if t is None else len(t), 5, 3, None, "x", 1) for i, t, la, s in rows]


@pytest.fixture(scope="session")
def hard(spark, hard_rows):
    return spark.createDataFrame(hard_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
