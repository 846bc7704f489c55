"""Stages of the pipeline on null and repeated ids."""

import random
from collections import Counter

import pytest

from glossara.llm.mixing import mixture

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def unnamed():
    """Distinct texts under a null and a repeated id, each with words of its own, among rows that quality rejects."""
    rng = random.Random(8)
    say = lambda k, n: " ".join(f"t{k}x{rng.randrange(10**6)}" for _ in range(n))
    good = [(i, say(k, 80 + 7 * k), "en", "a") for k, i in enumerate([None, None, None, 1, 1, 2])]
    bad = [(None, "too short", "en", "a"), (1, "short as well", "en", "a")]
    return [(i, t, la, s, len(t)) for i, t, la, s in good], [(i, t, la, s, len(t)) for i, t, la, s in bad]


def test_stages_decide_on_rows(spark, unnamed):
    import corpus_pipeline as P

    good, bad = unnamed
    rows = lambda df: Counter(map(tuple, df.collect()))
    assert rows(P.quality_rules(spark, spark.createDataFrame(good + bad, SCHEMA), "")) == Counter(good)
    # a null-id copy of a text that is kept under an id, and rows that repeat id and text
    named = (9, good[0][1], "en", "a", good[0][4])
    docs = spark.createDataFrame([*good, named, good[1], good[3]], SCHEMA)
    assert rows(P.exact(spark, docs, "")) == Counter([*good[1:], named])
    # near copies: one row of each component, the known id first
    close = [(i, t.replace(t.split()[40], "other"), la, s, n) for i, t, la, s, n in good[:4]]
    known = [(20 + k, *x[1:]) for k, x in enumerate(close)]
    assert rows(P.near(spark, spark.createDataFrame([*good, good[0], *known], SCHEMA), "")) == Counter([*known[:3], *good[3:]])


def test_mixture_of_rows_without_ids(spark, unnamed):
    good = unnamed[0]
    docs = spark.createDataFrame([*good, good[0], good[3]], SCHEMA)
    got = mixture(docs, block_words=16, share=2.0).collect()
    copies, words = Counter(t for _, t, *_ in [*good, good[0], good[3]]), Counter()
    of = {t.split("x")[0]: (i, t) for i, t, *_ in good}
    for r in got:
        (name,) = {w.split("x")[0] for w in r.text.split()}
        i, t = of[name]
        assert r.doc_id == i and r.n_chars == len(r.text) and set(r.text.split()) <= set(t.split())
        words[t] += len(r.text.split())
    assert all(words[t] <= 3 * n * len(t.split()) for t, n in copies.items())
    assert abs(sum(words.values()) - 2 * sum(n * len(t.split()) for t, n in copies.items())) <= 16
    assert len(got) <= 3 * sum(copies.values())
