"""Near copies of the pipeline against brute force."""

import random

import numpy as np
import pytest

from glossara.llm import near_dedup
from glossara.llm.components import components
from glossara.llm.near_dedup import covered, linked, near_kept, shingle_hashes, words_of
from glossara.llm.simhash import majority

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else frozenset()


def brute(texts):
    """Components of texts at a Jaccard similarity of 0.8."""
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((label[i], label[j]))
                label = [x if z == y else z for z in label]
    return label


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(5)
    texts = []
    for _ in range(60):
        base = [f"w{rng.randrange(2000)}" for _ in range(rng.randint(60, 200))]
        texts += [" ".join(edited(rng, base, k)) for k in (0, 1, 2, 3, 5, 8)]
    return texts + ["", None, " \n", "one two", "One two", "one three", "a b c d e", "a b c d f"]


def test_near_against_brute_force(spark, copies):
    import corpus_pipeline as P

    docs = spark.createDataFrame([(k, t, "en", "a", len(t or "")) for k, t in enumerate(copies)], SCHEMA).repartition(3)
    assert len(set(brute([t or "" for t in copies]))) < len(copies) * 0.7
    assert sorted(r.doc_id for r in P.near(spark, docs, "").collect()) == sorted(set(brute([t or "" for t in copies])))


@pytest.mark.parametrize("chunk", [3, 10])
def test_large_components_in_chunks(spark, chunk):
    """Components of many near copies: stars around one text, chains whose ends do not link, and both mixed."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join(edited(rng, base, rng.choice((1, 2, 3, 9)))) for _ in range(60)]
    walk = [f"c{k}" for k in range(120)]
    for _ in range(25):
        walk = edited(rng, walk, 2)
        texts.append(" ".join(walk))
    rng.shuffle(texts)
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in enumerate(texts)], SCHEMA).repartition(3)
    expected = sorted(set(brute(texts)))
    assert 2 < len(expected) < 60
    assert sorted(r.doc_id for r in near_kept(docs, chunk=chunk).collect()) == expected


def test_linked_between_two_sides():
    rng = random.Random(7)
    for _ in range(40):
        base = rng.sample(range(40), 20)
        sets = [np.array(sorted(rng.sample(base, rng.randint(15, 20)))) for _ in range(20)]
        some = np.array([rng.random() < 0.4 for _ in sets])
        label = list(range(20))
        for i in range(20):
            for j in range(i):
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                if some[i] != some[j] and 5 * len(a & b) >= 4 * len(a | b):
                    x, y = sorted((label[i], label[j]))
                    label = [x if z == y else z for z in label]
        assert linked(sets, some).tolist() == label


def test_linked_against_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        base = rng.sample(range(40), 20)
        sets = [np.array(sorted({*rng.sample(base, rng.randint(12, 20)), *rng.sample(range(40), rng.randint(0, 3))})) for _ in range(25)]
        label = list(range(25))
        for i in range(25):
            for j in range(i):
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                if 5 * len(a & b) >= 4 * len(a | b):
                    x, y = sorted((label[i], label[j]))
                    label = [x if z == y else z for z in label]
        assert linked(sets).tolist() == label


def test_fingerprints_are_covered(spark):
    """The stage's SimHash step: every pair within two bits is joined, whatever else proposes it."""
    rng = random.Random(11)
    prints = [rng.getrandbits(64) for _ in range(30)]
    for f in prints[:20]:
        prints += [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)), f ^ (7 << rng.randrange(60)), f]
    nodes = spark.createDataFrame([(k, f - (f >> 63 << 64)) for k, f in enumerate(prints)], "node long, fp long").repartition(3)
    label = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                x, y = sorted((label[i], label[j]))
                label = [x if z == y else z for z in label]
    got = {r.node: r.component for r in components(covered(nodes), "node", "centre").collect()}
    assert [got.get(k, k) for k in range(len(prints))] == label


def test_near_takes_fingerprints_where_no_band_is_shared(spark, monkeypatch):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(3000)]
    texts = [" ".join(words), " ".join(words[:2999] + ["other"]), " ".join(f"x{rng.randrange(10**6)}" for _ in range(300))]
    a, b = (majority(shingle_hashes(words_of(t))) for t in texts[:2])
    assert (a ^ b).bit_count() <= 2
    monkeypatch.setattr(near_dedup, "band_keys", lambda hashes: [])
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in enumerate(texts)], SCHEMA).repartition(2)
    assert sorted(r.doc_id for r in near_kept(docs).collect()) == [0, 2]
