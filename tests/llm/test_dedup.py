"""Exact dedup, substring dedup and SimHash against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from glossara.llm.components import components
from glossara.llm.exact_dedup import exact_dedup
from glossara.llm.simhash import fingerprint, links, masks, near_duplicates
from glossara.llm.substring_dedup import _later, levels, substring_dedup


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact(hard, hard_rows, keep):
    got = exact_dedup(hard, keep=keep).collect()
    groups = defaultdict(list)
    for i, t, *_ in hard_rows:
        groups[t or ""].append(i)
    pick = max if keep == "largest" else min
    expected = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            expected[(i, pick(known) if known else None, len(ids), hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and len({r.text_sha256 for r in kept}) == len(groups)
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_hot_group(spark):
    """A group over many range partitions, and texts that share their beginning."""
    rows = [(k, "same") for k in range(4000)] + [(5000 + k, "x" * 100 + str(k % 500)) for k in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = exact_dedup(df).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id < 4000} == {(0, 4000)}
    assert all(r.group_size == 2 and r.keep_id == min(r.doc_id, 5000 + (r.doc_id - 5000) % 500) for r in got if r.doc_id >= 5000)
    assert sum(r.kept for r in got) == 501


def brute_substrings(rows, window):
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    big = float("inf")
    least = {}
    for i, w in docs:
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            least[key] = min(least.get(key, big), big if i is None else i)
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if least[tuple(w[p : p + window])] < (big if i is None else i):
                gone[p : p + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return Counter(out)


@pytest.mark.parametrize("window, first", [(2, None), (5, None), (13, None), (13, 2), (13, 13), (8, 1)])
def test_substrings(hard, hard_rows, window, first):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(hard, window, first=first).collect())
    assert got == brute_substrings([r[:2] for r in hard_rows], window)


def test_substrings_many_repeats(spark):
    rng = random.Random(3)
    phrases = [[f"p{k}_{j}" for j in range(rng.randint(3, 40))] for k in range(30)]
    rows = [(k * 3 % 101, " ".join(w for _ in range(rng.randint(0, 12)) for w in rng.choice(phrases))) for k in range(150)]
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 13).collect())
    assert got == brute_substrings(rows, 13)


def test_levels():
    assert levels(13) == [7, 13] and levels(13, 2) == [2, 4, 8, 13] and levels(8, 1) == [1, 2, 4, 8] and levels(2) == [1, 2] and levels(5, 5) == [5]


def test_windows_equal_in_64_bits_are_told_apart():
    """Two windows with one first hash and other second ones, and a real repeat."""
    part = lambda ids, one, two: bytes([4]) + np.array(one, np.uint64).tobytes() + np.array(two, np.uint64).tobytes() + np.array(ids, np.uint32).tobytes()
    bits = _later([part([3, 1], [7, 9], [70, 90]), part([2, 2], [7, 9], [71, 90])])
    assert [np.unpackbits(np.frombuffer(x, np.uint8))[:2].tolist() for x in bits] == [[0, 0], [0, 1]]


def test_substrings_without_ids(spark):
    """Rows without an id are dealt by their text; they are one document, after all others."""
    words = [f"w{k}" for k in range(40)]
    rows = [(None, " ".join(words[k : k + 20])) for k in range(20)] + [(5, " ".join(words[3:18]))]
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_substrings(rows, 13)


def test_substrings_of_many_rows_of_one_text(spark):
    """Rows that share id and text, with null ids and null texts, pass as one row with a count."""
    words = [f"w{k}" for k in range(30)]
    text = " ".join(words)
    rows = [(None, None)] * 400 + [(None, "")] * 3 + [(None, text)] * 300 + [(7, text)] * 200 + [(8, text + " end"), (3, " ".join(words[5:25])), (None, "other " + text)]
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == brute_substrings(rows, 13)


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(ids, pairs):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def test_fingerprints(hard_rows):
    assert all(fingerprint(r[1]) == slow_fingerprint(r[1]) for r in hard_rows if len(r[1] or "") < 5000)


def test_masks_cover_every_pair():
    tables = masks(2)
    for a in range(64):
        for b in range(a, 64):
            assert any(not m >> a & 1 and not m >> b & 1 for m in tables)


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(300, 420)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    expected = union({x for p in pairs for x in p}, pairs)
    assert all(got.get(k, k) == v for k, v in expected.items())


@pytest.mark.parametrize("bucket_rows", [200_000, 3])
def test_links(spark, bucket_rows):
    """Chains of fingerprints two bits apart, and noise; small buckets and buckets that are handed on."""
    rng = random.Random(1)
    fps = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(8):
            fps.add(x)
            x ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
    fps = sorted(fps)
    arr = np.array(fps, np.uint64)
    pairs = [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(arr[i] ^ arr) <= 2) if j > i]
    expected = union(range(len(fps)), pairs)
    nodes = spark.createDataFrame([(i, x - 2**64 if x >= 2**63 else x) for i, x in enumerate(fps)], "node long, fp long")
    got = {r.node: r.component for r in components(links(nodes, bucket_rows=bucket_rows), "a", "b").collect()}
    assert {i: got.get(i, i) for i in expected} == expected


def test_near_duplicates(hard, hard_rows):
    got = near_duplicates(hard).collect()
    assert len(got) == len(hard_rows)
    fps = {f"{fingerprint(r[1]):016x}" for r in hard_rows}
    assert {r.fingerprint for r in got} == fps
    by = defaultdict(set)
    for i, t, *_ in hard_rows:
        by[f"{fingerprint(t):016x}"].add(i)
    zero = "0" * 16
    assert by[zero] >= {4, 5, 6, None}
    assert {r.component_id for r in got if r.fingerprint == zero} == {4}


def test_components_of_texts_by_brute_force(spark, hard, hard_rows):
    """Fingerprints, links and component ids from the texts on, with texts that differ in a word or two."""
    rng = random.Random(12)
    rows = []
    for k in range(25):
        base = [f"v{rng.randrange(400)}" for _ in range(rng.randint(300, 600))]
        for j in range(4):
            rows.append((100 * k + j, " ".join(base)))
            base[rng.randrange(len(base))] = f"z{rng.randrange(10**6)}"
    rows += [(5000 + i, r[1]) for i, r in enumerate(hard_rows) if len(r[1] or "") < 5000]
    fps = {i: slow_fingerprint(t) for i, t in rows}
    ids = sorted(fps)
    linked = [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    expected = union(ids, linked)
    assert len(set(expected.values())) < len({fps[i] for i in ids})
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", expected[i]) for i in ids}


def test_empty(none):
    assert exact_dedup(none).count() == substring_dedup(none).count() == near_duplicates(none).count() == 0
