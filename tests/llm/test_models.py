"""Quality rules and toxicity: counts by brute force, estimates by NumPy, held-out accuracy; the pipeline end to end."""

import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest

from glossara.llm import quality as Q, toxicity as T
from glossara.llm.queries import tokenizer_path
from glossara.llm.token_planes import Encoder
from glossara.llm.toxicity import fit_chain, score_chain, toxicity

DIR = "/root/testdata/sf0.01"


def slow_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts(spark, hard_rows):
    rng = random.Random(8)
    extra = [(1000 + k, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 70))).replace("d a", "d\na"), "en", "a") + (None,) * 6 for k in range(60)]
    rows = [r[:4] for r in hard_rows + extra]
    got = Q.text_counts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    for r in got:
        expected = slow_counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected, r.text[:80]
        assert r.base_failed == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])


def slow_fit(q, support=0.75):
    """The same estimate of one group by NumPy, with whole ranks: distances of all rows."""
    x = q / 1000.0
    quart = np.percentile(q, [25, 50, 75], axis=0)
    mid = quart[1] / 1000
    n = math.expm1(mid[0])
    floor = np.diag(np.square([math.log1p(1 / (n + 1)), math.log1p(1 / (n * math.exp(mid[1]))), math.log1p(100 / n), math.log1p(100 / n), math.asin(math.sqrt(min(1, 6 / n)))]))

    def distance(mean, cov):
        d = x - mean
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)

    def estimate(rows, factor):
        return rows.mean(axis=0), np.cov(rows.T, bias=True) * factor + floor

    first = np.diag(((quart[2] - quart[0]) / 1349) ** 2) + floor
    scale = np.sqrt(np.diag(first))
    sign = (x - mid) / scale
    sign = np.round(1000 * sign / np.maximum(np.linalg.norm(sign, axis=1), 1e-9)[:, None]) / 1000
    starts = [(mid, first), estimate(x, 1.0), (mid, sign.T @ sign / len(x) * 5 * np.outer(scale, scale) + floor)]
    factor = support / Q.chi2_cdf(Q.chi2_quantile(support, 5), 7)
    ends = []
    for mean, cov in starts:
        best = math.inf
        while True:
            step = np.floor(64 * np.log1p(distance(mean, cov))).astype(int)
            upto = np.array([(step < s).sum() for s in step])
            tried = estimate(x[upto < support * len(x)], factor)
            now = np.linalg.slogdet(tried[1])[1]
            if now >= best - 1e-9:
                break
            (mean, cov), best = tried, now
        ends.append((best, mean, cov))
    _, mean, cov = min(ends, key=lambda e: e[0])
    inner = Q.chi2_quantile(0.975, 5)
    return distance(*estimate(x[distance(mean, cov) <= inner], 0.975 / Q.chi2_cdf(inner, 7)))


def distances(df):
    estimate, n = Q.fit(df)
    return Q._distance(df, estimate, n)


def test_estimates(spark):
    rng = np.random.default_rng(3)
    groups = {}
    rows = []
    for g, shift in enumerate((9000, 2500, 0)):
        q = (5000 + rng.normal(size=(400, 5)) @ rng.normal(size=(5, 5)) * 500).round().astype(int)
        q[:40] += shift
        if not shift:
            q[:, 2] = 0
            q[:, 3] = np.where(rng.random(400) < 0.1, 900, 0)
        groups[g] = q
        rows += [(g, k, *map(int, v)) for k, v in enumerate(q)]
    df = spark.createDataFrame(rows, "grp long, k int, q0 long, q1 long, q2 long, q3 long, q4 long")
    got = distances(df).collect()
    for g, q in groups.items():
        own = np.array([r.d2 for r in sorted((r for r in got if r.grp == g), key=lambda r: r.k)])
        assert np.allclose(own, slow_fit(q), rtol=1e-5)
        if g == 0:
            assert (own[:40] > 50).all() and (own[40:] <= 50).all()


def test_rejection_by_correlation(spark):
    """Two statistics that move together; a row inside both ranges but across them is an outlier, as only their covariance shows."""
    rng = np.random.default_rng(5)
    t = rng.normal(size=500)
    q = np.column_stack([5000 + 900 * t, 1600 + 90 * t + rng.normal(size=500) * 4, np.zeros(500), np.zeros(500), np.zeros(500)]).round().astype(int)
    q[0, :2] = 5900, 1510
    df = spark.createDataFrame([(1, k, *map(int, v)) for k, v in enumerate(q)], "grp long, k int, q0 long, q1 long, q2 long, q3 long, q4 long")
    own = {r.k: r.d2 for r in distances(df).collect()}
    diagonal = ((q[0] - np.median(q, axis=0))[:2] ** 2 / np.var(q[1:, :2], axis=0)).sum()
    assert diagonal < 3 and own[0] > 100 and sorted(own.values())[-2] < 30


def test_too_few_rows_are_not_judged(spark):
    rows = [(k, " ".join(f"w{k * 100 + j}" for j in range(60)) + " #" * (40 * (k == 0)), "en", "a") for k in range(20)]
    got = Q.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert all(r.kept and r.d2 is None for r in got)


def test_chi_squared():
    assert math.isclose(Q.chi2_quantile(0.975, 5), 12.8325, abs_tol=1e-3) and math.isclose(Q.chi2_cdf(6.6257, 5), 0.75, abs_tol=1e-4)


def test_quality_of_hard_rows(hard, hard_rows, none):
    got = Q.quality(hard).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in hard_rows)
    assert all(not (r.kept and r.base_failed) and r.kept is not None for r in got)
    assert Q.quality(none).count() == 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")
def test_quality_against_labels(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    got = Q.quality(docs).where("not base_failed").join(labels, "doc_id").collect()
    assert sum(r.kept for r in got if r.quality == 1) >= 0.999 * sum(r.quality == 1 for r in got)
    assert sum(r.kept for r in got if r.quality == 0) <= 0.05 * sum(r.quality == 0 for r in got)


def chain_rows(n, seed):
    """Toxic texts hold a bad word; poor texts hold junk; toxic texts are often poor."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        toxic = rng.random() < 0.2
        poor = rng.random() < (0.7 if toxic else 0.1)
        words = [f"w{rng.randrange(200)}" for _ in range(rng.randint(20, 80))] + ["awfulness", "stupidity"][: rng.randint(1, 2)] * toxic + ["zzz"] * poor
        rng.shuffle(words)
        rows.append((k, " ".join(words), int(not poor), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = chain_rows(900, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows if r[0] < 500], "doc_id long, quality int, toxic int")
    chain = fit_chain(docs, labels)
    assert chain["rows"] == 500 and chain["models"][1][1].shape == (T.STATS + 1,)
    got = {r.doc_id: r.toxic for r in score_chain(docs, chain).collect()}
    held = [r for r in rows if r[0] >= 500]
    hits = sum(got[r[0]] and r[3] for r in held)
    assert hits >= 0.9 * sum(r[3] for r in held) and hits >= 0.9 * sum(got[r[0]] for r in held)


def test_out_of_fold_predictions_do_not_see_their_rows():
    rng = np.random.default_rng(0)
    features = [np.array([k]) for k in range(60)]  # a word of its own for each row can only be memorised
    y = rng.integers(0, 2, (60, 1))
    chain = T.train_chain(features, np.zeros((60, 1)), y, 60, np.arange(60) % 5)
    inside = T.proba(chain["models"][0], T.Rows(features, np.zeros((60, 1)), 60))
    assert abs(np.corrcoef(chain["oof"][:, 0], y[:, 0])[0, 1]) < 0.6 < np.corrcoef(inside, y[:, 0])[0, 1]


def test_vocabulary_is_chosen_inside_folds():
    """Features that only the held-out rows would pick get no weight in that fold's model."""
    rng = np.random.default_rng(1)
    features, y = [np.array([k % 2]) for k in range(60)], np.array([[k % 2] for k in range(60)])
    use = np.ones((6, 2), bool)
    use[:5] = False
    chain = T.train_chain(features, rng.normal(size=(60, 1)) * 0, y, 2, np.arange(60) % 5, 5, use)
    assert np.ptp(chain["oof"][:, 0]) < 0.2 and chain["f1"][0] < 0.9
    inside = T.proba(chain["models"][0], T.Rows(features, np.zeros((60, 1)), 2))
    assert ((inside > 0.5) == y[:, 0]).all()


def test_toxicity_with_other_column_names(spark):
    rows = chain_rows(300, 3)
    docs = spark.createDataFrame([(9, r[0], r[1], "x", 1.0) for r in rows], "doc_id int, key long, body string, toxic string, id double")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "key long, quality int, toxic int")
    got = {r.key: r.toxic for r in toxicity(docs, labels, id_col="key", text_col="body").collect()}
    assert sum(got[r[0]] == bool(r[3]) for r in rows) > 0.9 * len(rows)


def test_repeated_ids_train_once(spark):
    rows = chain_rows(60, 5)
    docs = spark.createDataFrame([r[:2] for r in rows] * 3 + [(1, f"text {k}") for k in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "doc_id long, quality int, toxic int")
    assert fit_chain(docs, labels)["rows"] == 60


def test_copies_share_a_fold(spark):
    rows = chain_rows(200, 4)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1000 + r[0], r[1]) for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows] + [(1000 + r[0], r[2], r[3]) for r in rows], "doc_id long, quality int, toxic int")
    oof = fit_chain(docs, labels)["oof"]
    assert np.allclose(oof[:200], oof[200:])


def test_toxicity_of_hard_rows(spark, hard, hard_rows, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 0, None), (7, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity(hard, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in hard_rows)
    assert toxicity(none, labels).count() == 0
    assert not any(r.toxic for r in toxicity(hard, labels.where("false")).collect())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names, seen = docs.columns, {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, d)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        if name != P.STAGES[-1][0]:
            assert docs.columns == names
    ids = {k: Counter(r.doc_id for r in v) for k, v in seen.items() if k != "packing"}
    assert set(ids["exact"]) <= set(ids["quality"]) and set(ids["near"]) <= set(ids["exact"]) and set(ids["mixing"]) <= set(ids["near"])
    texts = {}
    for r in seen["quality"]:
        texts.setdefault(r.text, []).append(r.doc_id)
    assert ids["exact"] == Counter(max(x) for x in texts.values())
    model, packed, expected = Encoder(tokenizer_path()).model, Counter(), Counter()
    for r in seen["packing"]:
        for i, n in zip(r.doc_ids, r.n_tokens):
            packed[i] += n
    for r in seen["mixing"]:
        expected[r.doc_id] += len(model.encode(r.text or "", add_special_tokens=False).ids) + 1
    assert packed == expected
    assert P.run(spark, d).count() == len(seen["packing"])


def test_pipeline_stages_on_hard_rows(spark, hard, hard_rows, none):
    import corpus_pipeline as P

    cols = "doc_id text lang source n_chars".split()
    docs = hard.select(*cols)
    passed = Counter((r[0], r[1]) for r in hard_rows if slow_counts(r[1])[0] >= 50 and 2 * slow_counts(r[1])[4] <= slow_counts(r[1])[0])
    # the one text of 30,000 words is an outlier among short ones
    assert Counter((r.doc_id, r.text) for r in P.quality_rules(spark, docs, "").collect()) == Counter({k: n for k, n in passed.items() if k[0] != 9})
    texts = Counter(r[1] or "" for r in hard_rows)
    assert Counter(r.text or "" for r in P.exact(spark, docs, "").collect()) == Counter(set(texts))
    sets = {frozenset(zip(*[(t.lower().split())[k:] for k in range(5)])) or tuple(t.lower().split()) for t in texts}
    assert 1 < P.near(spark, docs, "").count() <= len(sets)
    mixed = P.mixing(spark, docs, "").collect()
    assert {r.text.split()[0] for r in mixed} <= {w for t in texts for w in t.split()} and len(mixed) <= 3 * len(hard_rows)
    packed = Counter(i for r in P.packing(spark, docs, "").collect() for i, at in zip(r.doc_ids, r.starts) if at == 0)
    assert packed == Counter(r[0] for r in hard_rows)
    for name, stage in P.STAGES:
        assert stage(spark, none.select(*cols), "").count() == 0, name
