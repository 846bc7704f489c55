"""Toxicity by a classifier chain of linear models.

The label columns are predicted one after the other; each later model also gets the probabilities of all earlier
categories, which in training are out-of-fold predictions, so that it learns from probabilities as good as those it will
see.  Models are logistic regressions over the presence of selected words and word beginnings and a few text statistics.

The labels table has two columns, so the chain has two links: ``quality`` leads, as toxic texts are more often poor ones,
and ``toxic`` follows.  Other tables name their own ``categories``.

Training uses at most ``sample_rows`` labelled documents (those of smallest hash); the vocabulary of each category is
the ``vocabulary`` words whose document counts there depart most from independence (chi-squared of ``least_chi2`` or
more, which a word reaches by chance less than once in a million).  Both bound what the
driver holds.  Folds follow from the text's hash, so exact copies share a fold, and the vocabulary of a fold's model is
chosen without the fold's rows.  Every document is scored, over its whole text.  The threshold of a category is the one
with the best F1 over out-of-fold predictions; the F1 that is reported takes for each fold the threshold of the others.

Defined cases: a null text scores as an empty one; labels that are null are not used for training; several labels of
one id count as the largest, and of several texts of one id that of the smallest hash is used for training; a category with one class only is predicted by its rate; without labels every probability is 0 and nothing is
flagged; null and repeated ids keep their rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut

STRIP = ".,;:!?\"'()[]{}«»„“”*#$%&|<>"
STATS = 3


def words_of(text: str | None) -> list[str]:
    """Distinct lower-cased words without punctuation at their ends, and the beginnings of longer words (as "abcd*"), in order."""
    words = {w.strip(STRIP) for w in set((text or "").lower().split())} - {""}
    stems = {w[:k] + "*" for w in words if len(w) > 5 for k in (4, 5)}
    return sorted(words | stems)


def stats_of(text: str | None) -> list[float]:
    text = text or ""
    n = max(1, len(text))
    return [float(np.log1p(len(text))) / 10, sum(map(text.count, "#*$%&|<>")) / n * 10, sum(map(text.count, "!?")) / n * 10]


class Rows:
    """Sparse rows of present features, and dense columns."""

    def __init__(self, features: list[np.ndarray], dense: np.ndarray, width: int):
        self.row = np.repeat(np.arange(len(features)), [len(x) for x in features])
        self.col = np.concatenate(features) if features else np.empty(0, np.int64)
        self.dense, self.width, self.n = dense, width, len(features)

    def dot(self, w: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n) + self.dense @ v

    def back(self, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(self.col, r[self.row], self.width), self.dense.T @ r

    def take(self, mask: np.ndarray) -> "Rows":
        new = object.__new__(Rows)
        place = np.cumsum(mask) - 1
        on = mask[self.row]
        new.row, new.col, new.dense, new.width, new.n = place[self.row[on]], self.col[on], self.dense[mask], self.width, int(mask.sum())
        return new


def logistic(x: Rows, y: np.ndarray, use: np.ndarray | None = None, penalty: float = 1.0, steps: int = 250) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of features and dense columns and the intercept, by Adam on the log loss plus penalty / 2 times the squared weights.

    use: mask of the features that may get a weight.
    """
    rate = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 1e-6
    w, v, b = np.zeros(x.width), np.zeros(x.dense.shape[1]), np.log(rate / (1 - rate))
    if not len(y) or y.min() == y.max():
        return w, v, b
    flat = np.concatenate([w, v, [b]])
    m, s = np.zeros_like(flat), np.zeros_like(flat)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x.dot(flat[: x.width], flat[x.width : -1]) + flat[-1], -30, 30)))
        r = (p - y) / len(y)
        gw, gv = x.back(r)
        gw = gw if use is None else gw * use
        g = np.concatenate([gw, gv, [r.sum()]]) + penalty / len(y) * np.r_[flat[:-1], 0]
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        flat = flat - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return flat[: x.width], flat[x.width : -1], float(flat[-1])


def proba(model, x: Rows) -> np.ndarray:
    w, v, b = model
    return 1 / (1 + np.exp(-np.clip(x.dot(w, v) + b, -30, 30)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p)) / 5


def best_threshold(y: np.ndarray, p: np.ndarray) -> tuple[float, float]:
    """(threshold, F1), half-way between the two scores around the best cut."""
    if not len(y) or not y.any():
        return 2.0, 0.0
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(np.argmax(f1))
    after = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float((p[order[k]] + after) / 2), float(f1[k])


def nested_f1(y: np.ndarray, p: np.ndarray, fold: np.ndarray) -> float:
    """F1 of predictions whose threshold, for each fold, is the best one of the other folds."""
    flagged = np.zeros(len(y), bool)
    for f in np.unique(fold):
        held = fold == f
        flagged[held] = p[held] >= best_threshold(y[~held], p[~held])[0]
    both = flagged.sum() + y.sum()
    return float(2 * (flagged & (y > 0)).sum() / both) if both else 0.0


def train_chain(features: list[np.ndarray], stats: np.ndarray, labels: np.ndarray, width: int, fold: np.ndarray, folds: int = 5, use: np.ndarray | None = None) -> dict:
    """Models of the columns of ``labels`` in order, with thresholds from their out-of-fold predictions and nested F1.

    use: (folds + 1) x width, the features of each fold's model and, last, of the model of all rows.
    """
    dense, models, thresholds, scores, out_of_fold = stats, [], [], [], []
    use = np.ones((folds + 1, width), bool) if use is None else use
    for k in range(labels.shape[1]):
        x, y = Rows(features, dense, width), labels[:, k].astype(float)
        oof = np.zeros(len(y))
        for f in range(folds):
            held = fold == f
            if held.any():
                oof[held] = proba(logistic(x.take(~held), y[~held], use[f]), x.take(held))
        models.append(logistic(x, y, use[folds]))
        thresholds.append(best_threshold(y, oof)[0])
        scores.append(nested_f1(y, oof, fold))
        out_of_fold.append(oof)
        dense = np.column_stack([dense, logit(oof)])
    return {"models": models, "thresholds": thresholds, "f1": scores, "oof": np.column_stack(out_of_fold)}


def fit_chain(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ("quality", "toxic"), id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 20_000, vocabulary: int = 1_500, min_docs: int = 4, least_chi2: float = 25.0, folds: int = 5) -> dict:
    spark = docs.sparkSession
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(*[F.max(F.col(c).cast("int")).alias(c) for c in categories]).dropna()
    # at most sample_rows rows
    sample = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()
    classes = [f"c{k}" for k in range(len(categories))]
    chosen = spark.createDataFrame([tuple(r) for r in sample], "id long, " + ", ".join(f"{c} int" for c in classes))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            fold = [xxhash.xxh64_intdigest((t or "").encode()) % folds for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fold, pa.int32()), pa.array([words_of(t) for t in texts], pa.list_(pa.string())), pa.array([stats_of(t) for t in texts], pa.list_(pa.float64()))], ["id", "fold", "words", "stats"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen.select("id")), "id", "left_semi")
    # a text for each id, so that repeated ids do not add to what the driver holds
    own = own.groupBy("id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = cut(own.mapInArrow(tokens, "id long, fold int, words array<string>, stats array<double>").join(F.broadcast(chosen), "id"))

    # counts of rows and of each class, in all and in each fold
    def sums() -> list[Column]:
        inside = [(f"_{f}", (F.col("fold") == f).cast("int")) for f in range(folds)] + [("", F.lit(1))]
        return [F.sum(v * x).alias(f"{c}{end}") for end, v in inside for c, x in [("n", F.lit(1)), *[(c, F.col(c)) for c in classes]]]

    totals = rows.agg(*sums()).first().asDict()
    counts = cut(rows.select("fold", F.explode("words").alias("word"), *classes).groupBy("word").agg(*sums()).where(F.col("n") >= min_docs))
    picks = []
    for f in range(folds + 1):
        there = lambda c: F.col(c) - F.col(f"{c}_{f}") if f < folds else F.col(c)  # noqa: B023, E731
        total = {c: (totals[c] or 0) - (totals[f"{c}_{f}"] or 0 if f < folds else 0) for c in ("n", *classes)}  # noqa: B023
        n = max(total["n"], 1)
        for c in classes:
            df, expected = there("n"), there("n") * (total[c] / n)
            score = F.pow(there(c) - expected, F.lit(2)) / (expected * (1 - df / n) + 0.5)
            # a fixed number of words, the model's size
            picks.append(counts.where((df >= min_docs) & (df < n) & (score >= least_chi2)).orderBy(score.desc(), "word").limit(vocabulary).select(F.lit(f).alias("f"), "word"))
    picked = functools.reduce(DataFrame.union, picks).distinct().collect()
    vocab: dict[str, int] = {}
    for r in sorted(picked, key=lambda r: (r["f"] != folds, r["word"])):  # the words of the model of all rows come first
        vocab.setdefault(r["word"], len(vocab))
    width = max(1, len(vocab))
    use = np.zeros((folds + 1, width), bool)
    for r in picked:
        use[r["f"], vocab[r["word"]]] = True
    words = spark.createDataFrame(list(vocab.items()), "word string, f int") if vocab else spark.createDataFrame([], "word string, f int")
    found = rows.select("id", F.explode("words").alias("word")).join(F.broadcast(words), "word").groupBy("id").agg(F.sort_array(F.collect_set("f")).alias("f"))
    data = rows.select("id", "fold", "stats", *classes).join(found, "id", "left").orderBy("id").collect()
    features = [np.array(r["f"] or [], np.int64) for r in data]
    stats = np.array([r["stats"] for r in data], float).reshape(len(data), STATS)
    y = np.array([[r[c] for c in classes] for r in data], int).reshape(len(data), len(classes))
    chain = train_chain(features, stats, y, width, np.array([r["fold"] for r in data], int), folds, use)
    # only words of the model of all rows have weights in it
    last = max(1, int(use[folds].sum()))
    chain["models"] = [(w[:last], v, b) for w, v, b in chain["models"]]
    return chain | {"vocab": {w: k for w, k in vocab.items() if use[folds, k]}, "categories": categories, "rows": len(data)}


def score_chain(docs: DataFrame, chain: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, p_<category> of each category, and the last category as a flag."""
    vocab, models, thresholds, names = chain["vocab"], chain["models"], chain["thresholds"], chain["categories"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            features = [np.array([vocab[w] for w in words_of(t) if w in vocab], np.int64) for t in texts]
            dense = np.array([stats_of(t) for t in texts], float).reshape(len(texts), STATS)
            ps = []
            for model in models:
                ps.append(proba(model, Rows(features, dense, max(1, len(vocab)))))
                dense = np.column_stack([dense, logit(ps[-1])])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p) for p in ps], pa.array(ps[-1] >= thresholds[-1])], ["id", *[f"p_{c}" for c in names], names[-1]])

    schema = "id long, " + ", ".join(f"p_{c} double" for c in names) + f", {names[-1]} boolean"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(score, schema).withColumnRenamed("id", id_col)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Scores of all docs by a chain fitted on their labelled rows; ``options`` as of fit_chain."""
    chain = fit_chain(docs, labels, id_col=id_col, text_col=text_col, **options)
    if not chain["rows"]:
        chain = chain | {"models": [(np.zeros(1), np.zeros(STATS + k), -30.0) for k in range(len(chain["categories"]))]}
    return score_chain(docs, chain, id_col=id_col, text_col=text_col)
