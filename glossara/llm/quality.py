"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Each text gives base counts and a transformed statistic vector.  For each language and source the location and scatter of
the vectors are estimated by minimum covariance determinant: from each of three deterministic starts (medians and quartile
ranges; mean and covariance; spatial signs) concentration steps keep the ``support`` share of rows with the smallest
Mahalanobis distances for as long as the determinant falls; the start that ends at the smallest determinant wins, and a
consistency factor and a reweighting step follow.  A row is rejected if its squared distance exceeds the chi-squared quantile
that a share ``tail`` of normal vectors exceeds (a corpus of 100 TB has some 10 ** 10 documents, hence 10 ** -9).

Most groups have statistics that are constant in more than half of their rows (no symbols at all, say), whose scatter would
be zero.  So the square of each statistic's resolution is added to the scatter's diagonal: how much it changes by one more
word, character, symbol, repeated line or repeated window in a text of the group's median length.  For log words and log
word length that is a hundredth of the usual spread; for a constant statistic it is the scale.

Groups with fewer than ``min_group`` rows (five for each statistic, below which a scatter says little) share one estimate
with the other small groups of their language, and those still too few one estimate for all; if that has fewer rows, too,
its rows are not judged, and stay.  Vectors are whole thousandths and their sums are whole numbers, so estimates are the
same however the rows are dealt; distances are ranked in steps of 1/64 of their logarithm, so a step of the estimation is
one aggregation to at most some thousand rows for each group, whatever the group's share of the corpus.

Defined cases: a null or empty text has zero counts and fails the base rules; null languages and sources are groups of
their own; estimates use rows that pass the base rules; with no such row nothing is kept; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import LOOKUP_ROWS, SPACE_PATTERN, cut, lookup

SYMBOLS = "[#*$%&|<>]"
#: Log words, log word length, log symbols and log repeated lines for 100 words, arc sine of the root of the repeated share.
DIMS = 5
STARTS = 3
#: Vectors that a task of an estimation step reads.
ROWS_A_TASK = 250_000
#: The determinant's logarithm falls by more than this, or a start has settled.
LEAST_FALL = 1e-9


def chi2_cdf(x: float, df: int) -> float:
    """Lower regularised gamma function at (df / 2, x / 2)."""
    a, t = df / 2, x / 2
    if t <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= t / k
        total += term
    return min(1.0, total * math.exp(a * math.log(t) - t - math.lgamma(a)))


def chi2_quantile(p: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def text_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed added."""
    own = [c for c in docs.columns]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumn("__w", F.filter(F.split(text, SPACE_PATTERN), lambda w: w != F.lit("")))
    n = F.size("__w")
    rows = rows.select(
        *own,
        "__w",
        F.when(n > 3, F.transform(F.slice("__w", F.lit(1), F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("__w", i + 1), F.get("__w", i + 2)))).alias("__h"),
    )
    # places of windows are needed only where some window occurs twice
    rows = rows.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("__s", lambda x, i: F.coalesce(F.get("__s", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("__s", i + 1)["h"] == x["h"], F.lit(False)))
    rows = rows.withColumn("__p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(F.transform("__p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("__p", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rows = rows.withColumn("__l", F.when(F.instr(text, "\n") > 0, lines))
    return rows.select(
        *own,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.coalesce(F.size("__l") - F.size(F.array_distinct("__l")), F.lit(0)).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def vector() -> list[Column]:
    """The transformed statistics in whole thousandths."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    xs = [F.log1p(n), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), F.log1p(100 * F.col("n_symbols") / n), F.log1p(100 * F.col("n_dup_lines") / n), F.asin(F.sqrt(F.least(F.col("n_repeat_words") / n, F.lit(1.0))))]
    return [F.round(1000 * x).cast("long") for x in xs]


def _q(i: int) -> str:
    return f"q{i}"


_PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]


def _sums() -> list[Column]:
    return [F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(DIMS)], *[F.sum(f"s{i}_{j}").alias(f"s{i}_{j}") for i, j in _PAIRS]]


def _moments(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(_q(i)).alias(f"s{i}") for i in range(DIMS)],
        *[F.sum(F.col(_q(i)) * F.col(_q(j))).alias(f"s{i}_{j}") for i, j in _PAIRS],
    )


def _factored(scatter: DataFrame, *own: str) -> DataFrame:
    """own, mean m0.., Cholesky factor l0_0.. of the scatter c0_0.. plus r0.. on its diagonal, and the logarithm of its determinant.

    The factor's entries are made one after the other by an array aggregation; as columns they would be one expression
    too large to compile.
    """
    row = lambda i: (i * (i + 1) / 2).cast("int")

    def entry(done: Column, at: Column) -> Column:
        i, j = at["i"], at["j"]
        dot = F.aggregate(F.zip_with(F.slice(done, row(i) + 1, j), F.slice(done, row(j) + 1, j), lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
        value = at["c"] - dot
        return F.concat(done, F.array(F.when(i == j, F.sqrt(F.greatest(value, F.lit(1e-12)))).otherwise(value / F.get(done, row(j) + j))))

    entries = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (F.col(f"c{i}_{j}") + (F.col(f"r{i}") if i == j else 0.0)).alias("c")) for i, j in _PAIRS])
    made = scatter.withColumn("l", F.aggregate(entries, F.array().cast("array<double>"), entry))
    made = made.select(*own, *_R, *[f"m{i}" for i in range(DIMS)], *[F.get("l", F.lit(k)).alias(f"l{i}_{j}") for k, (i, j) in enumerate(_PAIRS)])
    return made.withColumn("logdet", sum((2 * F.log(f"l{i}_{i}") for i in range(1, DIMS)), 2 * F.log("l0_0")))


_R = [f"r{i}" for i in range(DIMS)]
_MEAN_FACTOR = [f"m{i}" for i in range(DIMS)] + [f"l{i}_{j}" for i, j in _PAIRS] + ["logdet"]


def _scatter(factor: float) -> list[Column]:
    """m0.. and c0_0.. from sums in whole thousandths."""
    d = lambda c: F.col(c).cast("decimal(38,0)")
    n = F.col("n").cast("double")
    return [
        *[(F.col(f"s{i}") / n / 1000).alias(f"m{i}") for i in range(DIMS)],
        *[((d("n").cast("decimal(19,0)") * d(f"s{i}_{j}").cast("decimal(19,0)") - d(f"s{i}").cast("decimal(19,0)") * d(f"s{j}").cast("decimal(19,0)")).cast("double") / n / n * (factor / 1e6)).alias(f"c{i}_{j}") for i, j in _PAIRS],
    ]


def _distance(rows: DataFrame, estimate: DataFrame, n: int, how: str = "inner", *also: str) -> DataFrame:
    """rows with ``also`` of their estimates and the squared Mahalanobis distance d2 by forward substitution.  n: number of estimates."""
    made = lookup(rows, estimate, "grp", how, n)
    for i in range(DIMS):
        value = F.col(_q(i)) / 1000 - F.col(f"m{i}")
        for k in range(i):
            value = value - F.col(f"l{i}_{k}") * F.col(f"z{k}")
        made = made.withColumn(f"z{i}", value / F.col(f"l{i}_{i}"))
    return made.select(*rows.columns, *also, sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, DIMS)), F.col("z0") * F.col("z0")).alias("d2"))


def _small(estimates: DataFrame, n: int) -> DataFrame:
    """Estimates of n groups, broadcast where a counted table of that size may be."""
    return F.broadcast(estimates) if STARTS * n <= LOOKUP_ROWS else estimates


def resolutions() -> list[Column]:
    """Squared resolution of each statistic at the medians m0, m1 of log words and log word length."""
    n = F.expm1("m0")
    more = [F.log1p(1 / (n + 1)), F.log1p(1 / (n * F.exp("m1"))), F.log1p(100 / n), F.log1p(100 / n), F.asin(F.sqrt(F.least(F.lit(1.0), 6 / n)))]
    return [F.pow(x, F.lit(2)).alias(f"r{i}") for i, x in enumerate(more)]


def _starts(rows: DataFrame) -> tuple[DataFrame, int]:
    """Estimates of all starts, a row for each group and start, and their number."""
    quartiles = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n_all"), *[F.percentile(_q(i), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"p{i}") for i in range(DIMS)])
    first = quartiles.select(
        "grp", "n_all",
        *[(F.get(f"p{i}", F.lit(1)) / 1000).alias(f"m{i}") for i in range(DIMS)],
        *[(F.pow((F.get(f"p{i}", F.lit(2)) - F.get(f"p{i}", F.lit(0))) / 1349, F.lit(2)) if i == j else F.lit(0.0)).alias(f"c{i}_{j}") for i, j in _PAIRS],
    )
    first = cut(first.select("*", *resolutions()).coalesce(8))
    n = first.count()
    # spread of each statistic, and the directions from the medians in whole thousandths
    spread = first.select("grp", *_R, *[f"m{i}" for i in range(DIMS)], *[F.sqrt(F.col(f"c{i}_{i}") + F.col(f"r{i}")).alias(f"d{i}") for i in range(DIMS)])
    turned = lookup(rows, spread, "grp", n=n)
    turned = turned.select("*", *[((F.col(_q(i)) / 1000 - F.col(f"m{i}")) / F.col(f"d{i}")).alias(f"u{i}") for i in range(DIMS)])
    norm = F.greatest(F.sqrt(sum((F.col(f"u{i}") * F.col(f"u{i}") for i in range(1, DIMS)), F.col("u0") * F.col("u0"))), F.lit(1e-9))
    turned = turned.select("grp", *[F.col(_q(i)) for i in range(DIMS)], *[F.round(1000 * F.col(f"u{i}") / norm).cast("long").alias(f"t{i}") for i in range(DIMS)])
    sums = turned.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(_q(i)).alias(f"s{i}") for i in range(DIMS)], *[F.sum(F.col(_q(i)) * F.col(_q(j))).alias(f"s{i}_{j}") for i, j in _PAIRS],
        *[F.sum(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"t{i}_{j}") for i, j in _PAIRS])
    plain = sums.join(_small(first.select("grp", "n_all", *_R), n), "grp").select("grp", "n_all", *_R, *_scatter(1.0))
    signs = sums.select("grp", "n", *[f"t{i}_{j}" for i, j in _PAIRS]).join(_small(spread, n), "grp").withColumn("n_all", F.col("n"))
    signs = signs.select("grp", "n_all", *_R, *[f"m{i}" for i in range(DIMS)], *[(F.col(f"t{i}_{j}") / F.col("n") * (DIMS / 1e6) * F.col(f"d{i}") * F.col(f"d{j}")).alias(f"c{i}_{j}") for i, j in _PAIRS])
    names = ["grp", "n_all", *_R, *[f"m{i}" for i in range(DIMS)], *[f"c{i}_{j}" for i, j in _PAIRS]]
    every = functools.reduce(DataFrame.union, [x.select(F.lit(k).alias("start"), *names) for k, x in enumerate((first, plain, signs))])
    # no subset has been tried yet, so any determinant is a fall
    return cut(_factored(every, "grp", "start", "n_all").withColumn("logdet", F.lit(math.inf)).withColumn("moved", F.lit(True)).coalesce(8)), n


def fit(rows: DataFrame, support: float = 0.75, max_steps: int = 50) -> tuple[DataFrame, int]:
    """Robust estimates, one row for each grp: n_all, mean and Cholesky factor; and their number.  rows: grp, q0, q1, ..."""
    state, n = _starts(rows)
    consistent = support / chi2_cdf(chi2_quantile(support, DIMS), DIMS + 2)
    up_to = Window.partitionBy("grp", "start").orderBy("step")
    for _ in range(max_steps):
        live = state.where("moved")
        ranked = _distance(rows, live.select("grp", "start", *_MEAN_FACTOR), STARTS * n, "inner", "start").withColumn("step", F.floor(64 * F.log1p("d2")).cast("int"))
        counted = _moments(ranked, "grp", "start", "step").withColumn("upto", F.sum("n").over(up_to))
        was = _small(live.select("grp", "start", F.struct("n_all", *_R, *_MEAN_FACTOR).alias("was")), n)
        subset = counted.join(was, ["grp", "start"]).where(F.col("upto") - F.col("n") < support * F.col("was.n_all")).groupBy("grp", "start").agg(F.any_value("was").alias("was"), *_sums())
        tried = _factored(subset.select("grp", "start", "was", *[F.col(f"was.{r}") for r in _R], *_scatter(consistent)), "grp", "start", "was")
        fell = F.col("logdet") < F.col("was.logdet") - LEAST_FALL
        now = tried.select("grp", "start", "was.n_all", *_R, *[F.when(fell, F.col(c)).otherwise(F.col(f"was.{c}")).alias(c) for c in _MEAN_FACTOR], fell.alias("moved"))
        # a row for each group and start, written after each step: one plan of all steps would be very large
        state = cut(now.union(state.where("not moved").select(*now.columns)).coalesce(8))
        if not state.where("moved").limit(1).count():
            break
    best = state.groupBy("grp").agg(F.min_by(F.struct("n_all", *_R, *_MEAN_FACTOR), F.struct("logdet", "start")).alias("x")).select("grp", "x.*")
    best = cut(best.coalesce(8))
    inner = 0.975
    kept = _distance(rows, best.select("grp", *_MEAN_FACTOR), n).where(F.col("d2") <= chi2_quantile(inner, DIMS))
    final = _moments(kept, "grp").join(_small(best.select("grp", "n_all", *_R), n), "grp").select("grp", "n_all", *_R, *_scatter(inner / chi2_cdf(chi2_quantile(inner, DIMS), DIMS + 2)))
    return cut(_factored(final, "grp", "n_all").coalesce(8)), n


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, str] = ("lang", "source"), support: float = 0.75, min_group: int = 5 * DIMS, tail: float = 1e-9) -> DataFrame:
    """One row for each input row: id, the base counts, base_failed, d2 (squared distance; null if not judged), kept."""
    group = [F.to_json(F.struct(F.col(by[0]).alias("a"))).alias("g0"), F.to_json(F.struct(F.col(by[0]).alias("a"), F.col(by[1]).alias("b"))).alias("g1")]
    rows = text_counts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *group)).drop("text")
    rows = cut(rows.select("*", *[x.alias(_q(i)) for i, x in enumerate(vector())]))
    sizes = rows.where("not base_failed").groupBy("g0", "g1").agg(F.count(F.lit(1)).alias("n1"))
    rest = F.sum(F.when(F.col("n1") < min_group, F.col("n1"))).over(Window.partitionBy("g0"))
    named = F.when(F.col("n1") >= min_group, F.col("g1")).when(F.col("n0") >= min_group, F.col("g0")).otherwise(F.lit(""))
    sizes = cut(sizes.coalesce(8))
    names = cut(sizes.withColumn("n0", rest).select("g1", F.xxhash64(named).alias("grp")).coalesce(8))
    rows = lookup(rows, names, "g1", "left").drop("g0", "g1")
    vectors = rows.where("not base_failed").select("grp", *[_q(i) for i in range(DIMS)])
    # some 50 bytes a row, so a task of each step takes many
    total = sizes.agg(F.sum("n1")).first()[0] or 0
    estimate, n = fit(cut(vectors.coalesce(max(8, total // ROWS_A_TASK))), support)
    judged = _distance(rows, estimate.where(F.col("n_all") >= min_group).select("grp", *_MEAN_FACTOR), n, "left")
    return judged.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(~F.col("base_failed"), F.col("d2")).alias("d2"),
        (~F.col("base_failed") & F.coalesce(F.col("d2") <= chi2_quantile(1 - tail, DIMS), F.lit(True))).alias("kept"),
    )
