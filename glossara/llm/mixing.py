"""Mixing sources to target weights.

The words of each source, in an order that follows from the document ids alone, form one stream that is cut into blocks
of ``block_words``.  A source is given as many slots as bring its words nearest to its target; each output shard draws
its source counts from a multinomial over the slots that are still to be given out, and the last shard takes what is
left, so totals hold exactly.  Slot j of a source with m blocks stands for place j mod m of a pseudorandom permutation of
the block indexes, another one for each pass j div m (a swap-or-not shuffle, which works for any m without a table), and
blocks are joined to slots by index.  As no source gets more than ``cap`` times its blocks, no block is used more often.

Targets: all sizes together times ``share``, dealt by weight (sources by code point, null last, take ``weights`` in turn);
a target stops at ``cap`` times its source's size and the excess is dealt again by weight among the others.

The driver holds one row for each source and its draws, for at most ``max_sources`` sources; more are an error, not a
smaller mix.

Defined cases: a null text has no words and takes part with size 0; null sources are one source; null and repeated ids
keep their rows (rows without an id and of one size are copies that follow each other in the stream); sources without words have target 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACE_PATTERN, cut, lookup, n_words, repeats, starts, text_digest

CHUNK = 65_536
#: Rows of a source that one task sums up.
PER_BUCKET = 500


def targets(sizes: list[int], weights: list[float], cap: float, total: float) -> list[float]:
    """Water filling: no target above cap times its size."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_:
        shares = {k: left * weights[k] / sum(weights[i] for i in open_) for k in open_}
        full = [k for k in open_ if shares[k] > cap * sizes[k]]
        if not full:
            for k in open_:
                out[k] = shares[k]
            break
        for k in full:
            out[k] = float(cap * sizes[k])
            left -= out[k]
            open_.remove(k)
    return out


def draw(quota: list[int], shards: int, seed: int) -> np.ndarray:
    """Source counts (shards x sources): multinomial draws from what is left, of equal shard sizes; columns sum to quota."""
    rng, left = np.random.default_rng(seed), np.array(quota, np.int64)
    out = np.zeros((shards, len(quota)), np.int64)
    for k in range(shards):
        n = int(left.sum()) // (shards - k)
        if k == shards - 1:
            out[k] = left
        while k < shards - 1 and n > out[k].sum():
            free = left - out[k]
            got = rng.multinomial(n - int(out[k].sum()), free / free.sum())
            out[k] += np.minimum(got, free)
        left -= out[k]
    return out


def permuted(x: Column, m: Column, seed: int, source: Column, epoch: Column, rounds: int = 16) -> Column:
    """Place of x in a pseudorandom permutation of 0..m-1 (Hoang, Morris and Rogaway, "An Enciphering Scheme Based on a Card Shuffle", 2012)."""
    keys = F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda r: F.pmod(F.xxhash64(F.lit(seed), source, epoch, r), m))

    def swap(state: Column, key: Column) -> Column:
        other = F.pmod(key - state, m)
        return F.when(F.xxhash64(F.greatest(state, other), key, F.lit(seed)).bitwiseAND(F.lit(1)) == 1, other).otherwise(state)

    return F.aggregate(keys, x, swap)


def _streams(docs: DataFrame, id_col: str, text_col: str, source_col: str, max_sources: int, key: tuple[str, ...] = ()):
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), *key))
    # one row for each source, no more than max_sources
    sums = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("id").isNull()).alias("unnamed")).limit(max_sources + 1).collect()
    if len(sums) > max_sources:
        raise ValueError(f"more than {max_sources} sources: mix by a coarser column, or raise max_sources with the driver's memory")
    sums = sorted(sums, key=lambda r: (r["source"] is None, r["source"] or ""))
    return rows, sums


def _copies(runs: DataFrame) -> DataFrame:
    """A row for each copy of a run, one after the other in the stream; long runs are dealt out in chunks first."""
    chunks = runs.withColumn("__c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(CHUNK).cast("long"))))
    chunks = chunks.repartition("src", "start", "size", "__c")
    copies = chunks.withColumn("__k", F.explode(F.sequence(F.col("__c"), F.least(F.col("__c") + CHUNK, F.col("copies")) - 1)))
    return copies.withColumn("start", F.col("start") + F.col("__k") * F.col("size")).drop("__c", "__k")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, share: float = 1.0, block_words: int = 128, shards: int = 64, seed: int = 20_240, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_sources: int = 100_000, key: tuple[str, ...] = ()) -> DataFrame:
    """One row for each input row: id, size, source_size, target, taken, and blocks: array of (at, n, uses), the words at..at+n of the document that each block takes, and how often.

    ``key``: further columns, given back at the end, that tell rows without an id or with a repeated one apart.
    """
    spark = docs.sparkSession
    rows, sums = _streams(docs, id_col, text_col, source_col, max_sources, key)
    sizes = [int(r["size"]) for r in sums]
    goal = targets(sizes, [weights[k % len(weights)] for k in range(len(sums))], cap, share * sum(sizes))
    blocks = [-(-s // block_words) for s in sizes]
    quota = [min(cap * m, round(t * m / s)) if s else 0 for t, m, s in zip(goal, blocks, sizes)]
    plan = draw(quota, shards, seed)
    before = np.cumsum(plan, axis=0) - plan
    # one row for each source; slots are made from chunks that are dealt out first
    plan_rows = [(k, blocks[k], before[:, k].tolist(), plan[:, k].tolist()) for k in range(len(sums)) if quota[k]]
    drawn = spark.createDataFrame(plan_rows, "src int, m long, j0 array<long>, n array<long>")
    chunks = drawn.select("src", "m", F.explode(F.arrays_zip("j0", "n")).alias("x")).where("x.n > 0")
    chunks = chunks.select("src", "m", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("x.n") - 1, F.lit(CHUNK).cast("long"))).alias("c"))
    chunks = chunks.select("src", "m", (F.col("x.j0") + F.col("c")).alias("j"), F.least(F.lit(CHUNK), F.col("x.n") - F.col("c")).alias("n"))
    chunks = chunks.repartition(max(8, min(4096, sum(quota) // CHUNK)), "src", "j")
    slots = chunks.select("src", "m", F.explode(F.sequence(F.col("j"), F.col("j") + F.col("n") - 1)).alias("j"))
    place = permuted(F.col("j") % F.col("m"), F.col("m"), seed, F.col("src"), F.floor(F.col("j") / F.col("m")).cast("long"))
    # Spark's estimate for what is made from the small plan table knows nothing of its slots, so the join below is told
    # not to broadcast it
    uses = slots.select("src", place.alias("block")).groupBy("src", "block").agg(F.count(F.lit(1)).alias("uses"))

    # a source's rows are dealt to buckets by their number, so one source is as many tasks as it has rows for
    named = spark.createDataFrame([(k, r["source"], sizes[k], goal[k], -(-int(r["n"]) // PER_BUCKET)) for k, r in enumerate(sums)], "src int, source string, source_size long, target double, buckets long")
    rows = lookup(rows, named, "source", n=len(sums)).drop("source")
    unnamed = any(r["unnamed"] for r in sums)
    if unnamed:
        # rows without an id that nothing else tells apart are one run of copies, so they do not meet in one bucket
        runs = rows.where("id is null").groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))
        rows = rows.where("id is not null").withColumn("copies", F.lit(1).cast("long")).unionByName(runs)
    else:
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    dealt = F.when(F.col("id").isNull(), F.xxhash64("id", "size", *key)).otherwise(F.xxhash64("id", "size"))
    rows = rows.withColumn("bucket", F.pmod(dealt, F.col("buckets"))).drop("buckets")
    upto = Window.partitionBy("src", "bucket").orderBy("id", "size", *key).rowsBetween(Window.unboundedPreceding, -1)
    words = F.sum(F.col("size") * F.col("copies"))
    rows = cut(rows.withColumn("inner", F.coalesce(words.over(upto), F.lit(0))))
    outer = starts(rows.groupBy("src", "bucket").agg(words.alias("sum")), "src", "bucket", "sum").drop("sum")
    rows = rows.join(outer, ["src", "bucket"]).withColumn("start", F.col("start") + F.col("inner")).drop("inner", "bucket")
    if unnamed:
        rows = cut(rows.where("id is not null").unionByName(_copies(rows.where("id is null"))))
    rows = rows.drop("copies")
    size = F.lit(block_words)
    first, last = F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("size") - 1) / size)
    pieces = rows.where("size > 0").select("src", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    low, high = F.greatest(F.col("start"), F.col("block") * size), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * size)
    pieces = pieces.select("src", "start", "block", (low - F.col("start")).alias("at"), (high - low).alias("n")).join(uses.hint("merge"), ["src", "block"])
    of_doc = pieces.groupBy("src", "start").agg(F.sum(F.col("n") * F.col("uses")).alias("taken"), F.sort_array(F.collect_list(F.struct("at", "n", "uses"))).alias("blocks"))
    out = rows.join(of_doc.withColumn("worded", F.lit(True)), (rows["src"] == of_doc["src"]) & (rows["start"] == of_doc["start"]) & (rows["size"] > 0), "left").drop(of_doc["src"]).drop(of_doc["start"])
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "blocks", *key)


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", cap: int = 3, **options) -> DataFrame:
    """The mix as documents, with the columns of docs: one row for each pass over a document, up to ``cap``.

    A pass whose blocks all take part is the whole text as it is; otherwise it holds the words of the blocks that do,
    joined by one space, and ``length_col`` (if the table has it) is counted again.  Rows are told apart by id, text
    digest and, where these repeat, their number among such rows in the order of the other columns.
    """
    names = docs.columns
    nth = F.lit(0)
    if repeats(docs, id_col, text_col):
        nth = F.row_number().over(Window.partitionBy(id_col, "__digest").orderBy(*[F.col(c).asc_nulls_first() for c in names]))
    docs = docs.withColumn("__digest", text_digest(text_col)).withColumn("__nth", nth)
    key = ("__digest", "__nth")
    plan = mix(docs, id_col=id_col, text_col=text_col, cap=cap, key=key, **options).where("taken > 0").select(F.col(id_col).alias("__id"), F.col("size").alias("__size"), F.col("blocks").alias("__blocks"), *[F.col(c).alias(f"{c}_") for c in key])
    both = docs.join(plan, F.col("__id").eqNullSafe(docs[id_col]) & (F.col("__digest") == F.col("__digest_")) & (F.col("__nth") == F.col("__nth_"))).withColumn("__pass", F.explode(F.sequence(F.lit(1), F.array_max(F.transform("__blocks", lambda b: b["uses"])).cast("int"))))
    both = both.withColumn("__taken", F.filter("__blocks", lambda b: b["uses"] >= F.col("__pass")))
    whole = F.aggregate("__taken", F.lit(0).cast("long"), lambda a, b: a + b["n"]) == F.col("__size")
    words = F.filter(F.split(F.col(text_col), SPACE_PATTERN), lambda w: w != F.lit(""))
    both = both.withColumn("__words", F.when(~whole, words))
    part = F.array_join(F.flatten(F.transform("__taken", lambda b: F.slice("__words", (b["at"] + 1).cast("int"), b["n"].cast("int")))), " ")
    both = both.withColumn("__text", F.when(F.col("__words").isNull(), F.col(text_col)).otherwise(part))
    new = {text_col: F.col("__text").alias(text_col)}
    if length_col and length_col in names:
        new[length_col] = F.when(F.col("__words").isNull(), F.col(length_col)).otherwise(F.length("__text")).cast(docs.schema[length_col].dataType).alias(length_col)
    return both.select(*[new.get(c, F.col(c)) for c in names])
