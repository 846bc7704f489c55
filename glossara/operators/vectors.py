"""Vector items and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import examples

MAX_RESULTS = 100


def items(words: DataFrame, separator: str = ";") -> DataFrame:
    """One item for a word, one for its definition, one for each example: id, original_id, content_type, text."""
    ex = examples(F.col("usage_examples"), separator)
    one = lambda kind, letter, text: F.struct(F.concat(F.lit(f"{letter}_"), F.col("id")).alias("id"), F.col("id").alias("original_id"), F.lit(kind).alias("content_type"), text.alias("text"))
    head = F.array(one("word", "w", F.col("term")), F.when(F.coalesce("definition", F.lit("")) != "", one("definition", "d", F.col("definition"))))
    rest = F.transform(ex, lambda x, i: F.struct(F.concat(F.lit("e_"), F.col("id"), F.lit("_"), i).alias("id"), F.col("id").alias("original_id"), F.lit("example").alias("content_type"), x.alias("text")))
    return words.select(F.explode(F.filter(F.concat(head, rest), lambda x: x.isNotNull())).alias("x")).select("x.*")


def original_id(item: Column) -> Column:
    return F.split_part(item, F.lit("_"), F.lit(2)).try_cast("long")


def upsert(items_: DataFrame, new: DataFrame, dim: int, order: str | None = None) -> DataFrame:
    """Items replaced by id; vectors must have ``dim`` values.

    Of several new rows of one id the one with the largest ``order`` counts (without it, the largest by its columns).
    Items without an id are neither replaced nor merged.
    """
    sized = new.withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.raise_error(F.lit(f"dimension is not {dim}"))))
    rest = [c for c in sized.columns if c not in ("id", order)]
    one = sized.where("id is not null").groupBy("id").agg(F.max(F.struct(*([order] if order else []), *rest)).alias("x")).select("id", *[F.col(f"x.{c}").alias(c) for c in sized.columns if c != "id"])
    one = one.select(*sized.columns).unionByName(sized.where("id is null")).select(*[c for c in sized.columns if c in items_.columns])
    return items_.join(one.select("id"), "id", "left_anti").unionByName(one)


def delete(items_: DataFrame, original: int) -> DataFrame:
    """Items but those of one word; items without an original id stay."""
    return items_.where(~F.col("original_id").eqNullSafe(F.lit(original)))


def _sum(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    if metric == "cosine":
        return 1 - _sum(a, b, lambda x, y: x * y) / (F.sqrt(_sum(a, a, lambda x, y: x * y)) * F.sqrt(_sum(b, b, lambda x, y: x * y)))
    if metric == "euclidean":
        return F.sqrt(_sum(a, b, lambda x, y: (x - y) * (x - y)))
    if metric == "dot":
        return -_sum(a, b, lambda x, y: x * y)
    if metric == "manhattan":
        return _sum(a, b, lambda x, y: F.abs(x - y))
    raise ValueError(f"unknown metric {metric!r}")


def search(vectors: DataFrame, vector: list[float], k: int = 10, metric: str = "cosine", where: dict | None = None, id_col: str = "vec_id", flip: bool = False) -> DataFrame:
    """The k nearest vectors; k stops at 100.  flip: 1 - distance, as where a backend gives similarities."""
    rows = vectors
    for name, value in (where or {}).items():
        if value is not None:
            rows = rows.where(F.col(name) == F.lit(value))
    d = distance(F.col("embedding"), F.array(*map(F.lit, vector)), metric)
    return rows.select(id_col, (1 - d if flip else d).alias("distance")).orderBy("distance", id_col).limit(min(k, MAX_RESULTS))


def search_all(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 1024, id_col: str = "vec_id") -> DataFrame:
    """(q, id, distance): the k rows nearest to each query row by Euclidean distance, of equals the smallest id.

    Queries (q, e) pass the driver in blocks of ``block``; each partition of ``vectors`` keeps its k nearest for each query
    of a block, and these are merged by query.  Rows without a vector take no part.
    """

    def of_block(ids: np.ndarray, e: np.ndarray) -> DataFrame:
        step = max(1, 4_000_000 // e.size)

        def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best, who = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
            for batch in batches:
                names, x = batch["id"].to_numpy(np.int64), np.array(batch["e"].tolist(), float)
                for a in range(0, len(x), step):
                    d = np.sqrt(((e[:, None, :] - x[None, a : a + step, :]) ** 2).sum(axis=2))
                    d, w = np.c_[best, d], np.c_[who, np.broadcast_to(names[a : a + step], d.shape)]
                    order = np.lexsort((w, d), axis=1)[:, :k]
                    best, who = np.take_along_axis(d, order, 1), np.take_along_axis(w, order, 1)
            found = np.isfinite(best)
            yield pd.DataFrame({"q": np.repeat(ids, found.sum(axis=1)), "id": who[found], "distance": best[found]})

        rows = vectors.where("embedding is not null").select(F.col(id_col).alias("id"), F.col("embedding").cast("array<double>").alias("e"))
        near = rows.mapInPandas(of, "q long, id long, distance double")
        # k rows for each partition and query
        nearest = near.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "id"))), 1, k).alias("x"))
        return nearest.select("q", F.explode("x").alias("x")).select("q", F.col("x.id").alias(id_col), "x.distance")

    out, held = [], []
    for row in queries.where("e is not null").orderBy("q").toLocalIterator():
        held.append(row)
        if len(held) >= block and held[-1]["q"] != held[-2]["q"]:  # rows that repeat an id stay in one block
            out.append(of_block(np.array([r["q"] for r in held[:-1]], np.int64), np.array([r["e"] for r in held[:-1]], float)))
            held = held[-1:]
    if held:
        out.append(of_block(np.array([r["q"] for r in held], np.int64), np.array([r["e"] for r in held], float)))
    empty = vectors.limit(0).select(F.col(id_col).alias("q"), F.col(id_col), F.lit(0.0).alias("distance"))
    return reduce(DataFrame.unionByName, out, empty)


def _let(value: Column, f) -> Column:
    """f(value) with the value computed once for each row."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """Deterministic stand-in for a model: signed counts of character trigrams, of unit length.

    The first 32 bits of a trigram's MD5 give its place (modulo dim) and its sign (the top bit).
    """
    code = lambda g: F.conv(F.substring(F.md5(g.cast("binary")), 1, 8), 16, 10).cast("long")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: code(F.lower(F.substr(text, i, F.lit(3)))))
    sign = lambda g: F.when(g < 2**31, 1.0).otherwise(-1.0)
    counts = lambda gs: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.aggregate(gs, F.lit(0.0), lambda s, g: s + F.when(F.pmod(g, F.lit(dim)) == d, sign(g)).otherwise(0.0)))
    norm = lambda r: F.sqrt(F.aggregate(r, F.lit(0.0), lambda s, x: s + x * x))
    return _let(grams, lambda gs: _let(counts(gs), lambda r: _let(norm(r), lambda n: F.transform(r, lambda x: (x / F.greatest(n, F.lit(1e-9))).cast("float")))))
