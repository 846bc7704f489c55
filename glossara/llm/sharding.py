"""Sharding by vector bin packing: bytes, tokens and rows of a group are balanced jointly.

A group is all rows of one text.  Groups, of one row or many, that weigh more than a 4096th of the corpus in some measure
(so fewer than 3 * 4096 of them) are placed first, largest first, each where the dot product of its vector with the
residual capacity is highest.  A group stays whole in one shard unless its bytes exceed a shard; then no law of bytes can
hold with it whole, and its rows are cut by their id into pieces of about a quarter of a shard.  All others, one entry for
each group, are dealt into buckets of about ``per_bucket`` groups by the hash of their text, and each bucket places its
groups, largest first, by the same rule against its share of what the shards have left.  No task sees more than one bucket,
and the buckets' errors, of about their smallest groups, do not add up in one direction.  Rows learn their group's shard
by a join and are numbered inside buckets of a shard.  Shards differ in bytes by no more than about the largest
row; a group of many short rows may take its shard's rows and tokens off the mean, as groups stay together.

Defined cases: a null text has no bytes and no tokens and forms one group with empty texts; rows are never dropped, also
those with a null or repeated id (the slots of rows without an id follow from the order in which they are read); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import buckets_for, cut, n_words, starts

BIG = 4096
#: Weights of bytes, tokens and rows in the dot product; the law that holds is that of bytes.
WEIGHTS = np.array([8.0, 1.0, 1.0])


def place(vectors: np.ndarray, residual: np.ndarray, capacity: np.ndarray, turn: int = 0) -> np.ndarray:
    """Shard of each vector: largest first, where the dot product with the residual capacity is highest.

    ``residual`` (shards x measures) is lowered in place.  Vectors and residuals are taken relative to ``capacity``.
    A shard that whole groups have filled beyond its share of tokens or rows counts as full in that measure, no worse.
    Equal products go to the shard that follows ``turn``.
    """
    scaled, left = vectors / capacity * WEIGHTS, residual / capacity * WEIGHTS
    chosen = np.empty(len(vectors), np.int32)
    n = len(left)
    left = np.roll(left, -(turn % n), axis=0)
    open_ = np.column_stack([left[:, :1], np.maximum(left[:, 1:], 0)])
    for i in np.argsort(-(vectors / capacity).max(axis=1), kind="stable"):
        v = scaled[i]
        at = int(np.argmax(open_ @ v))
        left[at] -= v
        open_[at] = left[at, 0], max(left[at, 1], 0.0), max(left[at, 2], 0.0)
        chosen[i] = at
    residual[:] = np.roll(left / WEIGHTS, turn % n, axis=0) * capacity
    return (chosen + turn % n) % n


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", per_bucket: int = 5_000) -> DataFrame:
    """One row for each input row: id, size (bytes + 1), tokens, text_crc32, shard, slot (gapless from 0 in each shard)."""
    binary = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = cut(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(binary) + 1).cast("long").alias("size"),
            n_words(F.col(text_col)).alias("tokens"),
            F.crc32(binary).alias("crc"),
            F.unhex(F.sha2(binary, 256)).alias("digest"),
            # rows without an id are told apart by where they stand, so they do not meet in one piece or bucket
            F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()).alias("salt"),
        )
    )
    groups = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum("tokens").alias("tokens"))
    groups = cut(groups)
    total = groups.agg(F.sum("size"), F.sum("tokens"), F.sum("n"), F.count(F.lit(1))).first()
    whole, n_groups = np.array([float(x or 0) for x in total[:3]]), int(total[3])
    n_rows = int(whole[2])
    capacity = np.maximum(whole / shards, 1.0)
    residual = np.tile(whole / shards, (shards, 1))

    # fewer than 3 * BIG groups can weigh more than a BIG-th of the corpus in one of three measures
    limit = [max(x / BIG, 1.0) for x in whole]
    big = groups.where((F.col("size") > limit[0]) | (F.col("tokens") > limit[1]) | (F.col("n") > limit[2])).orderBy("digest").collect()
    spark = docs.sparkSession
    # only bytes cut a group, and only above a shard
    cuts = [min(int(g["n"]), -(-4 * int(g["size"]) // int(capacity[0]))) if g["size"] > capacity[0] else 1 for g in big]
    table = F.broadcast(spark.createDataFrame([(bytes(g["digest"]), k, c) for k, (g, c) in enumerate(zip(big, cuts))], "digest binary, grp int, cuts int"))
    # rows of a cut group go to pieces by their id, so pieces are counted before they are placed: all groups together
    # have no more pieces than quarters of a shard that they fill
    own = rows.join(table, "digest").withColumn("piece", F.pmod(F.xxhash64("id", "salt"), F.col("cuts")).cast("int"))
    counted = own.groupBy("grp", "piece").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).orderBy("grp", "piece").collect()
    vectors = np.array([(p["size"], p["tokens"], p["n"]) for p in counted], float).reshape(-1, 3)
    given = place(vectors, residual, capacity) if len(counted) else []
    placed = spark.createDataFrame([(p["grp"], p["piece"], int(s)) for p, s in zip(counted, given)], "grp int, piece int, shard int")
    own = own.join(F.broadcast(placed), ["grp", "piece"])
    free = residual.copy()

    def of_bucket(key, pdf):
        pdf = pdf.sort_values("digest", kind="stable")
        vec = pdf[["size", "tokens", "n"]].to_numpy(float)
        share = vec.sum(axis=0) / np.maximum(free.sum(axis=0), 1e-9)
        return pd.DataFrame({"digest": pdf["digest"], "shard": place(vec, free * share, capacity * share[0], turn=int(key[0]))})

    # one row for each text: a bucket holds no rows of documents
    loose = groups.join(table, "digest", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets_for(n_groups, per_bucket))).cast("int"))
    spots = loose.groupBy("bucket").applyInPandas(of_bucket, "digest binary, shard int")
    # the large groups take no part in this shuffle, so no key has more than a BIG-th of the rows
    rest = rows.join(table, "digest", "left_anti").join(spots, "digest")
    out = own.select(*rows.columns, "shard").union(rest.select(*rows.columns, "shard"))

    # slots: rows are numbered in buckets of a shard, those without an id in buckets after all others
    n_buckets = buckets_for(n_rows, per_bucket)
    after = F.when(F.col("id").isNull(), F.lit(n_buckets)).otherwise(F.lit(0))
    out = out.withColumn("bucket", (F.pmod(F.xxhash64("id", "digest", "salt"), F.lit(n_buckets)) + after).cast("int"))
    local = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "digest", "salt")) - 1
    out = cut(out.select("id", "size", "tokens", "crc", "shard", "bucket", local.alias("local")))
    # a row for each bucket and shard
    offsets = starts(out.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")), "shard", "bucket", "n").drop("n")
    return out.join(offsets, ["bucket", "shard"]).select(
        F.col("id").alias(id_col), "size", "tokens", F.col("crc").alias("text_crc32"), "shard", (F.col("start") + F.col("local")).cast("long").alias("slot")
    )
