"""Aggregations over nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .graph import adjacency


def histogram(rows: DataFrame, kind: str = "relationship_type") -> DataFrame:
    return rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def top_types(rows: DataFrame, k: int = 10, kind: str = "relationship_type") -> DataFrame:
    """The k most common types, each with the number of types that are left out."""
    counts = histogram(rows, kind)
    return counts.crossJoin(F.broadcast(counts.agg(F.count(F.lit(1)).alias("all")))).withColumn("more", F.greatest(F.col("all") - k, F.lit(0))).drop("all").orderBy(F.desc("n"), kind).limit(k)


def by_dimension(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.coalesce("dimension", F.lit("unknown")).alias("dimension")).agg(F.count(F.lit(1)).alias("n"))


def node_dimensions(edges: DataFrame) -> DataFrame:
    """Nodes with edges of several dimensions, and those dimensions in order."""
    sets = adjacency(edges).groupBy(F.col("a").alias("id")).agg(F.array_sort(F.collect_set(F.coalesce("dimension", F.lit("unknown")))).alias("dimensions"))
    return sets.where(F.size("dimensions") > 1)


def top_per_dimension(edges: DataFrame, k: int = 1) -> DataFrame:
    counts = edges.groupBy("dimension", "relationship").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("dimension").orderBy(F.desc("n"), "relationship")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def dimension_pairs(edges: DataFrame) -> DataFrame:
    """Nodes for each unordered pair of dimensions; a node has at most as many as there are dimensions."""
    one = node_dimensions(edges)
    pairs = one.select("id", F.posexplode("dimensions").alias("i", "d1"), "dimensions").select("d1", F.explode(F.slice("dimensions", F.col("i") + 2, F.size("dimensions"))).alias("d2"))
    return pairs.groupBy(F.concat("d1", F.lit("_&_"), "d2").alias("pair")).agg(F.count(F.lit(1)).alias("n"))


def touched_nodes(edges: DataFrame, nodes: DataFrame, dimension: str) -> DataFrame:
    ids = adjacency(edges.where(F.col("dimension") == dimension)).select(F.col("a").alias("id"))
    return nodes.where("valence is not null").join(ids, "id", "left_semi")


def valence_distribution(edges: DataFrame, nodes: DataFrame, dimension: str) -> DataFrame:
    v = F.col("valence")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return touched_nodes(edges, nodes, dimension).agg(F.count(F.lit(1)).alias("n"), zero(F.avg(v)).alias("mean"), zero(F.min(v)).alias("low"), zero(F.max(v)).alias("high"))


def valence_extremes(edges: DataFrame, nodes: DataFrame, dimension: str, k: int = 5) -> DataFrame:
    rows = touched_nodes(edges, nodes, dimension).select("id", "term", "valence")
    top = rows.orderBy(F.desc("valence"), "id").limit(k).withColumn("side", F.lit("top"))
    return top.union(rows.orderBy("valence", "id").limit(k).withColumn("side", F.lit("bottom")))


def valence_distribution_legacy(edges: DataFrame, nodes: DataFrame, dimension: str) -> DataFrame:
    v = F.col("valence")
    return touched_nodes(edges, nodes, dimension).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_pop(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"))


def valence_bins(edges: DataFrame, nodes: DataFrame, dimension: str, bins: int = 7) -> DataFrame:
    rows = touched_nodes(edges, nodes, dimension)
    bin_ = F.least(F.lit(bins - 1), F.floor((F.col("valence") + 1) / 2 * bins))
    return rows.groupBy(bin_.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def valence_ratios(nodes: DataFrame, neutral: float = 0.1) -> DataFrame:
    v = F.col("valence")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return nodes.where("valence is not null").agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_pop(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"), share(v > neutral).alias("positive"), share(v < -neutral).alias("negative"), share(F.abs(v) <= neutral).alias("neutral"))


def types_per_word(relationships: DataFrame) -> DataFrame:
    return relationships.groupBy("word_id", F.coalesce("relationship_type", F.lit("unknown")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def merge_sources(rows: DataFrame) -> DataFrame:
    """rows(id, dims map, confidence): mean by dimension over the sources that have it, weighted by confidence."""
    parts = rows.select("id", "confidence", F.explode("dims").alias("dim", "value"))
    return parts.groupBy("id", "dim").agg((F.sum(F.col("value") * F.col("confidence")) / F.sum("confidence")).alias("value"))


def confusion(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows(predicted, actual) against labels(ord, label): TP, FP and FN of every label."""
    both = rows.groupBy("predicted", "actual").agg(F.count(F.lit(1)).alias("n"))
    hit = F.col("predicted") == F.col("actual")
    parts = both.select(F.explode(F.array(F.struct(F.col("predicted").alias("label"), F.when(hit, F.col("n")).otherwise(0).alias("tp"), F.when(hit, 0).otherwise(F.col("n")).alias("fp"), F.lit(0).cast("long").alias("fn")), F.struct(F.col("actual").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(hit, 0).otherwise(F.col("n")).alias("fn")))).alias("x")).select("x.*")
    sums = parts.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return labels.select("ord", "label").join(sums, "label", "left").fillna(0, ["tp", "fp", "fn"])


def scores(counts: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    rows = counts.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return rows.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def tuned_weights(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """Category weights after optimisation: unchanged below ten detections."""
    p = F.col("precision")
    new = F.when(F.col("tp") + F.col("fp") < 10, F.col("weight")).when(p < 0.5, F.greatest(F.lit(0.1), F.col("weight") * 0.9)).when(p > 0.8, F.least(F.lit(1.0), F.col("weight") * 1.1)).otherwise(F.col("weight"))
    return scored.join(labels.select("label", "weight"), "label").select("label", new.alias("weight"))


def operation_metrics(rows: DataFrame, op: str, value: str) -> DataFrame:
    return rows.groupBy(op).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.sum(value).alias("total"))


def rolling_mean(rows: DataFrame, value: str, order: list[str], by: list[str], last: int = 100) -> DataFrame:
    """Mean of the last ``last`` values up to each row, within ``by``."""
    return rows.withColumn("rolling", F.avg(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - last, 0)))


def last_rows(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)
