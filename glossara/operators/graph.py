"""Graph operators over nodes(id, term, valence, arousal) and edges(u, v, ...), u < v, one edge for each unordered pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..catalog import AFFECTIVE_COLORS, BASE_COLORS, DEFAULT_BIDIRECTIONAL, DEFAULT_COLOR, DEFAULT_WEIGHT, EMOTIONAL_COLORS
from ..scratch import fixed
from .numbering import numbered

META_TYPES = ["meta_emotion", "evokes", "responds_to", "intensifies", "diminishes", "emotional_component"]


def scan_words(words: DataFrame) -> DataFrame:
    return words.where("id is not null and term is not null").select("id", "term")


def scan_relationships(relationships: DataFrame) -> DataFrame:
    return relationships.dropna(subset=["word_id", "related_term", "relationship_type"])


def resolve(relationships: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relationships whose ends are both nodes (the related term in any case), without self-loops."""
    last = nodes.groupBy(F.lower("term").alias("k")).agg(F.max("id").alias("dst_id"))
    rows = relationships.join(nodes.select(F.col("id").alias("word_id")), "word_id", "left_semi").withColumn("k", F.lower("related_term"))
    return rows.join(last, "k").where("word_id <> dst_id").select(F.col("id").alias("rel_id"), F.col("word_id").alias("src_id"), "dst_id", "relationship_type")


def dimension(kind: Column, legacy: bool = False) -> Column:
    """Dimension of a relationship type: by the colour tables, or by prefixes (legacy)."""
    k = F.lower(kind)
    if legacy:
        emotional, affective = k.rlike("^(emotional_|evokes|responds_to|valence_|arousal_|meta_emotion|intensifies|diminishes)"), k.rlike("^(positive_|negative_|high_|low_)")
    else:
        emotional, affective = k.isin(list(EMOTIONAL_COLORS)), k.isin(list(AFFECTIVE_COLORS))
    return F.when(emotional, "emotional").when(affective, "affective").otherwise("lexical")


def category(kind: Column) -> Column:
    return F.when(kind.rlike("^(synonym|antonym|hypernym|hyponym)"), "lexical").when(kind.rlike("^(related_to|part_of|has_part)"), "semantic").when(kind.rlike("^(evokes|emotional_)"), "emotional").when(kind.rlike("^(positive_|negative_|high_|low_)"), "affective").otherwise("other")


def color(kind: Column, active: tuple[str, ...] = ("lexical",)) -> Column:
    table = dict(BASE_COLORS) | (EMOTIONAL_COLORS if "emotional" in active else {}) | (AFFECTIVE_COLORS if "affective" in active else {})
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.lower(kind)), F.lit(DEFAULT_COLOR))


def properties(rows: DataFrame, types: DataFrame, kind: str = "relationship_type", lower: bool = True) -> DataFrame:
    """rows with weight, color and bidirectional of their type; the defaults for unknown types."""
    known = F.broadcast(types.select(F.col("type").alias("__type"), "weight", "color", "bidirectional"))  # the type catalogue, some dozens of rows
    joined = rows.join(known, (F.lower(kind) if lower else F.col(kind)) == F.col("__type"), "left").drop("__type")
    return joined.withColumns({"weight": F.coalesce("weight", F.lit(DEFAULT_WEIGHT)), "color": F.coalesce("color", F.lit(DEFAULT_COLOR)), "bidirectional": F.coalesce("bidirectional", F.lit(DEFAULT_BIDIRECTIONAL))})


def decorate(resolved: DataFrame, types: DataFrame, legacy: bool = False) -> DataFrame:
    rows = properties(resolved, types)
    return rows.withColumn("dimension", dimension(F.col("relationship_type"), legacy)).withColumnRenamed("relationship_type", "relationship")


def collapse(rows: DataFrame, first: bool = False) -> DataFrame:
    """One edge for each unordered pair: the last relationship wins (a full build), or the first (an update).

    A max over structs is combined before the shuffle, which a window is not.
    """
    own = ["rel_id", "src_id", "dst_id", "relationship", "weight", "color", "bidirectional", "dimension"]
    pick = F.min if first else F.max
    return rows.groupBy(F.least("src_id", "dst_id").alias("u"), F.greatest("src_id", "dst_id").alias("v")).agg(pick(F.struct(*own)).alias("e")).select("u", "v", *[F.col(f"e.{c}").alias(c) for c in own])


def update(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """Edges of unordered pairs that the graph does not have yet, the first relationship of each."""
    return collapse(rows, first=True).join(edges.select("u", "v"), ["u", "v"], "left_anti")


def title(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    a, b = (nodes.select(F.col("id").alias(k), F.col("term").alias(t)) for k, t in (("src_id", "s_term"), ("dst_id", "d_term")))
    arrow = F.when(F.col("bidirectional"), F.lit(" ↔ ")).otherwise(F.lit(" → "))
    return edges.join(a, "src_id").join(b, "dst_id").withColumn("title", F.concat("relationship", F.lit(": "), "s_term", arrow, "d_term")).drop("s_term", "d_term")


def adjacency(edges: DataFrame) -> DataFrame:
    rest = [c for c in ("relationship", "weight", "dimension") if c in edges.columns]
    return edges.select(F.col("u").alias("a"), F.col("v").alias("b"), *rest).unionByName(edges.select(F.col("v").alias("a"), F.col("u").alias("b"), *rest))


def ends(edges: DataFrame, nodes: DataFrame, columns: tuple[str, ...] = ("term", "valence")) -> DataFrame:
    """Edges with the given node columns of both ends, as u_<column> and v_<column>."""
    out = edges
    for k in "uv":
        out = out.join(nodes.select(F.col("id").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in columns]), k)
    return out


def related_terms(edges: DataFrame, nodes: DataFrame, term: str, kind: str | None = None) -> DataFrame:
    adj = adjacency(edges)
    adj = adj if kind is None else adj.where(F.lower("relationship") == kind.lower())
    start = nodes.where(F.lower("term") == term.lower()).select(F.col("id").alias("a"))
    return adj.join(start, "a", "left_semi").join(nodes.select(F.col("id").alias("b"), "term"), "b").select("term", "relationship").distinct()


def k_hop(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(id, hops) of all nodes within ``depth`` edges of the start ids; the frontier alone is joined in each round."""
    if depth < 0:
        raise ValueError("depth must not be negative")
    adj = adjacency(edges).select("a", "b")
    adj = fixed(adj) if depth > 1 else adj
    seen = frontier = start.select(F.col("id").cast("long"), F.lit(0).alias("hops")).distinct()
    for hop in range(1, depth + 1):
        reached = frontier.join(adj, frontier["id"] == adj["a"]).select(F.col("b").alias("id")).distinct()
        frontier = reached.join(seen.select("id"), "id", "left_anti").select("id", F.lit(hop).alias("hops"))
        if hop < depth:
            frontier = fixed(frontier)
        seen = seen.union(frontier)
    return seen


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest node that can be reached, for each node with an edge to another; large-star and small-star
    steps in turn (Kiveris et al., 2014), so no machine holds a component."""
    stars, seen = fixed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), None
    for _ in range(max_rounds):
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        stars = stars.select(F.col("u").alias("w"), F.col("v").alias("u")).join(least, "u").select(F.col("w").alias("u"), F.least("u", "m").alias("v")).distinct()
        least = stars.groupBy("u").agg(F.min("v").alias("m"))
        stars = fixed(stars.join(least, "u").select("v", "m").where("v > m").union(least).toDF("u", "v").distinct())
        # sums of labels fall with every change
        now = stars.agg(F.count(F.lit(1)), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.col("u").cast("decimal(38,0)"))).first()
        if now == seen:
            return stars.toDF("id", "component").union(stars.select("v", "v")).distinct()
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    keep = ids.select("id")
    return edges.join(keep.withColumnRenamed("id", "u"), "u", "left_semi").join(keep.withColumnRenamed("id", "v"), "v", "left_semi")


def emotional_subgraph(edges: DataFrame, start: DataFrame, depth: int, types: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """Emotional edges of the k-hop subgraph with a weight of ``least`` or more."""
    edges = fixed(edges)
    rows = induced(edges, k_hop(edges, start, depth)).where(F.col("dimension") == "emotional").where(F.coalesce("weight", F.lit(0.0)) >= least)
    return rows if types is None else rows.where(F.col("relationship").isin(types))


def emotional_subgraph_legacy(edges: DataFrame, start: DataFrame, depth: int, types: list[str] | None = None, least: float = 0.0, factors: dict[str, float] | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Breadth-first through qualifying emotional edges only; weights grow with the largest factor named in type or terms."""
    own = edges.where("dimension = 'emotional'").where(F.col("weight") >= least)
    own = fixed(own if types is None else own.where(F.col("relationship").isin(types)))
    sub = induced(own, k_hop(own, start, depth))
    if factors:
        sub = ends(sub, nodes, ("term",))
        hit = [F.when(F.lower("relationship").contains(f) | F.lower("u_term").contains(f) | F.lower("v_term").contains(f), F.lit(w)) for f, w in factors.items()]
        best = F.coalesce(F.greatest(*hit, F.lit(None).cast("double")), F.lit(0.0))
        sub = sub.withColumns({"original_weight": F.col("weight"), "context_relevance": best, "weight": F.col("weight") * (1 + best)}).drop("u_term", "v_term")
    return sub


def apply_context(edges: DataFrame, nodes: DataFrame, factors: dict[str, float]) -> DataFrame:
    """Edges tagged with the first factor that is part of their type or of either term."""
    if any(not 0 <= w <= 1 for w in factors.values()):
        raise ValueError("context weights must be in [0, 1]")
    rows = ends(edges, nodes, ("term",))
    tag = F.coalesce(*[F.when(F.lower("relationship").contains(f) | F.lower("u_term").contains(f) | F.lower("v_term").contains(f), F.struct(F.lit(f).alias("context"), F.lit(w).alias("context_weight"))) for f, w in factors.items()])
    return rows.withColumn("tag", tag).where("tag is not null").select("u", "v", "relationship", "tag.context", "tag.context_weight")


def transitions(edges: DataFrame, nodes: DataFrame, length: int = 2, least: float = 0.1) -> DataFrame:
    """Simple paths of up to ``length`` emotional edges, both directions, with the product of weights of ``least`` or more.

    Where no weight is above 1, a prefix below the limit is dropped before the next join.
    """
    adj = fixed(adjacency(edges.where("dimension = 'emotional'")).select("a", "b", F.coalesce("weight", F.lit(0.1)).alias("w")))
    prune = F.lit(bool(adj.where("w > 1").limit(1).count())) | (F.col("strength") >= least)
    level = adj.withColumn("strength", F.col("w")).where(prune).select(F.col("a").alias("start"), F.col("b").alias("end"), F.array("a", "b").alias("path"), F.col("w").alias("strength"))
    out = level
    for _ in range(length - 1):
        level = level.join(adj, level["end"] == adj["a"]).where(~F.array_contains("path", F.col("b"))).select("start", F.col("b").alias("end"), F.concat("path", F.array("b")).alias("path"), (F.col("strength") * F.col("w")).alias("strength")).where(prune)
        out = out.union(level)
    out = out.where(F.col("strength") >= least)
    value = lambda k: nodes.select(F.col("id").alias(k), F.coalesce("valence", F.lit(0.0)).alias(f"{k}_valence"))
    return out.join(value("start"), "start").join(value("end"), "end").withColumn("valence_shift", F.col("end_valence") - F.col("start_valence"))


def transitions_legacy(edges: DataFrame, nodes: DataFrame, max_nodes: int = 3, least: float = 0.3) -> DataFrame:
    """Paths of fewer than ``max_nodes`` nodes over all edges between nodes that have valence and arousal."""
    adj = adjacency(edges).select("a", "b", F.coalesce("weight", F.lit(1.0)).alias("w"), "relationship")
    level = adj.where(F.col("w") >= least).select(F.col("a").alias("start"), F.col("b").alias("end"), F.array("a", "b").alias("path"), F.col("w").alias("strength"), F.array("relationship").alias("kinds"))
    out = level
    for _ in range(max_nodes - 3):
        level = level.join(adj, level["end"] == adj["a"]).where(~F.array_contains("path", F.col("b"))).select("start", F.col("b").alias("end"), F.concat("path", F.array("b")).alias("path"), (F.col("strength") * F.col("w")).alias("strength"), F.concat("kinds", F.array("relationship")).alias("kinds")).where(F.col("strength") >= least)
        out = out.union(level)
    felt = nodes.where("valence is not null and arousal is not null")
    for k in ("start", "end"):
        out = out.join(felt.select(F.col("id").alias(k), F.col("valence").alias(f"{k}_valence"), F.col("arousal").alias(f"{k}_arousal")), k)
    return out.withColumns({"valence_shift": F.col("end_valence") - F.col("start_valence"), "arousal_shift": F.col("end_arousal") - F.col("start_arousal")})


def meta_patterns(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Emotional edges of meta types, by the term of their first node."""
    return ends(edges.where((F.col("dimension") == "emotional") & F.col("relationship").isin(META_TYPES)), nodes).select(F.col("u_term").alias("source"), F.col("v_term").alias("target"), "relationship", "weight")


def meta_patterns_legacy(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Both directions, any dimension, where both ends are emotional (by their values or an emotional edge)."""
    touched = adjacency(edges.where("dimension = 'emotional'")).select(F.col("a").alias("id"))
    felt = nodes.where("valence is not null or arousal is not null").select("id").union(touched).distinct()
    kinds = [t for t in META_TYPES if t != "responds_to"]
    rows = induced(edges.where(F.col("relationship").isin(kinds)), felt)
    both = adjacency(rows)
    return both.join(nodes.select(F.col("id").alias("a"), F.col("term").alias("source")), "a").join(nodes.select(F.col("id").alias("b"), F.col("term").alias("target")), "b").select("source", "target", "relationship", "weight")


def affective_transitions(edges: DataFrame, nodes: DataFrame, k: int = 10) -> DataFrame:
    """Directed pairs by weight * |valence change| above 0.01, the k strongest."""
    value = lambda c: nodes.where("valence is not null").select(F.col("id").alias(c), F.col("valence").alias(f"{c}_valence"))
    rows = adjacency(edges).join(value("a"), "a").join(value("b"), "b").withColumn("shift", F.col("b_valence") - F.col("a_valence")).where(F.abs("shift") > 0.01)
    return rows.withColumn("impact", F.col("weight") * F.abs("shift")).orderBy(F.desc("impact"), "a", "b").limit(k)


def degrees(edges: DataFrame) -> DataFrame:
    return adjacency(edges).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def node_size(edges: DataFrame, nodes: DataFrame, low: float = 5.0, high: float = 30.0) -> DataFrame:
    found = nodes.select("id").join(degrees(edges), "id", "left").fillna(0, ["degree"])
    most = found.agg(F.max("degree").alias("most"))
    size = low + (high - low) * F.col("degree") / F.greatest(F.lit(1), F.col("most"))
    return found.crossJoin(F.broadcast(most)).select("id", "degree", F.greatest(F.lit(low), F.least(F.lit(high), size)).alias("size"))  # one row is broadcast


def edge_width(weight: Column, low: float = 0.5, high: float = 5.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), low + (high - low) * F.coalesce(weight, F.lit(0.5))))


def node_color(valence: Column) -> Column:
    return F.when(valence.isNull(), "#6666ff").when(valence > 0.5, "#00cc66").when(valence < -0.5, "#cc3300").when(valence > 0.1, "#90EE90").when(valence < -0.1, "#FFA07A").otherwise("#cccccc")


def tooltip(term: Column, id_: Column, valence: Column, arousal: Column) -> Column:
    number = lambda name, x: F.when(x.isNotNull(), F.concat(F.lit(f"{name}: "), F.format_string("%.2f", F.round(F.round(x, 6), 2))))
    return F.concat_ws("\n", F.concat(F.lit("Term: "), term), F.concat(F.lit("ID: "), id_), number("Valence", valence), number("Arousal", arousal))


def edge_style(kind: Column, bidirectional: Column) -> list[Column]:
    return [F.when(kind == "emotional", "dashed").when(kind == "affective", "dotted").otherwise("solid").alias("style"), (~bidirectional).alias("arrow")]


def circular_layout(nodes: DataFrame) -> DataFrame:
    """Positions on the unit circle in the order of ids."""
    every = nodes.agg(F.count(F.lit(1)).alias("all"))  # one row is broadcast
    rows = numbered(nodes.select("id"), "id").crossJoin(F.broadcast(every))
    angle = 2 * F.pi() * F.col("place") / F.col("all")
    return rows.select("id", F.cos(angle).alias("x"), F.sin(angle).alias("y"))


def neighbour_means(new: DataFrame, edges: DataFrame, positions: DataFrame) -> DataFrame:
    """Start positions of new nodes: the mean of placed neighbours (without the noise), else the origin."""
    near = adjacency(edges).join(positions.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return new.select("id").join(near, "id", "left").fillna(0.0, ["x", "y"])
