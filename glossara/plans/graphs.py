"""Queries over the relationship graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import AFFECTIVE_COLORS, BASE_COLORS, EMOTIONAL_COLORS
from ..operators import graph, stats
from ..scratch import fixed
from .registry import query

START = "small ring 0"
_ROUND = lambda c: F.round(c, 6) + 0.0  # noqa: E731  no negative zeros
EDGE = ("u", "v", "relationship", "weight", "color", "bidirectional", "dimension")


def _sql_list(keys) -> str:
    return ", ".join(f"'{k}'" for k in keys)


def _start(v, *ids):
    return v.nodes.where(F.col("id").isin(*(ids or (0,)))).select("id")


def hops_sql(depth: int, edges: str = "adj") -> str:
    # each step stands once: without MATERIALIZED DuckDB puts it in wherever it is named
    parts = ["h0 AS MATERIALIZED (SELECT id FROM nodes WHERE id = 0)"]
    for k in range(1, depth + 1):
        parts.append(f"h{k} AS MATERIALIZED (SELECT id FROM h{k - 1} UNION SELECT b FROM {edges} JOIN h{k - 1} ON a = id)")
    return ", ".join(parts)


query("s02_graph_scan_words", "SELECT id, term FROM words WHERE id IS NOT NULL AND term IS NOT NULL")(lambda v: graph.scan_words(v.words))
query("s03_graph_scan_relationships", "SELECT * FROM relationships WHERE word_id IS NOT NULL AND related_term IS NOT NULL AND relationship_type IS NOT NULL")(lambda v: graph.scan_relationships(v.relationships))
query("j04_edge_resolution", "SELECT rel_id, src_id, dst_id, relationship_type FROM resolved")(lambda v: v.resolved)
query("g01_build_graph", "SELECT u, v, relationship, weight, color, bidirectional, dimension, concat(relationship, ': ', s.term, CASE WHEN bidirectional THEN ' ↔ ' ELSE ' → ' END, d.term) AS title FROM edges JOIN nodes s ON s.id = src_id JOIN nodes d ON d.id = dst_id")(lambda v: graph.title(v.edges, graph.scan_words(v.words)).select(*EDGE, "title"))


@query("g02_incremental_update", """SELECT least(src_id, dst_id) AS u, greatest(src_id, dst_id) AS v, relationship, weight FROM decorated d
WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src_id % 10 <> 0 AND e.u = least(d.src_id, d.dst_id) AND e.v = greatest(d.src_id, d.dst_id))
QUALIFY row_number() OVER (PARTITION BY least(src_id, dst_id), greatest(src_id, dst_id) ORDER BY rel_id) = 1""")
def _(v):
    old = v.edges.where("src_id % 10 <> 0")
    return graph.update(old, graph.decorate(v.resolved, v.types, legacy=True)).select("u", "v", "relationship", "weight")


@query("g03_add_node", """, fresh AS (SELECT DISTINCT lower(trim(item)) AS k FROM queue) SELECT (SELECT max(id) FROM words) + row_number() OVER (ORDER BY k) AS id, k AS term FROM fresh WHERE k NOT IN (SELECT lower(term) FROM words)""")
def _(v):
    from ..operators.store import add_terms

    return add_terms(v.nodes.select("id", "term"), v.queue.select(F.lower(F.trim("item")).alias("term")))


@query("g04_add_relationship", """SELECT u, v, coalesce(n.kind, relationship) AS relationship FROM (SELECT u, v, relationship FROM edges UNION ALL SELECT 0, 1, 'synonym' WHERE NOT EXISTS (SELECT 1 FROM edges WHERE u = 0 AND v = 1)) LEFT JOIN (VALUES (0, 1, 'synonym')) n(a, b, kind) ON u = a AND v = b""")
def _(v):
    new = v.spark.createDataFrame([(1, 0, "synonym")], "a long, b long, relationship string")
    own = new.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "relationship").where("u <> v")
    return v.edges.select("u", "v", "relationship").join(own.select("u", "v"), ["u", "v"], "left_anti").unionByName(own)


query("g05_related_terms", f"SELECT DISTINCT n.term, relationship FROM adj JOIN nodes n ON n.id = b WHERE a IN (SELECT id FROM nodes WHERE lower(term) = '{START}')")(lambda v: graph.related_terms(v.edges, v.nodes, START.upper()))
query("g05_related_terms_typed", f"SELECT DISTINCT n.term, relationship FROM adj JOIN nodes n ON n.id = b WHERE lower(relationship) = 'custom_link' AND a IN (SELECT id FROM nodes WHERE lower(term) = '{START}')")(lambda v: graph.related_terms(v.edges, v.nodes, START, "CUSTOM_LINK"))
query("g06_k_hop_nodes", f", {hops_sql(2)} SELECT id FROM h2")(lambda v: graph.k_hop(v.edges, _start(v), 2).select("id"))
query("g06_k_hop", f", {hops_sql(2)} SELECT u, v, relationship FROM edges WHERE u IN (SELECT id FROM h2) AND v IN (SELECT id FROM h2)")(lambda v: (lambda e: graph.induced(e, graph.k_hop(e, _start(v), 2)))(fixed(v.edges.select("u", "v", "relationship"))))
query("g07_emotional_subgraph", f", {hops_sql(2)} SELECT u, v, relationship, weight FROM edges WHERE u IN (SELECT id FROM h2) AND v IN (SELECT id FROM h2) AND dimension = 'emotional' AND weight >= 0.6")(lambda v: graph.emotional_subgraph(v.edges, _start(v), 2, least=0.6).select("u", "v", "relationship", "weight"))


@query("g07l_emotional_subgraph_legacy", f""", emo AS MATERIALIZED (SELECT a, b FROM adj WHERE dimension = 'emotional' AND weight >= 0.6), {hops_sql(3, "emo")}
SELECT e.u, e.v, round(weight * (1 + rel), 6) AS weight, weight AS original_weight, rel AS context_relevance FROM (
  SELECT u, v, weight, CASE WHEN relationship LIKE '%evok%' OR a.term LIKE '%evok%' OR b.term LIKE '%evok%' THEN 0.4::DOUBLE WHEN a.term LIKE '%blue%' OR b.term LIKE '%blue%' THEN 0.2::DOUBLE ELSE 0::DOUBLE END AS rel
  FROM edges JOIN nodes a ON a.id = u JOIN nodes b ON b.id = v WHERE dimension = 'emotional' AND weight >= 0.6 AND u IN (SELECT id FROM h3) AND v IN (SELECT id FROM h3)) e""")
def _(v):
    sub = graph.emotional_subgraph_legacy(v.edges, _start(v), 3, least=0.6, factors={"evok": 0.4, "blue": 0.2}, nodes=v.nodes)
    return sub.select("u", "v", _ROUND("weight").alias("weight"), "original_weight", "context_relevance")


query("g09_meta_patterns", f"SELECT a.term AS source, b.term AS target, relationship, weight FROM edges JOIN nodes a ON a.id = u JOIN nodes b ON b.id = v WHERE dimension = 'emotional' AND relationship IN ({_sql_list(graph.META_TYPES)})")(lambda v: graph.meta_patterns(v.edges, v.nodes))
query("g09l_meta_patterns_legacy", f", felt AS (SELECT id FROM nodes WHERE valence IS NOT NULL OR arousal IS NOT NULL UNION SELECT a FROM adj WHERE dimension = 'emotional') SELECT x.term AS source, y.term AS target, relationship, weight FROM adj JOIN nodes x ON x.id = a JOIN nodes y ON y.id = b WHERE relationship IN ({_sql_list(t for t in graph.META_TYPES if t != 'responds_to')}) AND a IN (SELECT id FROM felt) AND b IN (SELECT id FROM felt)")(lambda v: graph.meta_patterns_legacy(v.edges, v.nodes))
query("g10l_apply_context", "SELECT u, v, relationship, CASE WHEN relationship LIKE '%intens%' THEN 'intens' ELSE 'gear' END AS context, CASE WHEN relationship LIKE '%intens%' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS context_weight FROM edges JOIN nodes a ON a.id = u JOIN nodes b ON b.id = v WHERE lower(relationship) LIKE '%intens%' OR a.term LIKE '%intens%' OR b.term LIKE '%intens%' OR a.term LIKE '%gear%' OR b.term LIKE '%gear%'")(lambda v: graph.apply_context(v.edges, v.nodes, {"intens": 0.7, "gear": 0.3}))

_PATHS = """, e AS (SELECT a, b, weight AS w FROM adj WHERE dimension = 'emotional'),
paths AS (SELECT a AS s, b AS t, concat(a, '-', b) AS path, w AS strength FROM e WHERE w >= 0.45
  UNION ALL SELECT x.a, y.b, concat(x.a, '-', x.b, '-', y.b), x.w * y.w FROM e x JOIN e y ON x.b = y.a AND y.b <> x.a WHERE x.w >= 0.45 AND x.w * y.w >= 0.45)"""


@query("g12_transitions", f"{_PATHS} SELECT path, round(strength, 6) AS strength, round(coalesce(n.valence, 0) - coalesce(m.valence, 0), 6) + 0 AS valence_shift FROM paths JOIN nodes m ON m.id = s JOIN nodes n ON n.id = t")
def _(v):
    return graph.transitions(v.edges, v.nodes, 2, 0.45).select(F.array_join(F.col("path").cast("array<string>"), "-").alias("path"), _ROUND("strength").alias("strength"), _ROUND("valence_shift").alias("valence_shift"))


@query("g12l_transitions_legacy", "SELECT a AS start_id, b AS end_id, weight AS strength, relationship AS kinds, round(n.valence - m.valence, 6) + 0 AS valence_shift, round(n.arousal - m.arousal, 6) + 0 AS arousal_shift FROM adj JOIN nodes m ON m.id = a JOIN nodes n ON n.id = b WHERE weight >= 0.3 AND m.valence IS NOT NULL AND n.valence IS NOT NULL")
def _(v):
    return graph.transitions_legacy(v.edges, v.nodes).select(F.col("start").alias("start_id"), F.col("end").alias("end_id"), "strength", F.array_join("kinds", ",").alias("kinds"), _ROUND("valence_shift").alias("valence_shift"), _ROUND("arousal_shift").alias("arousal_shift"))


query("g13_circular_layout", "SELECT id, round(cos(2 * pi() * r / n), 6) + 0.0 AS x, round(sin(2 * pi() * r / n), 6) + 0.0 AS y FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r, count(*) OVER () AS n FROM nodes)")(lambda v: graph.circular_layout(v.nodes).select("id", (_ROUND("x") + 0.0).alias("x"), (_ROUND("y") + 0.0).alias("y")))


@query("g14_neighbour_layout", ", placed AS (SELECT id, id::DOUBLE AS x, (id % 7)::DOUBLE AS y FROM nodes WHERE id % 4 <> 0) SELECT n.id, round(coalesce(avg(x), 0), 6) AS x, round(coalesce(avg(y), 0), 6) AS y FROM nodes n LEFT JOIN (adj JOIN placed p ON p.id = b) ON a = n.id WHERE n.id % 4 = 0 GROUP BY n.id")
def _(v):
    placed = v.nodes.where("id % 4 <> 0").select("id", F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    return graph.neighbour_means(v.nodes.where("id % 4 = 0"), v.edges, placed).select("id", _ROUND("x").alias("x"), _ROUND("y").alias("y"))


query("g15_node_size", ", d AS (SELECT n.id, count(a) AS degree FROM nodes n LEFT JOIN adj ON a = n.id GROUP BY n.id) SELECT id, degree, round(5 + 25.0::DOUBLE * degree / greatest(1, max(degree) OVER ()), 6) AS size FROM d")(lambda v: graph.node_size(v.edges, v.nodes).select("id", "degree", _ROUND("size").alias("size")))
query("g16_edge_width", "SELECT u, v, round(greatest(0.5, least(5.0, 0.5 + 4.5 * weight)), 6) AS width FROM edges")(lambda v: v.edges.select("u", "v", _ROUND(graph.edge_width(F.col("weight"))).alias("width")))
query("g17_node_color", "SELECT id, CASE WHEN valence IS NULL THEN '#6666ff' WHEN valence > 0.5 THEN '#00cc66' WHEN valence < -0.5 THEN '#cc3300' WHEN valence > 0.1 THEN '#90EE90' WHEN valence < -0.1 THEN '#FFA07A' ELSE '#cccccc' END AS color FROM nodes")(lambda v: v.nodes.select("id", graph.node_color(F.col("valence")).alias("color")))
query("g18_tooltips", "SELECT id, concat_ws(chr(10), 'Term: ' || term, 'ID: ' || id, 'Valence: ' || printf('%.2f', round(CAST(valence AS DECIMAL(18, 6)), 2)::DOUBLE), 'Arousal: ' || printf('%.2f', round(CAST(arousal AS DECIMAL(18, 6)), 2)::DOUBLE)) AS tooltip FROM nodes")(lambda v: v.nodes.select("id", graph.tooltip(F.col("term"), F.col("id"), F.col("valence"), F.col("arousal")).alias("tooltip")))
query("g19_edge_style", "SELECT u, v, CASE dimension WHEN 'emotional' THEN 'dashed' WHEN 'affective' THEN 'dotted' ELSE 'solid' END AS style, NOT bidirectional AS arrow FROM edges")(lambda v: v.edges.select("u", "v", *graph.edge_style(F.col("dimension"), F.col("bidirectional"))))
query("g20_visual_limits", "SELECT u, v FROM edges ORDER BY u, v LIMIT 2000")(lambda v: v.edges.select("u", "v").orderBy("u", "v").limit(2000))

query("f02_node_id_by_term", f"SELECT max(id) AS id FROM nodes WHERE lower(term) = '{START}'")(lambda v: v.nodes.where(F.lower("term") == START).agg(F.max("id").alias("id")))
query("f03_term_by_id", "SELECT id, term FROM nodes WHERE id = 3")(lambda v: v.nodes.where("id = 3").select("id", "term"))


@query("f06_by_dimension", "SELECT u, v, relationship FROM edges e JOIN nodes a ON a.id = u JOIN nodes b ON b.id = v WHERE dimension = 'emotional' AND relationship = 'evokes' AND (a.valence BETWEEN 0 AND 0.2 OR b.valence BETWEEN 0 AND 0.2)")
def _(v):
    rows = graph.ends(v.edges.where("dimension = 'emotional' and relationship = 'evokes'"), v.nodes, ("valence",))
    return rows.where(F.col("u_valence").between(0, 0.2) | F.col("v_valence").between(0, 0.2)).select("u", "v", "relationship")


query("f06l_by_dimension_legacy", "SELECT u, v, relationship FROM edges e JOIN nodes a ON a.id = u WHERE dimension = 'emotional' AND a.valence BETWEEN 0 AND 0.2")(lambda v: graph.ends(v.edges.where("dimension = 'emotional'"), v.nodes, ("valence",)).where(F.col("u_valence").between(0, 0.2)).select("u", "v", "relationship"))
query("f07_active_dimensions", "SELECT u, v FROM edges WHERE dimension IN ('lexical', 'affective')")(lambda v: v.edges.where(F.col("dimension").isin("lexical", "affective")).select("u", "v"))
query("f08_type_validity", ", known AS (SELECT DISTINCT lower(relationship_type) AS k FROM relationships) SELECT t, k IS NOT NULL OR regexp_matches(t, '^(custom_|domain_|project_)') AS valid FROM (SELECT DISTINCT lower(trim(event_type)) AS t FROM queue UNION SELECT lower(relationship_type) FROM relationships UNION SELECT 'project_x') LEFT JOIN known ON k = t")(
    lambda v: v.queue.select(F.lower(F.trim("event_type")).alias("t")).union(v.relationships.select(F.lower("relationship_type"))).union(v.spark.createDataFrame([("project_x",)], "t string")).distinct().join(v.relationships.select(F.lower("relationship_type").alias("k")).distinct(), F.col("t") == F.col("k"), "left").select("t", (F.col("k").isNotNull() | F.col("t").rlike("^(custom_|domain_|project_)")).alias("valid"))
)
query("f09_type_category", "SELECT DISTINCT relationship_type, CASE WHEN regexp_matches(relationship_type, '^(synonym|antonym|hypernym|hyponym)') THEN 'lexical' WHEN regexp_matches(relationship_type, '^(related_to|part_of|has_part)') THEN 'semantic' WHEN regexp_matches(relationship_type, '^(evokes|emotional_)') THEN 'emotional' WHEN regexp_matches(relationship_type, '^(positive_|negative_|high_|low_)') THEN 'affective' ELSE 'other' END AS category FROM relationships")(lambda v: v.relationships.select("relationship_type").distinct().withColumn("category", graph.category(F.col("relationship_type"))))
query("f10_dimension", f"SELECT DISTINCT relationship_type, CASE WHEN lower(relationship_type) IN ({_sql_list(EMOTIONAL_COLORS)}) THEN 'emotional' WHEN lower(relationship_type) IN ({_sql_list(AFFECTIVE_COLORS)}) THEN 'affective' ELSE 'lexical' END AS dimension FROM relationships")(lambda v: v.relationships.select("relationship_type").distinct().withColumn("dimension", graph.dimension(F.col("relationship_type"))))
query("f10l_dimension_legacy", "SELECT DISTINCT relationship AS relationship_type, dimension FROM decorated")(lambda v: v.relationships.select("relationship_type").distinct().withColumn("dimension", graph.dimension(F.col("relationship_type"), legacy=True)))
query("f11_type_properties", "SELECT r.id, coalesce(weight, 0.3::DOUBLE) AS weight, coalesce(color, '#aaaaaa') AS color, coalesce(bidirectional, true) AS bidirectional FROM relationships r LEFT JOIN types ON type = lower(relationship_type)")(lambda v: graph.properties(v.relationships, v.types).select("id", "weight", "color", "bidirectional"))
query("f11_type_properties_exact", "SELECT r.id, coalesce(weight, 0.3::DOUBLE) AS weight FROM relationships r LEFT JOIN types ON type = relationship_type")(lambda v: graph.properties(v.relationships, v.types, lower=False).select("id", "weight"))


def _color_sql(active: dict[str, str]) -> str:
    return "CASE lower(relationship_type) " + " ".join(f"WHEN '{k}' THEN '{c}'" for k, c in active.items()) + " ELSE '#aaaaaa' END"


query("f12_type_color", f"SELECT DISTINCT relationship_type, {_color_sql(BASE_COLORS)} AS lexical, {_color_sql(BASE_COLORS | EMOTIONAL_COLORS | AFFECTIVE_COLORS)} AS every FROM relationships")(lambda v: v.relationships.select("relationship_type").distinct().select("relationship_type", graph.color(F.col("relationship_type")).alias("lexical"), graph.color(F.col("relationship_type"), ("lexical", "emotional", "affective")).alias("every")))
query("f24_legacy_self_loops", "SELECT count(*) AS n FROM relationships r JOIN words s ON s.id = word_id JOIN words d ON lower(d.term) = lower(related_term)")(lambda v: v.relationships.join(v.words.select(F.col("id").alias("word_id")), "word_id", "left_semi").join(v.words.select(F.lower("term").alias("k")), F.lower("related_term") == F.col("k")).agg(F.count(F.lit(1)).alias("n")))

query("j05_edge_ends", "SELECT u, v, a.term AS u_term, b.term AS v_term, a.valence AS u_valence, b.valence AS v_valence FROM edges JOIN nodes a ON a.id = u JOIN nodes b ON b.id = v")(lambda v: graph.ends(v.edges, v.nodes).select("u", "v", "u_term", "v_term", "u_valence", "v_valence"))
query("j06_reachable_pairs", f"{_PATHS} SELECT DISTINCT s AS start_id, t AS end_id FROM paths")(lambda v: graph.transitions(v.edges, v.nodes, 2, 0.45).select(F.col("start").alias("start_id"), F.col("end").alias("end_id")).distinct())
query("j13_new_nodes", "SELECT id FROM words WHERE id NOT IN (SELECT a FROM adj WHERE relationship = 'evokes')")(lambda v: v.words.select("id").join(graph.adjacency(v.edges.where("relationship = 'evokes'")).select(F.col("a").alias("id")), "id", "left_anti"))

query("a01_graph_counts", "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges")(lambda v: v.nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(v.edges.agg(F.count(F.lit(1)).alias("edges"))))
query("a02_type_histogram", "SELECT relationship_type, count(*) AS n FROM resolved GROUP BY 1")(lambda v: stats.histogram(v.resolved))
query("a03_distinct_types", "SELECT DISTINCT relationship_type FROM resolved ORDER BY 1")(lambda v: v.resolved.select("relationship_type").distinct().orderBy("relationship_type"))
query("a04_top_types", ", c AS (SELECT relationship_type, count(*) AS n FROM resolved GROUP BY 1) SELECT relationship_type, n, greatest((SELECT count(*) FROM c) - 10, 0) AS more FROM c ORDER BY n DESC, relationship_type LIMIT 10")(lambda v: stats.top_types(v.resolved))


@query("a05_graph_info", "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT string_agg(term, '|' ORDER BY id) FROM (SELECT id, term FROM nodes ORDER BY id LIMIT 5)) AS sample_nodes, (SELECT string_agg(concat(u, '-', v), '|' ORDER BY u, v) FROM (SELECT u, v FROM edges ORDER BY u, v LIMIT 5)) AS sample_edges, (SELECT string_agg(r, '|' ORDER BY r) FROM (SELECT DISTINCT relationship AS r FROM edges)) AS types")
def _(v):
    one = lambda df, name, *by: df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by))), lambda x: x["t"]), "|").alias(name))
    nodes = one(v.nodes.select("id", F.col("term").alias("t")).orderBy("id").limit(5), "sample_nodes", "id", "t")
    edges = one(v.edges.select("u", "v", F.concat("u", F.lit("-"), "v").alias("t")).orderBy("u", "v").limit(5), "sample_edges", "u", "v", "t")
    types = one(v.edges.select(F.col("relationship").alias("t")).distinct(), "types", "t")
    out = v.nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(v.edges.agg(F.count(F.lit(1)).alias("edges")))
    return out.crossJoin(nodes).crossJoin(edges).crossJoin(types)  # single rows


query("a06_edges_per_dimension", "SELECT coalesce(dimension, 'unknown') AS dimension, count(*) AS n FROM edges GROUP BY 1")(lambda v: stats.by_dimension(v.edges))
query("a07_multi_dimensional_nodes", "SELECT a AS id, string_agg(DISTINCT dimension, ',' ORDER BY dimension) AS dimensions FROM adj GROUP BY a HAVING count(DISTINCT dimension) > 1")(lambda v: stats.node_dimensions(v.edges).select("id", F.array_join("dimensions", ",").alias("dimensions")))
_TOP = "SELECT dimension, relationship, n, place FROM (SELECT dimension, relationship, count(*) AS n, row_number() OVER (PARTITION BY dimension ORDER BY count(*) DESC, relationship) AS place FROM edges GROUP BY 1, 2) WHERE place <= {}"
query("a08_top_type_per_dimension", _TOP.format(1))(lambda v: stats.top_per_dimension(v.edges))
query("a08l_top5_per_dimension", _TOP.format(5))(lambda v: stats.top_per_dimension(v.edges, 5))
query("a09_dimension_pairs", ", nd AS (SELECT DISTINCT a, dimension AS d FROM adj) SELECT concat(x.d, '_&_', y.d) AS pair, count(*) AS n FROM nd x JOIN nd y ON x.a = y.a AND x.d < y.d GROUP BY 1")(lambda v: stats.dimension_pairs(v.edges))
_TOUCHED = ", touched AS (SELECT id, term, valence FROM nodes WHERE valence IS NOT NULL AND id IN (SELECT a FROM adj WHERE dimension = 'emotional'))"
query("a10_valence_distribution", f"{_TOUCHED} SELECT count(*) AS n, round(avg(valence), 6) AS mean, round(min(valence), 6) AS low, round(max(valence), 6) AS high FROM touched")(lambda v: stats.valence_distribution(v.edges, v.nodes, "emotional").select("n", *[_ROUND(c).alias(c) for c in ("mean", "low", "high")]))
query("t04_valence_extremes", f"{_TOUCHED} (SELECT id, term, round(valence, 6) AS valence, 'top' AS side FROM touched ORDER BY touched.valence DESC, id LIMIT 5) UNION ALL (SELECT id, term, round(valence, 6), 'bottom' FROM touched ORDER BY touched.valence, id LIMIT 5)")(lambda v: stats.valence_extremes(v.edges, v.nodes, "emotional").withColumn("valence", _ROUND("valence")))
query("a11_valence_legacy", f"{_TOUCHED} SELECT count(*) AS n, round(avg(valence), 6) AS mean, round(median(valence), 6) AS median, round(stddev_pop(valence), 6) AS std, round(min(valence), 6) AS low, round(max(valence), 6) AS high FROM touched")(lambda v: stats.valence_distribution_legacy(v.edges, v.nodes, "emotional").select("n", *[_ROUND(c).alias(c) for c in ("mean", "median", "std", "low", "high")]))
query("a11_valence_bins", f"{_TOUCHED} SELECT CAST(least(6, floor((valence + 1) / 2 * 7)) AS INT) AS bin, count(*) AS n FROM touched GROUP BY 1")(lambda v: stats.valence_bins(v.edges, v.nodes, "emotional"))
query("a12_valence_ratios", "SELECT count(*) AS n, round(avg(valence), 6) AS mean, round(median(valence), 6) AS median, round(stddev_pop(valence), 6) AS std, round(min(valence), 6) AS low, round(max(valence), 6) AS high, round(avg((valence > 0.1)::INT), 6) AS positive, round(avg((valence < -0.1)::INT), 6) AS negative, round(avg((abs(valence) <= 0.1)::INT), 6) AS neutral FROM nodes WHERE valence IS NOT NULL")(lambda v: (lambda r: r.select("n", *[_ROUND(c).alias(c) for c in r.columns[1:]]))(stats.valence_ratios(v.nodes)))
query("a13_types_per_word", "SELECT word_id, relationship_type AS type, count(*) AS n FROM relationships GROUP BY 1, 2")(lambda v: stats.types_per_word(v.relationships))
query("a25_degrees", "SELECT a AS id, count(*) AS degree FROM adj GROUP BY 1")(lambda v: graph.degrees(v.edges))
query("a25_max_degree", "SELECT max(n) AS degree FROM (SELECT count(*) AS n FROM adj GROUP BY a)")(lambda v: graph.degrees(v.edges).agg(F.max("degree").alias("degree")))

query("g08_multidimensional", "SELECT 'edges' AS part, dimension AS name, count(*) AS n FROM edges GROUP BY ALL UNION ALL SELECT 'nodes', d, count(*) FROM (SELECT string_agg(DISTINCT dimension, ',' ORDER BY dimension) AS d FROM adj GROUP BY a HAVING count(DISTINCT dimension) > 1) GROUP BY d UNION ALL SELECT 'top', concat(dimension, ':', relationship), n FROM (" + _TOP.format(1) + ")")(
    lambda v: stats.by_dimension(v.edges).select(F.lit("edges").alias("part"), F.col("dimension").alias("name"), "n").union(stats.node_dimensions(v.edges).groupBy(F.array_join("dimensions", ",").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes"), "name", "n")).union(stats.top_per_dimension(v.edges).select(F.lit("top"), F.concat("dimension", F.lit(":"), "relationship"), "n"))
)
query("t03_transitions_by_strength", f"{_PATHS} SELECT path, round(strength, 6) AS strength FROM paths ORDER BY round(strength, 6) DESC, path LIMIT 100")(lambda v: graph.transitions(v.edges, v.nodes, 2, 0.45).select(F.array_join(F.col("path").cast("array<string>"), "-").alias("path"), _ROUND("strength").alias("strength")).orderBy(F.desc("strength"), "path").limit(100))
query("t08_affective_transitions", "SELECT a, b, round(weight * abs(y.valence - x.valence), 6) AS impact FROM adj JOIN nodes x ON x.id = a JOIN nodes y ON y.id = b WHERE abs(y.valence - x.valence) > 0.01 ORDER BY weight * abs(y.valence - x.valence) DESC, a, b LIMIT 10")(lambda v: graph.affective_transitions(v.edges, v.nodes).select("a", "b", _ROUND("impact").alias("impact")))
query("k11_export_subgraph", f", {hops_sql(1)} SELECT id, term, concat('subgraph_', regexp_replace('{START}', '[^\\p{{L}}\\p{{N}}]', '_', 'g'), '_depth1.gexf') AS file FROM nodes WHERE id IN (SELECT id FROM h1)")(lambda v: graph.k_hop(v.edges, _start(v), 1).join(v.nodes, "id").select("id", "term", F.concat(F.lit("subgraph_"), F.regexp_replace(F.lit(START), "[^\\p{L}\\p{N}]", "_"), F.lit("_depth1.gexf")).alias("file")))
