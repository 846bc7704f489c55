"""Views of the lexical model over TPC-H-like test tables: words are parts, relationships are consecutive order lines."""

from __future__ import annotations

import os
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..catalog import relationship_types
from ..functions.emotion import clip, heuristic
from ..operators import graph

#: Relationship types of the adapter, by (first part * 7 + second part) modulo their number.
TYPES = ["synonym", "Antonym", "hypernym", "related", "evokes", "intensifies", "meta_emotion", "diminishes", "joy_associated", "positive_valence", "emotional_component", "custom_link"]


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.dir, f"{name}.parquet"))

    @cached_property
    def words(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("id"),
            F.concat("p_name", F.lit(" "), "p_partkey").alias("term"),
            F.when(F.col("p_partkey") % 5 != 0, F.col("p_type")).alias("definition"),
            F.col("p_brand").alias("part_of_speech"),
            F.concat(F.lit("a "), "p_name", F.lit("\n the "), "p_type", F.lit("; "), "p_brand", F.lit(" \n")).alias("usage_examples"),
            F.col("p_retailprice").alias("last_refreshed"),
        )

    @cached_property
    def relationships(self) -> DataFrame:
        lines = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
        after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("other"))
        pairs = lines.join(after, ["l_orderkey", "l_linenumber"]).where("l_partkey <> other").distinct()
        kind = F.element_at(F.array(*map(F.lit, TYPES)), ((F.col("l_partkey") * 7 + F.col("other")) % len(TYPES) + 1).cast("int"))
        names = self.words.select(F.col("id").alias("other"), F.col("term").alias("related_term"))
        rel_id = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 10_000_000_000 + F.col("l_partkey") * 100_000 + F.col("other")
        return pairs.join(names, "other").select(rel_id.alias("id"), F.col("l_partkey").alias("word_id"), "related_term", kind.alias("relationship_type"))

    @cached_property
    def types(self) -> DataFrame:
        return relationship_types(self.spark)

    @cached_property
    def emotions(self) -> DataFrame:
        """Heuristic valence, arousal, dominance and the emotion map (dominance for ids not divisible by 4)."""
        e = heuristic(F.col("term"))
        rows = self.words.select("id", "term", *[v.alias(k) for k, v in e.items()])
        full = F.create_map(F.lit("valence"), F.col("valence"), F.lit("arousal"), F.col("arousal"), F.lit("dominance"), F.col("dominance"))
        return rows.withColumn("m", F.map_filter(full, lambda k, v: (k != "dominance") | (F.col("id") % 4 != 0)))

    @cached_property
    def word_emotion(self) -> DataFrame:
        return self.emotions.where("id % 3 <> 0").select(F.col("id").alias("word_id"), clip(F.col("valence")).alias("valence"), clip(F.col("arousal"), 0.0, 1.0).alias("arousal"), F.col("id").cast("double").alias("timestamp"))

    @cached_property
    def nodes(self) -> DataFrame:
        return graph.scan_words(self.words).join(self.word_emotion.withColumnRenamed("word_id", "id").drop("timestamp"), "id", "left")

    @cached_property
    def resolved(self) -> DataFrame:
        return graph.resolve(graph.scan_relationships(self.relationships), graph.scan_words(self.words))

    @cached_property
    def edges(self) -> DataFrame:
        return graph.collapse(graph.decorate(self.resolved, self.types, legacy=True))

    @cached_property
    def messages(self) -> DataFrame:
        return self.table("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("conversation_id"), F.col("role").alias("speaker"), "text", F.col("turn").cast("double").alias("timestamp"))

    @cached_property
    def queue(self) -> DataFrame:
        e = self.table("events")
        priority = F.when(F.col("event_type") == "error", "HIGH").when(F.col("event_type").isin("purchase", "signup"), "NORMAL").otherwise("LOW")
        return e.select(F.col("event_id").alias("seq"), F.concat(F.lit(" "), F.initcap("event_type"), F.lit(":"), "user_id").alias("item"), priority.alias("priority"), "ts", "value", "event_type", "user_id")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")


_LIST = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"


def _types_sql() -> str:
    from ..catalog import RELATIONSHIP_TYPES

    return ", ".join(f"('{t}', {w}::DOUBLE, '{c}', {str(b).lower()})" for t, w, c, b in RELATIONSHIP_TYPES)


def _heuristic_sql() -> str:
    from ..catalog import HEURISTIC as H

    base = lambda a, b: f"CASE WHEN regexp_matches(lower(term), '{H[a]}') THEN 0.5::DOUBLE WHEN regexp_matches(lower(term), '{H[b]}') THEN -0.5::DOUBLE ELSE 0::DOUBLE END"
    return f"""
greatest(-1, least(1, {base('positive', 'negative')} + ((h % 100) / 100 - 0.5::DOUBLE) * 0.5::DOUBLE)) AS valence,
greatest(-1, least(1, {base('excited', 'calm')} + (length(regexp_replace(lower(term), '[^bcdfghjklmnpqrstvwxz]', '', 'g')) / greatest(length(term), 1) - 0.5::DOUBLE) + (h // 100 % 100) / 100 - 0.5::DOUBLE)) AS arousal,
greatest(-1, least(1, {base('strong', 'weak')} + (h // 10000 % 100) / 100 - 0.5::DOUBLE)) AS dominance"""


#: The same views for DuckDB, put before each oracle query.
PRELUDE = f"""
WITH words AS (
  SELECT p_partkey AS id, concat(p_name, ' ', p_partkey) AS term, CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS definition, p_brand AS part_of_speech,
    concat('a ', p_name, chr(10), ' the ', p_type, '; ', p_brand, ' ', chr(10)) AS usage_examples, p_retailprice AS last_refreshed FROM part),
relationships AS (
  SELECT DISTINCT (a.l_orderkey * 8 + a.l_linenumber) * 10000000000 + a.l_partkey * 100000 + b.l_partkey AS id, a.l_partkey AS word_id, w.term AS related_term,
    ({_LIST})[(a.l_partkey * 7 + b.l_partkey) % {len(TYPES)} + 1] AS relationship_type
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber AND a.l_partkey <> b.l_partkey JOIN words w ON w.id = b.l_partkey),
types(type, weight, color, bidirectional) AS (VALUES {_types_sql()}),
hashed AS (SELECT id, term, CAST(CAST(concat('0x', md5(term)) AS UHUGEINT) % 1000000 AS BIGINT) AS h FROM words),
emotions AS (SELECT id, term, {_heuristic_sql()} FROM hashed),
word_emotion AS (SELECT id AS word_id, valence, greatest(0, least(1, arousal)) AS arousal, id::DOUBLE AS timestamp FROM emotions WHERE id % 3 <> 0),
nodes AS MATERIALIZED (SELECT w.id, w.term, e.valence, e.arousal FROM words w LEFT JOIN word_emotion e ON e.word_id = w.id),
resolved AS MATERIALIZED (SELECT r.id AS rel_id, r.word_id AS src_id, d.id AS dst_id, r.relationship_type FROM relationships r JOIN words s ON s.id = r.word_id JOIN words d ON lower(d.term) = lower(r.related_term) WHERE r.word_id <> d.id),
decorated AS (
  SELECT rel_id, src_id, dst_id, relationship_type AS relationship, coalesce(weight, 0.3::DOUBLE) AS weight, coalesce(color, '#aaaaaa') AS color, coalesce(bidirectional, true) AS bidirectional,
    CASE WHEN regexp_matches(lower(relationship_type), '^(emotional_|evokes|responds_to|valence_|arousal_|meta_emotion|intensifies|diminishes)') THEN 'emotional'
         WHEN regexp_matches(lower(relationship_type), '^(positive_|negative_|high_|low_)') THEN 'affective' ELSE 'lexical' END AS dimension
  FROM resolved LEFT JOIN types ON type = lower(relationship_type)),
edges AS MATERIALIZED (
  SELECT least(src_id, dst_id) AS u, greatest(src_id, dst_id) AS v, rel_id, src_id, dst_id, relationship, weight, color, bidirectional, dimension FROM decorated
  QUALIFY row_number() OVER (PARTITION BY least(src_id, dst_id), greatest(src_id, dst_id) ORDER BY rel_id DESC) = 1),
adj AS MATERIALIZED (SELECT u AS a, v AS b, relationship, weight, dimension FROM edges UNION ALL SELECT v, u, relationship, weight, dimension FROM edges),
pairs AS (SELECT e.*, a.valence AS v1, a.arousal AS a1, CASE WHEN u % 4 <> 0 THEN a.dominance END AS d1, b.valence AS v2, b.arousal AS a2, CASE WHEN v % 4 <> 0 THEN b.dominance END AS d2 FROM edges e JOIN emotions a ON a.id = e.u JOIN emotions b ON b.id = e.v),
messages AS (SELECT conv_id * 1000 + turn AS id, conv_id AS conversation_id, role AS speaker, text, turn::DOUBLE AS timestamp FROM conversations),
queue AS (SELECT event_id AS seq, concat(' ', upper(event_type[1]), event_type[2:], ':', user_id) AS item, CASE WHEN event_type = 'error' THEN 'HIGH' WHEN event_type IN ('purchase', 'signup') THEN 'NORMAL' ELSE 'LOW' END AS priority, ts, value, event_type, user_id FROM events),
vectors AS (SELECT vec_id, embedding::DOUBLE[] AS embedding, label FROM embeddings)
"""
