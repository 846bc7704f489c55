"""Queries over the emotion algebra and message classification.  Maps are returned in long form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import CATEGORIES, DOMAIN_CONTEXTS, LABELS, categories
from ..functions import emotion as E
from ..operators import classify as C, graph, stats
from ..operators.store import related_weighted
from .registry import query

_R = lambda c: F.round(c, 6) + 0.0  # noqa: E731  no negative zeros
DIMS = ("valence", "arousal", "dominance")
#: DuckDB: long form of the words' vectors (dominance only where it is in the map), and of the pairs of edges.
_LONG = ", long AS (SELECT id, 'valence' AS dim, valence AS x FROM emotions UNION ALL SELECT id, 'arousal', arousal FROM emotions UNION ALL SELECT id, 'dominance', dominance FROM emotions WHERE id % 4 <> 0)"
_P3 = (("v1", "v2"), ("a1", "a2"), ("d1", "d2"))


def _long(df, m, *keys):
    return df.select(*keys, F.explode(m).alias("dim", "x")).select(*keys, "dim", _R("x").alias("x"))


def _pairs(v):
    a, b = (v.emotions.select(F.col("id").alias(k), F.col("m").alias(f"m{k}")) for k in "uv")
    return v.edges.select("u", "v", "relationship").join(a, "u").join(b, "v")


def _clip(x: str) -> str:
    return f"greatest(-1, least(1, {x}))"


def _dist(pairs) -> str:
    return "sqrt(" + " + ".join(f"pow(coalesce({a}, 0) - coalesce({b}, 0), 2)" for a, b in pairs) + ")"


query("e01_clamp", f"{_LONG} SELECT id, dim, round({_clip('x * 3')}, 6) + 0 AS x FROM long")(lambda v: _long(v.emotions, E.clamp(F.transform_values("m", lambda k, x: x * 3)), "id"))
query("e02_distance", f"SELECT u, v, round({_dist(_P3)}, 6) + 0 AS distance FROM pairs")(lambda v: _pairs(v).select("u", "v", _R(E.distance(F.col("mu"), F.col("mv"))).alias("distance")))
query("e03_blend", "SELECT u, v, round(coalesce(v1, 0) * 0.7::DOUBLE + coalesce(v2, 0) * 0.3::DOUBLE, 6) + 0 AS valence, CASE WHEN d1 IS NOT NULL OR d2 IS NOT NULL THEN round(coalesce(d1, 0) * 0.7::DOUBLE + coalesce(d2, 0) * 0.3::DOUBLE, 6) + 0 END AS dominance FROM pairs")(lambda v: _pairs(v).withColumn("b", E.blend(F.col("mu"), F.col("mv"), 0.3)).select("u", "v", *[_R(F.try_element_at("b", F.lit(d))).alias(d) for d in ("valence", "dominance")]))
query("e04_inverse", f"{_LONG} SELECT id, dim, round(-x, 6) + 0 AS x FROM long")(lambda v: _long(v.emotions, E.inverse(F.col("m")), "id"))
query("e05_intensify", f"{_LONG} SELECT id, dim, round({_clip('x * 1.5::DOUBLE')}, 6) + 0 AS high, round(x * 0.5::DOUBLE, 6) + 0 AS low FROM long")(lambda v: v.emotions.select("id", F.explode(F.map_zip_with(E.intensify(F.col("m")), E.diminish(F.col("m")), lambda k, a, b: F.struct(a.alias("a"), b.alias("b")))).alias("dim", "x")).select("id", "dim", _R("x.a").alias("high"), _R("x.b").alias("low")))
query("e06_normalized", f"{_LONG} SELECT id, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6) + 0 AS x FROM long")(lambda v: _long(v.emotions, E.normalized(F.col("m")), "id"))
query("e07_dominant", f"{_LONG} SELECT id, arg_max(dim, abs(x)) AS dim FROM long GROUP BY 1")(lambda v: v.emotions.select("id", E.dominant(F.col("m")).alias("dim")))
query("e08_contrast", "SELECT u, v, 'valence' AS dim, round(v1 - v2, 6) + 0 AS x FROM pairs WHERE abs(v1 - v2) > 0.1 UNION ALL SELECT u, v, 'arousal', round(a1 - a2, 6) + 0 FROM pairs WHERE abs(a1 - a2) > 0.1 UNION ALL SELECT u, v, 'dominance', round(coalesce(d1, 0) - coalesce(d2, 0), 6) + 0 FROM pairs WHERE (d1 IS NOT NULL OR d2 IS NOT NULL) AND abs(coalesce(d1, 0) - coalesce(d2, 0)) > 0.1")(lambda v: _long(_pairs(v), E.contrast(F.col("mu"), F.col("mv")), "u", "v"))
_COS = "(v1 * v2 + a1 * a2 + coalesce(d1 * d2, 0)) / (sqrt(v1 * v1 + a1 * a1 + CASE WHEN d1 * d2 IS NOT NULL THEN d1 * d1 ELSE 0 END) * sqrt(v2 * v2 + a2 * a2 + CASE WHEN d1 * d2 IS NOT NULL THEN d2 * d2 ELSE 0 END))"
query("e09_resonance", f"SELECT u, v, round(({_COS} + 1) / 2, 6) + 0 AS resonance FROM pairs")(lambda v: _pairs(v).select("u", "v", _R(E.resonance(F.col("mu"), F.col("mv"))).alias("resonance")))
query("e10_entropy", f"{_LONG}, p AS (SELECT id, abs(x) / sum(abs(x)) OVER (PARTITION BY id) AS p FROM long) SELECT id, round(-sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END) / log2(count(*)), 6) + 0 AS entropy FROM p GROUP BY 1")(lambda v: v.emotions.select("id", _R(E.entropy(F.col("m"))).alias("entropy")))
query("e11_with_dimension", f"{_LONG} SELECT id, dim, round(x, 6) + 0 AS x FROM long WHERE dim <> 'arousal' UNION ALL SELECT id, 'arousal', 0.25 FROM words UNION ALL SELECT id, 'meta_clarity', 0.9 FROM words")(lambda v: _long(v.emotions, E.with_dimension(E.with_dimension(F.col("m"), "arousal", F.lit(0.25)), "meta_clarity", F.lit(0.9)), "id"))
query("e11_of_category", f"{_LONG} SELECT id, dim, round(x, 6) + 0 AS x FROM long")(lambda v: _long(v.emotions, E.of_category(E.with_dimension(F.col("m"), "meta_clarity", F.lit(0.9)), "primary"), "id"))


def _context_sql(name: str) -> str:
    factors = DOMAIN_CONTEXTS[name]
    parts = []
    for d in sorted({*DIMS, *factors}):
        own = {"valence": "valence", "arousal": "arousal", "dominance": "CASE WHEN id % 4 <> 0 THEN dominance END"}.get(d, "NULL::DOUBLE")
        cond = "" if d in factors or d != "dominance" else " WHERE id % 4 <> 0"
        parts.append(f"SELECT id, '{d}' AS dim, round({_clip(f'coalesce({own}, 0) * 0.7::DOUBLE + {factors.get(d, 0.0)}::DOUBLE * 0.3::DOUBLE')}, 6) + 0 AS x FROM emotions{cond}")
    return " UNION ALL ".join(parts)


query("e12_apply_context", _context_sql("medical"))(lambda v: _long(v.emotions, E.apply_context(F.col("m"), E.literal(DOMAIN_CONTEXTS["medical"])), "id"))
query("e13_combine_contexts", f"{_LONG} SELECT id, dim, round(CASE dim WHEN 'valence' THEN x * 0.5 + 0.3::DOUBLE * 0.5 WHEN 'arousal' THEN x * 0.5 + 0.4::DOUBLE * 0.5 WHEN 'dominance' THEN x * 0.5 END, 6) + 0 AS x FROM long UNION ALL SELECT id, 'dominance', 0 FROM words WHERE id % 4 = 0 UNION ALL SELECT id, 'certainty', -0.1 FROM words UNION ALL SELECT id, 'social', 0.25 FROM words")(lambda v: _long(v.emotions, E.combine_contexts(F.col("m"), E.literal(DOMAIN_CONTEXTS["casual"])), "id"))
query("e14_domain_contexts", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{d}', {x}::DOUBLE)" for n, f in DOMAIN_CONTEXTS.items() for d, x in f.items()) + ") t(name, dim, x)")(lambda v: v.spark.createDataFrame([(n, d, x) for n, f in DOMAIN_CONTEXTS.items() for d, x in f.items()], "name string, dim string, x double"))
query("e15_heuristic", "SELECT id, round(valence, 6) + 0 AS valence, round(arousal, 6) + 0 AS arousal, round(dominance, 6) + 0 AS dominance FROM emotions")(lambda v: v.emotions.select("id", *[_R(d).alias(d) for d in DIMS]))
_SOURCES = ", s AS (SELECT id, 'valence' AS dim, valence AS x, 0.7::DOUBLE AS c FROM emotions UNION ALL SELECT id, 'arousal', arousal, 0.7::DOUBLE FROM emotions UNION ALL SELECT word_id, 'valence', valence, 1::DOUBLE FROM word_emotion UNION ALL SELECT word_id, 'arousal', arousal, 1::DOUBLE FROM word_emotion)"


def _sources(v):
    two = lambda df, c: df.select("id", F.create_map(F.lit("valence"), "valence", F.lit("arousal"), "arousal").alias("dims"), F.lit(c).alias("confidence"))
    return two(v.emotions, 0.7).unionByName(two(v.word_emotion.withColumnRenamed("word_id", "id"), 1.0))


query("a14_weighted_mean", f"{_SOURCES} SELECT id, dim, round(sum(x * c) / sum(c), 6) + 0 AS value FROM s GROUP BY 1, 2")(lambda v: stats.merge_sources(_sources(v)).withColumn("value", _R("value")))
query("e16_merge_confidence", "SELECT e.id, round(least(0.95::DOUBLE, CASE WHEN w.word_id IS NULL THEN 0.7::DOUBLE ELSE (0.7::DOUBLE * 0.7::DOUBLE + 1) / 1.7::DOUBLE + 0.05::DOUBLE END), 6) + 0 AS confidence FROM emotions e LEFT JOIN word_emotion w ON w.word_id = e.id")(lambda v: _sources(v).groupBy("id").agg(_R(F.least(F.lit(0.95), F.sum(F.col("confidence") * F.col("confidence")) / F.sum("confidence") + 0.05 * (F.count(F.lit(1)) - 1))).alias("confidence")))
query("a15_weighted_valence", f"{_SOURCES} SELECT id, round(sum(x * c) / sum(c), 6) + 0 AS valence FROM s WHERE dim = 'valence' GROUP BY 1")(lambda v: stats.merge_sources(_sources(v)).where("dim = 'valence'").select("id", _R("value").alias("valence")))


def _base(v):
    stored = v.word_emotion.select(F.col("word_id").alias("id"), F.create_map(F.lit("valence"), "valence", F.lit("arousal"), "arousal", F.lit("dominance"), F.lit(0.0)).alias("stored"))
    full = F.create_map(*[x for d in DIMS for x in (F.lit(d), F.col(d))])
    return v.emotions.join(stored, "id", "left").select("id", "term", F.coalesce("stored", full).alias("m"), F.when(F.col("stored").isNotNull(), F.lit(1.0)).otherwise(F.lit(0.75)).alias("confidence"))


_BASE = ", base AS (SELECT e.id, e.term, coalesce(w.valence, e.valence) AS valence, coalesce(w.arousal, e.arousal) AS arousal, CASE WHEN w.word_id IS NULL THEN e.dominance ELSE 0 END AS dominance, CASE WHEN w.word_id IS NULL THEN 0.75::DOUBLE ELSE 1::DOUBLE END AS confidence FROM emotions e LEFT JOIN word_emotion w ON w.word_id = e.id)"
_BASE_COLS = "id, round(valence, 6) + 0 AS valence, round(arousal, 6) + 0 AS arousal, round(dominance, 6) + 0 AS dominance, confidence"
for _name in ("e18_base_emotion", "e41_emotion_of_term"):
    query(_name, f"{_BASE} SELECT {_BASE_COLS} FROM base")(lambda v: _base(v).select("id", *[_R(F.element_at("m", F.lit(d))).alias(d) for d in DIMS], "confidence"))

_NEAR = "greatest(0, 1 - ({}) / 2)"
_STRENGTH = f"""CASE WHEN relationship = 'synonym' THEN {_NEAR.format(_dist(_P3))} WHEN relationship = 'antonym' THEN {_NEAR.format(_dist((('-v1', 'v2'), ('-a1', 'a2'), ('-d1', 'd2'))))}
WHEN relationship = 'intensifies' THEN {_NEAR.format(_dist(tuple((_clip(f'{a} * 1.5::DOUBLE') if a[0] != 'd' else f'CASE WHEN d1 IS NOT NULL THEN {_clip("d1 * 1.5::DOUBLE")} END', b) for a, b in _P3)))}
WHEN relationship = 'diminishes' THEN {_NEAR.format(_dist((('v1 * 0.5', 'v2'), ('a1 * 0.5', 'a2'), ('d1 * 0.5', 'd2'))))}
WHEN relationship IN ('evokes', 'responds_to') THEN evo WHEN relationship = 'emotional_component' THEN comp WHEN relationship = 'meta_emotion' THEN 0 ELSE {_NEAR.format(_dist(_P3))} END"""
_STRONG = lambda k: f"((abs(v{k}) > 0.5)::INT + (abs(a{k}) > 0.5)::INT + coalesce((abs(d{k}) > 0.5)::INT, 0))"
_MATCH = "(" + " + ".join(f"coalesce((abs({a}) > 0.4 AND abs({b}) > 0.4 AND {a} * {b} > 0)::INT, 0)" for a, b in _P3) + ")"
_SCORED = f""", z AS (SELECT *, coalesce(d1, 0) AS e1 FROM pairs), scored AS (SELECT *,
  greatest(0.2::DOUBLE, CASE WHEN v1 < -0.3 AND a2 > 0.3 THEN least(abs(v1), a2) END, CASE WHEN abs(v1) > 0.7 AND abs(v2) > 0.5 AND v1 * v2 > 0 THEN least(abs(v1), abs(v2)) * 0.7::DOUBLE END, CASE WHEN a1 > 0.5 AND e1 < -0.3 AND a2 > 0.5 AND v2 < -0.3 THEN least(a1, abs(e1)) * 0.8::DOUBLE END, CASE WHEN a1 < -0.3 AND e1 > 0.5 AND v2 > 0.5 AND a2 < 0 THEN least(abs(a1), e1) * 0.7::DOUBLE END) AS evo,
  CASE WHEN {_STRONG(1)} >= {_STRONG(2)} OR {_MATCH} = 0 THEN 0.2::DOUBLE ELSE least(1, {_MATCH} / greatest(1, {_STRONG(1)}) * 0.8::DOUBLE) END AS comp FROM z)"""
query("e22_strength", f"{_SCORED} SELECT u, v, relationship, round({_STRENGTH}, 6) + 0 AS strength FROM scored")(lambda v: _pairs(v).select("u", "v", "relationship", _R(E.strength(F.col("relationship"), F.col("mu"), F.col("mv"))).alias("strength")))
query("e23_evocative", f"{_SCORED} SELECT u, v, round(evo, 6) + 0 AS strength FROM scored")(lambda v: _pairs(v).select("u", "v", _R(E.evocative(F.col("mu"), F.col("mv"))).alias("strength")))
query("e24_component", f"{_SCORED} SELECT u, v, round(comp, 6) + 0 AS strength FROM scored")(lambda v: _pairs(v).select("u", "v", _R(E.component(F.col("mu"), F.col("mv"))).alias("strength")))
query("e33_blended_strength", f"{_SCORED} SELECT u, v, round(0.4::DOUBLE * 0.25::DOUBLE + {_STRENGTH} * 0.75::DOUBLE, 6) + 0 AS strength FROM scored")(lambda v: _pairs(v).select("u", "v", _R(F.lit(0.4) * 0.25 + E.strength(F.col("relationship"), F.col("mu"), F.col("mv")) * 0.75).alias("strength")))
query("e34_relationship_context", "SELECT u, v, round(s, 6) + 0 AS strength FROM (SELECT u, v, least(1, abs(a2 - a1) * 0.6::DOUBLE + CASE WHEN v1 < 0 AND v2 > 0 THEN 0.4::DOUBLE ELSE 0 END) AS s FROM pairs) WHERE s > 0.3")(lambda v: _pairs(v).select("u", "v", F.least(F.lit(1.0), F.abs(E.at(F.col("mv"), "arousal") - E.at(F.col("mu"), "arousal")) * 0.6 + F.when((E.at(F.col("mu"), "valence") < 0) & (E.at(F.col("mv"), "valence") > 0), 0.4).otherwise(0.0)).alias("s")).where("s > 0.3").select("u", "v", _R("s").alias("strength")))

# concepts: vectors are doubled here so that thresholds are reached
_WIDE = f", w AS (SELECT id, {_clip('valence * 3')} AS valence, {_clip('arousal * 3')} AS arousal, {_clip('dominance * 2')} AS dominance FROM emotions)"


def _wide(v):
    return v.emotions.select("id", "term", F.create_map(F.lit("valence"), E.clip(F.col("valence") * 3), F.lit("arousal"), E.clip(F.col("arousal") * 3), F.lit("dominance"), E.clip(F.col("dominance") * 2)).alias("m"))


def _meta_sql(hooks: bool) -> str:
    return f"""{_WIDE} SELECT id, 'awareness_of_emotional_clarity' AS label, 'certainty' AS dim, 0.8 AS x FROM w WHERE abs(valence) > 0.7 UNION ALL SELECT id, 'response_to_activation', 'valence', CASE WHEN arousal > 0.9 THEN -0.2 ELSE 0.2 END FROM w WHERE arousal > 0.7
UNION ALL SELECT id, 'awareness_of_emotional_complexity', 'meta_complexity', {0.8 if hooks else 0.9} FROM w WHERE abs(valence) > 0.5 AND abs(arousal) > 0.5 AND abs(dominance) > 0.5"""


def _meta(v, hooks):
    found = _wide(v).select("id", F.explode(E.meta_emotions(F.col("m"), hooks=hooks)).alias("e")).select("id", "e.label", F.explode("e.dims").alias("dim", "x"))
    return found.where("(label like '%clarity' and dim = 'certainty') or (label like '%activation' and dim = 'valence') or (label like '%complexity' and dim = 'meta_complexity')")


query("e25_meta_emotions", _meta_sql(False))(lambda v: _meta(v, False))
query("e26_meta_hooks", _meta_sql(True))(lambda v: _meta(v, True))


def _states(df, states):
    return df.select("id", F.explode(states).alias("s")).select("id", "s.name", "s.confidence", F.explode("s.dims").alias("dim", "x")).select("id", "name", F.round("confidence", 6).alias("confidence"), "dim", _R("x").alias("x"))


def _state_sql(rows) -> str:
    return _WIDE + " " + " UNION ALL ".join(f"SELECT id, '{n}' AS name, {c}::DOUBLE AS confidence, '{d}' AS dim, round({x}, 6) + 0 AS x FROM w" for n, c, d, x in rows)


query("e27_temporal_sequence", _state_sql([r for d in DIMS for r in (("onset", 0.7, d, f"{d} * 0.7::DOUBLE"), ("peak", 0.7, d, d), ("offset", 0.7, d, f"{d} * 0.5::DOUBLE * {0.8 if d == 'valence' else 1}::DOUBLE"))]))(lambda v: _states(_wide(v), E.temporal_sequence(F.col("m"), F.lit(0.7))))
query("e28_intensity_gradation", _state_sql([r for d in DIMS for r in (("minimal", 0.7, d, f"{d} * 0.2::DOUBLE"), ("low", 0.8, d, f"{d} * 0.5::DOUBLE"), ("medium", 0.7, d, d), ("high", 0.8, d, _clip(f"{d} * 1.5::DOUBLE")), ("extreme", 0.7, d, _clip(f"{d} * 2")))] + [("extreme", 0.7, "certainty", "-0.3::DOUBLE"), ("extreme", 0.7, "social", "-0.2::DOUBLE")]))(lambda v: _states(_wide(v), E.intensity_gradation(F.col("m"), F.lit(0.7))))
_VAR = [("personal", 0.7, {"intensity": 0.3, "relevance": 0.4, "social": 0.5}), ("professional", 0.7, {"intensity": -0.3, "dominance": 0.2, "certainty": 0.3}), ("social", 0.7, {"social": 0.6}), ("cultural", 0.6, {"intensity": -0.2, "certainty": -0.3})]
query("e29_contextual_variations", _state_sql([(n, c, d, (_clip(f"{d if d in DIMS else 0} + {ch[d]}::DOUBLE") if d in ch else ("CASE WHEN valence < 0 THEN valence * 0.5 ELSE valence END" if n == "social" and d == "valence" else d))) for n, c, ch in _VAR for d in sorted({*DIMS, *ch})]))(lambda v: _states(_wide(v), E.contextual_variations(F.col("m"))))

_SECOND = ["synonym", "emotional_synonym", "related", "emotional_component", "intensifies", "diminishes", "evokes", "hypernym", "hyponym"]


def _secondary(v):
    rel = related_weighted(v.relationships, v.words, None).where(F.col("relationship_type").isin(_SECOND))
    own = _base(v)
    rows = rel.join(own.select(F.col("id").alias("word_id"), F.col("m").alias("p")), "word_id").join(own.select(F.col("id").alias("related_id"), F.col("m").alias("r")), "related_id")
    vec = F.when(F.col("relationship_type") == "intensifies", E.intensify(F.col("p"))).when(F.col("relationship_type") == "diminishes", E.diminish(F.col("p"))).otherwise(F.col("r"))
    return rows.select("word_id", F.concat("relationship_type", F.lit(":"), "related_term").alias("label"), "p", vec.alias("s"))


_REL15 = "(SELECT r.*, w.id AS related_id, row_number() OVER (PARTITION BY r.word_id ORDER BY r.relationship_type, w.id, r.id) AS place FROM relationships r JOIN words w ON w.term = r.related_term)"
_SEC = f"""{_BASE}, second AS (SELECT word_id, concat(relationship_type, ':', related_term) AS label, p.valence AS pv, p.arousal AS pa, p.dominance AS pd,
  CASE relationship_type WHEN 'intensifies' THEN {_clip('p.valence * 1.5::DOUBLE')} WHEN 'diminishes' THEN p.valence * 0.5 ELSE q.valence END AS sv,
  CASE relationship_type WHEN 'intensifies' THEN {_clip('p.arousal * 1.5::DOUBLE')} WHEN 'diminishes' THEN p.arousal * 0.5 ELSE q.arousal END AS sa,
  CASE relationship_type WHEN 'intensifies' THEN {_clip('p.dominance * 1.5::DOUBLE')} WHEN 'diminishes' THEN p.dominance * 0.5 ELSE q.dominance END AS sd
  FROM {_REL15} r JOIN base p ON p.id = r.word_id JOIN base q ON q.id = r.related_id WHERE place <= 15 AND relationship_type IN ({", ".join(f"'{t}'" for t in _SECOND)}))"""
query("e30_secondary_emotions", f"{_SEC} SELECT word_id, label, round(sv, 6) + 0 AS valence, round(sa, 6) + 0 AS arousal FROM second")(lambda v: _secondary(v).select("word_id", "label", *[_R(E.at(F.col("s"), d)).alias(d) for d in ("valence", "arousal")]))
query("e25_incongruence", f"{_SEC} SELECT word_id, bool_or(pv * sv < 0 AND abs(pv) > 0.3 AND abs(sv) > 0.3) AS conflict FROM second GROUP BY 1")(lambda v: _secondary(v).groupBy("word_id").agg(F.bool_or((E.at(F.col("p"), "valence") * E.at(F.col("s"), "valence") < 0) & (F.abs(E.at(F.col("p"), "valence")) > 0.3) & (F.abs(E.at(F.col("s"), "valence")) > 0.3)).alias("conflict")))
_RES = "CASE WHEN sqrt(pv*pv+pa*pa+pd*pd) * sqrt(sv*sv+sa*sa+sd*sd) = 0 THEN 0 ELSE ((pv*sv+pa*sa+pd*sd) / (sqrt(pv*pv+pa*pa+pd*pd) * sqrt(sv*sv+sa*sa+sd*sd)) + 1) / 2 END"
query("a19_coherence", f"{_SEC} SELECT word_id, round(avg({_RES}) * 0.7 + 0.3, 5) AS coherence FROM second GROUP BY 1")(lambda v: _secondary(v).groupBy("word_id").agg(F.round(F.avg(E.resonance(F.col("p"), F.col("s"))) * 0.7 + 0.3, 5).alias("coherence")))
query("e31_process_term", f"{_BASE}, c AS (SELECT id, confidence, valence * 0.7::DOUBLE + 0.1::DOUBLE * 0.3::DOUBLE AS valence, arousal * 0.7::DOUBLE - 0.4::DOUBLE * 0.3::DOUBLE AS arousal FROM base) SELECT id, round(valence, 6) + 0 AS valence, round(arousal, 6) + 0 AS arousal, round(confidence * 0.7::DOUBLE + 0.8::DOUBLE * 0.3::DOUBLE, 6) + 0 AS confidence, (abs(valence) > 0.7)::INT + (arousal > 0.7)::INT AS metas FROM c")(
    lambda v: _base(v).select("id", E.apply_context(F.col("m"), E.literal(DOMAIN_CONTEXTS["academic"])).alias("m"), "confidence").select("id", _R(E.at(F.col("m"), "valence")).alias("valence"), _R(E.at(F.col("m"), "arousal")).alias("arousal"), _R(F.col("confidence") * 0.7 + 0.8 * 0.3).alias("confidence"), F.size(F.filter(E.meta_emotions(F.col("m")), lambda x: x["label"] != "awareness_of_emotional_complexity")).alias("metas"))
)
query("a20_context_dominance", "SELECT name, round(least(1, count(*) / 10 * avg(abs(x)) * 2), 6) + 0 AS dominance FROM (VALUES " + ", ".join(f"('{n}', {x}::DOUBLE)" for n, f in DOMAIN_CONTEXTS.items() for x in f.values()) + ") t(name, x) GROUP BY 1")(lambda v: v.spark.createDataFrame([(n, f) for n, f in DOMAIN_CONTEXTS.items()], "name string, f map<string,double>").select("name", _R(E.context_dominance(F.col("f"))).alias("dominance")))
query("a21_dominant_emotion", f"{_BASE} SELECT p.id, arg_max(e.v, (abs(e.a), -e.v)) AS other FROM base p JOIN (SELECT a AS id, b AS v, arousal AS a FROM adj JOIN base ON base.id = b) e USING (id) GROUP BY 1")(lambda v: graph.adjacency(v.edges).join(_base(v).select(F.col("id").alias("b"), E.at(F.col("m"), "arousal").alias("x")), "b").groupBy(F.col("a").alias("id")).agg(F.max_by("b", F.struct(F.abs("x"), -F.col("b"))).alias("other")))
query("e37_valid_ranges", "SELECT id, valence BETWEEN -0.2 AND 0.2 AS ok FROM emotions")(lambda v: v.emotions.select("id", F.col("valence").between(-0.2, 0.2).alias("ok")))
query("e39_register_context", "SELECT 'mix' AS name, d AS dim, x::DOUBLE AS x FROM (VALUES ('valence', 0.9), ('arousal', -0.4), ('dominance', 0.3), ('certainty', 0.7), ('social', -0.2)) t(d, x)")(lambda v: v.spark.createDataFrame([("mix", DOMAIN_CONTEXTS["academic"] | {"valence": 0.9})], "name string, f map<string,double>").select("name", F.explode("f").alias("dim", "x")))
query("e42_default_concept", "SELECT id, CASE WHEN id % 10 = 0 THEN 0 ELSE round(valence, 6) END AS valence, CASE WHEN id % 10 = 0 THEN 0.5::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM emotions")(lambda v: v.emotions.withColumn("t", F.when(F.col("id") % 10 != 0, F.col("term")).otherwise("")).select("id", F.when(F.col("t") == "", 0.0).otherwise(_R("valence")).alias("valence"), F.when(F.col("t") == "", 0.5).otherwise(0.7).alias("confidence")))
query("e43_normalised_secondary", f"{_SEC} SELECT word_id, label, round(sv / sqrt(sv * sv + sa * sa + sd * sd), 6) + 0 AS valence FROM second WHERE sv * sv + sa * sa + sd * sd > 0")(lambda v: _secondary(v).where(E.norm(F.col("s")) > 0).select("word_id", "label", _R(E.at(E.normalized(F.col("s")), "valence")).alias("valence")))
query("e44_serialise", "SELECT id, round(valence, 6) + 0 AS valence FROM emotions")(lambda v: v.emotions.select("id", F.from_json(F.to_json("m"), "map<string,double>").alias("m")).select("id", _R(E.at(F.col("m"), "valence")).alias("valence")))
query("e45_category_weights", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {w}::DOUBLE, {t}::DOUBLE)" for n, w, t, _ in CATEGORIES) + ") t(label, weight, threshold)")(lambda v: categories(v.spark).select("label", "weight", "threshold"))
query("u05_dimension_sets", "SELECT u, v, 2 + (d1 IS NOT NULL OR d2 IS NOT NULL)::INT AS either, 2 + (d1 IS NOT NULL AND d2 IS NOT NULL)::INT AS common FROM pairs")(lambda v: _pairs(v).select("u", "v", F.size(F.array_union(F.map_keys("mu"), F.map_keys("mv"))).alias("either"), F.size(F.array_intersect(F.map_keys("mu"), F.map_keys("mv"))).alias("common")))

# messages carry few keywords; the conversation id adds one to each
_WORDS = [c[3][0] for c in CATEGORIES]
_CASE = "CASE conversation_id % 7 " + " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(_WORDS)) + " END"
_MSG = f", msg AS (SELECT id, concat(text, ' ', {_CASE}, CASE WHEN id % 3 = 0 THEN ' happy!' ELSE '' END) AS text, (id % 9 - 4) / 5 AS valence FROM messages)"
_COUNT = {label: " + ".join(f"CAST((length(lower(text)) - length(replace(lower(text), '{w}', ''))) / {len(w)} AS BIGINT)" for w in words) for label, _, _, words in CATEGORIES}


def _msg(v):
    word = F.element_at(F.array(*map(F.lit, _WORDS)), (F.col("conversation_id") % 7 + 1).cast("int"))
    return v.messages.select("id", F.concat("text", F.lit(" "), word, F.when(F.col("id") % 3 == 0, " happy!").otherwise("")).alias("text"), ((F.col("id") % 9 - 4) / 5).alias("valence"))


_best = lambda ls: "greatest(" + ", ".join(f"c_{k}" for k in ls) + ")"
_first = lambda ls, m: "CASE " + " ".join(f"WHEN c_{k} = {m} THEN '{k}'" for k in ls) + " END"
_pos, _neg = C.POSITIVE, C.NEGATIVE
_CLS = f"""{_MSG}, cnt AS (SELECT *, {", ".join(f"{e} AS c_{k}" for k, e in _COUNT.items())} FROM msg),
top AS (SELECT *, {_best(LABELS)} AS mx, {_first(LABELS, _best(LABELS))} AS t FROM cnt),
lab AS (SELECT *, CASE WHEN mx = 0 THEN CASE WHEN valence > 0.3 THEN 'happiness' WHEN valence < -0.3 THEN 'sadness' ELSE 'neutral' END
  WHEN t IN ('happiness', 'surprise') AND valence < -0.3 THEN CASE WHEN {_best(_neg)} > 0 THEN {_first(_neg, _best(_neg))} ELSE 'sadness' END
  WHEN t IN ('sadness', 'anger', 'fear', 'disgust') AND valence > 0.3 THEN CASE WHEN {_best(_pos)} > 0 THEN {_first(_pos, _best(_pos))} ELSE 'happiness' END ELSE t END AS label FROM top),
conf AS (SELECT *, CASE WHEN mx > 0 THEN greatest(0.3::DOUBLE, least(mx / 3, 1) * 0.6::DOUBLE) ELSE 0.3::DOUBLE END AS b, CASE label {" ".join(f"WHEN '{k}' THEN {t}::DOUBLE" for k, _, t, _ in CATEGORIES)} END AS th FROM lab),
rai AS (SELECT *, CASE WHEN (label IN ('happiness', 'surprise') AND valence > 0.3) OR (label IN ('sadness', 'anger', 'fear', 'disgust') AND valence < -0.3) THEN least(b + 0.15::DOUBLE, 1) ELSE b END AS r FROM conf),
classified AS (SELECT id, label, CASE WHEN r < th THEN (r + th) / 2 ELSE r END AS confidence, {_CASE.replace("conversation_id", "(id // 1000)")} AS word FROM rai)"""
query("x08_keyword_counts", f"{_MSG} SELECT id, {', '.join(f'{e} AS {k}' for k, e in _COUNT.items())} FROM msg")(lambda v: _msg(v).select("id", *[c.alias(k) for k, c in C.keyword_counts(F.col("text")).items()]))
query("e20_classify", f"{_CLS} SELECT id, label, round(confidence, 6) + 0 AS confidence FROM classified")(lambda v: C.classify(_msg(v)).select("id", "label", _R("confidence").alias("confidence")))
query("e32_full_analysis", f"{_CLS} SELECT id, label, round(confidence, 6) + 0 AS confidence, CASE WHEN label = 'neutral' THEN 1 ELSE 2 END AS depth FROM classified")(lambda v: C.classify(_msg(v)).select("id", "label", _R("confidence").alias("confidence"), F.when(F.col("label") == "neutral", 1).otherwise(2).alias("depth")))


def _scored(v):
    actual = F.element_at(F.array(*map(F.lit, LABELS)), (F.floor(F.col("id") / 1000) % 7 + 1).cast("int"))
    rows = C.classify(_msg(v)).select(F.col("label").alias("predicted"), actual.alias("actual"))
    return stats.scores(stats.confusion(rows, categories(v.spark)))


_ACT = "CASE id // 1000 % 7 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(LABELS)) + " END"
_CONF = f"""{_CLS}, pa AS (SELECT label AS p, {_ACT} AS a FROM classified), cats(ord, label, weight) AS (VALUES {", ".join(f"({k}, '{n}', {w}::DOUBLE)" for k, (n, w, _, _) in enumerate(CATEGORIES))}),
cf AS (SELECT label, weight, count(*) FILTER (p = label AND a = label) AS tp, count(*) FILTER (p = label AND a <> label) AS fp, count(*) FILTER (p <> label AND a = label) AS fn FROM cats, pa GROUP BY 1, 2),
sc AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re FROM cf)"""
query("a16_confusion", f"{_CONF} SELECT label, tp, fp, fn FROM cf")(lambda v: _scored(v).select("label", "tp", "fp", "fn"))
query("a17_scores", f"{_CONF} SELECT label, round(pr, 6) + 0 AS precision, round(re, 6) + 0 AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) + 0 AS f1 FROM sc")(lambda v: _scored(v).select("label", *[_R(c).alias(c) for c in ("precision", "recall", "f1")]))
query("a17_macro", f"{_CONF} SELECT round(avg(pr), 6) + 0 AS precision, round(avg(re), 6) + 0 AS recall, round(avg(coalesce(2 * pr * re / nullif(pr + re, 0), 0)), 6) + 0 AS f1, round(sum(tp) / (SELECT count(*) FROM pa), 6) + 0 AS accuracy FROM sc")(lambda v: _scored(v).agg(*[_R(F.avg(c)).alias(c) for c in ("precision", "recall", "f1")], _R(F.sum("tp") / F.sum(F.col("tp") + F.col("fn"))).alias("accuracy")))
query("a18_tuned_weights", f"{_CONF} SELECT label, round(CASE WHEN tp + fp < 10 THEN weight WHEN pr < 0.5 THEN greatest(0.1, weight * 0.9::DOUBLE) WHEN pr > 0.8 THEN least(1, weight * 1.1::DOUBLE) ELSE weight END, 6) + 0 AS weight FROM sc")(lambda v: stats.tuned_weights(_scored(v), categories(v.spark)).select("label", _R("weight").alias("weight")))
query("f22_keyword_resolution", "SELECT label, count(*) AS n FROM (VALUES " + ", ".join(f"('{n}', '{w}')" for n, _, _, ws in CATEGORIES for w in (["glee"] if n == "happiness" else ws)) + ") t(label, word) GROUP BY 1")(lambda v: categories(v.spark).select("label", F.explode(F.coalesce(F.when(F.col("label") == "happiness", F.array(F.lit("glee"))), F.col("keywords"))).alias("w")).groupBy("label").agg(F.count(F.lit(1)).alias("n")))


_LEXICON = "CASE w " + " ".join(f"WHEN '{w}' THEN {x}::DOUBLE" for w, x in sorted(C.seed_lexicon().items())) + " ELSE 0::DOUBLE END"
_SCORED_TEXT = f"""SELECT *, s / sqrt(s * s + 15) AS p, least((length(text) - length(replace(text, '!', ''))) / 5, 1) AS marks, length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) / greatest(length(text), 1) AS upper
  FROM (SELECT *, list_sum(list_transform(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: {_LEXICON})) AS s FROM {{rows}})"""
_AROUSAL = "greatest(0, least(1, (abs(p) + marks + upper * 2 + abs(p) * 4) / 5))"
_FELT = _MSG + f", felt AS ({_SCORED_TEXT.replace('{rows}', 'msg')})"


@query("e19_text_emotion", f"{_FELT} SELECT id, round(p, 6) + 0 AS valence, round({_AROUSAL}, 6) + 0 AS arousal FROM felt")
def _(v):
    e = C.text_emotion(F.col("text"))
    return _msg(v).select("id", *[_R(e[k]).alias(k) for k in ("valence", "arousal")])


@query("e21_process_messages", _CLS.replace(_MSG, _FELT + ", spoken AS (SELECT id, text, p AS valence FROM felt)").replace("FROM msg),\ntop", "FROM spoken),\ntop") + " SELECT id, label, round(confidence, 6) + 0 AS confidence FROM classified")
def _(v):
    e = C.text_emotion(F.col("text"))
    return C.classify(_msg(v).withColumns(e)).select("id", "label", _R("confidence").alias("confidence"))


@query("e40_enrich_words", f" SELECT id AS word_id, round(p, 6) + 0 AS valence, round({_AROUSAL}, 6) + 0 AS arousal FROM ({_SCORED_TEXT.replace('{rows}', '(SELECT id, term AS text FROM words)')})")
def _(v):
    e = C.text_emotion(F.col("term"))
    return v.words.select(F.col("id").alias("word_id"), *[_R(e[k]).alias(k) for k in ("valence", "arousal")])
