"""Emotion vectors as Columns: map<dimension, double> with a confidence beside it; all of it built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..catalog import HEURISTIC, META, PRIMARY


def clip(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def clamp(m: Column) -> Column:
    return F.transform_values(m, lambda k, v: clip(v))


def at(m: Column, dim: str) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(dim)), F.lit(0.0))


def both(a: Column, b: Column, f) -> Column:
    """f over the union of the dimensions; a missing one counts as 0."""
    return F.map_zip_with(a, b, lambda k, x, y: f(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def norm(m: Column) -> Column:
    return F.sqrt(total(F.transform(F.map_values(m), lambda x: x * x)))


def distance(a: Column, b: Column) -> Column:
    return norm(both(a, b, lambda x, y: x - y))


def blend(a: Column, b: Column, weight: float = 0.5) -> Column:
    return clamp(both(a, b, lambda x, y: x * (1 - weight) + y * weight))


def inverse(m: Column) -> Column:
    """Primary dimensions only, negated."""
    return F.transform_values(F.map_filter(m, lambda k, v: k.isin(PRIMARY)), lambda k, v: -v)


def scale(m: Column, factor: float) -> Column:
    return clamp(F.transform_values(m, lambda k, v: v * factor))


def intensify(m: Column, factor: float = 1.5) -> Column:
    return scale(m, factor)


def diminish(m: Column, factor: float = 0.5) -> Column:
    return scale(m, factor)


def normalized(m: Column) -> Column:
    size = norm(m)
    return F.when(size == 0, m).otherwise(F.transform_values(m, lambda k, v: v / size))


def dominant(m: Column) -> Column:
    """Dimension with the largest absolute value, the first one of equals."""
    entries = F.transform(F.map_entries(m), lambda e, i: F.struct((-F.abs(e["value"])).alias("v"), i.alias("i"), e["key"].alias("k")))
    return F.get(F.sort_array(entries), F.lit(0))["k"]


def contrast(a: Column, b: Column) -> Column:
    return F.map_filter(both(a, b, lambda x, y: x - y), lambda k, v: F.abs(v) > 0.1)


def resonance(a: Column, b: Column) -> Column:
    """(cosine + 1) / 2 over common dimensions; 0 without any or for a zero vector."""
    ax = F.map_filter(a, lambda k, v: F.map_contains_key(b, k))
    bx = F.map_filter(b, lambda k, v: F.map_contains_key(a, k))
    size = norm(ax) * norm(bx)
    dot = total(F.map_values(both(ax, bx, lambda x, y: x * y)))
    return F.when((F.size(ax) == 0) | (size == 0), F.lit(0.0)).otherwise((dot / F.when(size != 0, size) + 1) / 2)


def entropy(m: Column) -> Column:
    sums = total(F.transform(F.map_values(m), F.abs))
    raw = -total(F.transform(F.filter(F.map_values(m), lambda v: v != 0), lambda v: F.abs(v) / sums * F.log2(F.abs(v) / sums)))
    return F.when((F.size(m) <= 1) | (sums == 0), F.lit(0.0)).otherwise(raw / F.log2(F.size(m)))


def with_dimension(m: Column, dim: str, value: Column) -> Column:
    return F.map_concat(F.map_filter(m, lambda k, v: k != dim), F.create_map(F.lit(dim), clip(value)))


def of_category(m: Column, category: str) -> Column:
    keep = {"primary": PRIMARY, "meta": META}[category]
    return F.map_filter(m, lambda k, v: k.isin(keep))


def combine_contexts(a: Column, b: Column, weight: float = 0.5) -> Column:
    """Factors in both are blended, those only left stay, those only right count with the weight."""
    return F.map_zip_with(a, b, lambda k, x, y: F.when(y.isNull(), x).when(x.isNull(), y * weight).otherwise(x * (1 - weight) + y * weight))


def literal(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv]) if values else F.from_json(F.lit("{}"), "map<string,double>")


def apply_context(m: Column, factors: Column) -> Column:
    """Blend with the clamped context at weight 0.3; a context without factors changes nothing."""
    return F.when(F.size(factors) == 0, m).otherwise(blend(m, clamp(factors), 0.3))


def context_dominance(factors: Column) -> Column:
    n = F.size(factors)
    mean = total(F.transform(F.map_values(factors), F.abs)) / F.greatest(n, F.lit(1))
    return F.least(F.lit(1.0), n / 10 * mean * 2)


def evocative(a: Column, b: Column) -> Column:
    v1, a1, d1, v2, a2 = at(a, "valence"), at(a, "arousal"), at(a, "dominance"), at(b, "valence"), at(b, "arousal")
    return F.greatest(
        F.lit(0.2),
        F.when((v1 < -0.3) & (a2 > 0.3), F.least(F.abs(v1), a2)),
        F.when((F.abs(v1) > 0.7) & (F.abs(v2) > 0.5) & (v1 * v2 > 0), F.least(F.abs(v1), F.abs(v2)) * 0.7),
        F.when((a1 > 0.5) & (d1 < -0.3) & (a2 > 0.5) & (v2 < -0.3), F.least(a1, F.abs(d1)) * 0.8),
        F.when((a1 < -0.3) & (d1 > 0.5) & (v2 > 0.5) & (a2 < 0), F.least(F.abs(a1), d1) * 0.7),
    )


def component(part: Column, whole: Column) -> Column:
    strong = lambda m: F.size(F.filter(F.map_values(m), lambda v: F.abs(v) > 0.5))
    matches = F.size(F.map_keys(F.map_filter(part, lambda k, v: (F.abs(v) > 0.4) & F.coalesce((F.abs(F.try_element_at(whole, k)) > 0.4) & (v * F.try_element_at(whole, k) > 0), F.lit(False)))))
    return F.when((strong(part) >= strong(whole)) | (matches == 0), F.lit(0.2)).otherwise(F.least(F.lit(1.0), matches / F.greatest(F.lit(1), strong(part)) * 0.8))


def strength(kind: Column, a: Column, b: Column) -> Column:
    """Strength of a relationship of two terms with vectors a and b, by its type."""
    near = lambda d: F.greatest(F.lit(0.0), 1 - d / 2)
    meta = F.map_values(F.map_filter(b, lambda k, v: k.isin(META)))
    dim = F.regexp_extract(kind, "^([a-z]+)_related$", 1)
    return (
        F.when(kind.isin("emotional_synonym", "synonym"), near(distance(a, b)))
        .when(kind.isin("emotional_antonym", "antonym"), near(distance(inverse(a), b)))
        .when(kind == "intensifies", near(distance(intensify(a), b)))
        .when(kind == "diminishes", near(distance(diminish(a), b)))
        .when(kind.isin("evokes", "responds_to"), evocative(a, b))
        .when(dim.isin(PRIMARY), 1 - F.abs(F.coalesce(F.try_element_at(a, dim), F.lit(0.0)) - F.coalesce(F.try_element_at(b, dim), F.lit(0.0))))
        .when(kind == "emotional_component", component(a, b))
        .when(kind == "emotional_composite", component(b, a))
        .when(kind == "meta_emotion", total(F.transform(meta, F.abs)) / len(META))
        .otherwise(near(distance(a, b)))
    )


def md5_mod_million(term: Column) -> Column:
    """The md5 of a term as a number, modulo a million."""
    out = F.lit(0).cast("long")
    for k in range(4):
        out = (out * 4294967296 + F.conv(F.substring(F.md5(term), 8 * k + 1, 8), 16, 10).cast("long")) % 1_000_000
    return out


def _base(text: Column, high: str, low: str) -> Column:
    return F.when(text.rlike(HEURISTIC[high]), F.lit(0.5)).when(text.rlike(HEURISTIC[low]), F.lit(-0.5)).otherwise(F.lit(0.0))


def heuristic(term: Column) -> dict[str, Column]:
    """Valence, arousal and dominance from a term's text and md5."""
    h, text = md5_mod_million(term), F.lower(term)
    part = lambda step: F.floor(h / step) % 100 / 100
    consonants = F.length(F.regexp_replace(text, "[^bcdfghjklmnpqrstvwxz]", "")) / F.greatest(F.length(term), F.lit(1))
    return {
        "valence": clip(_base(text, "positive", "negative") + (part(1) - 0.5) * 0.5),
        "arousal": clip(_base(text, "excited", "calm") + (consonants - 0.5) + part(100) - 0.5),
        "dominance": clip(_base(text, "strong", "weak") + part(10_000) - 0.5),
    }


def heuristic_map(term: Column) -> Column:
    return F.create_map(*[x for k, v in heuristic(term).items() for x in (F.lit(k), v)])


def meta_emotions(m: Column, conflict: Column | None = None, hooks: bool = False) -> Column:
    """Array of (label, dims, confidence) that a concept's primary vector calls for; hooks: the registered variants."""
    v, a = at(m, "valence"), at(m, "arousal")
    made = lambda label, dims, conf: F.struct(F.lit(label).alias("label"), F.create_map(*[x for k, y in dims.items() for x in (F.lit(k), F.lit(y) if isinstance(y, float) else y)]).alias("dims"), F.lit(conf).alias("confidence"))
    many = F.size(F.filter(F.map_values(m), lambda x: F.abs(x) > 0.5)) >= 3
    found = [
        F.when(F.abs(v) > 0.7, made("awareness_of_emotional_clarity", {"valence": 0.3, "arousal": 0.2, "certainty": 0.8, "meta_clarity": 0.9}, 0.8)),
        F.when(a > 0.7, made("response_to_activation", {"valence": F.when(a > 0.9, F.lit(-0.2)).otherwise(F.lit(0.2)), "arousal": -0.5, "dominance": F.when(a < 0.9, F.lit(0.3)).otherwise(F.lit(-0.3)), "meta_stability": -0.4}, 0.7)),
        F.when(many, made("awareness_of_emotional_complexity", {"valence": 0.2, "arousal": 0.3 if hooks else 0.1, "certainty": -0.3, "meta_complexity": 0.8 if hooks else 0.9}, 0.7)),
    ]
    if conflict is not None:
        found.append(F.when(conflict, made("response_to_emotional_incongruence", {"valence": -0.3, "arousal": 0.4, "certainty": -0.5, "meta_congruence": -0.8}, 0.6)))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _state(name: str, dims: Column, confidence) -> Column:
    return F.struct(F.lit(name).alias("name"), dims.alias("dims"), (F.lit(confidence) if isinstance(confidence, float) else confidence).cast("double").alias("confidence"))


def temporal_sequence(m: Column, confidence: Column, fade: float = 0.8) -> Column:
    end = F.transform_values(diminish(m, 0.5), lambda k, v: F.when(k == "valence", v * fade).otherwise(v))
    return F.array(_state("onset", diminish(m, 0.7), confidence), _state("peak", m, confidence), _state("offset", end, confidence))


def intensity_gradation(m: Column, confidence: Column, certainty: float = -0.3, social: float = -0.2) -> Column:
    extreme = scale(m, 2.0)
    extreme = F.map_concat(extreme, F.map_filter(literal({"certainty": certainty, "social": social}), lambda k, v: ~F.map_contains_key(m, k)))
    return F.array(_state("minimal", scale(m, 0.2), 0.7), _state("low", scale(m, 0.5), 0.8), _state("medium", m, confidence), _state("high", scale(m, 1.5), 0.8), _state("extreme", extreme, 0.7))


def _shift(m: Column, changes: dict[str, float]) -> Column:
    changed = F.create_map(*[x for k, d in changes.items() for x in (F.lit(k), clip(at(m, k) + d))])
    return F.map_concat(F.map_filter(m, lambda k, v: ~k.isin(list(changes))), changed)


def contextual_variations(m: Column) -> Column:
    muted = F.transform_values(m, lambda k, v: F.when((k == "valence") & (v < 0), v * 0.5).otherwise(v))
    return F.array(
        _state("personal", _shift(m, {"intensity": 0.3, "relevance": 0.4, "social": 0.5}), 0.7),
        _state("professional", _shift(m, {"intensity": -0.3, "dominance": 0.2, "certainty": 0.3}), 0.7),
        _state("social", _shift(muted, {"social": 0.6}), 0.7),
        _state("cultural", _shift(m, {"intensity": -0.2, "certainty": -0.3}), 0.6),
    )


def random_emotion(id_: Column, seed: int = 7) -> list[Column]:
    """Valence in [-1, 1) and arousal in [0, 1) that follow from the id and the seed alone."""
    unit = lambda k: F.conv(F.substring(F.md5(F.concat_ws(":", id_.cast("string"), F.lit(str(seed)), F.lit(k)).cast("binary")), 1, 8), 16, 10).cast("double") / 2**32
    return [(unit("valence") * 2 - 1).alias("valence"), unit("arousal").alias("arousal")]
