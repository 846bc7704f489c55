"""Rule-based affect of texts: keyword counts, categories, valence and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..catalog import CATEGORIES, KEYWORD_WEIGHT, LABELS
from ..functions.emotion import clip
from ..functions.text import count_of, exclamation_factor, upper_ratio

POSITIVE, NEGATIVE = ["happiness", "surprise"], ["sadness", "anger", "fear", "disgust"]


def keyword_counts(text: Column, keywords: dict[str, list[str]] | None = None) -> dict[str, Column]:
    """Substring counts of each category's keywords; given keywords replace a category's own."""
    low = F.lower(text)
    own = {label: words for label, _, _, words in CATEGORIES} | (keywords or {})
    return {label: sum((count_of(low, w) for w in own[label]), F.lit(0).cast("long")) for label in LABELS}


def seed_lexicon() -> dict[str, float]:
    """Polarity of the category keywords, a small stand-in for a sentiment lexicon."""
    sign = {"happiness": 2.0, "surprise": 1.0, "sadness": -2.0, "anger": -2.5, "fear": -2.0, "disgust": -2.5, "neutral": 0.0}
    return {w: sign[label] for label, _, _, words in CATEGORIES for w in words if sign[label]}


def polarity(text: Column, lexicon: dict[str, float] | None = None, alpha: float = 15.0) -> Column:
    """Sum of word values, normalised by s / sqrt(s * s + alpha)."""
    table = F.create_map(*[F.lit(x) for kv in sorted((lexicon or seed_lexicon()).items()) for x in kv])
    words = F.split(F.lower(text), "[^\\p{L}\\p{N}_]+")
    total = F.aggregate(words, F.lit(0.0), lambda s, w: s + F.coalesce(F.try_element_at(table, w), F.lit(0.0)))
    return total / F.sqrt(total * total + alpha)


def text_emotion(text: Column, lexicon: dict[str, float] | None = None) -> dict[str, Column]:
    """Valence and arousal of a text: weighted means over the sources."""
    p = polarity(text, lexicon)
    arousal = (F.abs(p) * 1.0 + exclamation_factor(text) * 1.0 + upper_ratio(text) * 2 * 1.0 + F.abs(p) * 2 * 2.0) / 5.0
    return {"valence": clip((p * 0.3 + p * 0.7) / (0.3 + 0.7)), "arousal": clip(arousal, 0.0, 1.0)}


def classify(rows: DataFrame, text: str = "text", valence: str = "valence") -> DataFrame:
    """rows with label and confidence."""
    own = rows.columns
    counted = rows.withColumns({f"__{k}": c for k, c in keyword_counts(F.col(text)).items()})
    best = lambda labels: F.greatest(*[F.col(f"__{k}") for k in labels])

    def first(labels: list[str], count: Column) -> Column:
        return F.coalesce(*[F.when(F.col(f"__{k}") == count, F.lit(k)) for k in labels])

    v = F.col(valence)
    counted = counted.withColumn("__max", best(LABELS)).withColumn("__top", first(LABELS, F.col("__max")))
    pick = lambda labels, other: F.when(best(labels) > 0, first(labels, best(labels))).otherwise(F.lit(other))
    label = (
        F.when(F.col("__max") == 0, F.when(v > 0.3, "happiness").when(v < -0.3, "sadness").otherwise("neutral"))
        .when(F.col("__top").isin(POSITIVE) & (v < -0.3), pick(NEGATIVE, "sadness"))
        .when(F.col("__top").isin(NEGATIVE) & (v > 0.3), pick(POSITIVE, "happiness"))
        .otherwise(F.col("__top"))
    )
    counted = counted.withColumn("label", label)
    threshold = F.coalesce(*[F.when(F.col("label") == k, F.lit(t)) for k, _, t, _ in CATEGORIES])
    base = F.when(F.col("__max") > 0, F.greatest(F.lit(0.3), F.least(F.col("__max") / 3, F.lit(1.0)) * KEYWORD_WEIGHT)).otherwise(F.lit(0.3))
    agrees = (F.col("label").isin(POSITIVE) & (v > 0.3)) | (F.col("label").isin(NEGATIVE) & (v < -0.3))
    raised = F.when(agrees, F.least(base + 0.15, F.lit(1.0))).otherwise(base)
    final = F.when(raised < threshold, (raised + threshold) / 2).otherwise(raised)
    return counted.withColumn("confidence", clip(final, 0.0, 1.0)).select(*own, "label", "confidence")
