"""Dimension tables and constants of the lexical model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Type, weight, colour, bidirectional.
RELATIONSHIP_TYPES = [
    ("synonym", 1.0, "#4287f5", True),
    ("antonym", 0.9, "#f54242", True),
    ("hypernym", 0.7, "#42f584", False),
    ("hyponym", 0.7, "#a142f5", False),
    ("holonym", 0.6, "#f5a142", False),
    ("meronym", 0.6, "#42f5f5", False),
    ("translation", 0.8, "#42d4f5", True),
    ("domain", 0.5, "#7a42f5", False),
    ("function", 0.5, "#f542a7", False),
    ("related", 0.4, "#42f5a1", True),
    ("derived_from", 0.5, "#8c42f5", False),
    ("etymological_source", 0.4, "#f5b942", False),
    ("context", 0.3, "#42d4f5", False),
    ("register", 0.3, "#f542d4", False),
    ("example_of", 0.3, "#7adbf5", False),
    ("instance", 0.4, "#e642f5", False),
    ("emotional_synonym", 0.85, "#8a2be2", True),
    ("emotional_antonym", 0.85, "#ff6347", True),
    ("intensifies", 0.70, "#ff4500", False),
    ("diminishes", 0.70, "#4682b4", False),
    ("evokes", 0.65, "#da70d6", False),
    ("responds_to", 0.65, "#32cd32", False),
    ("valence_related", 0.60, "#ff69b4", True),
    ("arousal_related", 0.60, "#ff8c00", True),
    ("dominance_related", 0.60, "#4b0082", True),
    ("emotional_component", 0.55, "#7b68ee", False),
    ("emotional_composite", 0.55, "#ee82ee", False),
    ("emotional_sequence", 0.50, "#6a5acd", False),
    ("cultural_context", 0.45, "#daa520", False),
    ("situational_context", 0.45, "#20b2aa", False),
    ("temporal_context", 0.45, "#778899", False),
    ("meta_emotion", 0.40, "#800080", False),
    ("emotional_regulation", 0.40, "#008080", False),
]
DEFAULT_WEIGHT, DEFAULT_COLOR, DEFAULT_BIDIRECTIONAL = 0.3, "#aaaaaa", True

# Colours of the types of each dimension; their keys also classify types.
BASE_COLORS = {"synonym": "#4287f5", "antonym": "#f54242", "hypernym": "#42f584", "hyponym": "#a142f5", "holonym": "#f5a142", "meronym": "#42f5f5", "domain": "#7a42f5", "function": "#f542a7", "related": "#42f5a1"}
EMOTIONAL_COLORS = {"joy_associated": "#ffde17", "sadness_associated": "#0077be", "anger_associated": "#d62728", "fear_associated": "#9467bd", "surprise_associated": "#2ca02c", "disgust_associated": "#8c564b", "trust_associated": "#17becf", "anticipation_associated": "#ff7f0e", "emotional_neutral": "#e0e0e0", "emotionally_charged": "#ff1493"}
AFFECTIVE_COLORS = {"positive_valence": "#00cc66", "negative_valence": "#cc3300", "high_arousal": "#ff9900", "low_arousal": "#3366cc", "high_dominance": "#cc00cc", "low_dominance": "#669999", "valence_neutral": "#cccccc"}

# Label, weight, threshold, keywords, in the order that breaks ties.
CATEGORIES = [
    ("happiness", 0.8, 0.7, ["happy", "joy", "delight", "pleased", "glad", "excited"]),
    ("sadness", 0.7, 0.6, ["sad", "unhappy", "depressed", "down", "miserable", "gloomy"]),
    ("anger", 0.8, 0.8, ["angry", "furious", "enraged", "mad", "irritated", "annoyed"]),
    ("fear", 0.7, 0.7, ["afraid", "scared", "frightened", "terrified", "anxious", "worried"]),
    ("surprise", 0.6, 0.5, ["surprised", "astonished", "amazed", "shocked", "startled"]),
    ("disgust", 0.7, 0.7, ["disgusted", "revolted", "repulsed", "sickened", "appalled"]),
    ("neutral", 0.3, 0.3, ["okay", "fine", "neutral", "indifferent", "average"]),
]
LABELS = [c[0] for c in CATEGORIES]
KEYWORD_WEIGHT = 0.6

# Emotion dimensions.
PRIMARY = ["valence", "arousal", "dominance"]
EXTENDED = ["certainty", "relevance", "novelty", "agency", "social", "temporal", "potency", "familiarity", "intensity"]
META = ["meta_complexity", "meta_stability", "meta_congruence", "meta_clarity", "meta_awareness"]
DIMENSIONS = PRIMARY + EXTENDED + META

# Adjustments of the domains.
DOMAIN_CONTEXTS = {
    "academic": {"valence": 0.1, "arousal": -0.4, "dominance": 0.3, "certainty": 0.7, "social": -0.2},
    "casual": {"valence": 0.3, "arousal": 0.4, "dominance": 0.0, "certainty": -0.2, "social": 0.5},
    "medical": {"valence": -0.2, "arousal": -0.1, "dominance": 0.5, "certainty": 0.8, "relevance": 0.9},
    "literary": {"valence": 0.0, "arousal": 0.2, "dominance": 0.0, "novelty": 0.7, "temporal": 0.5},
}

# Words that term extraction leaves out.
COMMON_WORDS = ["the", "and", "that", "have", "this", "with", "from", "they", "you", "what", "which", "their", "will", "would", "make", "when", "more", "other", "about", "some", "then", "than"]

# Words with a known place in an emotional dimension.
REFERENCE_WORDS = [("happy", "valence", 0.8), ("sad", "valence", -0.8), ("angry", "arousal", 0.9), ("calm", "arousal", -0.7), ("powerful", "dominance", 0.9), ("weak", "dominance", -0.8), ("certain", "certainty", 0.9), ("uncertain", "certainty", -0.8), ("important", "relevance", 0.9), ("trivial", "relevance", -0.7), ("novel", "novelty", 0.9), ("familiar", "novelty", -0.7), ("responsible", "agency", 0.8), ("helpless", "agency", -0.8), ("connected", "social", 0.9), ("isolated", "social", -0.9), ("future", "temporal", 0.7), ("past", "temporal", -0.7)]

# Affixes of derived terms.
SUFFIXES = ["ing", "ed", "er", "ion", "ity", "ment", "ness", "ly"]
PREFIXES = ["un", "re", "in", "dis", "over", "under"]

# Patterns of the heuristic emotion.
HEURISTIC = {
    "positive": "happ|joy|love|good|great|nice|win|pleasant|delight|content",
    "negative": "sad|anger|hate|bad|awful|terr|fear|anxi|depress|rage|grief",
    "excited": "excit|thrill|energe|passion|intens|ecsta|vigor|alert|awake",
    "calm": "calm|relax|tranquil|peace|serene|gentle|quiet|sleep",
    "strong": "power|control|domin|master|confiden|assert|strong",
    "weak": "weak|submiss|vulnerab|helpless|fragile|timid",
}

# Instruction texts of embedding queries.
INSTRUCTIONS = {
    "search": "Given a web search query, retrieve relevant passages that answer the query",
    "definition": "Find the definition that best matches this term",
    "similarity": "Measure semantic similarity between these text passages",
}
INSTRUCTION_PREFIX = "Instruct: {task}\nQuery: "


def relationship_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RELATIONSHIP_TYPES, "type string, weight double, color string, bidirectional boolean")


def categories(spark: SparkSession) -> DataFrame:
    rows = [(k, label, w, t, words) for k, (label, w, t, words) in enumerate(CATEGORIES)]
    return spark.createDataFrame(rows, "ord int, label string, weight double, threshold double, keywords array<string>")
