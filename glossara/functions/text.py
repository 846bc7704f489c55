"""Text functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..catalog import COMMON_WORDS, INSTRUCTION_PREFIX, INSTRUCTIONS, PREFIXES, SUFFIXES


def term_text(definition: Column, examples: Column) -> Column:
    return F.concat(F.lit("DEFINITION: "), F.coalesce(definition, F.lit("")), F.lit(" EXAMPLES: "), F.array_join(examples, " "))


def regex_terms(text: Column) -> Column:
    """Distinct lower-cased words of three or more ASCII letters that stand alone."""
    parts = F.split(text, "[^\\p{L}\\p{N}_]+")
    return F.array_distinct(F.transform(F.filter(parts, lambda w: w.rlike("^[a-zA-Z]{3,}$")), F.lower))


def filter_terms(terms: Column, original: Column) -> Column:
    return F.array_except(terms, F.concat(F.array(*map(F.lit, COMMON_WORDS)), F.array(F.lower(original))))


def term_score(term: Column) -> Column:
    return F.length(term) + 3 * (F.length(term) - F.length(F.replace(term, F.lit(" "), F.lit("")))) + F.length(F.regexp_replace(term, "[aeiou]", ""))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def key(text: Column) -> Column:
    return F.lower(strip(text))


def count_of(text: Column, part: str) -> Column:
    """Occurrences of a substring that do not overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def exclamation_factor(text: Column) -> Column:
    return F.least(count_of(text, "!") / 5, F.lit(1.0))


def upper_ratio(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^\\p{Lu}]", "")) / F.greatest(F.length(text), F.lit(1))


def examples(text: Column, separator: str = "\n") -> Column:
    """Usage examples of a joined text, stripped, without empty ones."""
    pattern = {"\n": "\n", ";": ";", "; ": "; "}[separator]
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), pattern), strip), lambda x: x != F.lit(""))


def embedding_text(term: Column, definition: Column, parts: Column) -> Column:
    return F.concat_ws(" ", term, definition, F.array_join(parts, " "))


def instruction(text: Column, template: str) -> Column:
    task = INSTRUCTIONS.get(template)
    return text if task is None else F.concat(F.lit(f"{task}\n{INSTRUCTION_PREFIX}"), text)


def query_prompt(text: Column, task: str) -> Column:
    return F.concat(F.lit(f"Instruct: {task}\nQuery: "), text)


def example_sentence(generated: Column) -> Column:
    """First sentence after "Example Sentence:"."""
    after = F.trim(F.split_part(generated, F.lit("Example Sentence:"), F.lit(2)))
    return F.when(F.instr(generated, "Example Sentence:") > 0, F.concat(F.substring_index(after, ".", 1), F.lit(".")))


def truncate_words(text: Column, limit: int) -> Column:
    """Cut at the last word end within the limit, with "..."."""
    head = F.substring(text, 1, limit)
    cut = F.regexp_extract(head, "(?s)^(.*)\\s", 1)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.when(cut != "", cut).otherwise(head), F.lit("...")))


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, "[^\\p{L}\\p{N}]", "_")


def clock(seconds: Column) -> Column:
    """H:MM:SS without days; negative counts as 0."""
    s = F.greatest(F.floor(seconds), F.lit(0)).cast("long") % 86_400
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), (s % 60).cast("int"))


def collection_name(model: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.lower(F.replace(F.substring_index(model, "/", -1), F.lit("-"), F.lit("_"))))


def lemma(text: Column) -> Column:
    return F.replace(text, F.lit("_"), F.lit(" "))


def styled(text: Column, prefix: str) -> Column:
    """Reply with the style prefix once, and nothing before its first letter or digit."""
    body = F.regexp_replace(text, "^[^\\p{L}\\p{N}]+", "")
    return F.when(F.startswith(text, F.lit(prefix)), text).otherwise(F.concat(F.lit(prefix), body))


def affix_terms(term: Column) -> Column:
    """Array of (type, term, weight) derived by suffixes and prefixes, for terms longer than five, first of equals."""
    one = lambda kind, t, w: F.struct(F.lit(kind).alias("type"), t.alias("term"), F.lit(w).alias("weight"))
    made = []
    for s in SUFFIXES:
        base = F.expr("substring(__t, 1, greatest(length(__t) - %d, 0))" % len(s))
        made.append(F.when(F.endswith(term, F.lit(s)), F.when(F.length(base) > 3, one("derived_from", base, 0.7))).otherwise(one("hyponym", F.concat(term, F.lit(s)), 0.6)))
    for p in PREFIXES:
        base = F.expr("substring(__t, %d)" % (len(p) + 1))
        made.append(F.when(F.startswith(term, F.lit(p)), F.when(F.length(base) > 3, one("derived_from", base, 0.7))).otherwise(one("antonym" if p in ("un", "in", "dis") else "related", F.concat(F.lit(p), term), 0.6)))
    return F.when(F.length(term) > 5, F.filter(F.array(*made), lambda x: x.isNotNull()))


def json_part(text: Column) -> Column:
    return F.regexp_extract(text, "(?s)(\\{.*\\})", 1)


def truthy(text: Column) -> Column:
    """Whether a setting's text stands for true."""
    return F.lower(F.trim(text)).isin("true", "yes", "1", "y")


#: What takes the place of SQLite's automatic key.
KEYS = {"postgres": "SERIAL PRIMARY KEY", "mysql": "INT AUTO_INCREMENT PRIMARY KEY"}


def ddl_dialect(ddl: Column, dialect: str) -> Column:
    return F.replace(ddl, F.lit("INTEGER PRIMARY KEY"), F.lit(KEYS[dialect]))


def connection_uri(path: Column, options: Column) -> Column:
    """file:<path>?<key>=<value>&..., by key; without options the path alone."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&")
    return F.concat(F.lit("file:"), path, F.when(pairs != "", F.concat(F.lit("?"), pairs)).otherwise(F.lit("")))
