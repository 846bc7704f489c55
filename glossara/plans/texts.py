"""Queries over text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import COMMON_WORDS, INSTRUCTION_PREFIX, INSTRUCTIONS, PREFIXES, SUFFIXES
from ..functions import text as X
from .registry import query

_R = lambda c: F.round(c, 6)
_COMMON = ", ".join(f"'{w}'" for w in COMMON_WORDS)
_TERMS = "list_distinct(list_transform(list_filter(regexp_split_to_array({t}, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-zA-Z]{{3,}}')), lambda w: lower(w)))"


def _docs(v):
    return v.table("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


def _long(v):
    return _docs(v).select("doc_id", F.explode(X.regex_terms(F.col("text"))).alias("term"))


query("x01_regex_terms", f"SELECT doc_id, unnest({_TERMS.format(t='text')}) AS term FROM documents")(_long)
_DEFINED = "concat('DEFINITION: ', coalesce(definition, ''), ' EXAMPLES: ', usage_examples)"
query("x01_definition_terms", f"SELECT id, array_to_string(list_sort({_TERMS.format(t=_DEFINED)}), ',') AS terms FROM words")(lambda v: v.words.select("id", F.array_join(F.array_sort(X.regex_terms(X.term_text(F.col("definition"), F.array("usage_examples")))), ",").alias("terms")))
query("x02_filter_terms", f"SELECT doc_id, t AS term FROM (SELECT doc_id, source, unnest({_TERMS.format(t='text')}) AS t FROM documents) WHERE t NOT IN ({_COMMON}) AND t <> source")(lambda v: _docs(v).select("doc_id", F.explode(X.filter_terms(X.regex_terms(F.col("text")), F.col("source"))).alias("term")))
query("x03_term_score", "SELECT id, length(term) + 3 * (length(term) - length(replace(term, ' ', ''))) + length(regexp_replace(term, '[aeiou]', '', 'g')) AS score FROM words")(lambda v: v.words.select("id", X.term_score(F.col("term")).alias("score")))


@query("t01_top_terms", ", s AS (SELECT DISTINCT term, contains(term, ' ') AS multi, length(term) + 3 * (length(term) - length(replace(term, ' ', ''))) + length(regexp_replace(term, '[aeiou]', '', 'g')) AS score FROM (SELECT lower(term) AS term FROM words UNION SELECT lower(split_part(term, ' ', 1)) FROM words)) (SELECT term, score FROM s WHERE multi ORDER BY score DESC, term LIMIT 100) UNION ALL (SELECT term, score FROM s WHERE NOT multi ORDER BY score DESC, term LIMIT 150)")
def _(v):
    terms = v.words.select(F.lower("term").alias("term")).union(v.words.select(F.lower(F.split_part("term", F.lit(" "), F.lit(1))))).distinct()
    scored = terms.select("term", X.term_score(F.col("term")).alias("score"))
    best = lambda multi, n: scored.where(F.contains("term", F.lit(" ")) == multi).orderBy(F.desc("score"), "term").limit(n)
    return best(True, 100).union(best(False, 150))


query("u04_term_union", f"SELECT DISTINCT t AS term FROM (SELECT unnest({_TERMS.format(t='text')}) AS t FROM documents UNION SELECT lower(p_type) FROM part) WHERE t NOT IN ({_COMMON})")(lambda v: _long(v).select("term").union(v.words.select(F.lower(F.col("definition"))).dropna()).where(~F.col("term").isin(COMMON_WORDS)).distinct())
query("x06_pos_tag", "SELECT DISTINCT part_of_speech, CASE part_of_speech[1] WHEN 'J' THEN 'a' WHEN 'V' THEN 'v' WHEN 'R' THEN 'r' ELSE 'n' END AS tag FROM words")(lambda v: v.words.select("part_of_speech").distinct().select("part_of_speech", F.coalesce(F.try_element_at(F.create_map(*map(F.lit, ("J", "a", "V", "v", "N", "n", "R", "r"))), F.substring("part_of_speech", 1, 1)), F.lit("n")).alias("tag")))
query("x07_key", "SELECT seq, lower(trim(item)) AS key FROM queue")(lambda v: v.queue.select("seq", X.key(F.col("item")).alias("key")))
query("x08_substring_counts", "SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'ea', ''))) / 2 AS BIGINT) AS n FROM documents")(lambda v: _docs(v).select("doc_id", X.count_of(F.lower("text"), "ea").alias("n")))
query("x09_exclamation", "SELECT doc_id, round(least((length(text) - length(replace(text, '!', ''))) / 5, 1), 6) AS factor FROM documents")(lambda v: _docs(v).select("doc_id", _R(X.exclamation_factor(F.col("text"))).alias("factor")))
query("x10_upper_ratio", "SELECT doc_id, round(length(regexp_replace(text, '[^\\p{Lu}]', '', 'g')) / greatest(length(text), 1), 6) AS ratio FROM documents")(lambda v: _docs(v).select("doc_id", _R(X.upper_ratio(F.col("text"))).alias("ratio")))
query("x11_usage_examples", "SELECT id, array_to_string(list_filter(list_transform(string_split(usage_examples, chr(10)), lambda x: trim(x)), lambda x: x <> ''), '|') AS by_line, array_to_string(list_filter(list_transform(string_split(usage_examples, ';'), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> ''), '|') AS by_semicolon FROM words")(lambda v: v.words.select("id", F.array_join(X.examples(F.col("usage_examples")), "|").alias("by_line"), F.array_join(X.examples(F.col("usage_examples"), ";"), "|").alias("by_semicolon")))
query("x12_embedding_text", "SELECT id, concat_ws(' ', term, definition, array_to_string(list_filter(list_transform(string_split(usage_examples, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ')) AS text FROM words")(lambda v: v.words.select("id", X.embedding_text(F.col("term"), F.col("definition"), X.examples(F.col("usage_examples"))).alias("text")))
_PRE = INSTRUCTION_PREFIX.replace("\n", "' || chr(10) || '")
query("x13_instruction", f"SELECT id, '{INSTRUCTIONS['search']}' || chr(10) || '{_PRE}' || term AS search, term AS other FROM words")(lambda v: v.words.select("id", X.instruction(F.col("term"), "search").alias("search"), X.instruction(F.col("term"), "term").alias("other")))
query("x14_query_prompt", "SELECT id, 'Instruct: find' || chr(10) || 'Query: ' || term AS prompt FROM words")(lambda v: v.words.select("id", X.query_prompt(F.col("term"), "find").alias("prompt")))
query("x15_example_sentence", "SELECT id, split_part(trim(split_part('Text. Example Sentence: The ' || term || ' works. More.', 'Example Sentence:', 2)), '.', 1) || '.' AS sentence FROM words")(lambda v: v.words.select("id", X.example_sentence(F.concat(F.lit("Text. Example Sentence: The "), "term", F.lit(" works. More."))).alias("sentence")))
query("x16_truncate", "SELECT doc_id, CASE WHEN length(text) <= 60 THEN text ELSE (CASE WHEN regexp_extract(text[1:60], '(?s)^(.*)\\s', 1) <> '' THEN regexp_extract(text[1:60], '(?s)^(.*)\\s', 1) ELSE text[1:60] END) || '...' END AS text FROM documents")(lambda v: _docs(v).select("doc_id", X.truncate_words(F.col("text"), 60).alias("text")))
query("x17_safe_name", "SELECT id, regexp_replace(term, '[^\\p{L}\\p{N}]', '_', 'g') AS name FROM words")(lambda v: v.words.select("id", X.safe_name(F.col("term")).alias("name")))
query("x18_clock", "SELECT seq, printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS clock FROM (SELECT seq, CAST(greatest(floor((value - 10) * 1000), 0) AS BIGINT) % 86400 AS s FROM queue)")(lambda v: v.queue.select("seq", X.clock((F.col("value") - 10) * 1000).alias("clock")))
query("x19_transcript", "SELECT conversation_id, string_agg('[' || printf('%d:%02d:%02d', CAST(timestamp AS BIGINT) * 65 // 3600, CAST(timestamp AS BIGINT) * 65 % 3600 // 60, CAST(timestamp AS BIGINT) * 65 % 60) || '] ' || text, chr(10) || chr(10) ORDER BY timestamp, id) AS transcript FROM messages WHERE trim(text) <> '' GROUP BY 1")(
    lambda v: v.messages.where("trim(text) <> ''").groupBy("conversation_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("timestamp", "id", F.concat(F.lit("["), X.clock(F.col("timestamp") * 65), F.lit("] "), "text").alias("line")))), lambda x: x["line"]), "\n\n").alias("transcript"))
)
query("x20_collection_name", "SELECT DISTINCT part_of_speech, 'c_' || lower(replace(split_part('org/' || part_of_speech || '-v2', '/', 2), '-', '_')) AS name FROM words")(lambda v: v.words.select("part_of_speech").distinct().select("part_of_speech", X.collection_name(F.concat(F.lit("org/"), "part_of_speech", F.lit("-v2")), "c_").alias("name")))
query("x21_lemma", "SELECT DISTINCT relationship_type, replace(relationship_type, '_', ' ') AS lemma FROM relationships")(lambda v: v.relationships.select("relationship_type").distinct().withColumn("lemma", X.lemma(F.col("relationship_type"))))
query("x22_style_prefix", "SELECT seq, CASE WHEN starts_with(t, '[Voice v1]: ') THEN t ELSE '[Voice v1]: ' || regexp_replace(t, '^[^\\p{L}\\p{N}]+', '') END AS reply FROM (SELECT seq, CASE WHEN seq % 2 = 0 THEN '[Voice v1]: ' || item ELSE '-- ' || item END AS t FROM queue)")(lambda v: v.queue.select("seq", F.when(F.col("seq") % 2 == 0, F.concat(F.lit("[Voice v1]: "), "item")).otherwise(F.concat(F.lit("-- "), "item")).alias("t")).select("seq", X.styled(F.col("t"), "[Voice v1]: ").alias("reply")))


def _affix_sql() -> str:
    rows = []
    for k, s in enumerate(SUFFIXES):
        rows.append(f"SELECT t, {k} AS k, CASE WHEN ends_with(t, '{s}') THEN 'derived_from' ELSE 'hyponym' END AS kind, CASE WHEN ends_with(t, '{s}') THEN left(t, length(t) - {len(s)}) ELSE t || '{s}' END AS derived, ends_with(t, '{s}') AND length(t) - {len(s)} <= 3 AS short FROM own")
    for k, p in enumerate(PREFIXES):
        kind = "antonym" if p in ("un", "in", "dis") else "related"
        rows.append(f"SELECT t, {k + 50}, CASE WHEN starts_with(t, '{p}') THEN 'derived_from' ELSE '{kind}' END, CASE WHEN starts_with(t, '{p}') THEN substr(t, {len(p) + 1}) ELSE '{p}' || t END, starts_with(t, '{p}') AND length(t) - {len(p)} <= 3 FROM own")
    return " UNION ALL ".join(rows)


query("x23_affix_terms", f", own AS (SELECT DISTINCT lower(p_type) AS t FROM part WHERE length(p_type) > 5 UNION SELECT unnest(['meeting', 'unhappily', 'redness', 'overly'])), made AS ({_affix_sql()}) SELECT t AS term, arg_min(kind, k) AS type, derived FROM made WHERE NOT short GROUP BY t, derived")(
    lambda v: v.table("part").select(F.lower("p_type").alias("__t")).where(F.length("__t") > 5).union(v.spark.createDataFrame([(w,) for w in ("meeting", "unhappily", "redness", "overly")], "t string")).distinct().select(F.col("__t").alias("term"), F.posexplode(X.affix_terms(F.col("__t"))).alias("k", "x")).groupBy("term", F.col("x.term").alias("derived")).agg(F.min_by("x.type", "k").alias("type"))
)
query("x24_json_part", "SELECT event_id AS seq, CAST(json_extract(regexp_extract('answer: ' || props || ' end', '(?s)(\\{.*\\})', 1), '$.k') AS BIGINT) AS k FROM events")(lambda v: v.table("events").select(F.col("event_id").alias("seq"), F.from_json(X.json_part(F.concat(F.lit("answer: "), "props", F.lit(" end"))), "k long")["k"].alias("k")))
