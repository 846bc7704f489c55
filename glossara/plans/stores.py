"""Queries over the word store, joins and dictionary sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import categories
from ..functions.text import examples
from ..operators import lexical, store
from ..sources import lexicons
from .registry import query

query("s01_scan_words", "SELECT id, term, coalesce(definition, '') AS definition, coalesce(usage_examples, '') AS usage_examples FROM words")(lambda v: store.all_words(v.words))
query("s04_sql", "SELECT id, term FROM words WHERE term LIKE 'small%'")(lambda v: store.sql(v.spark, "SELECT id, term FROM words WHERE term LIKE :like", {"like": "small%"}, words=v.words))
query("s05_scalar_sql", "SELECT count(*) AS n FROM words")(lambda v: store.sql(v.spark, "SELECT count(*) AS n FROM words", words=v.words))


@query("s06_table_exists", "SELECT * FROM (VALUES ('words', true), ('no_such_table', false)) t(name, found)")
def _(v):
    v.words.createOrReplaceTempView("words")
    names = ["words", "no_such_table"]
    return v.spark.createDataFrame([(t, v.spark.catalog.tableExists(t)) for t in names], "name string, found boolean")


@query("s07_verify_tables", "SELECT true AS complete, false AS incomplete")
def _(v):
    v.words.createOrReplaceTempView("words")
    v.relationships.createOrReplaceTempView("relationships")
    return v.spark.createDataFrame([(store.verify_tables(v.spark), store.verify_tables(v.spark, ("words", "no_such_table")))], "complete boolean, incomplete boolean")


def _entries(v):
    """Dictionary entries from parts: some words have none, some no definition."""
    return v.words.where("id % 3 <> 0").select(F.col("term").alias("word"), "definition", F.when(F.col("id") % 7 != 0, examples(F.col("usage_examples"))).alias("examples"))


_ENTRIES = ", entries AS (SELECT term AS word, definition, CASE WHEN id % 7 <> 0 THEN list_filter(list_transform(string_split(usage_examples, chr(10)), lambda x: trim(x)), lambda x: x <> '') END AS examples FROM words WHERE id % 3 <> 0)"
query("s08_dictionary", f"{_ENTRIES} SELECT term AS word, coalesce(e.definition, 'Not Found') AS definition, coalesce(array_to_string(e.examples, '|'), '') AS examples FROM words w LEFT JOIN (SELECT * FROM entries WHERE definition IS NOT NULL AND examples IS NOT NULL) e ON e.word = w.term")(lambda v: lexical.dictionary(v.words.select(F.col("term").alias("word")), _entries(v)).select("word", "definition", F.array_join("examples", "|").alias("examples")))


def _lines(v):
    """Thesaurus lines: the parts of one order, in line order."""
    rows = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct().join(v.words.select(F.col("id").alias("l_partkey"), "term"), "l_partkey")
    return rows.groupBy(F.col("l_orderkey").alias("line")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "term"))), lambda x: x["term"]).alias("words"))


_LINES = ", items AS (SELECT DISTINCT l_orderkey AS line, l_linenumber, l_partkey, term FROM lineitem JOIN words ON id = l_partkey), placed AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY l_linenumber, l_partkey, term) - 1 AS pos FROM items)"
query("s09_openthesaurus", f"{_LINES}, pairs_ AS (SELECT DISTINCT a.term AS word, b.term AS synonym, b.line, b.pos FROM placed a JOIN placed b ON a.line = b.line AND a.term <> b.term), firsts AS (SELECT word, synonym, min(struct_pack(line := line, pos := pos)) AS spot FROM pairs_ GROUP BY 1, 2) SELECT word, synonym, row_number() OVER (PARTITION BY word ORDER BY spot) - 1 AS place FROM firsts")(lambda v: lexical.openthesaurus(v.words.select(F.col("term").alias("word")), _lines(v)))
query("s10_thesaurus", ", l AS (SELECT s.term AS word, r.related_term AS synonym FROM relationships r JOIN words s ON s.id = r.word_id WHERE lower(relationship_type) = 'synonym') SELECT word, synonym FROM l")(lambda v: lexical.thesaurus(v.words.select(F.col("term").alias("word")), v.relationships.where("lower(relationship_type) = 'synonym'").join(v.words.select(F.col("id").alias("word_id"), F.col("term").alias("word")), "word_id").groupBy("word").agg(F.collect_list("related_term").alias("synonyms"))))


def _triples(v):
    w = v.words.where("id % 5 < 3")
    entry, form = F.concat(F.lit("e"), "id"), F.concat(F.lit("f"), "id")
    t = lambda s, p, o, lang: F.struct(s.alias("s"), F.lit(f"http://lemon/{p}").alias("p"), o.alias("o"), F.lit(lang).alias("lang"))
    return w.select(F.explode(F.filter(F.array(
        t(entry, "canonicalForm", form, None), t(form, "writtenRep", F.col("term"), "en"),
        F.when(F.col("id") % 2 == 0, t(entry, "definition", F.coalesce("definition", F.lit("")), "en")),
        F.when(F.col("id") % 3 == 0, t(entry, "translation", F.col("part_of_speech"), "fr")),
        F.when(F.col("id") % 6 == 0, t(entry, "translation", F.upper("part_of_speech"), "de"))), lambda x: x.isNotNull())).alias("x")).select("x.*")


query("s12_dbnary", "SELECT term AS word, coalesce(CASE WHEN id % 2 = 0 THEN definition END, '') AS definition, coalesce(t, '') AS translation FROM words LEFT JOIN (SELECT id AS i, part_of_speech AS t FROM words WHERE id % 3 = 0 UNION ALL SELECT id, upper(part_of_speech) FROM words WHERE id % 6 = 0) ON i = id WHERE id % 5 < 3 AND (coalesce(CASE WHEN id % 2 = 0 THEN definition END, '') <> '' OR coalesce(t, '') <> '')")(lambda v: lexical.dbnary(v.words.select(F.col("term").alias("word")), _triples(v)))


def _synsets(v):
    rows = v.resolved.join(v.words.select(F.col("id").alias("src_id"), F.col("term").alias("word")), "src_id")
    other = v.words.select(F.col("id").alias("dst_id"), F.col("term").alias("other"), F.col("definition").alias("definition"), "part_of_speech")
    rows = rows.join(other, "dst_id")
    lemma = lambda c: F.array(F.replace(F.concat(F.lit("the_"), c), F.lit("_"), F.lit(" ")))
    none = F.array().cast("array<string>")
    return rows.select("word", F.col("rel_id").alias("ord"), "part_of_speech", F.coalesce("definition", F.lit("")).alias("definition"), F.when(F.lower("relationship_type") == "antonym", none).otherwise(lemma(F.col("other"))).alias("synonyms"), F.when(F.lower("relationship_type") == "antonym", lemma(F.col("other"))).otherwise(none).alias("antonyms"))


_SYN = ", synsets AS (SELECT s.term AS word, rel_id AS ord, d.part_of_speech, coalesce(d.definition, '') AS definition, lower(relationship_type) = 'antonym' AS is_anti, 'the ' || d.term AS lemma FROM resolved JOIN words s ON s.id = src_id JOIN words d ON d.id = dst_id)"
query("s13_wordnet", f"{_SYN} SELECT word, ord, part_of_speech, definition, CASE WHEN is_anti THEN '' ELSE lemma END AS synonyms, CASE WHEN is_anti THEN lemma ELSE '' END AS antonyms FROM synsets")(lambda v: _synsets(v).select("word", "ord", "part_of_speech", "definition", F.array_join("synonyms", "|").alias("synonyms"), F.array_join("antonyms", "|").alias("antonyms")))


@query("s14_dataset", f"{_ENTRIES}{_LINES}{_SYN} SELECT term AS word, coalesce(e.definition, 'Not Found') AS definition, (SELECT count(DISTINCT b.term) FROM placed a JOIN placed b ON a.line = b.line AND a.term <> b.term WHERE a.term = w.term) AS open_synonyms, (SELECT count(*) FROM synsets s WHERE s.word = w.term) AS senses FROM words w LEFT JOIN (SELECT * FROM entries WHERE definition IS NOT NULL AND examples IS NOT NULL) e ON e.word = w.term")
def _(v):
    w = v.words.select(F.col("term").alias("word"))
    lines = v.spark.createDataFrame([], "word string, synonyms array<string>")
    d = lexical.dataset(w, _entries(v), _entries(v), _lines(v), lines, _triples(v), _synsets(v).join(w, "word", "left_semi"))
    n = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long")
    return d.select("word", F.col("odict.definition").alias("definition"), n("openthesaurus").alias("open_synonyms"), n("wordnet").alias("senses"))


query("s17_keyword_registry", ", k AS (SELECT event_type AS label, lower(trim(item)) AS keyword FROM queue UNION ALL SELECT 'fear', concat('w', user_id % 5) FROM queue) SELECT label, string_agg(DISTINCT keyword, ',' ORDER BY keyword) AS keywords FROM k WHERE label IN ('happiness','sadness','anger','fear','surprise','disgust','neutral') GROUP BY 1")(
    lambda v: lexicons.keyword_registry(v.queue.select(F.col("event_type").alias("label"), F.lower(F.trim("item")).alias("keyword")).union(v.queue.select(F.lit("fear"), F.concat(F.lit("w"), F.col("user_id") % 5))), categories(v.spark)).select("label", F.array_join("keywords", ",").alias("keywords"))
)
query("s21_part_of_speech", f"{_SYN} SELECT term AS word, coalesce((SELECT arg_min(part_of_speech, ord) FROM synsets s WHERE s.word = w.term), '') AS part_of_speech FROM words w")(lambda v: lexical.part_of_speech(v.words.select(F.col("term").alias("word")), _synsets(v)))

query("k01_upsert_words", ", new AS (SELECT CASE WHEN id % 2 = 0 THEN term ELSE 'new ' || id END AS term, 'd' || id AS definition, part_of_speech, usage_examples, last_refreshed + 10000 AS last_refreshed FROM words) SELECT coalesce(w.id, (SELECT max(id) FROM words) + row_number() OVER (PARTITION BY w.id IS NULL ORDER BY n.term)) AS id, coalesce(n.term, w.term) AS term, coalesce(n.definition, w.definition) AS definition FROM words w FULL JOIN new n ON n.term = w.term")(
    lambda v: store.upsert_words(v.words, v.words.select(F.when(F.col("id") % 2 == 0, F.col("term")).otherwise(F.concat(F.lit("new "), "id")).alias("term"), F.concat(F.lit("d"), "id").alias("definition"), "part_of_speech", "usage_examples", (F.col("last_refreshed") + 10000).alias("last_refreshed"))).select("id", "term", "definition")
)
query("k02_insert_relationships", ", new AS (SELECT s.term AS base, d.term AS related_term, CASE WHEN q.seq % 3 = 0 THEN '' ELSE 'related' END AS kind, s.id AS word_id FROM queue q JOIN words s ON s.id = q.seq % 1000 JOIN words d ON d.id = (q.seq * 7) % 1000) SELECT DISTINCT word_id, related_term, kind AS relationship_type FROM new n WHERE kind <> '' AND base <> related_term AND NOT EXISTS (SELECT 1 FROM relationships r WHERE r.word_id = n.word_id AND r.related_term = n.related_term AND r.relationship_type = kind)")(
    lambda v: store.insert_relationships(v.relationships, v.words, v.queue.select((F.col("seq") % 1000).alias("a"), (F.col("seq") * 7 % 1000).alias("b"), F.when(F.col("seq") % 3 == 0, "").otherwise("related").alias("relationship_type")).join(v.words.select(F.col("id").alias("a"), F.col("term").alias("base")), "a").join(v.words.select(F.col("id").alias("b"), F.col("term").alias("related_term")), "b").select("base", "related_term", "relationship_type"))
)
query("k03_set_word_emotion", "SELECT user_id AS word_id, round(greatest(-1, least(1, arg_max(value, seq) / 50 - 1)), 6) AS valence FROM queue GROUP BY 1")(lambda v: store.latest(v.queue.select(F.col("user_id").alias("word_id"), "seq", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("value") / 50 - 1)).alias("valence")), "word_id", "seq").select("word_id", F.round("valence", 6).alias("valence")))
query("k04_message_emotion", "SELECT user_id AS message_id, arg_max(event_type, seq) AS label, round(least(1, greatest(0, arg_max(value, seq) / 100)), 6) AS confidence FROM queue GROUP BY 1")(lambda v: store.latest(v.queue.select(F.col("user_id").alias("message_id"), "seq", F.col("event_type").alias("label"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100)).alias("confidence")), "message_id", "seq").select("message_id", "label", F.round("confidence", 6).alias("confidence")))
query("k15_backup_retention", ", b AS (SELECT concat('db_', seq, '.backup') AS path, epoch_us(ts) AS mtime FROM queue) SELECT path, row_number() OVER (ORDER BY mtime DESC, path) <= 10 AS kept FROM b")(lambda v: store.retention(v.queue.select(F.concat(F.lit("db_"), "seq", F.lit(".backup")).alias("path"), F.unix_micros(F.col("ts").cast("timestamp")).alias("mtime"))).select("path", "kept"))
query("k18_integrity", "SELECT 'dangling' AS problem, count(*) AS n FROM relationships WHERE word_id NOT IN (SELECT id FROM words WHERE id % 11 <> 0) UNION ALL SELECT 'duplicate term', count(*) FROM (SELECT term FROM words WHERE id % 11 <> 0 GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'duplicate relationship', count(*) FROM (SELECT 1 FROM relationships GROUP BY word_id, related_term, relationship_type HAVING count(*) > 1)")(lambda v: store.integrity(v.words.where("id % 11 <> 0"), v.relationships))
query("k25_auto_create", "SELECT (SELECT max(id) FROM words) + row_number() OVER (ORDER BY t) AS id, t AS term, concat('Auto-generated entry for ''', t, '''') AS definition FROM (SELECT DISTINCT trim(item) AS t FROM queue) WHERE t NOT IN (SELECT term FROM words)")(lambda v: store.add_terms(v.words.select("id", "term"), v.queue.select(F.trim("item").alias("term")), lower=False).withColumn("definition", F.concat(F.lit("Auto-generated entry for '"), "term", F.lit("'"))))

query("f01_word_id", "SELECT id FROM words WHERE term = 'small ring 0'")(lambda v: v.words.where(F.col("term") == "small ring 0").select("id"))
_ENTRY_SQL = "SELECT w.id, w.term, coalesce(definition, '') AS definition, 'en' AS language, array_to_string(list_filter(list_transform(string_split(usage_examples, chr(10)), lambda x: trim(x)), lambda x: x <> ''), '|') AS usage_examples, coalesce((SELECT string_agg(related_term || '/' || relationship_type, '|' ORDER BY related_term, relationship_type) FROM relationships r WHERE r.word_id = w.id), '') AS relationships FROM words w WHERE "


def _flat_entry(df):
    return df.select("id", "term", "definition", "language", F.array_join("usage_examples", "|").alias("usage_examples"), F.array_join(F.transform("relationships", lambda r: F.concat(r["related_term"], F.lit("/"), r["relationship_type"])), "|").alias("relationships"))


query("f04_word_entry", _ENTRY_SQL + "true")(lambda v: _flat_entry(store.entry(v.words, v.relationships, F.lit(True))))
query("f21_word_search", _ENTRY_SQL + "w.term = lower('SMALL RING 0')")(lambda v: _flat_entry(store.entry(v.words, v.relationships, F.col("term") == F.lower(F.lit("SMALL RING 0")))))
query("f05_relationships_of_word", "SELECT related_term, relationship_type FROM relationships WHERE word_id = 7")(lambda v: v.relationships.where("word_id = 7").select("related_term", "relationship_type"))
query("f13_emotion_lookup", "SELECT word_id, round(valence, 6) AS valence, round(arousal, 6) AS arousal, 0.0::DOUBLE AS dominance FROM word_emotion")(lambda v: v.word_emotion.select("word_id", F.round("valence", 6).alias("valence"), F.round("arousal", 6).alias("arousal"), F.lit(0.0).alias("dominance")))
query("f16_duplicate_terms", "SELECT DISTINCT lower(p_name) AS term FROM part JOIN (SELECT lower(event_type) || ' ring' AS t FROM events UNION SELECT 'small ring') ON t = lower(p_name)")(lambda v: v.table("part").select(F.lower("p_name").alias("term")).distinct().join(v.queue.select(F.concat(F.lower("event_type"), F.lit(" ring")).alias("term")).union(v.spark.createDataFrame([("small ring",)], "term string")), "term", "left_semi"))

query("j01_untagged_backlog", "SELECT id, term FROM words WHERE id NOT IN (SELECT word_id FROM word_emotion) ORDER BY id LIMIT 50")(lambda v: v.words.join(v.word_emotion.select(F.col("word_id").alias("id")), "id", "left_anti").select("id", "term").orderBy("id").limit(50))
_J = "SELECT word_id, relationship_type, related_term, related_id, weight FROM (SELECT r.word_id, r.relationship_type, r.related_term, w.id AS related_id, {w} AS weight, row_number() OVER (PARTITION BY r.word_id ORDER BY {w} DESC, r.relationship_type, w.id, r.id) AS place FROM relationships r JOIN words w ON w.term = r.related_term {j}) WHERE place <= 15"
query("j02_related_weighted", _J.format(w="coalesce(t.weight, 0.5::DOUBLE)", j="LEFT JOIN types t ON t.type = r.relationship_type"))(lambda v: store.related_weighted(v.relationships, v.words, v.types))
query("j03_related_unweighted", _J.format(w="0.5::DOUBLE", j=""))(lambda v: store.related_weighted(v.relationships, v.words, None))

query("u01_definition_union", f"{_ENTRIES} SELECT term AS word, coalesce((SELECT string_agg(d, ' | ' ORDER BY d) FROM (SELECT DISTINCT d FROM (VALUES (e.definition), (w.definition), (w.part_of_speech)) x(d) WHERE d IS NOT NULL AND d <> '' AND d <> 'Not Found')), '') AS definitions FROM words w LEFT JOIN entries e ON e.word = w.term")(lambda v: v.words.select(F.col("term").alias("word"), F.col("definition").alias("own"), "part_of_speech").join(_entries(v).select("word", "definition"), "word", "left").select("word", lexical.definitions(F.array("definition", "own", "part_of_speech", F.lit("Not Found"))).alias("definitions")))
query("u02_usage_union", "SELECT id, concat_ws('|', 'a ' || p_name, 'the ' || p_type || '; ' || p_brand) AS examples FROM words JOIN part ON p_partkey = id")(lambda v: v.words.select("id", F.array_join(lexical.usage(examples(F.col("usage_examples")), F.array(F.lit("No example available"))), "|").alias("examples")))
query("u03_relationship_union", f"{_SYN} SELECT DISTINCT word, lemma AS related_term, CASE WHEN is_anti THEN 'antonym' ELSE 'synonym' END AS type FROM synsets UNION SELECT s.term, r.related_term, 'synonym' FROM relationships r JOIN words s ON s.id = r.word_id WHERE lower(relationship_type) = 'synonym' UNION SELECT term, part_of_speech, 'translation' FROM words WHERE id % 3 = 0")(
    lambda v: lexical.relationships(
        [_synsets(v).select("word", F.explode("synonyms").alias("synonym")), v.relationships.where("lower(relationship_type) = 'synonym'").join(v.words.select(F.col("id").alias("word_id"), F.col("term").alias("word")), "word_id").select("word", F.col("related_term").alias("synonym"))],
        _synsets(v).select("word", F.explode("antonyms").alias("antonym")), v.words.where("id % 3 = 0").select(F.col("term").alias("word"), F.col("part_of_speech").alias("translation")))
)
query("t09_slices", f"{_SYN} SELECT word, array_to_string(list(lemma ORDER BY ord)[1:5], '|') AS synonyms FROM synsets WHERE NOT is_anti GROUP BY word")(lambda v: _synsets(v).where(F.size("synonyms") > 0).groupBy("word").agg(F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ord", "synonyms"))), lambda x: x["synonyms"][0]), 1, 5), "|").alias("synonyms")))
query("q18_discovery", ", rel AS (SELECT s.term AS word, lower(trim(related_term)) AS other FROM relationships JOIN words s ON s.id = word_id WHERE relationship_type = 'evokes'), d0 AS (SELECT term AS word FROM words WHERE id = 0), d1 AS (SELECT DISTINCT other AS word FROM rel WHERE word IN (SELECT word FROM d0) AND other NOT IN (SELECT word FROM d0)), d2 AS (SELECT DISTINCT other AS word FROM rel WHERE word IN (SELECT word FROM d1) AND other NOT IN (SELECT word FROM d0 UNION SELECT word FROM d1)) SELECT word, 0 AS depth FROM d0 UNION ALL SELECT word, 1 FROM d1 UNION ALL SELECT word, 2 FROM d2")(
    lambda v: lexical.discovery(v.words.where("id = 0").select(F.col("term").alias("word")), v.relationships.where("relationship_type = 'evokes'").join(v.words.select(F.col("id").alias("word_id"), F.col("term").alias("word")), "word_id").select("word", F.col("related_term").alias("other")), 2)
)
query("k26_demo_crud", "SELECT id, term, CASE WHEN id % 2 = 0 THEN 'updated ' || term ELSE coalesce(definition, '') END AS definition, 'en' AS language FROM words")(lambda v: v.words.select("id", "term", F.when(F.col("id") % 2 == 0, F.concat(F.lit("updated "), "term")).otherwise(F.coalesce("definition", F.lit(""))).alias("definition"), F.lit("en").alias("language")))
query("p07_result_values", "SELECT id, coalesce(definition, 'Not Found') AS value, CASE WHEN definition IS NULL THEN 'NOT_FOUND' END AS error FROM words")(lambda v: v.words.select("id", F.struct(F.col("definition").alias("value"), F.when(F.col("definition").isNull(), F.lit("NOT_FOUND")).alias("error")).alias("r")).select("id", F.coalesce("r.value", F.lit("Not Found")).alias("value"), "r.error"))
