"""Queries over readers, writers, extension points, clusters and worker rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window, functions as F

from .. import errors, extensions
from ..catalog import REFERENCE_WORDS
from ..config import GraphConfig, ParserConfig, QueueConfig, Settings
from ..functions import emotion as E, text as T
from ..operators import clusters, graph, store, vectors, work
from ..scratch import folder
from ..sources import lexicons, sinks
from .affect import _WIDE, _wide
from .registry import query

_R = lambda c: F.round(c, 6) + 0.0


def _folder(v) -> str:
    return folder(v.spark)


@query("s11_jsonl_reader", "SELECT event_id, event_type, value FROM events")
def _(v):
    path = _folder(v)
    v.table("events").select("event_id", "event_type", "value").write.json(path)
    return lexicons.jsonl(v.spark, path, "event_id long, event_type string, value double")


@query("s15_gexf_import", "SELECT u AS source, v AS target, weight, relationship, dimension FROM edges")
def _(v):
    path = _folder(v)
    sinks.write_gexf_parts(v.nodes, v.edges, path)
    _, edges = lexicons.gexf(v.spark, f"{path}/nodes", f"{path}/edges")
    return edges.select(F.col("u").cast("long").alias("source"), F.col("v").cast("long").alias("target"), "weight", F.col("attrs")["relationship"].alias("relationship"), F.col("attrs")["dimension"].alias("dimension"))


query("k10_gexf_lines", "SELECT 0 AS part, count(*) AS n FROM nodes UNION ALL SELECT 1, count(*) FROM edges")(lambda v: sinks.gexf_lines(v.nodes, v.edges).groupBy("part").agg(F.count(F.lit(1)).alias("n")))


@query("s16_word_list", "SELECT trim(item) AS word FROM queue")
def _(v):
    path = _folder(v)
    v.queue.select("item").write.text(path)
    return lexicons.word_list(v.spark, path)


@query("s18_media_files", "SELECT count(DISTINCT event_type) * 2 AS media, count(DISTINCT event_type) AS sound FROM queue")
def _(v):
    path, jvm = _folder(v), v.spark.sparkContext._jvm.org.apache.hadoop.fs
    # three files of one byte for each kind of event, two of them media
    for kind in [r[0] for r in v.queue.select("event_type").distinct().collect()]:
        for name in (f"{kind}.mp3", f"{kind}.txt", f"clips/{kind}.MKV"):
            file = jvm.Path(f"{path}/{name}")
            out = file.getFileSystem(v.spark.sparkContext._jsc.hadoopConfiguration()).create(file)
            out.write(0)
            out.close()
    files = lexicons.media_files(v.spark, path)
    return files.agg(F.count(F.lit(1)).alias("media"), F.sum(F.col("path").endswith(".mp3").cast("long")).alias("sound"))


query("s20_synsets_reused", "SELECT relationship_type, count(*) AS n FROM resolved WHERE relationship_type IN ('synonym', 'hypernym') GROUP BY 1")(lambda v: v.resolved.where(F.col("relationship_type").isin("synonym", "hypernym")).groupBy("relationship_type").agg(F.count(F.lit(1)).alias("n")))
query("s22_prototype_antonym", "SELECT s.term AS word, arg_min(d.term, rel_id) AS antonym FROM resolved JOIN words s ON s.id = src_id JOIN words d ON d.id = dst_id WHERE relationship_type = 'Antonym' GROUP BY 1")(lambda v: v.resolved.where("relationship_type = 'Antonym'").join(v.words.select(F.col("id").alias("src_id"), F.col("term").alias("word")), "src_id").join(v.words.select(F.col("id").alias("dst_id"), F.col("term").alias("other")), "dst_id").groupBy("word").agg(F.min_by("other", "rel_id").alias("antonym")))
query("k05_start_conversations", "SELECT (SELECT max(conversation_id) FROM messages) + row_number() OVER (ORDER BY user_id) AS id, 'ACTIVE' AS status FROM (SELECT DISTINCT user_id FROM queue)")(lambda v: store.start_conversations(v.messages, v.queue).select("id", F.lit("ACTIVE").alias("status")))
query("k14_transcript_paths", "SELECT seq, regexp_replace('/in/' || event_type || '/' || seq || '.mp3', '^/in/(.*)\\.[^.]+$', '/out/\\1.txt') AS path FROM queue")(lambda v: v.queue.select("seq", F.regexp_replace(F.concat(F.lit("/in/"), "event_type", F.lit("/"), "seq", F.lit(".mp3")), "^/in/(.*)\\.[^.]+$", "/out/$1.txt").alias("path")))


@query("k17_compaction", "SELECT count(*) AS n, sum(id)::BIGINT AS ids FROM words")
def _(v):
    source, target = _folder(v), _folder(v)
    v.words.repartition(8).write.parquet(source)
    sinks.compact(v.spark, source, target, 1)
    return v.spark.read.parquet(target).agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


_CONFIG = "SELECT * FROM (VALUES ('graph', 'min_node_size', 5.0::DOUBLE), ('graph', 'max_node_size', 30.0), ('graph', 'limit_nodes', 1000), ('graph', 'limit_edges', 2000), ('queue', 'batch_size', 50), ('queue', 'max_retries', 3), ('vector', 'dimension', 64), ('vector', 'max_results', 100), ('graph', 'min_edge_width', 0.5), ('graph', 'max_edge_width', 5.0)) t(component, field, value)"


@query("k13_config_export", _CONFIG)
def _(v):
    """The exported JSON, read back; its numbers."""
    path = _folder(v)
    v.spark.createDataFrame([(sinks.config_json(Settings({}).as_dict()),)], "value string").write.text(path)
    fields = v.spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("component", "x")).select("component", F.explode("x").alias("field", "value"))
    return fields.withColumn("value", F.col("value").try_cast("double")).where("value is not null")


_SEED = [("algorithm", "computation", "domain"), ("graph", "network", "synonym")]


@query("k19_sample_seed", "SELECT (SELECT max(id) FROM words) + id AS word_id, related_term, relationship_type FROM (VALUES (1, 'computation', 'domain'), (2, 'network', 'synonym')) t(id, related_term, relationship_type)")
def _(v):
    seed = v.spark.createDataFrame(_SEED, "base string, related_term string, relationship_type string")
    words = v.words.select("id", "term")
    return store.insert_relationships(v.relationships, words.unionByName(store.add_terms(words, seed.select(F.col("base").alias("term")))), seed)


query("k20_mark_seen", "SELECT DISTINCT lower(trim(item)) AS key FROM queue WHERE user_id % 2 = 1 AND lower(trim(item)) NOT IN (SELECT lower(trim(item)) FROM queue WHERE user_id % 4 = 1)")(lambda v: v.queue.where("user_id % 2 = 1").select(F.lower(F.trim("item")).alias("key")).distinct().join(v.queue.where("user_id % 4 = 1").select(F.lower(F.trim("item")).alias("key")), "key", "left_anti"))
query("k23_tables", "SELECT 'words' AS name, 6 AS columns UNION ALL SELECT 'relationships', 4 UNION ALL SELECT 'word_emotion', 4")(lambda v: v.spark.createDataFrame([(n, len(df.columns)) for n, df in (("words", v.words), ("relationships", v.relationships), ("word_emotion", v.word_emotion))], "name string, columns int"))


def _nearest(v, queries: str):
    found = vectors.search_all(v.vectors, v.vectors.where(queries).select(F.col("vec_id").alias("q"), F.col("embedding").alias("e")))
    return found.select("q", "vec_id", _R("distance").alias("distance"))


query("j07_query_by_all", ", q AS (SELECT embedding AS e, vec_id AS q FROM vectors WHERE vec_id < 3) SELECT q, vec_id, round(list_distance(embedding, e), 6) AS distance FROM vectors, q QUALIFY row_number() OVER (PARTITION BY q ORDER BY list_distance(embedding, e), vec_id) <= 5")(lambda v: _nearest(v, "vec_id < 3"))
query("j07_every_twentieth", ", q AS (SELECT embedding AS e, vec_id AS q FROM vectors WHERE vec_id % 20 = 0) SELECT q, vec_id, round(list_distance(embedding, e), 6) AS distance FROM vectors, q QUALIFY row_number() OVER (PARTITION BY q ORDER BY list_distance(embedding, e), vec_id) <= 5")(lambda v: _nearest(v, "vec_id % 20 = 0"))
query("j10_optional_joins", "SELECT w.id, e.valence IS NOT NULL AS has_emotion, count(r.id) AS relationships FROM words w LEFT JOIN word_emotion e ON e.word_id = w.id LEFT JOIN relationships r ON r.word_id = w.id GROUP BY 1, 2")(lambda v: v.words.select("id").join(v.word_emotion.select(F.col("word_id").alias("id"), "valence"), "id", "left").join(v.relationships.select(F.col("word_id").alias("id"), F.lit(1).alias("r")), "id", "left").groupBy("id", F.col("valence").isNotNull().alias("has_emotion")).agg(F.count("r").alias("relationships")))
query("j14_positional_zip", "SELECT id, string_agg(x || '=' || i, ',' ORDER BY i) AS pairs FROM (SELECT id, unnest(string_split(term, ' ')) AS x, unnest(range(0, len(string_split(term, ' ')))) AS i FROM words) GROUP BY 1")(lambda v: v.words.select("id", F.array_join(F.transform(F.split("term", " "), lambda x, i: F.concat(x, F.lit("="), i)), ",").alias("pairs")))
query("w06_ordered_states", f"{_WIDE} SELECT id, i - 1 AS place, round(valence * f::DOUBLE, 6) + 0 AS valence FROM w, (VALUES (1, 0.2), (2, 0.5), (3, 1.0)) t(i, f)")(lambda v: _wide(v).select("id", F.posexplode(F.slice(E.intensity_gradation(F.col("m"), F.lit(0.7)), 1, 3)).alias("place", "s")).select("id", "place", _R(E.at(F.col("s.dims"), "valence")).alias("valence")))
query("t07_batches", "SELECT word_id, id FROM relationships QUALIFY row_number() OVER (PARTITION BY word_id ORDER BY id) <= 5")(lambda v: v.relationships.groupBy("word_id").agg(F.slice(F.array_sort(F.collect_list("id")), 1, 5).alias("x")).select("word_id", F.explode("x").alias("id")))

_LP = ", l0 AS (SELECT id, id AS label FROM nodes), near AS (SELECT a, b, weight FROM adj UNION ALL SELECT id, id, coalesce((SELECT max(weight) FROM adj WHERE a = id), 1::DOUBLE) FROM nodes)" + "".join(
    f", v{k} AS (SELECT a, label, round(sum(weight), 6) AS w FROM near JOIN l{k - 1} ON id = b GROUP BY 1, 2), l{k} AS (SELECT a AS id, label FROM v{k} QUALIFY row_number() OVER (PARTITION BY a ORDER BY w DESC, label) = 1)" for k in range(1, 4)
)
query("g11_label_clusters", f"{_LP} SELECT id, label FROM l3")(lambda v: clusters.label_propagation(v.nodes, v.edges, 3))
query("t02_cluster_members", f"{_LP} SELECT label, string_agg(term, '|' ORDER BY term) AS members FROM l3 JOIN nodes USING (id) GROUP BY 1 HAVING count(*) >= 3")(lambda v: clusters.members(clusters.label_propagation(v.nodes, v.edges, 3), v.nodes).select("label", F.array_join("members", "|").alias("members")))


query("g11_louvain")(lambda v: clusters.clustered(v.edges))


@query("g11l_betweenness")
def _(v):
    return clusters.betweenness_by_source(v.edges)


query("g10_store_context", "SELECT 'clinical' AS context, factor, weight FROM (VALUES ('anger', 0.2::DOUBLE), ('fear', 0.5::DOUBLE), ('joy', 0.1::DOUBLE)) t(factor, weight)")(lambda v: v.spark.createDataFrame([("clinical", {"anger": 0.2, "fear": 0.5, "joy": 0.1})], "context string, f map<string,double>").select("context", F.explode("f").alias("factor", "weight")))
query("g21_positions", "SELECT count(*) AS n, round(sum(x * x + y * y), 4) AS total FROM (SELECT cos(2 * pi() * r / n) AS x, sin(2 * pi() * r / n) AS y FROM (SELECT row_number() OVER (ORDER BY id) - 1 AS r, count(*) OVER () AS n FROM nodes))")(lambda v: graph.circular_layout(v.nodes).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("x") * F.col("x") + F.col("y") * F.col("y")), 4).alias("total")))

query("x04_bigrams", "SELECT id, string_split(term, ' ')[i] || ' ' || string_split(term, ' ')[i + 1] AS bigram FROM (SELECT id, term, unnest(range(1, len(string_split(term, ' ')))) AS i FROM words) WHERE length(string_split(term, ' ')[i] || ' ' || string_split(term, ' ')[i + 1]) > 5")(lambda v: v.words.select("id", F.explode(extensions.bigrams(F.split("term", " "))).alias("bigram")))
query("x05_semantic_expansion", "SELECT src_id, dst_id FROM (SELECT DISTINCT src_id, dst_id FROM resolved WHERE relationship_type IN ('synonym', 'hypernym', 'related')) QUALIFY row_number() OVER (PARTITION BY src_id ORDER BY dst_id) <= 75")(lambda v: v.resolved.where(F.col("relationship_type").isin("synonym", "hypernym", "related")).groupBy("src_id").agg(F.slice(F.array_sort(F.collect_set("dst_id")), 1, 75).alias("x")).select("src_id", F.explode("x").alias("dst_id")))
query("x25_truthy", "SELECT seq, lower(trim(t)) IN ('true', 'yes', '1', 'y') AS flag FROM (SELECT seq, CASE seq % 5 WHEN 0 THEN ' Yes' WHEN 1 THEN 'no' WHEN 2 THEN '1' WHEN 3 THEN 'TRUE' ELSE 'on' END AS t FROM queue)")(lambda v: v.queue.select("seq", T.truthy(F.element_at(F.array(*map(F.lit, (" Yes", "no", "1", "TRUE", "on"))), (F.col("seq") % 5 + 1).cast("int"))).alias("flag")))
query("x26_ddl_dialect", "SELECT id, concat('CREATE TABLE t', id, ' (id SERIAL PRIMARY KEY, term TEXT)') AS postgres, concat('CREATE TABLE t', id, ' (id INT AUTO_INCREMENT PRIMARY KEY, term TEXT)') AS mysql FROM words")(lambda v: v.words.select("id", F.concat(F.lit("CREATE TABLE t"), "id", F.lit(" (id INTEGER PRIMARY KEY, term TEXT)")).alias("ddl")).select("id", *[T.ddl_dialect(F.col("ddl"), d).alias(d) for d in ("postgres", "mysql")]))
query("x27_connection_uri", "SELECT id, concat('file:', term, CASE WHEN id % 2 = 0 THEN '?cache=shared&mode=ro' ELSE '' END) AS uri FROM words")(lambda v: v.words.select("id", T.connection_uri(F.col("term"), F.when(F.col("id") % 2 == 0, F.create_map(*map(F.lit, ("mode", "ro", "cache", "shared")))).otherwise(F.create_map().cast("map<string,string>"))).alias("uri")))

_CODE = lambda text: f"CAST(concat('0x', substr(md5({text}), 1, 8)) AS BIGINT)"


def _embedded(rows: str, dim: int) -> str:
    """(id, e) for rows(id, term): the hashed embedding as a list of doubles, in SQL."""
    code = _CODE("lower(substr(term, CAST(i AS BIGINT), 3))")
    return f"""SELECT id, list_transform(x, lambda y: CAST(CAST(y / greatest(sqrt(list_sum(list_transform(x, lambda z: z * z))), 1e-9) AS FLOAT) AS DOUBLE)) AS e FROM (
  SELECT id, list_transform(range(0, {dim}), lambda d: coalesce(list_sum(list_transform(list_filter(g, lambda c: c % {dim} = d), lambda c: CASE WHEN c < 2147483648 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)), 0)) AS x FROM (
    SELECT id, list_transform(range(1, greatest(length(term) - 2, 1) + 1), lambda i: {code}) AS g FROM {rows}))"""


def _dims(v, dim: int):
    """The values that are not zero, by place."""
    return v.words.select("id", F.posexplode(vectors.hashed_embedding(F.col("term"), dim)).alias("place", "value")).where("value <> 0").select("id", "place", _R(F.col("value").cast("double")).alias("value"))


def _dims_sql(dim: int) -> str:
    return f", emb AS ({_embedded('words', dim)}) SELECT id, CAST(place - 1 AS INT) AS place, round(value, 6) AS value FROM (SELECT id, unnest(e) AS value, unnest(range(1, {dim} + 1)) AS place FROM emb) WHERE value <> 0"


_REFS = ", ".join(f"('{w}', '{d}', {s}::DOUBLE)" for w, d, s in REFERENCE_WORDS)


@query("e17_reference_words", f""", emb AS MATERIALIZED ({_embedded('words', 64)}), refs(id, dim, sign) AS (VALUES {_REFS}), ref AS MATERIALIZED (SELECT r.id, e FROM ({_embedded('(SELECT id, id AS term FROM refs)', 64)}) r),
near AS (SELECT w.id, dim, sign, 1 - (1 - list_dot_product(w.e, r.e) / (sqrt(list_dot_product(w.e, w.e)) * sqrt(list_dot_product(r.e, r.e)))) AS s FROM emb w, ref r JOIN refs USING (id))
SELECT id, dim, round(greatest(-1, least(1, sum(s * sign))), 6) + 0.0 AS x FROM near WHERE s > 0.3 GROUP BY 1, 2""")
def _(v):
    ref = v.spark.createDataFrame(REFERENCE_WORDS, "ref string, dim string, sign double").withColumn("e", vectors.hashed_embedding(F.col("ref")).cast("array<double>"))
    rows = v.words.select("id", vectors.hashed_embedding(F.col("term")).cast("array<double>").alias("w")).crossJoin(F.broadcast(ref))  # 18 reference words
    near = rows.withColumn("s", 1 - vectors.distance(F.col("w"), F.col("e"))).where("s > 0.3")
    return near.groupBy("id", "dim").agg(_R(E.clip(F.sum(F.col("s") * F.col("sign")))).alias("x"))


query("e35_random_emotion", f"SELECT id, {_CODE("concat(id, ':7:valence')")} / 4294967296::DOUBLE * 2 - 1 AS valence, {_CODE("concat(id, ':7:arousal')")} / 4294967296::DOUBLE AS arousal FROM words")(lambda v: v.words.select("id", *E.random_emotion(F.col("id"))))
query("e36_strategies", "SELECT id, CASE WHEN id % 3 = 0 THEN 'random' WHEN abs(valence) >= 0.1 THEN 'recursive' ELSE 'skip' END AS strategy FROM emotions")(lambda v: v.emotions.select("id", F.when(F.col("id") % 3 == 0, "random").when(F.abs("valence") >= 0.1, "recursive").otherwise("skip").alias("strategy")))
query("e38_vocabulary_neighbours", f", emb AS ({_embedded('words', 64)}) SELECT id, round(1 - e[1] / sqrt(list_dot_product(e, e)), 6) AS distance FROM emb ORDER BY round(1 - e[1] / sqrt(list_dot_product(e, e)), 12), id LIMIT 5")(lambda v: vectors.search(v.words.select("id", vectors.hashed_embedding(F.col("term")).cast("array<double>").alias("embedding")), [1.0] + [0.0] * 63, 5, id_col="id").select("id", _R("distance").alias("distance")))
query("v02_hashed_embedding", _dims_sql(64))(lambda v: _dims(v, 64))
query("v03_deterministic_embedder", _dims_sql(768))(lambda v: _dims(v, 768))
query("v08_reembed_pass", "SELECT concat('d_', id) AS item, 'SUCCESS' AS status FROM words WHERE definition IS NOT NULL UNION ALL SELECT concat('d_', id), 'EMBEDDING_ERROR' FROM words WHERE definition IS NULL")(lambda v: v.words.select(F.concat(F.lit("d_"), "id").alias("item"), F.when(F.col("definition").isNull(), "EMBEDDING_ERROR").when(F.size(vectors.hashed_embedding(F.coalesce("definition", F.lit("")))) == 64, "SUCCESS").otherwise("STORAGE_ERROR").alias("status")))
query("v09_language_search", ", q AS (SELECT embedding AS e FROM vectors WHERE vec_id = 0), lang AS (SELECT *, CASE label % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'zh' ELSE 'fr' END AS language FROM vectors) SELECT vec_id, language FROM lang, q WHERE language = 'fr' ORDER BY list_distance(embedding, e), vec_id LIMIT 7")(lambda v: (lambda rows: vectors.search(rows, list(v.vectors.where("vec_id = 0").first()["embedding"]), 7, "euclidean", {"language": "fr"}).select("vec_id", F.lit("fr").alias("language")))(v.vectors.withColumn("language", F.element_at(F.array(F.lit("en"), F.lit("zh"), F.lit("fr")), (F.col("label") % 3 + 1).cast("int")))))
query("v10_store_words", "SELECT 'word' AS content_type, count(*) AS n FROM words UNION ALL SELECT 'definition', count(*) FROM words WHERE coalesce(definition, '') <> ''")(lambda v: vectors.items(v.words).where("content_type <> 'example'").withColumn("embedding", vectors.hashed_embedding(F.col("text"))).where(F.size("embedding") == 64).groupBy("content_type").agg(F.count(F.lit(1)).alias("n")))

query("q05_states", "SELECT seq, CASE event_type WHEN 'view' THEN 'INITIALIZED' WHEN 'click' THEN 'RUNNING' WHEN 'signup' THEN 'PAUSED' WHEN 'purchase' THEN 'STOPPING' ELSE 'STOPPED' END AS state FROM queue")(lambda v: v.queue.select("seq", work.state(F.col("event_type")).alias("state")))
query("q07_parallel_items", "SELECT event_type, count(*) AS n FROM queue GROUP BY 1")(lambda v: extensions.process(v.queue.select("event_type"), lambda b: b.groupby("event_type").size().reset_index(name="n"), "event_type string, n long").groupBy("event_type").agg(F.sum("n").alias("n")))
query("q12_graph_cycle", "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM resolved) AS relationships")(lambda v: v.nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(v.edges.agg(F.count(F.lit(1)).alias("edges"))).crossJoin(v.resolved.agg(F.count(F.lit(1)).alias("relationships"))))
query("q13_emotion_cycle", "SELECT e.id, round(e.valence, 6) AS valence FROM emotions e WHERE e.id NOT IN (SELECT word_id FROM word_emotion) ORDER BY e.id LIMIT 20")(lambda v: v.emotions.join(v.word_emotion.select(F.col("word_id").alias("id")), "id", "left_anti").select("id", _R("valence").alias("valence")).orderBy("id").limit(20))
query("q14_schedule", "SELECT seq, value * 1000 >= 3600 AS maintenance, value * 1000 >= 86400 AS backup, value * 1000 >= 43200 AS optimise FROM queue")(lambda v: v.queue.select("seq", *work.due(F.col("value") * 1000)))
query("q19_response_stages", "SELECT id, 'note:' || speaker AS reflex, CASE WHEN length(text) > 500 THEN 'long' ELSE 'short' END AS route, '[Voice v1]: ' || speaker AS reply FROM messages")(lambda v: extensions.staged(v.messages, [lambda d: d.withColumn("reflex", F.concat(F.lit("note:"), "speaker")), lambda d: d.withColumn("route", F.when(F.length("text") > 500, "long").otherwise("short")), lambda d: d.withColumn("reply", F.concat(F.lit("[Voice v1]: "), "speaker"))]).select("id", "reflex", "route", "reply"))
query("q21_operation_queue", "SELECT user_id, string_agg(event_type, ',' ORDER BY seq) AS operations FROM queue GROUP BY 1")(lambda v: v.queue.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "event_type"))), lambda x: x["event_type"]), ",").alias("operations")))
_ERRORS = "SELECT seq, 'ERROR' AS state, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY seq) >= 10 THEN 'RECOVERY' ELSE 'RUNNING' END AS next_state FROM queue WHERE event_type = 'error'"


@query("q22_error_log", _ERRORS)
def _(v):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("seq"))
    return v.queue.where("event_type = 'error'").select("seq", F.lit("ERROR").alias("state"), F.when(n >= 10, "RECOVERY").otherwise("RUNNING").alias("next_state"))


@query("p01_embedder", "SELECT id, length(term)::DOUBLE AS first FROM words")
def _(v):
    extensions.register_embedder("length", lambda texts: texts.map(lambda t: [float(len(t))]))
    return extensions.embed(v.words.select("id", F.col("term").alias("text")), "length").select("id", F.get("embedding", F.lit(0)).cast("double").alias("first"))


def _check_terms(batch: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"id": batch["id"], "ok": batch["definition"].notna()})


query("p02_processor", "SELECT id, definition IS NOT NULL AS ok FROM words")(lambda v: extensions.process(v.words.select("id", "definition"), _check_terms, "id long, ok boolean"))


@query("p03_hooks", f"{_WIDE} SELECT id, 'awareness_of_emotional_clarity' AS label FROM w WHERE abs(valence) > 0.7 UNION ALL SELECT id, 'response_to_activation' FROM w WHERE arousal > 0.7 UNION ALL SELECT id, 'awareness_of_emotional_complexity' FROM w WHERE abs(valence) > 0.5 AND abs(arousal) > 0.5 AND abs(dominance) > 0.5")
def _(v):
    extensions.register_hook("meta", lambda m: E.meta_emotions(m, hooks=True))
    return extensions.hooked(_wide(v))


query("p08_sql", "SELECT relationship_type, count(*) AS n FROM relationships GROUP BY 1 HAVING count(*) > 10")(lambda v: store.sql(v.spark, "SELECT relationship_type, count(*) AS n FROM relationships GROUP BY 1 HAVING count(*) > :least", {"least": 10}, relationships=v.relationships))
query("p12_mock_affect", "SELECT m.id, round((m.id % 11 - 5) / 10, 6) + 0 AS valence FROM messages m")(lambda v: extensions.MockModel().feel(v.messages).select("id", _R("valence").alias("valence")))
query("f20_types_known", "SELECT DISTINCT relationship_type FROM relationships WHERE lower(relationship_type) NOT IN (SELECT type FROM types)")(lambda v: v.relationships.select("relationship_type").distinct().join(v.types, F.lower("relationship_type") == F.col("type"), "left_anti"))

query("k16_statistics", "SELECT 'id' AS \"column\", count(*) AS n, count(*) - count(id) AS nulls, CAST(min(id) AS VARCHAR) AS least, CAST(max(id) AS VARCHAR) AS most FROM words UNION ALL SELECT 'definition', count(*), count(*) - count(definition), min(definition), max(definition) FROM words UNION ALL SELECT 'part_of_speech', count(*), count(*) - count(part_of_speech), min(part_of_speech), max(part_of_speech) FROM words")(lambda v: sinks.statistics(v.words.select("id", "definition", "part_of_speech")))


@query("k22_graph_formats", "SELECT f AS form, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges FROM (VALUES ('gexf'), ('json'), ('parquet')) t(f)")
def _(v):
    """Written in each format and read back."""
    nodes, edges, rows = v.nodes, v.edges.select("u", "v", "weight", "relationship", "dimension"), []
    for form in sinks.GRAPH_FORMATS:
        path = _folder(v)
        sinks.write_graph(nodes, edges, path, form)
        back = lexicons.gexf(v.spark, f"{path}/nodes", f"{path}/edges") if form == "gexf" else [v.spark.read.format(form).load(f"{path}/{x}") for x in ("nodes", "edges")]
        rows.append((form, back[0].count(), back[1].count()))
    return v.spark.createDataFrame(rows, "form string, nodes long, edges long")


query("f23_resource_paths", "SELECT * FROM (VALUES ('openthesaurus', 'lex/openthesaurus.jsonl'), ('odict', 'lex/odict.json'), ('opendict', 'lex/opendict.json')) t(name, path)")(lambda v: v.spark.createDataFrame([(n, ParserConfig("lex").path(n)) for n in ("openthesaurus", "odict", "opendict")], "name string, path string"))


@query("p04_transformers", f"{_WIDE} SELECT id, round(-valence * 0.5, 6) + 0 AS valence FROM w")
def _(v):
    extensions.register_transformer("inverse", lambda m: F.transform_values(m, lambda k, x: -x))
    extensions.register_transformer("half", lambda m: F.transform_values(m, lambda k, x: x * 0.5))
    return _wide(v).select("id", _R(E.at(extensions.transformed(F.col("m"), "inverse", "half"), "valence")).alias("valence"))


@query("p05_models", "SELECT id, 'note:' || speaker AS reflex, CASE WHEN length(text) > 500 THEN 'long' ELSE 'short' END AS route, round((id % 11 - 5) / 10, 6) + 0 AS valence, '[Voice v1]: ' || speaker AS reply FROM messages")
def _(v):
    model = extensions.MockModel()
    return extensions.respond(v.messages, model, model, model, model).select("id", "reflex", "route", _R("valence").alias("valence"), "reply")


@query("p06_observers", "SELECT 'queue' AS component, 'batch_size' AS field, 50 + count(*)::INT AS value FROM (SELECT DISTINCT event_type FROM queue)")
def _(v):
    settings, seen = Settings({}), []
    settings.observers.append(lambda component, changes: seen.extend((component, f, x) for f, x in changes.items()))
    settings.set("queue", batch_size=settings.get("queue").batch_size + v.queue.select("event_type").distinct().count())
    return v.spark.createDataFrame(seen, "component string, field string, value int")


@query("p09_as_completed", "SELECT 'words' AS name, count(*) AS n FROM words UNION ALL SELECT 'messages', count(*) FROM messages UNION ALL SELECT 'queue', count(*) FROM queue")
def _(v):
    return v.spark.createDataFrame(list(extensions.as_completed({"words": v.words.count, "messages": v.messages.count, "queue": v.queue.count})), "name string, n long")


query("p13_presets", "SELECT * FROM (VALUES ('graph', 'lexical,emotional'), ('queue', '200')) t(component, preset)")(lambda v: v.spark.createDataFrame([("graph", ",".join(GraphConfig().with_dimensions("lexical", "emotional").active_dimensions)), ("queue", str(QueueConfig().high_throughput().batch_size))], "component string, preset string"))
query("p14_load_order", "SELECT component, before FROM (VALUES ('graph', 'parser'), ('vector', 'parser')) t(component, before)")(lambda v: (lambda order: v.spark.createDataFrame([(c, b) for c in ("graph", "vector") for b in ("parser",) if order.index(b) < order.index(c)], "component string, before string"))(Settings({}).order()))


@query("p15_measured", "SELECT 'count' AS name, true AS measured, count(*) AS n FROM words")
def _(v):
    times: dict[str, float] = {}
    with extensions.measured(times, "count"):
        n = v.words.count()
    return v.spark.createDataFrame([(name, seconds > 0, n) for name, seconds in times.items()], "name string, measured boolean, n long")


query("p16_errors", "SELECT * FROM (VALUES ('NotFoundError', 'GlossaraError'), ('InvalidInputError', 'GlossaraError'), ('DimensionMismatchError', 'InvalidInputError'), ('TooLargeError', 'GlossaraError')) t(error, base)")(lambda v: v.spark.createDataFrame([(e.__name__, e.__mro__[1].__name__) for e in vars(errors).values() if isinstance(e, type) and issubclass(e, errors.GlossaraError) and e is not errors.GlossaraError], "error string, base string"))
_TTL = """SELECT concat('http://w.org/', id) AS s, 'http://w.org/ns#term' AS p, term AS o, 'en' AS lang FROM words UNION ALL
SELECT concat('http://w.org/', id), 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://w.org/ns#Word', NULL FROM words UNION ALL SELECT concat('http://w.org/', id), 'http://w.org/ns#next', concat('http://w.org/', id + 1), NULL FROM words"""


@query("s12_turtle", _TTL)
def _(v):
    """One statement for each word, of three triples, in files that begin with their prefixes."""
    path = _folder(v)
    line = F.concat(F.lit("w:"), "id", F.lit(' a o:Word ; o:term "'), "term", F.lit('"@en ;\n  o:next w:'), F.col("id") + 1, F.lit(" ."))
    files = v.words.groupBy((F.col("id") % 8).alias("file")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    files.select(F.concat(F.lit("@prefix w: <http://w.org/> .\n@prefix o: <http://w.org/ns#> .\n"), "body").alias("value")).repartition(8, F.col("value")).sortWithinPartitions("value").write.option("lineSep", "\n# end\n").text(path)
    return lexicons.turtle(v.spark, path)


@query("s11_line_errors", "SELECT CAST(5 AS BIGINT) AS line, 'no json' AS text")
def _(v):
    path = _folder(v)
    v.spark.createDataFrame([(k, x) for k, x in enumerate(['{"a": 1}', "", '{"a": 2}', " ", "no json", '{"a": 3}'])], "k int, x string").coalesce(1).orderBy("k").select("x").write.text(path)
    return lexicons.bad_lines(v.spark, path, "a long").select("line", "text")
