"""Queries over queues, conversations, workers and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats, vectors, work
from ..sources import sinks
from .registry import query

_R = lambda c: F.round(c, 6)
_ACCEPTED = ", marked AS (SELECT *, lower(trim(item)) AS key, row_number() OVER (PARTITION BY lower(trim(item)) ORDER BY seq) = 1 AS accepted FROM queue)"
_RANK = "CASE priority WHEN 'HIGH' THEN 1 WHEN 'NORMAL' THEN 2 ELSE 3 END"

query("s19_queue_sample", f"{_ACCEPTED} SELECT seq, key, priority FROM marked WHERE accepted ORDER BY {_RANK}, seq LIMIT 20")(lambda v: work.dequeue(work.enqueue(v.queue).where("accepted"), 20).select("seq", "key", "priority"))
query("q01_enqueue", f"{_ACCEPTED} SELECT seq, key, accepted FROM marked")(lambda v: work.enqueue(v.queue).select("seq", "key", "accepted"))
query("q02_dequeue", f"{_ACCEPTED} SELECT seq, key, priority FROM marked WHERE accepted ORDER BY {_RANK}, seq LIMIT 100")(lambda v: work.dequeue(work.enqueue(v.queue).where("accepted"), 100).select("seq", "key", "priority"))
query("q03_priority_rank", f"SELECT priority, {_RANK} AS place, count(*) AS n FROM queue GROUP BY 1, 2")(lambda v: v.queue.groupBy("priority", work.rank(F.col("priority")).alias("place")).agg(F.count(F.lit(1)).alias("n")))
query("q04_process_batch", f"{_ACCEPTED} SELECT count(*) AS taken, count(*) FILTER (event_type <> 'error') AS successes FROM (SELECT * FROM marked WHERE accepted ORDER BY {_RANK}, seq LIMIT 50)")(lambda v: work.dequeue(work.enqueue(v.queue).where("accepted"), 50).agg(F.count(F.lit(1)).alias("taken"), F.count_if(F.col("event_type") != "error").alias("successes")))
query("q06_queue_stats", f"{_ACCEPTED} SELECT count(*) FILTER (accepted) AS enqueued, count(*) FILTER (NOT accepted) AS rejected, round(count(*) FILTER (accepted) / count(*), 6) AS success_rate FROM marked")(lambda v: work.counts(work.enqueue(v.queue)).withColumn("success_rate", _R("success_rate")))
query("a27_priority_counters", "SELECT count(*) FILTER (priority = 'HIGH') AS high, count(*) FILTER (priority = 'NORMAL') AS normal, count(*) FILTER (priority = 'LOW') AS low FROM queue")(lambda v: work.by_priority(v.queue))
query("j11_seen_items", f"{_ACCEPTED} SELECT seq, key FROM marked WHERE accepted AND user_id % 2 = 1")(lambda v: work.enqueue(v.queue, work.enqueue(v.queue.where("user_id % 2 = 0"))).where("accepted").select("seq", "key"))
query("j12_stale_tasks", "SELECT seq FROM queue WHERE 100 - value > 60")(lambda v: work.stale(v.queue.withColumn("started", F.col("value")), 100.0, 60.0).select("seq"))
query("t06_priority_order", f"SELECT seq FROM queue ORDER BY {_RANK}, seq LIMIT 200")(lambda v: v.queue.orderBy(work.rank(F.col("priority")), "seq").select("seq").limit(200))

query("q08_word_step", "SELECT w.id, CASE WHEN trim(term) = '' THEN 'INVALID' WHEN definition IS NULL THEN 'NOT_FOUND' ELSE 'SUCCESS' END AS status, (SELECT count(*) FROM relationships r WHERE r.word_id = w.id) AS relationships FROM words w")(lambda v: v.words.join(v.relationships.groupBy(F.col("word_id").alias("id")).agg(F.count(F.lit(1)).alias("relationships")), "id", "left").select("id", F.when(F.trim("term") == "", "INVALID").when(F.col("definition").isNull(), "NOT_FOUND").otherwise("SUCCESS").alias("status"), F.coalesce("relationships", F.lit(0)).alias("relationships")))
query("q09_task_route", "SELECT id, CASE WHEN trim(coalesce(CASE WHEN id % 5 > 0 THEN text END, '')) = '' THEN 'invalid' WHEN id % 3 = 0 THEN 'start_conversation_and_add' WHEN speaker = 'user' THEN 'add_message_and_respond' ELSE 'add_message' END AS route FROM messages")(lambda v: v.messages.select("id", work.route("route", F.when(F.col("id") % 5 > 0, F.col("text")), F.when(F.col("id") % 3 != 0, F.col("conversation_id")), F.col("speaker") == "user")))
query("q10_retry", "SELECT seq, attempts FROM (SELECT seq, CASE WHEN event_type = 'view' THEN seq % 4 ELSE seq % 4 + 1 END AS attempts FROM queue WHERE event_type <> 'purchase') WHERE attempts < 3")(lambda v: work.retry(v.queue.select("seq", F.when(F.col("event_type") == "purchase", "SUCCESS").when(F.col("event_type") == "view", "DEFERRED").otherwise("ERROR").alias("status"), (F.col("seq") % 4).alias("attempts"))).select("seq", "attempts"))
query("q11_backoff", "SELECT n, least(60, pow(2, least(10, n - 1)))::DOUBLE AS emotion, least(300, 30 * pow(2, least(6, n - 1)))::DOUBLE AS database, least(60, pow(2, n - 1))::DOUBLE AS conversation FROM (SELECT DISTINCT user_id % 15 + 1 AS n FROM queue)")(lambda v: v.queue.select((F.col("user_id") % 15 + 1).alias("n")).distinct().select("n", *[work.backoff(k, F.col("n")).alias(k) for k in ("emotion", "database", "conversation")]))
query("q15_adaptive_depth", "SELECT seq, greatest(1, least(5, 3 + (length(event_type) <= 5)::INT - (seq > 1000)::INT - (value > 5)::INT)) AS depth FROM queue")(lambda v: v.queue.select("seq", work.adaptive_depth(F.col("event_type"), F.col("seq"), F.col("value")).alias("depth")))
query("q16_frequent_terms", "SELECT item, count(*) AS n FROM queue GROUP BY 1 HAVING count(*) >= 5")(lambda v: work.frequent(v.queue, "item"))
query("q17_synonym_heavy", "SELECT word_id, CASE WHEN count(*) FILTER (lower(relationship_type) = 'synonym') > 2 THEN 'HIGH' ELSE 'NORMAL' END AS priority FROM relationships GROUP BY 1")(lambda v: v.relationships.groupBy("word_id").agg(F.when(F.count_if(F.lower("relationship_type") == "synonym") > 2, "HIGH").otherwise("NORMAL").alias("priority")))

query("a22_worker_stats", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(sum(value) / count(*) * 60, 4) AS per_minute FROM queue GROUP BY 1")(lambda v: v.queue.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), _R(F.avg("value")).alias("mean"), F.round(F.sum("value") / F.count(F.lit(1)) * 60, 4).alias("per_minute")))
query("a23_operation_metrics", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, round(sum(value), 4) AS total FROM queue GROUP BY 1")(lambda v: stats.operation_metrics(v.queue, "event_type", "value").withColumns({"mean": _R("mean"), "total": F.round("total", 4)}))
query("a24_top_errors", "SELECT item, count(*) AS n FROM queue WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, item LIMIT 5")(lambda v: work.top_errors(v.queue.where("event_type = 'error'"), "item"))
query("a26_productivity", "SELECT user_id, round(count(*) / (count(*) + greatest(0, count(*) FILTER (event_type = 'signup') - count(*) FILTER (event_type = 'click'))), 6) AS productivity FROM queue GROUP BY 1")(lambda v: v.queue.groupBy("user_id").agg(F.count(F.lit(1)).alias("p"), (F.count_if(F.col("event_type") == "signup") - F.count_if(F.col("event_type") == "click")).alias("g")).select("user_id", _R(work.productivity(F.col("p"), F.col("g"))).alias("productivity")))
query("a28_conversation_metrics", "SELECT speaker, count(*) AS n, round(avg(length(text)), 6) AS mean FROM messages GROUP BY 1")(lambda v: v.messages.groupBy("speaker").agg(F.count(F.lit(1)).alias("n"), _R(F.avg(F.length("text"))).alias("mean")))
query("a29_parser_stats", "SELECT count(*) AS processed, count(*) FILTER (event_type <> 'error') AS successful, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT lower(trim(item))) AS unique_words FROM queue")(lambda v: v.queue.agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("event_type") != "error").alias("successful"), F.count_if(F.col("event_type") == "error").alias("errors"), F.countDistinct(F.lower(F.trim("item"))).alias("unique_words")))
query("a30_worker_line", "SELECT user_id, printf('%d processed, %.2f mean', count(*), avg(value)) AS line FROM queue GROUP BY 1")(lambda v: v.queue.groupBy("user_id").agg(F.format_string("%d processed, %.2f mean", F.count(F.lit(1)), F.avg("value")).alias("line")))

_ROLL = "SELECT seq, round(avg(value) OVER (PARTITION BY {by} ORDER BY seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 9) AS rolling FROM queue"
query("w01_rolling_wait", _ROLL.format(by="user_id"))(lambda v: stats.rolling_mean(v.queue, "value", ["seq"], ["user_id"]).select("seq", F.round("rolling", 9).alias("rolling")))
query("w02_rolling_by_operation", _ROLL.format(by="event_type, user_id % 8"))(lambda v: stats.rolling_mean(v.queue.withColumn("worker", F.col("user_id") % 8), "value", ["seq"], ["event_type", "worker"]).select("seq", F.round("rolling", 9).alias("rolling")))
query("w03_rolling_processing", _ROLL.format(by="priority, user_id"))(lambda v: stats.rolling_mean(v.queue, "value", ["seq"], ["priority", "user_id"]).select("seq", F.round("rolling", 9).alias("rolling")))
query("w04_history", "SELECT conversation_id, id FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY timestamp DESC, id DESC) AS place FROM messages) WHERE place <= 5")(lambda v: work.history(v.messages, 5).select("conversation_id", "id"))
query("w05_last_errors", "SELECT user_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS place FROM queue WHERE event_type = 'error') WHERE place <= 5")(lambda v: stats.last_rows(v.queue.where("event_type = 'error'"), ["user_id"], [F.desc("seq")], 5).select("user_id", "seq"))
query("w07_error_runs", ", i AS (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY seq) AS island FROM queue) SELECT user_id, max(n) AS longest FROM (SELECT user_id, island, count(*) AS n FROM i WHERE event_type = 'error' GROUP BY 1, 2) GROUP BY 1")(lambda v: work.error_runs(v.queue, "user_id", "seq", F.col("event_type") == "error"))
query("w08_keep_first", "SELECT event_type, min(seq) AS seq FROM queue GROUP BY 1")(lambda v: v.queue.groupBy("event_type").agg(F.min("seq").alias("seq")))

query("f14_conversation", "SELECT conversation_id, string_agg(speaker || ': ' || text, chr(10) ORDER BY timestamp, id) AS content FROM messages GROUP BY 1")(lambda v: sinks.conversation_export(v.messages, "text"))
query("j08_conversation_messages", "SELECT conversation_id AS id, min(timestamp) AS created_at, max(timestamp) AS updated_at, count(*) AS messages FROM messages GROUP BY 1")(lambda v: work.conversations(v.messages))
query("j09_message_emotion", "SELECT m.id, CASE WHEN m.id % 2 = 0 THEN 'neutral' END AS label FROM messages m")(lambda v: v.messages.select("id").join(v.messages.where("id % 2 = 0").select("id", F.lit("neutral").alias("label")), "id", "left"))
query("k06_end_conversation", "SELECT conversation_id AS id, CASE WHEN conversation_id % 3 = 0 THEN 'COMPLETED' ELSE 'ACTIVE' END AS status, greatest(max(timestamp), CASE WHEN conversation_id % 3 = 0 THEN 99::DOUBLE END) AS updated_at FROM messages GROUP BY 1")(lambda v: work.ended(work.conversations(v.messages), v.messages.where("conversation_id % 3 = 0").select(F.col("conversation_id").alias("id"), F.lit(99.0).alias("at"))).select("id", "status", "updated_at"))
query("k07_add_message", "SELECT conversation_id AS id, max(timestamp) + 1 AS updated_at, count(*) + 1 AS messages FROM messages GROUP BY 1")(lambda v: work.conversations(v.messages.unionByName(v.messages.groupBy("conversation_id").agg(F.max("timestamp").alias("t")).select((F.col("conversation_id") * 1000 + 999).alias("id"), "conversation_id", F.lit("user").alias("speaker"), F.lit("more").alias("text"), (F.col("t") + 1).alias("timestamp")))).select("id", "updated_at", "messages"))
query("k24_assistant_message", "SELECT conversation_id, count(*) FILTER (speaker = 'assistant') + 1 AS n FROM messages GROUP BY 1")(lambda v: v.messages.select("conversation_id", "speaker").union(v.messages.select("conversation_id").distinct().withColumn("speaker", F.lit("assistant"))).groupBy("conversation_id").agg(F.count_if(F.col("speaker") == "assistant").alias("n")))
query("k21_conversation_markdown", "SELECT conversation_id, string_agg('**' || speaker || ':** ' || text, chr(10) || chr(10) ORDER BY timestamp, id) AS content FROM messages GROUP BY 1")(lambda v: sinks.conversation_export(v.messages, "markdown"))
query("f17_metadata_predicates", "SELECT user_id, NOT list_contains(list(DISTINCT event_type), 'error') AS missing_error FROM queue GROUP BY 1")(lambda v: v.queue.groupBy("user_id").agg(F.collect_set("event_type").alias("s")).select("user_id", (F.size(F.array_except(F.array(F.lit("error")), "s")) > 0).alias("missing_error")))
query("f18_status_labels", "SELECT event_type, CASE event_type WHEN 'view' THEN 'ACTIVE' WHEN 'click' THEN 'PENDING' WHEN 'purchase' THEN 'COMPLETED' END AS status FROM (SELECT DISTINCT event_type FROM queue)")(lambda v: v.queue.select("event_type").distinct().select("event_type", F.try_element_at(F.create_map(*[F.lit(x) for x in ("view", "ACTIVE", "click", "PENDING", "purchase", "COMPLETED")]), "event_type").alias("status")))
query("f19_retention", "SELECT seq, CASE WHEN value > 90 THEN 'delete' WHEN value > 30 THEN 'archive' ELSE 'keep' END AS policy FROM queue")(lambda v: v.queue.select("seq", F.when(F.col("value") > 90, "delete").when(F.col("value") > 30, "archive").otherwise("keep").alias("policy")))
query("u06_metadata_union", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS fields FROM (SELECT user_id, event_type FROM queue UNION SELECT user_id, 'topic' FROM queue) GROUP BY 1")(lambda v: v.queue.groupBy("user_id").agg(F.collect_set("event_type").alias("s")).select("user_id", F.array_join(F.array_sort(F.array_union("s", F.array(F.lit("topic")))), ",").alias("fields")))

_EX = "list_filter(list_transform(string_split(usage_examples, ';'), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '')"
query("v01_vector_items", f"SELECT concat('w_', id) AS id, id AS original_id, 'word' AS content_type, term AS text FROM words UNION ALL SELECT concat('d_', id), id, 'definition', definition FROM words WHERE coalesce(definition, '') <> '' UNION ALL SELECT concat('e_', id, '_', i - 1), id, 'example', ex[i] FROM (SELECT id, {_EX} AS ex, unnest(range(1, len({_EX}) + 1)) AS i FROM words)")(lambda v: vectors.items(v.words))
query("v07_content_info", "SELECT concat('w_', id) AS item, term FROM words")(lambda v: vectors.items(v.words).where("content_type = 'word'").select(F.col("id").alias("item"), vectors.original_id(F.col("id")).alias("id")).join(v.words.select("id", "term"), "id").select("item", "term"))
query("v11_vector_emotion", "SELECT concat('w_', id) AS item, round(valence, 6) AS valence, round(arousal, 6) AS arousal FROM nodes")(lambda v: vectors.items(v.words).where("content_type = 'word'").join(v.word_emotion.withColumnRenamed("word_id", "original_id"), "original_id", "left").select(F.col("id").alias("item"), _R("valence").alias("valence"), _R("arousal").alias("arousal")))
query("v13_worker_success", "SELECT round(count(*) FILTER (definition IS NOT NULL) * 100 / count(*), 6) AS success FROM words")(lambda v: v.words.agg(_R(F.count_if(F.col("definition").isNotNull()) * 100 / F.count(F.lit(1))).alias("success")))


def _query_vector(v):
    return list(v.vectors.where("vec_id = 0").first()["embedding"])  # one row


_Q = ", q AS (SELECT embedding AS e FROM vectors WHERE vec_id = 0)"
_METRICS = {"cosine": "1 - list_cosine_similarity(embedding, e)", "euclidean": "list_distance(embedding, e)", "dot": "-list_dot_product(embedding, e)", "manhattan": "list_sum(list_transform(list_zip(embedding, e), lambda p: abs(p[1] - p[2])))"}
for _m, _s in _METRICS.items():
    query(f"v05_distance_{_m}", f"{_Q} SELECT vec_id, round({_s}, 6) AS distance FROM vectors, q")(lambda v, m=_m: v.vectors.select("vec_id", _R(vectors.distance(F.col("embedding"), F.array(*map(F.lit, _query_vector(v))), m)).alias("distance")))
query("v04_knn", f"{_Q} SELECT vec_id, round({_METRICS['cosine']}, 6) AS distance FROM vectors, q ORDER BY {_METRICS['cosine']}, vec_id LIMIT 10")(lambda v: vectors.search(v.vectors, _query_vector(v)).withColumn("distance", _R("distance")))
query("v04_knn_filtered", f"{_Q} SELECT vec_id, round({_METRICS['euclidean']}, 6) AS distance FROM vectors, q WHERE label = 1 ORDER BY {_METRICS['euclidean']}, vec_id LIMIT 100")(lambda v: vectors.search(v.vectors, _query_vector(v), 500, "euclidean", {"label": 1, "language": None}).withColumn("distance", _R("distance")))
query("v06_legacy_result", f"{_Q} SELECT vec_id AS id, round({_METRICS['cosine']}, 6) AS distance FROM vectors, q ORDER BY {_METRICS['cosine']}, vec_id LIMIT 5")(lambda v: vectors.search(v.vectors, _query_vector(v), 5).select(F.col("vec_id").alias("id"), _R("distance").alias("distance")))
query("v12_similarity", f"{_Q} SELECT vec_id, round(list_cosine_similarity(embedding, e), 6) AS similarity FROM vectors, q")(lambda v: v.vectors.select("vec_id", _R(1 - vectors.distance(F.col("embedding"), F.array(*map(F.lit, _query_vector(v))))).alias("similarity")))
query("f15_metadata_filter", "SELECT vec_id FROM vectors WHERE label = 2")(lambda v: v.vectors.where("label = 2").select("vec_id"))
query("t05_topk_capped", f"{_Q} SELECT vec_id FROM vectors, q ORDER BY {_METRICS['dot']}, vec_id LIMIT 100")(lambda v: vectors.search(v.vectors, _query_vector(v), 1000, "dot").select("vec_id"))
query("k08_vector_upsert", "SELECT vec_id, CASE WHEN label = 1 THEN 9 ELSE label END AS label FROM vectors")(lambda v: (lambda items: vectors.upsert(items, items.where("label = 1").withColumn("label", F.lit(9)), 64).select(F.col("id").alias("vec_id"), "label"))(v.vectors.withColumnRenamed("vec_id", "id")))
query("k09_vector_delete", "SELECT concat('w_', id) AS id FROM words WHERE id <> 5")(lambda v: vectors.delete(vectors.items(v.words), 5).where("content_type = 'word'").select("id"))
