"""Work queue, conversations and worker statistics as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import key

ORDER = {"HIGH": 1, "NORMAL": 2, "LOW": 3}


def rank(priority: Column) -> Column:
    return F.coalesce(*[F.when(priority == k, F.lit(n)) for k, n in ORDER.items()])


def enqueue(items: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """items(seq, item, priority, ...) with key and accepted: the first of each normalised key that was not seen before."""
    own = items.withColumn("key", key(F.col("item")))
    first = own.groupBy("key").agg(F.min("seq").alias("__first"))
    if seen is not None:
        first = first.join(seen.select("key"), "key", "left_anti")
    return own.join(first, "key", "left").withColumn("accepted", F.coalesce(F.col("seq") == F.col("__first"), F.lit(False))).drop("__first")


def dequeue(accepted: DataFrame, n: int) -> DataFrame:
    """The next n items: by priority, then first come."""
    if n < 1:
        raise ValueError("INVALID_COUNT")
    return accepted.orderBy(rank(F.col("priority")), "seq").limit(n)


def counts(marked: DataFrame) -> DataFrame:
    return marked.agg(F.count_if("accepted").alias("enqueued"), F.count_if(~F.col("accepted")).alias("rejected"), (F.count_if("accepted") / F.count(F.lit(1))).alias("success_rate"))


def by_priority(rows: DataFrame) -> DataFrame:
    return rows.agg(*[F.count_if(F.col("priority") == k).alias(k.lower()) for k in ORDER])


def route(task: str, message: Column, conversation: Column, respond: Column) -> Column:
    """Route of a conversation task."""
    blank = F.trim(F.coalesce(message, F.lit(""))) == ""
    return F.when(blank, "invalid").when(conversation.isNull(), "start_conversation_and_add").when(respond, "add_message_and_respond").otherwise("add_message").alias(task)


def retry(rows: DataFrame, most: int = 3) -> DataFrame:
    """rows(status, attempts): what is tried again; deferred rows do not count as an attempt."""
    tried = F.when(F.col("status") == "DEFERRED", F.col("attempts")).otherwise(F.col("attempts") + 1)
    return rows.where("status <> 'SUCCESS'").withColumn("attempts", tried).where(F.col("attempts") < most)


def backoff(kind: str, n: Column) -> Column:
    """Seconds to wait after n failures, without jitter."""
    if kind == "emotion":
        return F.least(F.lit(60.0), F.pow(F.lit(2.0), F.least(F.lit(10), n - 1)))
    if kind == "database":
        return F.least(F.lit(300.0), 30 * F.pow(F.lit(2.0), F.least(F.lit(6), n - 1)))
    if kind == "conversation":
        return F.least(F.lit(60.0), F.pow(F.lit(2.0), n - 1))
    raise ValueError(f"unknown policy {kind!r}")


def adaptive_depth(term: Column, waiting: Column, seconds: Column) -> Column:
    d = 3 + (F.length(term) <= 5).cast("int") - (waiting > 1000).cast("int") - (seconds > 5).cast("int")
    return F.greatest(F.lit(1), F.least(F.lit(5), d))


def frequent(rows: DataFrame, term: str, least: int = 5) -> DataFrame:
    return rows.groupBy(term).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def productivity(processed: Column, growth: Column) -> Column:
    return processed / (processed + F.greatest(F.lit(0), growth))


def error_runs(rows: DataFrame, by: str, order: str, bad: Column) -> DataFrame:
    """Longest run of bad rows of each group (islands between good rows)."""
    w = Window.partitionBy(by).orderBy(order)
    own = rows.select(by, order, bad.alias("bad")).withColumn("island", F.sum(F.when(~F.col("bad"), 1).otherwise(0)).over(w))
    runs = own.where("bad").groupBy(by, "island").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(by).agg(F.max("n").alias("longest"))


def top_errors(rows: DataFrame, kind: str, k: int = 5) -> DataFrame:
    return rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), kind).limit(k)


def conversations(messages: DataFrame) -> DataFrame:
    """Headers from messages: created, updated, number of messages."""
    return messages.groupBy(F.col("conversation_id").alias("id")).agg(F.min("timestamp").alias("created_at"), F.max("timestamp").alias("updated_at"), F.count(F.lit(1)).alias("messages"))


def ended(headers: DataFrame, ends: DataFrame) -> DataFrame:
    """Headers with the status of the log of ends(id, at)."""
    last = ends.groupBy("id").agg(F.max("at").alias("at"))
    return headers.join(last, "id", "left").withColumn("status", F.when(F.col("at").isNotNull(), "COMPLETED").otherwise("ACTIVE")).withColumn("updated_at", F.greatest("updated_at", "at")).drop("at")


def history(messages: DataFrame, n: int = 20) -> DataFrame:
    """The last n messages of each conversation."""
    order = Window.partitionBy("conversation_id").orderBy(F.desc("timestamp"), F.desc("id"))
    return messages.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def stale(tasks: DataFrame, now: float, timeout: float) -> DataFrame:
    return tasks.where(F.lit(now) - F.col("started") > timeout)


#: State of a worker by what it has last seen.
STATES = {"view": "INITIALIZED", "click": "RUNNING", "signup": "PAUSED", "purchase": "STOPPING"}
#: Seconds after which a job of the store is due.
INTERVALS = {"maintenance": 3600, "backup": 86400, "optimise": 43200}


def state(event: Column, states: dict[str, str] = STATES, other: str = "STOPPED") -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in states.items() for x in pair]), event), F.lit(other))


def due(elapsed: Column, intervals: dict[str, int] = INTERVALS) -> list[Column]:
    """A flag for each job whose interval has passed."""
    return [(elapsed >= seconds).alias(job) for job, seconds in intervals.items()]
