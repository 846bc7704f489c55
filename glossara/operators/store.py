"""Word store: scans, lookups, upserts and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import examples
from .numbering import numbered


def all_words(words: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return words.select("id", "term", text("definition"), text("usage_examples"))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key; a max over structs, which is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in [order, *rest]])


def upsert_words(words: DataFrame, new: DataFrame, order: str = "last_refreshed") -> DataFrame:
    """Words with the newest definition, part of speech and examples of each term; the smallest id is kept.

    ``new`` has no ids; unseen terms follow the largest one, in the order of the terms.
    """
    if new.where("term is null or trim(term) = ''").limit(1).count():
        raise ValueError("term must not be empty")
    ids = words.groupBy("term").agg(F.min("id").alias("id"))
    cols = ["term", "definition", "part_of_speech", "usage_examples", order]
    newest = latest(words.select(*cols).unionByName(new.select(*cols)), "term", order)
    known = newest.join(ids, "term", "left")
    fresh = add_terms(words.select("id", "term"), known.where("id is null").select("term"), lower=False)
    return known.where("id is not null").unionByName(known.where("id is null").drop("id").join(fresh, "term"))


def add_terms(words: DataFrame, terms: DataFrame, lower: bool = True) -> DataFrame:
    """(id, term) of the terms that words does not have: ids after the largest, in the order of the terms."""
    k = F.lower("term") if lower else F.col("term")
    fresh = terms.distinct().join(words.select(k.alias("__k")), k == F.col("__k"), "left_anti")
    top = words.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))  # one row is broadcast
    return numbered(fresh, "term").crossJoin(F.broadcast(top)).select((F.col("top") + F.col("place") + 1).alias("id"), "term")


def start_conversations(messages: DataFrame, queue: DataFrame) -> DataFrame:
    """(id, user_id): a conversation for each user of the queue, after the largest one of messages, in the order of the users
    (null last); ids are null where messages has none, as in SQL."""
    users = queue.select(F.struct(F.col("user_id").isNull().alias("none"), "user_id").alias("user")).distinct()
    top = messages.agg(F.max("conversation_id").alias("top"))  # one row is broadcast
    return numbered(users, "user").crossJoin(F.broadcast(top)).select((F.col("top") + F.col("place") + 1).alias("id"), "user.user_id")


def insert_relationships(relationships: DataFrame, words: DataFrame, new: DataFrame) -> DataFrame:
    """New (word_id, related_term, relationship_type) rows: valid, with a known base term, not there yet, once each."""
    ok = new.where("trim(base) <> '' and trim(related_term) <> '' and trim(relationship_type) <> '' and base <> related_term")
    known = ok.join(words.select(F.col("term").alias("base"), F.col("id").alias("word_id")), "base").select("word_id", "related_term", "relationship_type").distinct()
    return known.join(relationships, ["word_id", "related_term", "relationship_type"], "left_anti")


def entry(words: DataFrame, relationships: DataFrame, where: Column) -> DataFrame:
    """Words with their relationships as an array of structs and their examples as an array."""
    rows = words.where(where)
    rels = relationships.join(rows.select(F.col("id").alias("word_id")), "word_id", "left_semi").groupBy(F.col("word_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("related_term", "relationship_type"))).alias("relationships"))
    return rows.join(rels, "id", "left").select("id", "term", F.coalesce("definition", F.lit("")).alias("definition"), "part_of_speech", F.lit("en").alias("language"), examples(F.col("usage_examples")).alias("usage_examples"), F.coalesce("relationships", F.array().cast("array<struct<related_term:string,relationship_type:string>>")).alias("relationships"))


def integrity(words: DataFrame, relationships: DataFrame) -> DataFrame:
    """(problem, n): dangling word ids, duplicate terms, duplicate relationships."""
    dangling = relationships.join(words.select(F.col("id").alias("word_id")), "word_id", "left_anti").agg(F.lit("dangling").alias("problem"), F.count(F.lit(1)).alias("n"))
    terms = words.groupBy("term").count().where("count > 1").agg(F.lit("duplicate term"), F.count(F.lit(1)))
    rels = relationships.groupBy("word_id", "related_term", "relationship_type").count().where("count > 1").agg(F.lit("duplicate relationship"), F.count(F.lit(1)))
    return dangling.union(terms).union(rels)


def verify_tables(spark, required: tuple[str, ...] = ("words", "relationships")) -> bool:
    return all(spark.catalog.tableExists(t) for t in required)


def sql(spark, text: str, args=None, **views: DataFrame) -> DataFrame:
    """Any parameterised SELECT over the given views."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=args)


def scalar(df: DataFrame):
    """First column of the first row, or None."""
    row = df.first()
    return None if row is None else row[0]


def retention(backups: DataFrame, keep: int = 10) -> DataFrame:
    """backups(path, mtime) with whether each is among the newest; paths are unique."""
    newest = backups.orderBy(F.desc("mtime"), "path").limit(keep).select("path", F.lit(True).alias("kept"))
    return backups.join(F.broadcast(newest), "path", "left").fillna(False, ["kept"])  # ``keep`` rows


def related_weighted(relationships: DataFrame, words: DataFrame, types: DataFrame | None, k: int = 15) -> DataFrame:
    """Up to k related words of each word with the weight of the type (0.5 where unknown, or without types)."""
    w1 = words.select(F.col("id").alias("word_id"))
    w2 = words.select(F.col("term").alias("related_term"), F.col("id").alias("related_id"))
    rows = relationships.join(w1, "word_id", "left_semi").join(w2, "related_term")
    if types is None:
        rows = rows.withColumn("weight", F.lit(0.5))
    else:
        rows = rows.join(F.broadcast(types.select(F.col("type").alias("relationship_type"), "weight")), "relationship_type", "left").withColumn("weight", F.coalesce("weight", F.lit(0.5)))
    order = Window.partitionBy("word_id").orderBy(F.desc("weight"), "relationship_type", "related_id", "id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("word_id", "relationship_type", "related_term", "related_id", "weight")
