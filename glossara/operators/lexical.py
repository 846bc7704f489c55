"""Dictionary sources merged into one lexical record for each word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

NOT_FOUND, NO_EXAMPLE = "Not Found", "No example available"


def dictionary(words: DataFrame, entries: DataFrame) -> DataFrame:
    """words(word) with the definition and examples of entries(word, definition, examples), or the default."""
    ok = entries.where("definition is not null and examples is not null")
    return words.join(ok, "word", "left").select("word", F.coalesce("definition", F.lit(NOT_FOUND)).alias("definition"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def openthesaurus(words: DataFrame, lines: DataFrame) -> DataFrame:
    """(word, synonym, place): other words of every line with the word, in order, the first of equals.  lines(line, words)."""
    flat = lines.select("line", F.posexplode("words").alias("pos", "synonym"), "words")
    holds = lines.select("line", F.explode(F.array_distinct("words")).alias("word")).join(words.select("word").distinct(), "word", "left_semi")
    found = holds.join(flat, "line").where("synonym <> word").groupBy("word", "synonym").agg(F.min(F.struct("line", "pos")).alias("at"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("word").orderBy("at")) - 1).select("word", "synonym", "place")


def thesaurus(words: DataFrame, lines: DataFrame) -> DataFrame:
    return lines.join(words.select("word").distinct(), "word", "left_semi").select("word", F.explode("synonyms").alias("synonym"))


def dbnary(words: DataFrame, triples: DataFrame) -> DataFrame:
    """Definitions and translations by the property path canonicalForm / writtenRep, with two optional parts.

    triples(s, p, o, lang); a row for each definition and translation of an entry, if one of them is there.
    """
    of = lambda p, s, o, lang=None: triples.where(F.col("p").endswith(p) if lang is None else F.col("p").endswith(p) & (F.col("lang") == lang)).select(F.col("s").alias(s), F.col("o").alias(o))
    entry = of("canonicalForm", "entry", "form").join(of("writtenRep", "form", "word", "en"), "form").join(words.select("word").distinct(), "word", "left_semi")
    rows = entry.join(of("definition", "entry", "definition"), "entry", "left").join(of("translation", "entry", "translation"), "entry", "left")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select("word", empty("definition"), empty("translation")).where("definition <> '' or translation <> ''")


def definitions(*parts: Column) -> Column:
    """Distinct definitions of the sources, in order of text, joined by " | "."""
    flat = F.filter(F.concat(*parts), lambda x: x.isNotNull() & (x != "") & (x != NOT_FOUND))
    return F.array_join(F.array_sort(F.array_distinct(flat)), " | ")


def usage(*parts: Column) -> Column:
    return F.array_distinct(F.filter(F.concat(*parts), lambda x: x.isNotNull() & (x != NO_EXAMPLE)))


def relationships(synonyms: list[DataFrame], antonyms: DataFrame, translations: DataFrame) -> DataFrame:
    """(word, related_term, type) of all sources, once each; a word is no synonym of itself."""
    rows = None
    for s in synonyms:
        own = s.select("word", F.col("synonym").alias("related_term"), F.lit("synonym").alias("type")).where("word <> related_term")
        rows = own if rows is None else rows.unionByName(own)
    rows = rows.unionByName(antonyms.select("word", F.col("antonym").alias("related_term"), F.lit("antonym").alias("type")))
    rows = rows.unionByName(translations.select("word", F.col("translation").alias("related_term"), F.lit("translation").alias("type")).where("word <> related_term"))
    return rows.where("related_term <> ''").distinct()


def part_of_speech(words: DataFrame, synsets: DataFrame) -> DataFrame:
    """Part of speech of the first synset, or an empty string.  synsets(word, ord, part_of_speech, ...)."""
    first = synsets.groupBy("word").agg(F.min_by("part_of_speech", "ord").alias("part_of_speech"))
    return words.join(first, "word", "left").select("word", F.coalesce("part_of_speech", F.lit("")).alias("part_of_speech"))


def dataset(words: DataFrame, odict: DataFrame, opendict: DataFrame, open_lines: DataFrame, lines: DataFrame, triples: DataFrame, synsets: DataFrame) -> DataFrame:
    """One nested record for each word, from all sources by left joins."""
    listed = lambda df, col, *by: df.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct(*by, col))), lambda x: x[col]).alias(col))
    out = words.select("word").distinct()
    for name, src in (("odict", odict), ("opendict", opendict)):
        d = dictionary(words.select("word").distinct(), src)
        out = out.join(d.select("word", F.struct("definition", "examples").alias(name)), "word", "left")
    out = out.join(listed(openthesaurus(words, open_lines), "synonym", "place").withColumnRenamed("synonym", "openthesaurus"), "word", "left")
    out = out.join(listed(thesaurus(words, lines), "synonym").withColumnRenamed("synonym", "thesaurus"), "word", "left")
    db = dbnary(words, triples).groupBy("word").agg(F.array_sort(F.collect_list(F.struct("definition", "translation"))).alias("dbnary"))
    wn = synsets.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("ord", "part_of_speech", "definition", "synonyms", "antonyms"))).alias("wordnet"))
    return out.join(db, "word", "left").join(wn, "word", "left")


def discovery(frontier: DataFrame, related: DataFrame, depth: int, cap: int | None = None) -> DataFrame:
    """(word, depth) reached from the frontier by related(word, other) in up to ``depth`` rounds, each word once.

    ``cap``: largest number of new words for each round, in order of text; a limit of the operator, none by default.
    """
    from ..scratch import fixed

    seen = now = frontier.select("word").distinct().withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        new = now.join(related, "word").select(F.lower(F.trim("other")).alias("word")).where("word <> ''").distinct().join(seen.select("word"), "word", "left_anti")
        new = (new.orderBy("word").limit(cap) if cap else new).withColumn("depth", F.lit(d))
        now = fixed(new) if d < depth else new
        seen = seen.union(now)
    return seen
