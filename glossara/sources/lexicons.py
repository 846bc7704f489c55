"""Readers of dictionary files, thesauri, triples, word lists, keyword tables and graphs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..errors import InvalidInputError

_ENTRY = "struct<definition:string,examples:array<string>>"


def dictionary_json(spark: SparkSession, path: str) -> DataFrame:
    """(word, definition, examples) of one JSON object {word: {definition, examples}}."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{_ENTRY}>")).alias("word", "x")).select("word", "x.definition", "x.examples")


def jsonl(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """Lines of JSON; blank lines are skipped, a bad line is an error (or left out, if tolerant)."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line, text) of the lines that are no JSON of this schema; lines count from 1 in each file, blank ones too.

    A line's number is its place in its split plus the lines of the file's earlier splits, so no task numbers a whole file.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    splits = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    splits = splits.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    parsed = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    bad = lines.where(F.trim("value") != "").where(parsed.isNull() | parsed["_bad"].isNotNull())
    return bad.join(splits, ["file", "block"]).select("file", (F.col("at") - F.col("first") + F.col("earlier") + 1).alias("line"), F.col("value").alias("text"))


def checked_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; the first bad line is an error that names its file and line number."""
    first = bad_lines(spark, path, schema).orderBy("file", "line").first()
    if first:
        raise InvalidInputError(f"{first['file']}, line {first['line']}: no valid JSON: {first['text'][:80]}")
    return jsonl(spark, path, schema)


def numbered_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with ``line``, a number that grows with the place in the files."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("line"), F.from_json("value", schema).alias("x"))
    return lines.select("line", "x.*")


_TERM = r'(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)'


def n_triples(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """(s, p, o, lang) of N-Triples lines; a line of another form is an error (or left out, if tolerant)."""
    pattern = rf"^\s*{_TERM}\s+{_TERM}\s+{_TERM}\s*\.\s*$"
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    fits = F.col("value").rlike(pattern)
    rows = rows.where(fits) if tolerant else rows.where(F.when(fits, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no N-Triples line: "), F.substring("value", 1, 80))).cast("boolean")))
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r'^"((?:[^"\\]|\\.)*)".*$', "$1"), r"^<(.*)>$", "$1")
    part = lambda k: F.regexp_extract("value", pattern, k)
    return rows.select(bare(part(1)).alias("s"), bare(part(2)).alias("p"), bare(part(3)).alias("o"), F.nullif(F.regexp_extract(part(3), r'"@([A-Za-z0-9-]+)$', 1), F.lit("")).alias("lang"))


def turtle(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o, lang) of Turtle files, in the form of ``n_triples``; a syntax error names its file and place.

    Prefixes hold from where they stand to the end of their file, so a file is read by one task; a large dump is a folder
    of files.
    """
    from .turtle import triples

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    found = triples(data.decode(), f"f{crc32(name.encode()):08x}.")
                    while rows := list(islice(found, 10_000)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["s", "p", "o", "lang"])
                except ValueError as e:
                    raise InvalidInputError(f"{name}: {e}") from e

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, "s string, p string, o string, lang string")


def word_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''")


def media_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Paths of audio and video files, by extension."""
    kinds = "mp3|wav|flac|m4a|ogg|aac|mp4|mkv|avi|mov|webm|wmv|flv"
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "length").where(F.lower("path").rlike(rf"\.({kinds})$"))


def keyword_registry(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """(label, keywords) of rows(label, keyword): known labels only, each keyword once."""
    known = rows.join(F.broadcast(categories.select("label")), "label", "left_semi")  # some categories
    return known.groupBy("label").agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))


def gexf(spark: SparkSession, path: str, edge_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a GEXF file (or of folders of part files), read with Spark's XML source; attribute values as a map."""
    pairs = "attvalues struct<attvalue:array<struct<_for:string,_value:string>>>"
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, _label string, {pairs}").load(path)
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_id string, _source string, _target string, _weight double, {pairs}").load(edge_path or path)
    attrs = F.map_from_entries(F.transform("attvalues.attvalue", lambda a: F.struct(a["_for"], a["_value"]))).alias("attrs")
    return nodes.select(F.col("_id").alias("id"), F.col("_label").alias("term"), attrs), edges.select(F.col("_source").alias("u"), F.col("_target").alias("v"), F.col("_weight").alias("weight"), attrs)
