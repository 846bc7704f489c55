"""Documents through quality rules, exact dedup, near dedup, mixing and packing.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of documents, the last sequences of token ids.

Defined cases: ids may be null or repeated, as stages decide on rows by id and text together (quality also by language and
source), never by id alone; of rows that repeat an id together with its text the dedup stages keep one.  Null and empty
texts fail the quality rules; in a later stage's own input they are equal to each other, take no part in the mix, and pack
to an end id.  Null languages and sources are groups of their own; an empty table passes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from glossara.llm.common import cut, keep_one, keep_rows, mark, release, scratch, table, text_digest
from glossara.llm.exact_dedup import exact_dedup
from glossara.llm.mixing import mixture
from glossara.llm.near_dedup import near_kept
from glossara.llm.packing import pack
from glossara.llm.quality import quality
from glossara.llm.queries import tokenizer_path

#: Rows of runs of the whole pipeline depend on pseudorandom permutations, which SQL can't express.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and are no outliers of their language and source."""
    # what is decided depends on these columns alone, so rows that share them share the decision
    key = ("doc_id", "lang", "source", "__digest")
    keyed = docs.withColumn("__digest", text_digest())
    judged = quality(keyed.withColumn("__key", F.struct(*key)), id_col="__key").where("kept")
    return keep_rows(keyed, judged.select("__key.*"), key).drop("__digest")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id."""
    return keep_one(docs, cut(exact_dedup(docs, keep="largest").where("kept")), "text_sha256")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of texts that share four fifths of their 5-word shingles."""
    return keep_one(docs, near_kept(docs), "digest")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, cut to the blocks it takes."""
    return mixture(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids, with the documents that each holds."""
    return pack(docs, tokenizer_path())


STAGES = [("quality", quality_rules), ("exact", exact), ("near", near), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage leaves behind is deleted once the next has been written."""
    docs, before = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        folder = scratch(spark, f"pipeline-{name}")
        made.write.parquet(folder)
        docs = spark.read.parquet(folder)
        release(spark, before, keep=(folder,))
    return docs
