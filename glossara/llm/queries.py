"""Queries opN_* of the training-data operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .chat import format_chats, read_chats
from .common import table
from .exact_dedup import exact_dedup
from .mixing import mix
from .packing import pack
from .quality import quality
from .quality_sql import quality_sql
from .sharding import shard
from .simhash import near_duplicates
from .substring_dedup import substring_dedup
from .token_planes import token_planes
from .toxicity import toxicity

TOKENIZER = "byte_bpe_50k.json"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op3_token_planes(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return token_planes(table(spark, sf_dir, "documents"), tokenizer or tokenizer_path(), digest=True)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).drop("d2")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op7_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """A row for each sequence; a digest stands for its ids."""
    sequences = pack(table(spark, sf_dir, "documents"), tokenizer or tokenizer_path())
    return sequences.withColumn("ids_xxhash64", F.xxhash64("ids")).drop("ids")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("blocks")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


EXTRA_CHAT = "\\### Assistant: </turn> ok"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", EXTRA_CHAT), (-7, 1, "assistant", EXTRA_CHAT)], "conv_id long, turn long, role string, text string")
    read = read_chats(format_chats(turns.unionByName(extra)))
    line = F.lit("\n")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], line, t["text"], line)), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {f.__name__: f for f in (op1_sharding, op2_substring_dedup, op3_token_planes, op4_simhash, op5_quality, op6_exact_dedup, op7_packing, op8_mixing, op9_toxicity, op10_chat)}

_WORDS = r"'[^\x20\x09-\x0D]+'"

ORACLES = {
    "op2_substring_dedup": rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
pos AS (SELECT rid, doc_id, w, unnest(range(1, greatest(len(w) - 12, 0) + 1)) AS p FROM docs),
win AS (SELECT rid, doc_id, p, array_to_string(w[p:p + 12], ' ') AS seq FROM pos),
least_ids AS (SELECT seq, min(doc_id) AS least FROM win GROUP BY seq),
gone AS (SELECT DISTINCT rid, p + o.k AS p FROM win JOIN least_ids USING (seq), (SELECT unnest(range(0, 13)) AS k) o WHERE least < doc_id),
gone_list AS (SELECT rid, list(p) AS ps FROM gone GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' '), '')) AS kept_sha256
FROM docs LEFT JOIN gone_list USING (rid)""",
    "op5_quality": quality_sql(),
    "op6_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op10_chat": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
coded AS (
  SELECT *, replace(replace(replace(replace(replace(role, '\', '\e'), '###', '\h'), '</turn>', '\t'), '</part>', '\p'), ': ', '\c') AS role_code,
    replace(replace(replace(replace(text, '\', '\e'), '###', '\h'), '</turn>', '\t'), '</part>', '\p') AS text_code,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(text_code) + CASE WHEN before IS NULL OR before <> role THEN length('### ' || role_code || ': ') + 8 ELSE 7 END) AS BIGINT) AS formatted_chars
FROM coded GROUP BY conv_id""",
}
