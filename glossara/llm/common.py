"""Helpers that the training-data operators share."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Characters that separate words: space and U+0009 to U+000D.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
SPACE_PATTERN = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a folder of this process's own only where that is unset, as in local tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def full_path(spark: SparkSession, path: str) -> str:
    """The path with its scheme: one without a scheme is in Spark's default file system, as Spark itself takes it."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(own).toString()
    return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full


#: Scratch folders of this session, oldest first.
_scratch: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """Path of a new folder in the shared one, which ``release`` deletes."""
    _scratch.append(full_path(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"))
    return _scratch[-1]


def mark() -> int:
    """A point for ``release``."""
    return len(_scratch)


def release(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Deletes the scratch folders and checkpoints made after a ``mark``.  Results that still read them must be written first."""
    gone = [path for path in _scratch[since:] if path not in keep]
    _scratch[since:] = [path for path in _scratch[since:] if path in keep]
    for path in gone:
        own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared checkpoint folder, so that later reads survive lost executors."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    file = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        _scratch.append(file.get())
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def buckets_for(rows: int, per_bucket: int = 20_000) -> int:
    """Bucket count that follows from the row count alone, so that results do not depend on the cluster."""
    return max(4, -(-rows // per_bucket))


def text_digest(text_col: str = "text") -> Column:
    """SHA-256 of a text; null counts as empty."""
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)


def keep_rows(docs: DataFrame, kept: DataFrame, key: str | tuple[str, ...] = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose key (a column or several) is in ``kept`` (null matches null), with the columns of ``docs``.

    A key repeated in ``kept`` means that one of several rows with this key was chosen more than once; ``docs`` rows
    are never multiplied.
    """
    keys = (key,) if isinstance(key, str) else key
    chosen = kept.select(*[F.col(c).alias(f"__kept{k}") for k, c in enumerate(keys)]).distinct()
    match = [F.col(f"__kept{k}").eqNullSafe(docs[c]) for k, c in enumerate(keys)]
    return docs.join(chosen, functools.reduce(lambda a, b: a & b, match), "left_semi")


def keep_one(docs: DataFrame, kept: DataFrame, digest: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each id and text digest in ``kept``; of several the first by its other columns."""
    names = docs.columns
    out = keep_rows(docs.withColumn("__digest", text_digest(text_col)), kept.select(id_col, F.col(digest).alias("__digest")), (id_col, "__digest"))
    if repeats(docs, id_col, text_col):
        first = F.min(F.struct(*[F.struct(F.col(c).isNull().alias("none"), c).alias(c) for c in names if c != text_col], F.col(text_col))).alias("first")
        out = out.groupBy(id_col, "__digest").agg(first).select(*[F.col(f"first.{c}" if c == text_col else f"first.{c}.{c}") for c in names])
    return out.select(*names)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> bool:
    """Whether rows share their id and text."""
    return docs.groupBy(F.col(id_col), text_digest(text_col)).count().where("count > 1").limit(1).count() > 0


#: Rows of one group that a window sums up in one task.
SPAN = 2_000


def starts(counts: DataFrame, key: str, order: str, value: str, span: int = SPAN) -> DataFrame:
    """counts with ``start``: the sum of ``value`` over the rows of the same key with a smaller ``order`` (whole, from 0).

    Sums go by spans of ``span`` orders and then over the spans, so no task sorts all rows of a key.
    """
    rows = counts.withColumn("__span", F.floor(F.col(order) / F.lit(span)))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy(key, "__span").agg(F.sum(value).alias("__sum"))
    spans = spans.select(key, "__span", F.coalesce(F.sum("__sum").over(before(key, "__span")), F.lit(0)).alias("__before"))
    rows = rows.withColumn("start", F.coalesce(F.sum(value).over(before(key, "__span", order)), F.lit(0)))
    return rows.join(spans, [key, "__span"]).withColumn("start", F.col("start") + F.col("__before")).drop("__span", "__before")


#: Rows of a table that may be broadcast, of some hundred bytes each.
LOOKUP_ROWS = 50_000
SALTS = 32


def lookup(rows: DataFrame, small: DataFrame, key: str, how: str = "inner", n: int | None = None, limit: int = LOOKUP_ROWS) -> DataFrame:
    """rows joined to ``small`` (one row for each key), where one key may hold a large share of ``rows``.

    Up to ``limit`` counted rows of ``small`` are broadcast, so ``rows`` stay where they are; more are repeated for each
    of SALTS salts, and each key's rows are dealt to that many tasks.  Null matches null.
    """
    n = small.count() if n is None else n
    other = small.withColumnRenamed(key, "__key")
    match = F.col("__key").eqNullSafe(F.col(key))
    if n <= limit:
        return rows.join(F.broadcast(other), match, how).drop("__key")
    salted = other.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = rows.withColumn("__own", F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), F.lit(SALTS)).cast("int"))
    return own.join(salted, match & (F.col("__salt") == F.col("__own")), how).drop("__key", "__salt", "__own")
