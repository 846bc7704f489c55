"""Extension points: embedders, item processors, concept hooks, conversation stages and taggers.

Functions on Columns stay in the plan; Python models run as Pandas UDFs over Arrow batches.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent import futures
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

EMBEDDERS: dict[str, Callable[[pd.Series], pd.Series]] = {}
HOOKS: dict[str, Callable[[Column], Column]] = {}
TRANSFORMERS: dict[str, Callable[[Column], Column]] = {}


class Reflexive(Protocol):
    """Conversation models: each takes the messages and adds a column for those after it."""

    def reflex(self, messages: DataFrame) -> DataFrame: ...


class Lightweight(Protocol):
    def route(self, messages: DataFrame) -> DataFrame: ...


class Affective(Protocol):
    def feel(self, messages: DataFrame) -> DataFrame: ...


class Identity(Protocol):
    def reply(self, messages: DataFrame) -> DataFrame: ...


def respond(messages: DataFrame, reflexive: Reflexive, lightweight: Lightweight, affective: Affective, identity: Identity) -> DataFrame:
    """The four models in turn."""
    return staged(messages, [reflexive.reflex, lightweight.route, affective.feel, identity.reply])


class MockModel:
    """All four models, from the messages alone, for tests."""

    def reflex(self, messages: DataFrame) -> DataFrame:
        return messages.withColumn("reflex", F.concat(F.lit("note:"), "speaker"))

    def route(self, messages: DataFrame) -> DataFrame:
        return messages.withColumn("route", F.when(F.length("text") > 500, "long").otherwise("short"))

    def feel(self, messages: DataFrame) -> DataFrame:
        return messages.withColumn("valence", (F.col("id") % 11 - 5) / 10)

    def reply(self, messages: DataFrame) -> DataFrame:
        return messages.withColumn("reply", F.concat(F.lit("[Voice v1]: "), "speaker"))


def register_transformer(name: str, f: Callable[[Column], Column]) -> None:
    """f: an emotion vector (map of dimensions) to another one."""
    TRANSFORMERS[name] = f


def transformed(vector: Column, *names: str) -> Column:
    for name in names:
        vector = TRANSFORMERS[name](vector)
    return vector


def as_completed(jobs: dict[str, Callable[[], object]], workers: int = 4) -> Iterator[tuple[str, object]]:
    """(name, result) of Spark actions that run side by side, as each ends; an error ends up with its job's name."""
    with ThreadPoolExecutor(workers) as pool:
        names = {pool.submit(f): name for name, f in jobs.items()}
        for done in futures.as_completed(names):
            yield names[done], done.exception() or done.result()


@contextmanager
def measured(times: dict[str, float], name: str) -> Iterator[None]:
    """Adds the seconds that the block takes to times[name], also when it fails."""
    began = time.perf_counter()
    try:
        yield
    finally:
        times[name] = times.get(name, 0.0) + time.perf_counter() - began


def register_embedder(name: str, f: Callable[[pd.Series], pd.Series]) -> None:
    """f: a series of texts to a series of lists of floats."""
    EMBEDDERS[name] = f


def embed(df: DataFrame, name: str, text: str = "text", out: str = "embedding") -> DataFrame:
    f = EMBEDDERS[name]

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return f(texts)

    return df.withColumn(out, run(F.col(text)))


def register_hook(name: str, f: Callable[[Column], Column]) -> None:
    """f: the primary vector of a concept to an array of (label, dims, confidence)."""
    HOOKS[name] = f


def hooked(df: DataFrame, vector: str = "m") -> DataFrame:
    """One row for each concept and meta emotion of all hooks."""
    if not HOOKS:
        return df.select("id", F.lit(None).cast("string").alias("label")).where("false")
    found = F.flatten(F.array(*[F.transform(f(F.col(vector)), lambda x: x["label"]) for _, f in sorted(HOOKS.items())]))
    return df.select("id", F.explode(found).alias("label"))


def process(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f over batches of items, on all partitions at once; results stream back as they are made."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield f(batch)

    return df.mapInPandas(run, schema)


def staged(df: DataFrame, stages: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Stages of a response, each adding columns for the next."""
    for stage in stages:
        df = stage(df)
    return df


def bigrams(words: Column) -> Column:
    """Neighbouring words, a stand-in for multi-word expressions where there is no tagger; longer than five characters."""
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.filter(pairs, lambda p: F.length(p) > 5))
