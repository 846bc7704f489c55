from collections import Counter

import pytest
from pyspark.sql import functions as F

from glossara.llm.common import buckets_for, keep_rows, lookup


@pytest.mark.parametrize("limit", [100, 1])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup(spark, limit, how):
    rows = spark.createDataFrame([(k, "hot" if k % 3 else ("a" if k % 2 else None)) for k in range(200)] + [(999, "unknown")], "id long, key string")
    small = spark.createDataFrame([("hot", 1), ("a", 2), (None, 3)], "key string, v int")
    got = Counter((r.id, r.key, r.v) for r in lookup(rows, small, "key", how, limit=limit).collect())
    value = {"hot": 1, "a": 2, None: 3}
    expected = Counter((r.id, r.key, value.get(r.key)) for r in rows.collect() if how == "left" or r.key in value)
    assert got == expected


def test_keep_rows_never_multiplies(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d")], "doc_id long, text string")
    kept = spark.createDataFrame([(1,), (1,), (None,)], "doc_id long")
    assert sorted(r.text for r in keep_rows(docs, kept).collect()) == ["a", "b", "c"]
    assert keep_rows(docs, kept.where(F.lit(False))).count() == 0


def test_buckets():
    assert buckets_for(0) == 4 and buckets_for(100_000, 5_000) == 20
