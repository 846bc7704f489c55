"""Queries that take every edge and every twentieth vector, against brute force."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossara.operators import clusters, vectors
from glossara.plans import adapters, registry

registry.load()


def test_betweenness_by_source(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(70)] + [(50, 51), (51, 52), (51, 52)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs if a != b], "u long, v long, weight double")
    got = {r.id: r.score for r in clusters.betweenness_by_source(edges, 5).collect()}
    expected = clusters.betweenness(edges)
    assert got.keys() == expected.keys() and all(math.isclose(got[k], x, abs_tol=2e-6) for k, x in expected.items())
    assert clusters.betweenness_by_source(edges.where("false")).count() == 0


@pytest.mark.parametrize("cells", [4, 2_000_000])
def test_betweenness_of_any_size(spark, monkeypatch, cells):
    """More edges than the driver may collect; components of all sizes in bundles, alone and in shares of their nodes."""
    rng = random.Random(8)
    pairs = [(a, a + 1) for a in range(1000, 1040)] + [(2000, k) for k in range(2001, 2030)] + [(3000, 3000)]
    for k in range(25):
        size = rng.choice((2, 3, 5, 9, 30))
        pairs += [(100 * k + rng.randrange(size), 100 * k + 50 + rng.randrange(size)) for _ in range(3 * size)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in sorted(set(pairs))], "u long, v long, weight double").repartition(3)
    expected = clusters.betweenness(edges)
    for name, value in {"MAX_EDGES": 100, "BUNDLE": 40, "SHARE": 300.0, "WIDTH": 4, "CELLS": cells, "SPAN": 64}.items():
        monkeypatch.setattr(clusters, name, value)
    got = {r.id: r.score for r in clusters.betweenness_by_source(edges).collect()}
    assert got.keys() == expected.keys() and all(math.isclose(got[k], x, abs_tol=2e-6) for k, x in expected.items())


@pytest.mark.parametrize("compiled", [True, False])
def test_betweenness_of_all_shapes(spark, compiled):
    """Cycles, a tail behind a dense part, even levels, repeated edges, loops; each pair once, wherever its ends stand."""
    rng = random.Random(12)
    pairs = [(k, (k + 1) % 41) for k in range(41)] + [(100 + k, 100 + j) for k in range(12) for j in range(k)] + [(111 + k, 112 + k) for k in range(25)]
    pairs += [(300 + k, 300 + (k - 1) // 2) for k in range(1, 63)] + [(400 + k, 400 + j) for k in range(9) for j in range(9, 21)] * 2 + [(430, 430), (400, 430), (500, 500)]
    pairs += [(1000 + rng.randrange(300), 1000 + rng.randrange(300)) for _ in range(1500)] + [(1000 + k, 2000 - k) for k in range(40)] + [(1999 - k, 1960 - k) for k in range(60)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "u long, v long, weight double").repartition(3)
    expected = clusters.betweenness(edges)
    got = {r.id: r.score for r in clusters.betweenness_by_source(edges, 7, compiled).collect()}
    assert got.keys() == expected.keys() and all(math.isclose(got[k], x, rel_tol=1e-9, abs_tol=2e-6) for k, x in expected.items())


def test_compiled_betweenness_is_quick(spark):
    """A share of the nodes of a graph as large as sf0.1's takes at most half of what it takes in numpy."""
    ends = np.random.default_rng(5).integers(0, 20_000, (290_000, 2))
    u, v = ends[ends[:, 0] != ends[:, 1]].T
    _, *graph = clusters._laid_out(np.zeros(len(u), np.int64), u, v)
    took = []
    row = spark.createDataFrame([tuple(bytearray(x.astype("<i4").tobytes()) for x in graph)], "first binary, ends binary, begin binary")
    scores = row.select(F.call_function(clusters._compiled(spark), "first", "ends", "begin", F.lit(3), F.lit(25)).alias("x")).select(F.aggregate("x", F.lit(0.0), lambda a, b: a + b))
    for run in (lambda: clusters._share(*graph, 3, 25).sum() / 2, lambda: scores.first()[0]):
        began = time.monotonic()
        total = run()
        took.append((time.monotonic() - began, total))
    # nodes after each source are about half of all
    assert took[1][0] < took[0][0] / 2 and math.isclose(took[0][1], took[1][1], rel_tol=0.05), took


def test_cluster_queries_take_all_edges(spark):
    d = "/root/testdata/sf0.001"
    edges = adapters.Views(spark, d).edges
    ends = {x for r in edges.select("u", "v").collect() for x in r}
    for name in ("g11_louvain", "g11l_betweenness"):
        assert {r.id for r in registry.QUERIES[name](spark, d).collect()} == ends


def test_search_all_against_brute_force(spark):
    rng = random.Random(4)
    points = {k: [float(rng.randrange(6)) for _ in range(3)] for k in range(90)}
    rows = spark.createDataFrame([*points.items(), (91, None)], "vec_id long, embedding array<float>").repartition(4)
    queries = rows.where("vec_id % 9 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("e"))
    got = {}
    for r in vectors.search_all(rows, queries, 5, block=3).collect():
        got.setdefault(r.q, []).append((r.distance, r.vec_id))
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted((math.dist(points[q], p), k) for k, p in points.items())[:5] for q in points if q % 9 == 0}
    assert vectors.search_all(rows, queries.where("false")).count() == 0
