"""Clusters, settings, extension points, sinks and remaining edge cases."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from glossara import extensions
from glossara.catalog import DOMAIN_CONTEXTS
from glossara.config import ParserConfig, Settings, truthy
from glossara.errors import InvalidInputError, NotFoundError, TooLargeError
from glossara.functions import emotion as E, text as X
from glossara.operators import clusters, graph, lexical, store, vectors, work
from glossara.sources import lexicons, sinks


@pytest.fixture(scope="module")
def two_triangles(spark):
    nodes = spark.createDataFrame([(k, f"t{k}", 0.1 * k, 0.5) for k in range(1, 7)], "id long, term string, valence double, arousal double")
    pairs = [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)]
    edges = spark.createDataFrame([(a, b, "evokes", 0.9 if (a, b) != (3, 4) else 0.1, "emotional") for a, b in pairs], "u long, v long, relationship string, weight double, dimension string")
    return nodes, edges


def test_louvain_finds_the_triangles(two_triangles):
    _, edges = two_triangles
    assert clusters.louvain(edges) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    assert clusters.louvain(edges.where("false")) == {}


def test_betweenness(two_triangles):
    _, edges = two_triangles
    score = clusters.betweenness(edges)
    assert score[3] == score[4] == 6.0 and score[1] == 0.0


def test_bound_of_graphs_in_memory(two_triangles, monkeypatch):
    monkeypatch.setattr(clusters, "MAX_EDGES", 3)
    with pytest.raises(TooLargeError):
        clusters.louvain(two_triangles[1])


def test_label_propagation(two_triangles):
    nodes, edges = two_triangles
    got = {r.id: r.label for r in clusters.label_propagation(nodes, edges, 4).collect()}
    assert len({got[1], got[2], got[3]}) == len({got[4], got[5], got[6]}) == 1
    assert clusters.members(clusters.label_propagation(nodes, edges, 4), nodes, 4).count() in (0, 1)


def test_transitions(two_triangles):
    nodes, edges = two_triangles
    got = {tuple(r.path): round(r.strength, 6) for r in graph.transitions(edges, nodes, 2, 0.5).collect()}
    assert got[(1, 2)] == 0.9 and got[(1, 2, 3)] == 0.81 and (3, 4) not in got
    assert not [p for p in got if len(set(p)) < len(p)]


def test_context_weights_are_checked(two_triangles):
    nodes, edges = two_triangles
    with pytest.raises(ValueError):
        graph.apply_context(edges, nodes, {"anger": 1.5})
    assert graph.apply_context(edges, nodes, {"joy": 0.1, "evok": 0.5}).count() == 7


def test_settings():
    seen = []
    s = Settings({"GLOSSARA_QUEUE_BATCH_SIZE": "7"})
    s.observers.append(lambda *x: seen.append(x))
    assert s.get("queue").batch_size == 7 and s.get("queue").high_throughput().batch_size == 28
    s.set("graph", limit_nodes=5)
    assert s.get("graph").limit_nodes == 5 and seen == [("graph", {"limit_nodes": 5})]
    assert s.order().index("parser") < s.order().index("graph")
    assert json.loads(sinks.config_json(s.as_dict()))["vector"]["metric"] == "cosine"
    with pytest.raises(NotFoundError):
        s.get("nothing")
    with pytest.raises(InvalidInputError):
        s.set("graph", nothing=1)
    assert ParserConfig(data_dir="x").path("odict") == "x/odict.json" and truthy(" Yes") and not truthy("on")
    with pytest.raises(NotFoundError):
        ParserConfig().path("nothing")


def test_extension_points(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "abc")], "id long, text string")
    extensions.register_embedder("size", lambda texts: texts.map(lambda t: [float(len(t))]))
    assert [r.embedding for r in extensions.embed(df, "size").orderBy("id").collect()] == [[2.0], [3.0]]
    out = extensions.process(df, lambda b: pd.DataFrame({"id": b["id"] * 2}), "id long")
    assert sorted(r.id for r in out.collect()) == [2, 4]
    done = extensions.staged(df, [lambda d: d.withColumn("a", F.length("text")), lambda d: d.withColumn("b", F.col("a") + 1)])
    assert done.orderBy("id").first().b == 3


def test_vector_dimension(spark):
    items = spark.createDataFrame([("a", [1.0, 2.0])], "id string, embedding array<double>")
    with pytest.raises(Exception):
        vectors.upsert(items, items, 3).collect()
    assert vectors.upsert(items, spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 1.0])], items.schema), 2).count() == 2


def test_contexts(spark):
    df = spark.createDataFrame([({"valence": 0.5},)], "m map<string,double>")
    same = df.select(E.apply_context(F.col("m"), E.literal({})).alias("m")).first().m
    assert same == {"valence": 0.5}
    blended = df.select(E.apply_context(F.col("m"), E.literal(DOMAIN_CONTEXTS["academic"])).alias("m")).first().m
    assert round(blended["valence"], 6) == 0.38 and round(blended["certainty"], 6) == 0.21


def test_insert_relationships(spark):
    words = spark.createDataFrame([(1, "algorithm"), (2, "recursion")], "id long, term string")
    old = spark.createDataFrame([(1, "recursion", "related_concept")], "word_id long, related_term string, relationship_type string")
    new = spark.createDataFrame([("algorithm", "recursion", "related_concept"), ("algorithm", "Recursion", "synonym"), ("algorithm", "algorithm", "synonym"), ("nothing", "x", "synonym"), ("algorithm", " ", "synonym")], "base string, related_term string, relationship_type string")
    assert [tuple(r) for r in store.insert_relationships(old, words, new).collect()] == [(1, "Recursion", "synonym")]


def test_retry_and_backoff(spark):
    rows = spark.createDataFrame([(1, "ERROR", 2), (2, "DEFERRED", 2), (3, "SUCCESS", 0), (4, "ERROR", 0)], "id int, status string, attempts int")
    assert {(r.id, r.attempts) for r in work.retry(rows).collect()} == {(2, 2), (4, 1)}
    n = spark.createDataFrame([(1,), (4,), (30,)], "n int")
    assert [r.w for r in n.select(work.backoff("emotion", F.col("n")).alias("w")).collect()] == [1.0, 8.0, 60.0]


def test_conversation_formats(spark):
    m = spark.createDataFrame([(2, 1, "assistant", "yo", 2.0), (1, 1, "user", "hi", 1.0)], "id long, conversation_id long, speaker string, text string, timestamp double")
    assert sinks.conversation_export(m, "text").first().content == "user: hi\nassistant: yo"
    assert json.loads(sinks.conversation_export(m, "json").first().content)[0] == {"speaker": "user", "text": "hi"}
    with pytest.raises(ValueError):
        sinks.conversation_export(m, "pdf")


def test_discovery_stops_at_depth(spark):
    pairs = spark.createDataFrame([("a", "B "), ("b", "c"), ("c", "d"), ("b", "a")], "word string, other string")
    start = spark.createDataFrame([("a",)], "word string")
    assert {(r.word, r.depth) for r in lexical.discovery(start, pairs, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert lexical.discovery(start, pairs, 9).count() == 4


def test_empty_tables(spark):
    nodes = spark.createDataFrame([], "id long, term string, valence double, arousal double")
    edges = spark.createDataFrame([], "u long, v long, relationship string, weight double, color string, bidirectional boolean, dimension string")
    assert graph.k_hop(edges, nodes.select("id"), 2).count() == 0
    assert graph.transitions(edges, nodes).count() == 0
    assert graph.circular_layout(nodes).count() == 0
    assert clusters.label_propagation(nodes, edges, 2).count() == 0


def test_affixes_and_styles(spark):
    got = {r.term: (r.type, r.weight) for r in spark.createDataFrame([("unhappily",)], "__t string").select(F.explode(X.affix_terms(F.col("__t"))).alias("x")).select("x.*").collect()}
    assert got["happily"] == ("derived_from", 0.7) and got["unhappi"] == ("derived_from", 0.7) and got["disunhappily"] == ("antonym", 0.6)
    s = spark.createDataFrame([("[V]: hi",), ("-- hi",)], "t string").select(X.styled(F.col("t"), "[V]: ").alias("t"))
    assert [r.t for r in s.collect()] == ["[V]: hi", "[V]: hi"]


def test_gexf_parts(spark, two_triangles, tmp_path):
    nodes, edges = two_triangles
    sinks.write_gexf_parts(nodes, edges, str(tmp_path / "g"))
    n, e = lexicons.gexf(spark, str(tmp_path / "g" / "nodes"), str(tmp_path / "g" / "edges"))
    assert n.count() == 6 and {r.attrs["dimension"] for r in e.collect()} == {"emotional"}
