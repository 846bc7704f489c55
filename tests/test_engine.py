"""Small fixtures with results worked out by hand."""

import json
import math

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from glossara.catalog import relationship_types
from glossara.functions import emotion as E, text as X
from glossara.operators import classify, graph, lexical, store, vectors, work
from glossara.sources import lexicons, sinks

NODES = [(1, "algorithm"), (11, "algorithmic rule"), (12, "algorithmic program"), (509, "operation"), (521, "process"), (730, "procedure"), (853, "recursion"), (859, "function")]
RELS = [(1, 1, "algorithmic rule", "synonym"), (2, 1, "algorithmic program", "synonym"), (3, 1, "Procedure", "synonym"), (4, 1, "recursion", "related_concept"), (5, 521, "operation", "synonym"), (6, 730, "process", "synonym"), (7, 730, "operation", "synonym"), (8, 859, "procedure", "synonym"), (9, 1, "missing", "synonym"), (10, 1, "algorithm", "synonym")]


@pytest.fixture(scope="module")
def golden(spark):
    nodes = spark.createDataFrame(NODES, "id long, term string")
    rels = spark.createDataFrame(RELS, "id long, word_id long, related_term string, relationship_type string")
    return nodes, graph.collapse(graph.decorate(graph.resolve(rels, nodes), relationship_types(spark)))


def test_golden_graph(golden):
    nodes, edges = golden
    assert edges.count() == 8
    got = {(r.u, r.v): (r.relationship, r.weight, r.bidirectional) for r in edges.collect()}
    assert got[(1, 853)] == ("related_concept", 0.3, True) and got[(730, 859)] == ("synonym", 1.0, True)
    titles = {(r.u, r.v): r.title for r in graph.title(edges, nodes).collect()}
    assert titles[(730, 859)] == "synonym: function ↔ procedure"


def test_ego_graph(spark, golden):
    nodes, edges = golden
    start = spark.createDataFrame([(1,)], "id long")
    assert {r.id for r in graph.k_hop(edges, start, 1).collect()} == {1, 11, 12, 730, 853}
    assert {r.id for r in graph.k_hop(edges, start, 0).collect()} == {1}
    assert graph.induced(edges, graph.k_hop(edges, start, 2)).count() == 8
    with pytest.raises(ValueError):
        graph.k_hop(edges, start, -1)


def test_last_and_first_win(spark):
    nodes = spark.createDataFrame([(1, "a"), (2, "b")], "id long, term string")
    rels = spark.createDataFrame([(1, 1, "b", "synonym"), (2, 2, "A", "antonym")], "id long, word_id long, related_term string, relationship_type string")
    rows = graph.decorate(graph.resolve(rels, nodes), relationship_types(spark))
    assert graph.collapse(rows).first().relationship == "antonym"
    assert graph.collapse(rows, first=True).first().relationship == "synonym"
    assert graph.update(graph.collapse(rows), rows).count() == 0


def test_gexf_round_trip(spark, golden, tmp_path):
    nodes, edges = golden
    path = str(tmp_path / "g.gexf")
    assert sinks.write_gexf(nodes, edges, path)
    n, e = lexicons.gexf(spark, path)
    assert {(int(r.id), r.term) for r in n.collect()} == set(NODES)
    assert {(int(r.u), int(r.v), r.attrs["relationship"]) for r in e.collect()} == {(r.u, r.v, r.relationship) for r in edges.collect()}
    assert not sinks.write_gexf(nodes.where("false"), edges, str(tmp_path / "empty"))


MESSAGES = ["I'm so happy today! Everything is going GREAT!", "I feel sad and disappointed about the results.", "This product is amazing and exceeds expectations.", "I'm furious about the terrible customer service.", "Just received the package, it looks fine.", "unhappy", "made", "download"]


def test_keyword_counts(spark):
    df = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(MESSAGES)], "id int, text string, valence double")
    got = [r.asDict() for r in df.select("id", *[c.alias(k) for k, c in classify.keyword_counts(F.col("text")).items()]).orderBy("id").collect()]
    hits = [{k: v for k, v in r.items() if k != "id" and v} for r in got]
    assert hits[:5] == [{"happiness": 1}, {"sadness": 1}, {}, {"anger": 1}, {"neutral": 1}] and hits[6:] == [{"anger": 1}, {"sadness": 1}]
    assert set(hits[5]) == {"happiness", "sadness"}  # keywords count inside other words
    labels = [r.label for r in classify.classify(df).orderBy("id").collect()]
    assert labels[:5] == ["happiness", "sadness", "neutral", "anger", "neutral"]


def test_queue(spark):
    rows = [(0, "normal item 1", "NORMAL"), (1, "low item", "LOW"), (2, "high item", "HIGH"), (3, " Normal Item 1 ", "NORMAL"), (4, "normal item 2", "NORMAL")]
    marked = work.enqueue(spark.createDataFrame(rows, "seq long, item string, priority string"))
    counts = work.counts(marked).first()
    assert (counts.enqueued, counts.rejected) == (4, 1)
    assert [r.item for r in work.dequeue(marked.where("accepted"), 10).collect()] == ["high item", "normal item 1", "normal item 2", "low item"]
    with pytest.raises(ValueError):
        work.dequeue(marked, 0)


def test_upsert(spark):
    cols = "id long, term string, definition string, part_of_speech string, usage_examples string, last_refreshed double"
    words = spark.createDataFrame([(1, "a", "old", "n", "", 1.0), (2, "b", "keep", "n", "", 1.0)], cols)
    new = spark.createDataFrame([("a", "new", "v", "", 2.0), ("c", "more", "n", "", 2.0), ("c", "most", "n", "", 3.0)], cols.replace("id long, ", ""))
    got = {(r.id, r.term, r.definition) for r in store.upsert_words(words, new).collect()}
    assert got == {(1, "a", "new"), (2, "b", "keep"), (3, "c", "most")}
    with pytest.raises(ValueError):
        store.upsert_words(words, new.withColumn("term", F.lit(" ")))


def test_sources(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"tree": {"definition": "a plant", "examples": ["an oak"]}, "bare": {"definition": "x"}}))
    words = spark.createDataFrame([("tree",), ("bare",), ("none",)], "word string")
    got = {r.word: (r.definition, r.examples) for r in lexical.dictionary(words, lexicons.dictionary_json(spark, str(tmp_path / "d.json"))).collect()}
    assert got == {"tree": ("a plant", ["an oak"]), "bare": ("Not Found", []), "none": ("Not Found", [])}
    (tmp_path / "t.jsonl").write_text('{"words": ["tree", "oak", "tree"]}\n\n{"words": ["ash", "tree", "oak"]}\n')
    lines = lexicons.numbered_lines(spark, str(tmp_path / "t.jsonl"), "words array<string>")
    assert [r.synonym for r in lexical.openthesaurus(words, lines).orderBy("place").collect()] == ["oak", "ash"]
    (tmp_path / "b.jsonl").write_text('{"word": "a", "synonyms": ["b"]}\nnot json\n')
    assert lexicons.jsonl(spark, str(tmp_path / "b.jsonl"), "word string, synonyms array<string>", tolerant=True).count() == 1
    with pytest.raises(Exception):
        lexicons.jsonl(spark, str(tmp_path / "b.jsonl"), "word string, synonyms array<string>").collect()
    (tmp_path / "x.nt").write_text('# c\n<e1> <http://l/canonicalForm> <f1> .\n<f1> <http://l/writtenRep> "tree"@en .\n<e1> <http://l/definition> "a \\"tall\\" plant"@en .\n<e1> <http://l/translation> "arbre"@fr .\n<e1> <http://l/translation> "Baum"@de .\n')
    got = {(r.definition, r.translation) for r in lexical.dbnary(words, lexicons.n_triples(spark, str(tmp_path / "x.nt"))).collect()}
    assert {t for _, t in got} == {"arbre", "Baum"} and len(got) == 2
    (tmp_path / "w.txt").write_text("one\n\n two \n")
    assert [r.word for r in lexicons.word_list(spark, str(tmp_path / "w.txt")).collect()] == ["one", "two"]


def test_vectors(spark):
    words = spark.createDataFrame([(1, "recursion", "calls itself", "one; two"), (2, "x", None, None)], "id long, term string, definition string, usage_examples string")
    assert {r.id for r in vectors.items(words).collect()} == {"w_1", "d_1", "e_1_0", "e_1_1", "w_2"}
    table = spark.createDataFrame([(k, [math.cos(k), math.sin(k)]) for k in range(5)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in vectors.search(table, [1.0, 0.0], 2).collect()] == [0, 1]
    with pytest.raises(ValueError):
        vectors.distance(F.col("a"), F.col("b"), "chebyshev")


def test_streaming(spark, tmp_path):
    from glossara.streaming import work_stream

    src = str(tmp_path / "in")
    rows = [(0, " A ", "LOW", "2024-01-01 00:00:00"), (1, "a", "HIGH", "2024-01-01 00:01:00"), (2, "b", "HIGH", "2024-01-01 00:02:00")]
    spark.createDataFrame(rows, "seq long, item string, priority string, t string").select("seq", "item", "priority", F.to_timestamp("t").alias("ts")).coalesce(1).write.parquet(src)
    got = []
    stream = work_stream.deduplicated(spark.readStream.schema("seq long, item string, priority string, ts timestamp").parquet(src))
    work_stream.drain(stream, lambda df, epoch: got.extend(r.key for r in df.collect()), str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(got) == ["a", "b"]


def test_text_functions(spark):
    df = spark.createDataFrame([("Read the quick RED fox_trot, café ab abc1",)], "t string")
    assert df.select(X.regex_terms(F.col("t"))).first()[0] == ["read", "the", "quick", "red"]
    assert [r[0] for r in spark.createDataFrame([(3723.0,), (-5.0,)], "s double").select(X.clock(F.col("s"))).collect()] == ["1:02:03", "0:00:00"]


vectors_ = st.dictionaries(st.sampled_from(["valence", "arousal", "dominance", "social"]), st.floats(-1, 1), max_size=4)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=vectors_, b=vectors_)
def test_algebra(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a map<string,double>, b map<string,double>")
    x, y = F.col("a"), F.col("b")
    r = df.select(E.distance(x, y).alias("d"), E.distance(y, x).alias("e"), E.resonance(x, y).alias("r"), E.entropy(x).alias("h"), E.blend(x, y, 0.0).alias("z"), E.scale(x, 9.0).alias("s")).first()
    assert math.isclose(r.d, r.e, abs_tol=1e-12)
    assert -1e-9 <= r.r <= 1 + 1e-9 and -1e-9 <= r.h <= 1 + 1e-9
    assert all(math.isclose(r.z[k], v, abs_tol=1e-12) for k, v in a.items())
    assert all(-1 <= v <= 1 for v in r.s.values())
