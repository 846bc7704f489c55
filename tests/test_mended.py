"""Numbering, vector upserts, readers' errors, Turtle, paths and distributed communities."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from glossara import extensions
from glossara.errors import InvalidInputError
from glossara.operators import clusters, graph, numbering, store, vectors
from glossara.operators.numbering import numbered
from glossara.plans import registry
from glossara.sources import lexicons, sinks
from glossara.sources.turtle import triples

registry.load()


def test_numbers_follow_the_order(spark):
    """Terms with one beginning, and ids that cluster: ranges are cut by what is there."""
    terms = [f"000000{k}" for k in range(3000)]
    random.Random(1).shuffle(terms)
    rows = spark.createDataFrame([(t,) for t in terms], "term string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.term: r.place for r in numbered(rows, "term").collect()}
        dealt = rows.repartitionByRange("term").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {t: k for k, t in enumerate(sorted(terms))}
    assert len(dealt) > 1 and max(r["count"] for r in dealt) < 0.6 * len(terms)


def test_new_terms_follow_the_largest_id(spark):
    words = spark.createDataFrame([(7, "Alpha"), (3, "beta")], "id long, term string")
    new = spark.createDataFrame([("beta",), ("gamma",), ("delta",), ("gamma",), ("alpha",)], "term string")
    assert sorted((r.id, r.term) for r in store.add_terms(words, new).collect()) == [(8, "delta"), (9, "gamma")]
    assert [(r.id, r.term) for r in store.add_terms(words.where("false"), new.where("term = 'beta'")).collect()] == [(1, "beta")]


VECTORS = "id string, original_id long, embedding array<double>"


def test_delete_keeps_rows_without_an_original_id(spark):
    rows = spark.createDataFrame([("a", 1, [1.0]), ("b", None, [2.0]), ("c", 2, [3.0])], VECTORS)
    assert sorted(r.id for r in vectors.delete(rows, 1).collect()) == ["b", "c"]


def test_upsert_keeps_one_row_for_each_id(spark):
    old = spark.createDataFrame([("a", 1, [1.0]), ("b", 2, [2.0])], VECTORS)
    new = spark.createDataFrame([("a", 1, [5.0], 1), ("a", 1, [4.0], 2), ("c", 3, [6.0], 1)], f"{VECTORS}, at int")
    got = sorted((r.id, r.embedding[0]) for r in vectors.upsert(old, new, 1, order="at").collect())
    assert got == [("a", 4.0), ("b", 2.0), ("c", 6.0)]
    assert sorted(r.embedding[0] for r in vectors.upsert(old, new.drop("at"), 1).collect()) == [2.0, 5.0, 6.0]
    with pytest.raises(Exception, match="dimension is not 2"):
        vectors.upsert(old, new, 2).collect()


def test_bad_json_names_file_and_line(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n{"a": oops}\n' + '{"a": 3}\n' * 50 + "nothing\n")
    (tmp_path / "y.jsonl").write_text('{"a": 4}\n')
    assert sorted((r.file.rsplit("/", 1)[1], r.line) for r in lexicons.bad_lines(spark, str(tmp_path), "a long").collect()) == [("x.jsonl", 4), ("x.jsonl", 55)]
    with pytest.raises(InvalidInputError, match="x.jsonl, line 4"):
        lexicons.checked_jsonl(spark, str(tmp_path), "a long")
    assert lexicons.checked_jsonl(spark, str(tmp_path / "y.jsonl"), "a long").collect()[0].a == 4


def test_bad_triples_are_an_error(spark, tmp_path):
    (tmp_path / "t.nt").write_text('<a:b> <a:c> "x"@en .\n# note\n\n<a:b> <a:c> .\n')
    with pytest.raises(Exception, match="no N-Triples line"):
        lexicons.n_triples(spark, str(tmp_path)).collect()
    assert [(r.o, r.lang) for r in lexicons.n_triples(spark, str(tmp_path), tolerant=True).collect()] == [("x", "en")]


TURTLE = '''@prefix ex: <http://e.org/> . PREFIX o: <http://o.org#>
@base <http://b.org/x> .
# a note
ex:dog a o:Word ; o:label "dog"@en , 'chien'@fr ; o:n 3, -1.5e3 , true ;.
<rel> o:def """long "quoted" text
line \\u00e9"""^^o:string . _:b1 o:list ( ex:a "x" ) .
[ o:p [ o:q ex:z.y ] ] o:r ex:e\\,f .
[ o:only 1 ] .
ex:end o:p ex:q.'''


def test_turtle(spark, tmp_path):
    rdf = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    got = list(triples(TURTLE, "k."))
    assert [(s.rsplit("/", 1)[-1], p.rsplit("#", 1)[-1], o, lang) for s, p, o, lang in got[:7]] == [
        ("dog", "type", "http://o.org#Word", None), ("dog", "label", "dog", "en"), ("dog", "label", "chien", "fr"), ("dog", "n", "3", None), ("dog", "n", "-1.5e3", None), ("dog", "n", "true", None), ("rel", "def", 'long "quoted" text\nline é', None)]
    nodes = {s for s, p, *_ in got if p in (f"{rdf}first", f"{rdf}rest")}
    assert len(nodes) == 2 and all(n.startswith("_:k.") for n in nodes) and ("_:k.b1", "http://o.org#list") in {(s, p) for s, p, *_ in got}
    assert (got[-1][0], got[-1][2]) == ("http://e.org/end", "http://e.org/q") and len(got) == 17
    (tmp_path / "a.ttl").write_text(TURTLE)
    (tmp_path / "b.ttl").write_text("<a:a> <a:b> <a:c> .")
    assert lexicons.turtle(spark, str(tmp_path)).count() == 18
    (tmp_path / "c.ttl").write_text("<a:a> <a:b> <a:c> .\n<a:a> <a:b> ex:c .")
    with pytest.raises(Exception, match="c.ttl: line 2: unknown prefix 'ex'"):
        lexicons.turtle(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("bad", ['<a:a> <a:b> "x .', "<a:a> <a:b> <a:c>", "<a:a> <a:b> ( 1 ", '"x" <a:b> <a:c> .', "<a:a> <a:b> .", "@prefix <a> ."])
def test_broken_turtle(bad):
    with pytest.raises(ValueError):
        list(triples(bad))


def small_graph(spark, weight):
    rng = random.Random(3)
    pairs = sorted({tuple(sorted(rng.sample(range(12), 2))) for _ in range(22)})
    rows = [(u, v, weight(rng), rng.choice(["evokes", "related"]), "emotional") for u, v in pairs]
    nodes = [(k, f"n{k}", rng.random(), rng.random()) for k in range(12)]
    return rows, spark.createDataFrame(rows, "u long, v long, weight double, relationship string, dimension string"), spark.createDataFrame(nodes, "id long, term string, valence double, arousal double")


def simple_paths(rows, edges_most, least, prune):
    near = defaultdict(list)
    for u, v, w, *_ in rows:
        near[u].append((v, w))
        near[v].append((u, w))
    out, level = [], [((a, b), w) for a in near for b, w in near[a]]
    for k in range(edges_most):
        level = [(p, s) for p, s in level if not prune or s >= least]
        out += [(p, round(s, 9)) for p, s in level if s >= least]
        level = [((*p, b), s * w) for p, s in level for b, w in near[p[-1]] if b not in p]
    return sorted(out)


@pytest.mark.parametrize("most", [3, 4, 5])
def test_legacy_transitions(spark, most):
    rows, edges, nodes = small_graph(spark, lambda rng: rng.choice([0.2, 0.5, 0.9, 1.0]))
    got = sorted((tuple(r.path), round(r.strength, 9)) for r in graph.transitions_legacy(edges, nodes, most, 0.3).collect())
    assert got == simple_paths(rows, most - 2, 0.3, True)


def test_transitions_with_weights_above_one(spark):
    rows, edges, nodes = small_graph(spark, lambda rng: rng.choice([0.2, 0.5, 2.0, 3.0]))
    got = sorted((tuple(r.path), round(r.strength, 9)) for r in graph.transitions(edges, nodes, 3, 0.6).collect())
    assert got == simple_paths(rows, 3, 0.6, False) and got != simple_paths(rows, 3, 0.6, True)


def modularity(edges, label):
    degree, inside, total = defaultdict(float), defaultdict(float), sum(w for *_, w in edges)
    for u, v, w in edges:
        degree[label[u]] += w
        degree[label[v]] += w
        inside[label[u]] += w * (label[u] == label[v])
    return sum(inside[c] / total - (k / 2 / total) ** 2 for c, k in degree.items())


def test_communities_come_close_to_louvain(spark):
    rng = random.Random(1)
    pairs = {tuple(sorted(rng.sample(range(g * 20, g * 20 + 20), 2))) for g in range(5) for _ in range(60)} | {tuple(sorted(rng.sample(range(100), 2))) for _ in range(20)}
    rows = [(u, v, 1.0) for u, v in sorted(pairs)]
    edges = spark.createDataFrame(rows, "u long, v long, weight double")
    label = {r.id: r.community for r in clusters.communities(edges).collect()}
    assert set(label) == {x for p in pairs for x in p} and all(label[c] == c for c in set(label.values()))
    assert modularity(rows, label) > 0.9 * modularity(rows, clusters.louvain(edges))


def test_as_completed_and_formats(spark, tmp_path):
    found = dict(extensions.as_completed({"one": lambda: 1, "bad": lambda: 1 / 0}))
    assert found["one"] == 1 and isinstance(found["bad"], ZeroDivisionError)
    times = {}
    with pytest.raises(KeyError), extensions.measured(times, "x"):
        raise KeyError
    assert times["x"] >= 0
    with pytest.raises(InvalidInputError, match="graphml"):
        sinks.write_graph(spark.range(1), spark.range(1), str(tmp_path), "graphml")


def test_start_conversations_in_order_of_users(spark):
    """Users of any sign and length, null last."""
    users = [5, 3, None, -7, -20, 10**14, 3]
    queue = spark.createDataFrame([(u,) for u in users], "user_id long").repartition(3)
    messages = spark.createDataFrame([(k % 9 + 1,) for k in range(50)], "conversation_id long")
    started = store.start_conversations(messages, queue)
    assert sorted((r.id, r.user_id) for r in started.collect()) == list(enumerate([-20, -7, 3, 5, 10**14, None], 10))
    assert all(r.id is None for r in store.start_conversations(messages.where("false"), queue).collect())


def test_start_conversations_plan(spark, monkeypatch):
    """What is numbered is the users alone: messages give one row."""
    plans = []
    monkeypatch.setattr(numbering, "fixed", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df.checkpoint())
    registry.QUERIES["k05_start_conversations"](spark, "/root/testdata/sf0.001").collect()
    assert plans and all("NestedLoop" not in p and "Cartesian" not in p and "conv_id" not in p for p in plans)
