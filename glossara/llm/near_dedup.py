"""Near-duplicate texts by the Jaccard similarity of their word shingles: SimHash fingerprints and MinHash bands propose,
words decide.

Texts are lower-cased and cut into ``shingle`` words; two texts link at a similarity of 4/5 or more.  Texts with equal
shingle sets are one node from the start.  A node's fingerprint is the majority of its shingles' hashes; fingerprints at two
or fewer differing bits are joined by op4's covering LSH (``simhash.links``), so of these none is missed.  Most pairs at 4/5
differ in more bits, so a node also gives BANDS keys, each of ROWS minima; nodes that share a key are joined by a star for
each key (never all pairs).  The components of all these edges, by large-star and small-star steps, are the candidates.
Inside a candidate component every pair that can reach the similarity is found by its rarest shingles (a prefix filter) and
compared by its words, unless both texts are linked already.  So no link is wrong, and one is missed only if its texts differ
in more than two bits, share no band and no chain of both joins them: (1 - 0.8 ** 6) ** 32 = 0.00006 for a pair at exactly
0.8, less above.

A task holds no more than about ``chunk`` texts, whatever the component's size (chunk_bytes bounds their length, too):

* A larger component is dealt into chunks by the hash of its nodes, and each chunk is linked by itself.
* The leaders of the chunks' groups (one for each) are linked in the same way, and again for as long as they get fewer by
  half; copies of one text end as one group here.
* What is left outside the largest group of its component is compared with all texts of the component, a block of it with a
  chunk at a time, so no link is lost.  This takes time with the product of both, little where most texts link.

Defined cases: a text with fewer words than a shingle gives one shingle of all its words; texts without words (or null)
are one node; of a component the row with the smallest id is chosen (null after all others, then by the text's digest).
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut, lookup, text_digest
from .components import components
from .simhash import links, majority

SEED, BANDS, ROWS = 42, 32, 6
#: Similarity from which texts link, as a fraction.
NUM, DEN = 4, 5

_RNG = np.random.default_rng(SEED)
_XOR, _MUL = (_RNG.integers(0, 2**64, BANDS * ROWS, np.uint64) for _ in range(2))
_MUL |= np.uint64(1)
_IN_BAND, _BAND = _RNG.integers(0, 2**64, ROWS, np.uint64) | np.uint64(1), _RNG.integers(0, 2**64, BANDS, np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingle_hashes(words: list[bytes], shingle: int = 5) -> np.ndarray:
    """Distinct hashes of the shingles, in order."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], np.uint64)
    size = min(shingle, len(words))
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        # another multiplier for each place and length
        out += h[k : k + len(out)] * np.uint64(xxhash.xxh64_intdigest(f"{size} {k}", SEED) | 1)
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for a in range(0, len(hashes), 512):
        np.minimum(least, ((hashes[a : a + 512, None] ^ _XOR) * _MUL).min(axis=0), out=least)
    keys = (least.reshape(BANDS, ROWS) * _IN_BAND).sum(axis=1, dtype=np.uint64) ^ _BAND
    return keys.view(np.int64)


def shingle_ids(words: list[bytes], known: dict[bytes, int], shingle: int = 5) -> np.ndarray:
    """Numbers of the distinct shingles; new ones are added to ``known``."""
    size = min(shingle, len(words))
    return np.array(sorted({known.setdefault(b" ".join(words[k : k + size]), len(known)) for k in range(len(words) - size + 1)}), np.int64)


def linked(sets: list[np.ndarray], some: np.ndarray | None = None) -> np.ndarray:
    """Label (an index) of each set's component of links at NUM / DEN or more.  sets: distinct whole numbers from 0.

    some: only links between a set that is marked here and one that is not are looked at.
    """
    label = np.arange(len(sets))
    if len(sets) < 2:
        return label
    df = np.bincount(np.concatenate(sets))
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))
    size = np.array([len(s) for s in sets])
    # sets that link share one of their rarest n - ceil(n * NUM / DEN) + 1 numbers
    prefix = [s[np.argsort(rank[s])[: len(s) - -(-len(s) * NUM // DEN) + 1]] for s in sets]
    holders: dict[int, list[int]] = defaultdict(list)
    for i, p in enumerate(prefix):
        for t in p.tolist():
            holders[t].append(i)
    postings = {t: np.array(x) for t, x in holders.items() if len(x) > 1}
    group = {i: [i] for i in range(len(sets))}
    mark = np.zeros(len(df), bool)
    for i, p in enumerate(prefix):
        near = [postings[t] for t in p.tolist() if t in postings]
        if not near:
            continue
        near = np.concatenate(near)
        near = near[(near < i) & (label[near] != label[i])]
        near = near if some is None else near[some[near] != some[i]]
        near = near[(size[near] * DEN >= size[i] * NUM) & (size[i] * DEN >= size[near] * NUM)]
        if not len(near):
            continue
        near, shared = np.unique(near, return_counts=True)
        near = near[np.argsort(-shared, kind="stable")]
        mark[sets[i]] = True
        for j in near.tolist():
            if label[j] != label[i] and (NUM + DEN) * int(mark[sets[j]].sum()) >= NUM * int(size[i] + size[j]):
                a, b = sorted((int(label[i]), int(label[j])))
                if len(group[a]) < len(group[b]):
                    group[a], group[b] = group[b], group[a]
                    label[group[b]], label[group[a]] = a, a
                else:
                    label[group[b]] = a
                group[a] += group.pop(b)
        mark[sets[i]] = False
    return label


def covered(nodes: DataFrame) -> DataFrame:
    """(node, centre): stars that connect the nodes (node, fp) as all pairs of fingerprints at two or fewer bits do."""
    prints = cut(nodes.groupBy("fp").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n")))
    same = nodes.join(prints.where("n > 1"), "fp").where("node != centre").select("node", "centre")
    return same.union(links(prints.select(F.col("centre").alias("node"), "fp")).select("b", "a"))


def near_kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, chunk: int = 4_000, chunk_mb: int = 8) -> DataFrame:
    """(id, digest): the id and text digest of the row that is chosen of each component."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(words_of(t.as_py()), shingle) for t in batch.column(2)]
            sets = [xxhash.xxh3_128_digest(h.tobytes()) for h in hashes]
            fp = np.array([majority(h) if len(h) else 0 for h in hashes], np.uint64).view(np.int64)
            bands = [band_keys(h) if len(h) else [] for h in hashes]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary()), pa.array(fp), pa.array(bands, pa.list_(pa.int64()))], ["id", "digest", "set", "fp", "bands"])

    keyed = docs.select(F.col(id_col).cast("long").alias("id"), text_digest(text_col).alias("digest"), F.col(text_col).cast("string").alias("text"))
    rows = cut(keyed.mapInArrow(signed, "id long, digest string, set binary, fp long, bands array<long>"))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("least")
    nodes = cut(rows.groupBy("set").agg(least, F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands")).withColumn("node", F.xxhash64("set")))
    keys = nodes.select("node", F.explode("bands").alias("key"))
    centre = keys.groupBy("key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = keys.join(centre, "key").where("node != centre").select("node", "centre")
    candidates = components(shared.union(covered(nodes)), "node", "centre")

    members = nodes.select("set", "node", F.col("least.id").alias("__id"), F.col("least.digest").alias("__digest")).join(candidates, "node")
    # texts of the candidates only; rows that repeat an id and its text are told apart where they meet
    texts = cut(keyed.join(members, F.col("__id").eqNullSafe(F.col("id")) & (F.col("__digest") == F.col("digest"))).select("component", "node", "text"))
    labels = _linked_texts(texts, shingle, chunk, chunk_mb << 20)
    named = nodes.select("node", "least").join(labels, "node", "left")
    chosen = named.groupBy(F.coalesce("group", "node").alias("group")).agg(F.min("least").alias("least"))
    return cut(chosen.select(F.col("least.id").alias(id_col), F.col("least.digest").alias("digest")))


def _chunked(texts: DataFrame, chunk: int, chunk_bytes: int) -> DataFrame:
    """texts with chunks (how many its component is dealt into) and part (its chunk)."""
    sizes = texts.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    sizes = sizes.select("component", F.greatest(F.lit(1), F.ceil(F.col("n") / chunk), F.ceil(F.col("bytes") / chunk_bytes)).cast("int").alias("chunks"))
    return lookup(texts, sizes, "component").withColumn("part", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))


def _linked_texts(texts: DataFrame, shingle: int, chunk: int, chunk_bytes: int) -> DataFrame:
    """(node, group) for texts (component, node, text): components of the links, each named by one of its nodes."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, bodies, _ in _parts(batches):
            known: dict[bytes, int] = {}
            label = linked([shingle_ids(words_of(t), known, shingle) for t in bodies])
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([nodes[k] for k in label.tolist()], pa.int64())], ["node", "leader"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of a block (flag true) against those of a chunk; only links between the two are wanted."""
        for nodes, bodies, flags in _parts(batches):
            known: dict[bytes, int] = {}
            label = linked([shingle_ids(words_of(t), known, shingle) for t in bodies], np.array(flags, bool))
            own = [(n, nodes[k]) for n, k in zip(nodes, label.tolist()) if n != nodes[k]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*own) if own else ([], []))], ["node", "leader"])

    def run(rows: DataFrame, function, *by: str) -> DataFrame:
        dealt = rows.repartition(*by).sortWithinPartitions(*by, "node")
        return dealt.select(F.struct(*by).cast("string").alias("by"), "node", "text", "flag").mapInArrow(function, "node long, leader long")

    level = _chunked(texts, chunk, chunk_bytes)
    local = cut(run(level.withColumn("flag", F.lit(False)), within, "component", "part"))
    links, large = [local], cut(level.where("chunks > 1").select("component", "node", "text"))
    left = large.count()
    if not left:
        return local.select("node", F.col("leader").alias("group"))
    # a component of many chunks: its rows may repeat, its groups are counted by distinct nodes
    rows = large
    while True:
        rows = cut(rows.join(links[-1].where("node = leader").select("node"), "node").select("component", "node", "text"))
        before, left = left, rows.count()
        links.append(cut(run(_chunked(rows, chunk, chunk_bytes).withColumn("flag", F.lit(False)), within, "component", "part")))
        if 2 * left > before or left <= 1:
            break

    def grouped() -> DataFrame:
        edges = functools.reduce(DataFrame.union, links).where("node != leader")
        found = components(edges, "node", "leader")
        return texts.select("component", "node").distinct().join(found.withColumnRenamed("component", "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))

    # what is outside the largest group of its component
    own = grouped().join(large.select("node"), "node", "left_semi")
    sizes = own.groupBy("component", "group").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("component").agg(F.max_by("group", F.struct("n", "group")).alias("largest"))
    rest = cut(large.join(own.join(largest, "component").where("group != largest").select("node"), "node"))
    if rest.limit(1).count():
        blocks, chunks = _chunked(rest, chunk, chunk_bytes), _chunked(large, chunk, chunk_bytes)
        counts = blocks.groupBy("component").agg(F.max("chunks").alias("blocks"))
        every = chunks.join(counts, "component").select("component", "node", "text", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("flag"))
        dealt = chunks.groupBy("component").agg(F.max("chunks").alias("of"))
        some = blocks.join(dealt, "component").select("component", "node", "text", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("part"), F.col("part").alias("block"), F.lit(True).alias("flag"))
        links.append(cut(run(every.union(some), across, "component", "part", "block")))
    return grouped().select("node", "group")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    """Runs of rows with one key (by, node, text, flag), which stand together."""
    key, nodes, bodies, flags = None, [], [], []
    for batch in batches:
        for k, n, t, f in zip(*(x.to_pylist() for x in batch.columns)):
            if k != key:
                if nodes:
                    yield nodes, bodies, flags
                key, nodes, bodies, flags = k, [], [], []
            if nodes and nodes[-1] == n and flags[-1] == f:  # rows that repeat an id and its text
                continue
            nodes.append(n)
            bodies.append(t)
            flags.append(f)
    if nodes:
        yield nodes, bodies, flags
