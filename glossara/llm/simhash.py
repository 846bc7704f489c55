"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints (64 bits) link at ``radius`` or fewer differing bits.  Every bit i has a vector m(i) in {1..2^(radius+1)-1};
table t, for t in 1..2^(radius+1)-1, keeps the bits where the inner product <m(i), t> mod 2 is 1.  For any ``radius``
positions some t is orthogonal to all their vectors, so two fingerprints that differ in those positions only have the
same kept bits in that table (Pagh, "CoveringLSH", 2016): no link is missed, whatever the data.

Equal fingerprints are one row from the start, each with its smallest id.  A bucket of a table is a stream of distinct
fingerprints in order.  For radius 2, members of a bucket are linked through keys: each gives itself and its one-bit
neighbours within the bits the table leaves open; two members share a key exactly if they differ in two bits or fewer.
A bucket of n members costs n times the open bits and never n squared; buckets over ``bucket_rows`` hand their keys to a
grouping over all machines instead of one task.  A star for each key is written, not all its pairs; components of the
stars equal those of all links.

Defined cases: a text with fewer words than a shingle gives one shingle of all its words; one without words (or null)
has fingerprint zero and links like any other; rows with null ids get a fingerprint but no component of their own unless
others share it (the smallest known id; null if there is none); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut
from .components import components

SEED, BITS = 42, 64


def fingerprint(text: str | None, shingle: int = 3) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.r_[0, ends[:-1] + 1]
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    return majority(np.array(hashes, "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are 1 in over half of the hashes."""
    # votes in slices, so that a very long text needs little memory
    votes = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def masks(radius: int) -> list[int]:
    """Kept bits of each table, as unsigned integers."""
    n = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(BITS) if ((i % n + 1) & t).bit_count() % 2) for t in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(of, "id long, fp long")


def links(nodes: DataFrame, radius: int = 2, bucket_rows: int = 200_000) -> DataFrame:
    """(a, b): stars that connect the same distinct fingerprints as all links do.  nodes: (node, fp), one for each fp."""
    if radius != 2:
        raise ValueError("one-bit keys link at radius 2")
    tables = masks(radius)
    open_bits = [np.array([np.uint64(1 << i) for i in range(BITS) if not m >> i & 1]) for m in tables]
    rows = nodes.select(F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("kept"), "fp", "node") for k, m in enumerate(tables)])).alias("x")).select("x.*")

    def keys(t: int, fp: np.ndarray) -> np.ndarray:
        return np.concatenate([fp[None, :], fp[None, :] ^ open_bits[t][:, None]]).T

    def stars(t: int, fp: np.ndarray, node: np.ndarray):
        """Edges of a whole bucket."""
        flat = keys(t, fp).reshape(-1)
        own = np.repeat(node, len(flat) // len(fp))
        order = np.lexsort((own, flat))
        flat, own = flat[order], own[order]
        head = np.r_[True, flat[1:] != flat[:-1]]
        centre = own[head][np.cumsum(head) - 1]
        far = centre != own
        return np.unique(np.column_stack([centre[far], own[far]]), axis=0)

    out_schema = pa.schema([("t", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])

    def edges_of(found: list[np.ndarray]) -> pa.RecordBatch:
        e = np.concatenate(found)
        return pa.RecordBatch.from_arrays([pa.nulls(len(e), pa.int32()), pa.array(e[:, 0]), pa.array(e[:, 1]), pa.nulls(len(e), pa.int64())], schema=out_schema)

    def spilled(t: int, fp: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(fp), 20_000):
            flat = keys(t, fp[a : a + 20_000])
            own = np.repeat(node[a : a + 20_000], flat.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), t, np.int32)), pa.array(own), pa.nulls(len(own), pa.int64()), pa.array(flat.reshape(-1).view(np.int64))], schema=out_schema)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        bucket, count, over, found, n_found = None, 0, False, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            t, kept, fp, node = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            fp = fp.view(np.uint64)
            cuts = np.flatnonzero((t[1:] != t[:-1]) | (kept[1:] != kept[:-1])) + 1
            edge = [0, *cuts.tolist(), len(t)]
            for a, b in zip(edge, edge[1:]):
                if (t[a], kept[a]) != bucket:
                    if count > 1 and not over:
                        found.append(stars(int(bucket[0]), *(np.concatenate(x) for x in zip(*held))))
                        n_found += len(found[-1])
                    if n_found > 100_000:
                        yield edges_of(found)
                        found, n_found = [], 0
                    bucket, count, over, held = (t[a], kept[a]), 0, False, []
                count += b - a
                held.append((fp[a:b], node[a:b]))
                if over or count > bucket_rows:
                    over = True
                    for x in held:
                        yield from spilled(int(bucket[0]), *x)
                    held = []
        if count > 1 and not over:
            found.append(stars(int(bucket[0]), *(np.concatenate(x) for x in zip(*held))))
        if found:
            yield edges_of(found)

    made = cut(rows.repartition("t", "kept").sortWithinPartitions("t", "kept", "fp").mapInArrow(of, "t int, a long, b long, key long"))
    direct = made.where("t is null").select("a", "b")
    keyed = made.where("t is not null")
    centre = keyed.groupBy("t", "key").agg(F.min("a").alias("c"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return direct.union(keyed.join(centre, ["t", "key"]).where("a != c").select(F.col("c").alias("a"), F.col("a").alias("b")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row for each input row: id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    nodes = rows.groupBy("fp").agg(F.min("id").alias("node"))
    parts = components(links(nodes.where("node is not null"), radius), "a", "b")
    named = nodes.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return rows.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
