"""Exact deduplication by content sort; beyond their first 32 bytes, texts are ordered by digest and not by content.

Texts are range-partitioned on (leading bytes, digest, id) with splitters that Spark samples from all rows and sorted
externally inside each partition, so equal texts are adjacent and every text is compared in full with its neighbour.  The
digest only orders texts with a common beginning, it never decides that they are equal.  The
sampled keys are short, whatever the texts.  As the id is part of the key, a group of copies of any size is cut over as
many partitions as its share of the rows asks for.  A run of
equals that touches the edge of its partition may go on in the next one; only those runs, two for each partition at
most, are joined once more by their full bytes.

Defined cases: a null text counts as empty; a null id is smaller than every other; of rows with equal text and id one is
kept; an empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut

#: Leading bytes in the sort key; longer common beginnings are told apart by the digest.
LEAD = 32

_RUNS = "id long, keep_id long, n long, sha string, chosen boolean, part int, edge int, edge_text binary"
_SCHEMA = pa.schema([("id", pa.int64()), ("keep_id", pa.int64()), ("n", pa.int64()), ("sha", pa.string()), ("chosen", pa.bool_()), ("part", pa.int32()), ("edge", pa.int32()), ("edge_text", pa.binary())])


def _runs(largest: bool):
    """Partition function: one row for each input row, with what its run of equal texts holds, and one for each edge run."""

    def close(text: bytes, ids: list, sha: str, part: int, edge: int) -> list[tuple]:
        known = [x for x in ids if x is not None]
        keep = (max if largest else min)(known) if known else None
        at = (len(ids) - 1 - ids[::-1].index(keep)) if largest else ids.index(keep)
        rows = [(x, keep, len(ids), sha, i == at, part, edge, None) for i, x in enumerate(ids)]
        if edge:
            rows.append((None, keep, len(ids), None, None, part, edge, text))
        return rows

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        text, digest, ids, first, out = None, "", [], True, []
        for batch in batches:
            for t, sha, i in zip(*(c.to_pylist() for c in batch.columns)):
                if t != text:
                    if text is not None:
                        out += close(text, ids, digest, part, 1 if first else 0)
                        first = False
                    text, digest, ids = t, sha, []
                ids.append(i)
            if len(out) > 20_000:
                yield _batch(out)
                out = []
        if text is not None:
            out += close(text, ids, digest, part, 3 if first else 2)
        if out:
            yield _batch(out)

    return of


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None, keep: str = "smallest") -> DataFrame:
    """One row for each input row: id, keep_id, group_size, kept, text_sha256.

    ``normalise``: a function from the text Column to the Column that is compared; without one, texts must be identical.
    ``keep``: whether the row with the ``smallest`` or the ``largest`` id of a group stays.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    largest = keep == "largest"
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = F.coalesce(normalise(text), F.lit("")) if normalise else text
    rows = docs.select(text.cast("binary").alias("t"), F.col(id_col).cast("long").alias("i")).withColumn("sha", F.sha2("t", 256)).withColumn("lead", F.substring("t", 1, LEAD))
    key = ["lead", "sha", "i"]
    sorted_rows = rows.repartitionByRange(*key).sortWithinPartitions("lead", "sha", "t", "i").select("t", "sha", "i")
    runs = cut(sorted_rows.mapInArrow(_runs(largest), _RUNS))
    edges = runs.where("edge_text is not null").select("part", "edge", "edge_text", "n", "keep_id")
    best = F.max if largest else F.min
    whole = edges.groupBy("edge_text").agg(F.sum("n").alias("all_n"), best("keep_id").alias("all_keep"))
    # two rows for each range partition at most, whatever the number of documents
    fix = F.broadcast(edges.join(whole, "edge_text").select("part", "edge", "all_n", "all_keep"))
    rows = runs.where("edge_text is null").join(fix, ["part", "edge"], "left")
    keep_id = F.when(F.col("all_n").isNull(), F.col("keep_id")).otherwise(F.col("all_keep"))
    return rows.select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("all_n", "n").alias("group_size"),
        (F.col("chosen") & F.col("id").eqNullSafe(keep_id)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
