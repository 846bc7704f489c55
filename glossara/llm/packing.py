"""Variable-capacity best-fit packing: several permitted sequence lengths are optimised jointly, and sequences of token ids written.

Documents are encoded with a tokenizer and end with ``end_id``; one longer than the longest length gives full sequences of
that length and a remainder.  The pieces of ``block_tokens`` tokens of consecutive documents are packed together: longest
first, each piece goes to the open sequence with the least room that still fits it; where none fits, the length of least
cost for each token that it can still be given is opened (the piece and the shorter pieces after it).  The same is tried
with each length as the only one to open, the cheapest of these plans is taken, and in the end each sequence is cut down to
the shortest permitted length that holds its contents.

Blocks are filled and packed where the documents are read: nothing is shuffled or gathered, no key can be hot, and a task
holds one block.  So what is packed together follows from the order of the rows and their partitions, and a run over the
same files gives the same sequences.

Cost of a sequence: length * (1 + length / 32768), a linear share and one that grows with the square, as attention does.

Defined cases: a null text is empty, and its document the end id alone; null and repeated ids keep their rows; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .token_planes import encoder


def cost(length: int) -> float:
    return length * (1 + length / 32768)


def best_fit(sizes: list[int], lengths: list[int], opens: list[int], price=cost) -> tuple[list[int], list[int]]:
    """(sequence of each piece, length of each sequence) for sizes in descending order, opening only ``opens``."""
    left = sum(sizes)
    room: list[tuple[int, int]] = []  # (room, sequence), ordered
    used: list[int] = []
    where = []
    for s in sizes:
        k = bisect.bisect_left(room, (s, -1))
        if k < len(room):
            free, seq = room.pop(k)
        else:
            fits = [x for x in opens if x >= s] or [min(x for x in lengths if x >= s)]
            free = min(fits, key=lambda x: (price(x) / min(x, left), x))
            seq = len(used)
            used.append(0)
        used[seq] += s
        if free > s:
            bisect.insort(room, (free - s, seq))
        where.append(seq)
        left -= s
    return where, [min(x for x in lengths if x >= u) for u in used]


def joint_best_fit(sizes: list[int], lengths: list[int], price=cost) -> tuple[list[int], list[int]]:
    plans = [best_fit(sizes, lengths, opens, price) for opens in [lengths, *[[x] for x in lengths]]]
    return min(plans, key=lambda p: sum(map(price, p[1])))


_SCHEMA = pa.schema([("sequence", pa.int64()), ("seq_length", pa.int32()), ("seq_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("positions", pa.list_(pa.int32())), ("n_tokens", pa.list_(pa.int32())), ("ids", pa.list_(pa.int32()))])
SCHEMA = "sequence long, seq_length int, seq_tokens int, doc_ids array<long>, starts array<long>, positions array<int>, n_tokens array<int>, ids array<int>"


def pack(docs: DataFrame, tokenizer: str, lengths: tuple[int, ...] = (512, 1024, 2048, 4096), id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, block_tokens: int = 1 << 20) -> DataFrame:
    """One row for each sequence: sequence (number), seq_length (permitted length), seq_tokens (ids in it), ids, and of each piece in
    order doc_ids, starts (its first token in the document), positions (in the sequence) and n_tokens."""
    sizes_ = sorted(set(lengths))
    longest = sizes_[-1]

    def packed(pieces: list[tuple], first: int) -> pa.RecordBatch:
        pieces.sort(key=lambda p: -len(p[2]))
        where, length = joint_best_fit([len(p[2]) // 4 for p in pieces], sizes_)
        members: list[list[tuple]] = [[] for _ in length]
        for piece, seq in zip(pieces, where):
            members[seq].append(piece)
        ids = [np.frombuffer(b"".join(p[2] for p in m), "<i4") for m in members]
        columns = [
            range(first, first + len(length)), length, [len(x) for x in ids], [[p[0] for p in m] for m in members], [[p[1] for p in m] for m in members],
            [list(accumulate((len(p[2]) // 4 for p in m[:-1]), initial=0)) for m in members], [[len(p[2]) // 4 for p in m] for m in members],
        ]
        arrays = [pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)]
        offsets = pa.array(np.r_[0, np.cumsum([len(x) for x in ids])], pa.int32())
        arrays.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids), pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, schema=_SCHEMA)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        made, held, pieces = TaskContext.get().partitionId() << 32, 0, []
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a in range(0, len(texts), 64):
                for name, ids in zip(names[a : a + 64], enc.encode([t or "" for t in texts[a : a + 64]])):
                    ids += end
                    for at in range(0, len(ids), 4 * longest):
                        pieces.append((name, at // 4, ids[at : at + 4 * longest]))
                        held += len(pieces[-1][2]) // 4
                        if held >= block_tokens:
                            out = packed(pieces, made)
                            made, held, pieces = made + out.num_rows, 0, []
                            yield out
        if pieces:
            yield packed(pieces, made)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(write, SCHEMA)


def pieces_of(sequences: DataFrame) -> DataFrame:
    """One row for each piece, read back from the sequences: doc_id, start, n_tokens, sequence, position, seq_length, seq_tokens, ids."""
    rows = sequences.select("sequence", "seq_length", "seq_tokens", "ids", F.explode(F.arrays_zip("doc_ids", "starts", "positions", "n_tokens")).alias("p"))
    return rows.select(
        F.col("p.doc_ids").alias("doc_id"), F.col("p.starts").alias("start"), F.col("p.n_tokens").alias("n_tokens"),
        "sequence", F.col("p.positions").alias("position"), "seq_length", "seq_tokens", F.slice("ids", F.col("p.positions") + 1, F.col("p.n_tokens")).alias("ids"))
