"""Substring deduplication by level-wise doubling.

A window of ``window`` words is repeated only if each shorter window in it is.  Lengths start at ``first`` (half the window,
rounded up, unless given) and double up to ``window``; a level looks only at what was repeated at the level before, and
the levels end where no candidate survives or the window's length is reached: longer repeats cover no other words.

A level of length L:

* Each surviving full window is represented by the smallest hash among its L-word windows (a minimizer; at the last level
  the window itself).  Equal windows have equal representatives, so a representative that stands in one document alone
  drops all its windows, and nothing that is repeated is lost.
* The hash of L words is made from the two hashes of the level before that cover them (overlapping where the last level is
  not twice the one before).
* Levels before the last send 32 bits of each distinct representative of a block, as they only filter.  The last level
  decides on 128 bits, two hashes of independent seeds, with the smallest document id: among n distinct candidate
  windows two would be taken for one with a probability below n * n / 2 ** 129 (10 ** -15 for n = 10 ** 12).

Texts are dealt once, by the hash of their id and text, to blocks of about ``block_mb``; all levels and the result use that
one exchange.  A block sends each distinct hash once, so a passage that is in a third of all documents is at most one entry
for each block, and gets back one bit for each entry it sent.  All hashing and sorting is done on arrays.

Defined cases: a null text has no words; a null id counts as larger than every other id; rows that share an id (or
have none) are one document for the comparison, so they do not remove each other's words; rows that share id and text go
through as one row with a count and are repeated in the result, so any number of them (null texts without an id, say) is one
entry of a block; texts shorter than the window stay whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import chain, compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

_LAST = np.iinfo(np.int64).max
_SENT = "block int, bucket int, data binary"
_BITS = "block int, level int, bits_bucket int, bits binary"
_MUL, _MUL2, _SHIFT, _S32 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(29), np.uint64(32)


class _Words(dict):
    """Number of each word, and two 64-bit hashes of it by number; emptied between blocks when it has grown too large."""

    def __init__(self):
        self.hashes: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.hashes.append(xxhash.xxh3_128_digest(word))
        return number

    def lanes(self) -> tuple[np.ndarray, np.ndarray]:
        both = np.frombuffer(b"".join(self.hashes), np.uint64).reshape(-1, 2)
        return both[:, 0].copy(), both[:, 1].copy()

    def reset(self) -> None:
        if len(self) > 300_000:
            self.clear()
            self.hashes.clear()


_words = _Words()


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> _SHIFT)) * _MUL + b
    x ^= x >> _S32
    return x * _MUL2


def _hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each position on, made by doubling."""
    total, done, out, step = len(words), 0, None, words
    size = 1
    while size <= length:
        if length & size:
            out = step if out is None else _mix(out[: total - done - size + 1], step[done : total - size + 1])
            done += size
        if size * 2 <= length:
            step = _mix(step[: max(0, len(step) - size)], step[size:])
        size *= 2
    return out


def levels(window: int, first: int | None = None) -> list[int]:
    """Lengths of the levels: ``first``, its doubles, and the window."""
    out = [min(window, first or -(-window // 2))]
    while out[-1] < window:
        out.append(min(window, 2 * out[-1]))
    return out


class _Block:
    """Documents of one block in the order of their ids, with the survivors of the levels that are over."""

    def __init__(self, table: pa.Table, window: int, keep_words: bool = False):
        ids, texts = table.column("id").to_pylist(), table.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or ""))
        self.ids = [ids[i] for i in order]
        self.copies = table.column("copies").take(pa.array(order, pa.int64()))
        self.words = [(texts[i] or "").encode().split() for i in order]
        counts = np.fromiter(map(len, self.words), np.int64, len(order))
        self.ends = np.cumsum(counts)
        self.total, self.window = int(self.ends[-1]) if len(order) else 0, window
        _words.reset()
        self.flat = np.fromiter(map(_words.__getitem__, chain.from_iterable(self.words)), np.int64, self.total)
        self.lanes = _words.lanes()
        if not keep_words:
            self.words = None
        key = np.array([_LAST if x is None else x for x in self.ids], np.int64)
        valid = np.ones(max(0, self.total - window + 1), bool)
        for end in self.ends[:-1]:
            valid[max(0, end - window + 1) : end] = False
        self.starts = np.flatnonzero(valid)
        self.doc = np.repeat(key, counts)[self.starts] if len(self.starts) else np.empty(0, np.int64)
        self.length, self.hash = 0, None

    def extend(self, length: int) -> None:
        """Goes to the level of ``length`` words, whose hashes are made from those of the level before."""
        if not len(self.starts):
            self.hash = np.empty(0, np.uint64)
        elif self.hash is None:
            self.hash = _hashes(self.lanes[0][self.flat], length)
        else:
            step = length - self.length
            self.hash = _mix(self.hash[: len(self.hash) - step], self.hash[step:])
        self.length = length

    def represented(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct representatives of the windows that are left, whether one stands in several documents here, and each window's."""
        if not len(self.starts):
            return np.empty(0, np.uint64), np.empty(0, bool), np.empty(0, np.int64)
        width = self.window - self.length + 1
        if width > 1:
            spread = np.lib.stride_tricks.sliding_window_view(self.hash, width)
            at = np.empty(len(spread), np.int64)
            for a in range(0, len(spread), 1 << 16):
                at[a : a + (1 << 16)] = spread[a : a + (1 << 16)].argmin(axis=1)
            at = at[self.starts] + self.starts
        else:
            at = self.starts
        # neighbouring windows mostly share their representative's place
        head = np.r_[True, at[1:] != at[:-1]]
        distinct, of = np.unique(self.hash[at[head]], return_inverse=True)
        return distinct, _ends(of, self.doc[head], len(distinct)), of[np.cumsum(head) - 1]

    def keep(self, bits: dict[int, np.ndarray], buckets: int) -> None:
        """Drops the windows whose representative stands in one document alone."""
        distinct, flag, of = self.represented()
        for bucket, at in _dealt(distinct, buckets):
            if bucket in bits:
                flag[at] |= bits[bucket][: len(at)].astype(bool)
        live = flag[of]
        self.starts, self.doc = self.starts[live], self.doc[live]

    def candidates(self, before: int):
        """Distinct windows that are left, by 128 bits: their two hashes, the index of each window's, smallest id of each.

        before: length of the level before the last, from whose windows the second hash is made, too.
        """
        empty = np.empty(0, np.uint64)
        if not len(self.starts):
            return empty, empty, np.empty(0, np.int64), np.empty(0, np.int64)
        one = self.hash[self.starts]
        short = _hashes(self.lanes[1][self.flat], before)
        two = short[self.starts] if before == self.window else _mix(short[self.starts], short[self.starts + self.window - before])
        # windows are in the order of ids, so the first of equals has the smallest
        hashes, first, of = np.unique(one, return_index=True, return_inverse=True)
        if (two != two[first][of]).any():  # equal in 64 bits alone
            pairs = np.empty(len(one), [("a", np.uint64), ("b", np.uint64)])
            pairs["a"], pairs["b"] = one, two
            hashes, first, of = np.unique(pairs, return_index=True, return_inverse=True)
        return one[first], two[first], of, self.doc[first]


def _ends(group: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Whether a group has several documents; rows are in the order of documents."""
    low, high = np.empty(n, np.int64), np.empty(n, np.int64)
    high[group] = doc
    low[group[::-1]] = doc[::-1]
    return low < high


def _dealt(hashes: np.ndarray, buckets: int):
    """(bucket, indexes into hashes) of all buckets that get any, in order."""
    if not len(hashes):
        return
    bucket = ((hashes >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0])
    for a, b in zip(edge, [*edge[1:], len(order)]):
        yield int(bucket[order[a]]), order[a:b]


def _table(columns: list[list], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_SENT_SCHEMA = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())])
_BITS_SCHEMA = pa.schema([("block", pa.int32()), ("level", pa.int32()), ("bits_bucket", pa.int32()), ("bits", pa.binary())])


def _bits(flags: pa.Table, level: int) -> dict[int, np.ndarray]:
    return {k: np.unpackbits(np.frombuffer(v, np.uint8)) for own, k, v in zip(*(flags.column(c).to_pylist() for c in ("level", "bits_bucket", "bits"))) if own == level}


def substring_dedup(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", block_mb: int = 8, first: int | None = None) -> DataFrame:
    """One row for each input row: id, n_words, n_removed, kept_text (kept words joined by one space).

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller id.

    ``block_mb``: what a task holds at once takes some twenty times as much; larger blocks send fewer pieces to buckets.
    """
    if window < 2:
        raise ValueError("window must be 2 or more")
    if first is not None and not 1 <= first <= window:
        raise ValueError("first must be between 1 and window")
    lengths = levels(window, first)
    before = lengths[-2] if len(lengths) > 1 else window
    own, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    rows = docs.select(own.alias("id"), text.alias("text"))
    # the bytes of all rows, and whether rows share id and text
    counted = rows.groupBy("id", F.xxhash64("text").alias("hash"), F.octet_length("text").alias("bytes")).agg(F.count(F.lit(1)).alias("n"))
    size, most = counted.agg(F.sum(F.col("bytes") * F.col("n")), F.max("n")).first()
    size, repeats = size or 0, (most or 0) > 1
    rows = rows.groupBy("id", "text").agg(F.count(F.lit(1)).alias("copies")) if repeats else rows.withColumn("copies", F.lit(1).cast("long"))
    n_blocks = max(8, -(-size // (block_mb << 20)))
    n_buckets = max(8, -(-size // (24 << 20)))
    blocks = rows.select(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)).cast("int").alias("block"), "id", "text", "copies")
    # one plan with this one exchange of the texts, which Spark reuses for all readers; as many tasks as blocks
    blocks = blocks.repartition(n_blocks, "block")

    def begun(table: pa.Table, flags: pa.Table | None, level: int, keep_words: bool = False) -> _Block:
        """The block at ``level``, after all levels before it."""
        block = _Block(table, window, keep_words)
        for k, length in enumerate(lengths[: level + 1]):
            block.extend(length)
            if k < level:
                block.keep(_bits(flags, k), n_buckets)
        return block

    def passed(flags: pa.Table) -> list[tuple]:
        """The bits of earlier levels go along (after a 0 byte): later levels need them too."""
        return [(b, k, bytes([0, own]) + x) for b, own, k, x in zip(*(flags.column(c).to_pylist() for c in ("block", "level", "bits_bucket", "bits")))]

    def send(level: int):
        def of(table: pa.Table, flags: pa.Table | None = None) -> pa.Table:
            if not table.num_rows:
                return _table([[], [], []], _SENT_SCHEMA)
            at, block, sent = table.column("block")[0].as_py(), begun(table, flags, level), passed(flags) if flags else []
            if lengths[level] < window:
                distinct = block.represented()[0]
                sent += [(at, k, b"\1" + distinct[i].astype(np.uint32).tobytes()) for k, i in _dealt(distinct, n_buckets)]
            else:
                one, two, _, least = block.candidates(before)
                for k, i in _dealt(one, n_buckets):
                    ids = least[i]
                    narrow = ids.astype(np.uint32) if ids.min() >= 0 and ids.max() < 2**32 else ids
                    sent.append((at, k, bytes([narrow.itemsize]) + one[i].tobytes() + two[i].tobytes() + narrow.tobytes()))
            return _table(list(zip(*sent)) or [[], [], []], _SENT_SCHEMA)

        return (lambda table: of(table)) if level == 0 else (lambda table, flags: of(table, flags))

    def repeated(level: int):
        """What stands in several documents (or, at the last level, in one with a smaller id), a bit for each entry."""

        def of(table: pa.Table) -> pa.Table:
            bucket, out, own = table.column("bucket")[0].as_py(), [], []
            for block, x in zip(table.column("block").to_pylist(), table.column("data").to_pylist()):
                if x[0] == 0:
                    out.append((block, x[1], bucket, x[2:]))
                else:
                    own.append((block, x))
            if own:
                flags = (_several if lengths[level] < window else _later)([x for _, x in own])
                out += [(block, level, bucket, bits) for (block, _), bits in zip(own, flags)]
            return _table(list(zip(*out)), _BITS_SCHEMA)

        return of

    out_schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("copies", pa.int64())])
    last = len(lengths) - 1

    def finish(table: pa.Table, flags: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table([[], [], [], [], []], out_schema)
        block = begun(table, flags, last, keep_words=True)
        one, _, of, least = block.candidates(before)
        earlier, bits = np.zeros(len(one), bool), _bits(flags, last)
        for k, i in _dealt(one, n_buckets):
            if k in bits:
                earlier[i] = bits[k][: len(i)].astype(bool)
        gone = block.starts[earlier[of] | (least[of] < block.doc)] if len(one) else block.starts
        edges = np.zeros(block.total + window + 1, np.int32)
        edges[gone] += 1
        edges[gone + window] -= 1
        stays = np.cumsum(edges[: block.total]) == 0
        n, removed, text, a = [], [], [], 0
        for words, b in zip(block.words, block.ends.tolist()):
            own = stays[a:b]
            kept = int(own.sum())
            n.append(b - a)
            removed.append(b - a - kept)
            text.append(b" ".join(words if kept == b - a else compress(words, own.tolist())).decode())
            a = b
        return _table([block.ids, n, removed, text, block.copies.to_pylist()], out_schema)

    bits = None
    for level in range(len(lengths)):
        groups = blocks.groupBy("block")
        sent = groups.applyInArrow(send(level), _SENT) if bits is None else groups.cogroup(bits.groupBy("block")).applyInArrow(send(level), _SENT)
        # a task for each bucket, whatever the session's number of shuffle partitions
        bits = sent.repartitionById(n_buckets, F.col("bucket")).groupBy("bucket").applyInArrow(repeated(level), _BITS)
    done = blocks.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(finish, "id long, n_words long, n_removed long, kept_text string, copies long")
    if repeats:
        done = done.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return done.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_text")


def _several(parts: list[bytes]) -> list[bytes]:
    """Bits of the 32-bit hashes (after one byte) that stand in several parts."""
    own = [np.frombuffer(x, np.uint32, offset=1) for x in parts]
    every = np.sort(np.concatenate(own))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    return [np.packbits(np.isin(x, twice)).tobytes() for x in own]


def _later(parts: list[bytes]) -> list[bytes]:
    """Bits of the windows that also stand under a smaller id.  A part: size of an id, both hashes of all windows, ids."""
    one, two, ids = [], [], []
    for x in parts:
        n = (len(x) - 1) // (16 + x[0])
        one.append(np.frombuffer(x, np.uint64, n, 1))
        two.append(np.frombuffer(x, np.uint64, n, 1 + 8 * n))
        ids.append(np.frombuffer(x, np.uint32 if x[0] == 4 else np.int64, n, 1 + 16 * n).astype(np.int64))
    a, b, own = np.concatenate(one), np.concatenate(two), np.concatenate(ids)
    order = np.lexsort((own, a))
    same = a[order][1:] == a[order][:-1]
    if (same & (b[order][1:] != b[order][:-1])).any():  # equal in 64 bits alone
        order = np.lexsort((own, b, a))
        same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    head = np.r_[True, ~same]
    flag = np.empty(len(a), bool)
    flag[order] = own[order][head][np.cumsum(head) - 1] < own[order]
    edges = np.cumsum([len(x) for x in one])
    return [np.packbits(x).tobytes() for x in np.split(flag, edges[:-1])]
