"""Token ids as binary files: fixed-size blocks of ids, transposed into bit or byte planes, each plane compressed with
zstandard, and a chunk index at the end.

File layout (integers little-endian):
    magic "GPL1"
    chunks: for each block of ``block_ids`` ids its compressed planes, one after the other
    document table: compressed doc ids (int64) and id counts (int64)
    index: JSON {"mode", "block_ids", "n_ids", "n_docs", "chunks": [[offset, n_ids, [plane sizes]]...], "docs": [offset, size, size]}
    u64 length of the index, magic
Plane p of a block holds bit (or byte) p of all its ids; trailing planes that are zero throughout have size 0 and are
not stored.

Documents are range-partitioned and sorted by id, each partition writes one file to the shared folder under a name that
does not depend on the attempt (a repeated task replaces it with the same bytes), and the start of each file follows
from the id counts of the files before it.

Defined cases: a null text is an empty document, which still has its end id; a null doc id sorts first; equal doc ids
keep one row each, ordered by text; an empty table makes no files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import full_path, scratch

MAGIC = b"GPL1"


def planes(ids: np.ndarray, mode: str) -> list[bytes]:
    """Bit (32) or byte (4) planes of unsigned 32-bit ids."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if mode == "byte":
        top = int(ids.max()) if len(ids) else 0
        return [raw[:, p].tobytes() if top >> 8 * p else bytes(len(ids)) for p in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, p], bitorder="little").tobytes() for p in range(32)]


def unplanes(parts: list[bytes], n: int, mode: str) -> np.ndarray:
    if mode == "byte":
        raw = np.zeros((n, 4), np.uint8)
        for p, x in enumerate(parts):
            if x:
                raw[:, p] = np.frombuffer(x, np.uint8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        for p, x in enumerate(parts):
            if x:
                bits[:, p] = np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little")[:n]
        raw = np.packbits(bits, axis=1, bitorder="little")
    return raw.reshape(-1).view("<u4")


class Writer:
    def __init__(self, out, mode: str = "byte", block_ids: int = 65_536, level: int = 1):
        self.out, self.mode, self.block, self.zip = out, mode, block_ids, zstandard.ZstdCompressor(level=level)
        self.chunks, self.docs, self.counts, self.left, self.n, self.at = [], [], [], [], 0, len(MAGIC)
        self.held = 0
        out.write(MAGIC)

    def add(self, doc_id, ids: bytes) -> None:
        """One document: its id and its ids as little-endian unsigned 32-bit integers."""
        self.docs.append(-(2**63) if doc_id is None else doc_id)
        self.counts.append(len(ids) // 4)
        self.left.append(ids)
        self.held += len(ids)
        if self.held >= 4 * self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        data = b"".join(self.left)
        step = 4 * self.block
        end = len(data) if last else len(data) // step * step
        for a in range(0, end, step):
            ids = np.frombuffer(data[a : min(a + step, end)], "<u4")
            packed = [self.zip.compress(p) if p.strip(b"\0") else b"" for p in planes(ids, self.mode)]
            self.chunks.append([self.at, len(ids), [len(p) for p in packed]])
            self._write(b"".join(packed))
            self.n += len(ids)
        self.left, self.held = [data[end:]], len(data) - end

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self._flush(True)
        at = self.at
        ids, counts = (self.zip.compress(np.array(x, "<i8").tobytes()) for x in (self.docs, self.counts))
        self._write(ids + counts)
        index = json.dumps({"mode": self.mode, "block_ids": self.block, "n_ids": self.n, "n_docs": len(self.docs), "chunks": self.chunks, "docs": [at, len(ids), len(counts)]}).encode()
        self._write(index + struct.pack("<Q", len(index)) + MAGIC)


def read(source) -> Iterator[tuple[int | None, bytes]]:
    """(doc id, ids as bytes) of all documents of a seekable file, one chunk in memory at a time."""
    source.seek(0, 2)
    end = source.tell()
    source.seek(end - 12)
    n, magic = struct.unpack("<Q4s", source.read(12))
    if magic != MAGIC:
        raise ValueError("not a token plane file")
    source.seek(end - 12 - n)
    index = json.loads(source.read(n))
    unzip = zstandard.ZstdDecompressor()
    at, a, b = index["docs"]
    source.seek(at)
    docs = np.frombuffer(unzip.decompress(source.read(a)), "<i8") if index["n_docs"] else []
    counts = np.frombuffer(unzip.decompress(source.read(b)), "<i8") if index["n_docs"] else []
    chunks, data = iter(index["chunks"]), b""
    for doc, count in zip(docs, counts):
        parts, have = [data], len(data)
        while have < 4 * count:
            at, size, lengths = next(chunks)
            source.seek(at)
            own = unplanes([unzip.decompress(source.read(x)) if x else b"" for x in lengths], size, index["mode"]).tobytes()
            parts.append(own)
            have += len(own)
        data = b"".join(parts) if len(parts) > 1 else data
        yield None if doc == -(2**63) else int(doc), data[: 4 * count]
        data = data[4 * count :]


#: Letters that a piece may be made of, and white space as the tokenizer's pattern has it.
_L = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_S = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Encoder:
    """Ids of texts by a byte-level BPE of the tokenizers library.

    Its pre-tokenizer starts a new piece at a single space before other characters, between a letter and a character
    that is no letter (but for contractions, after an apostrophe), and around the last character of white space.  The
    pattern here cuts only there, and keeps together whatever it is not sure of.  So the library is asked for each
    distinct piece once, for as long as the (bounded) table remembers it; pieces of a space and letters are given to it
    many at a time, as one text, and told apart by their bytes.
    """

    PIECES = re.compile(f" ?[{_L}]++(?![^\\W\\d_])| ?(?:[^{_S}{_L}]+(?:(?<=[^\\W\\d_])[{_L}]+|(?<=')[{_L}]+)?)+| ?[^{_S}]+|[{_S}]+(?=[{_S}][^{_S}])|[{_S}]+")

    def __init__(self, path: str, remember: int = 1_000_000):
        from tokenizers import Tokenizer

        self.path, self.remember = path, remember
        self.model = Tokenizer.from_file(path)
        kind = json.loads(self.model.to_str())
        pre = kind.get("pre_tokenizer") or {}
        added = kind.get("added_tokens") or []
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not kind.get("normalizer")
        # a special string must reach the library in one piece: texts that hold one are not cut
        self.special = [x["content"] for x in added]
        vocab = self.model.get_vocab()
        self.bytes_of = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        for token, k in vocab.items():
            self.bytes_of[k] = len(token)
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        if not self.cuts or any(x in text for x in self.special):
            return [text]
        return self.PIECES.findall(text)

    def _learn(self, new: list[str]) -> None:
        spaced = [p for p in new if p[0] == " " and p[1:].isalpha()] if self.cuts else []
        bare = [p for p in new if p.isalpha()] if self.cuts else []
        # letters end at a newline, which is a piece of its own before other characters
        for own, between in ((spaced, ""), (bare, "\n")):
            groups = [own[a : a + 1024] for a in range(0, len(own), 1024)]
            for group, found in zip(groups, self.model.encode_batch_fast([between.join(g) for g in groups], add_special_tokens=False)):
                ids = np.array(found.ids, "<u4")
                at = np.r_[0, np.cumsum(self.bytes_of[ids])]
                sizes = np.array([len(p.encode()) for p in group])
                ends = np.cumsum(sizes + len(between)) - len(between)
                data = ids.tobytes()
                for p, a, b in zip(group, (4 * np.searchsorted(at, ends - sizes)).tolist(), (4 * np.searchsorted(at, ends)).tolist()):
                    self.known[p] = data[a:b]
        rest = list(set(new).difference(spaced, bare))
        for a in range(0, len(rest), 4096):
            own = rest[a : a + 4096]
            self.known.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(own, self.model.encode_batch_fast(own, add_special_tokens=False)))

    def encode(self, texts: list[str]) -> list[bytes]:
        get, out, gaps = self.known.get, [], []
        for t in texts:
            ps = self.pieces(t)
            ids = list(map(get, ps))
            out.append(ids)
            if None in ids:
                at = -1
                for _ in range(ids.count(None)):
                    at = ids.index(None, at + 1)
                    gaps.append((ids, at, ps[at]))
        new = list({p for _, _, p in gaps})
        if len(self.known) + len(new) > self.remember:
            self.known.clear()
        self._learn(new)
        known = self.known
        for ids, at, p in gaps:
            ids[at] = known[p]
        return [b"".join(ids) for ids in out]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _open(path: str):
    """File system and path; a full path is one with a scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_planes(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", mode: str = "byte", block_ids: int = 65_536) -> list:
    """Writes one file for each range of ids; returns the manifest, a row (part, path, n_docs, n_ids) for each file."""
    end = struct.pack("<I", end_id)
    folder = full_path(docs.sparkSession, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, out, docs_, ids_ = context.partitionId(), None, 0, 0
        path = f"{folder}/part-{part:06d}.gpl"
        files, at = _open(path)
        attempt = f"{at}.{context.taskAttemptId()}"
        enc = encoder(tokenizer)
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                files.create_dir(at.rsplit("/", 1)[0], recursive=True)
                raw = files.open_output_stream(attempt)
                out = Writer(raw, mode, block_ids)
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a in range(0, len(texts), 256):
                for name, ids in zip(names[a : a + 256], enc.encode([t or "" for t in texts[a : a + 256]])):
                    out.add(name, ids + end)
                    docs_, ids_ = docs_ + 1, ids_ + len(ids) // 4 + 1
        if out is not None:
            out.close()
            raw.close()
            files.move(attempt, at)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "n_docs": pa.array([docs_], pa.int64()), "n_ids": pa.array([ids_], pa.int64())})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ranges = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    return sorted(ranges.mapInArrow(write, "part int, path string, n_docs long, n_ids long").collect())


def read_planes(spark, manifest: list, id_col: str = "doc_id", digest: bool = False) -> DataFrame:
    """One row for each document of the files: id, start (ids of all documents before it), n_tokens, ids (binary).

    digest: the unsigned crc32 of the ids, as ids_crc32, instead of the ids.
    """
    start, files = 0, []
    for m in manifest:
        files.append((m["path"], start))
        start += m["n_ids"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, name = _open(path)
                with store.open_input_file(name) as source:
                    held, size = [], 0
                    for doc, ids in read(source):
                        held.append((doc, at, len(ids) // 4, zlib.crc32(ids) if digest else ids))
                        at += len(ids) // 4
                        size += len(ids)
                        if size > 8 << 20:
                            yield _batch(held, digest)
                            held, size = [], 0
                    if held:
                        yield _batch(held, digest)

    schema = f"{id_col} long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary")
    if not files:
        return spark.createDataFrame([], schema)
    table = spark.createDataFrame(files, "path string, start long").repartition(len(files), "path")
    return table.mapInArrow(rows, schema.replace(id_col, "id", 1)).withColumnRenamed("id", id_col)


def _batch(rows: list[tuple], digest: bool) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["id", "start", "n_tokens", "ids_crc32" if digest else "ids"])


def token_planes(docs: DataFrame, tokenizer: str, folder: str | None = None, digest: bool = False, **options) -> DataFrame:
    """Writes the files (to a new folder in the shared one, unless given) and reads them back."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "token-planes")
    manifest = write_planes(docs, tokenizer, folder, **options)
    return read_planes(spark, manifest, options.get("id_col", "doc_id"), digest)
