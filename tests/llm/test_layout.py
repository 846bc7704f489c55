"""Sharding, token files, packing, mixing and chat formatting."""

import hashlib
import io
import os
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossara.llm import mixing, queries
from glossara.llm.chat import escape, format_chats, read_chats, unescape
from glossara.llm.mixing import PER_BUCKET, draw, mix, mixture, permuted, targets
from glossara.llm.packing import best_fit, cost, joint_best_fit, pack, pieces_of
from glossara.llm.sharding import place, shard
from glossara.llm.token_planes import Encoder, Writer, planes, read, token_planes, unplanes

public = pytest.importorskip("public_tokenizers")


def slots_are_gapless(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    return all(sorted(x) == list(range(len(x))) for x in by.values())


def test_shards_of_hard_rows(hard, hard_rows):
    got = shard(hard).collect()
    expected = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in hard_rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == expected
    assert slots_are_gapless(got) and all(0 <= r.shard < 16 for r in got)


def test_shards_balance_with_a_hot_group(spark):
    rng = random.Random(2)
    rows = [(k, "hot text " * 20) for k in range(3000)] + [(3000 + k, f"{k} " + "z" * rng.randint(1, 900)) for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = shard(df).collect()
    size, count = Counter(), Counter()
    for r in got:
        size[r.shard] += r["size"]
        count[r.shard] += 1
    mean = sum(size.values()) / 16
    assert all(abs(x - mean) < 0.02 * mean for x in size.values())
    # the hot group exceeds a shard in bytes, so it is cut
    assert len({r.shard for r in got if r.doc_id < 3000}) > 1
    assert slots_are_gapless(got)
    again = {(r.doc_id, r.shard, r.slot) for r in shard(df.repartition(5)).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got}


def test_shards_balance_with_long_single_texts(spark):
    rng = random.Random(4)
    rows = [(k, f"{k} " + "z" * 200_000) for k in range(20)] + [(100 + k, f"{k} " + "z" * rng.randint(1, 900)) for k in range(40_000)]
    size = Counter()
    for r in shard(spark.createDataFrame(rows, "doc_id long, text string"), per_bucket=500).collect():
        size[r.shard] += r["size"]
    mean = sum(size.values()) / 16
    assert all(abs(x - mean) < 0.02 * mean for x in size.values())


def test_half_shard_texts_and_many_null_texts(spark):
    """32 texts of half a shard each among small ones, and a group of many rows with few bytes, which stays whole."""
    rng = random.Random(6)
    rows = [(k, f"{k} " + "z" * 100_000) for k in range(32)] + [(100 + k, f"{k} " + "z" * rng.randint(1, 20)) for k in range(6_000)] + [(10_000 + k, None) for k in range(2_000)]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string"), per_bucket=500).collect()
    size = Counter()
    for r in got:
        size[r.shard] += r["size"]
    mean = sum(size.values()) / 16
    assert all(abs(x - mean) < 0.05 * mean for x in size.values())
    assert len({r.shard for r in got if r.doc_id >= 10_000}) == 1 and slots_are_gapless(got)


def test_a_hot_text_without_ids_is_cut(spark):
    """Rows that nothing tells apart still fill several shards, and rows with ids keep their slots whatever their number."""
    rows = [(None, "hot text " * 20)] * 3000 + [(None, None)] * 500 + [(k, f"{k} " + "z" * (k * 37 % 900)) for k in range(3000)]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), per_bucket=200).collect()
    size = Counter()
    for r in got:
        size[r.shard] += r["size"]
    mean = sum(size.values()) / 16
    assert len(got) == len(rows) and slots_are_gapless(got) and all(abs(x - mean) < 0.05 * mean for x in size.values())
    assert len({r.shard for r in got if r["size"] == 181}) > 3 and len({r.shard for r in got if r["size"] == 1}) == 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_shards_of_the_test_tables(spark, sf):
    got = queries.op1_sharding(spark, f"/root/testdata/{sf}").collect()
    size, where = Counter(), defaultdict(set)
    for r in got:
        size[r.shard] += r["size"]
        where[r.text_crc32, r["size"]].add(r.shard)
    mean = sum(size.values()) / 16
    assert all(abs(x - mean) < 0.05 * mean for x in size.values()) and all(len(x) == 1 for x in where.values())


def test_place_by_brute_force():
    rng = np.random.default_rng(2)
    for n, shards, turn in ((1, 3, 0), (40, 4, 1), (60, 7, 9)):
        vectors = rng.integers(1, 500, (n, 3)).astype(float)
        capacity = vectors.sum(axis=0) / shards
        left = [list(map(float, capacity)) for _ in range(shards)]
        expected = [0] * n
        for i in sorted(range(n), key=lambda i: -max(vectors[i][m] / capacity[m] for m in range(3))):
            dots = [sum((w * vectors[i][m] / capacity[m]) * (w * (left[s][m] if m == 0 else max(left[s][m], 0)) / capacity[m]) for m, w in enumerate((8, 1, 1))) for s in range(shards)]
            best = max(dots)
            at = next(s for s in ((turn + k) % shards for k in range(shards)) if dots[s] >= best - 1e-9)
            for m in range(3):
                left[at][m] -= vectors[i][m]
            expected[i] = at
        residual = np.tile(capacity, (shards, 1))
        assert place(vectors, residual, capacity, turn).tolist() == expected
        assert np.allclose(residual, left)


def test_small_groups_stay_together(spark):
    rows = [(k, f"text {k % 1500} " + "q" * (k % 1500 % 50)) for k in range(4500)]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = defaultdict(set)
    for r in got:
        by[r.doc_id % 1500].add(r.shard)
    assert all(len(x) == 1 for x in by.values())


@pytest.mark.parametrize("mode", ["bit", "byte"])
@pytest.mark.parametrize("n", [1, 7, 64, 1000])
def test_planes(mode, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
    assert (unplanes(planes(ids, mode), n, mode) == ids).all()


@pytest.mark.parametrize("mode", ["bit", "byte"])
def test_file_round_trip(mode):
    rng = np.random.default_rng(1)
    docs = [(None if k == 0 else k, rng.integers(0, 60_000, rng.integers(0, 400)).astype("<u4").tobytes()) for k in range(50)]
    out = io.BytesIO()
    writer = Writer(out, mode, block_ids=128)
    for k, ids in docs:
        writer.add(k, ids)
    writer.close()
    assert list(read(out)) == docs
    with pytest.raises(ValueError):
        list(read(io.BytesIO(b"0" * 40)))


def test_encoder_equals_the_library():
    path = str(public.path(queries.TOKENIZER))
    own = Encoder(path, remember=500)
    rng = random.Random(4)
    letters = " \n\t,.'sabcé漢αβ1²_!<|>endoftext\x1c\x85́ \u200dمגdemllrvtSTREDMLV\u3000\u2009🙂\U000e0001"
    texts = ["", " ", "a\nb", "foo's bar's 'tis don't.", "<|endoftext|> a", "x  y \n z", "²3 x²3", "naïve, ok!"] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(20_000)]
    got = [x for a in range(0, len(texts), 100) for x in own.encode(texts[a : a + 100])]
    for t, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == own.model.encode(t, add_special_tokens=False).ids


def test_token_files(hard, hard_rows):
    path = str(public.path(queries.TOKENIZER))
    got = token_planes(hard, path).collect()
    model = Encoder(path).model
    rows = sorted(hard_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, expected = 0, []
    for r in rows:
        ids = model.encode(r[1] or "", add_special_tokens=False).ids + [2]
        expected.append((r[0], at, len(ids), np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert Counter((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in got) == Counter(expected)


def test_best_fit():
    where, lengths = best_fit([5, 4, 3, 2, 1], [4, 8], [8])
    assert where == [0, 1, 0, 1, 1] and lengths == [8, 8]
    rng = random.Random(0)
    sizes = sorted((rng.randint(1, 4096) for _ in range(500)), reverse=True)
    own = [512, 1024, 2048, 4096]
    _, joint = joint_best_fit(sizes, own)
    assert all(sum(map(cost, joint)) <= sum(map(cost, best_fit(sizes, own, [x])[1])) for x in own)


def cheapest(sizes, lengths):
    """Least cost of all ways to share sizes out among sequences, by trying them all."""
    if not sizes:
        return 0.0
    best = float("inf")

    def go(k, sums):
        nonlocal best
        if k == len(sizes):
            best = min(best, sum(cost(min(x for x in lengths if x >= u)) for u in sums))
            return
        for i in range(len(sums)):
            if sums[i] + sizes[k] <= lengths[-1]:
                go(k + 1, [*sums[:i], sums[i] + sizes[k], *sums[i + 1 :]])
        go(k + 1, [*sums, sizes[k]])

    go(0, [])
    return best


def test_packing_cost_by_brute_force():
    """Best fit is a heuristic: never below the least cost, close to it on average and within a third of it always."""
    rng, lengths, over = random.Random(1), [4, 8, 16], []
    for _ in range(150):
        sizes = sorted((rng.randint(1, 16) for _ in range(rng.randint(1, 7))), reverse=True)
        where, made = joint_best_fit(sizes, lengths)
        used = Counter()
        for s, k in zip(sizes, where):
            used[k] += s
        assert all(used[k] <= made[k] for k in used)
        over.append(sum(map(cost, made)) / cheapest(sizes, lengths))
    assert min(over) >= 1 - 1e-12 and max(over) < 1.34 and sum(over) / len(over) < 1.02


@pytest.mark.parametrize("block", [1 << 20, 700])
def test_packing(hard, hard_rows, block):
    """The documents' ids, put together again from the written sequences, are the library's."""
    path = queries.tokenizer_path()
    model, own = Encoder(path).model, (64, 256, 1024)
    sequences = pack(hard, path, own, block_tokens=block)
    for r in sequences.collect():
        assert len(r.ids) == r.seq_tokens == sum(r.n_tokens) <= r.seq_length in own
        assert not [x for x in own if r.seq_tokens <= x < r.seq_length]
    rows = pieces_of(sequences).collect()
    assert len({r.sequence for r in rows}) == sequences.count()
    expected = Counter()
    for r in hard_rows:
        ids = model.encode(r[1] or "", add_special_tokens=False).ids + [2]
        expected.update((r[0], a, tuple(ids[a : a + 1024])) for a in range(0, len(ids), 1024))
    assert Counter((r.doc_id, r.start, tuple(r.ids)) for r in rows) == expected


def test_targets():
    got = targets([100, 100, 1], [5, 2, 1], 3, 201)
    assert abs(sum(got) - 201) < 1e-9 and got[2] == 3
    assert targets([10, 0], [5, 2], 3, 10) == [10, 0]
    assert targets([], [], 3, 0) == []


def test_draw_is_exact():
    out = draw([1000, 10, 0, 333], 16, 3)
    assert out.sum(axis=0).tolist() == [1000, 10, 0, 333] and (out >= 0).all()
    assert (draw([1000, 10, 0, 333], 16, 3) == out).all()
    assert max(out.sum(axis=1)) - min(out.sum(axis=1)) <= 16


@pytest.mark.parametrize("m", [1, 2, 7, 100, 997])
def test_permutation(spark, m):
    rows = spark.range(m).select(permuted(F.col("id"), F.lit(m).cast("long"), 5, F.lit(2), F.lit(1).cast("long")).alias("p")).collect()
    assert sorted(r.p for r in rows) == list(range(m))


def test_mix(hard, hard_rows):
    got = mix(hard, block_words=16).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], len((r[1] or "").encode().split())) for r in hard_rows)
    assert all(r.taken <= 3 * r["size"] for r in got)
    taken, target = Counter(), {}
    for r in got:
        taken[(r.source_size, r.target)] += r.taken
    for (size, goal), words in taken.items():
        assert abs(words - goal) <= 48, (size, goal, words)
    key = lambda rows: sorted((repr(r.doc_id), r["size"], r.taken) for r in rows)
    assert key(mix(hard.repartition(5), block_words=16).collect()) == key(got)
    assert all(sum(b.n * b.uses for b in r.blocks or []) == r.taken for r in got)


def test_mix_by_brute_force(spark, hard, hard_rows):
    """Streams, blocks and slots made one by one in Python; only hashes and permutations come from the operator's Columns."""
    block = 16
    docs = [r for r in hard_rows if r[0] is not None and [x[0] for x in hard_rows].count(r[0]) == 1]
    df = spark.createDataFrame([(r[0], r[1], r[3]) for r in docs], "doc_id long, text string, source string")
    size = {r[0]: len((r[1] or "").encode().split()) for r in docs}
    names = sorted({r[3] for r in docs}, key=lambda x: (x is None, x or ""))
    sums = [sum(size[r[0]] for r in docs if r[3] == s) for s in names]
    goal = targets(sums, [(5, 2, 1)[k % 3] for k in range(len(names))], 3, sum(sums))
    hashed = {r.id: r.h for r in spark.createDataFrame(list(size.items()), "id long, size long").select("id", F.xxhash64("id", "size").alias("h")).collect()}
    taken = Counter()
    for k, s in enumerate(names):
        own = [r[0] for r in docs if r[3] == s]
        buckets = -(-len(own) // PER_BUCKET)
        stream = [i for i in sorted(own, key=lambda i: (hashed[i] % buckets, i)) for _ in range(size[i])]
        m = -(-len(stream) // block)
        if not m:
            continue
        quota = min(3 * m, round(goal[k] * m / sums[k]))
        col = permuted(F.col("id") % m, F.lit(m).cast("long"), 20_240, F.lit(k), F.floor(F.col("id") / m).cast("long"))
        for (at,) in spark.range(quota).select(col).collect():
            taken.update(stream[at * block : (at + 1) * block])
    got = {r.doc_id: r.taken for r in mix(df, block_words=block).collect()}
    assert got == {i: taken[i] for i in size}


def test_mix_of_many_rows_without_ids(spark, monkeypatch):
    """Rows of one size without an id are runs; long runs go by chunks, and what is taken does not depend on partitions."""
    monkeypatch.setattr(mixing, "CHUNK", 64)
    rows = [(None, None, "a")] * 500 + [(None, f"t{k % 3} b c d e", "a") for k in range(400)] + [(None, "one two", "b")] * 150 + [(k, "w " * (k % 40), "ab"[k % 2]) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(df, block_words=16).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len((t or "").split())) for i, t, _ in rows)
    assert all(r.taken <= 3 * r["size"] and sum(b.n * b.uses for b in r.blocks or []) == r.taken for r in got)
    taken, goal = Counter(), {}
    for r in got:
        taken[r.source_size] += r.taken
        goal[r.source_size] = r.target
    assert all(abs(taken[s] - goal[s]) <= 48 for s in goal)
    key = lambda rows: Counter((r.doc_id, r["size"], r.taken) for r in rows)
    assert key(mix(df.repartition(5), block_words=16).collect()) == key(got)


def test_mix_names_its_bound(hard):
    with pytest.raises(ValueError, match="max_sources"):
        mix(hard, max_sources=1)


def test_mixture(spark, hard):
    docs = hard.where("doc_id is not null").dropDuplicates(["doc_id"])
    plan = {r.doc_id: r for r in mix(docs, block_words=16).collect()}
    got = mixture(docs, block_words=16)
    assert got.schema.names == docs.schema.names
    words, texts = Counter(), {r.doc_id: r.text for r in docs.collect()}
    for r in got.collect():
        words[r.doc_id] += len(r.text.encode().split())
        assert r.n_chars == len(r.text)
        if len(r.text.encode().split()) == plan[r.doc_id]["size"]:
            assert r.text == texts[r.doc_id]
    assert all(words[k] == r.taken for k, r in plan.items())


CHAT = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "one"), (1, 2, "assistant", "two </part> ### \\e"), (1, 3, "user", None), (1, 3, "user", "tie"), (1, 4, None, "x"),
    (2, 0, "a: b", "\\### Assistant: </turn> ok"), (2, 1, "assistant", ""), (3, 0, "assistant", "é漢</turn>\n### user: no"), (3, 1, "assistant", "###" * 5 + "\\\\h"), (None, 0, "user", "no id"), (4, None, "user", "</turn"), (4, 1, "assistant", "\n</turn>\n"),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*r, 1, "x") for r in CHAT], "conv_id long, turn long, role string, text string, rows int, formatted string").repartition(4)
    made = format_chats(df).collect()
    got = {r.conv_id: r for r in read_chats(format_chats(df)).collect()}
    by = defaultdict(list)
    for c, t, r, x in CHAT:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    for c, rows in by.items():
        rows.sort()
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, _, r, x in rows]
        assert got[c].loss_text == "".join(x for _, _, r, x in rows if r == "assistant")
    one = next(r.formatted for r in made if r.conv_id == 1)
    assert one.count("### assistant: ") == 1 and one.count("</part>") == 2


def test_chat_of_many_turns(spark):
    """20,000 turns in one conversation, in time that grows with its length only."""
    n = 20_000
    df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.repeat(F.lit("ab ###"), 16), F.col("id").cast("string")).alias("text"))
    began = time.time()
    row = read_chats(format_chats(df)).first()
    assert time.time() - began < 20
    assert [t.text for t in row.turns] == ["ab ###" * 16 + str(k) for k in range(n)]
    assert row.loss_text == "".join("ab ###" * 16 + str(k) for k in range(n) if k % 3)


def test_a_mask_that_does_not_fit_is_an_error(spark):
    made = format_chats(spark.createDataFrame([(1, 0, "assistant", "abc")], "conv_id long, turn long, role string, text string"))
    moved = made.withColumn("loss_mask", F.transform("loss_mask", lambda m: F.struct((m["skip"] - 1).alias("skip"), m["take"].alias("take"))))
    with pytest.raises(Exception, match="does not fit"):
        read_chats(moved).collect()


def test_escape(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["\\", "#", "###", "</turn>", "</part>", "\n", "e", "h", "t", "p", " ", "</turn", ">"]) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", unescape(F.col("e")).alias("u")).collect():
        assert r.t == r.u and not any(c in r.e for c in ("###", "</turn>", "</part>"))


def test_empty(spark, none):
    assert shard(none).count() == pack(none, queries.tokenizer_path()).count() == mix(none).count() == mixture(none).count() == 0
    assert token_planes(none, str(public.path(queries.TOKENIZER))).count() == 0
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert read_chats(format_chats(empty)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_chat_query_has_the_extra_conversation(spark):
    row = queries.op10_chat(spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    x = queries.EXTRA_CHAT
    assert row.n_turns == 2 and row.loss_chars == len(x)
    assert row.turns_sha256 == hashlib.sha256(f"user\n{x}\nassistant\n{x}\n".encode()).hexdigest()
    assert row.loss_sha256 == hashlib.sha256(x.encode()).hexdigest()
