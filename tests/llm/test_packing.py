import zlib
from collections import defaultdict

import numpy as np
import pytest

from websift.llm import packing, tokens, training_order


def library_ids(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokens.default_vocabulary())
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_equal_the_tokenizers_library(rows):
    texts = [r[1] for r in rows] + ["<|endoftext|> a", "  x \n\n y  ", "it's 12,5\t é", "a  b", "\U0001f600"]
    e = tokens.Encoder()
    for ids, t in zip(library_ids(texts), texts):
        assert e.encode(t) == np.array(ids, dtype="<u4").tobytes()


SPECIAL = ["a<|endoftext|>b", "<|endoftext|>", " <|endoftext|>  x\n", "<|endoftext|><|endoftext|> a  <|endoftext|", "a  <|endoftext|>  b"]


def test_ids_with_special_tokens_equal_the_library_in_its_default_setting(rows):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokens.default_vocabulary())
    texts = [r[1] or "" for r in rows] + SPECIAL
    e = tokens.Encoder(special=True)
    for text, want in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert e.encode(text) == np.array(want.ids, dtype="<u4").tobytes()


@pytest.mark.parametrize("unit", [" ", "\n", "\t", "x", "1", "!"])
def test_long_runs_equal_the_library(unit):
    text = "x" + unit * 2_000_000 + " <|endoftext|> y"
    for special in (True, False):
        assert tokens.Encoder(special=special)._by_library("a <|endoftext|>") == tokens.Encoder(special=special).encode("a <|endoftext|>")
    assert tokens.Encoder(dtype="<u4").encode(text) == np.array(library_ids([text])[0], dtype="<u4").tobytes()


def test_packing_takes_the_ids_of_special_tokens(spark):
    df = spark.createDataFrame([(1, SPECIAL[0])], "doc_id long, text string")
    r = packing.pack(df).first()
    assert r.ids_crc32 == zlib.crc32(np.array([64, 50256, 65, tokens.END_ID], dtype="<u4").tobytes()) and r.doc_tokens == 4


def test_every_id_lies_in_one_piece_and_sequences_are_gapless(docs, rows):
    got = packing.pack(docs, seq_len=64, group_pieces=50).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at and n > 0
            at += n
        assert at <= 64
    want = []
    for r, ids in zip(rows, library_ids([r[1] for r in rows])):
        ids = np.array([*ids, tokens.END_ID], dtype="<u4")
        want += [(r[0], s, len(ids[s:s + 64]), zlib.crc32(ids[s:s + 64].tobytes()), len(ids)) for s in range(0, len(ids), 64)]
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got), key=key) == sorted(want, key=key)


def test_first_fit_decreasing_equals_a_linear_search():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 101, 500).tolist()
    room, want = [], {}
    for k in sorted(range(500), key=lambda i: -sizes[i]):
        b = next((i for i, x in enumerate(room) if x >= sizes[k]), None)
        if b is None:
            room.append(100)
            b = len(room) - 1
        want[k] = (b, 100 - room[b])
        room[b] -= sizes[k]
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    assert [want[k] for k in range(500)] == list(zip(bins, offsets))


def test_empty(empty):
    assert packing.pack(empty).count() == 0


def test_feistel_slots_are_a_permutation():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        p = training_order.permute(np.arange(n), n)
        assert sorted(p.tolist()) == list(range(n))
        assert (training_order.permute(p, n, inverse=True) == np.arange(n)).all()
    assert (training_order.permute(np.arange(50), 50, "a") != training_order.permute(np.arange(50), 50, "b")).any()


def test_training_order_round_trip(spark, docs, rows, tmp_path):
    folder = f"file://{tmp_path}/shards"
    slots = training_order.materialise(docs, folder, seq_len=32, shard_sequences=50)
    got = training_order.read_sequences(slots, folder, seq_len=32, shard_sequences=50).orderBy("slot").collect()
    assert [r.slot for r in got] == list(range(len(got)))
    ids = {}
    for r in got:
        raw = open(f"{tmp_path}/shards/{r.file}", "rb").read()
        seq = raw[r.byte_offset:r.byte_offset + 64]
        assert zlib.crc32(seq[:2 * r.n_tokens]) == r.ids_crc32 and r.shard == r.slot // 50
        ids[r.slot] = np.frombuffer(seq, dtype="<u2")[:r.n_tokens]
    # back in the order of the sequences, the ids are those of the documents, each with its end
    back = training_order.permute(np.arange(len(got)), len(got), inverse=True)
    stream = np.concatenate([ids[s] for s in np.argsort(back)])
    want = sorted(tuple(x) for x in library_ids([r[1] for r in rows]))
    found, at = [], 0
    for end in np.flatnonzero(stream == training_order.END_ID):
        found.append(tuple(stream[at:end].tolist()))
        at = end + 1
    assert at == len(stream) and sorted(found) == want
    assert {d for r in got for d in r.doc_ids} == {r[0] for r in rows}


def test_training_order_empty(empty):
    assert training_order.order(empty).count() == 0


def test_sequences_are_numbered_by_partition(spark):
    rows = [(i, f"text number {i} " * (i % 7)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spark.range(100).repartition(5).count()  # task attempts have gone on
    for n in (3, 4):
        runs = training_order._sequences(df.repartition(n, "doc_id"), 16, None, training_order.DTYPE)
        assert {r.task for r in runs.select("task").collect()} <= set(range(n))
    again = [sorted(map(tuple, training_order.order(df.repartition(3, "doc_id"), seq_len=16).drop("doc_ids").collect())) for _ in range(2)]
    assert again[0] == again[1]
