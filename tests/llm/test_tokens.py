import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from hammerline.llm import bpe, packing, tokenstore

ODD = [" ", "  ", "\n", "\t", "\x1c", "　", "a", "Word", "é", "中", "１", "9", "_", "'s", "'ll", "!", "..", "<|endoftext|>", "\x00", "🙂", "ß", "́"]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(bpe.default_vocabulary())
    return lambda text: found.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [None, "", " ", *["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(150)], "the cat sat. " * 3000, "x" * 5000]
    keys = [None, None, *rng.sample(range(-50, 400), len(texts) - 4), 77777, 77777]
    return [(k, t, "n", 1) for k, t in zip(keys, texts)]


def encoded(encoder, texts):
    out = []
    for at, ids, sizes in encoder.slices(pa.array(texts, pa.string())):
        assert at == len(out)
        out += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    return out


def test_encoder_is_exact(reference, monkeypatch):
    rng = random.Random(3)
    encoder = bpe.Encoder(bpe.default_vocabulary())
    ends = ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|> a", "a<|endoftext|>", "<|endoftext", "\n \n", "foo\n \nbar", "foo \n bar"]
    texts = [None, "", *ends, *["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(3000)]]
    assert encoder.by_words and encoded(encoder, texts) == [reference(t) for t in texts]
    monkeypatch.setattr(bpe, "SLICE_BYTES", 400)
    monkeypatch.setattr(bpe, "MEMO_BYTES", 3000)
    monkeypatch.setattr(bpe, "CUT", 60)
    texts += ["".join(rng.choice(ODD) for _ in range(800)), "some words, and more of them. " * 60, "x" * 3000]
    assert encoded(encoder, texts) == [reference(t) for t in texts]
    assert encoded(encoder, []) == []


def test_other_vocabularies_are_encoded_whole():
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    encoder, library, texts = bpe.Encoder(file), Tokenizer.from_file(file), ["A Word, twice a word!", "", None, "  x\ny "]
    assert not encoder.by_words
    assert encoded(encoder, texts) == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_ids_that_do_not_fit_are_an_error(tmp_path):
    writer = tokenstore.ShardWriter(str(tmp_path), 0, 2)
    with pytest.raises(ValueError, match="fit"):
        writer.add([1], np.array([70_000], "<u4"), [1])


def test_store_round_trip(spark, rows, reference):
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, shard int").repartition(3)
    folder = tokenstore.write_tokens(docs)
    got = tokenstore.lookup(spark, folder, docs.select("doc_id")).collect()
    want = sorted(([*reference(t), 0] for _, t, *_ in rows), key=str)
    assert sorted((list(r.ids) for r in got), key=str) == want
    by_key = {k: [*reference(t), 0] for k, t, *_ in rows}
    position = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == position and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        if r.key is not None and r.key != 77777:
            assert list(r.ids) == by_key[r.key]
        position += r.n_tokens
    keys = [r.key for r in sorted(got, key=lambda r: r.start)]
    assert keys == [None, None, *sorted(k for k in keys if k is not None)]
    few = spark.createDataFrame([(77777,), (123456,), (rows[5][0],)], "k long")
    assert sorted(r.key for r in tokenstore.lookup(spark, folder, few).collect()) == sorted([77777, 77777, rows[5][0]])


def test_store_of_an_empty_table(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, shard int").limit(0)
    assert tokenstore.lookup(spark, tokenstore.write_tokens(docs), docs.select("doc_id")).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 20_000))
    slots = tokenstore.PerfectHash(tokenstore.build_hash(keys)).slot(keys)
    assert sorted(slots) == list(range(len(keys)))


def check_packing(rows, reference, got, capacity):
    want = sorted((k is not None, k or 0, zlib.crc32(np.array([*reference(t), 0], "<u4").tobytes())) for k, t, *_ in rows)
    whole = [r for r in got if r.start == 0 and r.length < capacity and r.doc_id != 77777]  # which is cut
    assert {(r.doc_id is not None, r.doc_id or 0, r.ids_crc32) for r in whole} <= set(want)
    assert sum(r.length for r in got) == sum(len(reference(t)) + 1 for _, t, *_ in rows)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_is_valid_and_tight(spark, rows, reference):
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, sequence_id int").repartition(3)
    got = packing.pack(docs, 256).collect()
    n = check_packing(rows, reference, got, 256)
    assert n <= 1.02 * -(-sum(r.length for r in got) // 256) + 1
    assert packing.pack(docs.limit(0), 256).count() == 0


def test_sequences_hold_the_ids(spark, reference):
    rows = [(i, "word " * (i * 7)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    packed = packing.pack(docs, 64).cache()
    made = {r.sequence_id: r.ids for r in packing.sequences(docs, packed).collect()}
    for r in packed.collect():
        ids = [*reference(rows[r.doc_id][1]), 0][r.start : r.start + r.length]
        assert made[r.sequence_id][r.offset : r.offset + r.length] == ids


def test_plan_places_every_piece_once():
    rng = random.Random(1)
    for _ in range(60):
        capacity, counts = rng.choice([7, 10, 64, 2048]), {}
        for _ in range(rng.randint(1, 300)):
            n = rng.randint(1, capacity if rng.random() < 0.7 else max(1, capacity // 8))
            counts[n] = counts.get(n, 0) + rng.choice([1, 2, 3, 50])
        bins, ranks = {}, {}
        for n, rank, total, first, each, offset in packing.plan(counts, capacity):
            for i in range(total):
                bins.setdefault(first + i // each, []).append((offset + i % each * n, n))
                ranks.setdefault(n, []).append(rank + i)
        assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
        for parts in bins.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= capacity
            assert sum(3 * n > capacity for _, n in parts) <= 2


def test_known_words_are_found_by_hashes_and_compared(reference, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["river", "Stone,", "éa", "x9", "light."]) + rng.choice(["", "s", "!"]) for _ in range(200)) for _ in range(6)]
    want = [reference(t) for t in texts]

    def built(*_, **__):
        raise AssertionError("a table of all words known is built anew")

    monkeypatch.setattr(bpe.pc, "index_in", built)
    digest = bpe.xxhash.xxh64_intdigest
    for hashed in (digest, lambda w: 7, lambda w: digest(w) % 3):  # words of one hash are told apart
        monkeypatch.setattr(bpe.xxhash, "xxh64_intdigest", hashed)
        encoder = bpe.Encoder(bpe.default_vocabulary())
        for t, ids in zip(texts, want):
            assert encoder.encode(pa.array([t]))[0].tolist() == ids
    assert len(encoder.memo.words)
