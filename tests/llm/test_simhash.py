import random

import xxhash
from pyspark.sql import functions as F

from hammerline.llm import simhash

SCHEMA = "doc_id long, text string, fp long, node string"


def brute(text, k=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    k = min(k, len(words))
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def groups(fps, radius):
    parent = {i: i for i in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= radius and root(a) != root(b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in fps}


def test_matches_brute_force_with_nulls_ties_and_clashing_names(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("ab cd EF gh\tij kl mn éa 中".split(" ")) for _ in range(n)) for n in (1, 2, 3, 40, 60, 3000)]
    texts = [None, "", " \n", *base, *base]
    for t in base[3:]:
        words = t.split(" ")
        for _ in range(6):
            words[rng.randrange(len(words))] = "zz"
            texts.append(" ".join(words))
    rows = [(i * 3 + 5, t, 1, "x") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    fps = {r[0]: brute(r[1]) for r in rows}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{v:016x}" for i, v in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == groups(fps, 2)


def test_links_connect_as_all_pairs_do(spark):
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(20)]
    for _ in range(150):
        f = rng.choice(fps)
        for b in rng.sample(range(64), rng.randint(0, 4)):
            f ^= 1 << b
        fps.append(f)
    fps = sorted({simhash._signed(f) for f in fps})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    from hammerline.llm.components import connected_components

    for radius in (1, 2):
        want = groups({f: f & (2**64 - 1) for f in fps}, radius)
        got = {r.node: r.component for r in connected_components(simhash.ball_links(df, radius)).collect()}
        assert got == {f: c for f, c in want.items() if list(want.values()).count(c) > 1}


def test_repeated_and_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (3, "x y z")], "doc_id long, text string")
    rows = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert rows == [(-1, 7), (3, 3), (7, 7), (7, 7)]
    assert simhash.near_duplicates(df.filter(F.lit(False))).count() == 0


def test_very_long_text_in_spans(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a", "B", "cc", "é"]) + rng.choice(["", "\n", "\t "]) for _ in range(n)) for n in (0, 1, 2, 3, 50, 400)]
    monkeypatch.setattr(simhash, "SPAN_BYTES", 7)
    for k in (1, 2, 3, 5):
        assert [simhash.simhash64(t, k) for t in texts] == [brute(t, k) for t in texts]
