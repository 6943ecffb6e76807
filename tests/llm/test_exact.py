import hashlib
import random

import numpy as np

from hammerline.llm import exact, substring
from hammerline.llm.quotient import QuotientFilter

SCHEMA = "doc_id long, text string, copies string, cls long"


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for key, text, *_ in rows:
        groups.setdefault(fold(text), []).append(key)
    out, done = [], set()
    for key, text, *_ in rows:
        held = groups[fold(text)]
        keep = max((k for k in held if k is not None), default=None)
        kept = key == keep and fold(text) not in done
        done |= {fold(text)} if kept else set()
        out.append((key, keep, len(held), kept, hashlib.sha256(fold(text).encode()).hexdigest()))
    return sorted(out, key=str)


def test_filter_gives_back_what_was_put_in_and_merges_without_loss():
    rng = random.Random(3)
    for n in (1, 2, 9, 400):
        for bits in (3, 11):
            mask, prefix, made = (1 << (64 - bits)) - 1, rng.getrandbits(bits) << (64 - bits), []
            for _ in range(3):  # crowded quotients, equal remainders, large counts
                fps = [prefix | (rng.getrandbits(64) if rng.random() < 0.5 else rng.getrandbits(8) << rng.choice([0, 25, 50])) & mask for _ in range(n)]
                distinct, counts = np.unique(np.array(fps, np.uint64), return_counts=True)
                counts[0] += rng.choice([0, 1 << 40])
                made.append((QuotientFilter.from_bytes(QuotientFilter.build(distinct, counts, bits).to_bytes()), distinct, counts))
                assert [x.tolist() for x in made[-1][0].entries()] == [distinct.tolist(), counts.tolist()]
            total = {}
            for _, distinct, counts in made:
                for f, c in zip(distinct.tolist(), counts.tolist()):
                    total[f] = total.get(f, 0) + c
            merged = QuotientFilter.merge([m[0] for m in made])
            assert dict(zip(*(x.tolist() for x in merged.entries()))) == total
            asked = np.array([*total, prefix | 12345], np.uint64)
            assert merged.count(asked).tolist() == [total.get(f, 0) for f in asked.tolist()]


def test_matches_brute_force_with_nulls_ties_and_clashing_names(spark, monkeypatch):
    rng = random.Random(5)
    texts = [None, "", "A b", "a B", "ä", "Ä", "x " * 50_000, *(f"t{i}" for i in range(30))]
    rows = [(rng.choice([k, k, k, 7, None]), rng.choice(texts), "x", 1) for k in range(200)] + [(900, "one", "x", 2), (None, "only null", "x", 2), (None, "ONLY null", "x", 2)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for size in (200, 4_000_000):
        monkeypatch.setattr(substring, "SOURCE_BYTES", size)
        found = exact.exact_duplicates(docs)
        assert found.columns == ["doc_id", "text", "copies", "cls", "copies_"]
        got = [(r.doc_id, r.copies_.keep_id, r.copies_.group_size, r.copies_.kept, r.copies_.text_sha256) for r in found.collect()]
        want = brute(rows)
        flat = lambda xs: sorted(((x[:3] + x[4:]) for x in xs), key=str)
        assert flat(got) == flat(want)
        kept = exact.without_copies(found).collect()
        assert sorted(fold(r.text) for r in kept) == sorted({fold(r[1]) for r in rows})
        best = {fold(r[1]): max((x[0] for x in rows if fold(x[1]) == fold(r[1]) and x[0] is not None), default=None) for r in rows}
        assert all(r.doc_id == best[fold(r.text)] for r in kept)


def test_equal_fingerprints_of_different_texts_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(exact, "_prints", lambda texts: np.zeros(len(texts), np.uint64))
    table = exact._routed([1, 2, 3], __import__("pyarrow").array(["a", "b", "A"]), 5, {0: b"\x80"}, 3)
    assert table[1].to_pylist()[0] == table[1].to_pylist()[2] != table[1].to_pylist()[1]
    assert table[2].to_pylist() == [False, True, True] and table[3].to_pylist() == [None, 1, 2]


def test_empty_table(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string").limit(0)
    assert exact.exact_duplicates(docs).count() == 0
