import random
import re
from collections import Counter

import numpy as np
import pytest

from hammerline.llm import phrases
from hammerline.llm.quicksort import frequent_prefixes

SCHEMA = "doc_id long, text string, lang string, h string, k1 int"


def brute(rows, least=10, covered=50, top=2000):
    counts, n = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                counts.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        fit = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in fit.items():
            if any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in fit.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (score, a, phrase, left, right) in enumerate(sorted(found)[:top]):
            out.append((lang, i + 1, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def case(rng):
    names = ["ab", "Cd", "é", "中", "\x1c", "the", "the", "the", "of", "of", "x y", *(f"w{i}" for i in range(40))]
    texts = [None, "", " .,\t", *("".join(rng.choice(names) + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", "\r\n"]) for _ in range(rng.randint(1, 90))) for _ in range(150))]
    rows = [(rng.choice([k, 7, None]), rng.choice(texts), rng.choice(["en", "de", None, ""]), "h", 1) for k in range(300)]
    return [*rows, rows[5], (900, "of the w1 " * 4000, "en", "h", 1), (901, "the, " * 3000, "de", "h", 1)]


@pytest.mark.parametrize("seed, held, span, words, share", [(1, 8_000_000, 1_000_000, 2_000_000, 1 / 1024), (2, 900, 64, 40, 1 / 20), (3, 300, 40, 2_000_000, 1 / 4)])
def test_matches_brute_force(spark, monkeypatch, seed, held, span, words, share):
    monkeypatch.setattr(phrases, "SLICE_WORDS", words)
    monkeypatch.setattr(phrases, "COMMON_SHARE", share)
    monkeypatch.setattr(phrases, "_SALTS", 3)
    rows = case(random.Random(seed))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for top in (2000, 9):
        got = sorted(tuple(r) for r in phrases.collocations(docs, top=top).collect())
        assert got == brute(rows, top=top)


def test_parts_of_a_cut_text_count_once(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(phrases, "HELD_BYTES", 100)
    monkeypatch.setattr(phrases, "SPAN_BYTES", 20)
    rng = random.Random(5)
    rows = [(None, "".join(rng.choice(["a", "b", "cc", "d"]) + rng.choice([" ", " ", ".", "\t"]) for _ in range(rng.randint(0, 400))), rng.choice(["x", "y"])) for _ in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[2] for r in rows]), pa.array([r[1] for r in rows])], ["lang", "text"])
    total, words, parts = Counter(), Counter(), 0
    for held in phrases._held(iter([batch])):
        parts += 1
        for lang, names, ids, front, _ in held.each():
            for i in ids[front:].tolist():
                words[lang, i and names[i - 1].decode()] += i > 0
        out = phrases._suffixes(held, np.empty(0, np.uint64), 3)
        for raw in out.column(2).to_pylist():
            hashes, number, counts = phrases._unpacked(raw)
            for k, n in zip(hashes[number].reshape(3, -1).T.tolist(), counts.tolist()):
                total[tuple(k)] += n
    want, n = Counter(), Counter()
    for _, text, lang in rows:
        for piece in re.split("[.]", text):
            w = piece.split()
            h = [*phrases.word_hashes(lang, [x.encode() for x in w]).tolist(), 0, 0]
            want.update(tuple(h[i : i + 3]) for i in range(len(w) - 1))
            n.update((lang, x) for x in w)
    assert parts > 10 and total == want and +words == n


def test_a_very_long_text_of_one_piece(spark):
    rows = [(1, "a b c " * 700_000, "en", "h", 1)]
    got = sorted(tuple(r) for r in phrases.collocations(spark.createDataFrame(rows, SCHEMA)).collect())
    f = 700_000
    assert [(r[2], r[3]) for r in got] == [("a b c", f), ("b c a", f - 1), ("c a b", f - 1)]


def test_frequent_prefixes_against_counting():
    rng = np.random.default_rng(1)
    for n in (0, 1, 50, 3000):
        for least in (1, 3, 10):
            keys = [rng.zipf(1.5, n).clip(1, 50), rng.zipf(1.5, n).clip(0, 50), rng.zipf(1.5, n).clip(1, 50) - 1]
            weights = rng.integers(1, 3, n)
            for d, (at, sizes) in enumerate(frequent_prefixes(keys, weights, least)):
                want = Counter()
                for i in range(n):
                    t = tuple(int(k[i]) for k in keys[: d + 1])
                    if all(t):
                        want[t] += int(weights[i])
                assert {tuple(int(k[i]) for k in keys[: d + 1]): int(v) for i, v in zip(at, sizes)} == {t: v for t, v in want.items() if v >= least}


def test_exact_score_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, left, right = 123_456_789_012_345, 123_456_789_012_347, 123_456_789_012_349
    row = spark.range(1).select(phrases._score(F.lit(a), F.lit(left), F.lit(right)).alias("s")).first()
    assert row.s == 1_000_000 * a * a // (left * right)


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([(1, "a", "en", "h", 1)], SCHEMA).limit(0)).count() == 0
