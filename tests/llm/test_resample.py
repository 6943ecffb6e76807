import hashlib
import math
import random
import re
import zlib

import pytest

from hammerline.llm import prefixcrc, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, rank string, score string, packed int"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def buckets(text, most, n):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % n for k in range(1, most + 1) for i in range(len(w) - k + 1)]


def brute(rows, items, most=2, n=10_000, least=20, percent=25, seed=7):
    s, t = [0] * n, [0] * n
    for total, texts in ((s, [r[1] for r in rows]), (t, items)):
        for x in texts:
            for b in buckets(x, most, n):
                total[b] += 1
    s_all, t_all = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (s_all + n) / ((a + 1) * (t_all + n)))) for a, b in zip(s, t)]
    out = []
    for key, text, *_ in rows:
        found = buckets(text, most, n)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        score = None
        if key is not None:
            h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(found), weight, score, None, len(words(text)) >= least and key is not None])
    fit = sorted((x for x in out if x[5]), key=lambda x: (-x[3], x[0], x[2], x[1]))
    for i, x in enumerate(fit[: percent * len(fit) // 100]):
        x[4] = i + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


def case(rng):
    vocabulary = ["ab", "Cd", "é", "中中", "x" * 80, "y" * 200, "q1", "zz"]
    texts = [None, "", " .-", "one", *(rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, k=rng.randint(1, 60))) for _ in range(80))]
    rows = [(rng.choice([k, k, k, 5, None]), rng.choice(texts), "r", "s", 1) for k in range(200)]
    return [*rows, rows[9], rows[9], (800, "ab cd " * 30_000, "r", "s", 1), (801, "w" * 300_000, "r", "s", 1)], [rng.choice(texts) for _ in range(9)]


@pytest.mark.parametrize("most, n, span", [(2, 10_000, 1 << 20), (1, 70_000, 40), (3, 50, 40)])
def test_matches_brute_force(spark, monkeypatch, most, n, span):
    monkeypatch.setattr(prefixcrc, "SPAN_BYTES", span if span > 40 else 4000)
    rows, items = case(random.Random(n))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    target = spark.createDataFrame([(t, 1) for t in items], "text string, id int")
    for percent in (25, 100, 0):
        got = [tuple(r) for r in resample.importance(docs, target, most=most, n_buckets=n, percent=percent).collect()]
        assert sorted(got, key=str) == brute(rows, items, most, n, percent=percent)


def test_crcs_of_all_runs_over_borders_of_spans(monkeypatch):
    monkeypatch.setattr(prefixcrc, "SPAN_BYTES", 30)
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["a", "B", "zé", "中", " ", "-", "q" * rng.choice([1, 70, 300])]) for _ in range(rng.randrange(100)))
        for most in (1, 2, 3):
            n, found = resample._buckets(text, most, 1 << 20)
            assert n == len(words(text)) and sorted(found.tolist()) == sorted(buckets(text, most, 1 << 20))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b " * 30), (2, "a b " * 30)], "doc_id long, text string")
    assert resample.importance(docs.limit(0), docs).count() == 0
    got = resample.importance(docs, docs.limit(0), percent=50).collect()
    assert sorted(tuple(r) for r in got) == brute([(r.doc_id, r.text) for r in docs.collect()], [], percent=50)
