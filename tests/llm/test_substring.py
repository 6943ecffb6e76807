import random

from hammerline.llm import substring


def brute(rows, window):
    first = {}
    for key, text, *_ in rows:
        words = (text or "").replace("\t", " ").replace("\n", " ").split(" ")
        words = [w for w in words if w]
        for i in range(len(words) - window + 1 if key is not None else 0):
            w = tuple(words[i : i + window])
            first[w] = min(key, first.get(w, key))
    out = []
    for key, text, *_ in rows:
        words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
        covered = set()
        for i in range(len(words) - window + 1 if key is not None else 0):
            if first[tuple(words[i : i + window])] < key:
                covered |= set(range(i, i + window))
        kept = [w for i, w in enumerate(words) if i not in covered]
        out.append((key, len(words), len(covered), " ".join(kept)))
    return sorted(out, key=str)


def case(rng, window):
    passages = [[f"p{rng.randrange(60)}" for _ in range(rng.randint(window - 2, 3 * window))] for _ in range(4)]
    rows = []
    for k in range(60):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randint(0, 2 * window))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(words))
            p = rng.choice(passages)
            a = rng.randint(0, 3)
            words[at:at] = p[a : len(p) - rng.randint(0, 3)]
        rows.append((rng.choice([k, k, k, 7, None]), rng.choice([" ", "\n", "\t "]).join(words), "x"))
    rows += [(500 + i, rows[3][1], "copy") for i in range(5)] + [(None, rows[3][1], "x"), (900, None, "x"), (901, "", "x"), (902, "a b " * 200, "x")]
    return rows


def test_matches_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    for window, size in ((50, 3000), (7, 8_000_000), (8, 500)):
        rows = case(rng, window)
        rng.shuffle(rows)
        monkeypatch.setattr(substring, "SOURCE_BYTES", size)
        docs = spark.createDataFrame(rows, "doc_id long, text string, repeats string").repartition(3)
        found = substring.remove_repeats(docs, window)
        assert found.columns == ["doc_id", "text", "repeats", "repeats_"]
        got = sorted(((r.doc_id, r.repeats_.n_words, r.repeats_.n_removed, r.repeats_.kept) for r in found.collect()), key=str)
        assert got == brute(rows, window)
        assert sorted(found.select("doc_id", "text", "repeats").collect(), key=str) == sorted(docs.collect(), key=str)
        left = substring.without_repeats(found)
        assert left.columns == docs.columns and left.filter("repeats is null").count() == 0


def test_empty_table(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string").limit(0)
    assert substring.remove_repeats(docs).count() == 0
