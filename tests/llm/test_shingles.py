import random

import corpus_pipeline
from hammerline.llm import shingles, simhash, substring
from tests.llm import brute


def sets(text):
    words = brute.split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def kept(docs):
    found, group = {k: sets(t) for k, t in docs.items()}, {k: k for k in docs}
    changed = True
    while changed:
        changed = False
        for a in docs:
            for b in docs:
                if group[a] < group[b] and alike(found[a], found[b]):
                    group[b], changed = group[a], True
    return {k for k in docs if group[k] == k}


def edited():
    """Texts with chains of edited copies around the limit, exact copies, short texts and shared boilerplate."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    common = " ".join(word() for _ in range(60))
    texts = ["", None, "One two", "one  TWO", "one two three", "a b c d e f"]
    for k in range(40):
        words = [word() for _ in range(rng.randint(20, 250))] + (common.split() if k % 3 == 0 else [])
        for _ in range(6):
            texts.append(" ".join(words))
            for _ in range(rng.randint(0, max(1, len(words) // 45))):
                words[rng.randrange(len(words))] = word().upper()
    rng.shuffle(texts)
    return {3 * k + 5: t for k, t in enumerate(texts)}


def test_edited_copies_go_as_by_brute_force(spark, monkeypatch):
    docs = edited()
    want = kept(docs)
    assert 45 < len(want) < len(docs) - 60
    table = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, table, "").collect()) == sorted(want)
    monkeypatch.setattr(substring, "SOURCE_BYTES", 4000)  # many sources and slices
    monkeypatch.setattr(shingles, "SLICE_SHINGLES", 300)
    assert sorted(r.doc_id for r in shingles.keep_one(table).collect()) == sorted(want)


def test_repeated_and_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(7, "a b c d"), (7, "A b c d"), (None, "a b c d"), (None, "a b c d"), (9, "a b  c d"), (3, "x y z")], "doc_id long, text string")
    assert sorted(r.doc_id or -1 for r in shingles.keep_one(df).collect()) == [-1, 3, 7]
    assert shingles.keep_one(df.limit(0)).count() == 0
    two = spark.createDataFrame([(1, "one text of its own", "a"), (1, "quite another thing here", "b"), (1, "one text of its own", "c"), (2, "one  text of its own", "d")], "doc_id long, text string, __x string")
    for keep in (shingles.keep_one, simhash.keep_one):
        assert sorted(r.text for r in keep(two).collect()) == ["one text of its own", "quite another thing here"] and keep(two).columns == two.columns
