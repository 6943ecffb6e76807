import hashlib
import random
import re

from hammerline.llm import decontaminate as d


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size=10):
    out = []
    for key, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            b = words(t)
            n = min(size, len(b))
            for i in range(len(b) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == b[i : i + n]:
                        hit |= set(range(j, j + n))
                        found |= {str(item)} if item is not None else set()
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def case():
    rng = random.Random(6)
    word = lambda: rng.choice(["A", "b", "Éa", "éa", "c3", "x-y", "中", "w%d" % rng.randrange(40)])
    items = [(i if i else None, rng.choice([" ", ", ", "\n"]).join(word() for _ in range(rng.choice([0, 1, 4, 9, 10, 25])))) for i in range(12)]
    items += [(5, items[5][1]), (77, None), (78, "!!"), (11, "ONE two THREE")]
    docs = []
    for k in range(40):
        parts = [" ".join(word() for _ in range(rng.randint(0, 12)))]
        for _ in range(rng.randint(0, 3)):
            parts.append(rng.choice(items)[1] or "")
        docs.append((rng.choice([k, 3, None]), rng.choice([" ", "--", "\t"]).join(parts).upper() if k % 3 else " ".join(parts), "c"))
    docs += [(900, None, "c"), (901, "", "c"), (902, "one two three " * 3000, "c")]
    return docs, items


def test_matches_brute_force_whole_and_sliced(spark):
    docs, items = case()
    df = spark.createDataFrame(docs, "doc_id long, text string, items string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for chars in (32_000_000, 150):
        got = [tuple(r) for r in d.report(d.find_windows(df, bench, slice_chars=chars)).collect()]
        assert sorted(got, key=str) == brute(docs, items)


def test_spans_are_cut_and_clean_documents_stay(spark):
    bench = spark.createDataFrame([(1, "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11")], "item_id long, text string")
    hit = "Keep (this) one. Q1, q2 q3 q4 q5 q6 q7 q8\nq9 q10 q11! and these six words too please, and more of them"
    df = spark.createDataFrame([(1, hit, "s"), (2, "clean  text ", "s"), (3, "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10", "s"), (4, None, "s")], "doc_id long, text string, source string")
    kept = {r.doc_id: r.text for r in d.without_hits(d.find_windows(df, bench)).collect()}
    assert kept == {1: "Keep (this) one. ! and these six words too please, and more of them", 2: "clean  text ", 4: None}


def test_empty_tables(spark):
    docs, items = case()
    df = spark.createDataFrame(docs, "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert d.report(d.find_windows(df.limit(0), bench)).count() == 0
    assert not any(r.contaminated for r in d.report(d.find_windows(df, bench.limit(0))).collect())


def test_index_of_many_windows_stays_small():
    import pickle

    rng = random.Random(2)
    items = [(str(k), " ".join(rng.choices([f"w{i:04d}" for i in range(3000)], k=1000))) for k in range(300)]
    index = d.Windows(iter(items), 10)
    assert len(pickle.dumps(index)) < 8 * sum(len(t) for _, t in items)
    words = d.words_of("x y " + " ".join(items[7][1].split()[5:17]) + " z")
    assert d.merged(index.scan(words)[0]) == [(2, 14)] and index.scan(words)[1] == {"7"}
