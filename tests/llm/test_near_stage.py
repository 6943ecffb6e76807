import random

import corpus_pipeline
from hammerline.llm import shingles, simhash
from tests.llm import brute


def texts():
    """Texts that repeat a sentence, before short tails of their own, have near fingerprints and few shingles in
    common; edited copies of long texts have many in common and distant fingerprints."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    prose = lambda n: [word() for _ in range(n)]
    found = []
    for _ in range(6):
        said = prose(9)
        found += [" ".join(said * 40 + prose(n)) for n in (0, 6, 12, 20, 25)]
    edited = [*found[1].split(), *prose(3)]  # near one of the last by its shingles alone
    found.append(" ".join(edited))
    for _ in range(10):
        words = prose(120)
        found.append(" ".join(words))
        words[60] = word()
        found.append(" ".join(words))
    found += [" ".join(prose(50)) for _ in range(8)]
    rng.shuffle(found)
    return {7 * k + 3: t for k, t in enumerate(found)}


def groups(docs):
    sets, prints = {k: brute.shingle_set(t) for k, t in docs.items()}, {k: simhash.simhash64(t) for k, t in docs.items()}
    by = {
        "fingerprints": lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2,
        "shingles": lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]),
    }
    out = {}
    for name, rules in {**{k: [f] for k, f in by.items()}, "both": [*by.values()]}.items():
        group, changed = {k: k for k in docs}, True
        while changed:
            changed = False
            for a in docs:
                for b in docs:
                    if group[a] < group[b] and any(f(a, b) for f in rules):
                        group[b], changed = group[a], True
        out[name] = group
    return out


def test_the_stage_links_near_fingerprints_and_alike_shingles(spark):
    docs = texts()
    want = groups(docs)
    kept = {name: {k for k in docs if group[k] == k} for name, group in want.items()}
    assert len(kept["both"]) < min(len(kept["fingerprints"]), len(kept["shingles"])) - 5  # either finds what the other misses
    table = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, table, "").collect()} == kept["both"]
    assert {r.doc_id: r.component_id for r in shingles.near_duplicates(table).collect()} == want["both"]
