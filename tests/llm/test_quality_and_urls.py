import re
from collections import Counter

from hammerline.llm import quality, urls

WHITE = " \t\n\x0b\x0c\r"


def base(text):
    text = text or ""
    w = [x for x in re.split(f"[{WHITE}]+", text) if x]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times = Counter(grams)
    covered = {j for i, g in enumerate(grams) if times[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def test_base_rules_match_brute_force(spark):
    texts = [None, "", " \n\t", "a b c d e " * 3, "x " * 9, "one two three four five six seven eight nine ten", "é中🙂 #*$%&|<>\n\nsame\nsame\n same\n", "a\x0bb\x0cc\rd\u00a0e f g h i j k l",
             "w1 w2 w3 w4 w5 w6 w7 x w3 w4 w5 w6 w7 y w1 w2 w3 w4 w5 end " + " ".join(f"z{i}" for i in range(70)), "long " * 40_000]
    rows = [(i % 7 if i else None, t, "q", 3) for i, t in enumerate(texts)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, quality string, __n int")).collect()
    assert len(got) == len(rows)
    for (key, text, *_), r in zip(rows, got):
        q = r.quality_
        assert (r.doc_id, q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == (key, *base(text))
        assert not (q.base_failed and q.kept)


def test_prose_passes_and_junk_fails(spark):
    prose = "The house of the old man and the sea is in a small town, to the north of here. " \
            "It was that kind of place where people go for a walk, and talk about what they did in summer. "  # fmt: skip
    prose += "A boat lay by the wall; nobody had used it since the storm took the sail and most of the ropes."
    junk = " ".join(w + "%%%" for w in prose.upper().split())
    df = spark.createDataFrame([(1, prose), (2, junk), (3, prose[:60])], "doc_id long, text string")
    assert [r.quality.kept for r in quality.judge(df).collect()] == [True, False, True]
    assert quality.judge(df.limit(0)).count() == 0


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/")]


def test_url_verdicts(spark):
    pages = [
        (1, "http://A.Example.COM/en/712?q", "a.example.com", "/en/712", "example.com/en/7", "allow"),
        (2, "https://www.badexample.com/en/7#x", "www.badexample.com", "/en/7", "com/en/", "block"),
        (3, "https://net/de/1", "net", "/de/1", "net/de/", "allow"),
        (4, "https://www.spam.org/x/?utm=1", "www.spam.org", "/x/", None, "block"),
        (5, "https://spam.org/y", "spam.org", "/y", None, "allow"),
        (6, None, "", "", None, "allow"),
        (7, "no url", "", "", None, "allow"),
        (8, "x://", "", "", None, "allow"),
        (None, "a://b://c/d", "b:", "//c/d", None, "allow"),
        (4, "http://spam.org/x", "spam.org", "/x", None, "block"),
        (9, "http://cafe\u0301.org?x", "cafe\u0301.org", "", None, "allow"),
    ]
    df = spark.createDataFrame([(p[0], p[1], "rule") for p in pages], "page_id long, url string, rule string")
    listed = spark.createDataFrame([("http://spam.org/x/",), (None,), ("nothing",), ("http://spam.org/x",)], "u string")
    for most in (500_000, 0):
        urls.MAX_BROADCAST_BLOCKS = most
        got = sorted((tuple(r) for r in urls.judge_urls(df, RULES, listed).collect()), key=str)
        assert got == sorted(((p[0], *p[2:]) for p in pages), key=str)
    urls.MAX_BROADCAST_BLOCKS = 500_000
    assert urls.judge_urls(df.limit(0), RULES, listed).count() == 0
    assert urls.judge_urls(df, RULES, listed.limit(0)).filter("verdict = 'block'").count() == 1


def test_bloom_filter_passes_all_listed_and_few_others(spark):
    from pyspark.sql import functions as F

    keys = spark.range(5000).select(F.concat(F.lit("site"), "id").alias("key"))
    n = -(-5000 * urls.BITS_A_KEY // urls.BLOCK_BITS)
    blocks = urls.bloom_blocks(keys, n)
    probe = spark.range(20_000).select(F.concat(F.lit("site"), "id").alias("key"), (F.col("id") < 5000).alias("listed"))
    probe = probe.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n))).join(blocks, "block", "left")
    inside = [F.col(f"b{i}").bitwiseAND(b) == b for i, b in enumerate(urls._bits(F.col("key")))]
    found = probe.filter(F.coalesce(inside[0] & inside[1] & inside[2] & inside[3], F.lit(False)))
    assert found.filter("listed").count() == 5000 and found.filter("not listed").count() < 600
