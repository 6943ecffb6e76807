import difflib
import random

from pyspark.sql import functions as F

from hammerline.operators import identity, listings


def test_similarity_and_blocks(spark):
    aliases = spark.createDataFrame([("germany", "DE"), ("gernany", "X"), ("france", "FR")], "alias string, target string")
    words = spark.createDataFrame([("germny",), ("francs",), ("zzzzzz",), ("ger",), (None,)], "word string")
    got = {r.word: r.target for r in identity.similar_alias(words, aliases, "word").collect()}
    assert got == {"germny": "DE", "francs": "FR"}
    row = spark.createDataFrame([("abcd", "bcde"), (None, "x")], "a string, b string").select(identity.similarity("a", "b").alias("s")).collect()
    assert [r.s for r in row] == [0.75, None]


def test_similar_aliases_are_those_of_all_pairs(spark):
    rng = random.Random(11)
    spell = lambda: "".join(rng.choice("abcdeors ") for _ in range(rng.randint(3, 11)))
    names = sorted({" ".join(spell().split()) for _ in range(60)} | {"croatia", "new zealand", "aaaaaa", "ab12.5/x"})
    words = {" ".join(spell().split()) for _ in range(300)} | {"kroatia", "new zeland", "aaaaa", "", "a" * 500, "ab12.5/y"}
    for name in names:
        k = rng.randrange(len(name) + 1)
        words |= {name[:k] + name[k + 1 :], name[:k] + "z" + name[k:], rng.choice("abcz") + name[1:], name + name[:2]}
    for least in (0.8, 0.82):
        ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
        expected = {}
        for w in words:
            near = [(ratio(w, a), a) for a in names if len(a) >= 5 and ratio(w, a) >= least]
            if near:
                expected[w] = max(near)
        df = identity.similar_alias(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(a, "t") for a in names], "alias string, target string"), "word", least)
        assert {r.word: (r.ratio, r.alias) for r in df.collect()} == expected
        assert len(expected) > 60 and expected["kroatia"][1] == "croatia" and expected["new zeland"][1] == "new zealand"
    none = spark.createDataFrame([], "alias string, target string")
    assert identity.similar_alias(spark.createDataFrame([("x",)], "word string"), none, "word").count() == 0


def test_exact_alias_takes_whole_words(spark):
    aliases = spark.createDataFrame([("new york", "NY"), ("york", "Y")], "alias string, target string")
    texts = spark.createDataFrame([(1, "In New-York, new york"), (2, "Yorkshire"), (3, None)], "id int, text string")
    assert sorted((r.id, r.target) for r in identity.exact_alias(texts, aliases, "id", "text").collect()) == [(1, "NY"), (1, "Y")]


def test_gap_makes_candidates_ambiguous(spark):
    rows = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.85), ("b", 1, 0.9), ("b", 2, 0.5), ("c", 1, 0.4)], "k string, seq int, confidence double")
    assert {r.k: r.ambiguous for r in identity.candidates(rows, ["k"]).collect()} == {"a": True, "b": False, "c": False}


def test_pages_with_products_and_cards(spark):
    page = """<script type="application/ld+json">{"@graph":[{"@type":"Product","name":"A","offers":[{"price":"3.5","priceCurrency":"EUR"}]},
    {"@type":"Product","name":"B","offers":{"price":"x","availability":"https://schema.org/SoldOut"}},{"@type":"Other"}]}</script><table>
    <tr><td><a href="item.php?id=7"><img></a><a href="item.php?id=7"><b>Long title</b></a> 12,50 EUR<tr><a href="item.php?id=8">C</a> 5 EUR sold<tr><a href="item.php?id=9">D</a> 300000 EUR</table>"""
    df = spark.createDataFrame([(1, page), (2, ""), (3, None)], "page_id int, html string")
    assert [tuple(r)[:4] for r in listings.jsonld_offers(df).collect()] == [(1, "A", 3.5, "EUR")]
    assert [tuple(r) for r in listings.listing_cards(df).collect()] == [(1, "7", "Long title", 12.5)]


def test_reasons_against_listings(spark):
    rows = [("2 Euro 1999 Austria UNC",), ("  ",), ("1 Euro 1998 France VF replica set",), (None,), ("a coin",)]
    df = spark.createDataFrame(rows, "title string").select("title", F.lit(2.0).alias("t_value"), F.lit("euro").alias("t_unit"), F.lit(1999).alias("t_year"), F.lit("Austria").alias("t_country"), F.lit("MINT").alias("t_grade"))
    got = [r.reasons for r in listings.hard_filter(df).collect()]
    assert got == [[], ["EMPTY_TEXT"], ["NOT_SINGLE_COIN", "DENOMINATION_MISMATCH", "YEAR_MISMATCH", "COUNTRY_MISMATCH", "GRADE_MISMATCH", "NEGATIVE_PRODUCT_FLAG"], ["EMPTY_TEXT"], []]


def test_issuers_of_a_country_and_of_their_years(spark):
    kings = [("Otto", 0, "otto", "GR", 1832, 1862), ("George", 1, "george i", "GR", 1863, 1913), ("George", 1, "king george i", "GR", 1863, 1913), ("George V", 2, "king george", "GB", 1910, 1936), ("Republic", 3, "hellenic republic", "GR", 1974, None), ("None", 4, "", None, None, None)]
    issuers = spark.createDataFrame(kings, "issuer string, place int, alias string, country_code string, valid_from int, valid_to int")
    rows = [
        (1, "5 drachmai King George I", "GR", 1913), (2, "5 drachmai King George I", "GR", 1914), (3, "King George I", None, 1911), (4, "King George I", "GB", 1911), (5, "OTTO 1 lepton", None, None),
        (6, "Helenic Republc", "GR", 2000), (7, "Helenic Republc", "GR", 1973), (8, None, "GR", 1900), (9, "", None, None), (10, "ottoman", None, None), (11, "King George", "GR", 1900),
    ]
    texts = spark.createDataFrame(rows, "id int, text string, country_code string, year int")
    got = {r.id: (r.issuer, r.alias, round(r.score, 3)) for r in identity.issuers_of(texts, issuers, "id", "text").collect()}
    near = difflib.SequenceMatcher(None, "helenic republc", "hellenic republic").ratio()
    assert got == {
        1: ("George", "king george i", 1.0), 3: ("George", "king george i", 1.0), 4: ("George V", "king george", 1.0), 5: ("Otto", "otto", 1.0), 6: ("Republic", "hellenic republic", round(near, 3)),
        10: ("Otto", "otto", round(8 / 11, 3)), 11: ("George", "king george i", round(22 / 24, 3)),
    }
    assert identity.issuers_of(texts, issuers.filter("false"), "id", "text").count() == 0
    assert {r.id for r in identity.issuers_of(texts.drop("year", "country_code"), issuers, "id", "text").collect()} == {1, 2, 3, 4, 5, 6, 7, 10, 11}
