from pyspark.sql import functions as F

from hammerline.functions import assets, catalogue, places
from hammerline.functions import text as t
from hammerline.operators import listings, pageparts


def test_scripts_accents_and_signs_in_normal_forms(spark):
    rows = [("Ελλάδα 2 Ευρώ Россия ÉCU š",), ("€5, ½ Złoty $1",), ("San-Marino Йод",), (None,), ("",)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "x string").select(t.norm(F.col("x")), t.transliterate_greek(F.col("x"))).collect()]
    assert [g[0] for g in got] == ["ελλαδα 2 ευρω россия ecu s", "euro 5 1/2 z oty usd 1", "san marino иод", "", ""]
    assert got[0][1] == "ellada 2 eyro россия ecu s" and got[3][1] is None


def test_assets_by_counts_with_their_confidence(spark):
    cases = {
        "USA 1 Dollar 1923 Silver Certificate": ("BANKNOTE", 0.995), "bank note 5": ("BANKNOTE", 0.92), "bank note, large size note": ("BANKNOTE", 0.94), "5 Pesos p-12a": ("BANKNOTE", 0.89),
        "P12 watermark": ("BANKNOTE", 0.97), "watermark": ("UNKNOWN", 0.45), "coin with watermark": ("COIN", 0.76), "Gedenkmünze": ("COIN", 0.82), "commemorative coin mint proof unc bu": ("COIN", 0.98),
        "5 mark": ("UNKNOWN", 0.45), "": ("UNKNOWN", 0.45), None: ("UNKNOWN", 0.45), "p 5 coin mint proof unc": ("COIN", 0.94), "word " * 50000 + "coin": ("COIN", 0.76),
    }
    got = spark.createDataFrame([(x,) for x in cases], "x string").select("x", assets.classify(F.col("x")).alias("c")).select("x", "c.*").collect()
    assert {r.x: (r.asset, r.confidence) for r in got} == cases


def test_every_country_is_found_by_each_of_its_names(spark):
    rows = [(k, n) for k, names in places.NAMES.items() for n in names.split("|")]
    got = spark.createDataFrame(rows, "country string, name string").select("country", "name", places.country_of(F.concat(F.lit("5 x "), F.upper("name"), F.lit("!"))).alias("found"), places.country_in(F.col("name"), F.col("name")).alias("own"))
    assert [r for r in got.collect() if r.found != r.country.title() or not r.own] == []
    assert set(places.CODES) <= set(places.NAMES)


def test_scores_count_only_fields_that_a_search_states(spark):
    kinds = "title string, t_country string, t_year int, t_value double, t_unit string, t_issuer string, t_mintmark string, t_variant string"
    rows = [
        ("Greece 5 Drachmai 1976 proof", "Greece", 1976, 5.0, "drachma", None, None, None), ("Ελλάδα 5 Drachmai 1976", "Greece", 1976, 5.0, "drachma", "Hellenic Republic", "A", "proof"), ("Greece 5 1976 replica", "Greece", 1976, 5.0, None, None, None, None),
        ("France 0.25 franc 19761", "France", 1976, 0.25, "franc", None, None, None), (None, "Greece", 1976, None, None, None, None, None), ("anything", None, None, None, None, None, None, None),
    ]
    got = [r.listing_score for r in listings.match_points(spark.createDataFrame(rows, kinds)).collect()]
    assert got == [100, round(100 * 94 / 109), 20, round(100 * 66 / 94) - 20, 0, 0]
    few = spark.createDataFrame(rows, kinds).drop("t_issuer", "t_mintmark", "t_variant")
    assert [r.listing_score for r in listings.match_points(few).collect()][1] == 100


def test_references_and_variants(spark):
    rows = [("KM#A12 and Y 3",), ("SKM 5 RIC 7b Pick# 9",), ("P 1964 Unc. double strike",), (None,)]
    got = spark.createDataFrame(rows, "x string").select(*[v.alias(n) for n, v in catalogue.catalog_references(F.col("x")).items()], catalogue.variants_of(F.col("x")).alias("v")).collect()
    assert [tuple(r) for r in got] == [("A12", "3", None, None, []), (None, None, "9", "7b", []), (None, None, None, None, ["error"]), (None, None, None, None, [])]


def test_a_material_ends_at_the_next_label_or_is_too_long(spark):
    rows = [("Material: silver 0.925 Weight: 5 g",), ("Weight 5 g Metal - gold",), ("Metal: " + "x" * 101,), ("Metal: silver " + "y" * 60 + " Ø 20 mm " + "z" * 90,), ("none",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "b string").select(pageparts.material(F.col("b"))).collect()]
    assert got[:3] == ["silver 0.925", "gold", ""] and got[3] == "silver " + "y" * 60 and got[4:] == ["", None] or got[4:] == ["", ""]
