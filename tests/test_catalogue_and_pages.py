import datetime
import difflib

from pyspark.sql import functions as F

from hammerline.functions import catalogue as c
from hammerline.operators import identity, listings, pageparts, registry, resolver
from hammerline.plans import identities
from hammerline.sources import landed


def test_nested_blocks_scripts_and_bare_numbers(spark):
    html = "<div>Metal: Silver Weight: 6,5 g</div><p>188</p><p>Weight: 0,01 g Diameter: 2 mm Fineness: 925 Material: argent</p><script>Weight: 1 g Fineness: 900</script>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<p>Weight 5 g</p>"), (5, "<p>" + "Weight: 5 g Metal: gold " * 60 + "</p>")], "page_id long, html string")
    got = [tuple(r) for r in pageparts.explicit_specs(pageparts.spec_blocks(pages)).orderBy("pos").select("page_id", *pageparts.FIELDS).collect()]
    assert got == [(1, "Silver", None, 6.5, None), (1, "Silver", 925, None, None)]
    assert pageparts.complete_single_spec(pageparts.explicit_specs(pageparts.spec_blocks(pages))).count() == 0


def test_money_sides_and_separators(spark):
    rows = [("EUR 1.234,50",), ("12.50€",), ("€ 7 or $ 8",), ("CHF 5 EUR 6",), ("5",), (None,), ("",)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "x string").select(*c.money(F.col("x"))).collect()]
    assert got == [(1234.5, "EUR"), (12.5, "EUR"), (7.0, "EUR"), (5.0, "CHF"), (None, None), (None, None), (None, None)]


def test_shipping_without_a_rate_is_unknown(spark):
    offers = spark.createDataFrame([(1, "EUR", 5.0, "GBP", "known"), (2, "EUR", 5.0, "EUR", "known"), (3, "EUR", None, None, "unknown")], "id int, currency string, shipping double, shipping_currency string, shipping_status string")
    rates = spark.createDataFrame([("EUR", 1.0), ("USD", 1.25)], "currency string, per_eur double")
    got = {r.id: (r.shipping, r.shipping_status) for r in pageparts.bridged(offers, rates).collect()}
    assert got == {1: (None, "unknown"), 2: (5.0, "known"), 3: (None, "unknown")}


def test_one_broken_feed_costs_no_others(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rss><channel><item><title>A</title><link>u</link><pubDate>Tue, 02 Jan 2024 03:04:05 +0100</pubDate></item><item><title></title><link>v</link></item></channel></rss>")
    (tmp_path / "b.xml").write_text("<feed><entry><title>B</title><link href='w'/></entry><entry><title>C")
    got = sorted((r.title, r.link, r.at) for r in landed.read_feed_items(spark, f"file://{tmp_path}").withColumn("at", F.col("at").cast("timestamp_ntz")).collect())
    assert got == [("A", "u", datetime.datetime(2024, 1, 2, 2, 4, 5)), ("B", "w", None)]


def test_spec_file_keeps_its_order(spark, tmp_path):
    (tmp_path / "s.json").write_text('{\n "records": [{"denomination": 1, "weight_g": 7.5, "countries": ["A", "B"]},\n {"denomination": 1, "weight_g": 8.5, "countries": ["A"]}]\n}')
    entries = landed.read_spec_json(spark, f"file://{tmp_path}").withColumnRenamed("denomination", "value")
    targets = spark.createDataFrame([(1, "A", 1.0), (2, "B", 1.0), (3, "C", 1.0), (4, None, None)], "id int, country string, value double")
    assert {r.id: r.weight_g for r in registry.first_in_file(targets, entries).collect()} == {1: 7.5, 2: 7.5, 3: None, 4: None}


def test_applying_the_registry_twice_changes_nothing(spark):
    kind = "id int, country string, year int, value double, {} string, weight_g double, diameter_mm double"
    registry_rows = spark.createDataFrame([(9, "A", 2000, 5.0, "steel", 7.0, 26.0), (8, "A", 2000, 5.0, "steel", 7.1, 26.2), (7, "B", None, 1.0, None, 1.0, 1.0)], kind.format("token"))
    targets = spark.createDataFrame([(1, "A", 2000, 5.0, "blue steel", None, None), (2, "A", 2000, 5.0, "gold", 1.0, 2.0), (3, "A", 2000, 5.0, None, 3.0, 4.0), (4, None, None, None, None, 5.0, 6.0)], kind.format("variant"))

    def once(rows):
        found = registry.official_specs(rows, registry_rows)
        return found.withColumn("weight_g", F.coalesce("official_weight", "weight_g")).select(*rows.columns)

    first = once(targets)
    assert {r.id: r.weight_g for r in first.collect()} == {1: 7.1, 2: 1.0, 3: 7.1, 4: 5.0}
    assert sorted(map(str, once(first).collect())) == sorted(map(str, first.collect()))


def test_corrections_are_checked_deleted_and_latest(spark):
    rows = spark.createDataFrame([("1", "k", "x", "why", 1), ("2", "k", "y", "why", 2), ("3", "k", None, " ", 3), ("4", "k", "z", "why", 4)], "id string, key string, corrected string, reason string, at int")
    live, rejects = registry.maintained(rows, rows.filter("id = '4'"), ["corrected", "reason"], "key", ["at"])
    assert [(r.key, r.id) for r in live.collect()] == [("k", "2")]
    assert [(r.id, r.error) for r in rejects.collect()] == [("3", "corrected,reason")]


def test_resolver_on_empty_and_odd_texts(spark):
    kinds = "kind string, alias string, country_code string, currency_code string, valid_from int, valid_to int, special_value double"
    aliases = spark.createDataFrame(identities.ALIASES, kinds)
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "Γερμανία 5"), (4, "5 mark " * 3000)], "id int, text string")
    got = {r.id: (r.status, r.currency) for r in resolver.resolve_identity(texts, aliases, "id", "text").collect()}
    assert got[1] == got[2] == ("unresolved", None) and got[4] == ("resolved", "DEM") and len(got) == 4
    assert resolver.resolve_identity(texts.limit(0), aliases, "id", "text").count() == 0


def test_resolver_takes_each_distinct_text_once_and_in_steps(spark):
    kinds = "kind string, alias string, country_code string, currency_code string, valid_from int, valid_to int, special_value double"
    texts = spark.range(40).selectExpr("id", "element_at(array('5 mark Germany 1970', '5 mark Germny 1970', null), cast(id % 3 + 1 AS int)) AS text")
    found = resolver.resolve_identity(texts, spark.createDataFrame(identities.ALIASES, kinds), "id", "text")
    assert {(r.id, r.currency) for r in found.collect()} == {(k, "DEM" if k % 3 < 2 else None) for k in range(40)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 3


def test_title_score_against_plain_python(spark):
    row = (1, 1, "5 Mark 1970 Austria coin UNC", 5.0, "mark", 1970, "Austria", "MINT")
    rows = spark.createDataFrame([row, (1, 2, " ", *row[3:])], "target_id int, seq int, title string, t_value double, t_unit string, t_year int, t_country string, t_grade string")
    got = {r.seq: r.title_score for r in listings.title_score(rows, identity.similarity).collect()}
    ratio = difflib.SequenceMatcher(None, "5 mark 1970 austria coin unc", "austria 5 mark 1970").ratio()
    assert abs(got[1] - (ratio + 0.18 + 0.22 + 0.2 + 0.08 + 0.1)) < 1e-9 and got[2] == 0.0


def test_json_leaves_decode_escapes(spark):
    from hammerline.functions import catalogue as c

    texts = [r'{"a": "say \"x\"", "b": ["caf\u00e9", "a\\b", 7]}', r'{"a": "bad \q"}', "{}", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.v for r in rows.orderBy("i").select(c.json_leaves(rows.t).alias("v")).collect()]
    assert got == ['say "x" café a\\b 7', "bad \\q", "", None]


def test_jsonld_products_at_any_depth(spark):
    def product(name, price, more=""):
        return f'{{"@type": "Product", "name": "{name}", "offers": [{{"price": "{price}"}}, {{"price": 1}}]{more}}}'

    deep = "[" * 8 + product("deep", "1.234,50") + "]" * 8
    bodies = [
        product("outer", 5, ', "isRelatedTo": {"x": [' + product("inner", "6") + "]}"), deep, '{"broken": ' + product("lost", 1), "[]", "7",
        '{"@type": "Product", "offers": {"price": 3, "priceCurrency": "USD", "availability": "https://schema.org/In Stock"}}',
        '{"@type": "Product", "name": "gone", "offers": {"price": 3, "availability": "Out Of Stock"}}',
        '{"@type": ["Product"], "name": "list", "offers": {"price": 3}}', '{"@type": "Product", "name": "free", "offers": []}', '{"@type": "Offer", "price": 3, "of": "Product"}',
    ]
    html = "".join(f'<script type="application/ld+json">{b}</script>' for b in bodies)
    pages = spark.createDataFrame([(1, html), (2, html.replace("deep", "again")), (3, None), (4, "<p>Product</p>")], "page_id int, html string")
    got = sorted((r.page_id, r.name, r.price, r.currency) for r in listings.jsonld_offers(pages).collect())
    want = [("", 3.0, "USD"), ("deep", 1234.5, "EUR"), ("inner", 6.0, "EUR"), ("outer", 5.0, "EUR")]
    assert got == sorted([(1, *w) for w in want] + [(2, w[0].replace("deep", "again"), *w[1:]) for w in want])
    assert listings.jsonld_offers(pages.limit(0)).count() == 0
