"""Queries over item pages that Spark derives from the part table; their twins follow from the same rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hammerline.operators import pageparts as op
from hammerline.plans.catalogue import K, pick, sql_pick
from hammerline.plans.market import r4
from hammerline.sources import derived as d

QUERIES, ORACLES = {}, {}


def add(name, build, sql):
    QUERIES[name] = build
    ORACLES[name] = sql


def item_pages(s: SparkSession, f: str) -> DataFrame:
    """An item page a part: title, breadcrumb, a table of specifications whose fields come and go, a price cell."""
    k, part = F.col(K), d.table(s, f, "part")
    weight = F.concat(F.lit("Gewicht: "), (k % 40 + 1).cast("string"), F.lit(",5 g"))
    table = F.concat_ws(
        " ", F.concat(F.lit("Material: "), pick(["Silber", "Gold 0.917", "cuivre", "wood"])), F.when(k % 3 != 0, weight), F.when(k % 5 != 0, F.concat(F.lit("Feinheit: "), (k % 900 + 90).cast("string"))),
        F.when(k % 2 == 0, F.concat(F.lit("Durchmesser: "), (k % 300).cast("string"), F.lit(" mm"))), F.when(k % 6 == 5, F.concat(F.lit("Ø "), (k % 30 + 10).cast("string"), F.lit(" mm"))),
    )
    cell = F.concat(F.when(k % 4 == 0, F.concat(F.lit("<del>"), (k % 100 + 150).cast("string"), F.lit(",00 EUR</del>"))).otherwise(""), F.lit("<b>"), (k % 200 + 1).cast("string"), F.lit(",00 EUR</b>"))
    html = F.concat(
        F.lit("<html><head><title>"), F.col("p_name"), pick([" coin", " banknote", ""]), F.lit('</title><script>Gewicht: 9 g Feinheit: 111</script></head><nav class="breadcrumb">Coins + Banknotes</nav><table><tr><td>'),
        table, F.lit("</td></tr></table><p>188 EUR</p><div>"), cell, F.lit("</div></html>"),
    )
    return part.select(k.alias("page_id"), html.alias("html"), (k % 200 + 1.0).alias("price"), F.col("p_name").alias("wanted"))


SAID = f"""said AS (SELECT {K} AS page_id, {sql_pick(['Silver', 'Gold', 'Copper', None])} AS primary_metal,
    CASE WHEN {K} % 5 <> 0 AND {K} % 900 + 90 >= 100 THEN {K} % 900 + 90 WHEN {K} % 4 = 1 THEN 917 END AS fineness_per_mille,
    CASE WHEN {K} % 3 <> 0 THEN {K} % 40 + 1.5 END::DOUBLE AS weight_g,
    CASE WHEN {K} % 2 = 0 THEN CASE WHEN {K} % 300 BETWEEN 3 AND 200 THEN {K} % 300 END WHEN {K} % 6 = 5 THEN {K} % 30 + 10 END::DOUBLE AS diameter_mm,
    {K} % 3 <> 0 OR {K} % 5 <> 0 OR {K} % 2 = 0 OR {K} % 6 = 5 AS block FROM part),
stated AS (SELECT *, (primary_metal IS NOT NULL)::INT + (fineness_per_mille IS NOT NULL)::INT + (weight_g IS NOT NULL)::INT + (diameter_mm IS NOT NULL)::INT AS n_fields FROM said WHERE block)"""
add("spec_blocks", lambda s, f: r4(op.explicit_specs(op.spec_blocks(item_pages(s, f))).select("page_id", *op.FIELDS, "n_fields")), f"WITH {SAID} SELECT page_id, primary_metal, CAST(fineness_per_mille AS INTEGER) AS fineness_per_mille, weight_g, diameter_mm, n_fields FROM stated WHERE n_fields >= 2")
add(
    "complete_single_spec",
    lambda s, f: r4(op.complete_single_spec(op.explicit_specs(op.spec_blocks(item_pages(s, f))))),
    f"WITH {SAID} SELECT page_id, primary_metal, CAST(fineness_per_mille AS INTEGER) AS fineness_per_mille, weight_g, diameter_mm, round(weight_g * fineness_per_mille / 1000 + 1e-7, 4) AS fine_metal_g FROM stated WHERE primary_metal IS NOT NULL AND fineness_per_mille IS NOT NULL AND weight_g IS NOT NULL",
)
add(
    "discount_detect",
    lambda s, f: r4(item_pages(s, f).select("page_id", *[x.alias(n) for n, x in op.discount(F.col("html"), F.col("price")).items()])),
    f"""WITH o AS (SELECT {K} AS page_id, CASE WHEN {K} % 4 = 0 AND {K} % 100 + 150 > {K} % 200 + 1 THEN CAST({K} % 100 + 150 AS DOUBLE) END AS old, CAST({K} % 200 + 1 AS DOUBLE) AS price FROM part)
    SELECT page_id, old AS original_price, round_even((old - price) / old * 100, 1) AS discount_pct FROM o""",
)
add(
    "page_asset_class",
    lambda s, f: item_pages(s, f).select("page_id", op.page_asset_class(F.col("html")).alias("asset")),
    f"SELECT {K} AS page_id, {sql_pick(['COIN', 'BANKNOTE', 'UNKNOWN'])} AS asset FROM part",
)


def _offers(s: SparkSession, f: str) -> DataFrame:
    k = F.col(K)
    return d.table(s, f, "part").select(k.alias("offer_id"), F.when(k % 8 != 0, k).alias("page_id"), (k % 2 == 0).alias("ambiguous"), F.when(k % 5 == 0, "gilded thing").otherwise(F.col("p_name")).alias("wanted"))


add(
    "detail_page_validation",
    lambda s, f: op.validated(_offers(s, f), item_pages(s, f)),
    f"""WITH o AS (SELECT {K} AS offer_id, CASE WHEN {K} % 8 <> 0 THEN {K} END AS page_id, {K} % 2 = 0 AS ambiguous, CASE WHEN {K} % 8 <> 0 THEN {sql_pick(['COIN', 'BANKNOTE', 'UNKNOWN'])} END AS asset FROM part)
    SELECT * FROM o WHERE NOT ambiguous OR coalesce(asset <> 'BANKNOTE' AND offer_id % 5 <> 0, false)""",
)
#: Texts of result rows; in each the title stands first (fixed values).
ROWS = [
    "5 EUR coin 30,00 EUR + 7,50 EUR shipping", "5 EUR coin Price: 12,50 EUR free shipping", "5 EUR coin shipping: US$ 5.00 price $20.00", "5 EUR coin 40 EUR shipping 10 USD", "5 EUR coin no amount", "5 EUR coin 11,00 EUR 3 EUR shipping (to Greece)",
]


def _read(s: SparkSession, f: str) -> DataFrame:
    rows = d.table(s, f, "part").select(K, pick(ROWS).alias("text"))
    found = rows.select(K, *[x.alias(n) for n, x in op.price_and_shipping(F.col("text"), F.lit("5 EUR coin")).items()])
    rates = s.createDataFrame([("EUR", 1.0), ("USD", 1.25)], "currency string, per_eur double")
    return r4(op.bridged(found, rates))


add(
    "price_and_shipping",
    _read,
    f"SELECT {K}, {sql_pick([30, 12.5, 20, 40, None, 11], 'DOUBLE')} AS price, {sql_pick(['EUR', 'EUR', 'USD', 'EUR', None, 'EUR'])} AS currency, "
    f"{sql_pick([7.5, 0, 5, 8, None, 3], 'DOUBLE')} AS shipping, {sql_pick(['known', 'free', 'known', 'known', 'unknown', 'known'])} AS shipping_status FROM part",
)
#: Texts of item pages about shipping (fixed values).
NOTES = ["5,00 EUR shipping to Greece", "shipping: 6,00 EUR to Germany", "Versand 7,00 EUR", "portofrei nach Griechenland", "call us", "9 EUR shipping to Germany or 4 EUR shipping to Greece"]
add(
    "shipping_from_page",
    lambda s, f: r4(d.table(s, f, "part").select(K, *[x.alias(n) for n, x in op.shipping_from_page(pick(NOTES), F.lit("greece|griechenland"), ["germany", "france"]).items()])),
    f"SELECT {K}, {sql_pick([5, 6, 7, 0, None, 4], 'DOUBLE')} AS cost, {sql_pick(['known_target', 'known_other_destination', 'known_unconfirmed_destination', 'known_target', 'unknown', 'known_target'])} AS level FROM part",
)


def result_pages(s: SparkSession, f: str) -> DataFrame:
    """A page of the second layout a part: three items, of which one repeats another."""
    k = F.col(K)
    card = lambda n, price, ship: F.concat(F.lit('<li class="s-item"><a href="http://m/itm/'), n.cast("string"), F.lit('?hash=1"><h3 class="s-item__title">'), F.col("p_name"), F.lit('</h3></a><span class="s-item__price">'), price, F.lit("</span>"), ship, F.lit("</li>"))
    range_, one = F.concat(F.lit("EUR "), (k % 90 + 1).cast("string"), F.lit(",50 to EUR 99,00")), F.concat((k % 90 + 2).cast("string"), F.lit(" €"))
    said = F.when(k % 2 == 0, '<span class="s-item__shipping">+EUR 3,00 shipping</span>').otherwise("")
    return d.table(s, f, "part").select(k.alias("page_id"), F.concat(F.lit("<ul>"), card(k, range_, said), card(k, one, said), card(k + 1000000, one, F.lit("")), F.lit("</ul>")).alias("html"))


add(
    "marketplace_cards",
    lambda s, f: r4(op.marketplace_cards(result_pages(s, f))),
    f"""SELECT {K} AS page_id, 'http://m/itm/' || {K} AS url, p_name AS title, CAST({K} % 90 + 1.5 AS DOUBLE) AS price, CASE WHEN {K} % 2 = 0 THEN 3.0 ELSE 0.0 END::DOUBLE AS shipping FROM part
    UNION ALL SELECT {K}, 'http://m/itm/' || {K} + 1000000, p_name, CAST({K} % 90 + 2 AS DOUBLE), 0.0::DOUBLE FROM part""",
)
