"""Queries over offers, rates, tariffs, specifications and keyed merges, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hammerline.operators import joins, specs
from hammerline.plans.market import r4
from hammerline.sources import derived as d

QUERIES, ORACLES = {}, {}


def add(name, build, sql):
    QUERIES[name] = build
    ORACLES[name] = sql.replace(", 4)", " + 1e-7, 4)")


# --- rates ---------------------------------------------------------------------------------------------


def _rated(s: SparkSession, f: str) -> DataFrame:
    sales = d.comparables(s, f).select("target_id", "seq", "hammer_price", F.col("currency").alias("from_ccy"), "auction_date")
    return joins.asof_rates(sales, d.fx_rates(s))


RATED = f"""{d.COMPARABLES_SQL}, {d.FX_RATES_SQL},
rated AS (SELECT c.target_id, c.seq, hammer_price, currency AS from_ccy, auction_date, rate, rate_date, rate_date = auction_date AS is_exact
  FROM comparables c ASOF LEFT JOIN fx_rates r ON c.currency = r.from_ccy AND c.auction_date >= r.rate_date)"""
add("fx_asof_join", lambda s, f: r4(_rated(s, f).select("target_id", "seq", "from_ccy", "rate", "rate_date", "is_exact")), f"WITH {RATED} SELECT target_id, seq, from_ccy, round(rate, 4) AS rate, rate_date, is_exact FROM rated")
add(
    "convert_amount",
    lambda s, f: r4(_rated(s, f).select("target_id", "seq", F.when(F.col("from_ccy") == "EUR", F.col("hammer_price")).otherwise(F.col("hammer_price") * F.col("rate")).alias("eur"))),
    f"WITH {RATED} SELECT target_id, seq, round(CASE WHEN from_ccy = 'EUR' THEN hammer_price ELSE hammer_price * rate END, 4) AS eur FROM rated",
)
add(
    "normalize_comparable",
    lambda s, f: r4(_rated(s, f).select("target_id", "seq", F.when((F.col("from_ccy") == "EUR") | F.col("rate").isNotNull(), "EUR").otherwise(F.col("from_ccy")).alias("currency"), F.when(F.col("from_ccy") == "EUR", F.col("hammer_price")).otherwise(F.col("hammer_price") * F.coalesce("rate", F.lit(1.0))).alias("price"), F.when(F.col("from_ccy") != "EUR", F.col("rate")).alias("rate"), F.when(F.col("from_ccy") != "EUR", F.col("is_exact")).alias("is_exact"))),
    f"WITH {RATED} SELECT target_id, seq, CASE WHEN from_ccy = 'EUR' OR rate IS NOT NULL THEN 'EUR' ELSE from_ccy END AS currency, round(hammer_price * CASE WHEN from_ccy = 'EUR' THEN 1 ELSE coalesce(rate, 1) END, 4) AS price, CASE WHEN from_ccy <> 'EUR' THEN round(rate, 4) END AS rate, CASE WHEN from_ccy <> 'EUR' THEN is_exact END AS is_exact FROM rated",
)

# --- offers --------------------------------------------------------------------------------------------


def offers(s: SparkSession, f: str) -> DataFrame:
    rows = d.dealer_prices(s, f).filter("price > 0 AND price <= 200000")
    return rows.withColumn("total", F.col("price") + F.col("shipping"))


OFFERS = f"{d.DEALER_PRICES_SQL}, offers AS (SELECT *, price + shipping AS total FROM dealer_prices WHERE price > 0 AND price <= 200000)"


def _best_by_url(s, f):
    order = Window.partitionBy("target_id", "url").orderBy(F.desc("score"), "seq")
    return offers(s, f).withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")


DEDUPED = f"{OFFERS}, deduped AS (SELECT * FROM offers QUALIFY row_number() OVER (PARTITION BY target_id, url ORDER BY score DESC, seq) = 1)"


def _top(df: DataFrame, n: int, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("target_id").orderBy(*order))).filter(F.col("rank") <= n)


add("price_range_guard", lambda s, f: r4(offers(s, f).groupBy("target_id").agg(F.count("*").alias("n"), F.max("price").alias("highest"))), f"WITH {OFFERS} SELECT target_id, count(*) AS n, round(max(price), 4) AS highest FROM offers GROUP BY ALL")
add("numeric_price_filter", lambda s, f: d.dealer_prices(s, f).filter("price IS NOT NULL").groupBy("dealer_id").agg(F.count("*").alias("n")), f"WITH {d.DEALER_PRICES_SQL} SELECT dealer_id, count(*) AS n FROM dealer_prices WHERE price IS NOT NULL GROUP BY ALL")
add("dedupe_best_score", lambda s, f: r4(_best_by_url(s, f).select("target_id", "url", "seq", "score", "price")), f"WITH {DEDUPED} SELECT target_id, url, seq, round(score, 4) AS score, round(price, 4) AS price FROM deduped")
add(
    "rank_offers",
    lambda s, f: r4(_top(_best_by_url(s, f), 2, F.coalesce("total", "price"), "price", F.col("total").isNull(), F.desc("score"), "seq").select("target_id", "rank", "seq", "price", "total")),
    f"WITH {DEDUPED}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY target_id ORDER BY coalesce(total, price), price, total IS NULL, score DESC, seq) AS INTEGER) AS rank FROM deduped) SELECT target_id, rank, seq, round(price, 4) AS price, round(total, 4) AS total FROM r WHERE rank <= 2",
)
add(
    "market_sample",
    lambda s, f: r4(_top(_best_by_url(s, f).filter("total IS NOT NULL"), 15, F.desc("score"), "seq").select("target_id", "rank", "seq", "total")),
    f"WITH {DEDUPED}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY target_id ORDER BY score DESC, seq) AS INTEGER) AS rank FROM deduped WHERE total IS NOT NULL) SELECT target_id, rank, seq, round(total, 4) AS total FROM r WHERE rank <= 15",
)
add(
    "cheapest_validation_window",
    lambda s, f: _top(d.dealer_prices(s, f), 4, F.col("price").asc_nulls_last(), F.desc("score"), "seq").select("target_id", "rank", "seq"),
    f"WITH {d.DEALER_PRICES_SQL}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY target_id ORDER BY price ASC NULLS LAST, score DESC, seq) AS INTEGER) AS rank FROM dealer_prices) SELECT target_id, rank, seq FROM r WHERE rank <= 4",
)
add(
    "search_diagnostics",
    lambda s, f: d.dealer_prices(s, f).groupBy("target_id").agg(F.count("*").alias("raw"), F.countDistinct("url").alias("unique_urls"), F.count_if(F.col("price") > 0).alias("valid"), F.count_if(F.col("price").isNull()).alias("rejected"), F.count_if(F.col("shipping").isNotNull()).alias("known_total")),
    f"WITH {d.DEALER_PRICES_SQL} SELECT target_id, count(*) AS raw, count(DISTINCT url) AS unique_urls, count(*) FILTER (price > 0) AS valid, count(*) FILTER (price IS NULL) AS rejected, count(shipping) AS known_total FROM dealer_prices GROUP BY ALL",
)
add(
    "union_offer_sources",
    lambda s, f: (lambda o: o.filter("dealer_id % 2 = 0").select("target_id", "url").union(o.filter("score > 0.5").select("target_id", "url")).distinct().groupBy("target_id").agg(F.count("*").alias("n")))(offers(s, f)),
    f"WITH {OFFERS} SELECT target_id, count(*) AS n FROM (SELECT target_id, url FROM offers WHERE dealer_id % 2 = 0 UNION SELECT target_id, url FROM offers WHERE score > 0.5) GROUP BY ALL",
)
add("public_projection", lambda s, f: r4(offers(s, f).drop("score", "dealer_id", "title")), f"WITH {OFFERS} SELECT target_id, seq, url, round(price, 4) AS price, round(shipping, 4) AS shipping, round(total, 4) AS total FROM offers")
add(
    "target_currency_prices",
    lambda s, f: r4(offers(s, f).select("target_id", "seq", (F.col("price") / 1.08).alias("eur_price"), (F.col("total") / 1.08).alias("eur_total"))),
    f"WITH {OFFERS} SELECT target_id, seq, round(price / 1.08, 4) AS eur_price, round(total / 1.08, 4) AS eur_total FROM offers",
)
add(
    "dedupe_comparables",
    lambda s, f: joins.latest_wins(d.comparables(s, f).withColumn("key", F.lower(F.concat_ws("|", "auction_house", F.col("auction_date").cast("string"), "lot_number"))), ["key"], ["target_id", "seq"]).select("key", "target_id", "seq"),
    f"WITH {d.COMPARABLES_SQL} SELECT lower(concat_ws('|', auction_house, CAST(auction_date AS VARCHAR), lot_number)) AS key, target_id, seq FROM comparables QUALIFY row_number() OVER (PARTITION BY key ORDER BY target_id DESC, seq DESC) = 1",
)


# --- tariffs -------------------------------------------------------------------------------------------


def tariffs(s: SparkSession) -> DataFrame:
    """Bands by dealer group: closed formulas of the band's number."""
    n = F.col("id")
    place = F.element_at(F.array(*map(F.lit, ("FRANCE", "European Union", "Europe", "World"))), (n % 4 + 1).cast("int"))
    return s.range(60).select(
        n.alias("tariff_id"), (n % 5).alias("dealer_group"), place.alias("destination"),
        F.when(n % 3 != 0, (n % 7 * 100).cast("double")).alias("price_min"), F.when(n % 4 != 3, (n % 7 * 100 + 900).cast("double")).alias("price_max"),
        F.when(n % 4 == 0, (n % 6 * 10 - 5).cast("double")).when(n % 8 == 3, 20.0).alias("weight_min"), F.when(n % 2 == 0, (n % 6 * 10 + 5).cast("double")).alias("weight_max"),
        (n % 11 + 2.5).alias("cost"), (n % 13 == 0).alias("free"),
    )


TARIFFS = """tariffs AS (SELECT n AS tariff_id, n % 5 AS dealer_group, list_extract(['FRANCE', 'European Union', 'Europe', 'World'], CAST(n % 4 + 1 AS INTEGER)) AS destination,
    CASE WHEN n % 3 <> 0 THEN (n % 7 * 100)::DOUBLE END AS price_min, CASE WHEN n % 4 <> 3 THEN (n % 7 * 100 + 900)::DOUBLE END AS price_max,
    CASE WHEN n % 4 = 0 THEN (n % 6 * 10 - 5)::DOUBLE WHEN n % 8 = 3 THEN 20.0::DOUBLE END AS weight_min, CASE WHEN n % 2 = 0 THEN (n % 6 * 10 + 5)::DOUBLE END AS weight_max, n % 11 + 2.5::DOUBLE AS cost, n % 13 = 0 AS free FROM range(60) t(n))"""
EU, EUROPE = ("FRANCE", "GERMANY", "ROMANIA"), ("FRANCE", "GERMANY", "ROMANIA", "UNITED KINGDOM", "RUSSIA")


def _shipped(s: SparkSession, f: str) -> DataFrame:
    nation = d.table(s, f, "nation").select(F.col("n_nationkey"), F.upper("n_name").alias("destination"))
    rows = offers(s, f).withColumn("n_nationkey", (F.col("seq") % 25).cast("int")).join(F.broadcast(nation), "n_nationkey")
    rows = rows.select(F.concat_ws("-", F.col("target_id").cast("string"), F.col("seq").cast("string")).alias("offer_id"), (F.col("dealer_id") % 5).alias("dealer_group"), "destination", "price",
                       F.when(F.col("seq") % 3 != 0, F.col("target_id") % 60).cast("double").alias("weight"))
    return rows.withColumn("is_eu", F.col("destination").isin(*EU)).withColumn("is_europe", F.col("destination").isin(*EUROPE))


SHIPPED = f"""{OFFERS}, {TARIFFS}, shipped AS (SELECT target_id, seq, dealer_id % 5 AS dealer_group, upper(n_name) AS destination, price,
    CASE WHEN seq % 3 <> 0 THEN (target_id % 60)::DOUBLE END AS weight FROM offers JOIN nation ON n_nationkey = seq % 25),
placed AS (SELECT s.target_id, s.seq, t.tariff_id, CASE WHEN t.free THEN 0 ELSE t.cost END AS cost, coalesce(price_max, 'inf'::DOUBLE) - coalesce(price_min, 0) AS span, coalesce(weight_max - weight_min, 'inf'::DOUBLE) AS wm,
    CASE WHEN t.destination = s.destination THEN 0 WHEN t.destination = 'European Union' AND s.destination IN {EU} THEN 1 WHEN t.destination = 'Europe' AND s.destination IN {EUROPE} THEN 2 WHEN t.destination = 'World' THEN 3 END AS place
  FROM shipped s JOIN tariffs t USING (dealer_group) WHERE price >= coalesce(price_min, 0) AND price <= coalesce(price_max, 'inf'::DOUBLE) AND (weight_max IS NULL OR weight <= weight_max) AND (weight_min IS NULL OR weight >= weight_min)),
best AS (SELECT target_id, seq, b.c AS cost, b.t AS tariff_id FROM (SELECT target_id, seq, arg_min({{'c': cost, 't': tariff_id}}, (place, span, wm, tariff_id)) AS b FROM placed WHERE place IS NOT NULL GROUP BY ALL))"""
add("shipping_tier_join", lambda s, f: r4(joins.best_tariff(_shipped(s, f), tariffs(s)).select("offer_id", "cost", "tariff_id")), f"WITH {SHIPPED} SELECT target_id || '-' || seq AS offer_id, round(cost, 4) AS cost, tariff_id FROM shipped LEFT JOIN best USING (target_id, seq)")
add("destination_priority", lambda s, f: joins.best_tariff(_shipped(s, f), tariffs(s)).groupBy("destination").agg(F.count("*").alias("n"), F.count("cost").alias("priced"), F.count_if(F.col("cost") == 0).alias("free")),
    f"WITH {SHIPPED} SELECT destination, count(*) AS n, count(cost) AS priced, count(*) FILTER (cost = 0) AS free FROM shipped LEFT JOIN best USING (target_id, seq) GROUP BY ALL")

# --- specifications ------------------------------------------------------------------------------------


def _spec_targets(s: SparkSession, f: str) -> DataFrame:
    c = d.table(s, f, "customer")
    k = F.col("c_custkey")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    return c.select(k.alias("target_id"), pick(("AUSTRIA", "greece", "Croatia", "France", "Latvia"), k).alias("country"), pick((0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0), k).alias("denomination"), (1990 + k % 40).alias("year"))


SPEC_TARGETS = """t AS (SELECT c_custkey AS target_id, list_extract(['AUSTRIA', 'greece', 'Croatia', 'France', 'Latvia'], CAST(c_custkey % 5 + 1 AS INTEGER)) AS country,
    list_extract([0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0]::DOUBLE[], CAST(c_custkey % 8 + 1 AS INTEGER)) AS denomination, 1990 + c_custkey % 40 AS year FROM customer)"""
add(
    "spec_lookup_join",
    lambda s, f: r4(joins.best_spec(_spec_targets(s, f), d.specs(s, f)).select("target_id", "spec_id", "weight_g", "diameter_mm", "primary_metal")),
    f"""WITH {d.SPECS_SQL}, {SPEC_TARGETS}, hit AS (SELECT target_id, s.* FROM t JOIN specs s ON lower(t.country) = lower(s.country) AND abs(denomination - denomination_value) < 1e-4 AND year BETWEEN coalesce(year_from, 0) AND coalesce(year_to, 9999)
      QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY verified DESC, confidence DESC, id) = 1)
    SELECT target_id, id AS spec_id, round(weight_g, 4) AS weight_g, round(diameter_mm, 4) AS diameter_mm, primary_metal FROM t LEFT JOIN hit USING (target_id)""",
)
PROFILES = "profiles(v, w, dm) AS (VALUES " + ", ".join(f"({v}::DOUBLE, {w}::DOUBLE, {m}::DOUBLE)" for v, w, m in specs.EURO_PROFILES) + ")"
STARTS = "starts(c, y) AS (VALUES " + ", ".join(f"('{c}', {y})" for c, y in specs.EURO_STARTS.items()) + ")"
AUDIT = f"""{d.SPECS_SQL}, {PROFILES}, {STARTS}, audit0 AS (SELECT s.*, coalesce(issue_year, year_from) AS anchor, y AS start_year, lower(coalesce(primary_metal, '')) AS metal,
    EXISTS (SELECT 1 FROM profiles WHERE abs(denomination_value - v) < 1e-9 AND abs(weight_g - w) <= 0.02 AND abs(diameter_mm - dm) <= 0.03) AS profile FROM specs s LEFT JOIN starts ON lower(c) = lower(trim(country))),
audit1 AS (SELECT *, regexp_matches(metal, 'gold|silver|platinum|palladium') AND metal NOT LIKE '%nordic gold%' AS precious FROM audit0),
audit AS (SELECT *, profile AND precious AS conflict, profile AND coalesce(anchor < start_year, false) AS bad_year,
    list_filter([CASE WHEN weight_g IS NULL THEN 'weight_g' END, CASE WHEN diameter_mm IS NULL THEN 'diameter_mm' END, CASE WHEN primary_metal IS NULL THEN 'primary_metal' END,
      CASE WHEN precious AND fineness_per_mille IS NULL THEN 'fineness_per_mille' END], lambda x: x IS NOT NULL) AS missing FROM audit1)"""
add("euro_profile_conflict", lambda s, f: d.specs(s, f).filter(specs.euro_conflict()).select("id", "country", "primary_metal"), f"WITH {AUDIT} SELECT id, country, primary_metal FROM audit WHERE conflict")
add("euro_year_invalid", lambda s, f: d.specs(s, f).filter(specs.euro_year_invalid()).select("id", "country"), f"WITH {AUDIT} SELECT id, country FROM audit WHERE bad_year")
add("euro_year_audit", lambda s, f: d.specs(s, f).filter(specs.euro_year_invalid()).groupBy("country").agg(F.count("*").alias("n"), F.min("id").alias("example")), f"WITH {AUDIT} SELECT country, count(*) AS n, min(id) AS example FROM audit WHERE bad_year GROUP BY ALL")
add("repair_year_from", lambda s, f: d.specs(s, f).filter(specs.euro_year_invalid()).select("id", F.col("year_from").alias("old_year"), specs.euro_start().alias("new_year")), f"WITH {AUDIT} SELECT id, year_from AS old_year, start_year AS new_year FROM audit WHERE bad_year")
add(
    "incomplete_specs",
    lambda s, f: specs.incomplete(d.specs(s, f)).select("id", F.concat_ws(",", "missing").alias("missing"), "series_mode", "representative_year"),
    f"WITH {AUDIT} SELECT id, array_to_string(missing, ',') AS missing, issue_year IS NULL AS series_mode, anchor AS representative_year FROM audit WHERE NOT conflict AND NOT bad_year AND anchor IS NOT NULL AND len(missing) > 0",
)
add(
    "completeness_audit",
    lambda s, f: specs.completeness(d.specs(s, f)),
    f"WITH {AUDIT} SELECT count(*) AS total, count(issue_year) AS issue_specific, count(*) FILTER (len(missing) = 0) AS complete, count(*) FILTER (len(missing) > 0) AS incomplete, count(*) FILTER (len(missing) = 0 AND NOT precious AND primary_metal IS NOT NULL AND fineness_per_mille IS NULL) AS base_metal_complete, "
    + ", ".join(f"count(*) FILTER (list_contains(missing, '{c}')) AS lacks_{c}" for c in ("weight_g", "diameter_mm", "primary_metal", "fineness_per_mille"))
    + " FROM audit",
)
add(
    "completeness_samples",
    lambda s, f: specs.completeness_samples(d.specs(s, f)).select("code", "n", F.concat_ws(",", F.transform("samples", lambda x: x.id.cast("string"))).alias("ids")),
    f"""WITH {AUDIT}, v AS (SELECT id, unnest(list_prepend(CASE WHEN len(missing) = 0 THEN 'complete' ELSE 'incomplete' END, list_transform(missing, lambda x: 'lacks_' || x))) AS code FROM audit),
    r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY id) AS rn, count(*) OVER (PARTITION BY code) AS n FROM v)
    SELECT code, any_value(n) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM r WHERE rn <= 20 GROUP BY code""",
)
#: Specifications with every 50th fineness per ten thousand and every 70th metal of a euro coin that of a precious one.
_damaged = lambda s, f: d.specs(s, f).withColumns({
    "fineness_per_mille": F.when(F.col("id") % 50 == 3, F.col("id") % 7 * 1000.0).otherwise(F.col("fineness_per_mille")), "primary_metal": F.when(F.col("id") % 7 == 0, "silver").otherwise(F.col("primary_metal")),
})
DAMAGED = AUDIT.replace(d.SPECS_SQL, d.SPECS_SQL + ", damaged AS (SELECT * REPLACE (CASE WHEN id % 50 = 3 THEN id % 7 * 1000.0 ELSE fineness_per_mille END AS fineness_per_mille, CASE WHEN id % 7 = 0 THEN 'silver' ELSE primary_metal END AS primary_metal) FROM specs)").replace("FROM specs s", "FROM damaged s")
add(
    "integrity_audit",
    lambda s, f: specs.integrity(_damaged(s, f), _damaged(s, f).filter("weight_g IS NOT NULL AND id % 2 = 0")),
    f"""WITH {DAMAGED}, v AS (SELECT id, 'euro_conflict' AS code FROM audit WHERE conflict UNION ALL SELECT id, 'euro_year' FROM audit WHERE bad_year
      UNION ALL SELECT id, 'fineness_range' FROM audit WHERE fineness_per_mille <= 0 OR fineness_per_mille > 1000 UNION ALL SELECT id, 'no_year' FROM audit WHERE anchor IS NULL
      UNION ALL SELECT id, 'overlap' FROM audit WHERE conflict AND weight_g IS NOT NULL AND id % 2 = 0)
    SELECT code, count(*) AS n, min(id) AS example, code <> 'euro_year' AS blocking FROM v GROUP BY code""",
)
add(
    "repeated_fingerprints",
    lambda s, f: r4(specs.repeated_fingerprints(d.specs(s, f))),
    f"WITH {d.SPECS_SQL} SELECT round(weight_g, 4) AS weight_g, round(diameter_mm, 4) AS diameter_mm, lower(primary_metal) AS metal, count(*) AS n, count(DISTINCT country) AS countries FROM specs WHERE weight_g IS NOT NULL AND diameter_mm IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 4 AND count(DISTINCT country) >= 3",
)
add(
    "official_fill",
    lambda s, f: r4(d.specs(s, f).select("id", F.when(F.col("id") % 10 == 0, 900.0).otherwise(F.col("fineness_per_mille")).alias("fineness"), (F.col("weight_g") * F.when(F.col("id") % 10 == 0, 900.0).otherwise(F.col("fineness_per_mille")) / 1000).alias("fine_metal_g"))),
    f"WITH {d.SPECS_SQL}, x AS (SELECT *, CASE WHEN id % 10 = 0 THEN 900.0::DOUBLE ELSE fineness_per_mille END AS fineness FROM specs) SELECT id, round(fineness, 4) AS fineness, round(weight_g * fineness / 1000, 4) AS fine_metal_g FROM x",
)


def _canonical(s, f):
    return specs.recompute_canonical(d.observations(s, f), "item_id", "dealer", {"weight_g": 2, "diameter_mm": 1, "fineness_per_mille": 0})


def _votes(field: str, digits: int) -> str:
    return f"SELECT item_id, '{field}' AS field, round({field} + 1e-9, {digits}) AS value, count(DISTINCT dealer) AS n FROM observations WHERE {field} IS NOT NULL GROUP BY ALL HAVING count(DISTINCT dealer) >= 2"


CANONICAL = f"""{d.OBSERVATIONS_SQL}, votes AS ({_votes('weight_g', 2)} UNION ALL {_votes('diameter_mm', 1)} UNION ALL {_votes('fineness_per_mille', 0)}),
won AS (SELECT item_id, field, value FROM votes QUALIFY row_number() OVER (PARTITION BY item_id, field ORDER BY n DESC, value) = 1),
canonical AS (SELECT i.item_id, max(value) FILTER (field = 'weight_g') AS weight_g, max(value) FILTER (field = 'diameter_mm') AS diameter_mm, max(value) FILTER (field = 'fineness_per_mille') AS fineness_per_mille, count(field) AS k
  FROM (SELECT DISTINCT item_id FROM observations) i LEFT JOIN won USING (item_id) GROUP BY i.item_id)"""
add("recompute_canonical", lambda s, f: r4(_canonical(s, f)), f"WITH {CANONICAL} SELECT item_id, round(weight_g, 4) AS weight_g, round(diameter_mm, 4) AS diameter_mm, round(fineness_per_mille, 4) AS fineness_per_mille, CASE WHEN k = 3 THEN 'HIGH' WHEN k >= 1 THEN 'MEDIUM' ELSE 'UNVERIFIED' END AS confidence FROM canonical")
FIRSTS = "firsts AS (SELECT item_id, dealer, seq, {0} AS value FROM observations WHERE {0} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_id, dealer ORDER BY seq) = 1)"
add("first_per_dealer", lambda s, f: r4(specs.first_per_dealer(d.observations(s, f), "item_id", "dealer", "weight_g")), f"WITH {d.OBSERVATIONS_SQL}, {FIRSTS.format('weight_g')} SELECT item_id, dealer, seq, round(value, 4) AS value FROM firsts")
add(
    "exact_consensus",
    lambda s, f: specs.exact_consensus(d.observations(s, f), "item_id", "dealer", "primary_metal"),
    f"WITH {d.OBSERVATIONS_SQL}, {FIRSTS.format('primary_metal')}, v AS (SELECT item_id, value, count(*) AS support, min(seq) AS first FROM firsts GROUP BY ALL) SELECT item_id, value, support FROM v QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY support DESC, first) = 1",
)
add(
    "numeric_consensus",
    lambda s, f: r4(specs.numeric_consensus(d.observations(s, f), "item_id", "dealer", "weight_g", 0.03, 0.0)),
    f"""WITH {d.OBSERVATIONS_SQL}, {FIRSTS.format('weight_g')}, a AS (SELECT x.item_id, x.value AS anchor, x.seq, count(*) AS support FROM firsts x JOIN firsts y ON x.item_id = y.item_id AND abs(y.value - x.value) <= 0.03 GROUP BY ALL),
    b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY support DESC, seq) = 1)
    SELECT b.item_id, round(median(value), 4) AS value, any_value(support) AS support FROM b JOIN firsts USING (item_id) WHERE abs(value - anchor) <= 0.03 GROUP BY b.item_id""",
)

# --- keyed merges --------------------------------------------------------------------------------------


def _latest(s, f):
    return joins.latest_wins(d.observations(s, f).filter("source_item_id IS NOT NULL"), ["item_id", "source_item_id"], ["observed_on", "seq"])


LATEST = f"{d.OBSERVATIONS_SQL}, latest AS (SELECT * FROM observations QUALIFY row_number() OVER (PARTITION BY item_id, source_item_id ORDER BY observed_on DESC, seq DESC) = 1)"
add("upsert_latest", lambda s, f: _latest(s, f).select("item_id", "source_item_id", "seq", "observed_on"), f"WITH {LATEST} SELECT item_id, source_item_id, seq, observed_on FROM latest")
_KEYS = ["item_id", "source_item_id"]
add(
    "write_observations_upsert",
    lambda s, f: (lambda o: joins.upsert(joins.latest_wins(o.filter("observed_on < '1999-01-01'"), _KEYS, ["observed_on", "seq"]), joins.latest_wins(o.filter("observed_on >= '1999-01-01'"), _KEYS, ["observed_on", "seq"]), _KEYS).select("item_id", "source_item_id", "seq"))(d.observations(s, f)),
    f"WITH {LATEST} SELECT item_id, source_item_id, seq FROM latest",
)
add(
    "write_observations_ignore",
    lambda s, f: (lambda o: joins.insert_new(joins.latest_wins(o.filter("observed_on < '1999-01-01'"), _KEYS, ["observed_on", "seq"]), joins.latest_wins(o.filter("observed_on >= '1999-01-01'"), _KEYS, ["observed_on", "seq"]), _KEYS).select("item_id", "source_item_id", "seq"))(d.observations(s, f)),
    f"WITH {d.OBSERVATIONS_SQL} SELECT item_id, source_item_id, seq FROM observations QUALIFY row_number() OVER (PARTITION BY item_id, source_item_id ORDER BY observed_on >= DATE '1999-01-01', observed_on DESC, seq DESC) = 1",
)


def queue(s: SparkSession, f: str) -> DataFrame:
    """Work items: an order stands for one; its status and priority follow from its keys."""
    k = F.col("o_orderkey")
    status = F.when(k % 5 == 0, "DONE").when(k % 5 == 1, "FAILED").when(k % 5 == 2, "RETRY").when(k % 5 == 3, "RUNNING").otherwise("PENDING")
    return d.table(s, f, "orders").select(k.alias("item_id"), status.alias("status"), (k % 90).alias("priority"), (k % 4).alias("attempts"), F.when(k % 3 != 0, F.to_date("o_orderdate")).alias("next_run"))


QUEUE = """queue AS (SELECT o_orderkey AS item_id, list_extract(['DONE', 'FAILED', 'RETRY', 'RUNNING', 'PENDING'], CAST(o_orderkey % 5 + 1 AS INTEGER)) AS status, o_orderkey % 90 AS priority,
    o_orderkey % 4 AS attempts, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END AS next_run FROM orders)"""
add("queue_status", lambda s, f: queue(s, f).groupBy("status").agg(F.count("*").alias("n")), f"WITH {QUEUE} SELECT status, count(*) AS n FROM queue GROUP BY ALL")
add("due_items", lambda s, f: queue(s, f).filter("status IN ('PENDING', 'RETRY') AND (next_run IS NULL OR next_run <= '1998-01-01')").select("item_id", "priority"), f"WITH {QUEUE} SELECT item_id, priority FROM queue WHERE status IN ('PENDING', 'RETRY') AND (next_run IS NULL OR next_run <= DATE '1998-01-01')")
add("retry_outcome", lambda s, f: queue(s, f).select("item_id", F.when(F.col("attempts") >= 3, "FAILED").otherwise("RETRY").alias("outcome"), F.when(F.col("attempts") < 3, F.element_at(F.array(*map(F.lit, (60, 120, 360))), (F.col("attempts") + 1).cast("int"))).alias("delay_minutes")),
    f"WITH {QUEUE} SELECT item_id, CASE WHEN attempts >= 3 THEN 'FAILED' ELSE 'RETRY' END AS outcome, CASE attempts WHEN 0 THEN 60 WHEN 1 THEN 120 WHEN 2 THEN 360 END AS delay_minutes FROM queue")
add("queue_merge", lambda s, f: queue(s, f).join(d.table(s, f, "part").select(F.col("p_partkey").alias("item_id"), (F.col("p_partkey") % 50).alias("new_priority")), "item_id", "full").select("item_id", F.when(F.col("new_priority").isNull() | (F.col("status") == "DONE"), F.col("status")).otherwise("PENDING").alias("status"), F.least("priority", "new_priority").alias("priority")),
    f"WITH {QUEUE} SELECT coalesce(item_id, p_partkey) AS item_id, CASE WHEN p_partkey IS NULL OR status = 'DONE' THEN status ELSE 'PENDING' END AS status, least(priority, p_partkey % 50) AS priority FROM queue FULL JOIN part ON item_id = p_partkey")
add("catalog_not_queued", lambda s, f: d.specs(s, f).select("id").join(queue(s, f).select(F.col("item_id").alias("id")), "id", "left_anti"), f"WITH {d.SPECS_SQL}, {QUEUE} SELECT id FROM specs WHERE id NOT IN (SELECT item_id FROM queue)")
add("selector_quarantine_overlap", lambda s, f: queue(s, f).filter("status = 'FAILED'").select(F.col("item_id").alias("id")).intersect(specs.incomplete(d.specs(s, f)).select("id")), f"WITH {AUDIT}, {QUEUE} SELECT item_id AS id FROM queue WHERE status = 'FAILED' INTERSECT SELECT id FROM audit WHERE NOT conflict AND NOT bad_year AND anchor IS NOT NULL AND len(missing) > 0")
add("quarantine_jobs", lambda s, f: queue(s, f).join(d.specs(s, f).filter(specs.euro_year_invalid()).select(F.col("id").alias("item_id"), F.lit(True).alias("bad")), "item_id", "left").select("item_id", F.when(F.col("bad"), "FAILED").otherwise(F.col("status")).alias("status")),
    f"WITH {AUDIT}, {QUEUE} SELECT item_id, CASE WHEN item_id IN (SELECT id FROM audit WHERE bad_year) THEN 'FAILED' ELSE status END AS status FROM queue")
add("queue_join_catalog", lambda s, f: queue(s, f).join(d.specs(s, f).select(F.col("id").alias("item_id"), "country"), "item_id", "left").groupBy("status", "country").agg(F.count("*").alias("n")), f"WITH {d.SPECS_SQL}, {QUEUE} SELECT status, country, count(*) AS n FROM queue LEFT JOIN specs ON id = item_id GROUP BY ALL")
