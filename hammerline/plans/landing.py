"""Queries that land derived rows as files in the shared folder and read them by the library's readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hammerline.operators import backtest
from hammerline.plans import market
from hammerline.plans.catalogue import K, pick, sql_pick
from hammerline.plans.market import r4
from hammerline.sources import derived as d
from hammerline.sources import landed
from hammerline.streaming.streams import shared_dir

QUERIES, ORACLES = {}, {}


def add(name, build, sql):
    QUERIES[name] = build
    ORACLES[name] = sql


def land(rows: DataFrame, kind: str = "text") -> str:
    """Writes rows as files of a kind to a new folder and returns its path."""
    path = f"{shared_dir(rows.sparkSession)}/landed-{uuid.uuid4().hex}"
    rows.write.option("header", True).format(kind).save(path)
    return path


def _csv(s, f):
    k = F.col("l_orderkey")
    rows = d.table(s, f, "lineitem").select(
        F.when(k % 9 == 0, F.lit("31.12.1999")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("DATE"),
        F.when(k % 11 == 0, F.lit("n/a")).when(k % 11 == 1, F.lit("-5")).when(k % 2 == 0, F.regexp_replace(F.format_string("%.1f", F.col("l_quantity") + 0.5), r"\.", ",")).otherwise(F.format_string("%.1f", "l_quantity")).alias("Hammer"),
        F.when(k % 3 == 0, F.lit("usd")).alias("currency"), F.concat_ws("-", k, "l_linenumber").alias("LOT_NUMBER"))
    found = landed.read_comparables_csv(s, land(rows, "csv"))
    return r4(found.select("lot_number", "auction_date", "hammer_price", "currency"))


add("read_comparables_csv", _csv, "SELECT l_orderkey || '-' || l_linenumber AS lot_number, CASE WHEN l_orderkey % 9 <> 0 THEN CAST(l_shipdate AS DATE) END AS auction_date, "
    "l_quantity + CASE WHEN l_orderkey % 2 = 0 THEN 0.5 ELSE 0 END::DOUBLE AS hammer_price, CASE WHEN l_orderkey % 3 = 0 THEN 'USD' ELSE 'EUR' END AS currency FROM lineitem WHERE l_orderkey % 11 > 1")  # fmt: skip


def _lines(s, f):
    k = F.col("l_orderkey")
    day, price = F.date_format("l_shipdate", "yyyy-MM-dd"), F.format_string("%.1f", "l_quantity")
    line = F.when(k % 4 == 0, price).when(k % 4 == 1, F.lit("no sale")).when(k % 4 == 2, F.concat_ws(" | ", day, price, F.lit("gbp"), F.lit("VF"), F.concat(F.lit("H"), k))).otherwise(F.concat_ws("|", day, price))
    found = landed.read_comparables_lines(s, land(d.table(s, f, "lineitem").select(line.alias("value"))))
    return r4(found.groupBy("auction_date", "currency", "grade_raw").agg(F.count("*").alias("n"), F.sum("hammer_price").alias("total")))


add("read_comparables_lines", _lines, "SELECT CASE WHEN l_orderkey % 4 > 1 THEN CAST(l_shipdate AS DATE) END AS auction_date, CASE WHEN l_orderkey % 4 = 2 THEN 'GBP' ELSE 'EUR' END AS currency, "
    "CASE WHEN l_orderkey % 4 = 2 THEN 'VF' END AS grade_raw, count(*) AS n, sum(l_quantity) AS total FROM lineitem WHERE l_orderkey % 4 <> 1 GROUP BY ALL")  # fmt: skip


def _tariffs(s, f):
    k = F.col(K)
    rows = d.table(s, f, "part").select(
        F.concat(F.lit("Shop"), k).alias("dealer_slug"), pick(["Greece", "World", "Europe"]).alias("destination"), pick(["0", "nan", ""]).alias("price_tier_min"), F.when(k % 4 != 0, (k % 90).cast("string")).alias("price_tier_max"),
        pick(["x", "500"]).alias("weight_tier_max_g"), F.concat((k % 20).cast("string"), F.lit(".5")).alias("cost"), pick(["usd", None]).alias("currency"), pick(["Yes", "0", "TRUE", None, "1"]).alias("free_shipping"))
    return r4(landed.read_shipping_tariffs(s, land(rows, "csv")))


add("read_shipping_tariffs", _tariffs, f"SELECT 'shop' || {K} AS dealer_slug, {sql_pick(['Greece', 'World', 'Europe'])} AS destination, {sql_pick([0, None, None], 'DOUBLE')} AS price_min, CASE WHEN {K} % 4 <> 0 THEN CAST({K} % 90 AS DOUBLE) END AS price_max, NULL::DOUBLE AS weight_min, "
    f"{sql_pick([None, 500], 'DOUBLE')} AS weight_max, CAST({K} % 20 + 0.5 AS DOUBLE) AS cost, {sql_pick(['USD', 'EUR'])} AS currency, {sql_pick([True, False, True, False, True], 'BOOLEAN')} AS free_shipping, '' AS tier_label FROM part")  # fmt: skip


def _feeds(s, f):
    k, title = F.col(K), F.when(F.col(K) % 7 != 0, F.concat(F.col("p_name"), F.lit(" &amp; more"))).otherwise("")
    rss = F.concat(F.lit("<item><title>"), title, F.lit("</title><link>http://n/"), k, F.lit("</link>"), F.when(k % 3 == 0, "").otherwise("<pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate>"), F.lit("<description>&lt;p&gt;A  b&lt;/p&gt;</description></item>"))
    atom = F.concat(F.lit("<entry><title>"), title, F.lit('</title><link href="http://a/'), k, F.lit('"/><updated>2024-01-02T03:04:05Z</updated><summary>s</summary></entry>'))
    line = F.when(k % 2 == 0, rss).otherwise(atom)
    return landed.read_feed_items(s, land(d.table(s, f, "part").select(line.alias("value"))), feed_a_line=True).withColumn("at", F.col("at").cast("timestamp_ntz"))


add("read_feed_items", _feeds, f"SELECT p_name || ' & more' AS title, CASE WHEN {K} % 2 = 0 THEN 'http://n/' ELSE 'http://a/' END || {K} AS link, CASE WHEN {K} % 6 <> 0 THEN TIMESTAMP '2024-01-02 03:04:05' END AS at, "
    f"CASE WHEN {K} % 2 = 0 THEN 'A b' ELSE 's' END AS summary FROM part WHERE {K} % 7 <> 0")  # fmt: skip


def _spec_json(s, f):
    record = F.struct(F.col("denomination_value").alias("denomination"), "weight_g", "diameter_mm", F.col("primary_metal").alias("metal"), F.array("country", F.concat("country", F.lit(" II"))).alias("countries"))
    files = d.specs(s, f).groupBy((F.col("id") % 50).alias("shelf")).agg(F.array_sort(F.collect_list(record)).alias("records"))
    found = landed.read_spec_json(s, land(files.select("records"), "json"), multi_line=False)
    return r4(found.groupBy("country", "denomination").agg(F.count("*").alias("n"), F.sum("weight_g").alias("weight")))


def _ontology(s, f):
    names = lambda *x: F.array(*x)
    currency = F.struct(
        F.concat(F.lit("C"), "n_nationkey").alias("code"), names(F.concat(F.lit("Coin of "), "n_name"), F.lit("or")).alias("aliases"), F.array(F.struct(F.concat(F.lit("Cent"), "n_nationkey").alias("name"), names(F.lit("c")).alias("aliases"))).alias("subunits"),
        F.array(F.struct(F.lit(0.25).alias("value"), names(F.concat(F.lit("Quarter "), "n_name")).alias("aliases"))).alias("special_denominations"))
    rows = d.table(s, f, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"), names(F.concat(F.lit(" Land "), "n_name"), F.lit("The")).alias("aliases"), F.array(currency).alias("currencies"))
    return landed.read_alias_ontology(s, land(rows, "json"))


add("read_alias_ontology", _ontology, """WITH n AS (SELECT lower(n_name) AS n, CAST(n_nationkey AS VARCHAR) AS k FROM nation)
    SELECT 'country' AS kind, n AS alias, k AS country_code, NULL AS currency_code, NULL::DOUBLE AS special_value FROM n UNION ALL SELECT 'country', 'land ' || n, k, NULL, NULL FROM n
    UNION ALL SELECT 'currency', 'coin of ' || n, k, 'C' || k, NULL FROM n UNION ALL SELECT 'subunit', 'cent' || k, k, 'C' || k, NULL FROM n UNION ALL SELECT 'special', 'quarter ' || n, k, 'C' || k, 0.25 FROM n""")  # fmt: skip
add("read_spec_json", _spec_json, f"""WITH {d.SPECS_SQL} SELECT country, denomination_value AS denomination, count(*) AS n, round(sum(weight_g) + 1e-7, 4) AS weight FROM
    (SELECT * FROM specs UNION ALL SELECT * REPLACE (country || ' II' AS country) FROM specs) GROUP BY ALL""")
add("report_text", lambda s, f: backtest.report_lines(backtest.backtest_report(market._backtested(s, f))),
    f"WITH {market.CASES}, r AS (SELECT coalesce(label, 'ALL') AS label, cases, scored, hit FROM (SELECT label, count(*) AS cases, count(pct_error) AS scored, avg(within::INT) AS hit FROM cases GROUP BY label UNION ALL SELECT NULL, count(*), count(pct_error), avg(within::INT) FROM cases)) "
    "SELECT label, CASE WHEN scored = 0 THEN label || ': ' || cases || ' cases, none scored, no finding' ELSE label || ': ' || cases || ' cases, ' || scored || ' scored, ' || CAST(round(hit * 100) AS BIGINT) || ' percent within the range' END AS line FROM r")  # fmt: skip
