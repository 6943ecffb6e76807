"""Market tables derived from the star schema, each with the same rule written as SQL for the oracle.

There is no auction data in the given tables, so line items stand for realized lots, parts for collectible
targets, suppliers for auction houses and dealers, and events for bids. Every rule is a closed formula.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hammerline.operators import matching

#: All ages are counted from here (after every sale date).
AS_OF = "2002-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Grades that suppliers' lots state, by the supplier's number.
LOT_GRADES = ("MS64", "XF", "VF", "UNC", "PCGS MS66")


def _pick(values, by) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def target_grade(target: Column) -> dict[str, Column]:
    """The grade that a target names, if any, by its number."""
    return {
        "grade_bucket": F.when(target % 2 == 0, _pick(("VF", "XF", "UNC_MID", "UNC_HIGH"), target)),
        "grade_numeric": F.when(target % 8 == 2, 65),
        "grading_company": F.when(target % 8 == 2, "PCGS"),
    }


def _lot_grade_weight(lots: DataFrame) -> DataFrame:
    """Adds grade_weight: what the matcher gives for the lot's grade against its target's; null where that names none."""
    wanted = target_grade(F.col("target_id"))
    df = matching.grade(lots, "grade_raw")
    numeric = F.abs(wanted["grade_numeric"] - F.col("numeric_grade"))
    buckets, same = matching.bucket_distance(wanted["grade_bucket"], F.col("grade_bucket")), F.coalesce(wanted["grade_bucket"] == F.col("grade_bucket"), F.lit(False))
    weight = F.when(wanted["grade_bucket"].isNotNull(), matching.grade_weight(numeric, buckets, same))
    return df.select(*lots.columns, weight.alias("grade_weight"))


def comparables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Realized lots: a row a line item."""
    line = table(spark, sf_dir, "lineitem")
    house = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("auction_house"), "s_nationkey")
    o, n, k = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")
    order = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    semantics = (
        F.when(o % 20 == 0, "ESTIMATE").when(o % 20 == 1, "UNKNOWN").when(o % 20 == 2, "FIXED_PRICE")
        .when(F.col("l_returnflag") == "R", "REALIZED_INCL_PREMIUM").otherwise("HAMMER")
    )
    hammer = F.col("l_extendedprice") / F.col("l_quantity")
    found = line.join(house, "l_suppkey").select(
        F.col("l_partkey").alias("target_id"),
        F.row_number().over(order).cast("long").alias("seq"),
        hammer.alias("hammer_price"),
        (hammer * (1 + F.col("l_tax"))).alias("realized_price"),
        F.to_date("l_shipdate").alias("auction_date"),
        "auction_house",
        F.concat_ws("-", o.cast("string"), n.cast("string")).alias("lot_number"),
        semantics.alias("price_semantics"),
        (o % 37 == 5).alias("withdrawn"),
        (o % 41 == 7).alias("unsold"),
        F.element_at(F.array(*map(F.lit, ("EUR", "USD", "GBP", "CHF"))), (F.col("s_nationkey") % 4 + 1).cast("int")).alias("currency"),
        F.when(n % 3 == 0, "csv").otherwise("manual").alias("source"),
        F.when(n % 2 == 0, F.concat(F.lit("u"), o.cast("string"))).alias("source_url"),
        _pick(LOT_GRADES, k).alias("grade_raw"),
        (55 + (o * 7 + n * 13) % 46).cast("int").alias("identity_match_score"),
        k.alias("dealer_id"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
    )
    return _lot_grade_weight(found)


#: The matcher's weight of a lot's grade (gb, gn) against a target's (tb, tn), ranks in the table `ranks`.
RANKS_SQL = "ranks(b, i) AS (VALUES ('LOW', 1), ('FINE', 2), ('VF', 3), ('XF', 4 ), ('AU', 5), ('UNC_LOW', 6), ('UNC_MID', 7), ('UNC_HIGH', 8))"
GRADE_SQL = """CASE WHEN tb IS NULL THEN NULL WHEN tn IS NOT NULL AND gn IS NOT NULL THEN CASE abs(tn - gn) WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.75 ELSE 0.3 END
      WHEN tb = gb THEN 0.7 WHEN x.i IS NULL OR y.i IS NULL THEN 0.55 WHEN abs(x.i - y.i) = 1 THEN 0.45 ELSE 0.3 END::DOUBLE"""
_TARGET_GRADE_SQL = """CASE WHEN {0} % 2 = 0 THEN list_extract(['VF', 'XF', 'UNC_MID', 'UNC_HIGH'], CAST({0} % 4 + 1 AS INTEGER)) END AS tb, CASE WHEN {0} % 8 = 2 THEN 65 END AS tn"""
_LOT_GRADE_SQL = """list_extract(['UNC_MID', 'XF', 'VF', 'UNC_MID', 'UNC_HIGH'], CAST(l_suppkey % 5 + 1 AS INTEGER)) AS gb, CASE l_suppkey % 5 WHEN 0 THEN 64 WHEN 4 THEN 66 END AS gn"""
COMPARABLES_SQL = f"""{RANKS_SQL},
comparables AS (SELECT c.* EXCLUDE (tb, tn, gb, gn), {GRADE_SQL} AS grade_weight FROM (
  SELECT l_partkey AS target_id,
    row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS seq,
    l_extendedprice / l_quantity AS hammer_price, l_extendedprice / l_quantity * (1 + l_tax) AS realized_price,
    CAST(l_shipdate AS DATE) AS auction_date, s_name AS auction_house, l_orderkey || '-' || l_linenumber AS lot_number,
    CASE WHEN l_orderkey % 20 = 0 THEN 'ESTIMATE' WHEN l_orderkey % 20 = 1 THEN 'UNKNOWN' WHEN l_orderkey % 20 = 2 THEN 'FIXED_PRICE'
      WHEN l_returnflag = 'R' THEN 'REALIZED_INCL_PREMIUM' ELSE 'HAMMER' END AS price_semantics,
    l_orderkey % 37 = 5 AS withdrawn, l_orderkey % 41 = 7 AS unsold,
    CASE s_nationkey % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'GBP' ELSE 'CHF' END AS currency,
    CASE WHEN l_linenumber % 3 = 0 THEN 'csv' ELSE 'manual' END AS source,
    CASE WHEN l_linenumber % 2 = 0 THEN 'u' || l_orderkey END AS source_url,
    CASE l_suppkey % 5 WHEN 0 THEN 'MS64' WHEN 1 THEN 'XF' WHEN 2 THEN 'VF' WHEN 3 THEN 'UNC' ELSE 'PCGS MS66' END AS grade_raw,
    CAST(55 + (l_orderkey * 7 + l_linenumber * 13) % 46 AS INTEGER) AS identity_match_score,
    {_TARGET_GRADE_SQL.format('l_partkey')}, {_LOT_GRADE_SQL},
    l_suppkey AS dealer_id, l_quantity AS quantity, l_discount AS discount
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) c LEFT JOIN ranks x ON x.b = tb LEFT JOIN ranks y ON y.b = gb)"""


def _identity(k: Column) -> dict[str, Column]:
    """What part k is: a country, a year, a value, an issuer, a mint mark, a variant and a catalogue number."""
    return {
        "country_code": F.concat(F.lit("C"), (k % 25).cast("string")),
        "year": (1750 + k % 220).cast("int"),
        "denomination_value": (k % 50 / 4.0 + 0.25),
        "issuer": F.concat(F.lit("Mint of "), F.col("p_brand")),
        "mintmark": F.when(k % 5 == 2, _pick(("A", "D", "F"), k)),
        "catalog": F.concat(F.lit("KM"), (k % 700).cast("string")),
    }


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets with what is known of them: a row a part; now and then a field is left open."""
    k = F.col("p_partkey")
    of = _identity(k)
    return table(spark, sf_dir, "part").select(
        k.alias("target_id"),
        F.when(k % 89 != 3, of["country_code"]).alias("country_code"),
        F.when(k % 97 != 5, of["year"]).alias("year"),
        F.when(k % 101 != 7, of["denomination_value"]).alias("denomination_value"),
        F.when(k % 3 != 0, F.lower("p_brand")).alias("issuer"),
        F.lower(of["mintmark"]).alias("mintmark"),
        F.when(k % 4 == 1, F.array("p_type")).alias("variants"),
        F.when(k % 6 == 0, F.create_map(F.lit("KM"), of["catalog"])).alias("catalog_ids"),
        *[c.alias(n) for n, c in target_grade(k).items()],
    )


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots with what they say of themselves: a row a line item, which deviates from its part by the order's number."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type")
    k, o, n = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")
    of = _identity(k)
    order = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    line = table(spark, sf_dir, "lineitem").withColumn("copy", F.row_number().over(order))
    return line.join(part, "l_partkey").select(
        F.concat_ws("-", o.cast("string"), n.cast("string"), F.col("copy").cast("string")).alias("lot_id"),
        F.concat_ws(" ", "p_name", F.when(o % 31 == 4, "replica"), F.when(o % 37 == 5, "coin set")).alias("title"),
        F.when(o % 43 == 6, "with a medal").alias("description"),
        F.when(o % 17 != 0, of["country_code"]).alias("country_code"),
        (of["year"] + F.when(o % 6 == 0, 1).otherwise(0)).alias("coin_year"),
        (of["denomination_value"] + F.when(o % 9 == 0, 0.25).otherwise(0.0)).alias("denomination_value"),
        F.when(o % 7 != 1, F.concat(F.lower("p_type"), F.when(o % 2 == 0, " variety").otherwise(""))).alias("variant"),
        F.when(o % 5 != 0, F.create_map(F.lit("KM"), F.when(o % 5 == 1, "KM0").otherwise(of["catalog"]))).alias("catalog_ids"),
        of["mintmark"].alias("mintmark"),
        F.when(o % 4 == 0, "unknown").otherwise(of["issuer"]).alias("issuer"),
        _pick((*LOT_GRADES, "Very Fine, cleaned", "", "AU cert #A-12"), o).alias("grade_raw"),
        F.when(o % 8 == 3, "PCGS").alias("grading_company"),
        F.lit(None).cast("string").alias("cert_number"),
        (o % 41 == 7).alias("withdrawn"),
        F.when(o % 3 != 0, o % 47 == 8).alias("unsold"),
        F.when(o % 13 != 2, F.col("l_extendedprice")).alias("hammer_price"),
        F.lit(None).cast("double").alias("realized_price"),
        F.when(o % 26 == 2, 10.0).alias("estimate_low"),
        F.lit(None).cast("double").alias("estimate_high"),
    )


IDENTITIES_SQL = f"""identities AS (SELECT p_partkey AS target_id, CASE WHEN p_partkey % 89 <> 3 THEN 'C' || p_partkey % 25 END AS t_country, CASE WHEN p_partkey % 97 <> 5 THEN 1750 + p_partkey % 220 END AS t_year,
    CASE WHEN p_partkey % 101 <> 7 THEN p_partkey % 50 / 4.0::DOUBLE + 0.25 END AS t_value, CASE WHEN p_partkey % 3 <> 0 THEN lower(p_brand) END AS t_issuer,
    CASE WHEN p_partkey % 5 = 2 THEN list_extract(['a', 'd', 'f'], CAST(p_partkey % 3 + 1 AS INTEGER)) END AS t_mark, CASE WHEN p_partkey % 4 = 1 THEN lower(p_type) END AS t_variant,
    CASE WHEN p_partkey % 6 = 0 THEN 'KM' || p_partkey % 700 END AS t_km, {_TARGET_GRADE_SQL.format('p_partkey')}, CASE WHEN p_partkey % 8 = 2 THEN 'PCGS' END AS t_company FROM part)"""
LOTS_SQL = """lots AS (SELECT l_orderkey || '-' || l_linenumber || '-' || copy AS lot_id,
    concat_ws(',', CASE WHEN o % 37 = 5 THEN 'coin set' END, CASE WHEN o % 43 = 6 THEN 'medal' END, CASE WHEN o % 31 = 4 THEN 'replica' END, CASE WHEN o % 37 = 5 THEN 'set' END) AS negative,
    CASE WHEN o % 17 <> 0 THEN 'C' || k % 25 END AS country, 1750 + k % 220 + CASE WHEN o % 6 = 0 THEN 1 ELSE 0 END AS coin_year,
    k % 50 / 4.0::DOUBLE + 0.25 + CASE WHEN o % 9 = 0 THEN 0.25 ELSE 0 END AS value,
    CASE WHEN o % 7 <> 1 THEN lower(p_type) || CASE WHEN o % 2 = 0 THEN ' variety' ELSE '' END END AS variant,
    CASE WHEN o % 5 = 1 THEN 'KM0' WHEN o % 5 <> 0 THEN 'KM' || k % 700 END AS km, CASE WHEN k % 5 = 2 THEN list_extract(['a', 'd', 'f'], CAST(k % 3 + 1 AS INTEGER)) END AS mark,
    CASE WHEN o % 4 = 0 THEN 'unknown' ELSE lower('Mint of ' || p_brand) END AS issuer,
    list_extract(['MS64', 'XF', 'VF', 'UNC', 'PCGS MS66', 'Very Fine, cleaned', '', 'AU cert #A-12'], CAST(o % 8 + 1 AS INTEGER)) AS grade_raw,
    list_extract(['UNC_MID', 'XF', 'VF', 'UNC_MID', 'UNC_HIGH', 'DETAILS', 'UNKNOWN', 'AU'], CAST(o % 8 + 1 AS INTEGER)) AS gb, CASE o % 8 WHEN 0 THEN 64 WHEN 4 THEN 66 END AS gn,
    CASE WHEN o % 8 IN (4, 3) THEN 'PCGS' END AS company, CASE WHEN o % 8 = 7 THEN 'A-12' END AS cert, o % 41 = 7 AS withdrawn, CASE WHEN o % 3 <> 0 THEN o % 47 = 8 ELSE false END AS unsold,
    o % 13 = 2 AND o % 26 <> 2 AS priceless
  FROM (SELECT *, l_orderkey AS o, l_partkey AS k, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS copy FROM lineitem) JOIN part ON l_partkey = p_partkey)"""


def dealer_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asks: for each target and dealer the list price less a discount, with a relevance score."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice", "p_name", "p_type", "p_brand", "p_size")
    line = table(spark, sf_dir, "lineitem")
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    order = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    return line.join(part, "l_partkey").select(
        F.col("l_partkey").alias("target_id"),
        F.row_number().over(order).cast("long").alias("seq"),
        F.col("l_suppkey").alias("dealer_id"),
        F.when(o % 23 != 0, F.col("p_retailprice") * (1.1 - F.col("l_discount")) * F.when(o % 29 == 3, 4).otherwise(1)).alias("price"),
        ((o * 11 + n * 3) % 100 / 100.0).alias("score"),
        F.when(n % 4 != 0, (o % 9).cast("double")).alias("shipping"),
        F.concat(F.lit("http://d"), (o % 50).cast("string"), F.lit("/"), F.col("l_partkey").cast("string")).alias("url"),
        F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("title"),
    )


DEALER_PRICES_SQL = """dealer_prices AS (
  SELECT l_partkey AS target_id,
    row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS seq,
    l_suppkey AS dealer_id,
    CASE WHEN l_orderkey % 23 <> 0 THEN p_retailprice * (1.1 - l_discount) * CASE WHEN l_orderkey % 29 = 3 THEN 4 ELSE 1 END END AS price,
    (l_orderkey * 11 + l_linenumber * 3) % 100 / 100.0::DOUBLE AS score,
    CASE WHEN l_linenumber % 4 <> 0 THEN CAST(l_orderkey % 9 AS DOUBLE) END AS shipping,
    'http://d' || l_orderkey % 50 || '/' || l_partkey AS url,
    concat_ws(' ', p_name, p_brand, p_type) AS title
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current bids, a row an event: raw text of the bid (some invalid), premium and fees."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    raw = F.when(k % 17 == 0, "").when(k % 17 == 1, "-50").when(k % 17 == 2, "abc").when(k % 17 == 3, "0").otherwise(F.format_string("%d,5", (k * 37 % 2000).cast("long")))
    return e.select(
        k.alias("bid_id"),
        (F.col("user_id") % 200 + 1).alias("target_id"),
        F.col("ts").cast("timestamp").alias("bid_ts"),
        raw.alias("current_hammer_raw"),
        (15.0 + k % 4 * 2.5).alias("buyer_premium_pct"),
        (k % 7 * 2.0).alias("shipping"),
        (k % 3 * 5.0).alias("fixed_fees"),
        (k % 2 * 1.0).alias("taxes"),
    )


BIDS_SQL = """bids AS (
  SELECT event_id AS bid_id, user_id % 200 + 1 AS target_id,
    CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 17 = 1 THEN '-50' WHEN event_id % 17 = 2 THEN 'abc' WHEN event_id % 17 = 3 THEN '0'
      ELSE (event_id * 37 % 2000) || ',5' END AS current_hammer_raw,
    15.0 + event_id % 4 * 2.5 AS buyer_premium_pct, event_id % 7 * 2.0 AS shipping, event_id % 3 * 5.0 AS fixed_fees, event_id % 2 * 1.0 AS taxes
  FROM events)"""


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physical specifications, a row a part, with gaps and some impossible euro-coin profiles."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    return p.select(
        k.alias("id"),
        pick(("Austria", "Greece", "Croatia", "France", "Latvia"), k).alias("country"),
        pick((0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0), k).alias("denomination_value"),
        F.when(k % 6 != 0, (1990 + k % 35).cast("int")).alias("issue_year"),
        F.when(k % 4 != 0, (1985 + k % 35).cast("int")).alias("year_from"),
        F.when(k % 3 != 0, (1995 + k % 35).cast("int")).alias("year_to"),
        F.when(k % 9 != 0, pick((2.3, 3.06, 3.92, 4.1, 5.74, 7.8, 7.5, 8.5), k)).alias("weight_g"),
        F.when(k % 11 != 0, pick((16.25, 18.75, 21.25, 19.75, 22.25, 24.25, 23.25, 25.75), k)).alias("diameter_mm"),
        F.when(k % 13 != 0, pick(("Nordic gold", "gold", "copper", "silver", "steel", "bimetal"), k)).alias("primary_metal"),
        F.when(k % 5 != 0, (F.lit(500) + k % 8 * 60).cast("double")).alias("fineness_per_mille"),
        (k % 7 == 0).alias("verified"),
        (k % 100 / 100.0).alias("confidence"),
    )


SPECS_SQL = """specs AS (
  SELECT p_partkey AS id,
    list_extract(['Austria', 'Greece', 'Croatia', 'France', 'Latvia'], CAST(p_partkey % 5 + 1 AS INTEGER)) AS country,
    list_extract([0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0]::DOUBLE[], CAST(p_partkey % 8 + 1 AS INTEGER)) AS denomination_value,
    CASE WHEN p_partkey % 6 <> 0 THEN CAST(1990 + p_partkey % 35 AS INTEGER) END AS issue_year,
    CASE WHEN p_partkey % 4 <> 0 THEN CAST(1985 + p_partkey % 35 AS INTEGER) END AS year_from,
    CASE WHEN p_partkey % 3 <> 0 THEN CAST(1995 + p_partkey % 35 AS INTEGER) END AS year_to,
    CASE WHEN p_partkey % 9 <> 0 THEN list_extract([2.3, 3.06, 3.92, 4.1, 5.74, 7.8, 7.5, 8.5]::DOUBLE[], CAST(p_partkey % 8 + 1 AS INTEGER)) END AS weight_g,
    CASE WHEN p_partkey % 11 <> 0 THEN list_extract([16.25, 18.75, 21.25, 19.75, 22.25, 24.25, 23.25, 25.75]::DOUBLE[], CAST(p_partkey % 8 + 1 AS INTEGER)) END AS diameter_mm,
    CASE WHEN p_partkey % 13 <> 0 THEN list_extract(['Nordic gold', 'gold', 'copper', 'silver', 'steel', 'bimetal'], CAST(p_partkey % 6 + 1 AS INTEGER)) END AS primary_metal,
    CASE WHEN p_partkey % 5 <> 0 THEN CAST(500 + p_partkey % 8 * 60 AS DOUBLE) END AS fineness_per_mille,
    p_partkey % 7 = 0 AS verified, p_partkey % 100 / 100.0::DOUBLE AS confidence
  FROM part)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physical measurements by dealers, a row a line item: most agree, some are off."""
    line = table(spark, sf_dir, "lineitem")
    o, n, p = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    order = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    return line.select(
        p.alias("item_id"),
        F.row_number().over(order).cast("long").alias("seq"),
        F.col("l_suppkey").alias("dealer"),
        F.when(o % 10 != 0, (p % 20 + 2) + (o % 3) * 0.02).alias("weight_g"),
        F.when(o % 7 != 0, (p % 15 + 15) + (o % 2) * 0.04).alias("diameter_mm"),
        F.when(n % 5 != 0, (F.lit(900) - o % 2 * 25).cast("double")).alias("fineness_per_mille"),
        F.when(n % 6 != 0, F.when(o % 5 == 0, "gold").otherwise("silver")).alias("primary_metal"),
        F.concat(F.lit("i"), (o % 40).cast("string")).alias("source_item_id"),
        F.to_date("l_shipdate").alias("observed_on"),
    )


OBSERVATIONS_SQL = """observations AS (
  SELECT l_partkey AS item_id,
    row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS seq,
    l_suppkey AS dealer,
    CASE WHEN l_orderkey % 10 <> 0 THEN (l_partkey % 20 + 2) + (l_orderkey % 3) * 0.02::DOUBLE END AS weight_g,
    CASE WHEN l_orderkey % 7 <> 0 THEN (l_partkey % 15 + 15) + (l_orderkey % 2) * 0.04::DOUBLE END AS diameter_mm,
    CASE WHEN l_linenumber % 5 <> 0 THEN CAST(900 - l_orderkey % 2 * 25 AS DOUBLE) END AS fineness_per_mille,
    CASE WHEN l_linenumber % 6 <> 0 THEN CASE WHEN l_orderkey % 5 = 0 THEN 'gold' ELSE 'silver' END END AS primary_metal,
    'i' || l_orderkey % 40 AS source_item_id, CAST(l_shipdate AS DATE) AS observed_on
  FROM lineitem)"""


def fx_rates(spark: SparkSession) -> DataFrame:
    """Rates to EUR on business days from 1995 to 2001, by a closed formula of the day number."""
    days = spark.sql("SELECT explode(sequence(DATE'1995-01-01', DATE'2001-12-31', INTERVAL 1 DAY)) AS rate_date")
    days = days.filter(F.weekday("rate_date") < 5).withColumn("n", F.datediff("rate_date", F.lit("1995-01-01").cast("date")))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("from_ccy"), F.lit(b).alias("b")) for c, b in (("USD", 0.9), ("GBP", 1.4), ("CHF", 0.65))]))
    return days.select("rate_date", "n", pairs.alias("p")).select("p.from_ccy", "rate_date", (F.col("p.b") + F.col("n") % 100 / 1000.0).alias("rate"))


FX_RATES_SQL = """fx_rates AS (
  SELECT c AS from_ccy, d AS rate_date, b + date_diff('day', DATE '1995-01-01', d) % 100 / 1000.0::DOUBLE AS rate
  FROM (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS d) t,
    (VALUES ('USD', 0.9::DOUBLE), ('GBP', 1.4::DOUBLE), ('CHF', 0.65::DOUBLE)) p(c, b)
  WHERE isodow(d) < 6)"""
