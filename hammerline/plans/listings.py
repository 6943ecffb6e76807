"""Queries over listings and listing pages; their twins follow from the rules the listings are made by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hammerline.functions import assets
from hammerline.functions import text as t
from hammerline.operators import listings as op
from hammerline.operators import specs
from hammerline.plans import texts
from hammerline.plans.market import r4
from hammerline.sources import derived as d

QUERIES, ORACLES = {}, {}


def add(name, build, sql):
    QUERIES[name] = build
    ORACLES[name] = sql


def listings(s: SparkSession, f: str) -> DataFrame:
    """A listing a line item, whose title deviates from its search by rules of the order's number."""
    c = d.comparables(s, f).select("target_id", "seq", F.split_part("lot_number", F.lit("-"), F.lit(1)).cast("long").alias("o"))
    p, o = F.col("target_id"), F.col("o")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    kind = F.when(o % 10 == 1, "banknote").when(o % 10 == 2, "coin set").otherwise("coin")
    title = F.concat_ws(
        " ", pick(("1", "2", "5", "10"), p + F.when(o % 9 == 0, 1).otherwise(0)), F.lit("Mark"), (1950 + p % 60 + F.when(o % 7 == 0, 1).otherwise(0)).cast("string"),
        pick(("Austria", "France", "Greece"), p + F.when(o % 11 == 0, 1).otherwise(0)), kind, F.when(o % 5 == 0, "VF").otherwise("UNC"), F.when(o % 13 == 0, "replica"),
    )
    return c.select(
        "target_id", "seq", F.when(o % 10 == 0, " ").otherwise(title).alias("title"), pick((1.0, 2.0, 5.0, 10.0), p).alias("t_value"), F.lit("mark").alias("t_unit"),
        (1950 + p % 60).cast("int").alias("t_year"), pick(("Austria", "France", "Greece"), p).alias("t_country"), F.when(p % 2 == 0, "MINT").alias("t_grade"),
    )


LISTINGS = f"""{d.COMPARABLES_SQL}, l AS (SELECT target_id, seq, CAST(split_part(lot_number, '-', 1) AS BIGINT) AS o FROM comparables),
judged AS (SELECT target_id, seq, o, CASE WHEN o % 10 = 0 THEN 'EMPTY_TEXT' ELSE concat_ws(',', CASE WHEN o % 10 = 1 THEN 'BANKNOTE' END, CASE WHEN o % 10 = 2 THEN 'NOT_SINGLE_COIN' END,
    CASE WHEN o % 9 = 0 THEN 'DENOMINATION_MISMATCH' END, CASE WHEN o % 7 = 0 THEN 'YEAR_MISMATCH' END, CASE WHEN o % 11 = 0 THEN 'COUNTRY_MISMATCH' END,
    CASE WHEN target_id % 2 = 0 AND o % 5 = 0 THEN 'GRADE_MISMATCH' END, CASE WHEN o % 13 = 0 OR o % 10 IN (1, 2) THEN 'NEGATIVE_PRODUCT_FLAG' END) END AS reasons FROM l)"""
_judged = lambda s, f: op.hard_filter(listings(s, f))
add("hard_filter_reasons", lambda s, f: _judged(s, f).select("target_id", "seq", F.concat_ws(",", "reasons").alias("reasons")), f"WITH {LISTINGS} SELECT target_id, seq, reasons FROM judged")
add("passes_hard_filter", lambda s, f: _judged(s, f).filter(F.size("reasons") == 0).groupBy("target_id").agg(F.count("*").alias("n")), f"WITH {LISTINGS} SELECT target_id, count(*) AS n FROM judged WHERE reasons = '' GROUP BY ALL")
add(
    "rejection_counts",
    lambda s, f: specs.sampled(_judged(s, f).select("target_id", "seq", F.explode("reasons").alias("reason")), "reason", "target_id", "seq", most=12)
    .select("reason", "n", F.concat_ws(",", F.transform("samples", lambda x: F.concat_ws("-", x.target_id.cast("string"), x.seq.cast("string")))).alias("samples")),
    f"""WITH {LISTINGS}, v AS (SELECT target_id, seq, unnest(string_split(reasons, ',')) AS reason FROM judged WHERE reasons <> ''),
    r AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY target_id, seq) AS rn, count(*) OVER (PARTITION BY reason) AS n FROM v)
    SELECT reason, any_value(n) AS n, string_agg(target_id || '-' || seq, ',' ORDER BY target_id, seq) AS samples FROM r WHERE rn <= 12 GROUP BY reason""",
)
add("title_denomination_veto", lambda s, f: _judged(s, f).filter(F.array_contains("reasons", "DENOMINATION_MISMATCH")).groupBy("target_id").agg(F.count("*").alias("vetoed")), f"WITH {LISTINGS} SELECT target_id, count(*) AS vetoed FROM judged WHERE contains(reasons, 'DENOMINATION_MISMATCH') GROUP BY ALL")
add("grade_conflict", lambda s, f: listings(s, f).select("target_id", "seq", op.differs(op.grade_tier(F.col("title")), F.col("t_grade")).alias("conflict")), f"WITH {LISTINGS} SELECT target_id, seq, target_id % 2 = 0 AND o % 5 = 0 AND o % 10 <> 0 AS conflict FROM judged")
add("classify_asset", lambda s, f: listings(s, f).groupBy(op.asset_class(F.col("title")).alias("asset")).agg(F.count("*").alias("n")), f"WITH {LISTINGS} SELECT CASE WHEN o % 10 = 0 THEN 'UNKNOWN' WHEN o % 10 = 1 THEN 'BANKNOTE' ELSE 'COIN' END AS asset, count(*) AS n FROM l GROUP BY ALL")
_held = lambda terms: " + ".join(f"contains(t, '{x}')::INT" for x in assets._terms(terms))
add(
    "asset_confidence",
    lambda s, f: r4(d.table(s, f, "documents").select("doc_id", assets.classify(F.col("text")).alias("c")).select("doc_id", "c.*")),
    f"""WITH n AS (SELECT doc_id, {texts._NORM.format('text')} AS t FROM documents),
    k AS (SELECT doc_id, {_held(assets.EVIDENCE)} > 0 AS sure, {_held(assets.STRONG)} AS strong, {_held(assets.COINS)} AS coin, {_held(assets.WEAK)} + CASE WHEN regexp_matches(t, '{assets.PICK}') THEN 3 ELSE 0 END AS bank FROM n)
    SELECT doc_id, CASE WHEN sure OR strong > 0 OR (bank >= 2 AND bank > coin) THEN 'BANKNOTE' WHEN coin >= 1 THEN 'COIN' ELSE 'UNKNOWN' END AS asset,
      CASE WHEN sure THEN 0.995 WHEN strong > 0 THEN least(0.995, 0.90 + 0.02 * strong) WHEN bank >= 2 AND bank > coin THEN least(0.99, 0.65 + 0.08 * bank) WHEN coin >= 1 THEN least(0.98, 0.70 + 0.06 * coin) ELSE 0.45 END::DOUBLE AS confidence FROM k""",
)
add("canonical_country", lambda s, f: listings(s, f).groupBy(op.country_of(F.col("title")).alias("country")).agg(F.count("*").alias("n")),
    f"WITH {LISTINGS} SELECT CASE WHEN o % 10 <> 0 THEN list_extract(['Austria', 'France', 'Greece'], CAST((target_id + CASE WHEN o % 11 = 0 THEN 1 ELSE 0 END) % 3 + 1 AS INTEGER)) END AS country, count(*) AS n FROM l GROUP BY ALL")
_NEGATIVE = "(o % 13 = 0 OR o % 10 IN (1, 2)) AND o % 10 <> 0"
add("negative_flags", lambda s, f: listings(s, f).select("target_id", "seq", F.array_join(t.negative_flags(F.col("title")), ",").alias("flags")),
    f"WITH {LISTINGS} SELECT target_id, seq, CASE WHEN o % 10 = 0 THEN '' ELSE concat_ws(',', CASE WHEN o % 10 = 1 THEN 'banknote' WHEN o % 10 = 2 THEN 'coin set' END, CASE WHEN o % 13 = 0 THEN 'replica' END, CASE WHEN o % 10 = 2 THEN 'set' END) END AS flags FROM l")
_MISS = "CASE WHEN o % 9 = 0 THEN 1 ELSE 0 END + CASE WHEN o % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN o % 11 = 0 THEN 1 ELSE 0 END"
_GOT = "CASE WHEN o % 9 = 0 THEN 0 ELSE 22 END + CASE WHEN o % 7 = 0 THEN 0 ELSE 28 END + CASE WHEN o % 11 = 0 THEN 0 ELSE 28 END + 16"
add("listing_match_score", lambda s, f: op.match_points(listings(s, f)).select("target_id", "seq", "listing_score"),
    f"WITH {LISTINGS}, r AS (SELECT target_id, seq, o, CASE WHEN o % 10 = 0 THEN 0 ELSE 100.0::DOUBLE * ({_GOT}) / 94 - 20 * ({_MISS}) END AS raw FROM l) "
    f"SELECT target_id, seq, CAST(round_even(greatest(0, CASE WHEN {_NEGATIVE} THEN least(raw - 45, 20) ELSE raw END), 0) AS INTEGER) AS listing_score FROM r")  # fmt: skip


def listing_pages(s: SparkSession, f: str) -> DataFrame:
    """A result page a part: its product as JSON-LD (alone, in a list, in a graph or an item of a list in a graph; every fourth has
    one related to it inside) and two table rows."""
    part, k = d.table(s, f, "part"), F.col("p_partkey")
    price = F.format_string("%.2f", F.col("p_retailprice"))
    offer = F.format_string('{"price":"%s","priceCurrency":"EUR","availability":"https://schema.org/%s"}', price, F.when(k % 6 == 0, "OutOfStock").otherwise("InStock"))
    offer = F.when(k % 2 == 0, F.concat(F.lit("["), offer, F.lit("]"))).otherwise(offer)
    related = F.when(k % 4 == 1, F.format_string(',"isRelatedTo":[[{"@type":"IndividualProduct","name":"%s","offers":{"price":%d}}]]', F.col("p_brand"), F.col("p_size"))).otherwise("")
    product = F.format_string('{"@type":"Product","name":"%s","offers":%s%s}', F.col("p_name"), offer, related)
    json = F.when(k % 3 == 0, product).when(k % 3 == 1, F.concat(F.lit("["), product, F.lit("]"))).when(k % 6 == 2, F.concat(F.lit('{"@graph":['), product, F.lit("]}")))
    json = json.otherwise(F.concat(F.lit('{"@graph":[{"@type":"ItemList","itemListElement":[{"@type":"ListItem","item":'), product, F.lit("}]}]}")))
    row = lambda n, gone: F.format_string('<tr><td><a href="item.php?id=%d"><img></a><a href="item.php?id=%d"><b>%s</b></a></td><td>%s EUR</td><td>%s</td></tr>', n, n, F.col("p_name"), price, gone)
    html = F.concat(F.lit('<html><script type="application/ld+json">'), json, F.lit("</script><table>"), row(k, F.lit("")), row(k + 1000000, F.when(k % 4 == 0, "sold").otherwise("in stock")), F.lit("</table></html>"))
    return part.select(k.alias("page_id"), html.alias("html"))


add("jsonld_offers", lambda s, f: r4(op.jsonld_offers(listing_pages(s, f))), 
    "SELECT p_partkey AS page_id, p_name AS name, round(round(p_retailprice, 2) + 1e-7, 4) AS price, 'EUR' AS currency, 'InStock' AS availability FROM part WHERE p_partkey % 6 <> 0 "
    "UNION ALL SELECT p_partkey, p_brand, p_size, 'EUR', '' FROM part WHERE p_partkey % 4 = 1")  # fmt: skip
add("html_listing_cards", lambda s, f: r4(op.listing_cards(listing_pages(s, f))),
    "SELECT p_partkey AS page_id, CAST(p_partkey AS VARCHAR) AS item_id, p_name AS title, round(round(p_retailprice, 2) + 1e-7, 4) AS price FROM part UNION ALL "
    "SELECT p_partkey, CAST(p_partkey + 1000000 AS VARCHAR), p_name, round(round(p_retailprice, 2) + 1e-7, 4) FROM part WHERE p_partkey % 4 <> 0")  # fmt: skip
