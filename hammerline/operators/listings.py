"""Listings: offers read from pages, and the checks that a listing is what a search asked for."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hammerline.functions import denominations as dn
from hammerline.functions import text as t
from hammerline.functions.assets import classify
from hammerline.functions.places import country_in, country_of
from hammerline.sources.landed import amount
from hammerline.streaming.streams import shared_dir

#: Words of grade tiers (fixed values).
MINT, CIRCULATED = r"\b(unc|bu|ms|proof|uncirculated)\b", r"\b(vf|xf|ef|fine|vg|good|circulated)\b"


def grade_tier(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.rlike(MINT), "MINT").when(low.rlike(CIRCULATED), "CIRCULATED")


def asset_class(text: Column) -> Column:
    return classify(text)["asset"]


def differs(found: Column, wanted: Column) -> Column:
    """Both are stated and they differ."""
    return F.coalesce(found != wanted, F.lit(False))


def hard_filter(listings: DataFrame) -> DataFrame:
    """Adds reasons against a listing (title beside t_value, t_unit, t_year, t_country, t_grade of its search): an
    empty title alone is EMPTY_TEXT; otherwise all that apply. What a title doesn't state is no reason."""
    title = F.coalesce("title", F.lit(""))
    stated, wanted = dn.extract_denominations(title), (F.col("t_value"), F.col("t_unit"))
    reasons = F.array_compact(
        F.array(
            F.when(asset_class(title) == "BANKNOTE", "BANKNOTE"),
            F.when(t.product_scope(title) == "SET", "NOT_SINGLE_COIN"),
            F.when(t.let(stated, lambda found: dn.conflicts(found, *wanted)), "DENOMINATION_MISMATCH"),
            F.when(differs(t.parse_year(title), F.col("t_year")), "YEAR_MISMATCH"),
            F.when(differs(country_of(title), F.col("t_country")), "COUNTRY_MISMATCH"),
            F.when(differs(grade_tier(title), F.col("t_grade")), "GRADE_MISMATCH"),
            F.when(t.is_negative(title), "NEGATIVE_PRODUCT_FLAG"),
        )
    )
    return listings.withColumn("reasons", F.when(F.trim(title) == "", F.array(F.lit("EMPTY_TEXT"))).otherwise(reasons))


#: Points of the fields of a search that a title agrees with, and what each of the first three costs if it doesn't (fixed values).
POINTS = {"country": 28, "year": 28, "denomination": 22, "currency": 16, "issuer": 6, "mintmark": 5, "variant": 4}
NEEDED, COST, NEGATIVE_COST, NEGATIVE_MOST = ("country", "year", "denomination"), 20, 45, 20


def match_points(listings: DataFrame) -> DataFrame:
    """Adds listing_score, 0 to 100: points of the fields that the title agrees with as a share of those the search
    states (t_country, t_year, t_value, t_unit, and t_issuer, t_mintmark, t_variant where there are such columns), less
    twenty for each of country, year and denomination that it doesn't; with a word of other products 45 less and 20
    at most. A value agrees as a number alone or within a denomination, a variant in 60 percent of its words."""
    title = F.coalesce("title", F.lit(""))
    has = lambda c: F.col(c) if c in listings.columns else F.lit(None).cast("string")
    padded = F.concat(F.lit(" "), t.norm(title), F.lit(" "))
    holds = lambda words: F.contains(padded, F.concat(F.lit(" "), t.norm(words), F.lit(" ")))
    stands = lambda number: F.call_function("regexp_like", title, F.concat(F.lit("(?<![0-9])"), F.replace(number, F.lit("."), F.lit("[.]")), F.lit("(?![0-9])")))
    value = F.regexp_replace(F.col("t_value").cast("decimal(18,6)").cast("string"), r"\.?0+$", "")
    stated = dn.extract_denominations(title)
    unit = F.exists(stated, lambda d: d.unit == F.col("t_unit")) | holds(F.col("t_unit"))
    agrees = {
        "country": (F.col("t_country"), country_in(title, F.col("t_country"))), "year": (F.col("t_year"), stands(F.col("t_year").cast("string"))),
        "denomination": (F.col("t_value"), stands(value) | dn.fits(stated, F.col("t_value"), F.coalesce("t_unit", F.lit("?")))), "currency": (F.col("t_unit"), unit),
        "issuer": (has("t_issuer"), holds(has("t_issuer"))), "mintmark": (has("t_mintmark"), holds(has("t_mintmark"))),
        "variant": (has("t_variant"), t.variant_matches(t.variant_tokens(has("t_variant")), title)),
    }
    total = sum((F.when(w.isNotNull(), POINTS[n]).otherwise(0) for n, (w, _) in agrees.items()), F.lit(0))
    got = sum((F.when(w.isNotNull() & F.coalesce(ok, F.lit(False)), POINTS[n]).otherwise(0) for n, (w, ok) in agrees.items()), F.lit(0))
    missed = sum((F.when(agrees[n][0].isNotNull() & ~F.coalesce(agrees[n][1], F.lit(False)), 1).otherwise(0) for n in NEEDED), F.lit(0))
    raw = F.when(total > 0, 100.0 * got / total).otherwise(0.0) - COST * missed
    score = F.when(t.is_negative(title), F.least(raw - NEGATIVE_COST, F.lit(NEGATIVE_MOST))).otherwise(raw)
    return listings.withColumn("listing_score", F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).cast("int"))


#: Kinds of JSON-LD objects that are offered, and endings of their availability that rule them out (fixed values).
PRODUCTS, GONE = ("Product", "IndividualProduct"), ("outofstock", "soldout", "discontinued")


def json_objects(texts: DataFrame, json_col: str, mark: str) -> DataFrame:
    """texts with v in place of json_col: a row for every JSON object, at any depth, in whose text the mark stands.

    Each round takes the objects and lists of one depth apart, so there are as many rounds as the deepest of these
    objects has lists and objects around it; what doesn't hold the mark goes no further. Broken JSON has none."""
    spark, others = texts.sparkSession, [c for c in texts.columns if c != json_col]
    folder = f"{shared_dir(spark)}/objects-{uuid.uuid4().hex}"
    level, depth = texts.select(*others, F.try_parse_json(json_col).alias("v")), 0
    while True:
        level.filter(F.to_json("v").contains(mark)).select(*others, "v").write.parquet(f"{folder}/depth={depth}")
        level = spark.read.schema(level.select(*others, "v").schema).parquet(f"{folder}/depth={depth}")
        if level.isEmpty():
            break
        inner = spark.tvf.variant_explode(F.col("v").outer()).select(F.col("value").alias("part"))
        level, depth = level.lateralJoin(inner).select(*others, F.col("part").alias("v")), depth + 1
    found = spark.read.schema(level.schema).parquet(folder)
    return found.select(*others, "v").filter(F.schema_of_variant("v").startswith("OBJECT"))


def jsonld_offers(pages: DataFrame) -> DataFrame:
    """A row a product in the pages' JSON-LD (page_id, html), at any depth, also inside other products: page_id,
    name, price, currency, availability. The first offer counts; products without a price or sold out are left
    out; a missing currency is EUR."""
    scripts = F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    objects = json_objects(pages.select("page_id", F.explode(scripts).alias("j")), "j", "Product")
    get = lambda v, path, kind="string": F.try_variant_get(v, path, kind)
    first = F.coalesce(get("v", "$.offers[0]", "variant"), get("v", "$.offers", "variant"))
    items = objects.filter(get("v", "$['@type']").isin(*PRODUCTS)).select("page_id", F.coalesce(get("v", "$.name"), F.lit("")).alias("name"), first.alias("o"))
    stated = F.coalesce(get("o", "$.availability"), F.lit(""))
    gone = F.exists(F.array(*map(F.lit, GONE)), lambda x: F.contains(F.replace(F.lower(stated), F.lit(" ")), x))
    found = items.select("page_id", "name", t.parse_number(get("o", "$.price")).alias("price"), F.coalesce(get("o", "$.priceCurrency"), F.lit("EUR")).alias("currency"), F.regexp_extract(stated, "([A-Za-z]*)$", 1).alias("availability"), gone.alias("gone"))
    return found.filter(~F.col("gone") & F.col("price").isNotNull()).drop("gone")


def listing_cards(pages: DataFrame) -> DataFrame:
    """A row an item of result tables: page_id, item_id, title (the longest link text), price. Rows that say
    the item is gone, and prices outside 0 to 200,000, are left out."""
    rows = pages.select("page_id", F.explode(F.split("html", r"(?i)<tr\b")).alias("row"))
    link = r"(?is)<a[^>]*item\.php\?id=[0-9]+[^>]*>(.*?)</a>"
    texts = F.transform(F.regexp_extract_all("row", F.lit(link), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", "")))
    plain = F.regexp_replace("row", "<[^>]*>", " ")
    found = rows.select(
        "page_id", F.regexp_extract("row", r"item\.php\?id=([0-9]+)", 1).alias("item_id"), F.array_max(F.transform(texts, lambda x: F.struct(F.length(x).alias("n"), x.alias("t")))).alias("best"),
        amount(F.regexp_extract(plain, r"([0-9]+(?:[.,][0-9]+)?) (?:EUR|€)", 1)).alias("price"), t.looks_unavailable(plain).alias("gone"),
    )
    found = found.filter((F.col("item_id") != "") & ~F.col("gone") & (F.col("price") > 0) & (F.col("price") <= 200000))
    found = found.groupBy("page_id", "item_id").agg(F.max_by(F.struct("best.t", "price"), F.struct("best.n", "price")).alias("b"))
    return found.select("page_id", "item_id", F.col("b.t").alias("title"), "b.price")


def strict_filter(listings: DataFrame) -> DataFrame:
    """Adds reasons against a listing as evidence of a specification: what a title doesn't state is one as well."""
    title = F.coalesce("title", F.lit(""))
    stated, wanted = dn.extract_denominations(title), (F.col("t_value"), F.col("t_unit"))
    agrees = lambda found, wanted: F.coalesce(found == wanted, F.lit(False)) | wanted.isNull()
    reasons = F.array(
        F.when(asset_class(title) != "COIN", "NOT_COIN"),
        F.when(t.product_scope(title) == "SET", "NOT_SINGLE_COIN"),
        F.when(~dn.fits(stated, *wanted), "DENOMINATION_MISMATCH"),
        F.when(~agrees(t.parse_year(title), F.col("t_year")), "YEAR_MISMATCH"),
        F.when(~agrees(country_of(title), F.col("t_country")), "COUNTRY_MISMATCH"),
    )
    return listings.withColumn("reasons", F.array_compact(reasons))


#: Wordings of a type that lift a listing of a United States dollar, and by how much (fixed values).
TYPE_WORDS = {"peace dollar": 0.18, "morgan dollar": 0.10, "silver dollar": 0.08}


def type_bonus(title: Column, country: Column, denomination: Column) -> Column:
    """What the wordings of a type in a title add to its rank; 0 for other searches and for null titles."""
    wanted = (F.lower(F.trim(country)) == "united states") & F.contains(t.norm(denomination), F.lit("dollar"))
    total = sum((F.when(t.contains_phrase(title, words), points).otherwise(0.0) for words, points in TYPE_WORDS.items()), F.lit(0.0))
    return F.when(F.coalesce(wanted, F.lit(False)), total).otherwise(0.0)


def title_score(listings: DataFrame, similarity, variant_col: str | None = None) -> DataFrame:
    """Adds title_score: likeness of the title and the search's words, and a bonus for each field that agrees.
    variant_col: the column with the variant that is searched for; a search without one agrees with all titles."""
    title = F.coalesce("title", F.lit(""))
    stated, wished = dn.extract_denominations(title), (F.col("t_value"), F.col("t_unit"))
    variant = t.variant_tokens(F.col(variant_col)) if variant_col else F.array().cast("array<string>")
    wanted = F.concat_ws(" ", "t_country", F.col("t_value").cast("int").cast("string"), "t_unit", "t_year", *([variant_col] if variant_col else []))
    bonus = lambda ok, points: F.when(F.coalesce(ok, F.lit(False)), points).otherwise(0.0)
    extra = (
        bonus(country_of(title) == F.col("t_country"), 0.18) + bonus(dn.fits(stated, *wished), 0.22)
        + bonus(t.parse_year(title) == F.col("t_year"), 0.2) + bonus(grade_tier(title) == F.col("t_grade"), 0.08)
        + bonus((F.size(variant) == 0) | t.variant_matches(variant, title), 0.1)
    )
    score = F.when(F.trim(title) == "", 0.0).otherwise(similarity(t.norm(title), t.norm(wanted)) + extra)
    return listings.withColumn("title_score", score)
