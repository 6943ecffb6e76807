"""Readers of landed files of realized sales: CSV and free-text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a sale and the names that a CSV header may give (fixed values).
COLUMNS = ["date", "hammer", "currency", "grade", "auction_house", "url", "auction_name", "lot_number", "grading_company", "cert_number"]


def strict_date(text: Column) -> Column:
    """Dates written YYYY-MM-DD; all else is null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def amount(text: Column) -> Column:
    """A number with a decimal point or comma."""
    clean = F.trim(text)
    return F.when(clean.rlike(r"^-?\d+([.,]\d+)?$"), F.replace(clean, F.lit(","), F.lit(".")).cast("double"))


def read_comparables_csv(spark: SparkSession, path: str, default_currency: str = "EUR") -> DataFrame:
    """Sales of CSV files whose header may have any case and order. Only `hammer` must be there; rows
    without a positive hammer price are left out, dates that are not strict become null."""
    rows = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    rows = rows.toDF(*[c.strip().lower() for c in rows.columns])
    if "hammer" not in rows.columns:
        raise ValueError("the column hammer is missing")
    found = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS])
    return _sales(found, default_currency, "csv")


def read_comparables_lines(spark: SparkSession, path: str, default_currency: str = "EUR") -> DataFrame:
    """Sales of text lines: a number alone, or date | hammer | currency | grade | house | url, the last four
    optional. Lines of neither kind are left out."""
    parts = F.transform(F.split("value", r"\|"), lambda x: F.trim(x))
    lines = spark.read.text(path).withColumn("p", parts)
    piped = F.size("p") >= 2
    field = lambda k: F.when(piped, F.nullif(F.get("p", k), F.lit("")))
    found = lines.select(
        field(0).alias("date"), F.when(piped, F.get("p", 1)).otherwise(F.get("p", 0)).alias("hammer"), field(2).alias("currency"), field(3).alias("grade"),
        field(4).alias("auction_house"), field(5).alias("url"), *[F.lit(None).cast("string").alias(c) for c in COLUMNS[6:]],
    )
    return _sales(found, default_currency, "manual")


def _sales(rows: DataFrame, default_currency: str, source: str) -> DataFrame:
    rows = rows.withColumn("hammer", amount(F.col("hammer"))).filter("hammer > 0").withColumn("date", strict_date(F.col("date")))
    return rows.select(
        F.lit(source).alias("source"), F.col("date").alias("auction_date"), F.col("hammer").alias("hammer_price"), F.upper(F.coalesce("currency", F.lit(default_currency))).alias("currency"),
        F.col("grade").alias("grade_raw"), "auction_house", F.col("url").alias("source_url"), "auction_name", "lot_number", "grading_company", "cert_number",
        F.lit("HAMMER").alias("price_semantics"), F.lit(True).alias("sold"),
    )


def _number(text: Column) -> Column:
    """A decimal number; blank and nan are null."""
    clean = F.lower(F.trim(text))
    return F.when((clean != "") & (clean != "nan"), clean.try_cast("double"))


def read_shipping_tariffs(spark: SparkSession, path: str) -> DataFrame:
    """Tariffs of CSV files with a header: bounds and cost as numbers (blank or nan is null), EUR where no
    currency is given, free_shipping from 1, true or yes."""
    rows = spark.read.option("header", True).csv(path)
    column = lambda name: F.trim(F.coalesce(F.col(name), F.lit(""))) if name in rows.columns else F.lit("")
    numbers = {"price_min": "price_tier_min", "price_max": "price_tier_max", "weight_min": "weight_tier_min_g", "weight_max": "weight_tier_max_g", "cost": "cost"}
    return rows.select(
        F.lower(column("dealer_slug")).alias("dealer_slug"), column("destination").alias("destination"), *[_number(column(c)).alias(n) for n, c in numbers.items()],
        F.upper(F.coalesce(F.nullif(column("currency"), F.lit("")), F.lit("EUR"))).alias("currency"), F.lower(column("free_shipping")).isin("1", "true", "yes").alias("free_shipping"), column("tier_label").alias("tier_label"),
    )


#: Feed elements and their fields (fixed values).
RSS = "title string, link string, pubDate string, description string"
ATOM = "title string, link struct<_href:string>, published string, updated string, summary string"


def read_feed_items(spark: SparkSession, path: str, feed_a_line: bool = False) -> DataFrame:
    """(title, link, at, summary) of the RSS items and Atom entries of files that hold a feed each (or lines that
    do). Items without a title or a link are left out, undated ones stay, broken ones cost no others."""
    from hammerline.functions import catalogue, text

    feeds = spark.read.option("wholetext", not feed_a_line).text(path)

    def elements(tag: str, schema: str) -> DataFrame:
        parts = F.regexp_extract_all("value", F.lit(rf"(?s)(<{tag}\b.*?</{tag}>)"), F.lit(1))
        return feeds.select(F.explode(parts).alias("x")).select(F.from_xml("x", schema).alias("x")).select("x.*")

    rss = elements("item", RSS).select("title", "link", F.col("pubDate").alias("day"), F.col("description").alias("body"))
    atom = elements("entry", ATOM).select("title", F.col("link._href").alias("link"), F.coalesce("published", "updated").alias("day"), F.col("summary").alias("body"))
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    rows = rss.union(atom).select(clean("title").alias("title"), clean("link").alias("link"), catalogue.feed_date(F.col("day")).alias("at"), text.summary(F.col("body")).alias("summary"))
    return rows.filter("title IS NOT NULL AND link IS NOT NULL")


def read_spec_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(country, denomination, weight_g, diameter_mm, metal, pos): a row for each country of each record of JSON
    files that hold a list of records each (or lines that do); pos is the record's place in its list."""
    kind = "records array<struct<denomination:double,weight_g:double,diameter_mm:double,metal:string,countries:array<string>>>"
    records = spark.read.schema(kind).option("multiLine", multi_line).json(path).select(F.posexplode("records").alias("pos", "r"))
    return records.select(F.explode("r.countries").alias("country"), "r.denomination", "r.weight_g", "r.diameter_mm", "r.metal", "pos")


#: Words too short or too common to name a currency or country alone (fixed values).
COMMON = ["a", "an", "and", "at", "by", "de", "del", "der", "die", "du", "el", "en", "et", "for", "il", "in", "la", "le", "of", "on", "or", "the", "to", "us"]
ONTOLOGY = """code string, name string, aliases array<string>, currencies array<struct<code:string, aliases:array<string>,
    subunits:array<struct<name:string,aliases:array<string>>>, special_denominations:array<struct<value:double,aliases:array<string>>>>>"""


def read_alias_ontology(spark: SparkSession, path: str) -> DataFrame:
    """(kind, alias, country_code, currency_code, special_value): aliases of countries, currencies, subunits and
    special denominations from JSON lines, a country each; in lower case, without common words, distinct."""
    rows = spark.read.schema(ONTOLOGY).json(path)
    money = rows.select("code", F.explode("currencies").alias("c"))
    none, no_value = F.lit(None).cast("string"), F.lit(None).cast("double")

    def named(kind: str, source: DataFrame, aliases: Column, currency: Column = none, value: Column = no_value) -> DataFrame:
        return source.select(F.lit(kind).alias("kind"), F.explode(aliases).alias("alias"), F.col("code").alias("country_code"), currency.alias("currency_code"), value.alias("special_value"))

    subunits = money.select("code", "c.code", F.explode("c.subunits").alias("s")).toDF("code", "currency", "s")
    special = money.select("code", "c.code", F.explode("c.special_denominations").alias("s")).toDF("code", "currency", "s")
    found = named("country", rows, F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("name")))
    found = found.union(named("currency", money, F.col("c.aliases"), F.col("c.code")))
    found = found.union(named("subunit", subunits, F.array_append(F.coalesce("s.aliases", F.array().cast("array<string>")), F.col("s.name")), F.col("currency")))
    found = found.union(named("special", special, F.col("s.aliases"), F.col("currency"), F.col("s.value")))
    alias = F.lower(F.trim("alias"))
    return found.withColumn("alias", alias).filter((F.length("alias") > 1) & ~F.col("alias").isin(COMMON)).distinct()
