"""Agreement of sources on physical specifications, and audits of the specification table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Euro coins: denomination, weight in grams, diameter in millimetres (fixed values).
EURO_PROFILES = [(0.01, 2.30, 16.25), (0.02, 3.06, 18.75), (0.05, 3.92, 21.25), (0.10, 4.10, 19.75), (0.20, 5.74, 22.25), (0.50, 7.80, 24.25), (1.0, 7.50, 23.25), (2.0, 8.50, 25.75)]
#: First year of euro coins by issuer (fixed values).
EURO_STARTS = {
    "Andorra": 2014, "Austria": 2002, "Belgium": 1999, "Bulgaria": 2026, "Croatia": 2023, "Cyprus": 2008, "Estonia": 2011, "Finland": 1999,
    "France": 1999, "Germany": 2002, "Greece": 2002, "Ireland": 2002, "Italy": 2002, "Latvia": 2014, "Lithuania": 2015, "Luxembourg": 2002,
    "Malta": 2008, "Monaco": 2002, "Netherlands": 1999, "Portugal": 2002, "San Marino": 2002, "Slovakia": 2009, "Slovenia": 2007, "Spain": 1999,
    "Vatican City": 2002,
}
PRECIOUS = ("gold", "silver", "platinum", "palladium")


def first_per_dealer(rows: DataFrame, item: str, dealer: str, value: str) -> DataFrame:
    """The first value of each dealer for an item: repeats of one source are no agreement."""
    order = Window.partitionBy(item, dealer).orderBy("seq")
    rows = rows.filter(F.col(value).isNotNull()).withColumn("rn", F.row_number().over(order))
    return rows.filter("rn = 1").select(item, dealer, "seq", F.col(value).alias("value"))


def exact_consensus(rows: DataFrame, item: str, dealer: str, value: str) -> DataFrame:
    """item, value, support: the value that most dealers give, ties to the one seen first."""
    votes = first_per_dealer(rows, item, dealer, value).groupBy(item, "value").agg(F.count("*").alias("support"), F.min("seq").alias("first"))
    return votes.groupBy(item).agg(F.max_by(F.struct("value", "support"), F.struct("support", -F.col("first"))).alias("b")).select(item, "b.value", "b.support")


def _supports(values: DataFrame, item: str, absolute: float, relative: float) -> DataFrame:
    """values (item, value, k) with support: the sum of k of the item's values within max(absolute, relative * |value|)
    of each, by one order of the item's values and their reaches: n log n steps an item, one shuffle.

    Both ways from a value are looked at as upwards, downwards on negated values: the running sum at the end of its
    reach, less the sum before it. A reach ends at a rounded sum, and whether a value lies within is asked of rounded
    differences; so it ends some units of the last place further, and of the last four values before its end the
    first that is within counts (no more lie in so small a space, and the value itself always is within)."""
    width = lambda a: F.greatest(F.lit(absolute), F.abs(a) * relative)
    both = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), (F.col("value") * side).alias("v")) for side in (1, -1)]))
    rows = values.repartition(F.col(item)).select(*values.columns, both.alias("s")).select(*values.columns, "s.*")
    order = Window.partitionBy(item, "side").orderBy("v")
    rows = rows.withColumn("upto", F.sum("k").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.array(F.struct("v", "upto"), *[F.struct(F.lag("v", i).over(order).alias("v"), F.lag("upto", i).over(order).alias("upto")) for i in (1, 2, 3)])
    end = (F.col("v") + width(F.col("v"))) + (F.abs("v") + width(F.col("v"))) * 1e-15
    events = rows.withColumn("last", last).withColumn("e", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("v").alias("at")), F.struct(F.lit(1).alias("kind"), end.alias("at")))))
    seen = F.last(F.when(F.col("e.kind") == 0, F.col("last")), ignorenulls=True).over(Window.partitionBy(item, "side").orderBy("e.at", "e.kind").rowsBetween(Window.unboundedPreceding, 0))
    reached = events.withColumn("seen", seen).filter("e.kind = 1")
    inside = F.get(F.filter("seen", lambda x: F.abs(x.v - F.col("v")) <= width(F.col("v"))), 0)
    # each side counts the value itself once
    ahead = reached.withColumn("ahead", inside["upto"] - F.col("upto"))
    others = [c for c in values.columns if c not in (item, "value")]
    return ahead.groupBy(item, "value").agg(*[F.first(c).alias(c) for c in others], (F.sum("ahead") + F.first("k")).alias("support"))


def numeric_consensus(rows: DataFrame, item: str, dealer: str, value: str, absolute: float, relative: float) -> DataFrame:
    """item, value, support: the largest cluster within max(absolute, relative * anchor) of one dealer's
    value (first anchor on ties), and its median.

    A cluster is counted on the distinct values of an item and their numbers of dealers; the number of distinct
    values is bounded by the measuring, not by the dealers."""
    ones = first_per_dealer(rows, item, dealer, value)
    values = ones.groupBy(item, "value").agg(F.count("*").alias("k"), F.min("seq").alias("first"))
    counted = _supports(values, item, absolute, relative)
    best = counted.groupBy(item).agg(F.max_by(F.struct("support", F.col("value").alias("anchor")), F.struct("support", -F.col("first"))).alias("b")).select(item, "b.*")
    members = counted.drop("support").join(best, item).filter(F.abs(F.col("value") - F.col("anchor")) <= F.greatest(F.lit(absolute), F.abs("anchor") * relative))
    return members.groupBy(item).agg(F.expr("percentile(value, 0.5, k)").alias("value"), F.max("support").alias("support"))


def recompute_canonical(rows: DataFrame, item: str, dealer: str, fields: dict[str, int]) -> DataFrame:
    """item and, for each field, the rounded value that most distinct dealers give (ties to the smallest),
    if two or more do; confidence by how many fields are agreed on."""
    long = None
    for f, digits in fields.items():
        part = rows.filter(F.col(f).isNotNull()).select(item, dealer, F.lit(f).alias("field"), F.round(f, digits).alias("value"))
        long = part if long is None else long.union(part)
    votes = long.groupBy(item, "field", "value").agg(F.countDistinct(dealer).alias("n")).filter("n >= 2")
    best = votes.groupBy(item, "field").agg(F.max_by("value", F.struct("n", -F.col("value"))).alias("value"))
    wide = best.groupBy(item).pivot("field", list(fields)).agg(F.first("value"))
    agreed = sum((F.col(f).isNotNull().cast("int") for f in list(fields)[1:]), F.col(list(fields)[0]).isNotNull().cast("int"))
    found = rows.select(item).distinct().join(wide, item, "left")
    return found.withColumn("confidence", F.when(agreed == len(fields), "HIGH").when(agreed >= 1, "MEDIUM").otherwise("UNVERIFIED"))


def euro_profile() -> Column:
    hit = F.lit(False)
    for v, w, d in EURO_PROFILES:
        hit = hit | ((F.abs(F.col("denomination_value") - v) < 1e-9) & (F.abs(F.col("weight_g") - w) <= 0.02) & (F.abs(F.col("diameter_mm") - d) <= 0.03))
    return F.coalesce(hit, F.lit(False))


def precious_metal() -> Column:
    metal = F.lower(F.coalesce("primary_metal", F.lit("")))
    return metal.rlike("|".join(PRECIOUS)) & ~metal.contains("nordic gold")


def anchor_year() -> Column:
    return F.coalesce("issue_year", "year_from")


def euro_start() -> Column:
    """First year of euro coins of the row's country, however it is cased; null for others."""
    years = F.create_map(*[F.lit(x) for country, year in EURO_STARTS.items() for x in (country.lower(), year)])
    return F.try_element_at(years, F.lower(F.trim("country")))


def euro_conflict() -> Column:
    return euro_profile() & precious_metal()


def euro_year_invalid() -> Column:
    return euro_profile() & F.coalesce(anchor_year() < euro_start(), F.lit(False))


def missing_fields() -> Column:
    lacks = lambda c: F.when(F.col(c).isNull(), c)
    fineness = F.when(precious_metal() & F.col("fineness_per_mille").isNull(), "fineness_per_mille")
    return F.array_compact(F.array(lacks("weight_g"), lacks("diameter_mm"), lacks("primary_metal"), fineness))


def incomplete(specs: DataFrame) -> DataFrame:
    """Rows that lack a field, without those that contradict themselves or name no year."""
    rows = specs.filter(~euro_conflict() & ~euro_year_invalid() & anchor_year().isNotNull())
    rows = rows.withColumn("missing", missing_fields()).withColumn("series_mode", F.col("issue_year").isNull())
    return rows.filter(F.size("missing") > 0).withColumn("representative_year", anchor_year())


def sampled(rows: DataFrame, code: str, *shown: str, most: int = 20, parts: int = 256) -> DataFrame:
    """(code, n, samples): how many rows bear a code, and those with the `most` least values of the shown columns
    (they should be unique together), in one pass over the rows. A code's rows are numbered in `parts` parts, so that
    a code of all rows is shared by many tasks; no more than `most` of each part meet in the end."""
    part = Window.partitionBy(code, F.pmod(F.hash(*shown), F.lit(parts))).orderBy(*shown)
    first = F.when(F.row_number().over(part) <= most, F.struct(*shown))
    found = rows.select(code, first.alias("first")).groupBy(code).agg(F.count("*").alias("n"), F.collect_list("first").alias("all"))
    return found.select(code, "n", F.slice(F.array_sort("all"), 1, most).alias("samples"))


def completeness(specs: DataFrame) -> DataFrame:
    m = missing_fields()
    fields = ("weight_g", "diameter_mm", "primary_metal", "fineness_per_mille")
    plain = ~precious_metal() & F.col("primary_metal").isNotNull() & F.col("fineness_per_mille").isNull() & (F.size(m) == 0)
    return specs.agg(
        F.count("*").alias("total"), F.count("issue_year").alias("issue_specific"), F.count_if(F.size(m) == 0).alias("complete"), F.count_if(F.size(m) > 0).alias("incomplete"),
        F.count_if(F.coalesce(plain, F.lit(False))).alias("base_metal_complete"), *[F.count_if(F.array_contains(m, c)).alias(f"lacks_{c}") for c in fields],
    )


def completeness_samples(specs: DataFrame, most: int = 20) -> DataFrame:
    """(code, n, samples): rows that are complete, incomplete or lack a field, with the least ids of each."""
    m = missing_fields()
    codes = F.concat(F.array(F.when(F.size(m) == 0, "complete").otherwise("incomplete")), F.transform(m, lambda c: F.concat(F.lit("lacks_"), c)))
    return sampled(specs.select("id", F.explode(codes).alias("code")), "code", "id", most=most)


#: Rules of integrity whose violation forbids unattended work.
BLOCKING = ("euro_conflict", "fineness_range", "no_year", "overlap")


def integrity(specs: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """code, n, example (least id), blocking: violations of each rule. selected: ids chosen for further work; one that
    contradicts itself as a euro coin violates overlap."""
    rules = {
        "euro_conflict": euro_conflict(),
        "euro_year": euro_year_invalid(),
        "fineness_range": F.coalesce((F.col("fineness_per_mille") <= 0) | (F.col("fineness_per_mille") > 1000), F.lit(False)),
        "no_year": anchor_year().isNull(),
    }
    codes = F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()]))
    found = specs.select("id", F.explode(codes).alias("code"))
    if selected is not None:
        found = found.union(found.filter("code = 'euro_conflict'").join(selected.select("id").distinct(), "id", "left_semi").select("id", F.lit("overlap")))
    return found.groupBy("code").agg(F.count("*").alias("n"), F.min("id").alias("example")).withColumn("blocking", F.col("code").isin(*BLOCKING))


def repeated_fingerprints(specs: DataFrame, rows: int = 4, countries: int = 3) -> DataFrame:
    found = specs.filter("weight_g IS NOT NULL AND diameter_mm IS NOT NULL").groupBy(F.round("weight_g", 3).alias("weight_g"), F.round("diameter_mm", 3).alias("diameter_mm"), F.lower("primary_metal").alias("metal"))
    return found.agg(F.count("*").alias("n"), F.countDistinct("country").alias("countries")).filter((F.col("n") >= rows) & (F.col("countries") >= countries))
