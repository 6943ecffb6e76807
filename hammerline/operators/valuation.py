"""Valuation of targets from realized sales and dealers' asks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hammerline.operators import stats

REALIZED = ("HAMMER", "REALIZED_INCL_PREMIUM")


def effective_price(c=F.col) -> Column:
    """The price of a sale: hammer or realized price by its meaning, else null."""
    return F.when(c("price_semantics") == "HAMMER", c("hammer_price")).when(c("price_semantics") == "REALIZED_INCL_PREMIUM", c("realized_price"))


def realized_eligible() -> Column:
    """Sold lots with a price; unknown `withdrawn` or `unsold` passes."""
    known = ~F.coalesce("withdrawn", F.lit(False)) & ~F.coalesce("unsold", F.lit(False))
    return known & F.col("price_semantics").isin(*REALIZED) & F.col("price").isNotNull()


def tier(score: Column) -> Column:
    return F.when(score >= 90, "EXACT").when(score >= 75, "STRONG").when(score >= 55, "SUPPORTING").otherwise("REJECT")


def source_weight() -> Column:
    known = F.col("source_url").isNotNull() & F.col("auction_date").isNotNull()
    return F.when(F.col("source") == "manual", F.when(known, 0.85).otherwise(0.65)).when(F.col("source") == "csv", 0.80).otherwise(0.90)


def age_days(as_of: str) -> Column:
    return F.greatest(F.datediff(F.lit(as_of).cast("date"), "auction_date"), F.lit(0))


def final_weight(as_of: str, half_life: int = stats.HALF_LIFE_DAYS) -> Column:
    """By match, age, source and grade; a lot without a weight of its grade weighs by the others."""
    return F.col("identity_match_score") / 100.0 * stats.recency_weight(age_days(as_of), half_life) * source_weight() * F.coalesce("grade_weight", F.lit(1.0))


def eligible_sales(comparables: DataFrame, as_of: str) -> DataFrame:
    """Priced, sold and not rejected lots with weight, outlier_flag and the adjusted weight."""
    rows = comparables.withColumn("price", effective_price()).withColumn("tier", tier(F.col("identity_match_score")))
    rows = rows.filter(realized_eligible() & (F.col("tier") != "REJECT")).withColumn("weight", final_weight(as_of))
    rows = stats.flag_outliers(rows, ["target_id"], "price")
    return rows.withColumn("adj_weight", F.col("weight") * F.when(F.col("outlier_flag").isNull(), 1.0).otherwise(stats.OUTLIER_WEIGHT))


def realized_market_summary(comparables: DataFrame, as_of: str) -> DataFrame:
    """A row a target with sales: counts by tier, weighted median and quantiles, dispersion, houses, latest."""
    rows = eligible_sales(comparables, as_of)
    points = {"weighted_median": 0.5, "p25": 0.25, "p75": 0.75, "p10": 0.1, "p90": 0.9}
    q = stats.weighted_quantiles(rows, ["target_id"], "price", "adj_weight", "seq", points)
    spread = stats.dispersion(rows, ["target_id"], "price", "seq")
    house = F.lower(F.trim("auction_house"))
    counts = rows.groupBy("target_id").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("tier") == t).alias(f"{t.lower()}_count") for t in ("EXACT", "STRONG", "SUPPORTING")],
        F.count_if(F.col("outlier_flag").isNotNull()).alias("outliers"),
        F.countDistinct(F.when(F.length("auction_house") > 0, house)).alias("houses"),
        F.max("auction_date").alias("latest_sale"),
    )
    n = F.col("n")
    note = F.when(n == 1, "single sale").when(n == 2, "two values").when(n <= 4, "low").when(n <= 9, "medium").otherwise("high")
    found = counts.join(q, "target_id").join(spread, "target_id")
    for c in ("p10", "p90"):
        found = found.withColumn(c, F.when(n >= 5, F.col(c)))
    return found.withColumn("dispersion_label", stats.dispersion_label(F.col("dispersion"))).withColumn("sample_note", note)


def dealer_market_summary(asks: DataFrame) -> DataFrame:
    """A row a target: number of positive asks, robust median, lowest and second lowest."""
    rows = stats.flag_outliers(asks.filter("price > 0"), ["target_id"], "price")
    rows = rows.withColumn("w", F.when(F.col("outlier_flag").isNull(), 1.0).otherwise(stats.OUTLIER_WEIGHT))
    q = stats.weighted_quantiles(rows, ["target_id"], "price", "w", "seq", {"dealer_median": 0.5})
    rank = F.row_number().over(Window.partitionBy("target_id").orderBy("price", "seq"))
    low = rows.withColumn("r", rank).groupBy("target_id").agg(
        F.count("*").alias("dealer_count"),
        F.max(F.when(F.col("r") == 1, F.col("price"))).alias("lowest_offer"),
        F.max(F.when(F.col("r") == 2, F.col("price"))).alias("second_lowest"),
    )
    return low.join(q, "target_id")


def disagreement_pct(dealer: Column, realized: Column) -> Column:
    return F.when(realized != 0, (dealer - realized) / realized)


def disagreement_label(pct: Column) -> Column:
    return F.when(pct.isNull(), "UNKNOWN").when(F.abs(pct) < 0.10, "ALIGNED").when(F.abs(pct) < 0.20, "MODERATE").otherwise("SIGNIFICANT")


def realized_share(n: Column, good: Column) -> Column:
    """Weight of the realized market against the dealers': by the number of exact and strong sales."""
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0.0).when(good >= 10, 0.9).when(good >= 5, 0.8).when(good >= 3, 0.7).when(good >= 1, 0.5).otherwise(0.3)


def fair_value(df: DataFrame) -> DataFrame:
    """Adds fair_low, fair_central and fair_high from weighted_median, p25, p75, dealer_median, realized_weight."""
    r, d, w = F.col("weighted_median"), F.col("dealer_median"), F.col("realized_weight")
    low, high = F.coalesce("p25", r * 0.9), F.coalesce("p75", r * 1.1)
    only_dealer, only_realized = r.isNull(), d.isNull()
    return df.withColumns(
        {
            "fair_low": F.when(only_dealer, d * 0.85).when(only_realized, low).otherwise(w * low + (1 - w) * F.least(d, low)),
            "fair_central": F.when(only_dealer, d).when(only_realized, r).otherwise(w * r + (1 - w) * d),
            "fair_high": F.when(only_dealer, d * 1.15).when(only_realized, high).otherwise(w * high + (1 - w) * F.greatest(d, high)),
        }
    )


def confidence(df: DataFrame, as_of: str | Column) -> DataFrame:
    """Adds confidence_score and confidence_label. Points first, then the hard limits in their order; the
    label is set together with a limit, not from the limited score."""
    n, good, houses = F.coalesce("n", F.lit(0)), F.coalesce(F.col("exact_count") + F.col("strong_count"), F.lit(0)), F.coalesce("houses", F.lit(0))
    age = F.datediff((F.lit(as_of) if isinstance(as_of, str) else as_of).cast("date"), "latest_sale")
    disp, quality = F.col("dispersion"), F.col("identity_quality")
    points = (
        F.bround(20 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), quality)))
        + F.when(n >= 10, 15).when(n >= 5, 12).when(n >= 3, 8).when(n >= 1, 4).otherwise(0)
        + F.when(n > 0, F.bround(15.0 * good / n)).otherwise(0)
        + F.when(age <= 365, 10).when(age <= 730, 6).when(age.isNotNull(), 2).otherwise(0)
        + 8
        + F.when(houses >= 3, 10).when(houses == 2, 6).when(houses == 1, 3).otherwise(0)
        + F.when(disp < 0.10, 10).when(disp < 0.20, 7).when(disp < 0.35, 4).otherwise(0)
        + 5
    )
    df = df.withColumn("s", F.least(F.lit(100), F.greatest(F.lit(0), points)).cast("int"))
    df = df.withColumn("l", F.when(F.col("s") >= 85, "HIGH").when(F.col("s") >= 65, "MEDIUM").when(F.col("s") >= 40, "LOW").otherwise("VERY LOW"))
    limits = [
        (n <= 2, 39, "LOW", True),
        ((houses <= 1) & (n > 0), 64, "MEDIUM", False),
        (F.coalesce(disp >= 0.35, F.lit(False)), 64, "MEDIUM", False),
        (quality < 0.75, 39, "LOW", True),
        (F.col("disagreement") == "SIGNIFICANT", 64, "MEDIUM", False),
    ]
    for where, most, label, always in limits:
        holds = where if always else where & (F.col("s") > most)
        df = df.withColumn("l", F.when(holds, label).otherwise(F.col("l"))).withColumn("s", F.when(holds, F.least("s", F.lit(most))).otherwise(F.col("s")))
    return df.withColumnRenamed("s", "confidence_score").withColumnRenamed("l", "confidence_label")


def demand_counts(comparables: DataFrame, as_of: str) -> DataFrame:
    """Lots of each target within 12 and 24 months, rejected ones included."""
    age = F.datediff(F.lit(as_of).cast("date"), "auction_date")
    return comparables.groupBy("target_id").agg(F.count_if(age.between(0, 365)).alias("last_12m"), F.count_if(age.between(0, 730)).alias("last_24m"))


def demand(df: DataFrame, as_of: str) -> DataFrame:
    """Adds demand_score and demand_label."""
    age, disp = F.datediff(F.lit(as_of).cast("date"), "latest_sale"), F.col("dispersion")
    y1, y2, houses = (F.coalesce(c, F.lit(0)) for c in ("last_12m", "last_24m", "houses"))
    total = (
        F.least(F.lit(30), y1 * 6 + y2 * 2) + F.least(F.lit(15), houses * 5) + F.least(F.lit(20), y2 * 2)
        + F.when(age <= 180, 15).when(age <= 365, 9).when(age.isNotNull(), 3).otherwise(0)
        + F.when(disp < 0.10, 20).when(disp < 0.20, 12).when(disp.isNotNull(), 5).otherwise(0)
    )
    df = df.withColumn("demand_score", F.least(F.lit(100), total).cast("int"))
    return df.withColumn("demand_label", F.when(F.col("demand_score") >= 70, "HIGH").when(F.col("demand_score") >= 40, "MEDIUM").otherwise("LOW"))


def trend(comparables: DataFrame) -> DataFrame:
    """A row a target with dated sales: medians of the older and the newer half, change a year and label."""
    rows = comparables.withColumn("price", effective_price()).filter(realized_eligible() & F.col("auction_date").isNotNull())
    rows = rows.filter(tier(F.col("identity_match_score")) != "REJECT")
    group = Window.partitionBy("target_id")
    rows = rows.withColumn("r", F.row_number().over(group.orderBy("auction_date", "seq"))).withColumn("n", F.count("*").over(group))
    older = F.col("r") <= F.floor(F.col("n") / 2)
    found = rows.groupBy("target_id").agg(
        F.max("n").alias("n"),
        F.datediff(F.max("auction_date"), F.min("auction_date")).alias("span_days"),
        F.median(F.when(older, F.col("price"))).alias("older"),
        F.median(F.when(~older, F.col("price"))).alias("newer"),
    )
    enough = (F.col("n") >= 6) & (F.col("span_days") >= 180) & (F.col("older") != 0)
    change = (F.col("newer") - F.col("older")) / F.col("older") / F.greatest(F.col("span_days") / 365.0, F.lit(0.25))
    found = found.withColumn("annual_change", F.when(enough, change))
    c = F.col("annual_change")
    return found.withColumn("trend_label", F.when(c.isNull(), "INSUFFICIENT_DATA").when(c > 0.05, "RISING").when(c < -0.05, "FALLING").otherwise("STABLE"))


def fused(df: DataFrame, as_of: str | Column) -> DataFrame:
    """Adds the fair range, the disagreement of both markets and the confidence."""
    df = df.withColumn("realized_weight", realized_share(F.col("n"), F.col("exact_count") + F.col("strong_count")))
    df = df.withColumn("disagreement_pct", disagreement_pct(F.col("dealer_median"), F.col("weighted_median")))
    df = df.withColumn("disagreement", disagreement_label(F.col("disagreement_pct")))
    return confidence(fair_value(df), as_of)


def snapshot(comparables: DataFrame, asks: DataFrame, targets: DataFrame, as_of: str) -> DataFrame:
    """The whole valuation, a row a target (target_id, identity_quality)."""
    df = targets.join(realized_market_summary(comparables, as_of), "target_id", "left").join(dealer_market_summary(asks), "target_id", "left")
    df = df.join(demand_counts(comparables, as_of), "target_id", "left").join(trend(comparables).drop("n", "span_days", "older", "newer"), "target_id", "left")
    return demand(fused(df, as_of), as_of)
