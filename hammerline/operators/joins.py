"""As-of, range and first-match joins, and merges of keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_rates(sales: DataFrame, rates: DataFrame) -> DataFrame:
    """sales (from_ccy, auction_date, any others) with rate, rate_date and is_exact: the rate of that day, else
    of the nearest earlier one. Both sides go into one order, so it is one sort and no cross product.

    The days of a currency are few; sales are first reduced to their distinct (currency, day), so that a
    currency with a third of all sales doesn't fill one task, and joined back on both columns."""
    wanted = sales.select("from_ccy", F.col("auction_date").alias("day")).distinct()
    events = rates.select("from_ccy", F.col("rate_date").alias("day"), F.struct("rate", "rate_date").alias("r")).unionByName(
        wanted.withColumn("r", F.lit(None)), allowMissingColumns=True
    )
    upto = Window.partitionBy("from_ccy").orderBy("day", F.col("r").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = events.withColumn("last", F.last("r", ignorenulls=True).over(upto)).filter("r IS NULL")
    found = found.select("from_ccy", F.col("day").alias("auction_date"), "last.rate", "last.rate_date", (F.col("last.rate_date") == F.col("day")).alias("is_exact"))
    return sales.join(found, ["from_ccy", "auction_date"], "left")


def normalize_amounts(sales: DataFrame, amount: str, currency: str = "EUR") -> DataFrame:
    """sales of asof_rates with normalized_price (two decimals, halves to even), fx_source, fx_date and
    fx_confidence. An amount in the wanted currency passes as it is; without an amount, a currency or a rate all
    four are null."""
    own, known = F.upper(F.trim("from_ccy")) == currency, F.col(amount).isNotNull() & F.col("from_ccy").isNotNull()
    rated = known & (own | F.col("rate").isNotNull())
    value = F.when(own, F.col(amount)).otherwise(F.col(amount) * F.col("rate"))
    exact = F.when(own, F.col("auction_date").isNotNull()).otherwise(F.col("is_exact"))
    return sales.withColumns({
        "normalized_price": F.when(rated, F.bround(F.round(value * 100, 4)) / 100),
        "fx_source": F.when(rated, F.when(own, "same_currency").otherwise("reference_rates")),
        "fx_date": F.when(rated, F.when(own, F.col("auction_date")).otherwise(F.col("rate_date"))),
        "fx_confidence": F.when(rated, F.when(exact, "auction_date").otherwise("current_fallback")),
    })


def best_tariff(offers: DataFrame, tariffs: DataFrame) -> DataFrame:
    """offers (offer_id, dealer, destination, price, weight) with the cost of the best fitting tariff: nearest
    destination first, then the narrowest price band, then the narrowest weight band, which is wider than any if it
    lacks a bound. A tariff of another destination fits as European Union, Europe or World; null bounds are open,
    but an offer without a weight fits no tariff with a bound of weight; free shipping costs 0."""
    place = (
        F.when(F.col("t.destination") == F.col("o.destination"), 0)
        .when((F.col("t.destination") == "European Union") & F.col("o.is_eu"), 1)
        .when((F.col("t.destination") == "Europe") & F.col("o.is_europe"), 2)
        .when(F.col("t.destination") == "World", 3)
    )
    inf = F.lit(float("inf"))
    fits = (
        (F.col("o.price") >= F.coalesce("t.price_min", F.lit(0.0))) & (F.col("o.price") <= F.coalesce("t.price_max", inf))
        & (F.col("t.weight_max").isNull() | (F.col("o.weight") <= F.col("t.weight_max")))
        & (F.col("t.weight_min").isNull() | (F.col("o.weight") >= F.col("t.weight_min")))
    )
    found = offers.alias("o").join(tariffs.alias("t"), F.col("o.dealer_group") == F.col("t.dealer_group")).filter(fits & place.isNotNull())
    span = F.coalesce("t.price_max", inf) - F.coalesce("t.price_min", F.lit(0.0))
    best = found.groupBy("o.offer_id").agg(
        F.min_by(F.struct(F.when(F.col("t.free"), 0.0).otherwise(F.col("t.cost")).alias("cost"), F.col("t.tariff_id").alias("tariff_id")), F.struct(place, span, F.coalesce(F.col("t.weight_max") - F.col("t.weight_min"), inf), F.col("t.tariff_id"))).alias("b")
    )
    return offers.join(best.select("offer_id", "b.cost", "b.tariff_id"), "offer_id", "left")


def best_spec(targets: DataFrame, specs: DataFrame) -> DataFrame:
    """targets (target_id, country, denomination, year) with the spec of their country and denomination (less than
    0.0001 apart) whose years hold theirs (open where null): verified first, then the most confident, then the
    least id.

    Specs of one country, denomination and years are first reduced to the best of them, and targets to what they ask,
    so that many targets of a coin don't each meet all its specs. Denominations meet in buckets of 0.001; a spec near
    the edge of its bucket is in the next one too."""
    bucket = lambda value: F.floor(value * 1000 + 0.5).cast("long")
    value, edge, asks = F.col("denomination_value"), 0.00011, ["land", "denomination", "year"]
    shown, rank = F.struct("id", "weight_g", "diameter_mm", "primary_metal"), F.struct("verified", "confidence", -F.col("id"))
    kinds = specs.groupBy(F.lower("country").alias("land"), "denomination_value", "year_from", "year_to").agg(F.max_by(shown, rank).alias("b"), F.max(rank).alias("rank"))
    s = kinds.withColumn("unit", F.explode(F.array_distinct(F.array(bucket(value - edge), bucket(value + edge)))))
    t = targets.select(F.lower("country").alias("land"), "denomination", "year").distinct().withColumn("unit", bucket(F.col("denomination")))
    fits = (F.abs(F.col("denomination") - value) < 1e-4) & (F.col("year") >= F.coalesce("year_from", F.lit(0))) & (F.col("year") <= F.coalesce("year_to", F.lit(9999)))
    found = t.join(s, ["land", "unit"]).filter(fits).groupBy(*asks).agg(F.max_by("b", "rank").alias("b"))
    found = found.select(*asks, F.col("b.id").alias("spec_id"), "b.weight_g", "b.diameter_mm", "b.primary_metal")
    return targets.withColumn("land", F.lower("country")).join(found, asks, "left").select(*targets.columns, "spec_id", "weight_g", "diameter_mm", "primary_metal")


def latest_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the last in the order (which ends in a unique column)."""
    last = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("rn", F.row_number().over(last)).filter("rn = 1").drop("rn")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same keys: a snapshot to write anew."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new whose keys it lacks."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"))
