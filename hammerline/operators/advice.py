"""Advice to bidders and consignors from valuation snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: By confidence label (fixed values): band of the margin of safety, collector premium, widening of the
#: estimate, reserve as a share of the low estimate.
BY_CONFIDENCE = {
    "HIGH": (0.10, 0.15, 1.08, 1.00, 0.95),
    "MEDIUM": (0.15, 0.22, 1.10, 1.08, 0.85),
    "LOW": (0.22, 0.30, 1.15, 1.18, 0.75),
    "VERY LOW": (0.30, 0.40, 1.20, 1.30, 0.65),
}
OTHERWISE = (0.22, 0.30, 1.15, 1.20, 0.70)


def _by_label(k: int) -> Column:
    found = F.lit(OTHERWISE[k])
    for label, values in BY_CONFIDENCE.items():
        found = F.when(F.col("confidence_label") == label, values[k]).otherwise(found)
    return found


def margin_of_safety() -> Column:
    """Middle of the label's band, three points up for each risk, at most six above the band."""
    risks = (
        F.when(F.col("dispersion_label").isin("WIDE", "VERY_WIDE"), 1).otherwise(0)
        + F.when(F.col("disagreement") == "SIGNIFICANT", 1).otherwise(0)
        + F.when(F.coalesce("houses", F.lit(0)) <= 1, 1).otherwise(0)
    )
    low, high = _by_label(0), _by_label(1)
    return F.round(F.least((low + high) / 2 + risks * 0.03, high + 0.06), 4)


def ceilings(snapshots: DataFrame) -> DataFrame:
    """Adds margin and the all-in budgets value_max, fair_max and collector_max; null without a fair value."""
    df = snapshots.withColumn("margin", F.when(F.col("fair_central").isNotNull(), margin_of_safety()))
    margin, central = F.col("margin"), F.col("fair_central")
    return df.withColumns(
        {
            "value_max": F.coalesce("fair_low", central * (1 - margin)) * (1 - margin),
            "fair_max": central,
            "collector_max": F.coalesce("fair_high", central * (1 + margin)) * _by_label(2),
        }
    )


def hammer_from_all_in(all_in: Column) -> Column:
    left = all_in - F.col("shipping") - F.col("fixed_fees") - F.col("taxes")
    return F.when(all_in.isNull(), None).when(left <= 0, 0.0).otherwise(left / (1 + F.col("buyer_premium_pct") / 100.0))


def all_in_cost(hammer: Column) -> Column:
    return hammer * (1 + F.col("buyer_premium_pct") / 100.0) + F.col("shipping") + F.col("fixed_fees") + F.col("taxes")


def recommendation(all_in: Column) -> Column:
    value, fair, most = F.col("value_max"), F.col("fair_max"), F.col("collector_max")
    return (
        F.when(value.isNull() | fair.isNull() | most.isNull(), "UNKNOWN").when(all_in <= value * 0.9, "STRONG BUY").when(all_in <= value, "BUY")
        .when(all_in <= fair, "FAIR").when(all_in <= most, "CAUTION").when(all_in <= most * 1.15, "STOP").otherwise("OVERPAY")
    )


def bid_advice(bids: DataFrame, snapshots: DataFrame) -> DataFrame:
    """A row a bid: budgets as all-in and as hammer price, current cost, recommendation. A bid that is not a
    positive number has no verdict; a bid without a snapshot is UNKNOWN. bids may be a stream."""
    columns = ["target_id", "fair_low", "fair_central", "fair_high", "confidence_label", "dispersion_label", "disagreement", "houses"]
    df = bids.join(ceilings(snapshots.select(*columns)), "target_id", "left")
    raw = F.expr("try_cast(replace(trim(current_hammer_raw), ',', '.') AS double)")
    df = df.withColumn("current_hammer", F.when(raw > 0, raw))
    df = df.withColumn("current_all_in", all_in_cost(F.col("current_hammer")))
    for name in ("value", "fair", "collector"):
        df = df.withColumn(f"{name}_hammer", hammer_from_all_in(F.col(f"{name}_max")))
    return df.withColumn("recommendation", F.when(F.col("current_hammer").isNotNull(), recommendation(F.col("current_all_in"))))


def sell_advice(snapshots: DataFrame, terms: DataFrame) -> DataFrame:
    """A row a consigned target: estimate, reserve, starting bid and net proceeds at three prices.

    terms: target_id, commission_pct, insurance_pct, fixed_fees."""
    low, high = F.coalesce("fair_low", F.col("fair_central") * 0.85), F.coalesce("fair_high", F.col("fair_central") * 1.15)
    half = (high - low) / 2 * _by_label(3)
    df = snapshots.join(terms, "target_id").withColumns(
        {
            "estimate_low": F.when(F.col("fair_central").isNotNull(), F.greatest(F.lit(0.0), (low + high) / 2 - half)),
            "estimate_central": F.col("fair_central"),
            "estimate_high": F.when(F.col("fair_central").isNotNull(), (low + high) / 2 + half),
        }
    )
    df = df.withColumn("reserve", F.col("estimate_low") * _by_label(4)).withColumn("starting_bid", F.col("reserve") * 0.6)
    return df.withColumns({f"net_{n}": net_proceeds(F.col(f"estimate_{n}")) for n in ("low", "central", "high")})


def net_proceeds(hammer: Column) -> Column:
    return hammer - hammer * (F.col("commission_pct") + F.col("insurance_pct")) / 100.0 - F.col("fixed_fees")
