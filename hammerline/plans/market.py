"""Queries over realized lots, asks and bids, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hammerline.operators import advice, backtest, matching, stats, valuation
from hammerline.sources import derived as d

AS_OF = d.AS_OF


def r4(df: DataFrame) -> DataFrame:
    """Doubles at four decimals, as the twins give them; the small addend settles what lies on a half."""
    return df.select(*[F.round(F.col(c) + 1e-7, 4).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _sales(spark: SparkSession, sf: str) -> DataFrame:
    return valuation.eligible_sales(d.comparables(spark, sf), AS_OF)


def _priced(spark: SparkSession, sf: str) -> DataFrame:
    return d.comparables(spark, sf).withColumn("price", valuation.effective_price())


def targets(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return d.table(spark, sf, "part").select(k.alias("target_id"), (0.6 + k % 5 / 10.0).alias("identity_quality"))


def terms(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return d.table(spark, sf, "part").select(
        k.alias("target_id"), (k % 4 * 5.0).alias("commission_pct"), (k % 3 * 0.5).alias("insurance_pct"), (k % 6 * 2.0).alias("fixed_fees")
    )


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return valuation.snapshot(d.comparables(spark, sf), d.dealer_prices(spark, sf), targets(spark, sf), AS_OF)


# --- the same in SQL -------------------------------------------------------------------------------

_PRICE = "CASE price_semantics WHEN 'HAMMER' THEN hammer_price WHEN 'REALIZED_INCL_PREMIUM' THEN realized_price END"
PRICED = f"priced AS (SELECT *, {_PRICE} AS price FROM comparables)"
_AGE = f"greatest(date_diff('day', auction_date, DATE '{AS_OF}'), 0)"
ELIGIBLE = f"""eligible AS (
  SELECT *, CASE WHEN identity_match_score >= 90 THEN 'EXACT' WHEN identity_match_score >= 75 THEN 'STRONG' ELSE 'SUPPORTING' END AS tier,
    identity_match_score / 100.0 * pow(0.5, {_AGE} / 730.0) * CASE WHEN source = 'csv' THEN 0.8 WHEN source_url IS NOT NULL THEN 0.85 ELSE 0.65 END * coalesce(grade_weight, 1) AS weight
  FROM priced WHERE NOT withdrawn AND NOT unsold AND price IS NOT NULL)"""


def flags(name: str, source: str, value: str = "price", key: str = "target_id") -> str:
    return f"""{name}_m AS (SELECT {key}, median({value}) AS med, count({value}) AS sample_n FROM {source} GROUP BY {key}),
{name}_d AS (SELECT s.{key}, median(abs({value} - med)) AS mad FROM {source} s JOIN {name}_m USING ({key}) GROUP BY s.{key}),
{name} AS (SELECT s.*, med, sample_n, mad, CASE WHEN mad = 0 THEN 0 ELSE 0.6745 * ({value} - med) / mad END AS z,
  CASE WHEN sample_n >= 5 AND mad <> 0 AND 0.6745 * ({value} - med) / mad > 3.5 THEN 'OUTLIER_HIGH'
    WHEN sample_n >= 5 AND mad <> 0 AND 0.6745 * ({value} - med) / mad < -3.5 THEN 'OUTLIER_LOW' END AS outlier_flag
  FROM {source} s JOIN {name}_m USING ({key}) JOIN {name}_d USING ({key}))"""


def quantiles(name: str, source: str, value: str, weight: str, points: dict[str, float], key: str = "target_id") -> str:
    """Each point from the last row at or below it and the first above it."""
    chosen = ",\n  ".join(
        f"""CASE WHEN max(pos) <= {p} THEN max(v) WHEN min(pos) > {p} THEN min(v) ELSE
    arg_max(v, (pos, rn)) FILTER (pos <= {p}) + ({p} - max(pos) FILTER (pos <= {p})) / (min(pos) FILTER (pos > {p}) - max(pos) FILTER (pos <= {p}))
    * (arg_min(v, (pos, rn)) FILTER (pos > {p}) - arg_max(v, (pos, rn)) FILTER (pos <= {p})) END AS {n}"""
        for n, p in points.items()
    )
    return f"""{name}_r AS (SELECT {key}, {value} AS v, row_number() OVER k AS rn,
    (sum({weight}) OVER (PARTITION BY {key} ORDER BY {value}, seq ROWS UNBOUNDED PRECEDING) - {weight} / 2) / sum({weight}) OVER (PARTITION BY {key}) AS pos
  FROM {source} WINDOW k AS (PARTITION BY {key} ORDER BY {value}, seq)),
{name} AS (SELECT {key}, {chosen} FROM {name}_r GROUP BY {key})"""


SALES = f"{d.COMPARABLES_SQL}, {PRICED}, {ELIGIBLE}, {flags('flagged', 'eligible')},\nsales AS (SELECT *, weight * CASE WHEN outlier_flag IS NULL THEN 1 ELSE 0.35 END AS adj_weight FROM flagged)"
_DISPERSION = quantiles("spread", "sales", "price", "1.0::DOUBLE", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
_LABEL = "CASE WHEN dispersion IS NULL THEN 'UNKNOWN' WHEN dispersion < 0.1 THEN 'TIGHT' WHEN dispersion < 0.2 THEN 'MODERATE' WHEN dispersion < 0.35 THEN 'WIDE' ELSE 'VERY_WIDE' END"
SUMMARY = f"""{SALES}, {quantiles('q', 'sales', 'price', 'adj_weight', {'weighted_median': 0.5, 'p25': 0.25, 'p75': 0.75, 'p10_': 0.1, 'p90_': 0.9})}, {_DISPERSION},
counts AS (SELECT target_id, count(*) AS n, count(*) FILTER (tier = 'EXACT') AS exact_count, count(*) FILTER (tier = 'STRONG') AS strong_count,
    count(*) FILTER (tier = 'SUPPORTING') AS supporting_count, count(outlier_flag) AS outliers,
    count(DISTINCT lower(trim(auction_house))) AS houses, max(auction_date) AS latest_sale FROM sales GROUP BY target_id),
summary0 AS (SELECT counts.*, weighted_median, p25, p75, CASE WHEN n >= 5 THEN p10_ END AS p10, CASE WHEN n >= 5 THEN p90_ END AS p90,
    CASE WHEN n >= 2 AND q2 <> 0 THEN (q3 - q1) / q2 END AS dispersion,
    CASE WHEN n = 1 THEN 'single sale' WHEN n = 2 THEN 'two values' WHEN n <= 4 THEN 'low' WHEN n <= 9 THEN 'medium' ELSE 'high' END AS sample_note
  FROM counts JOIN q USING (target_id) JOIN spread USING (target_id)),
summary AS (SELECT *, {_LABEL} AS dispersion_label FROM summary0)"""
DEALERS = f"""{d.DEALER_PRICES_SQL}, asks AS (SELECT * FROM dealer_prices WHERE price > 0), {flags('asks_f', 'asks')},
asks_w AS (SELECT *, CASE WHEN outlier_flag IS NULL THEN 1.0::DOUBLE ELSE 0.35 END AS w, row_number() OVER (PARTITION BY target_id ORDER BY price, seq) AS r FROM asks_f),
{quantiles('dq', 'asks_w', 'price', 'w', {'dealer_median': 0.5})},
dealers AS (SELECT target_id, count(*) AS dealer_count, max(price) FILTER (r = 1) AS lowest_offer, max(price) FILTER (r = 2) AS second_lowest,
    any_value(dealer_median) AS dealer_median FROM asks_w JOIN dq USING (target_id) GROUP BY target_id)"""
DEMAND = f"""activity AS (SELECT target_id, count(*) FILTER (date_diff('day', auction_date, DATE '{AS_OF}') BETWEEN 0 AND 365) AS last_12m,
    count(*) FILTER (date_diff('day', auction_date, DATE '{AS_OF}') BETWEEN 0 AND 730) AS last_24m FROM comparables GROUP BY target_id)"""
TREND = """halves AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY auction_date, seq) AS r, count(*) OVER (PARTITION BY target_id) AS n FROM eligible),
trend0 AS (SELECT target_id, any_value(n) AS n, date_diff('day', min(auction_date), max(auction_date)) AS span_days,
    median(price) FILTER (r <= n // 2) AS older, median(price) FILTER (r > n // 2) AS newer FROM halves GROUP BY target_id),
trends AS (SELECT *, CASE WHEN n >= 6 AND span_days >= 180 AND older <> 0 THEN (newer - older) / older / greatest(span_days / 365.0, 0.25) END AS annual_change FROM trend0)"""
_TREND_LABEL = "CASE WHEN annual_change IS NULL THEN 'INSUFFICIENT_DATA' WHEN annual_change > 0.05 THEN 'RISING' WHEN annual_change < -0.05 THEN 'FALLING' ELSE 'STABLE' END"
SNAPSHOT = f"""{SUMMARY}, {DEALERS}, {DEMAND}, {TREND},
base AS (SELECT p_partkey AS target_id, 0.6 + p_partkey % 5 / 10.0::DOUBLE AS identity_quality, * EXCLUDE (p_partkey, target_id),
    CASE WHEN coalesce(s_n, 0) = 0 THEN 0 WHEN exact_count + strong_count >= 10 THEN 0.9 WHEN exact_count + strong_count >= 5 THEN 0.8
      WHEN exact_count + strong_count >= 3 THEN 0.7 WHEN exact_count + strong_count >= 1 THEN 0.5 ELSE 0.3 END::DOUBLE AS realized_weight,
    CASE WHEN weighted_median <> 0 THEN (dealer_median - weighted_median) / weighted_median END AS disagreement_pct
  FROM (SELECT p_partkey FROM part) p LEFT JOIN (SELECT *, n AS s_n FROM summary) s ON s.target_id = p_partkey
    LEFT JOIN (SELECT * RENAME (target_id AS t1) FROM dealers) ON t1 = p_partkey LEFT JOIN (SELECT * RENAME (target_id AS t2) FROM activity) ON t2 = p_partkey
    LEFT JOIN (SELECT target_id AS t3, annual_change, {_TREND_LABEL} AS trend_label FROM trends) ON t3 = p_partkey),
valued AS (SELECT *, CASE WHEN disagreement_pct IS NULL THEN 'UNKNOWN' WHEN abs(disagreement_pct) < 0.1 THEN 'ALIGNED' WHEN abs(disagreement_pct) < 0.2 THEN 'MODERATE' ELSE 'SIGNIFICANT' END AS disagreement,
    CASE WHEN weighted_median IS NULL THEN dealer_median * 0.85 WHEN dealer_median IS NULL THEN p25 ELSE realized_weight * p25 + (1 - realized_weight) * least(dealer_median, p25) END AS fair_low,
    CASE WHEN weighted_median IS NULL THEN dealer_median WHEN dealer_median IS NULL THEN weighted_median ELSE realized_weight * weighted_median + (1 - realized_weight) * dealer_median END AS fair_central,
    CASE WHEN weighted_median IS NULL THEN dealer_median * 1.15 WHEN dealer_median IS NULL THEN p75 ELSE realized_weight * p75 + (1 - realized_weight) * greatest(dealer_median, p75) END AS fair_high,
    date_diff('day', latest_sale, DATE '{AS_OF}') AS sale_age, coalesce(s_n, 0) AS k, coalesce(exact_count + strong_count, 0) AS good, coalesce(houses, 0) AS h FROM base),
c0 AS (SELECT *, CAST(least(100, greatest(0, round_even(20 * identity_quality, 0) + CASE WHEN k >= 10 THEN 15 WHEN k >= 5 THEN 12 WHEN k >= 3 THEN 8 WHEN k >= 1 THEN 4 ELSE 0 END
    + CASE WHEN k > 0 THEN round_even(15.0 * good / k, 0) ELSE 0 END + CASE WHEN sale_age <= 365 THEN 10 WHEN sale_age <= 730 THEN 6 WHEN sale_age IS NOT NULL THEN 2 ELSE 0 END + 8
    + CASE WHEN h >= 3 THEN 10 WHEN h = 2 THEN 6 WHEN h = 1 THEN 3 ELSE 0 END + CASE WHEN dispersion < 0.1 THEN 10 WHEN dispersion < 0.2 THEN 7 WHEN dispersion < 0.35 THEN 4 ELSE 0 END + 5)) AS INTEGER) AS s0 FROM valued),
c1 AS (SELECT *, CASE WHEN k <= 2 THEN least(s0, 39) ELSE s0 END AS s1, CASE WHEN k <= 2 THEN 'LOW' WHEN s0 >= 85 THEN 'HIGH' WHEN s0 >= 65 THEN 'MEDIUM' WHEN s0 >= 40 THEN 'LOW' ELSE 'VERY LOW' END AS l1 FROM c0),
c2 AS (SELECT *, CASE WHEN h <= 1 AND k > 0 THEN least(s1, 64) ELSE s1 END AS s2, CASE WHEN h <= 1 AND k > 0 AND s1 > 64 THEN 'MEDIUM' ELSE l1 END AS l2 FROM c1),
c3 AS (SELECT *, CASE WHEN dispersion >= 0.35 THEN least(s2, 64) ELSE s2 END AS s3, CASE WHEN dispersion >= 0.35 AND s2 > 64 THEN 'MEDIUM' ELSE l2 END AS l3 FROM c2),
c4 AS (SELECT *, CASE WHEN identity_quality < 0.75 THEN least(s3, 39) ELSE s3 END AS s4, CASE WHEN identity_quality < 0.75 THEN 'LOW' ELSE l3 END AS l4 FROM c3),
c5 AS (SELECT *, CASE WHEN disagreement = 'SIGNIFICANT' THEN least(s4, 64) ELSE s4 END AS confidence_score, CASE WHEN disagreement = 'SIGNIFICANT' AND s4 > 64 THEN 'MEDIUM' ELSE l4 END AS confidence_label,
    CAST(least(100, least(30, coalesce(last_12m, 0) * 6 + coalesce(last_24m, 0) * 2) + least(15, h * 5) + least(20, coalesce(last_24m, 0) * 2)
      + CASE WHEN sale_age <= 180 THEN 15 WHEN sale_age <= 365 THEN 9 WHEN sale_age IS NOT NULL THEN 3 ELSE 0 END
      + CASE WHEN dispersion < 0.1 THEN 20 WHEN dispersion < 0.2 THEN 12 WHEN dispersion IS NOT NULL THEN 5 ELSE 0 END) AS INTEGER) AS demand_score FROM c4),
snap AS (SELECT *, CASE WHEN demand_score >= 70 THEN 'HIGH' WHEN demand_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS demand_label FROM c5)"""
_BAND = "CASE confidence_label WHEN 'HIGH' THEN {0} WHEN 'MEDIUM' THEN {1} WHEN 'LOW' THEN {2} ELSE {3} END"
CEILINGS = f"""lab AS (SELECT *, {_BAND.format(0.10, 0.15, 0.22, 0.30)}::DOUBLE AS lo, {_BAND.format(0.15, 0.22, 0.30, 0.40)}::DOUBLE AS hi, {_BAND.format(1.08, 1.10, 1.15, 1.20)}::DOUBLE AS prem,
    {_BAND.format(1.0, 1.08, 1.18, 1.3)}::DOUBLE AS widen, {_BAND.format(0.95, 0.85, 0.75, 0.65)}::DOUBLE AS frac FROM snap),
ceil0 AS (SELECT *, CASE WHEN fair_central IS NOT NULL THEN round(least((lo + hi) / 2 + 0.03 * (CASE WHEN dispersion_label IN ('WIDE', 'VERY_WIDE') THEN 1 ELSE 0 END
    + CASE WHEN disagreement = 'SIGNIFICANT' THEN 1 ELSE 0 END + CASE WHEN h <= 1 THEN 1 ELSE 0 END), hi + 0.06), 4) END AS margin FROM lab),
ceilings AS (SELECT *, fair_low * (1 - margin) AS value_max, fair_central AS fair_max, fair_high * prem AS collector_max FROM ceil0)"""


def cols(names: str, *rounded: str) -> str:
    """A select list: names as they are, then names at four decimals."""
    return ", ".join([*names.split(), *(f"round({c}, 4) AS {c}" for c in rounded)])


QUERIES, ORACLES = {}, {}


def add(name, build, sql):
    QUERIES[name] = build
    if sql:
        ORACLES[name] = sql.replace(", 4)", " + 1e-7, 4)")


add(
    "realized_market_summary",
    lambda s, f: r4(valuation.realized_market_summary(d.comparables(s, f), AS_OF)),
    f"WITH {SUMMARY} SELECT {cols('target_id n exact_count strong_count supporting_count outliers houses latest_sale dispersion_label sample_note', 'weighted_median', 'p25', 'p75', 'p10', 'p90', 'dispersion')} FROM summary",
)
add("effective_price", lambda s, f: r4(_priced(s, f).select("target_id", "seq", "price_semantics", "price")), f"WITH {d.COMPARABLES_SQL}, {PRICED} SELECT target_id, seq, price_semantics, round(price, 4) AS price FROM priced")
add(
    "realized_eligible",
    lambda s, f: _priced(s, f).filter(valuation.realized_eligible()).groupBy("target_id", "price_semantics").agg(F.count("*").alias("n"), F.max("auction_date").alias("latest")),
    f"WITH {d.COMPARABLES_SQL}, {PRICED}, {ELIGIBLE} SELECT target_id, price_semantics, count(*) AS n, max(auction_date) AS latest FROM eligible GROUP BY ALL",
)
add(
    "recency_weight",
    lambda s, f: r4(d.comparables(s, f).select("target_id", "seq", valuation.age_days(AS_OF).alias("age"), *[stats.recency_weight(valuation.age_days(AS_OF), h).alias(f"w{h}") for h in (450, 730, 1460)])),
    f"WITH {d.COMPARABLES_SQL} SELECT target_id, seq, {_AGE} AS age, {', '.join(f'round(pow(0.5, {_AGE} / {h}.0), 4) AS w{h}' for h in (450, 730, 1460))} FROM comparables",
)
add(
    "final_weight",
    lambda s, f: r4(_sales(s, f).select("target_id", "seq", valuation.source_weight().alias("source_weight"), "weight", "adj_weight", "tier")),
    f"WITH {SALES} SELECT target_id, seq, tier, CASE WHEN source = 'csv' THEN 0.8 WHEN source_url IS NOT NULL THEN 0.85 ELSE 0.65 END::DOUBLE AS source_weight, round(weight, 4) AS weight, round(adj_weight, 4) AS adj_weight FROM sales",
)
_POINTS = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}
add(
    "weighted_quantile",
    lambda s, f: r4(stats.bucketed_quantiles(_sales(s, f), ["target_id"], "price", "weight", "seq", _POINTS)),
    f"WITH {SALES}, {quantiles('q', 'sales', 'price', 'weight', _POINTS)} SELECT {cols('target_id', *_POINTS)} FROM q",
)
add(
    "weighted_median",
    lambda s, f: r4(stats.bucketed_quantiles(d.dealer_prices(s, f).filter("price > 0"), ["target_id"], "price", "score", "seq", {"median": 0.5})),
    f"WITH {d.DEALER_PRICES_SQL}, a0 AS (SELECT *, CASE WHEN sum(score) OVER (PARTITION BY target_id) > 0 THEN score ELSE 1 END AS w FROM dealer_prices WHERE price > 0), {quantiles('q', 'a0', 'price', 'w', {'median': 0.5})} SELECT target_id, round(median, 4) AS median FROM q",
)
add(
    "cumulative_weight",
    lambda s, f: r4(_sales(s, f).selectExpr("target_id", "seq", "sum(weight) OVER (PARTITION BY target_id ORDER BY price, seq ROWS UNBOUNDED PRECEDING) AS running")),
    f"WITH {SALES} SELECT target_id, seq, round(sum(weight) OVER (PARTITION BY target_id ORDER BY price, seq ROWS UNBOUNDED PRECEDING), 4) AS running FROM sales",
)
_Z = "WITH {0} SELECT target_id, seq, sample_n, round(med, 4) AS med, round(mad, 4) AS mad, round(z, 4) AS z, outlier_flag FROM flagged"
add("robust_z", lambda s, f: r4(_sales(s, f).select("target_id", "seq", "sample_n", "med", "mad", "z", "outlier_flag")), _Z.format(SALES))
# DuckDB keeps the sign of a rounded zero, Spark does not.
ORACLES["robust_z"] = ORACLES["robust_z"].replace("round(z + 1e-7, 4) AS z", "round(z + 1e-7, 4) + 0.0 AS z")
add(
    "mad",
    lambda s, f: r4(stats.bucketed_robust_z(d.dealer_prices(s, f).filter("price > 0"), ["target_id"], "price", "seq").groupBy("target_id").agg(F.max("med").alias("med"), F.max("mad").alias("mad"))),
    f"WITH {d.DEALER_PRICES_SQL}, a AS (SELECT * FROM dealer_prices WHERE price > 0), {flags('fl', 'a')} SELECT target_id, round(max(med), 4) AS med, round(max(mad), 4) AS mad FROM fl GROUP BY target_id",
)
add(
    "flag_outliers",
    lambda s, f: stats.flag_outliers(d.dealer_prices(s, f).filter("price > 0"), ["target_id"], "price", "seq").groupBy("target_id").agg(F.count("*").alias("n"), F.count_if(F.col("outlier_flag") == "OUTLIER_HIGH").alias("high"), F.count_if(F.col("outlier_flag") == "OUTLIER_LOW").alias("low")),
    f"WITH {d.DEALER_PRICES_SQL}, a AS (SELECT * FROM dealer_prices WHERE price > 0), {flags('fl', 'a')} SELECT target_id, count(*) AS n, count(*) FILTER (outlier_flag = 'OUTLIER_HIGH') AS high, count(*) FILTER (outlier_flag = 'OUTLIER_LOW') AS low FROM fl GROUP BY target_id",
)
add(
    "dispersion_ratio",
    lambda s, f: r4(stats.dispersion(_sales(s, f), ["target_id"], "price", "seq").withColumn("label", stats.dispersion_label(F.col("dispersion")))),
    f"WITH {SUMMARY} SELECT target_id, round(dispersion, 4) AS dispersion, dispersion_label AS label FROM summary",
)
add(
    "dealer_market_summary",
    lambda s, f: r4(valuation.dealer_market_summary(d.dealer_prices(s, f))),
    f"WITH {DEALERS} SELECT {cols('target_id dealer_count', 'lowest_offer', 'second_lowest', 'dealer_median')} FROM dealers",
)
add(
    "demand_score",
    lambda s, f: snapshots(s, f).select("target_id", "last_12m", "last_24m", "demand_score", "demand_label"),
    f"WITH {SNAPSHOT} SELECT target_id, last_12m, last_24m, demand_score, demand_label FROM snap",
)
add(
    "sliding_activity",
    lambda s, f: valuation.demand_counts(d.comparables(s, f), AS_OF),
    f"WITH {d.COMPARABLES_SQL}, {DEMAND} SELECT * FROM activity",
)
add(
    "trend",
    lambda s, f: r4(valuation.trend(d.comparables(s, f))),
    f"WITH {d.COMPARABLES_SQL}, {PRICED}, {ELIGIBLE}, {TREND} SELECT {cols('target_id n span_days', 'older', 'newer', 'annual_change')}, {_TREND_LABEL} AS trend_label FROM trends",
)
add(
    "disagreement",
    lambda s, f: r4(snapshots(s, f).select("target_id", "disagreement", "disagreement_pct")),
    f"WITH {SNAPSHOT} SELECT {cols('target_id disagreement', 'disagreement_pct')} FROM snap",
)
add("fusion_weights", lambda s, f: r4(snapshots(s, f).select("target_id", "realized_weight", (1 - F.col("realized_weight")).alias("dealer_weight"))), f"WITH {SNAPSHOT} SELECT target_id, round(realized_weight, 4) AS realized_weight, round(1 - realized_weight, 4) AS dealer_weight FROM snap")
add("fair_value_range", lambda s, f: r4(snapshots(s, f).select("target_id", "fair_low", "fair_central", "fair_high")), f"WITH {SNAPSHOT} SELECT {cols('target_id', 'fair_low', 'fair_central', 'fair_high')} FROM snap")
add("confidence_score", lambda s, f: snapshots(s, f).select("target_id", "confidence_score", "confidence_label"), f"WITH {SNAPSHOT} SELECT target_id, confidence_score, confidence_label FROM snap")
_SNAP = "target_id n houses latest_sale dispersion_label disagreement confidence_score confidence_label demand_score demand_label trend_label dealer_count".split()
_SNAP_R = "identity_quality weighted_median p25 p75 dispersion dealer_median realized_weight fair_low fair_central fair_high annual_change".split()
add("valuation_snapshot", lambda s, f: r4(snapshots(s, f).select(*_SNAP, *_SNAP_R)), f"WITH {SNAPSHOT} SELECT {cols('target_id houses latest_sale dispersion_label disagreement confidence_score confidence_label demand_score demand_label trend_label dealer_count', *_SNAP_R)}, s_n AS n FROM snap")
add("margin_of_safety", lambda s, f: r4(advice.ceilings(snapshots(s, f)).select("target_id", "margin")), f"WITH {SNAPSHOT}, {CEILINGS} SELECT target_id, round(margin, 4) AS margin FROM ceilings")
add("bid_ceilings", lambda s, f: r4(advice.ceilings(snapshots(s, f)).select("target_id", "value_max", "fair_max", "collector_max")), f"WITH {SNAPSHOT}, {CEILINGS} SELECT {cols('target_id', 'value_max', 'fair_max', 'collector_max')} FROM ceilings")
_HAMMER = "CASE WHEN {0}_max - shipping - fixed_fees - taxes <= 0 THEN 0 ELSE ({0}_max - shipping - fixed_fees - taxes) / (1 + buyer_premium_pct / 100) END"
ADVICE = f"""{SNAPSHOT}, {CEILINGS}, {d.BIDS_SQL},
bid0 AS (SELECT b.*, value_max, fair_max, collector_max, CASE WHEN try_cast(replace(trim(current_hammer_raw), ',', '.') AS DOUBLE) > 0
    THEN try_cast(replace(trim(current_hammer_raw), ',', '.') AS DOUBLE) END AS current_hammer FROM bids b LEFT JOIN ceilings USING (target_id)),
bid1 AS (SELECT *, current_hammer * (1 + buyer_premium_pct / 100) + shipping + fixed_fees + taxes AS current_all_in FROM bid0),
advice AS (SELECT *, {', '.join(f'CASE WHEN {n}_max IS NOT NULL THEN {_HAMMER.format(n)} END AS {n}_hammer' for n in ('value', 'fair', 'collector'))},
    CASE WHEN current_hammer IS NOT NULL THEN CASE WHEN value_max IS NULL OR fair_max IS NULL OR collector_max IS NULL THEN 'UNKNOWN' WHEN current_all_in <= value_max * 0.9 THEN 'STRONG BUY'
      WHEN current_all_in <= value_max THEN 'BUY' WHEN current_all_in <= fair_max THEN 'FAIR' WHEN current_all_in <= collector_max THEN 'CAUTION'
      WHEN current_all_in <= collector_max * 1.15 THEN 'STOP' ELSE 'OVERPAY' END END AS recommendation FROM bid1)"""
_advised = lambda s, f: advice.bid_advice(d.bids(s, f), snapshots(s, f))
add("bid_advice", lambda s, f: r4(_advised(s, f).select("bid_id", "target_id", "recommendation", "current_hammer", "current_all_in", "value_hammer", "fair_hammer", "collector_hammer")),
    f"WITH {ADVICE} SELECT {cols('bid_id target_id recommendation', 'current_hammer', 'current_all_in', 'value_hammer', 'fair_hammer', 'collector_hammer')} FROM advice")
add("bid_recommendation", lambda s, f: _advised(s, f).groupBy("recommendation").agg(F.count("*").alias("n")), f"WITH {ADVICE} SELECT recommendation, count(*) AS n FROM advice GROUP BY ALL")
add("hammer_from_all_in", lambda s, f: r4(_advised(s, f).select("bid_id", "value_max", "value_hammer", "collector_max", "collector_hammer")), f"WITH {ADVICE} SELECT {cols('bid_id', 'value_max', 'value_hammer', 'collector_max', 'collector_hammer')} FROM advice")
add("all_in_cost", lambda s, f: r4(_advised(s, f).filter("current_all_in IS NOT NULL").select("bid_id", "current_hammer", "current_all_in")), f"WITH {ADVICE} SELECT {cols('bid_id', 'current_hammer', 'current_all_in')} FROM advice WHERE current_all_in IS NOT NULL")
SELL = f"""{SNAPSHOT}, {CEILINGS},
sell0 AS (SELECT *, target_id % 4 * 5.0 AS commission_pct, target_id % 3 * 0.5 AS insurance_pct, target_id % 6 * 2.0 AS fixed_fees,
    (fair_low + fair_high) / 2 AS mid, (fair_high - fair_low) / 2 * widen AS half FROM ceilings),
sell AS (SELECT *, CASE WHEN fair_central IS NOT NULL THEN greatest(0, mid - half) END AS estimate_low, fair_central AS estimate_central, CASE WHEN fair_central IS NOT NULL THEN mid + half END AS estimate_high FROM sell0),
sold AS (SELECT *, estimate_low * frac AS reserve, estimate_low * frac * 0.6 AS starting_bid,
    {', '.join(f'estimate_{n} - estimate_{n} * (commission_pct + insurance_pct) / 100 - fixed_fees AS net_{n}' for n in ('low', 'central', 'high'))} FROM sell)"""
_selling = lambda s, f: advice.sell_advice(snapshots(s, f), terms(s, f))
for _name, _columns in {
    "estimate_range": ("estimate_low", "estimate_central", "estimate_high"),
    "reserve_price": ("estimate_low", "reserve"),
    "starting_bid": ("reserve", "starting_bid"),
    "net_proceeds": ("net_low", "net_central", "net_high"),
    "sell_advice": ("estimate_low", "estimate_central", "estimate_high", "reserve", "starting_bid", "net_low", "net_central", "net_high"),
}.items():
    add(_name, lambda s, f, c=_columns: r4(_selling(s, f).select("target_id", *c)), f"WITH {SELL} SELECT {cols('target_id', *_columns)} FROM sold")


# --- grades and matching -----------------------------------------------------------------------------

def _matched(spark: SparkSession, sf: str) -> DataFrame:
    return matching.match(d.lots(spark, sf), d.identities(spark, sf))


MATCHED = f"""{d.RANKS_SQL}, {d.IDENTITIES_SQL}, {d.LOTS_SQL},
pairs AS (SELECT l.*, t.*, CASE WHEN tb IS NOT NULL THEN coalesce(abs(tn - gn), abs(x.i - y.i)) END AS grade_distance, {d.GRADE_SQL} AS grade_weight,
    coalesce(tb IS NOT NULL AND (tn = gn OR tb = gb), false) AS exact, coalesce(abs(tn - gn) <= 2, false) OR coalesce(abs(x.i - y.i) <= 1, false) AS near
  FROM lots l JOIN identities t ON (t_country IS NULL OR t_country = country) AND (t_year IS NULL OR t_year = coin_year) AND (t_value IS NULL OR t_value = value)
  LEFT JOIN ranks x ON x.b = tb LEFT JOIN ranks y ON y.b = gb WHERE t_country IS NOT NULL OR t_year IS NOT NULL OR t_value IS NOT NULL),
points AS (SELECT *, CASE WHEN t_variant IS NOT NULL AND NOT coalesce(contains(variant, t_variant), false) THEN 1 ELSE 0 END AS other_variant,
    CASE WHEN t_country IS NULL THEN 0 ELSE 15 END + CASE WHEN t_year IS NULL THEN 0 ELSE 15 END + CASE WHEN t_value IS NULL THEN 0 ELSE 15 END AS hard,
    CASE WHEN t_variant IS NULL THEN 0 ELSE 15 END + CASE WHEN t_km IS NULL THEN 0 ELSE 15 END + CASE WHEN t_mark IS NULL THEN 0 ELSE 5 END + CASE WHEN t_issuer IS NULL THEN 0 ELSE 5 END
      + CASE WHEN tb IS NULL THEN 0 ELSE 10 END + CASE WHEN t_company IS NULL THEN 0 ELSE 5 END AS soft,
    CASE WHEN contains(variant, t_variant) THEN 15 ELSE 0 END + CASE WHEN km = t_km THEN 15 ELSE 0 END + CASE WHEN mark = t_mark THEN 5 ELSE 0 END + CASE WHEN contains(issuer, t_issuer) THEN 5 ELSE 0 END
      + CASE WHEN tb IS NULL THEN 0 WHEN exact THEN 10 WHEN near THEN 6 ELSE 0 END + CASE WHEN company = t_company THEN 5 ELSE 0 END AS got FROM pairs),
judged AS (SELECT *, CASE WHEN negative <> '' THEN negative ELSE concat_ws(',', CASE WHEN other_variant = 1 THEN 'wrong variant' END, CASE WHEN tb <> 'DETAILS' AND gb = 'DETAILS' THEN 'details' END,
    CASE WHEN withdrawn THEN 'withdrawn' END, CASE WHEN unsold THEN 'unsold' END, CASE WHEN priceless THEN 'no price' END) END AS reasons, CAST(round_even(100.0 * (hard + got) / (hard + soft), 0) AS INTEGER) AS raw FROM points),
matched AS (SELECT *, CASE WHEN negative <> '' THEN 0 WHEN reasons <> '' THEN least(raw, 30) ELSE raw END AS match_score FROM judged)"""
_TIER = "CASE WHEN reasons <> '' OR match_score < 55 THEN 'REJECT' WHEN match_score >= 90 THEN 'EXACT' WHEN match_score >= 75 THEN 'STRONG' ELSE 'SUPPORTING' END AS tier"
add("classify_comparables", lambda s, f: _matched(s, f).select("target_id", "lot_id", "match_score", "tier", F.array_join("reject_reasons", ",").alias("reasons")), f"WITH {MATCHED} SELECT target_id, lot_id, match_score, {_TIER}, reasons FROM matched")
add("match_score", lambda s, f: _matched(s, f).groupBy("target_id", "tier", "match_score").agg(F.count("*").alias("n")), f"WITH {MATCHED} SELECT target_id, {_TIER}, match_score, count(*) AS n FROM matched GROUP BY ALL")
add("normalize_grade", lambda s, f: matching.grade(d.lots(s, f).drop("grading_company", "cert_number"), "grade_raw").groupBy("grade_raw", "grade_bucket", "numeric_grade", "grading_company", "cert_number", "is_details").agg(F.count("*").alias("n")),
    f"WITH {d.LOTS_SQL} SELECT grade_raw, gb AS grade_bucket, gn AS numeric_grade, CASE WHEN grade_raw = 'PCGS MS66' THEN 'PCGS' END AS grading_company, cert AS cert_number, gb = 'DETAILS' AS is_details, count(*) AS n FROM lots GROUP BY ALL")
add("grade_distance", lambda s, f: _matched(s, f).select("target_id", "lot_id", "grade_distance"), f"WITH {MATCHED} SELECT target_id, lot_id, grade_distance FROM matched")
add("grade_weight", lambda s, f: _matched(s, f).select("target_id", "lot_id", "grade_weight"), f"WITH {MATCHED} SELECT target_id, lot_id, grade_weight FROM matched")


# --- backtests, metal ----------------------------------------------------------------------------------

_QUARTILES = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
_CHAIN = SNAPSHOT[SNAPSHOT.index("valued AS") : SNAPSHOT.index(",\nsnap AS")].replace(f"DATE '{AS_OF}'", "as_of")
CASES = f"""{d.COMPARABLES_SQL}, {PRICED}, {ELIGIBLE}, {DEALERS},
sold AS (SELECT *, target_id || '-' || seq AS case_id FROM eligible WHERE auction_date IS NOT NULL),
past0 AS (SELECT c.case_id, e.seq, e.price, e.tier, e.auction_house, e.auction_date,
    e.weight * pow(0.5, (date_diff('day', e.auction_date, c.auction_date) - greatest(date_diff('day', e.auction_date, DATE '{AS_OF}'), 0)) / 730.0) AS weight
  FROM sold c JOIN sold e ON e.target_id = c.target_id AND e.auction_date < c.auction_date),
{flags('pf', 'past0', key='case_id')}, past AS (SELECT *, weight * CASE WHEN outlier_flag IS NULL THEN 1 ELSE 0.35 END AS adj_weight FROM pf),
{quantiles('pq', 'past', 'price', 'adj_weight', {'weighted_median': 0.5, 'p25': 0.25, 'p75': 0.75}, 'case_id')}, {quantiles('pd', 'past', 'price', '1.0::DOUBLE', _QUARTILES, 'case_id')},
pn AS (SELECT case_id, count(*) AS s_n, count(*) FILTER (tier = 'EXACT') AS exact_count, count(*) FILTER (tier = 'STRONG') AS strong_count,
    count(DISTINCT lower(trim(auction_house))) AS houses, max(auction_date) AS latest_sale FROM past GROUP BY case_id),
base AS (SELECT c.target_id, c.seq, c.price, c.auction_date AS as_of, 0.6 + c.target_id % 5 / 10.0::DOUBLE AS identity_quality, coalesce(s_n, 0) AS s_n, exact_count, strong_count, houses, latest_sale,
    weighted_median, p25, p75, CASE WHEN s_n >= 2 AND q2 <> 0 THEN (q3 - q1) / q2 END AS dispersion, dealer_median, NULL AS last_12m, NULL AS last_24m,
    CASE WHEN s_n IS NULL THEN 0 WHEN exact_count + strong_count >= 10 THEN 0.9 WHEN exact_count + strong_count >= 5 THEN 0.8
      WHEN exact_count + strong_count >= 3 THEN 0.7 WHEN exact_count + strong_count >= 1 THEN 0.5 ELSE 0.3 END::DOUBLE AS realized_weight,
    CASE WHEN weighted_median <> 0 THEN (dealer_median - weighted_median) / weighted_median END AS disagreement_pct
  FROM sold c LEFT JOIN pn USING (case_id) LEFT JOIN pq USING (case_id) LEFT JOIN pd USING (case_id) LEFT JOIN dealers dl ON dl.target_id = c.target_id),
{_CHAIN},
cases AS (SELECT target_id, seq, s_n AS past_n, price, fair_low AS predicted_low, fair_central AS predicted, fair_high AS predicted_high, abs(price - fair_central) / price AS pct_error,
    confidence_label AS label, CASE WHEN fair_central IS NOT NULL THEN price BETWEEN fair_low AND fair_high END AS within FROM c5)"""
_backtested = lambda s, f: backtest.run_backtest(d.comparables(s, f), d.dealer_prices(s, f), targets(s, f))
add("run_backtest", lambda s, f: r4(_backtested(s, f)), f"WITH {CASES} SELECT {cols('target_id seq past_n label within', 'price', 'predicted_low', 'predicted', 'predicted_high', 'pct_error')} FROM cases")
_REPORT = "count(*) AS cases, count(pct_error) AS scored, round(avg(within::INT), 4) AS hit_rate, round(avg(pct_error), 4) AS mean_error, round(-quantile_disc(-pct_error, 0.5), 4) AS median_error"
add("backtest_report", lambda s, f: r4(backtest.backtest_report(_backtested(s, f))), f"WITH {CASES} SELECT label, {_REPORT} FROM cases GROUP BY label UNION ALL SELECT NULL, {_REPORT} FROM cases")
add(
    "metal_value",
    lambda s, f: r4(d.specs(s, f).select("id", (F.col("weight_g") * F.col("fineness_per_mille") / 1000 * F.when(F.col("primary_metal") == "gold", 2000.0).when(F.col("primary_metal") == "silver", 25.0) / 1.08 / 31.1034768).alias("eur"))),
    f"WITH {d.SPECS_SQL} SELECT id, round(weight_g * fineness_per_mille / 1000 * CASE primary_metal WHEN 'gold' THEN 2000 WHEN 'silver' THEN 25 END / 1.08 / 31.1034768, 4) AS eur FROM specs",
)
