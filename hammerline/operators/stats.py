"""Robust statistics of weighted samples, per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HALF_LIFE_DAYS = 730
OUTLIER_Z, OUTLIER_WEIGHT, OUTLIER_LEAST = 3.5, 0.35, 5


def recency_weight(age: Column, half_life: int = HALF_LIFE_DAYS) -> Column:
    """0.5 ** (age / half life); an unknown age counts 0.05, a negative one as 0; no half-life: 1."""
    if half_life <= 0:
        return F.lit(1.0)
    return F.when(age.isNull(), 0.05).otherwise(F.pow(F.lit(0.5), F.greatest(age, F.lit(0)) / float(half_life)))


def weighted_quantiles(rows: DataFrame, keys: list[str], value: str, weight: str, seq: str, points: dict[str, float]) -> DataFrame:
    """keys and one column a point: values in order of (value, seq), each at the middle of its weight as a
    share of the total, linear between neighbours, the end values beyond. Without positive total weight
    all rows weigh the same. Null values are left out; a group without values has no row.

    One shuffle and sort by the keys serves all points; the interpolation is found by a row's successor.
    """
    rows = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"), F.col(weight).cast("double").alias("w"), F.col(seq).alias("s"))
    group = Window.partitionBy(*keys)
    order = group.orderBy("v", "s")
    rows = rows.withColumn("w", F.when(F.sum("w").over(group) > 0, F.col("w")).otherwise(1.0))
    upto = F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("at", (upto - F.col("w") / 2) / F.sum("w").over(group))
    rows = rows.withColumn("next_v", F.lead("v").over(order)).withColumn("next_at", F.lead("at").over(order))
    found = []
    for name, p in points.items():
        inside = (F.col("at") <= p) & (F.col("next_at") > p)
        share = (F.lit(p) - F.col("at")) / (F.col("next_at") - F.col("at"))
        found += [
            F.max(F.when(inside, F.col("v") + share * (F.col("next_v") - F.col("v")))).alias(f"{name}_in"),
            F.count_if(F.col("at") <= p).alias(f"{name}_below"),
        ]
    sums = rows.groupBy(*keys).agg(*found, F.min("v").alias("low"), F.max("v").alias("high"))
    return sums.select(*keys, *[F.when(F.col(f"{n}_below") == 0, F.col("low")).otherwise(F.coalesce(f"{n}_in", "high")).alias(n) for n in points])


#: Groups of more rows than this are cut into buckets.
LARGE = 1 << 18


def bucketed_quantiles(rows: DataFrame, keys: list[str], value: str, weight: str, seq: str, points: dict[str, float], buckets: int = 64, large: int = LARGE) -> DataFrame:
    """weighted_quantiles, also for groups that one task can't hold: the same values, no window over a group of more
    than `large` rows. Such groups are few (at most rows / large), so their keys are broadcast."""
    rows = rows.filter(F.col(value).isNotNull()).select(*keys, value, weight, seq)
    hot = F.broadcast(rows.groupBy(*keys).count().filter(F.col("count") > large).select(*keys))
    whole = weighted_quantiles(rows.join(hot, keys, "left_anti"), keys, value, weight, seq, points)
    return whole.unionByName(_cut_quantiles(rows.join(hot, keys, "left_semi"), keys, value, weight, seq, points, buckets))


def _cut_quantiles(rows: DataFrame, keys: list[str], value: str, weight: str, seq: str, points: dict[str, float], buckets: int) -> DataFrame:
    """bucketed_quantiles of large groups.

    Rows of one value become one, before they move. Approximate percentiles, which merge, cut a group into
    range buckets; their weights are summed, and only the buckets around a point are put in order. What lies
    before and behind a bucket is known from its neighbours' sums and ends, so the result is exact however
    uneven the buckets are.
    """
    rows = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"), F.col(weight).cast("double").alias("w"), F.col(seq).alias("s"))
    runs = rows.groupBy(*keys, "v").agg(F.sum("w").alias("w"), F.count("*").alias("n"), F.min_by("w", "s").alias("first"), F.max_by("w", "s").alias("last"))
    cuts = F.array(*[F.lit((k + 1) / buckets) for k in range(buckets - 1)])
    totals = runs.groupBy(*keys).agg(F.sum("w").alias("total"), F.sum("n").alias("rows"), F.percentile_approx("v", cuts, 100 * buckets).alias("cuts"))
    same = F.col("total").isNull() | (F.col("total") <= 0)
    runs = runs.join(totals, keys).select(
        *keys, "v", F.when(same, F.col("n").cast("double")).otherwise(F.col("w")).alias("w"), F.when(same, 1.0).otherwise(F.col("first")).alias("first"),
        F.when(same, 1.0).otherwise(F.col("last")).alias("last"), F.when(same, F.col("rows").cast("double")).otherwise(F.col("total")).alias("total"),
        F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("bucket"),
    )
    ends = runs.groupBy(*keys, "bucket").agg(
        F.sum("w").alias("w"), F.max("total").alias("total"), F.min("v").alias("low"), F.min_by("first", "v").alias("first"), F.max("v").alias("high"), F.max_by("last", "v").alias("last")
    )
    order = Window.partitionBy(*keys).orderBy("bucket")  # as many rows a group as buckets
    # A bucket begins where the one before ends, to the last bit: no point may lie between two.
    ends = ends.withColumn("upto", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("base", F.coalesce(F.lag("upto").over(order), F.lit(0.0)))
    before, behind = (lambda c: F.lag(c).over(order)), (lambda c: F.lead(c).over(order))
    ends = ends.withColumns(
        {
            "prior": F.struct(before("high").alias("v"), (F.col("base") - before("last") / 2).alias("at")),
            "later": F.struct(behind("low").alias("v"), (F.col("upto") + behind("first") / 2).alias("at")),
        }
    )
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).cast("double").alias("p")) for n, p in points.items()]))
    asked = ends.withColumn("point", wanted).withColumn("mass", F.col("point.p") * F.col("total"))
    is_last = F.col("later.v").isNull()
    asked = asked.filter((F.col("base") <= F.col("mass")) & ((F.col("mass") < F.col("upto")) | is_last)).select(*keys, "bucket", F.col("point.name").alias("name"), "mass", "base", "prior", "later")
    near = runs.join(asked.select(*keys, "bucket", "base").distinct(), [*keys, "bucket"])
    upto = F.col("base") + F.sum("w").over(Window.partitionBy(*keys, "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("upto", upto).select(*keys, "bucket", "v", (F.col("upto") - F.col("w") + F.col("first") / 2).alias("lo"), (F.col("upto") - F.col("last") / 2).alias("hi"))
    met = near.join(asked, [*keys, "bucket"])
    lower = F.max(F.when(F.col("hi") <= F.col("mass"), F.struct(F.col("hi").alias("at"), "v")))
    upper = F.min(F.when(F.col("lo") > F.col("mass"), F.struct(F.col("lo").alias("at"), "v")))
    found = met.groupBy(*keys, "name").agg(
        lower.alias("a"), upper.alias("b"), F.max(F.when((F.col("lo") <= F.col("mass")) & (F.col("mass") <= F.col("hi")), F.col("v"))).alias("on"), F.max("mass").alias("mass"), F.max("prior").alias("prior"), F.max("later").alias("later")
    )
    a_v, a_at = F.coalesce("a.v", "prior.v"), F.coalesce("a.at", "prior.at")
    b_v, b_at = F.coalesce("b.v", "later.v"), F.coalesce("b.at", "later.at")
    between = a_v + (F.col("mass") - a_at) / (b_at - a_at) * (b_v - a_v)
    found = found.select(*keys, "name", F.coalesce("on", F.when(a_v.isNull(), b_v).when(b_v.isNull(), a_v).otherwise(between)).alias("q"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("q"))).alias(n) for n in points])


def bucketed_robust_z(rows: DataFrame, keys: list[str], value: str, seq: str) -> DataFrame:
    """robust_z, for groups that one task can't hold: medians from range buckets, joined to the rows."""
    marked = rows.withColumn("one_", F.lit(1.0))
    med = bucketed_quantiles(marked, keys, value, "one_", seq, {"med": 0.5}).join(rows.groupBy(*keys).agg(F.count(value).alias("sample_n")), keys)
    rows = rows.join(med, keys)
    away = rows.withColumns({"one_": F.lit(1.0), "away_": F.abs(F.col(value) - F.col("med"))})
    rows = rows.join(bucketed_quantiles(away, keys, "away_", "one_", seq, {"mad": 0.5}), keys, "left")
    return rows.withColumn("z", F.when(F.col("mad") == 0, 0.0).otherwise(0.6745 * (F.col(value) - F.col("med")) / F.col("mad")))


def robust_z(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows with sample_n, med, mad and z = 0.6745 * (value - med) / mad, 0 where mad is 0."""
    group = Window.partitionBy(*keys)  # one shuffle, which the quantiles by the same keys share
    rows = rows.withColumn("med", F.median(value).over(group)).withColumn("sample_n", F.count(value).over(group))
    rows = rows.withColumn("mad", F.median(F.abs(F.col(value) - F.col("med"))).over(group))
    return rows.withColumn("z", F.when(F.col("mad") == 0, 0.0).otherwise(0.6745 * (F.col(value) - F.col("med")) / F.col("mad")))


def flag_outliers(rows: DataFrame, keys: list[str], value: str, seq: str | None = None) -> DataFrame:
    """rows with outlier_flag OUTLIER_HIGH, OUTLIER_LOW or null; none in samples below five. With seq, a column
    that orders rows of one value, no task holds a whole group (see bucketed_robust_z)."""
    flag = F.when((F.col("sample_n") >= OUTLIER_LEAST) & (F.col("z") > OUTLIER_Z), "OUTLIER_HIGH")
    flag = flag.when((F.col("sample_n") >= OUTLIER_LEAST) & (F.col("z") < -OUTLIER_Z), "OUTLIER_LOW")
    scored = robust_z(rows, keys, value) if seq is None else bucketed_robust_z(rows, keys, value, seq)
    return scored.withColumn("outlier_flag", flag)


def dispersion_label(ratio: Column) -> Column:
    return F.when(ratio.isNull(), "UNKNOWN").when(ratio < 0.10, "TIGHT").when(ratio < 0.20, "MODERATE").when(ratio < 0.35, "WIDE").otherwise("VERY_WIDE")


def dispersion(rows: DataFrame, keys: list[str], value: str, seq: str) -> DataFrame:
    """keys, dispersion: the interquartile range over the median; null for one value or a median of 0."""
    rows = rows.withColumn("one", F.lit(1.0))
    q = weighted_quantiles(rows, keys, value, "one", seq, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    n = rows.groupBy(*keys).agg(F.count(value).alias("n"))
    ratio = F.when((F.col("n") >= 2) & (F.col("q2") != 0), (F.col("q3") - F.col("q1")) / F.col("q2"))
    return q.join(n, keys).select(*keys, ratio.alias("dispersion"))
