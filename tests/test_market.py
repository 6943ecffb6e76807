import datetime
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hammerline.operators import advice, backtest, joins, matching, stats, valuation


def sample(spark, prices, weights=None):
    rows = [("t", k, float(p), float(w)) for k, (p, w) in enumerate(zip(prices, weights or [1.0] * len(prices)))]
    return spark.createDataFrame(rows, "target_id string, seq long, price double, w double")


def quantile(spark, prices, weights, p):
    return stats.weighted_quantiles(sample(spark, prices, weights), ["target_id"], "price", "w", "seq", {"q": p}).first().q


def direct(values, weights, p):
    rows = sorted(zip(values, range(len(values)), weights))
    total, upto, at = sum(weights), 0.0, []
    for v, _, w in rows:
        at.append(((upto + w / 2) / total, v))
        upto += w
    if p <= at[0][0]:
        return at[0][1]
    for (a, v), (b, u) in zip(at, at[1:]):
        if a <= p < b:
            return v + (p - a) / (b - a) * (u - v)
    return at[-1][1]


def test_quantiles_by_hand_and_directly(spark):
    assert quantile(spark, [100, 200, 300], [1, 1, 1], 0.5) == 200
    assert quantile(spark, [100, 200, 300], [1, 1, 10], 0.5) > 200
    assert (quantile(spark, [10, 20, 30], [1, 1, 1], 0.0), quantile(spark, [10, 20, 30], [1, 1, 1], 1.0)) == (10, 30)
    assert quantile(spark, [1, 2, 3, 4, 5], [1] * 5, 0.25) == 1.75
    assert quantile(spark, [1, 3], [0, 0], 0.5) == 2
    rng = random.Random(3)
    values, weights = [rng.choice([1, 2, 2, 5, 9]) * 1.0 for _ in range(40)], [rng.random() + 0.1 for _ in range(40)]
    for p in (0.1, 0.25, 0.5, 0.77, 0.9):
        assert math.isclose(quantile(spark, values, weights, p), direct(values, weights, p))


def test_bucketed_quantiles_are_those_of_one_window(spark):
    rng = random.Random(8)
    rows = []
    for key, n in (("hot", 900), ("few", 3), ("one", 1), ("same", 50), ("weightless", 6), (None, 5)):
        for k in range(n):
            value = 7.0 if key == "same" else rng.choice([None, 5.0, 5.0, 5.0, 1e6, rng.random() * 100, rng.gauss(50, 1)])
            rows.append((key, k, value, 0.0 if key == "weightless" else rng.choice([0.2, 1.0, 5.0])))
    points = {"p0": 0.0, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    df = spark.createDataFrame(rows, "target_id string, seq long, price double, w double").filter("target_id is not null").repartition(3)
    for buckets in (2, 8, 64):
        got = {r.target_id: r for r in stats.bucketed_quantiles(df, ["target_id"], "price", "w", "seq", points, buckets).collect()}
        want = {r.target_id: r for r in stats.weighted_quantiles(df, ["target_id"], "price", "w", "seq", points).collect()}
        assert set(got) == set(want)
        assert all(math.isclose(got[k][p], want[k][p], rel_tol=1e-9) for k in want for p in points)
    flat = lambda d: sorted((r.target_id, r.seq, r.sample_n, r.outlier_flag, round(r.z or 0, 6)) for r in d.filter("price is not null").collect())
    assert flat(stats.flag_outliers(df, ["target_id"], "price", "seq")) == flat(stats.flag_outliers(df, ["target_id"], "price"))


def test_large_groups_lose_no_point_between_two_buckets(spark):
    weights = [[0.23, 0.42, 0.19, 0.46], [0.47, 0.82, 0.99, 0.3], [0.56, 0.7, 0.82, 0.44], [0.81, 0.15, 0.46, 0.5], [0.94, 0.28, 0.4, 0.82]]
    rows = [(k, n, n + 1.0, w) for k, group in enumerate(weights) for n, w in enumerate(group)]
    df = spark.createDataFrame(rows, "target_id long, seq long, price double, w double").repartition(1)
    for large in (0, stats.LARGE):
        got = {r.target_id: r.q for r in stats.bucketed_quantiles(df, ["target_id"], "price", "w", "seq", {"q": 0.5}, large=large).collect()}
        assert set(got) == set(range(len(weights)))
        assert all(math.isclose(got[k], direct([1.0, 2.0, 3.0, 4.0], w, 0.5), rel_tol=1e-9) for k, w in enumerate(weights))


def test_large_groups_are_cut_and_small_ones_not(spark):
    rng = random.Random(9)
    rows = [(key, k, rng.choice([5.0, rng.random() * 100]), rng.choice([0.2, 1.0])) for key, n in (("hot", 400), ("few", 3), (None, 5)) for k in range(n)]
    df = spark.createDataFrame(rows, "target_id string, seq long, price double, w double")
    points = {"p0": 0.0, "p25": 0.25, "p90": 0.9}
    of = lambda found: {r.target_id: (r.p0, round(r.p25, 9), round(r.p90, 9)) for r in found.collect()}
    assert of(stats.bucketed_quantiles(df, ["target_id"], "price", "w", "seq", points, large=100)) == of(stats.weighted_quantiles(df, ["target_id"], "price", "w", "seq", points))


def test_outliers_and_dispersion(spark):
    flags = lambda prices: [r.outlier_flag for r in stats.flag_outliers(sample(spark, prices), ["target_id"], "price").orderBy("seq").collect()]
    assert flags([100, 105, 110, 115, 500]) == [None] * 4 + ["OUTLIER_HIGH"]
    assert flags([100, 105, 500]) == [None] * 3
    assert stats.dispersion(sample(spark, [100] * 4), ["target_id"], "price", "seq").first().dispersion == 0
    assert stats.dispersion(sample(spark, [100]), ["target_id"], "price", "seq").first().dispersion is None


def test_recency(spark):
    rows = spark.createDataFrame([(730,), (0,), (-5,), (None,)], "age int").select(stats.recency_weight(F.col("age")).alias("w")).collect()
    assert [r.w for r in rows] == [0.5, 1.0, 1.0, 0.05]


@pytest.mark.parametrize(
    ("raw", "bucket", "number"),
    [("PCGS MS64", "UNC_MID", 64), ("UNC", "UNC_MID", None), ("XF details, cleaned", "DETAILS", None), ("VF", "VF", None), ("PF 69", "PROOF", 69), ("MS-61", "UNC_LOW", 61), ("", "UNKNOWN", None), (None, "UNKNOWN", None)],
)
def test_grades(spark, raw, bucket, number):
    row = matching.grade(spark.createDataFrame([(raw,)], "g string"), "g").first()
    assert (row.grade_bucket, row.numeric_grade) == (bucket, number)


def test_price_semantics(spark):
    rows = [("ESTIMATE", False, False), ("HAMMER", True, False), ("HAMMER", False, True), ("FIXED_PRICE", False, False), ("HAMMER", None, None)]
    df = spark.createDataFrame([(*r, 10.0, 12.0) for r in rows], "price_semantics string, withdrawn boolean, unsold boolean, hammer_price double, realized_price double")
    assert df.withColumn("price", valuation.effective_price()).filter(valuation.realized_eligible()).count() == 1


def snapshot(spark, **more):
    row = {"target_id": 1, "fair_low": 380.0, "fair_central": 420.0, "fair_high": 450.0, "confidence_label": "HIGH", "dispersion_label": "TIGHT", "disagreement": "ALIGNED", "houses": 3} | more
    return spark.createDataFrame([tuple(row.values())], "target_id long, fair_low double, fair_central double, fair_high double, confidence_label string, dispersion_label string, disagreement string, houses int")


def test_bids(spark):
    raws = ["320", "", "-50", "0", "abc", "50", "2000", "320,5"]
    bids = spark.createDataFrame([(k, 1, r, 20.0, 15.0, 5.0, 0.0) for k, r in enumerate(raws)], "bid_id long, target_id long, current_hammer_raw string, buyer_premium_pct double, shipping double, fixed_fees double, taxes double")
    got = {r.bid_id: r for r in advice.bid_advice(bids, snapshot(spark)).collect()}
    assert got[0].current_all_in == 404.0
    assert [got[k].recommendation for k in range(1, 5)] == [None] * 4
    assert got[5].recommendation == "STRONG BUY" and got[6].recommendation == "OVERPAY" and got[7].current_hammer == 320.5
    assert got[0].value_max < got[0].fair_max < got[0].collector_max


def test_net_proceeds(spark):
    terms = spark.createDataFrame([(15.0, 1.0, 8.0)], "commission_pct double, insurance_pct double, fixed_fees double")
    assert terms.select(advice.net_proceeds(F.lit(400.0)).alias("n")).first().n == 328.0


def test_asof_takes_the_nearest_earlier_day(spark):
    rates = spark.sql("SELECT 'USD' AS from_ccy, DATE'2026-05-08' AS rate_date, 0.867D AS rate UNION ALL SELECT 'USD', DATE'2026-05-11', 0.9D")
    sales = spark.sql("SELECT 1 AS k, 'USD' AS from_ccy, DATE'2026-05-10' AS auction_date UNION ALL SELECT 2, 'USD', DATE'2026-05-11' UNION ALL SELECT 3, 'USD', DATE'2026-05-01' UNION ALL SELECT 4, 'XXX', DATE'2026-05-11'")
    got = {r.k: (r.rate, r.is_exact) for r in joins.asof_rates(sales, rates).collect()}
    assert got == {1: (0.867, False), 2: (0.9, True), 3: (None, None), 4: (None, None)}


def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = joins.upsert(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, joins.upsert(once, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, joins.insert_new(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]


def test_specs_join_by_difference(spark):
    values = [0.0331, 0.0334, 0.03345, 0.03355, 0.5, 0.50009, 0.50011, 2.0]
    specs = spark.createDataFrame([(k, "AT", v, None, None, True, 0.5, float(k), 1.0, "x") for k, v in enumerate(values)], "id long, country string, denomination_value double, year_from int, year_to int, verified boolean, confidence double, weight_g double, diameter_mm double, primary_metal string")
    wanted = [0.0331, 0.0334, 0.0333, 0.03351, 0.49995, 0.5001, 1.9999, 2.00005, None]
    targets = spark.createDataFrame([(k, "at", v, 2000) for k, v in enumerate(wanted)], "target_id long, country string, denomination double, year int")
    got = {r.target_id: r.spec_id for r in joins.best_spec(targets, specs).collect()}
    near = lambda w: min((k for k, v in enumerate(values) if w is not None and abs(v - w) < 1e-4), default=None)
    assert got == {k: near(w) for k, w in enumerate(wanted)}


def test_specs_meet_what_targets_ask_once(spark):
    specs = spark.range(300).selectExpr("id", "'AT' AS country", "1.0D AS denomination_value", "cast(null AS int) AS year_from", "cast(null AS int) AS year_to", "true AS verified", "0.5D AS confidence", "1.0D AS weight_g", "1.0D AS diameter_mm", "'x' AS primary_metal")
    targets = spark.range(300).selectExpr("id AS target_id", "'at' AS country", "1.0D AS denomination", "2000 AS year")
    found = joins.best_spec(targets, specs)
    assert [(r.n, r.spec_id) for r in found.groupBy("spec_id").agg(F.count("*").alias("n")).collect()] == [(300, 0)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 3  # of specs, of targets and of what met


SALE = "target_id int, seq int, price_semantics string, hammer_price double, realized_price double, withdrawn boolean, unsold boolean, auction_date date, identity_match_score int, source string, source_url string, auction_house string, grade_weight double"


def test_backtest_values_each_sale_by_the_snapshot_of_its_day(spark):
    rng, first = random.Random(6), datetime.date(2019, 1, 1)
    rows = []
    for target, n in ((1, 40), (2, 7), (3, 1), (4, 3)):
        for k in range(n):
            price = rng.choice([100, 104, 104, 110, 95, 99.5, 400, 20]) * 1.0
            rows.append((target, k, "HAMMER", price, None, False, rng.random() < 0.1, first + datetime.timedelta(days=rng.randrange(40) * 20), rng.choice([50, 60, 80, 95]), rng.choice(["csv", "manual"]), rng.choice([None, "u"]), rng.choice(["A", " a", "B", "", None]), rng.choice([None, 0.3, 1.0])))
    rows.append((5, 0, "HAMMER", 10.0, None, False, False, None, 90, "csv", None, "A", None))
    sales = spark.createDataFrame(rows, SALE)
    asks = spark.createDataFrame([(1, 0, 120.0), (1, 1, 130.0), (2, 0, 90.0), (9, 0, 1.0)], "target_id int, seq int, price double")
    targets = spark.createDataFrame([(k, 0.9) for k in range(1, 5)], "target_id int, identity_quality double")
    got = {(r.target_id, r.seq): r for r in backtest.run_backtest(sales, asks, targets).collect()}
    cases = [r for r in rows if not r[6] and r[7] is not None]
    assert set(got) == {(r[0], r[1]) for r in cases}
    for r in rng.sample(cases, 5) + cases[-1:]:
        before = sales.filter((F.col("target_id") == r[0]) & (F.col("auction_date") < F.lit(r[7])))
        want = valuation.snapshot(before, asks, targets.filter(F.col("target_id") == r[0]), str(r[7])).first()
        found = got[r[0], r[1]]
        assert found.past_n == (want.n or 0) or found.past_n is None and want.n is None
        assert found.label == want.confidence_label
        for a, b in ((found.predicted_low, want.fair_low), (found.predicted, want.fair_central), (found.predicted_high, want.fair_high)):
            assert a is None and b is None or math.isclose(a, b, rel_tol=1e-9)
        assert found.within == (None if want.fair_central is None else want.fair_low <= r[3] <= want.fair_high)


@pytest.mark.parametrize("rows_a_batch", [7, 64, 10_000])
def test_backtest_values_many_targets_in_one_call(monkeypatch, rows_a_batch):
    rng, rows = random.Random(2), []
    for target, n in enumerate([1, 2, 3, 5, 30, 31, 200, 1, 12] * 3):
        sales = sorted((rng.choice([1.0, 2.0, 2.0, 9.0, 40.0, rng.random() * 10]), k) for k in range(n))
        rows += [(target, k, price, rng.randrange(12), rng.choice([0.1, 1.0, 3.0]), rng.choice(["EXACT", "STRONG", "SUPPORTING"]), rng.choice(["a", "b", "c", None]), rng.random() < 0.8) for price, k in sales]
    table = pa.Table.from_pylist([dict(zip(("target_id", "seq", "price", "day", "weight", "tier", "house", "counts"), r)) for r in rows])
    found = {}
    for small in (128, 0):
        monkeypatch.setattr(backtest, "SMALL", small)
        monkeypatch.setattr(backtest, "GATHERED", 50)
        found[small] = [r for b in backtest._known_before(iter(table.to_batches(rows_a_batch))) for r in b.to_pylist()]
    assert [(r["target_id"], r["seq"]) for r in found[128]] == [r[:2] for r in rows]
    for a, b in zip(found[128], found[0], strict=True):
        assert all(math.isclose(a[k], b[k], rel_tol=1e-9, abs_tol=1e-12) if isinstance(a[k], float) and b[k] is not None else a[k] == b[k] for k in a), (a, b)


def test_upper_median_error_of_each_label(spark):
    rng = random.Random(4)
    rows = [(label, None if rng.random() < 0.1 else rng.choice([0.5, rng.random()]), rng.random() < 0.5) for label, n in (("HIGH", 301), ("LOW", 40), ("MEDIUM", 1)) for _ in range(n)] + [("NONE", None, None)]
    got = {r.label: r for r in backtest.backtest_report(spark.createDataFrame(rows, "label string, pct_error double, within boolean")).collect()}
    for label in ("HIGH", "LOW", "MEDIUM", "NONE", None):
        errors = sorted(e for x, e, _ in rows if label in (x, None) and e is not None)
        assert (got[label].cases, got[label].scored, got[label].median_error) == (sum(label in (r[0], None) for r in rows), len(errors), errors[len(errors) // 2] if errors else None)


def test_order_by_price_against_direct_counting():
    rng = random.Random(1)
    for n in (1, 2, 3, 5, 8, 60):
        for _ in range(20):
            prices = sorted(rng.choice([1.0, 2.0, 2.0, 2.5, 9.0, 40.0, rng.random() * 10]) for _ in range(n))
            past, held, order = backtest._Past(prices), [], list(range(n))
            rng.shuffle(order)
            for at in order:
                weight = rng.choice([0.1, 1.0, 1.0, 3.0])
                past.add(at, weight)
                held = sorted([*held, (prices[at], at, weight)])
                values = [h[0] for h in held]
                middle = sorted(values)[(len(values) - 1) // 2] / 2 + sorted(values)[len(values) // 2] / 2
                away = sorted(abs(v - middle) for v in values)
                assert math.isclose(past.median(), middle)
                assert math.isclose(past.deviation(past.median()), (away[(len(away) - 1) // 2] + away[len(away) // 2]) / 2, abs_tol=1e-12)
                low, high = rng.choice([(-math.inf, math.inf), (2.0, 9.0), (2.2, 2.3), (50.0, 60.0)])
                weights = [w * (1.0 if low <= v <= high else 0.35) for v, _, w in held]
                points = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
                for p, q in zip(points, past.quantiles(points, 0.35, low, high)):
                    assert math.isclose(q, direct(values, weights, p), rel_tol=1e-9), (values, weights, p)
                spread = [direct(values, [1.0] * len(values), p) for p in (0.25, 0.5, 0.75)]
                assert past.dispersion() is None if len(values) < 2 else math.isclose(past.dispersion(), (spread[2] - spread[0]) / spread[1], abs_tol=1e-12)
