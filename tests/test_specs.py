import random

from pyspark.sql import functions as F

from hammerline.operators import specs


def cluster(values, absolute, relative):
    """The anchor with most values within its width, the first of equals, and the middle of its cluster."""
    near = [[y for y in values if abs(y - x) <= max(absolute, abs(x) * relative)] for x in values]
    best = sorted(max(near, key=len))
    return (best[(len(best) - 1) // 2] + best[len(best) // 2]) / 2, len(best)


def test_consensus_equals_all_pairs_also_on_the_edge(spark):
    rnd = random.Random(3)
    items = {i: [round(rnd.choice([2.3, -4, 0, 100]) + rnd.randrange(-9, 9) / 100, 2) for _ in range(rnd.randrange(1, 30))] for i in range(60)}
    items[60] = [0.1 + 0.2, 0.3, 0.30000000000000004, 0.33, 0.27, 0.33000000000000002, 0.32999999999999996]
    items[61] = [5.0] * 40 + [1e9, -1e9, 1e-9]
    rows = [(i, f"d{n}", n, v) for i, vs in items.items() for n, v in enumerate(vs)] + [(62, "d", 1, None)]
    table = spark.createDataFrame(rows, "item int, dealer string, seq int, v double")
    for absolute, relative in ((0.03, 0.0), (0.08, 0.004), (0.0, 0.0), (0.01, 0.5)):
        got = {r.item: (r.value, r.support) for r in specs.numeric_consensus(table, "item", "dealer", "v", absolute, relative).collect()}
        assert got == {i: cluster(vs, absolute, relative) for i, vs in items.items()}, (absolute, relative)


def test_a_consensus_needs_no_lists_and_one_shuffle_of_values(spark):
    table = spark.createDataFrame([(1, "a", 1, 2.0)], "item int, dealer string, seq int, v double")
    plan = specs.numeric_consensus(table, "item", "dealer", "v", 0.03, 0.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "RepartitionByExpression" in plan
    assert specs.numeric_consensus(table.filter("false"), "item", "dealer", "v", 0.03, 0.0).count() == 0


def test_samples_are_the_least_and_counts_are_whole(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("id"), F.when(F.col("id") % 100 == 0, "rare").otherwise("hot").alias("code"))
    wanted = {}
    for r in rows.collect():
        wanted.setdefault(r.code, []).append(r.id)
    got = {r.code: (r.n, [x.id for x in r.samples]) for r in specs.sampled(rows, "code", "id", most=5, parts=16).collect()}
    assert got == {c: (len(ids), sorted(ids)[:5]) for c, ids in wanted.items()}
    assert specs.sampled(rows.filter("false"), "code", "id").count() == 0


def test_what_blocks_unattended_work(spark):
    kinds = "id int, country string, denomination_value double, weight_g double, diameter_mm double, primary_metal string, fineness_per_mille double, issue_year int, year_from int"
    rows = spark.createDataFrame([(1, "Austria", 2.0, 8.5, 25.75, "silver", 900.0, 2005, None), (2, "Austria", 2.0, 8.5, 25.75, "bimetal", None, 1990, None), (3, None, None, None, None, None, 1000.0, None, 1), (4, "X", 1.0, 1.0, 1.0, "gold", 1000.5, None, None)], kinds)
    plain = {r.code: (r.n, r.example, r.blocking) for r in specs.integrity(rows).collect()}
    assert plain == {"euro_conflict": (1, 1, True), "euro_year": (1, 2, False), "fineness_range": (1, 4, True), "no_year": (1, 4, True)}
    chosen = {r.code: r.n for r in specs.integrity(rows, rows.filter("id < 3")).collect()}
    assert chosen["overlap"] == 1 and len(chosen) == 5
