import datetime

import pytest

from pyspark.sql import functions as F

from hammerline.functions import denominations as dn
from hammerline.functions import text as t
from hammerline.operators import listings
from hammerline.sources import landed


def test_csv_header_in_any_case_and_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Hammer,DATE,Currency,other\n"120,50",2024-01-31,usd,x\n-3,2024-01-31,,\nabc,,,\n99,2024-02-30,,\n')
    got = [(r.hammer_price, r.auction_date, r.currency, r.source) for r in landed.read_comparables_csv(spark, f"file://{tmp_path}/a.csv").collect()]
    assert got == [(120.5, datetime.date(2024, 1, 31), "USD", "csv"), (99.0, None, "EUR", "csv")]
    (tmp_path / "b.csv").write_text("price\n1\n")
    with pytest.raises(ValueError, match="hammer"):
        landed.read_comparables_csv(spark, f"file://{tmp_path}/b.csv")


def test_lines_of_both_kinds(spark, tmp_path):
    (tmp_path / "l.txt").write_text("120\n99,5\n\nhello\n2024-03-01 | 75 | gbp | VF | House | http://x\n | 60\n2024 | -1 | EUR\n")
    got = sorted((r.hammer_price, r.currency, r.grade_raw, r.source_url) for r in landed.read_comparables_lines(spark, f"file://{tmp_path}/l.txt").collect())
    assert got == [(60.0, "EUR", None, None), (75.0, "GBP", "VF", "http://x"), (99.5, "EUR", None, None), (120.0, "EUR", None, None)]


@pytest.mark.parametrize(("raw", "value"), [("1,234.50", 1234.5), ("1.234,50", 1234.5), ("1.234.567", 1234567.0), ("1.234", 1.234), ("12,5", 12.5), ("abc", None), (None, None)])
def test_numbers(spark, raw, value):
    assert spark.createDataFrame([(raw,)], "x string").select(t.parse_number(F.col("x")).alias("v")).first().v == value


@pytest.mark.parametrize(("raw", "found"), [("1/2 Dollar", (0.5, "dollar")), ("1000 lire", (1000.0, "lira")), ("25 Euro cents", (25.0, "cent")), ("2 Euro", (2.0, "euro")), ("0,5 Euro", (0.5, "euro")), ("", (None, None))])
def test_denominations(spark, raw, found):
    value, unit = dn.parse_denomination(F.col("x"))
    row = spark.createDataFrame([(raw,)], "x string").select(value.alias("v"), unit.alias("u")).first()
    assert (row.v, row.u) == found


def test_normal_form_year_and_scope(spark):
    row = spark.createDataFrame([("  ÉCU d'Or  ½, 1899 and 2199x 1450!", "Proof SET of coins")], "x string, y string").select(
        t.norm(F.col("x")).alias("n"), t.parse_year(F.col("x")).alias("year"), t.product_scope(F.col("y")).alias("scope"), t.transliterate_greek(F.lit("Θεσχψ")).alias("g")
    )
    assert tuple(row.first()) == ("ecu d or 1/2 1899 and 2199x 1450", 1450, "SET", "thesc".replace("c", "ch") + "ps")


def test_entry_and_queries_have_twins(spark):
    import __spark_entry__ as entry

    queries, twins = entry.queries(), entry.oracle_sql()
    assert set(twins) <= set(queries) and len([q for q in queries if not q.startswith("op")]) >= 100
    assert entry.entry(spark).columns[:2] == ["target_id", "n"]


def test_euro_issuers_and_unavailable_words(spark):
    from hammerline.functions import text as t
    from hammerline.operators import specs

    rows = spark.createDataFrame([("Spain",), (" ESTONIA ",), ("san marino",), ("Japan",), (None,)], "country string")
    assert [r.y for r in rows.select(specs.euro_start().alias("y")).collect()] == [1999, 2011, 2002, None, None]
    texts = spark.createDataFrame([("Out of stock",), ("nicht verfügbar",), ("Not available now",), ("in stock",), ("unsold",), (None,)], "x string")
    assert [r.g for r in texts.select(t.looks_unavailable(texts.x).alias("g")).collect()] == [True, True, True, False, False, False]


@pytest.mark.parametrize(("raw", "found"), [
    ("1 Dollar 1923, quarter dollar and 1/4 Dollar", [(1.0, "dollar"), (0.25, "dollar")]),
    ("2 Euro-Cent / 2 EURO", [(2.0, "cent"), (2.0, "euro")]),
    ("half crown; 5&nbsp;Złotych, 10 Øre, ½ €", [(0.5, "crown"), (5.0, "zloty"), (10.0, "ore"), (0.5, "euro")]),
    ("3 Deutsche Mark 5marks", [(3.0, "mark"), (5.0, "mark")]),
    ("2,50 francs. 1950. mark", [(2.5, "franc"), (1950.0, "mark")]),
    ("someone marks 5 markers, 1/0 euro", []),
    ("", []), (None, []), ("x " * 50_000 + "7 lei", [(7.0, "leu")]),
])
def test_all_denominations_of_a_text(spark, raw, found):
    row = spark.createDataFrame([(raw,)], "x string").select(dn.extract_denominations(F.col("x")).alias("d")).first()
    assert [tuple(d) for d in row.d] == found


def test_a_later_denomination_can_match_and_only_others_veto(spark):
    titles = ["1 Mark, not 2 Mark", "5 Mark", "no unit", "two mark"]
    rows = spark.createDataFrame([(i, t, 2.0, "mark") for i, t in enumerate(titles)], "i int, title string, v double, u string")
    stated = dn.extract_denominations(F.col("title"))
    got = rows.orderBy("i").select(dn.fits(stated, F.col("v"), F.col("u")).alias("f"), dn.conflicts(stated, F.col("v"), F.col("u")).alias("c")).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, True), (False, False), (True, False)]


def test_type_bonus_adds_up_for_dollars_of_the_united_states_only(spark):
    rows = [("Peace Dollar silver dollar", "United States", "1 Dollar"), ("Morgan-Dollar", "united states ", "dollar"), ("Peace Dollar", "Canada", "1 Dollar"), (None, "United States", "dollar"), ("peace dollar", None, None)]
    frame = spark.createDataFrame(list(enumerate(rows)), "i int, r struct<t: string, c: string, d: string>").orderBy("i")
    got = [round(r.b, 4) for r in frame.select(listings.type_bonus(F.col("r.t"), F.col("r.c"), F.col("r.d")).alias("b")).collect()]
    assert got == [0.26, 0.1, 0.0, 0.0, 0.0]
