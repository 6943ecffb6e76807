"""Queries over what texts and sales state: all denominations, wordings of types, keys, amounts in one currency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hammerline.functions import denominations as dn
from hammerline.functions import text as t
from hammerline.operators import joins, listings
from hammerline.plans.catalogue import pick, sql_pick
from hammerline.plans.market import r4
from hammerline.plans.trade import RATED, _rated
from hammerline.sources import derived as d

QUERIES, ORACLES = {}, {}


def add(name, build, sql):
    QUERIES[name] = build
    ORACLES[name] = sql


NAMES, WORDS = list(dn.UNITS), list(dn.NUMBER_WORDS)


def _titles(s: SparkSession, f: str) -> DataFrame:
    """A title a part, which states two denominations beside other words, and every third time one of them again."""
    size = F.col("p_size").cast("string")
    again = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(", "), size, F.lit(" "), pick(NAMES))).otherwise("")
    title = F.concat(size, F.lit(" "), pick(NAMES), F.lit(", "), F.col("p_name"), F.lit(" "), pick(WORDS), F.lit(" "), pick(NAMES, "p_size"), again, F.lit(" "), F.col("p_type"))
    return d.table(s, f, "part").select("p_partkey", title.alias("title"))


#: The twin takes the titles apart at spaces and looks numbers and names up in tables, two-word names first.
_TITLES = f"""titles AS (SELECT p_partkey, lower(p_size || ' ' || {sql_pick(NAMES)} || ', ' || p_name || ' ' || {sql_pick(WORDS)} || ' ' || {sql_pick(NAMES, key='p_size')}
  || CASE WHEN p_partkey % 3 = 0 THEN ', ' || p_size || ' ' || {sql_pick(NAMES)} ELSE '' END || ' ' || p_type) AS title FROM part)"""
_UNITS = ", ".join(f"('{n}', '{u}')" for n, u in dn.UNITS.items())
_NUMBERS = ", ".join(f"('{w}', {v})" for w, v in dn.NUMBER_WORDS.items())
add(
    "extract_denominations",
    lambda s, f: _titles(s, f).select("p_partkey", F.array_join(F.transform(dn.extract_denominations(F.col("title")), lambda x: F.concat_ws(" ", (x.value * 1000).cast("long").cast("string"), x.unit)), ",").alias("stated")),
    f"""WITH {_TITLES}, units(name, unit) AS (VALUES {_UNITS}), numbers(word, value) AS (VALUES {_NUMBERS}),
    w AS (SELECT p_partkey, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM (SELECT p_partkey, regexp_split_to_array(title, '[ ,]+') AS ws FROM titles)),
    n AS (SELECT p_partkey, p, coalesce(value, try_cast(w.word AS DOUBLE)) AS v FROM w LEFT JOIN numbers ON w.word = numbers.word),
    pairs AS (SELECT a.p_partkey, a.p, a.word AS one, a.word || ' ' || b.word AS two FROM w a LEFT JOIN w b ON a.p_partkey = b.p_partkey AND b.p = a.p + 1),
    found AS (SELECT n.p_partkey, n.p, v, coalesce(u2.unit, u1.unit) AS unit FROM n JOIN pairs q ON n.p_partkey = q.p_partkey AND q.p = n.p + 1
      LEFT JOIN units u1 ON u1.name = q.one LEFT JOIN units u2 ON u2.name = q.two WHERE v IS NOT NULL),
    firsts AS (SELECT p_partkey, v, unit, min(p) AS p FROM found WHERE unit IS NOT NULL GROUP BY ALL)
    SELECT p_partkey, coalesce(string_agg(CAST(CAST(v * 1000 AS BIGINT) AS VARCHAR) || ' ' || unit, ',' ORDER BY p), '') AS stated FROM part LEFT JOIN firsts USING (p_partkey) GROUP BY p_partkey""",
)


def _dollars(s: SparkSession, f: str) -> DataFrame:
    nation = d.table(s, f, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    words = pick(["Peace Dollar", "Morgan Dollar", "silver dollar", "Peace Dollar, silver dollar", "Dollar"], "s_suppkey")
    return d.table(s, f, "supplier").join(nation, "s_nationkey").select("s_suppkey", "n_name", "s_name", F.concat(F.lit("1921 "), words, F.lit(" "), F.col("s_name")).alias("title"), "s_acctbal", "s_nationkey")


add(
    "type_bonus",
    lambda s, f: r4(_dollars(s, f).select("s_suppkey", listings.type_bonus(F.col("title"), F.col("n_name"), F.when(F.col("s_suppkey") % 7 == 0, "1 Cent").otherwise("1 Dollar")).alias("bonus"))),
    "WITH x AS (SELECT s_suppkey, n_name, CAST(s_suppkey % 5 AS INTEGER) AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey) "
    "SELECT s_suppkey, CASE WHEN n_name = 'UNITED STATES' AND s_suppkey % 7 <> 0 THEN CASE k WHEN 0 THEN 0.18 WHEN 1 THEN 0.1 WHEN 2 THEN 0.08 WHEN 3 THEN 0.26 ELSE 0 END ELSE 0 END::DOUBLE AS bonus FROM x",
)
add(
    "coin_key",
    lambda s, f: _dollars(s, f).select("s_suppkey", t.coin_key(F.concat(F.lit(" "), F.col("n_name")), F.lit("1 Dollar "), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_nationkey") + 1900), F.col("s_name")).alias("coin_key")),
    "SELECT s_suppkey, concat_ws('|', lower(n_name), '1 dollar', CASE WHEN s_suppkey % 4 <> 0 THEN CAST(s_nationkey + 1900 AS VARCHAR) ELSE '' END, lower(trim(s_name))) AS coin_key FROM supplier JOIN nation ON s_nationkey = n_nationkey",
)
add(
    "normalize_amount",
    lambda s, f: joins.normalize_amounts(_rated(s, f), "hammer_price").select("target_id", "seq", "normalized_price", "fx_source", "fx_date", "fx_confidence"),
    f"""WITH {RATED}, c AS (SELECT *, from_ccy = 'EUR' AS own, round(CASE WHEN from_ccy = 'EUR' THEN hammer_price ELSE hammer_price * rate END * 100, 4) AS cents FROM rated)
    SELECT target_id, seq, CASE WHEN cents - floor(cents) = 0.5 THEN floor(cents) + floor(cents) % 2 ELSE round(cents) END / 100 AS normalized_price,
      CASE WHEN own THEN 'same_currency' WHEN rate IS NOT NULL THEN 'reference_rates' END AS fx_source, CASE WHEN own THEN auction_date ELSE rate_date END AS fx_date,
      CASE WHEN own THEN 'auction_date' WHEN rate IS NULL THEN NULL WHEN is_exact THEN 'auction_date' ELSE 'current_fallback' END AS fx_confidence FROM c""",
)
