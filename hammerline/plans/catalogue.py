"""Queries over catalogue labels and listing texts; their twins follow from the rules the labels are made by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hammerline.functions import catalogue as c
from hammerline.functions import denominations as dn
from hammerline.functions import places
from hammerline.operators import listings, valuation
from hammerline.plans.market import r4
from hammerline.sources import derived as d
from hammerline.sources import landed

QUERIES, ORACLES = {}, {}
K = "p_partkey"


def add(name, build, sql):
    QUERIES[name] = build
    ORACLES[name] = sql


def pick(values: list, key: str = K) -> Column:
    """The values in turn, by a key."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def sql_pick(values: list, kind: str = "VARCHAR", key: str = K) -> str:
    shown = ["NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values]
    return f"CAST(list_extract([{', '.join(shown)}], CAST({key} % {len(values)} + 1 AS INTEGER)) AS {kind})"


def labelled(name: str, labels: list[str | None], found, expected: dict[str, tuple[list, str]]) -> None:
    """Registers a query of a column function over labels that the parts bear in turn."""
    run = lambda s, f: r4(d.table(s, f, "part").withColumn("label", pick(labels)).select(K, *[x.alias(n) for n, x in found(F.col("label")).items()]))
    add(name, run, f"SELECT {K}, " + ", ".join(f"{sql_pick(v, kind)} AS {n}" for n, (v, kind) in expected.items()) + " FROM part")


labelled(
    "parse_catalog_denomination", ["½ Dollar", "1 / 4 Florin", "3/8", "2,5 Schilling", ".5 Ecu", "+7  Groats", "0 Mark", "abc", "", None, "1/0 Mark", "25 Cents"],
    lambda x: dict(zip(("value", "unit", "error"), c.catalog_denomination(x))),
    {"value": ([0.5, 0.25, 0.375, 2.5, 0.5, 7, None, None, None, None, None, 25], "DOUBLE"), "unit": (["Dollar", "Florin", None, "schilling", "Ecu", "Groats", None, None, None, None, None, "cent"], "VARCHAR"),
     "error": ([None] * 6 + ["INVALID", "INVALID", "EMPTY", "EMPTY", "INVALID", None], "VARCHAR")},
)
labelled("spec_denomination_value", ["50 cent", "0,5", "2 euro", "20 Λεπτά", "none", None], lambda x: {"value": c.spec_denomination(x)}, {"value": ([0.5, 0.5, 2, 0.2, None, None], "DOUBLE")})
labelled("numeric_denomination", ["10 francs", "0,5", "2.346", "", "1.0", None], lambda x: {"value": c.bare_number(x)}, {"value": ([None, 0.5, 2.35, None, 1, None], "DOUBLE")})
labelled("parse_face_value", ["1/2 dollar 1964", "2  1/2 gulden", "1964 quarter 25 cents", "no", "1899", "12 1/4 x", "0,5 lira"], lambda x: {"value": c.face_value(x)}, {"value": ([0.5, 2.5, 25, None, None, 0.25, 0.5], "DOUBLE")})
labelled(
    "catalog_ids", ["KM# 123 dollar 1964", "quarter P 1964", "Pick 12a note", "P#7 and Y 44", "RIC 201 denarius", "", None],
    lambda x: c.catalog_references(x) | {"rest": c.without_references(x)},
    {"km": (["123", None, None, None, None, None, None], "VARCHAR"), "y": ([None, None, None, "44", None, None, None], "VARCHAR"), "pick": ([None, None, "12a", "7", None, None, None], "VARCHAR"),
     "ric": ([None, None, None, None, "201", None, None], "VARCHAR"), "rest": (["dollar 1964", "quarter P 1964", "note", "and", "denarius", "", None], "VARCHAR")},
)
labelled(
    "parse_price", ["EUR 12,50", "only 1.234,50 €", "US$ 1,234.50", "now £7", "99 CHF", "7 GBP or 8 EUR", "none 12", None],
    lambda x: dict(zip(("amount", "currency"), c.money(x))),
    {"amount": ([12.5, 1234.5, 1234.5, 7, 99, 7, None, None], "DOUBLE"), "currency": (["EUR", "EUR", "USD", "GBP", "CHF", "GBP", None, None], "VARCHAR")},
)
labelled("norm_listing", ["5 M&#228;rk &amp; &quot;UNC&quot;", "ΕΛΛΆΔΑ 2 Ευρώ!", "  Écu   d'Or 1/2 ", "", None], lambda x: {"norm": c.listing_norm(x)}, {"norm": (["5 märk unc", "ελλαδα 2 ευρω", "écu d or 1/2", "", None], "VARCHAR")})
labelled("parse_sale_date", ["2024-01-31", "2024-02-30", "2024-1-3", "31.01.2024", "", None], lambda x: {"day": landed.strict_date(x)}, {"day": (["2024-01-31", None, None, None, None, None], "DATE")})
labelled(
    "parse_feed_date", ["Tue, 02 Jan 2024 03:04:05 +0000", "2 Jan 2024 03:04:05 GMT", "Tue, 02 Jan 2024 03:04:05 +0200", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05", "2024-01-02", "soon", None],
    lambda x: {"at": c.feed_date(x).cast("timestamp_ntz")},
    {"at": (["2024-01-02 03:04:05", "2024-01-02 03:04:05", "2024-01-02 01:04:05", "2024-01-02 03:04:05", "2024-01-02 03:04:05", "2024-01-02 00:00:00", None, None], "TIMESTAMP")},
)
labelled(
    "flatten_json_text", ['{"a": "x", "b": {"c": 1.5, "d": ["y z", true, null]}}', '{"value": {"text": "2 Euro"}, "type": "coin"}', '{"value": "half", "q": "say \\"a: b\\""}', "{}", None],
    lambda x: {"leaves": c.json_leaves(x), "value": c.first_path(x, "$.value.text", "$.value")},
    {"leaves": (["x 1.5 y z true", "2 Euro coin", 'half say "a: b"', "", None], "VARCHAR"), "value": ([None, "2 Euro", "half", None, None], "VARCHAR")},
)
labelled("smart_join_fragments", ["33|,90|EUR", "3|3,90 EUR", "old|price|5", "|a||b", ""], lambda x: {"joined": c.joined_fragments(F.split(x, r"\|"))}, {"joined": (["33,90 EUR", "33,90 EUR", "old price 5", "a b", ""], "VARCHAR")})
labelled("grade_tier", ["Proof 1964", "nice VF", "UNC", "no grade", None], lambda x: {"tier": listings.grade_tier(x)}, {"tier": (["MINT", "CIRCULATED", "MINT", None, None], "VARCHAR")})
labelled("variant_explicit", ["large date silver", "silver date", "", None], lambda x: {"explicit": c.says_whole(x, F.array(F.lit("silver"), F.lit("date")))}, {"explicit": ([True, True, False, False], "BOOLEAN")})
labelled(
    "country_in_title", ["10 Mark Österreich", "hellas 5", "FRANCE 1 franc", "5 lire", "ΕΛΛΆΔΑ 2 ευρώ", "San-Marino", None],
    lambda x: {"country": places.country_of(x), "greek": places.country_in(x, F.lit("Griechenland")), "unknown": places.country_in(x, F.lit("Lire")), "any": places.country_in(x, F.lit(None).cast("string"))},
    {"country": (["Austria", "Greece", "France", None, "Greece", "San Marino", None], "VARCHAR"), "greek": ([False, True, False, False, True, False, False], "BOOLEAN"),
     "unknown": ([False] * 3 + [True] + [False] * 3, "BOOLEAN"), "any": ([True] * 7, "BOOLEAN")},
)


def _pattern(names: str) -> str:
    return "(?:" + "|".join(n.replace(".", "\\.").replace("-", "\\-") for n in sorted(set(names.split("|")), key=lambda n: (-len(n), n))) + ")"


labelled(
    "destination_pattern", ["GREECE", "Deutschland", "france", "USA", "st. peru", "San Marino", None], lambda x: {n: places.destination(x)[n] for n in ("name", "code", "pattern")},
    {"name": (["Greece", "Germany", "France", "United States", "St. Peru", "San Marino", "Greece"], "VARCHAR"), "code": (["GR", "DE", "FR", "US", "", "", "GR"], "VARCHAR"),
     "pattern": ([_pattern(places.NAMES.get(n, n)) for n in ("greece", "germany", "france", "united states", "st. peru", "san marino", "greece")], "VARCHAR")},
)
labelled("variant_aliases", ["PP coloured 1999", "small date", "proofs", "off-centre strike BU", "Αναμνηστικό", "", None], lambda x: {"variants": F.array_join(c.variants_of(x), ",")}, {"variants": (["colorized,proof", "small_date", "", "error,unc", "commemorative", "", ""], "VARCHAR")})
labelled(
    "denomination_matches", ["2 euro 50 cents", "5 mark", "none", "", "half crown, two euros or 5 Mark"],
    lambda x: {n: dn.fits(dn.extract_denominations(x), v, u) for n, v, u in (("two_euro", F.lit(2.0), F.lit("euro")), ("five_mark", F.lit(5.0), F.lit("mark")), ("unknown", F.lit(None).cast("double"), F.lit(None).cast("string")))},
    {"two_euro": ([True, False, False, False, True], "BOOLEAN"), "five_mark": ([False, True, False, False, True], "BOOLEAN"), "unknown": ([True] * 5, "BOOLEAN")},
)


def _variants(x: Column) -> dict[str, Column]:
    found = c.search_strings(places.names_of(x), F.array(F.lit("0.5 euro"), F.lit("50 cent"), F.lit("0.5 euro")), F.lit("1999"), 5)
    return {"n": F.size(found), "last": F.element_at(found, -1)}


labelled("query_variants", ["Austria", "France", "Hellas", "Peru"], _variants, {"n": ([5, 5, 5, 2], "INTEGER"), "last": (["österreich 0.5 euro 1999", "française 0.5 euro 1999", "hellas 0.5 euro 1999", "peru 50 cent 1999"], "VARCHAR")})
_EURO = ["Austria", "Greece", "Croatia", "France", "Latvia"]
add(
    "catalogue_denomination_form",
    lambda s, f: d.specs(s, f).select("id", c.euro_label(F.col("country").isin(_EURO) & (F.col("id") % 7 != 0), F.col("denomination_value").cast("string")).alias("label")),
    f"WITH {d.SPECS_SQL} SELECT id, CASE WHEN id % 7 = 0 THEN CAST(denomination_value AS VARCHAR) WHEN denomination_value < 1 THEN CAST(round(denomination_value * 100) AS BIGINT) || ' cent' ELSE CAST(round(denomination_value) AS BIGINT) || ' euro' END AS label FROM specs",
)
add("round_money", lambda s, f: d.comparables(s, f).select("target_id", "seq", F.bround(F.floor(F.col("hammer_price")) / 8, 2).alias("eighth")), f"WITH {d.COMPARABLES_SQL} SELECT target_id, seq, round_even(floor(hammer_price) / 8, 2) AS eighth FROM comparables")
add("age_days", lambda s, f: d.comparables(s, f).select("target_id", "seq", valuation.age_days("2000-01-01").alias("age")), f"WITH {d.COMPARABLES_SQL} SELECT target_id, seq, CAST(greatest(0, date_diff('day', auction_date, DATE '2000-01-01')) AS INTEGER) AS age FROM comparables")
add("source_weight", lambda s, f: r4(d.comparables(s, f).select("target_id", "seq", valuation.source_weight().alias("weight"))), f"WITH {d.COMPARABLES_SQL} SELECT target_id, seq, CASE WHEN source = 'csv' THEN 0.8 WHEN source_url IS NOT NULL THEN 0.85 ELSE 0.65 END::DOUBLE AS weight FROM comparables")
add(
    "semantic_denomination_aliases",
    lambda s, f: _aliased(d.specs(s, f)),
    f"""WITH {d.SPECS_SQL}, a(value, alias) AS (VALUES (0.5, 'half'), (0.5, '50 cents'), (0.01, 'cent'), (2.0, 'two'), (0.2, 'fifth'))
    SELECT id, coalesce(string_agg(alias, ',' ORDER BY alias), '') AS aliases FROM specs LEFT JOIN a ON abs(value - denomination_value) < 1e-9 GROUP BY id""",
)
#: Words for values of a currency's unit (fixed values).
VALUE_WORDS = {0.5: ["half", "50 cents"], 0.01: ["cent"], 2.0: ["two"], 0.2: ["fifth"]}


def _aliased(specs):
    words = F.array().cast("array<string>")
    for value, names in VALUE_WORDS.items():
        words = F.when(F.abs(F.col("denomination_value") - value) < 1e-9, F.array(*map(F.lit, names))).otherwise(words)
    return specs.select("id", F.array_join(F.array_sort(words), ",").alias("aliases"))
