"""Queries over aliases, candidates, corrections and evidence, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from hammerline.functions import text as t
from hammerline.operators import identity, resolver, specs
from hammerline.plans import texts
from hammerline.plans.catalogue import K, pick, sql_pick
from hammerline.plans.market import r4
from hammerline.plans.trade import AUDIT, FIRSTS, QUEUE, queue
from hammerline.sources import derived as d

QUERIES, ORACLES = {}, {}


def add(name, build, sql=None):
    QUERIES[name] = build
    if sql:
        ORACLES[name] = sql


def aliases(s, f):
    """Aliases of one to three words, a row a nation and a region, and some phrases of the texts."""
    nation = d.table(s, f, "nation").select(F.lower("n_name").alias("alias"), F.col("n_name").alias("target"))
    words = s.createDataFrame([("of the", "OF-THE"), ("de la", "DE-LA"), ("in der", "IN-DER"), ("and the", "AND-THE")], "alias string, target string")
    return nation.union(words)


def _phrases(s, f):
    """Runs of one to three words of all documents, turns and names of nations, and those names misspelt."""
    names = d.table(s, f, "nation").select(F.lower("n_name").alias("n"), F.explode(F.array(F.lower("n_name"), F.concat(F.lower("n_name"), F.lit("x")), F.regexp_replace(F.lower("n_name"), "[aeiou]", ""))).alias("word"))
    runs = identity.word_runs(d.table(s, f, "documents"), "doc_id", "text", "word").union(identity.word_runs(d.table(s, f, "conversations"), "conv_id", "text", "word"))
    return runs.select("word").union(names.select("word"))


_WORDS = f"w AS (SELECT doc_id, list_filter(string_split({texts._NORM.format('text')}, ' '), lambda x: x <> '') AS ws FROM documents)"
add("fuzzy_alias_match", lambda s, f: identity.similar_alias(_phrases(s, f), aliases(s, f), "word"))
add("similarity", lambda s, f: r4(d.table(s, f, "part").select("p_partkey", identity.similarity(F.lower("p_name"), F.lower("p_type")).alias("ratio"))))
add(
    "issuer_join",
    lambda s, f: identity.exact_alias(d.table(s, f, "documents"), aliases(s, f), "doc_id", "text").groupBy("target").agg(F.count("*").alias("n_docs")),
    f"""WITH {_WORDS}, runs AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS alias FROM w, unnest(range(1, len(ws) + 1)) u(i), (VALUES (1), (2), (3)) v(k)),
    al(alias, target) AS (SELECT lower(n_name), n_name FROM nation UNION ALL VALUES ('of the', 'OF-THE'), ('de la', 'DE-LA'), ('in der', 'IN-DER'), ('and the', 'AND-THE'))
    SELECT target, count(*) AS n_docs FROM runs JOIN al USING (alias) GROUP BY ALL""",
)


def _issued(s, f):
    """A text a customer: its nation in a sentence, misspelt in every fifth; with a year, and every second with a region."""
    k = F.col("c_custkey")
    rows = d.table(s, f, "customer").join(d.table(s, f, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    text = F.concat(F.lit("A coin of "), F.initcap("n_name"), F.when(k % 5 == 1, "x").otherwise(", fine"))
    region = F.when(k % 2 == 0, (F.col("n_regionkey") + F.when(k % 6 == 0, 1).otherwise(0)).cast("string"))
    return rows.select(k, text.alias("text"), region.alias("country_code"), F.when(k % 7 != 0, 1995 + k % 40).cast("int").alias("year"))


def _issuers(s, f):
    """Nations as issuers with ten years each; every fourth still issues."""
    n = F.col("n_nationkey")
    return d.table(s, f, "nation").select(F.col("n_name").alias("issuer"), n.alias("place"), t.norm(F.col("n_name")).alias("alias"), F.col("n_regionkey").cast("string").alias("country_code"), (1995 + n).cast("int").alias("valid_from"), F.when(n % 4 != 0, 2005 + n).cast("int").alias("valid_to"))


add(
    "issuer_validity_join",
    lambda s, f: r4(identity.issuers_of(_issued(s, f), _issuers(s, f), "c_custkey", "text")),
    f"""WITH i AS (SELECT c_custkey, n_name, n_nationkey AS n, 1995 + c_custkey % 40 AS year FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 5 <> 1 AND c_custkey % 6 <> 0)
    SELECT c_custkey, n_name AS issuer, {texts._NORM.format('n_name')} AS alias, 1::DOUBLE AS score FROM i
    WHERE c_custkey % 7 = 0 OR (year >= 1995 + n AND (n % 4 = 0 OR year <= 2005 + n))""",
)
_scored = lambda s, f: d.dealer_prices(s, f).select("target_id", "seq", F.col("score").alias("confidence"))
add(
    "ambiguity_gap",
    lambda s, f: r4(identity.candidates(_scored(s, f), ["target_id"])),
    f"WITH {d.DEALER_PRICES_SQL}, r AS (SELECT target_id, seq, score AS confidence, score - lead(score) OVER k AS gap, row_number() OVER k AS rn FROM dealer_prices WINDOW k AS (PARTITION BY target_id ORDER BY score DESC, seq)) "
    "SELECT target_id, seq, round(confidence + 1e-7, 4) AS confidence, round(gap + 1e-7, 4) AS gap, coalesce(gap < 0.08, false) AS ambiguous FROM r WHERE rn = 1",
)
add(
    "top_candidates",
    lambda s, f: _scored(s, f).selectExpr("target_id", "seq", "row_number() OVER (PARTITION BY target_id ORDER BY confidence DESC, seq) AS rank").filter("rank <= 8"),
    f"WITH {d.DEALER_PRICES_SQL} SELECT target_id, seq, CAST(row_number() OVER (PARTITION BY target_id ORDER BY score DESC, seq) AS INTEGER) AS rank FROM dealer_prices QUALIFY rank <= 8",
)
add(
    "correction_override_join",
    lambda s, f: identity.overridden(
        d.table(s, f, "part").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_type").alias("found")),
        d.table(s, f, "conversations").filter("role IS NOT NULL").groupBy(F.col("conv_id").cast("string").alias("key")).agg(F.max_by("role", F.struct("turn", "role")).alias("corrected")),
    ),
    "WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS key, arg_max(role, (turn, role)) AS corrected FROM conversations WHERE role IS NOT NULL GROUP BY 1) "
    "SELECT CAST(p_partkey AS VARCHAR) AS key, coalesce(corrected, p_type) AS found, corrected IS NOT NULL AS by_hand FROM part LEFT JOIN c ON key = CAST(p_partkey AS VARCHAR)",
)
add(
    "best_query_evidence",
    lambda s, f: d.observations(s, f).groupBy("item_id", "source_item_id").agg(F.countDistinct("dealer").alias("dealers"), F.count("weight_g").alias("hits")).groupBy("item_id").agg(F.max_by("source_item_id", F.struct("dealers", "hits", "source_item_id")).alias("query")),
    f"WITH {d.OBSERVATIONS_SQL}, q AS (SELECT item_id, source_item_id, count(DISTINCT dealer) AS dealers, count(weight_g) AS hits FROM observations GROUP BY ALL) SELECT item_id, arg_max(source_item_id, (dealers, hits, source_item_id)) AS query FROM q GROUP BY ALL",
)
add(
    "merge_field_evidence",
    lambda s, f: r4(d.observations(s, f).groupBy("item_id", "dealer").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in ("weight_g", "fineness_per_mille")]).withColumn("fine_metal_g", F.col("weight_g") * F.col("fineness_per_mille") / 1000)),
    f"WITH {d.OBSERVATIONS_SQL}, e AS (SELECT item_id, dealer, arg_max(weight_g, seq) AS w, arg_max(fineness_per_mille, seq) AS fi FROM observations GROUP BY ALL) "
    "SELECT item_id, dealer, round(w + 1e-7, 4) AS weight_g, round(fi + 1e-7, 4) AS fineness_per_mille, round(w * fi / 1000 + 1e-7, 4) AS fine_metal_g FROM e",
)
_consensus = lambda s, f: specs.numeric_consensus(d.observations(s, f), "item_id", "dealer", "weight_g", 0.08, 0.004).filter("support >= 2")
add(
    "spec_source_fallback",
    lambda s, f: r4(d.specs(s, f).join(_consensus(s, f).select(F.col("item_id").alias("id"), "value"), "id", "left").select("id", F.coalesce("value", "weight_g").alias("weight_g"), F.when(F.col("value").isNotNull(), "dealers").when(F.col("weight_g").isNotNull(), "specs").alias("provider"))),
    f"""WITH {d.OBSERVATIONS_SQL}, {d.SPECS_SQL}, {FIRSTS.format('weight_g')}, a AS (SELECT x.item_id, x.value AS anchor, x.seq, count(*) AS support FROM firsts x JOIN firsts y ON x.item_id = y.item_id AND abs(y.value - x.value) <= greatest(0.08, abs(x.value) * 0.004) GROUP BY ALL),
    b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY support DESC, seq) = 1),
    c AS (SELECT b.item_id, median(value) AS v FROM b JOIN firsts USING (item_id) WHERE support >= 2 AND abs(value - anchor) <= greatest(0.08, abs(anchor) * 0.004) GROUP BY b.item_id)
    SELECT id, round(coalesce(v, weight_g) + 1e-7, 4) AS weight_g, CASE WHEN v IS NOT NULL THEN 'dealers' WHEN weight_g IS NOT NULL THEN 'specs' END AS provider FROM specs LEFT JOIN c ON item_id = id""",
)
add(
    "enqueue_selection",
    lambda s, f: specs.incomplete(d.specs(s, f)).select("id").join(queue(s, f).select(F.col("item_id").alias("id"), "status"), "id", "left").select("id", F.when(F.col("id") % 50 == 0, "TEST_IDENTITY").when(F.col("status").isNotNull(), "ALREADY_QUEUED").otherwise("SELECTED").alias("outcome")),
    f"WITH {AUDIT}, {QUEUE} SELECT id, CASE WHEN id % 50 = 0 THEN 'TEST_IDENTITY' WHEN status IS NOT NULL THEN 'ALREADY_QUEUED' ELSE 'SELECTED' END AS outcome FROM audit LEFT JOIN queue ON item_id = id WHERE NOT conflict AND NOT bad_year AND anchor IS NOT NULL AND len(missing) > 0",
)
add(
    "fill_missing_specs",
    lambda s, f: r4(d.specs(s, f).join(d.observations(s, f).groupBy(F.col("item_id").alias("id")).agg(F.min("weight_g").alias("seen_w"), F.min("diameter_mm").alias("seen_d")), "id", "left").select("id", F.coalesce("weight_g", "seen_w").alias("weight_g"), F.coalesce("diameter_mm", "seen_d").alias("diameter_mm"))),
    f"WITH {d.OBSERVATIONS_SQL}, {d.SPECS_SQL}, o AS (SELECT item_id, min(weight_g) AS w, min(diameter_mm) AS dm FROM observations GROUP BY ALL) SELECT id, round(coalesce(weight_g, w) + 1e-7, 4) AS weight_g, round(coalesce(diameter_mm, dm) + 1e-7, 4) AS diameter_mm FROM specs LEFT JOIN o ON item_id = id",
)

#: A small alias table: kind, alias, country, currency, first and last year, special value (fixed values).
ALIASES = [
    ("country", "usa", "US", None, None, None, None), ("country", "united states", "US", None, None, None, None), ("country", "germany", "DE", None, None, None, None),
    ("country", "switzerland", "CH", None, None, None, None), ("country", "swiss", "CH", None, None, None, None), ("country", "liechtenstein", "LI", None, None, None, None),
    ("currency", "dollar", "US", "USD", 1793, None, None), ("subunit", "cents", "US", "USD", 1793, None, None), ("special", "quarter", "US", "USD", 1793, None, 0.25),
    ("currency", "mark", "DE", "DEM", 1948, 2001, None), ("currency", "euro", "DE", "EUR", 2002, None, None), ("subunit", "cents", "DE", "EUR", 2002, None, None),
    ("currency", "franc", "CH", "CHF", 1850, None, None), ("currency", "swiss franc", "CH", "CHF", 1850, None, None), ("currency", "franc", "LI", "CHF", 1924, None, None),
]
#: Texts and what they resolve to: status, country, currency, value, year, confidence (by hand; fixed values).
RESOLVED = [
    ("5 mark Germany 1970", "resolved", "DE", "DEM", 5, 1970, 1),
    ("5 mark Germany 1900", "review", "DE", "DEM", 5, 1900, 0.73),
    ("quarter dollar 1964 USA", "resolved", "US", "USD", 0.25, 1964, 1),
    ("5 franc", "review", "CH", "CHF", 5, None, 0.85),
    ("10 swiss franc Liechtenstein 1930", "resolved", "LI", "CHF", 10, 1930, 1),
    ("25 cents USA 1964", "resolved", "US", "USD", 0.25, 1964, 1),
    ("Germany 1970", "review", "DE", "DEM", None, 1970, 0.8),
    ("nothing here", "unresolved", None, None, None, None, 0),
    ("5 mark Germany 1970 replica", "review", "DE", "DEM", 5, 1970, 1),
    ("5 mark Germny 1970", "resolved", "DE", "DEM", 5, 1970, 1),
    ("KM# 5 2 euro Germany 2005", "resolved", "DE", "EUR", 2, 2005, 1),
]


def _resolved(s, f):
    kinds = "kind string, alias string, country_code string, currency_code string, valid_from int, valid_to int, special_value double"
    texts = d.table(s, f, "part").select(K, pick([r[0] for r in RESOLVED]).alias("text"))
    return resolver.resolve_identity(texts, s.createDataFrame(ALIASES, kinds), K, "text")


_SHOWN = (("status", "VARCHAR"), ("country", "VARCHAR"), ("currency", "VARCHAR"), ("value", "DOUBLE"), ("year", "INTEGER"), ("confidence", "DOUBLE"))
add("resolve_identity", lambda s, f: r4(_resolved(s, f)), f"SELECT {K}, " + ", ".join(f"{sql_pick([r[i + 1] for r in RESOLVED], kind)} AS {n}" for i, (n, kind) in enumerate(_SHOWN)) + " FROM part")
