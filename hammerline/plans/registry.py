"""Queries over registries, seeds, catalogue candidates and keyed upkeep, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from hammerline.operators import identity, listings, registry as op, specs
from hammerline.plans.catalogue import K, pick, sql_pick
from hammerline.plans.listings import LISTINGS, listings as listed
from hammerline.plans.market import r4
from hammerline.plans.trade import AUDIT, FIRSTS, QUEUE, queue
from hammerline.sources import derived as d

QUERIES, ORACLES = {}, {}


def add(name, build, sql=None):
    QUERIES[name] = build
    if sql:
        ORACLES[name] = sql


def _targets(s, f):
    rows = d.specs(s, f)
    return rows.select("id", "country", F.col("issue_year").alias("year"), F.col("denomination_value").alias("value"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("issue in "), F.lower("primary_metal"))).alias("variant"))


def _entries(s, f):
    rows = d.specs(s, f).filter("verified")
    return rows.select("id", "country", F.col("issue_year").alias("year"), F.col("denomination_value").alias("value"), F.lower("primary_metal").alias("token"), "weight_g", "diameter_mm")


OFFICIAL = f"""{d.SPECS_SQL}, reg AS (SELECT * FROM specs WHERE verified AND issue_year IS NOT NULL QUALIFY row_number() OVER (PARTITION BY country, issue_year, denomination_value ORDER BY id) = 1),
official AS (SELECT s.*, r.id AS official_id, r.weight_g AS ow, r.diameter_mm AS od FROM specs s LEFT JOIN reg r ON s.country = r.country AND s.issue_year = r.issue_year AND s.denomination_value = r.denomination_value
  AND (r.primary_metal IS NULL OR s.id % 3 <> 0 OR s.primary_metal IS NULL OR contains('issue in ' || lower(s.primary_metal), lower(r.primary_metal))))"""
add("official_spec_join", lambda s, f: r4(op.official_specs(_targets(s, f), _entries(s, f)).select("id", "official_id", "official_weight", "official_diameter")),
    f"WITH {OFFICIAL} SELECT id, official_id, ow AS official_weight, od AS official_diameter FROM official")
add(
    "official_reseed",
    lambda s, f: r4(op.official_specs(_targets(s, f), _entries(s, f)).join(d.specs(s, f).select("id", "weight_g", "diameter_mm", "verified"), "id").select("id", F.coalesce("official_weight", "weight_g").alias("weight_g"), F.coalesce("official_diameter", "diameter_mm").alias("diameter_mm"), (F.col("verified") | F.col("official_id").isNotNull()).alias("verified"))),
    f"WITH {OFFICIAL} SELECT id, coalesce(ow, weight_g) AS weight_g, coalesce(od, diameter_mm) AS diameter_mm, verified OR official_id IS NOT NULL AS verified FROM official",
)
add(
    "issue_validation_join",
    lambda s, f: op.validated_issues(
        _targets(s, f).filter("year IS NOT NULL").withColumn("value", F.when(F.col("id") % 4 != 0, F.col("value"))),
        _entries(s, f).filter("year IS NOT NULL").select("id", "country", "year", F.when(F.col("id") % 14 != 0, F.col("value")).alias("value")),
    ).select("country", "year", "value", "status", F.array_join("matches", ",").alias("matches")),
    f"""WITH {d.SPECS_SQL}, c AS (SELECT DISTINCT country, issue_year AS year, CASE WHEN id % 4 <> 0 THEN denomination_value END AS value FROM specs WHERE issue_year IS NOT NULL),
    i AS (SELECT id, country, issue_year AS year, CASE WHEN id % 14 <> 0 THEN denomination_value END AS value FROM specs WHERE verified AND issue_year IS NOT NULL),
    j AS (SELECT c.country, c.year, c.value, i.id FROM c LEFT JOIN i ON c.country = i.country AND c.year = i.year AND (c.value IS NULL OR i.value IS NULL OR c.value = i.value))
    SELECT country, year, value, CASE WHEN count(id) > 0 THEN 'confirmed_seed' ELSE 'not_in_local_issue_db' END AS status, coalesce(array_to_string(list_slice(list(id ORDER BY id) FILTER (id IS NOT NULL), 1, 5), ','), '') AS matches FROM j GROUP BY ALL""",
)
#: Mints by country and the names a text may give them (fixed values).
MINTS = [("US", "d", "Denver"), ("US", "philadelphia", "Philadelphia"), ("DE", "d", "Munich"), ("DE", "karlsruhe", "Karlsruhe")]


def _mints(s, f):
    texts = d.table(s, f, "part").select(F.struct(K, pick(["US", "DE", None]).alias("country")).alias("key"), F.concat("p_name", pick([" d", " philadelphia 1964", " karlsruhe", ""])).alias("text"))
    found = identity.exact_alias(texts, s.createDataFrame(MINTS, "country string, alias string, mint string"), "key", "text").filter("key.country = country")
    score = F.when(F.length("alias") == 1, 0.92).otherwise(1.0)
    return found.groupBy(f"key.{K}").agg(F.max_by(F.struct("mint", score.alias("score")), F.struct(score, "alias")).alias("b")).select(K, "b.*")


add("mint_join", _mints, f"SELECT {K}, {sql_pick(['Denver', 'Philadelphia', None, None] * 1)} AS mint, CASE WHEN {K} % 4 = 0 THEN 0.92 ELSE 1.0 END::DOUBLE AS score FROM part WHERE {K} % 3 = 0 AND {K} % 4 IN (0, 1) "
    f"UNION ALL SELECT {K}, CASE WHEN {K} % 4 = 0 THEN 'Munich' ELSE 'Karlsruhe' END, CASE WHEN {K} % 4 = 0 THEN 0.92 ELSE 1.0 END::DOUBLE FROM part WHERE {K} % 3 = 1 AND {K} % 4 IN (0, 2)")  # fmt: skip
add(
    "spec_lookup_json",
    lambda s, f: r4(op.first_in_file(d.specs(s, f).select("id", "country", F.col("denomination_value").alias("value")), d.specs(s, f).filter("id % 11 > 3").select("country", F.col("denomination_value").alias("value"), "weight_g", F.col("id").alias("pos")))),
    f"WITH {d.SPECS_SQL}, e AS (SELECT * FROM specs WHERE id % 11 > 3 QUALIFY row_number() OVER (PARTITION BY country, denomination_value ORDER BY id) = 1) SELECT s.id, e.id AS pos, e.weight_g FROM specs s LEFT JOIN e ON s.country = e.country AND s.denomination_value = e.denomination_value",
)


def _pairs(s, f):
    """Each target meets three records of the catalogue: its own, the next, and one of the same form."""
    t = _targets(s, f).select(F.col("id").alias("target_id"), "country", "year", "value", "variant", F.explode(F.array(F.col("id"), F.col("id") + 1, F.col("id") + 280)).alias("cand_id"))
    t = t.withColumn("variant", F.regexp_replace("variant", "^issue in ", ""))
    n = F.col("id")
    c = d.specs(s, f).select(
        n.alias("cand_id"), F.when(n % 10 == 9, "BANKNOTE").otherwise("COIN").alias("c_asset"), F.col("country").alias("c_country"), F.col("denomination_value").alias("c_value"), F.col("year_from").alias("c_from"),
        (F.col("year_to") + 20).alias("c_to"), F.when(n % 4 != 1, F.col("issue_year")).alias("c_issue"), F.lower("primary_metal").alias("c_variant"), F.col("weight_g").alias("c_weight"), F.when(n % 3 == 0, F.col("weight_g") + 0.5).alias("c_issue_weight"),
    )
    return op.judged_candidates(t.join(c, "cand_id"))


JUDGED = f"""{d.SPECS_SQL}, p AS (SELECT t.id AS target_id, c.id AS cand_id, t.country, c.country AS c_country, t.issue_year AS year, t.denomination_value AS value, c.denomination_value AS c_value,
  CASE WHEN t.id % 3 = 0 THEN lower(t.primary_metal) END AS variant, lower(c.primary_metal) AS c_variant, c.year_from AS c_from, c.year_to + 20 AS c_to, CASE WHEN c.id % 4 <> 1 THEN c.issue_year END AS c_issue,
  CASE WHEN c.id % 3 = 0 THEN c.weight_g + 0.5 ELSE c.weight_g END AS w FROM specs t JOIN specs c ON c.id IN (t.id, t.id + 1, t.id + 280)),
q AS (SELECT *, coalesce(year < c_from, false) OR coalesce(year > c_to, false) AS outside, coalesce(contains(c_variant, variant), false) AS same FROM p),
judged AS (SELECT *, concat_ws(',', CASE WHEN cand_id % 10 = 9 THEN 'WRONG_ASSET' END, CASE WHEN country <> c_country THEN 'WRONG_ISSUER' END, CASE WHEN value <> c_value THEN 'WRONG_DENOMINATION' END, CASE WHEN outside THEN 'WRONG_YEAR' END,
    CASE WHEN c_issue <> year THEN 'NO_ISSUE_FOR_YEAR' END, CASE WHEN variant IS NOT NULL AND NOT same THEN 'WRONG_VARIANT' END) AS reasons,
  (CASE WHEN country = c_country THEN 25 ELSE 0 END + CASE WHEN value = c_value THEN 30 ELSE 0 END + CASE WHEN c_issue = year THEN 25 WHEN year IS NOT NULL AND c_issue IS NULL AND NOT outside THEN 15 ELSE 0 END + CASE WHEN same THEN 20 ELSE 0 END) / 100.0::DOUBLE AS score FROM q)"""
add("catalogue_candidate_validation", lambda s, f: r4(_pairs(s, f).select("target_id", "cand_id", F.array_join("reasons", ",").alias("reasons"), "score")), f"WITH {JUDGED} SELECT target_id, cand_id, reasons, score FROM judged")
add(
    "candidate_resolution",
    lambda s, f: r4(op.resolved(_pairs(s, f))),
    f"""WITH {JUDGED}, g AS (SELECT target_id, count(*) FILTER (reasons = '') AS n, max(variant) AS variant, arg_max({{'c': cand_id, 'w': w, 's': score}}, (score, -cand_id)) FILTER (reasons = '') AS b FROM judged GROUP BY ALL),
    o AS (SELECT *, CASE WHEN n = 0 THEN 'none' WHEN n > 1 AND variant IS NULL THEN 'ambiguous' WHEN b.s >= 0.75 THEN 'EXACT' ELSE 'STRONG' END AS outcome FROM g)
    SELECT target_id, outcome, CASE WHEN outcome IN ('EXACT', 'STRONG') THEN b.c END AS cand_id, CASE WHEN outcome IN ('EXACT', 'STRONG') THEN round(b.w + 1e-7, 4) END AS weight_g FROM o""",
)
add(
    "candidate_dedupe",
    lambda s, f: op.deduped_candidates(
        d.comparables(s, f).select(
            (F.col("target_id") * 1000 + F.col("seq")).alias("id"), (F.col("dealer_id") % 7).alias("country"), F.col("currency"), F.year("auction_date").alias("year"),
            F.when(F.col("dealer_id") % 14 > 6, F.when(F.col("seq") % 3 != 0, F.col("seq") % 4)).alias("value"), F.col("identity_match_score").alias("confidence"),
        )
    ),
    f"""WITH {d.COMPARABLES_SQL}, r AS (SELECT target_id * 1000 + seq AS id, dealer_id % 7 AS country, currency, CAST(year(auction_date) AS INTEGER) AS year, CASE WHEN dealer_id % 14 > 6 AND seq % 3 <> 0 THEN seq % 4 END AS value, identity_match_score AS confidence FROM comparables),
    b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY country, currency, year, value ORDER BY confidence DESC, id) = 1)
    SELECT country, currency, year, value, id, confidence FROM b QUALIFY value IS NOT NULL OR count(value) OVER (PARTITION BY country, currency, year) = 0""",
)


def _agreed(field: str, absolute: float | None = None, relative: float = 0.0) -> str:
    """CTEs of a field's consensus among the first values of each dealer: agreed_<field> (item_id, value, support)."""
    firsts = FIRSTS.format(field).replace("firsts", f"first_{field}", 1)
    if absolute is None:
        return f"{firsts}, v_{field} AS (SELECT item_id, value, count(*) AS support, min(seq) AS least FROM first_{field} GROUP BY ALL), agreed_{field} AS (SELECT item_id, value, support FROM v_{field} QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY support DESC, least) = 1)"
    near = f"greatest({absolute}, abs({{}}) * {relative})"
    return f"""{firsts}, a_{field} AS (SELECT x.item_id, x.value AS anchor, x.seq, count(*) AS support FROM first_{field} x JOIN first_{field} y ON x.item_id = y.item_id AND abs(y.value - x.value) <= {near.format('x.value')} GROUP BY ALL),
    b_{field} AS (SELECT * FROM a_{field} QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY support DESC, seq) = 1),
    agreed_{field} AS (SELECT b.item_id, median(value) AS value, any_value(support) AS support FROM b_{field} b JOIN first_{field} USING (item_id) WHERE abs(value - anchor) <= {near.format('anchor')} GROUP BY b.item_id)"""


add(
    "spec_consensus",
    lambda s, f: r4(op.spec_consensus(d.observations(s, f))),
    f"""WITH {d.OBSERVATIONS_SQL}, {_agreed('primary_metal')}, {_agreed('fineness_per_mille')}, {_agreed('weight_g', 0.08, 0.004)}, {_agreed('diameter_mm', 0.18, 0.003)},
    j AS (SELECT item_id, CASE WHEN m.support >= 2 THEN m.value END AS metal, CASE WHEN x.support >= 2 THEN x.value END AS fine0, CASE WHEN w.support >= 2 THEN w.value END AS w, CASE WHEN z.support >= 2 THEN z.value END AS dm,
      coalesce(m.support, 0) AS n_metal, coalesce(x.support, 0) AS n_fineness, coalesce(w.support, 0) AS n_weight, coalesce(z.support, 0) AS n_diameter
      FROM agreed_primary_metal m FULL JOIN agreed_fineness_per_mille x USING (item_id) FULL JOIN agreed_weight_g w USING (item_id) FULL JOIN agreed_diameter_mm z USING (item_id)),
    k AS (SELECT *, CASE WHEN NOT (coalesce(metal, '') IN ('silver', 'gold', 'platinum', 'palladium') AND w IS NULL) THEN fine0 END AS fine FROM j)
    SELECT item_id, metal AS primary_metal, fine AS fineness_per_mille, round(w + 1e-7, 4) AS weight_g, round(dm + 1e-7, 4) AS diameter_mm, CASE WHEN fine IS NOT NULL THEN metal || ' (.' || lpad(CAST(CAST(fine AS INTEGER) AS VARCHAR), 3, '0') || ')' ELSE metal END AS composition,
      round(w * fine / 1000 + 1e-7, 4) AS fine_metal_g, n_metal, n_fineness, n_weight, n_diameter FROM k""",
)
add(
    "enqueue_ranking",
    lambda s, f: d.specs(s, f).orderBy("verified", F.col("primary_metal").isNotNull(), F.col("weight_g").isNotNull(), "country", F.asc_nulls_last("issue_year"), "denomination_value", "id").limit(100).select("id"),
    f"WITH {d.SPECS_SQL} SELECT id FROM specs ORDER BY verified, primary_metal IS NOT NULL, weight_g IS NOT NULL, country, issue_year NULLS LAST, denomination_value, id LIMIT 100",
)
_rank = lambda: F.when(F.col("status") == "RUNNING", 0).when(F.col("status") == "PENDING", 1).when(F.col("status") == "RETRY", 2).when(F.col("status") == "FAILED", 3).otherwise(4)
add("status_rank_order", lambda s, f: queue(s, f).select("item_id", "status", _rank().alias("rank")).orderBy("rank", "item_id"),
    f"WITH {QUEUE} SELECT item_id, status, CASE status WHEN 'RUNNING' THEN 0 WHEN 'PENDING' THEN 1 WHEN 'RETRY' THEN 2 WHEN 'FAILED' THEN 3 ELSE 4 END AS rank FROM queue ORDER BY rank, item_id")
add(
    "missing_columns",
    lambda s, f: d.table(s, f, "events").select("event_id", F.array_join(F.array_except(F.array(*map(F.lit, ("price", "k", "currency"))), F.coalesce(F.json_object_keys(F.when(F.col("event_id") % 5 != 0, F.col("props"))), F.array().cast("array<string>"))), ",").alias("missing")),
    "SELECT event_id, array_to_string(list_filter(['price', 'k', 'currency'], lambda x: NOT list_contains(coalesce(json_keys(CASE WHEN event_id % 5 <> 0 THEN props END), []), x)), ',') AS missing FROM events",
)


def _corrections(s, f):
    t = F.col("turn")
    rows = d.table(s, f, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").cast("string").alias("key"), t.alias("at"), F.when(t % 4 != 1, F.col("role")).alias("corrected"), F.when(t % 5 != 2, F.lit("seen")).otherwise(" ").alias("reason"))
    live, rejects = op.maintained(rows, rows.filter("CAST(key AS LONG) % 10 = 0"), ["key", "corrected", "reason"], "key", ["at"])
    return live.select("id", F.lit("live").alias("state")).union(rejects.select("id", F.concat(F.lit("lacks "), "error")))


add(
    "correction_table_maintenance",
    _corrections,
    """WITH r AS (SELECT conv_id || '-' || turn AS id, conv_id, turn, concat_ws(',', CASE WHEN turn % 4 = 1 OR trim(coalesce(role, '')) = '' THEN 'corrected' END, CASE WHEN turn % 5 = 2 THEN 'reason' END) AS error FROM conversations)
    SELECT id, 'lacks ' || error AS state FROM r WHERE error <> '' UNION ALL (SELECT id, 'live' FROM r WHERE error = '' AND conv_id % 10 <> 0 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)""",
)
add(
    "catalog_upsert",
    lambda s, f: d.table(s, f, "part").filter(f"{K} % 2 = 0").select(K, F.lit(1).alias("made")).join(d.table(s, f, "part").filter(f"{K} % 3 = 0").select(K, F.lit(2).alias("seen")), K, "full").select(K, F.coalesce("made", "seen").alias("created"), F.coalesce("seen", "made").alias("updated")),
    f"SELECT {K}, CASE WHEN {K} % 2 = 0 THEN 1 ELSE 2 END AS created, CASE WHEN {K} % 3 = 0 THEN 2 ELSE 1 END AS updated FROM part WHERE {K} % 2 = 0 OR {K} % 3 = 0",
)
add(
    "offer_weight",
    lambda s, f: r4(op.with_weight(d.dealer_prices(s, f).select(F.col("target_id").alias("item_id"), "seq", F.when(F.col("seq") % 3 == 0, 10.0).alias("asked")), d.specs(s, f)).select("item_id", "seq", "weight", "weight_source")),
    f"WITH {d.DEALER_PRICES_SQL}, {d.SPECS_SQL} SELECT target_id AS item_id, seq, CASE WHEN seq % 3 = 0 THEN 10.0 WHEN verified THEN weight_g END::DOUBLE AS weight, CASE WHEN seq % 3 = 0 THEN 'request' WHEN verified AND weight_g IS NOT NULL THEN 'spec' END AS weight_source FROM dealer_prices LEFT JOIN specs ON id = target_id",
)
add(
    "spot_with_fallback",
    lambda s, f: r4(op.spot_prices(d.table(s, f, "events").select(F.concat_ws("-", "event_type", (F.col("user_id") % 50).cast("string")).alias("metal"), F.when(F.col("event_id") % 2 == 0, "primary").otherwise("second").alias("source"), F.when(F.col("event_id") % 3 != 0, F.col("value")).otherwise(-1.0).alias("price"), "ts", F.col("event_id").alias("id")))),
    """WITH q AS (SELECT event_type || '-' || user_id % 50 AS metal, event_id % 2 = 0 AS first, value AS price, ts, event_id FROM events WHERE event_id % 3 <> 0 AND value > 0),
    b AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY metal ORDER BY first DESC, ts DESC, event_id DESC) = 1) SELECT metal, round(price + 1e-7, 4) AS price, CASE WHEN first THEN 'primary' ELSE 'second' END AS source FROM b""",
)
add(
    "to_eur",
    lambda s, f: r4(d.comparables(s, f).select("target_id", "seq", F.bround(F.round(F.col("hammer_price") / F.when(F.col("currency") == "EUR", 1.0).when(F.col("currency") == "USD", 1.25).when(F.col("currency") == "GBP", 0.8), 6), 2).alias("eur"))),
    f"WITH {d.COMPARABLES_SQL}, c AS (SELECT target_id, seq, round(hammer_price / CASE currency WHEN 'EUR' THEN 1.0 WHEN 'USD' THEN 1.25 WHEN 'GBP' THEN 0.8 END::DOUBLE * 100, 4) AS cents FROM comparables) "
    "SELECT target_id, seq, CASE WHEN cents - floor(cents) = 0.5 THEN floor(cents) + floor(cents) % 2 ELSE round(cents) END / 100 AS eur FROM c",
)
add(
    "impossible_year_guard",
    lambda s, f: d.specs(s, f).filter(F.coalesce(specs.anchor_year() < specs.euro_start(), F.lit(False))).select("id", "country", specs.anchor_year().alias("year")),
    f"WITH {AUDIT} SELECT id, country, anchor AS year FROM audit WHERE anchor < start_year",
)
add(
    "spec_candidate_reasons",
    lambda s, f: listings.strict_filter(listed(s, f)).select("target_id", "seq", F.array_join("reasons", ",").alias("reasons")),
    f"""WITH {LISTINGS} SELECT target_id, seq, concat_ws(',', CASE WHEN o % 10 IN (0, 1) THEN 'NOT_COIN' END, CASE WHEN o % 10 = 2 THEN 'NOT_SINGLE_COIN' END, CASE WHEN o % 9 = 0 OR o % 10 = 0 THEN 'DENOMINATION_MISMATCH' END,
    CASE WHEN o % 7 = 0 OR o % 10 = 0 THEN 'YEAR_MISMATCH' END, CASE WHEN o % 11 = 0 OR o % 10 = 0 THEN 'COUNTRY_MISMATCH' END) AS reasons FROM l""",
)
add(
    "comparable_schema_projection",
    lambda s, f: r4(d.comparables(s, f).select(F.from_json(F.to_json(F.struct("target_id", "seq", "hammer_price", F.when(F.col("seq") % 2 == 0, F.col("currency")).alias("currency"), F.lit("x").alias("unknown_field"))), "target_id long, seq long, hammer_price double, currency string, sold boolean").alias("r")).select("r.target_id", "r.seq", "r.hammer_price", F.coalesce("r.currency", F.lit("EUR")).alias("currency"), F.coalesce("r.sold", F.lit(True)).alias("sold"))),
    f"WITH {d.COMPARABLES_SQL} SELECT target_id, seq, round(hammer_price + 1e-7, 4) AS hammer_price, CASE WHEN seq % 2 = 0 THEN currency ELSE 'EUR' END AS currency, true AS sold FROM comparables",
)
add("title_score", lambda s, f: r4(listings.title_score(listed(s, f), identity.similarity).groupBy("target_id").agg(F.count("*").alias("n"), F.max("title_score").alias("best"), F.min("title_score").alias("worst"))))
