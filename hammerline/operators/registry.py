"""Registries, seeds and catalogue candidates: lookups, checks, choices and upkeep of their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hammerline.operators import specs


def units(value: Column) -> Column:
    """Millionths of a denomination as a whole number, so that equal values join."""
    return F.round(value * 1000000).cast("long")


def one_a_key(rows: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """The first row of each key in the order of a unique column."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("b")).select(*keys, "b.*")


def official_specs(targets: DataFrame, registry: DataFrame) -> DataFrame:
    """targets (id, country, year, value, variant) with official_id, official_weight and official_diameter of the
    registry's entry of the same country, year and denomination. Where both name a variant, the entry's
    token must be in the target's. The first entry of a key counts, so no target repeats."""
    entries = registry.withColumn("unit", units(F.col("value"))).select("country", "year", "unit", "token", F.col("id").alias("official_id"), F.col("weight_g").alias("official_weight"), F.col("diameter_mm").alias("official_diameter"))
    entries = one_a_key(entries.filter("year IS NOT NULL"), ["country", "year", "unit"], "official_id")
    rows = targets.withColumn("unit", units(F.col("value"))).join(entries, ["country", "year", "unit"], "left")
    fits = F.col("token").isNull() | F.col("variant").isNull() | F.contains("variant", "token")
    return rows.select(*targets.columns, *[F.when(fits, F.col(c)).alias(c) for c in ("official_id", "official_weight", "official_diameter")])


def validated_issues(candidates: DataFrame, seed: DataFrame, most: int = 5) -> DataFrame:
    """For each different candidate (country, year, value): status and matches, the least ids of up to `most` seeds.
    A denomination that either side lacks fits all. Seeds are cut to `most` a key before the join, which
    loses no match that is shown."""
    least = Window.partitionBy("country", "year", "value").orderBy("id")
    kept = seed.withColumn("rn", F.row_number().over(least)).filter(F.col("rn") <= most).drop("rn")
    keys = candidates.select("country", "year", "value").distinct()
    fits = (F.col("k.country") == F.col("s.country")) & (F.col("k.year") == F.col("s.year"))
    same = F.col("k.value").isNull() | F.col("s.value").isNull() | (F.abs(F.col("k.value") - F.col("s.value")) < 1e-9)
    found = keys.alias("k").join(kept.alias("s"), fits & same, "left").groupBy("k.country", "k.year", "k.value")
    found = found.agg(F.slice(F.array_sort(F.collect_list("s.id")), 1, most).alias("matches"))
    return found.withColumn("status", F.when(F.size("matches") > 0, "confirmed_seed").otherwise("not_in_local_issue_db"))


def first_in_file(targets: DataFrame, entries: DataFrame) -> DataFrame:
    """targets (id, country, value) with weight_g of the first entry (by pos) of their country and value."""
    first = entries.groupBy("country", units(F.col("value")).alias("unit")).agg(F.min_by("weight_g", "pos").alias("weight_g"), F.min("pos").alias("pos"))
    return targets.withColumn("unit", units(F.col("value"))).join(first, ["country", "unit"], "left").select("id", "pos", "weight_g")


def judged_candidates(pairs: DataFrame) -> DataFrame:
    """pairs of a target (country, year, value, variant) and a catalogue record (c_asset, c_country, c_value, c_from,
    c_to, c_issue, c_variant) with reasons against it and a score from 0 to 1."""
    c = F.col
    out = F.coalesce(c("year") < c("c_from"), F.lit(False)) | F.coalesce(c("year") > c("c_to"), F.lit(False))
    value, issue = F.abs(c("value") - c("c_value")) < 1e-9, c("c_issue") == c("year")
    variant = F.coalesce(F.contains("c_variant", "variant"), F.lit(False))
    reasons = F.array(
        F.when(c("c_asset") == "BANKNOTE", "WRONG_ASSET"), F.when(c("country") != c("c_country"), "WRONG_ISSUER"), F.when(~value, "WRONG_DENOMINATION"),
        F.when(out, "WRONG_YEAR"), F.when(~issue, "NO_ISSUE_FOR_YEAR"), F.when(c("variant").isNotNull() & ~variant, "WRONG_VARIANT"),
    )
    year = F.when(issue, 0.25).when(c("year").isNotNull() & c("c_issue").isNull() & ~out, 0.15).otherwise(0.0)
    score = F.when(c("country") == c("c_country"), 0.25).otherwise(0.0) + F.when(value, 0.3).otherwise(0.0) + year + F.when(variant, 0.2).otherwise(0.0)
    return pairs.withColumn("reasons", F.array_distinct(F.array_compact(reasons))).withColumn("score", F.bround(F.least(score, F.lit(1.0)), 2))


def resolved(judged: DataFrame) -> DataFrame:
    """A row a target: outcome none, ambiguous (several remain and no variant was asked for), EXACT or STRONG, with
    the best candidate; what is known of the issue overrides what is known of the type."""
    ok = F.size("reasons") == 0
    best = F.max_by(F.struct("cand_id", F.coalesce("c_issue_weight", "c_weight").alias("weight_g"), "score"), F.when(ok, F.struct("score", -F.col("cand_id"))))
    rows = judged.groupBy("target_id").agg(F.count_if(ok).alias("n"), F.max("variant").alias("variant"), best.alias("b"))
    outcome = F.when(F.col("n") == 0, "none").when((F.col("n") > 1) & F.col("variant").isNull(), "ambiguous").when(F.col("b.score") >= 0.75, "EXACT").otherwise("STRONG")
    rows = rows.withColumn("outcome", outcome)
    sure = F.col("outcome").isin("EXACT", "STRONG")
    return rows.select("target_id", "outcome", F.when(sure, F.col("b.cand_id")).alias("cand_id"), F.when(sure, F.col("b.weight_g")).alias("weight_g"))


def deduped_candidates(rows: DataFrame) -> DataFrame:
    """The most confident row of each (country, currency, value, year), then without those that lack a value
    where others of the same country, currency and year have one. Ties go to the least id."""
    core = ["country", "currency", "year"]
    best = rows.groupBy(*core, "value").agg(F.max_by(F.struct("id", "confidence"), F.struct("confidence", -F.col("id"))).alias("b"))
    stated = F.count("value").over(Window.partitionBy(*core))
    return best.withColumn("stated", stated).filter("value IS NOT NULL OR stated = 0").select(*core, "value", "b.id", "b.confidence")


def spec_consensus(observations: DataFrame) -> DataFrame:
    """item_id and the fields that two dealers or more agree on; the fineness of a precious metal is held back
    without a weight. composition and fine_metal_g follow; n_* count the dealers behind a field."""
    found = None
    for field, n in (("primary_metal", "n_metal"), ("fineness_per_mille", "n_fineness"), ("weight_g", "n_weight"), ("diameter_mm", "n_diameter")):
        tolerance = {"weight_g": (0.08, 0.004), "diameter_mm": (0.18, 0.003)}.get(field)
        agreed = specs.numeric_consensus(observations, "item_id", "dealer", field, *tolerance) if tolerance else specs.exact_consensus(observations, "item_id", "dealer", field)
        part = agreed.select("item_id", F.when(F.col("support") >= 2, F.col("value")).alias(field), F.col("support").alias(n))
        found = part if found is None else found.join(part, "item_id", "full")
    precious = F.lower(F.coalesce("primary_metal", F.lit(""))).isin("silver", "gold", "platinum", "palladium")
    found = found.withColumn("fineness_per_mille", F.when(~(precious & F.col("weight_g").isNull()), F.col("fineness_per_mille")))
    text = F.when(F.col("fineness_per_mille").isNotNull(), F.format_string("%s (.%03d)", "primary_metal", F.col("fineness_per_mille").cast("int"))).otherwise(F.col("primary_metal"))
    fields = [F.bround("weight_g", 4).alias("weight_g"), F.bround("diameter_mm", 3).alias("diameter_mm"), F.when(F.col("primary_metal").isNotNull(), text).alias("composition")]
    counts = [F.coalesce(n, F.lit(0)).alias(n) for n in ("n_metal", "n_fineness", "n_weight", "n_diameter")]
    return found.select("item_id", "primary_metal", "fineness_per_mille", *fields, (F.col("weight_g") * F.col("fineness_per_mille") / 1000).alias("fine_metal_g"), *counts)


def maintained(rows: DataFrame, deleted: DataFrame, required: list[str], key: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(live, rejects): rows with all required columns, without deleted ids, the latest of each key; the others
    with an error that names what they lack."""
    lacks = F.array_compact(F.array(*[F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", c) for c in required]))
    checked = rows.withColumn("error", F.array_join(lacks, ","))
    kept = checked.filter("error = ''").drop("error").join(deleted.select("id").distinct(), "id", "left_anti")
    live = kept.groupBy(key).agg(F.max_by(F.struct(*[c for c in kept.columns if c != key]), F.struct(*order)).alias("b")).select(key, "b.*")
    return live, checked.filter("error <> ''")


def with_weight(offers: DataFrame, known: DataFrame) -> DataFrame:
    """offers (item_id, asked) with weight and where it comes from: the request, else a verified specification."""
    spec = known.filter("verified").select(F.col("id").alias("item_id"), F.col("weight_g").alias("spec"))
    rows = offers.join(spec, "item_id", "left")
    return rows.withColumn("weight", F.coalesce("asked", "spec")).withColumn("weight_source", F.when(F.col("asked").isNotNull(), "request").when(F.col("spec").isNotNull(), "spec")).drop("spec")


def spot_prices(quotes: DataFrame) -> DataFrame:
    """(metal, price, source): the last positive quote of the primary source, else of the second."""
    rows = quotes.filter("price > 0").groupBy("metal")
    last = lambda n: F.max_by("price", F.when(F.col("source") == n, F.struct("ts", "id")))
    rows = rows.agg(last("primary").alias("a"), last("second").alias("b"), F.count_if(F.col("source") == "primary").alias("n"))
    first = F.col("n") > 0
    return rows.select("metal", F.when(first, F.col("a")).otherwise(F.col("b")).alias("price"), F.when(first, "primary").otherwise("second").alias("source"))
