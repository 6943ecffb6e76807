"""Identities of free texts: country, currency and denomination candidates from an alias table, scored and chosen."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hammerline.functions import catalogue as c
from hammerline.functions import text as t
from hammerline.operators import identity
from hammerline.streaming.streams import shared_dir

#: Currencies whose cents are a hundredth of the denomination (fixed values).
CENT_CURRENCIES = ["EUR", "USD"]


def _facts(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, norm, year, value, cents, negative) of each text; references of catalogues are no numbers."""
    raw = F.coalesce(text_col, F.lit(""))
    bare = t.norm(c.without_references(raw))
    return texts.select(
        F.col(id_col).alias("key"), t.norm(t.transliterate_greek(raw)).alias("norm"), t.parse_year(bare).alias("year"), c.face_value(bare).alias("value"),
        t.norm(raw).rlike(r"(?<![a-z])cents?(?![a-z])").alias("cents"), t.is_negative(raw).alias("negative"),
    )


def _hits(facts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, alias, the alias table's columns, strength): exact aliases; where a text has none of a country (or none
    of a currency), aliases that resemble one of its runs of up to three words, weaker by their ratio."""
    exact = identity.exact_alias(facts, aliases, "key", "norm").withColumn("strength", F.when(F.col("kind") == "subunit", 0.92).otherwise(1.0))
    found = exact
    for kinds, least, weight in ((["country"], 0.84, 0.86), (["currency", "special"], 0.80, 0.88)):
        known = exact.filter(F.col("kind").isin(*kinds, *(["subunit"] if "currency" in kinds else []))).select("key").distinct()
        words = identity.word_runs(facts.join(known, "key", "left_anti"), "key", "norm", "word")
        some = aliases.filter(F.col("kind").isin(kinds))
        near = identity.similar_alias(words, some.select("alias", F.lit("").alias("target")).distinct(), "word", least).select("word", "alias", "ratio")
        close = words.join(near, "word").join(some, "alias").withColumn("strength", F.col("ratio") * weight)
        found = found.unionByName(close.select(*exact.columns))
    return found


def _year_fit(inside: float, outside: float) -> Column:
    """Points for a year within or outside the currency's years; none without a year."""
    early, late = F.coalesce(F.col("year") < F.col("valid_from"), F.lit(False)), F.coalesce(F.col("year") > F.col("valid_to"), F.lit(False))
    return F.when(F.col("year").isNull(), 0.0).when(early | late, -outside).otherwise(inside)


def resolve_identity(texts: DataFrame, aliases: DataFrame, id_col: str, text_col: str, accept: float = 0.88, reject: float = 0.55, gap: float = 0.08) -> DataFrame:
    """A row a text: id_col, status, country, currency, value, year, confidence of its best candidate.

    aliases: kind (country, currency, subunit, special), alias (normal form), country_code, currency_code,
    valid_from, valid_to, special_value; a dimension table. A country named in full leaves only its own
    currencies (the longest name wins); an unnamed one is inferred from a currency that only it has; a
    country alone offers the currencies of the year. A candidate without a denomination yields to one of
    the same currency with one. resolved needs the accepted confidence, a gap to the second candidate and
    no word of other products; below the rejected confidence a text is unresolved; the rest is for review.

    Each distinct text is resolved once. What is known of texts, the aliases they hold and their candidates are written
    to the shared folder: a single plan of all steps, which reads these many times, is much for a small driver.
    """
    spark = texts.sparkSession
    folder = f"{shared_dir(spark)}/identities-{uuid.uuid4().hex}"

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    given = texts.select(F.col(id_col).alias("id_"), F.coalesce(text_col, F.lit("")).alias("text_"))
    facts = written(_facts(given.select("text_").distinct(), "text_", "text_"), "facts")
    hits = written(_hits(facts, aliases), "hits")
    named = hits.filter("kind = 'country'").groupBy("key", "country_code").agg(F.max("strength").alias("named"), F.max(F.length("alias")).alias("long"))
    full = F.col("named") >= 0.95
    longest = F.max(F.when(full, F.col("long"))).over(Window.partitionBy("key"))
    named = named.withColumn("longest", longest).withColumn("explicit", full & (F.col("long") == F.col("longest")))
    stated = named.groupBy("key").agg(F.bool_or("explicit").alias("any_explicit"))
    money = aliases.filter("currency_code IS NOT NULL").select("country_code", "currency_code", "valid_from", "valid_to").distinct()
    holders = money.groupBy("currency_code").agg(F.countDistinct("country_code").alias("holders"))
    found = hits.filter("kind <> 'country'").withColumn("special", F.col("kind") == "special")
    found = found.groupBy("key", "country_code", "currency_code", "valid_from", "valid_to", "special", "special_value").agg(F.max("strength").alias("strength"))
    found = found.join(named.select("key", "country_code", "named", "explicit"), ["key", "country_code"], "left").join(stated, "key", "left").join(holders, "currency_code")
    found = found.filter(~F.coalesce("any_explicit", F.lit(False)) | F.coalesce("explicit", F.lit(False))).join(facts, "key")
    value = F.when(F.col("cents") & F.col("currency_code").isin(CENT_CURRENCIES), F.col("value") / 100).otherwise(F.col("value"))
    by_name = 0.62 + 0.2 * F.col("strength") + F.when(F.col("named").isNotNull(), 0.16).otherwise(0.0) + _year_fit(0.06, 0.22)
    place = F.when(F.col("named").isNotNull(), 0.16 * F.col("named")).when(F.col("holders") == 1, 0.08).otherwise(0.0)
    by_money = 0.52 + 0.28 * F.col("strength") + place + _year_fit(0.07, 0.28) + F.when(F.col("value").isNotNull(), 0.05).otherwise(0.0)
    scored = found.select("key", "country_code", "currency_code", F.when(F.col("special"), F.col("special_value")).otherwise(value).alias("value"), F.when(F.col("special"), by_name).otherwise(by_money).alias("raw"))
    alone = named.join(hits.filter("kind <> 'country'").select("key").distinct(), "key", "left_anti").join(money, "country_code").join(facts, "key").filter(_year_fit(0.0, 1.0) >= 0)
    by_place = 0.48 + 0.22 * F.col("named") + F.when(F.col("year").isNotNull(), 0.1).otherwise(0.0) + F.when(F.col("value").isNotNull(), 0.04).otherwise(0.0)
    scored = written(scored.union(alone.select("key", "country_code", "currency_code", "value", by_place)), "scored")
    core = ["key", "country_code", "currency_code"]
    best = scored.groupBy(*core, "value").agg(F.bround(F.greatest(F.lit(0.0), F.least(F.max("raw"), F.lit(1.0))), 4).alias("confidence"))
    best = best.withColumn("n", F.count("value").over(Window.partitionBy(*core))).filter("value IS NOT NULL OR n = 0")
    order = Window.partitionBy("key").orderBy(F.desc("confidence"), "country_code", "currency_code", "value")
    best = best.withColumn("rn", F.row_number().over(order)).withColumn("next", F.lead("confidence").over(order)).filter("rn = 1")
    rows = given.join(facts.select("key", "year", "negative").join(best, "key", "left"), F.col("text_") == F.col("key"))
    sure = F.coalesce("confidence", F.lit(0.0))
    close = F.coalesce(F.col("confidence") - F.col("next") < gap, F.lit(False))
    status = F.when(F.col("negative") & F.col("confidence").isNotNull(), "review").when(sure < reject, "unresolved").when(close | (sure < accept), "review").otherwise("resolved")
    return rows.select(F.col("id_").alias(id_col), status.alias("status"), F.col("country_code").alias("country"), F.col("currency_code").alias("currency"), "value", "year", sure.alias("confidence"))
