"""Identities of texts: exact aliases first, then similar ones; candidates and overrides."""

from __future__ import annotations

import difflib
import functools
import operator
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from hammerline.functions import text as t


@F.pandas_udf(DoubleType())
def similarity(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp ratio of two strings; null if either is."""
    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


#: Letters from rare to frequent, so that strings meet on few of them; any order finds the same pairs.
RARE_FIRST = "zqxjkvbpygfwmucldrhsnioate "
PLACES = "abcdefghijklmnopqrstuvwxyz~"


def word_runs(texts: DataFrame, id_col: str, text_col: str, name: str, longest: int = 3) -> DataFrame:
    """(id_col, name): a text's runs of one to `longest` words in normal form, distinct within the text."""
    words = texts.select(id_col, F.array_remove(F.split(t.norm(F.col(text_col)), " "), "").alias("w"))
    return words.select(id_col, F.explode(F.array_distinct(F.flatten(F.array(*map(_runs, range(1, longest + 1)))))).alias(name))


def exact_alias(texts: DataFrame, aliases: DataFrame, id_col: str, text_col: str, longest: int = 3) -> DataFrame:
    """(id_col, alias, target): aliases that a text holds as whole words, found by an equi-join of the text's
    runs of one to `longest` words, distinct within the text, so that no text meets an alias it doesn't hold."""
    return word_runs(texts, id_col, text_col, "alias", longest).join(aliases, "alias")


def _runs(n: int):
    return F.transform("w", lambda x, i: F.array_join(F.slice("w", i + 1, F.lit(n)), " "))


def _letters(text: Column) -> Column:
    """A string's characters in one common order, each with how many of it stand before: all different."""
    chars = F.array_sort(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(F.translate(text, RARE_FIRST, PLACES), i, F.lit(1))))
    return t.let(chars, lambda s: F.transform(s, lambda c, i: F.concat(c, (i + 1 - F.array_position(s, c)).cast("string"))))


def _met_by(rows: DataFrame, text: str, least: float) -> DataFrame:
    """rows with letters, and a row for each of the first ones (letter), on one of which any two similar strings meet."""
    n = F.length(text)
    fewest = F.ceil(n * (least / (2 - least)) - 1e-9).cast("int")
    return rows.withColumn("letters", _letters(F.col(text))).withColumn("letter", F.explode(F.slice("letters", F.lit(1), n - fewest + 1)))


def similar_pairs(words: DataFrame, aliases: DataFrame, word_col: str, least: float, shortest: int = 5) -> DataFrame:
    """(word_col, alias, target, ratio): all pairs of a distinct string and an alias of `shortest` letters or more whose
    ratio is at least `least`.

    No such pair is missed. A ratio of r takes r/2 of both lengths in common letters, so neither is shorter
    than r/(2-r) of the other and each shares at least that part of its own letters. Put in one common order,
    the letters before the last such part then hold one that both have (prefix filtering): an equi-join.
    Those with enough common letters are compared. aliases is a dimension table; only its greatest length
    comes to the driver, by which strings too long for any alias are left out first."""
    some = aliases.filter(F.length("alias") >= shortest)
    longest = some.agg(F.max(F.length("alias"))).first()[0] or 0
    w = words.select(word_col).filter(F.length(word_col).between(1, int(longest * (2 - least) / least + 1e-9))).distinct()
    w, a = _met_by(w, word_col, least), _met_by(some, "alias", least).withColumnRenamed("letters", "theirs")
    both = (F.length(word_col) + F.length("alias")) * (least / 2) - 1e-9
    met = w.join(a, "letter").filter((F.least(F.length(word_col), F.length("alias")) >= both) & (F.size(F.array_intersect("letters", "theirs")) >= both))
    return met.select(word_col, "alias", "target").distinct().withColumn("ratio", similarity(F.col(word_col), F.col("alias"))).filter(F.col("ratio") >= least)


def similar_alias(words: DataFrame, aliases: DataFrame, word_col: str, least: float = 0.82) -> DataFrame:
    """(word_col, alias, target, ratio): for each distinct string the most similar alias of five letters or more,
    if its ratio is at least `least`; of equally similar ones the last in order."""
    pairs = similar_pairs(words, aliases, word_col, least)
    best = pairs.groupBy(word_col).agg(F.max_by(F.struct("alias", "target", "ratio"), F.struct("ratio", "alias", "target")).alias("b"))
    return best.select(word_col, "b.alias", "b.target", "b.ratio")


def issuers_of(texts: DataFrame, issuers: DataFrame, id_col: str, text_col: str, least: float = 0.72) -> DataFrame:
    """(id_col, issuer, alias, score): the best issuer of each text that has any. An alias as whole words of the text
    scores 1, else its likeness to the whole text, if that is at least `least`; of equal scores the issuer with the least
    place wins, then the longest alias.

    texts may state country_code and year: an issuer of another country, or whose years (valid_from, valid_to; both
    within; open where null) don't hold the year, is none. issuers is a dimension table (issuer, place, alias in normal
    form, country_code, valid_from, valid_to), a row an alias; only its greatest numbers of words and letters come to
    the driver. Texts meet aliases by equal runs of words, and by prefix filtering of letters; no likeness is missed."""
    known = issuers.filter(F.length("alias") > 0)
    words = known.agg(F.max(F.size(F.split("alias", " ")))).first()[0] or 1
    named = texts.select(id_col, t.norm(F.col(text_col)).alias("word"))
    exact = word_runs(texts, id_col, text_col, "alias", words).select(id_col, "alias", F.lit(1.0).alias("score"))
    near = similar_pairs(named, known.select("alias", F.lit("").alias("target")).distinct(), "word", least, 1)
    hits = exact.unionByName(named.join(near, "word").select(id_col, "alias", F.col("ratio").alias("score")))
    stated = texts.select(id_col, *[(F.col(c) if c in texts.columns else F.lit(None).cast(kind)).alias(f"text_{c}") for c, kind in (("country_code", "string"), ("year", "int"))])
    found = hits.join(known, "alias").join(stated, id_col)
    differ = [F.col("text_country_code") != F.col("country_code"), F.col("text_year") < F.col("valid_from"), F.col("text_year") > F.col("valid_to")]
    best = found.filter(~functools.reduce(operator.or_, [F.coalesce(d, F.lit(False)) for d in differ])).groupBy(id_col).agg(F.max_by(F.struct("issuer", "alias", "score"), F.struct("score", -F.col("place"), F.length("alias"), "alias")).alias("b"))
    return best.select(id_col, "b.*")


def candidates(scored: DataFrame, keys: list[str], least_gap: float = 0.08) -> DataFrame:
    """The best candidate of each group of keys with gap (to the second) and ambiguous (gap below least_gap)."""
    order = Window.partitionBy(*keys).orderBy(F.desc("confidence"), "seq")
    rows = scored.withColumn("rn", F.row_number().over(order)).withColumn("second", F.lead("confidence").over(order))
    rows = rows.filter("rn = 1").withColumn("gap", F.col("confidence") - F.col("second"))
    return rows.withColumn("ambiguous", F.coalesce(F.col("gap") < least_gap, F.lit(False))).drop("rn", "second")


def overridden(resolved: DataFrame, corrections: DataFrame) -> DataFrame:
    """resolved (key, found) with a correction of the same key in place of what was found."""
    return resolved.join(corrections, "key", "left").select(*resolved.columns[:-1], F.coalesce("corrected", "found").alias("found"), F.col("corrected").isNotNull().alias("by_hand"))
