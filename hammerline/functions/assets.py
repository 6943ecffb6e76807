"""Whether a text offers a coin or paper money, by the terms that it holds, with a confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hammerline.functions import text as t

#: Terms that settle paper money alone, at once (fixed values).
EVIDENCE = [
    "banknotes", "banknote", "emergency money", "notgeld", "notgeldschein", "notgeldscheine", "paper money", "papiergeld", "geldschein", "geldscheine", "silver certificate",
    "gold certificate", "federal reserve note", "legal tender note", "treasury note", "national currency", "fractional currency", "currency note", "currency notes",
]
#: Terms that settle paper money, surer the more of them there are (fixed values).
STRONG = [
    "banknote", "bank note", "paper money", "silver certificate", "gold certificate", "federal reserve note", "legal tender note", "treasury note", "national currency",
    "fractional currency", "large size note", "small size note", "papiergeld", "banconota", "billete", "notgeld", "notgeldschein", "notgeldscheine", "emergency money",
    "geldschein", "geldscheine", "currency note", "currency notes",
]
#: Further terms of paper money, of which one is not enough, and terms of coins (fixed values).
WEAK = ["billet", "pick p", "watermark", "serial number"]
COINS = ["coin", "münze", "munze", "monnaie", "moneta", "commemorative", "gedenkmünze", "gedenkmunze", "mint", "proof", "unc", "bu"]
#: References to a catalogue of paper money count as three terms of it (fixed values).
PICK, PICK_WEIGHT = r"\bp[- ]?[0-9]{1,5}[a-z]?\b", 3


def _terms(terms: list[str]) -> list[str]:
    """Terms as normal forms write them, each once."""
    return list(dict.fromkeys(x.translate(str.maketrans(t.ACCENTED, t.PLAIN)) for x in terms))


def _held(norm: Column, terms: list[str]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, _terms(terms))), lambda x: F.contains(norm, x)))


def classify(text: Column) -> Column:
    """asset (BANKNOTE, COIN, UNKNOWN) and confidence of a text. Decisive terms of paper money come first; of other
    terms two or more, and more than of coins, make it paper money, else one term of coins a coin. Null is UNKNOWN."""
    counts = lambda n: F.struct(
        (_held(n, EVIDENCE) > 0).alias("sure"), _held(n, STRONG).alias("strong"), _held(n, COINS).alias("coin"),
        (_held(n, WEAK) + F.when(n.rlike(PICK), PICK_WEIGHT).otherwise(0)).alias("bank"),
    )
    return t.let(t.let(t.norm(text), counts), _verdict)


def _verdict(c: Column) -> Column:
    said = lambda asset, confidence: F.struct(F.lit(asset).alias("asset"), F.round(confidence, 3).alias("confidence"))
    up_to = lambda most, base, each, n: F.least(F.lit(most), F.lit(base) + F.lit(each) * n)
    return (
        F.when(c["sure"], said("BANKNOTE", F.lit(0.995)))
        .when(c["strong"] > 0, said("BANKNOTE", up_to(0.995, 0.90, 0.02, c["strong"])))
        .when((c["bank"] >= 2) & (c["bank"] > c["coin"]), said("BANKNOTE", up_to(0.99, 0.65, 0.08, c["bank"])))
        .when(c["coin"] >= 1, said("COIN", up_to(0.98, 0.70, 0.06, c["coin"])))
        .otherwise(said("UNKNOWN", F.lit(0.45)))
    )
