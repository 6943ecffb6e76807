"""Columns over catalogue labels and listing texts: denominations, references, prices, dates, search strings."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from hammerline.functions import denominations as dn
from hammerline.functions import text as t

#: Fraction signs (fixed values).
FRACTIONS = {"½": "1/2", "¼": "1/4", "¾": "3/4", "⅒": "1/10", "⅕": "1/5", "⅖": "2/5", "⅛": "1/8"}
#: Catalogues and the marks of their references; a bare P is a mint mark (fixed values).
MARKS = {"km": ["KM"], "y": ["Y"], "pick": ["Pick", "P#"], "ric": ["RIC"]}
#: Variants by the wordings for them, in normal form (fixed values).
VARIANTS = {
    "proof": ["proof", "pp", "polierte platte", "belle epreuve"],
    "unc": ["unc", "uncirculated", "bu", "brilliant uncirculated", "stempelglanz", "fleur de coin"],
    "commemorative": ["commemorative", "commem", "gedenkmunze", "αναμνηστικο"],
    "error": ["error", "mint error", "misstrike", "double strike", "off center", "off centre"],
    "colorized": ["colorized", "colourized", "colored", "coloured"],
    "privy": ["privy", "privy mark"],
    "small_date": ["small date"],
    "large_date": ["large date"],
}


def reference_pattern(marks: list[str]) -> str:
    """A mark that doesn't end another word, and what follows it, a sign of number between or not."""
    return rf"(?i)\b(?:{'|'.join(marks)})[\s#]*([0-9A-Za-z.-]+)"


def variants_of(text: Column) -> Column:
    """The variants that the text words, sorted."""
    padded = F.concat(F.lit(" "), t.norm(text), F.lit(" "))
    table = F.array(*[F.struct(F.lit(v).alias("variant"), F.array(*map(F.lit, words)).alias("words")) for v, words in sorted(VARIANTS.items())])
    held = lambda p: F.filter(table, lambda v: F.exists(v["words"], lambda w: F.contains(p, F.concat(F.lit(" "), w, F.lit(" ")))))
    return F.transform(t.let(padded, held), lambda v: v["variant"])


#: Signs and codes of currencies (fixed values).
SIGNS = {"EUR": r"EUR\b|€", "USD": r"US\$|\$|\bUSD\b", "GBP": r"\bGBP\b|£", "CHF": r"\bCHF\b"}
NUMBER = r"[0-9]{1,6}(?:[.,][0-9]{1,3})*"
MONEY = rf"(?:(?:{'|'.join(SIGNS.values())})\s*{NUMBER}|{NUMBER}\s*(?:{'|'.join(SIGNS.values())}))"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """What a group matches first; null if nothing."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, group), F.lit(""))


def _double(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def catalog_denomination(text: Column) -> tuple[Column, Column, Column]:
    """(value, unit, error): a fraction of two whole numbers, else a number with a known unit, else a leading
    number with any unit. error is EMPTY or INVALID where there is no positive value."""
    raw = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    for sign, plain in FRACTIONS.items():
        raw = F.replace(raw, F.lit(sign), F.lit(plain))
    fraction, number = r"^([0-9]+) ?/ ?([0-9]+)(?: (.+))?$", r"^[+]?([0-9]+(?:[.,][0-9]+)?|[.,][0-9]+)(?: (.+))?$"
    known, known_unit = dn.parse_denomination(raw)
    ratio = _double(_found(raw, fraction)) / F.nullif(_double(_found(raw, fraction, 2)), F.lit(0.0))
    value = F.when(raw.rlike(fraction), ratio).when(known > 0, known).otherwise(_double(_found(raw, number)))
    unit = F.when(raw.rlike(fraction), _found(raw, fraction, 3)).when(known > 0, known_unit).otherwise(_found(raw, number, 2))
    fit = F.coalesce(value > 0, F.lit(False))
    return F.when(fit, value), F.when(fit, unit), F.when(raw == "", "EMPTY").when(~fit, "INVALID")


def spec_denomination(text: Column) -> Column:
    """The first number; of cents the hundredth part."""
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(","), F.lit(".")))
    value = _found(low, r"([0-9]+(?:\.[0-9]+)?)").cast("double")
    return F.bround(F.when(low.contains("cent") | low.contains("λεπτ"), value / 100).otherwise(value), 4)


def euro_label(is_euro: Column, raw: Column) -> Column:
    """Bare numbers of euro issuers as listings write them (50 cent, 2 euro); all else stays."""
    v = _double(raw)
    cents, fits = F.round(v * 100).cast("long"), F.abs(v * 100 - F.round(v * 100)) < 1e-9
    whole = F.when(F.abs(v - F.round(v)) < 1e-9, F.concat(F.round(v).cast("long").cast("string"), F.lit(" euro")))
    label = F.when((v < 1) & fits, F.concat(cents.cast("string"), F.lit(" cent"))).otherwise(F.coalesce(whole, F.concat(v.cast("string"), F.lit(" euro"))))
    return F.when(is_euro & (v > 0), label).otherwise(raw)


def bare_number(text: Column) -> Column:
    """Two decimals; null if the text has anything but a number."""
    return F.bround(_double(F.trim(text)), 2)


def face_value(text: Column) -> Column:
    """2 1/2, 1/2 and 1/4 first, else the first number that can't be a year."""
    part = F.regexp_replace(F.regexp_extract(text, r"(?<![0-9])(2\s*1/2|1/2|1/4)(?![0-9])", 1), r"\s+", " ")
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![0-9])([0-9]+(?:[.,][0-9]+)?)(?![0-9])"), F.lit(1)), _double)
    first = F.get(F.filter(numbers, lambda n: (n < 1000) | (n > 2199)), 0)
    return F.when(part == "1/2", 0.5).when(part == "1/4", 0.25).when(part != "", 2.5).otherwise(first)


def catalog_references(text: Column) -> dict[str, Column]:
    return {name: _found(text, reference_pattern(marks)) for name, marks in MARKS.items()}


def without_references(text: Column) -> Column:
    """The text with catalogue references blanked, so that their numbers are no value or year."""
    for marks in MARKS.values():
        text = F.regexp_replace(text, reference_pattern(marks), " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def money(text: Column) -> tuple[Column, Column]:
    """(amount, currency) of the first number with a currency's sign or code on either side."""
    found = t.let(F.regexp_extract(F.coalesce(text, F.lit("")), f"(?i)({MONEY})", 1), _money)
    return found["amount"], found["currency"]


def _money(seg: Column) -> Column:
    currency = F.lit(None).cast("string")
    for code, sign in reversed(SIGNS.items()):
        currency = F.when(seg.rlike(f"(?i){sign}"), code).otherwise(currency)
    return F.struct(t.parse_number(F.nullif(F.regexp_extract(seg, f"({NUMBER})", 1), F.lit(""))).alias("amount"), currency.alias("currency"))


@F.pandas_udf(StringType())
def _unescaped(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield part.map(html.unescape, na_action="ignore")


def listing_norm(text: Column) -> Column:
    """Lower case, character references decoded, accents kept, Greek accents dropped, all but letters, digits, points and slashes blank."""
    low = F.translate(F.lower(_unescaped(text)), "άέήίόύώϊϋΐΰ", "αεηιουωιυιυ")
    return F.trim(F.regexp_replace(low, r"[^a-z0-9à-öø-ÿα-ω./]+", " "))


def feed_date(raw: Column) -> Column:
    """An instant from an RFC 822 or ISO 8601 date; without a zone it is UTC; null if neither."""
    mail = F.regexp_replace(F.regexp_replace(F.trim(raw), r"^[A-Za-z]{3},\s*", ""), r"\s(GMT|UTC|UT)$", " +0000")
    iso = F.regexp_replace(F.regexp_replace(F.trim(raw), r"Z$", "+00:00"), r"^([0-9]{4}-[0-9]{2}-[0-9]{2})$", "$1T00:00:00")
    zoned = F.when(iso.rlike(r"(?:[+-][0-9]{2}:?[0-9]{2})$") & iso.contains("T"), iso).otherwise(F.concat(iso, F.lit("+00:00")))
    return F.coalesce(F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")), F.when(iso.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_timestamp(zoned)))


def json_leaves(text: Column) -> Column:
    """All leaves of a JSON text, in order, joined by blanks; names and nulls are no leaves."""
    values = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"\s*:', " ")
    leaves = F.regexp_extract_all(values, F.lit(r'("(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+\-]*|true|false)'), F.lit(1))
    return F.array_join(F.transform(leaves, _leaf), " ")


def _leaf(x: Column) -> Column:
    """A leaf as text: strings without quotes and with their escapes decoded, as they are where that fails."""
    plain = F.regexp_replace(x, '^"|"$', "")
    decoded = F.get_json_object(F.concat(F.lit('{"v":'), x, F.lit("}")), "$.v")
    return F.when(x.startswith('"') & x.contains("\\"), F.coalesce(decoded, plain)).otherwise(plain)


def first_path(text: Column, *paths: str) -> Column:
    """The first of some JSON paths that holds something."""
    return F.coalesce(*[F.get_json_object(text, p) for p in paths])


def joined_fragments(parts: Column) -> Column:
    """Text fragments joined by blanks, but numbers that are split over fragments without one."""
    apart = lambda s, x: F.when((s == "") | (s.rlike("[0-9]$") & x.rlike("^[0-9.,]")), F.concat(s, x)).otherwise(F.concat(s, F.lit(" "), x))
    return F.aggregate(F.filter(parts, lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(""), apart)


def search_strings(places: Column, labels: Column, rest: Column, most: int) -> Column:
    """Up to `most` distinct search strings: every name of the place with every writing of the denomination, and the rest."""
    crossed = F.flatten(F.transform(places, lambda p: F.transform(labels, lambda d: F.concat_ws(" ", p, d, F.nullif(rest, F.lit(""))))))
    return F.slice(F.array_distinct(crossed), 1, most)


def says_whole(text: Column, words: Column) -> Column:
    """Every word stands in the text as a whole word; true without words."""
    padded = F.concat(F.lit(" "), t.norm(text), F.lit(" "))
    return F.forall(words, lambda w: F.contains(padded, F.concat(F.lit(" "), w, F.lit(" "))))
