"""Columns over free text: normal forms, prices, numbers, denominations, years, catalogue references."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F



def _without_accents() -> dict[str, str]:
    """Small letters of Latin, Greek and Cyrillic that are one letter with marks, and that letter."""
    found = {}
    for letter in map(chr, [*range(0xC0, 0x250), *range(0x370, 0x460), *range(0x1E00, 0x2000)]):
        plain = "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c))
        if letter.islower() and plain != letter and re.fullmatch("[a-zα-ωа-я]", plain):
            found[letter] = plain
    return found


#: Accented letters and what they are without, in order.
ACCENTED, PLAIN = map("".join, zip(*_without_accents().items()))
#: Signs of currencies and fractions as words (fixed values).
SIGN_WORDS = {"€": " euro ", "£": " gbp ", "$": " usd ", "¢": " cent ", "½": " 1/2 ", "¼": " 1/4 "}
#: What normal forms keep: letters of three scripts, digits, points and slashes.
KEPT = "a-z0-9α-ωа-яєґ./"
#: Greek letters with one Latin letter, and those with two (fixed values, in order).
GREEK = "αβγδεζηικλμνξοπρσςτυφω"
LATIN = "avgdeziiklmnxoprsstyfo"
GREEK_PAIRS = {"θ": "th", "χ": "ch", "ψ": "ps"}
#: Sold, reserved and out of stock, in five languages (fixed values).
UNAVAILABLE = "sold|sold out|out of stock|not available|reserved|verkauft|reserviert|ausverkauft|nicht verfügbar|nicht verfuegbar|vendu|réservé|vendido|reservado|venduto"
#: Wording of sets and lots (fixed values).
SET_WORDS = r"\b(set|lot|lots|sets|collection|kursmünzensatz|série|roll|proofset)\b"
#: Wording of other products than a single coin (fixed values).
NEGATIVE_TERMS = [
    "banknote", "bank note", "paper money", "replica", "copy", "reproduction", "medal", "token", "coin set", "set", "roll", "rouleau", "lot of", "bulk lot",
    "fantasy issue", "souvenir",
]
STOP = ["the", "and", "with", "for", "der", "die", "das", "les", "des", "los", "las"]


def let(value: Column, body) -> Column:
    """body(value) with value computed once: long expressions that use a column often would outgrow generated code."""
    return F.get(F.transform(F.array(value), body), 0)


def norm(text: Column) -> Column:
    """Lower case, no accents, signs of currencies, quarters and halves as words; only Latin, Greek and Cyrillic letters,
    digits, points and slashes. Hyphens part words, so that each is found as a whole word."""
    t = F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN)
    for sign, word in SIGN_WORDS.items():
        t = F.replace(t, F.lit(sign), F.lit(word))
    return F.trim(F.regexp_replace(F.regexp_replace(t, f"[^{KEPT}]+", " "), " +", " "))


def transliterate_greek(text: Column) -> Column:
    t = F.translate(F.translate(F.lower(text), ACCENTED, PLAIN), GREEK, LATIN)
    for letter, pair in GREEK_PAIRS.items():
        t = F.replace(t, F.lit(letter), F.lit(pair))
    return t


def tokens(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(norm(text), " "), ""))


def contains_phrase(text: Column, phrase: str) -> Column:
    """The phrase as whole words of a normal form."""
    return F.concat(F.lit(" "), norm(text), F.lit(" ")).contains(f" {phrase} ")


def negative_flags(text: Column) -> Column:
    """The terms of NEGATIVE_TERMS that stand in the text as whole words, sorted."""
    return let(F.concat(F.lit(" "), norm(text), F.lit(" ")), lambda t: F.filter(F.array(*map(F.lit, sorted(NEGATIVE_TERMS))), lambda x: F.contains(t, F.concat(F.lit(" "), x, F.lit(" ")))))


def is_negative(text: Column) -> Column:
    """Whether negative_flags would find any."""
    return F.concat(F.lit(" "), norm(text), F.lit(" ")).rlike(f" ({'|'.join(NEGATIVE_TERMS)}) ")


def looks_unavailable(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike(rf"\b({UNAVAILABLE})\b")


def product_scope(text: Column) -> Column:
    return F.when(F.lower(F.coalesce(text, F.lit(""))).rlike(SET_WORDS), "SET").otherwise("SINGLE")


def variant_tokens(text: Column) -> Column:
    """Distinct words of three letters or more, without stop words and digits."""
    return F.filter(tokens(text), lambda x: (F.length(x) >= 3) & ~x.isin(STOP) & ~x.rlike("[0-9]"))


def variant_matches(wanted: Column, title: Column) -> Column:
    """At least 60 percent of the wanted words are in the title."""
    hits = F.size(F.filter(wanted, lambda x: F.contains(norm(title), x)))
    return (F.size(wanted) > 0) & (hits >= F.ceil(F.size(wanted) * 0.6))


def parse_number(raw: Column) -> Column:
    """Numbers in European and US writing: the last separator is the decimal one; several points are thousands."""
    return let(F.regexp_replace(F.coalesce(raw, F.lit("")), r"[^0-9.,\-]", ""), _number)


def _number(t: Column) -> Column:
    comma, point = F.length(t) - F.length(F.replace(t, F.lit(","))), F.length(t) - F.length(F.replace(t, F.lit(".")))
    last_comma = F.length(t) - F.instr(F.reverse(t), ",")
    last_point = F.length(t) - F.instr(F.reverse(t), ".")
    both = F.when(last_comma > last_point, F.replace(F.replace(t, F.lit(".")), F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(",")))
    plain = F.when(comma == 1, F.replace(t, F.lit(","), F.lit("."))).when(comma > 1, F.replace(t, F.lit(","))).when(point > 1, F.replace(t, F.lit("."))).otherwise(t)
    return F.when((comma > 0) & (point > 0), both).otherwise(plain).try_cast("double")


def parse_year(text: Column) -> Column:
    """The last number from 1000 to 2199 that stands alone."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b(1[0-9]{3}|2[01][0-9]{2})\b"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1)).cast("int")


def identity_key(*parts: Column) -> Column:
    """Parts in lower case, trimmed, joined by a bar; numbers without trailing zeros."""
    clean = lambda p: F.regexp_replace(F.lower(F.trim(F.coalesce(p.cast("string"), F.lit("")))), r"\.0+$|(\.[0-9]*[1-9])0+$", "$1")
    return F.concat_ws("|", *map(clean, parts))


def coin_key(country: Column, denomination: Column, year: Column, variant: Column) -> Column:
    """Country, denomination, year and variant as they are stated, in lower case, trimmed, joined by a bar; what is missing is empty."""
    return F.concat_ws("|", *[F.lower(F.trim(F.coalesce(p.cast("string"), F.lit("")))) for p in (country, denomination, year, variant)])


def item_id_from_url(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"[?&](?:id|page)=([0-9]+)", 1)
    return F.when(found != "", found)


def site_from_url(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"://(?:www\.|m\.|blog\.)?([^./?#]+)\.", 1)
    return F.when(found != "", found)


def summary(html: Column, most: int = 220) -> Column:
    """Text without tags and runs of white space, cut at a word and marked where longer than `most`."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]*>", " "), r"\s+", " "))
    return F.when(F.length(t) > most, F.concat(F.regexp_replace(F.substring(t, 1, most - 3), r"\s+\S*$", ""), F.lit("..."))).otherwise(t)
