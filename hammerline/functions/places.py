"""Countries: their names in several languages, codes, and columns that find them in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hammerline.functions import text as t

#: Countries by the names that texts use, in the order in which they are tried (fixed values).
NAMES = {
    "croatia": "croatia|croatian|hrvatska|kroatien|croatie|croazia|croacia|κροατια",
    "greece": "greece|greek|hellas|ellada|griechenland|grèce|grece|ελλαδα",
    "germany": "germany|deutschland|allemagne|γερμανια",
    "france": "france|francais|française|frankreich|γαλλια",
    "italy": "italy|italia|italien|ιταλια",
    "spain": "spain|espana|españa|spanien|ισπανια",
    "united states": "united states|usa|u.s.a|america|vereinigte staaten",
    "united kingdom": "united kingdom|great britain|britain|england|uk",
    "monaco": "monaco|monegasque",
    "slovenia": "slovenia|slovenian|slowenien|slovenie|slovénie",
    "slovakia": "slovakia|slovak|slowakei|slovaquie",
    "austria": "austria|osterreich|österreich",
    "belgium": "belgium|belgie|belgique",
    "netherlands": "netherlands|nederland|holland",
    "portugal": "portugal",
    "finland": "finland|suomi|finnland|finlande",
    "ireland": "ireland|eire|éire|irland|irlande",
    "cyprus": "cyprus|kypros|zypern|chypre",
    "malta": "malta|malte",
    "luxembourg": "luxembourg|luxemburg",
    "estonia": "estonia|eesti|estland|estonie",
    "latvia": "latvia|latvija|lettland|lettonie",
    "lithuania": "lithuania|lietuva|litauen|lituanie",
    "poland": "poland|polska|polen",
    "czech republic": "czech republic|czechia|tschechien",
    "sweden": "sweden|sverige|schweden",
    "norway": "norway|norge|norwegen",
    "denmark": "denmark|danmark|danemark",
    "switzerland": "switzerland|suisse|schweiz|svizzera",
    "australia": "australia",
    "canada": "canada",
    "bulgaria": "bulgaria",
    "romania": "romania|roumanie",
    "hungary": "hungary|magyarorszag|ungarn",
    "japan": "japan",
    "andorra": "andorra|andorre",
    "san marino": "san marino|san-marino|sanmarino",
    "vatican city": "vatican city|vatican|citta del vaticano|città del vaticano|vatikan",
}
#: Two-letter codes of countries (fixed values).
CODES = {
    "croatia": "HR", "greece": "GR", "germany": "DE", "france": "FR", "italy": "IT", "spain": "ES", "united states": "US", "united kingdom": "GB", "monaco": "MC",
    "slovenia": "SI", "slovakia": "SK", "austria": "AT", "belgium": "BE", "netherlands": "NL", "portugal": "PT", "finland": "FI", "ireland": "IE", "cyprus": "CY",
    "malta": "MT", "luxembourg": "LU", "estonia": "EE", "latvia": "LV", "lithuania": "LT", "poland": "PL", "czech republic": "CZ", "sweden": "SE", "norway": "NO",
    "denmark": "DK", "switzerland": "CH", "australia": "AU", "canada": "CA", "bulgaria": "BG", "romania": "RO", "hungary": "HU", "japan": "JP",
}


def _plain(name: str) -> str:
    """A name as normal forms write it."""
    return name.translate(str.maketrans(t.ACCENTED, t.PLAIN))


def shown(name: str) -> str:
    return name.title()


def country_of(text: Column) -> Column:
    """The first country, in the order of NAMES, one of whose names the text holds; null if none."""
    entries = F.array(*[F.struct(F.lit(shown(k)).alias("name"), F.array(*[F.lit(_plain(x)) for x in v.split("|")]).alias("names")) for k, v in NAMES.items()])
    return t.let(t.norm(text), lambda n: F.get(F.filter(entries, lambda e: F.exists(e["names"], lambda x: F.contains(n, x))), 0)["name"])


def canonical_country(text: Column) -> Column:
    """country_of the text, else its normal form."""
    return F.coalesce(country_of(text), t.norm(text))


def names_of(country: Column) -> Column:
    """All names of a country, however it is named itself; of an unknown one its normal form alone."""
    known = F.create_map(*[F.lit(x) if isinstance(x, str) else x for k, v in NAMES.items() for x in (shown(k), F.array(*map(F.lit, v.split("|"))))])
    return t.let(canonical_country(country), lambda c: F.coalesce(F.try_element_at(known, c), F.array(c)))


def country_in(text: Column, country: Column) -> Column:
    """Whether the text holds any name of the country; true without a country."""
    found = t.let(t.norm(text), lambda n: F.exists(names_of(country), lambda x: F.contains(n, t.norm(x))))
    return F.when(F.trim(F.coalesce(country, F.lit(""))) == "", True).otherwise(found)


def destination(country: Column) -> Column:
    """name, code (empty if unknown) and pattern (any name, longest first) of a country as someone writes it; without one, Greece."""
    asked = F.coalesce(F.nullif(F.trim(country), F.lit("")), F.lit("Greece"))
    codes = F.create_map(*[F.lit(x) for k, v in CODES.items() for x in (shown(k), v)])
    spelled = lambda c: F.when(country_of(asked).isNull(), F.array(F.lower(asked))).otherwise(names_of(c))
    longest = F.array_sort(F.array_distinct(spelled(asked)), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).otherwise(1))
    quoted = F.transform(longest, lambda x: F.regexp_replace(x, r"([^\p{L}\p{N} ])", r"\\$1"))
    return F.struct(
        F.coalesce(country_of(asked), F.initcap(asked)).alias("name"), F.coalesce(F.try_element_at(codes, country_of(asked)), F.lit("")).alias("code"),
        F.concat(F.lit("(?:"), F.array_join(quoted, "|"), F.lit(")")).alias("pattern"),
    )
