"""All denominations that a text states: numbers, fractions and number words before the name of a unit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hammerline.functions import text as t

#: Units and their other names (fixed values). A name with /s has a regular plural as well.
UNIT_LINES = """
euro/s eur €
dollar/s usd $
pound/s gbp sterling £
franc/s franken frank frs
yen
yuan renminbi
drachma/s drachmai drachmae drachme drachmen
lira/s lire
peseta/s ptas
mark/s deutsche_mark reichsmark dm
guilder/s gulden
schilling/s
markka markkaa finnmark finnmarkka
krona kronor krone kroner kronur
zloty zlote zlotych
koruna koruny korun
forint forintok
leu lei
lev leva
kuna kune
dinar/s dinara
litas litai litu
lats lati latu
kroon krooni
ruble/s rouble/s rubl rublei
escudo/s
tolar tolarjev tolarja
cent/s euro_cent/s eurocent/s centesimo/s centesimi centimo/s centime/s ¢
pfennig/s pfennige
pence penny
ore
grosz groszy grosze
filler fillerek
haler halere halierov halier
ban bani
stotinka stotinki stotin
lepton lepta lepto
santim/s
centas centai centu
kopeck/s kopek/s kopeyka
para
lipa lipe
shilling/s
crown/s
farthing/s
sovereign/s
guinea/s
groschen/s
taler/s thaler/s
kreuzer kreutzer
real reales reais
maravedi/s
soldo soldi
scudo scudi
baiocco baiocchi
skilling skillingar
lek leke
denar denari
lari
dram/s
piastre/s kurus
obol/s obolos obolus
stater/s
drachm/s
denarius denarii
sestertius sestertii sesterce
solidus solidi
tremissis tremisses
"""
#: Number words (fixed values).
NUMBER_WORDS = {
    "one": 1.0, "two": 2.0, "three": 3.0, "four": 4.0, "five": 5.0, "six": 6.0, "seven": 7.0, "eight": 8.0, "nine": 9.0, "ten": 10.0, "half": 0.5, "quarter": 0.25,
}
#: Fractions of one sign (fixed values).
FRACTIONS = {"½": "1/2", "¼": "1/4", "¾": "3/4", "⅒": "1/10", "⅕": "1/5", "⅛": "1/8"}
#: Letters beside those of text.ACCENTED and what they are without accents, in order (fixed values).
MORE_ACCENTED, MORE_PLAIN = "łøřšžćčęąśźżěůďťňđőűş", "lorszcceaszzeudtndous"
#: References to signs in pages (fixed values).
REFERENCES = {"&euro;": "€", "&pound;": "£", "&cent;": "¢", "&frac12;": "½", "&frac14;": "¼", "&frac34;": "¾", "&nbsp;": " "}


def unit_names() -> dict[str, str]:
    """Each name to its unit."""
    found = {}
    for line in UNIT_LINES.split("\n"):
        names = [n.replace("_", " ") for n in line.split()]
        for name in names:
            stem = name.removesuffix("/s")
            found |= dict.fromkeys([stem] if stem == name else [stem, stem + "s"], names[0].removesuffix("/s"))
    return found


UNITS = unit_names()
#: Longest names first, so that 2 euro cent is no 2 euro. A number neither begins inside another nor a word inside a word.
_NAMES = "|".join("\\" + n if n == "$" else n for n in sorted(UNITS, key=lambda n: (-len(n), n)))
PATTERN = rf"(?<![0-9/])(?:(?<![a-z])({'|'.join(NUMBER_WORDS)})(?![a-z0-9]) ?|([0-9]+(?:[./][0-9]+)?) ?)({_NAMES})(?![a-z])"


def plain_words(text: Column) -> Column:
    """Lower case without accents; commas in numbers as points, fractions as a/b; else letters, digits and signs of money."""
    low = F.lower(F.coalesce(text, F.lit("")))
    for reference, sign in REFERENCES.items():
        low = F.replace(low, F.lit(reference), F.lit(sign))
    for sign, fraction in FRACTIONS.items():
        low = F.replace(low, F.lit(sign), F.lit(f" {fraction} "))
    low = F.translate(low, t.ACCENTED + MORE_ACCENTED, t.PLAIN + MORE_PLAIN)
    low = F.regexp_replace(F.regexp_replace(low, "(?<=[0-9]),(?=[0-9])", "."), "(?<=[0-9])\\s*/\\s*(?=[0-9])", "/")
    return F.trim(F.regexp_replace(low, r"(?:[^\p{L}\p{N}./€£$¢]|(?<![0-9])[./]|[./](?![0-9]))+", " "))


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _number(raw: Column) -> Column:
    parts = F.split(raw, "/")
    fraction = F.get(parts, 0).try_cast("double") / F.nullif(F.get(parts, 1).try_cast("double"), F.lit(0.0))
    return F.when(F.size(parts) == 2, fraction).otherwise(raw.try_cast("double"))


def extract_denominations(text: Column) -> Column:
    """array of (value, unit): every denomination that the text states, each once, in the order in which they
    first stand. A null or empty text states none; a fraction by zero is none."""
    part = lambda hit, k: F.regexp_extract(hit, PATTERN, k)
    unit = lambda hit: F.try_element_at(_map(UNITS), part(hit, 3))
    value = lambda hit: F.when(part(hit, 1) != "", F.try_element_at(_map(NUMBER_WORDS), part(hit, 1))).otherwise(_number(part(hit, 2)))
    hits = F.regexp_extract_all(plain_words(text), F.lit(PATTERN), F.lit(0))
    found = F.transform(hits, lambda hit: F.struct(value(hit).alias("value"), unit(hit).alias("unit")))
    return F.array_distinct(F.filter(found, lambda d: d.value.isNotNull()))


def parse_denomination(text: Column) -> tuple[Column, Column]:
    """(value, unit) of the first denomination that the text states; null if none."""
    first = t.let(extract_denominations(text), lambda found: F.get(found, 0))
    return first["value"], first["unit"]


def fits(stated: Column, value: Column, unit: Column) -> Column:
    """Some of the stated denominations is the wanted one; all texts fit where none is wanted."""
    same = F.exists(stated, lambda d: (F.abs(d.value - value) < 1e-9) & (d.unit == unit))
    return F.when(value.isNull() | unit.isNull(), True).otherwise(F.coalesce(same, F.lit(False)))


def conflicts(stated: Column, value: Column, unit: Column) -> Column:
    """Denominations are stated, and none of them is the wanted one."""
    return (F.size(stated) > 0) & ~fits(stated, value, unit)
