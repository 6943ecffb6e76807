"""What item and result pages say: specifications, prices with shipping, discounts, second result layout, asset class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hammerline.functions import catalogue as c
from hammerline.functions import text as t
from hammerline.operators.listings import asset_class

#: Words that label physical specifications in five languages, and those of other fields (fixed values).
LABEL_WORDS = {
    "metal": ["material", "composition", "metal", "legierung", "materiale", "métal"],
    "weight": ["weight", "gewicht", "poids", "peso"],
    "fineness": ["fineness", "feinheit", "titre", "ley"],
    "diameter": ["diameter", "durchmesser", "diametre", "diamètre", "diametro", "Ø", "ø"],
}
OTHER_LABELS = ["catalog", "katalog", "mint", "mintage"]
#: Metals by the words for them (fixed values).
METALS = {
    "Silver": "silver|silber|argent|argento|plata", "Gold": "gold|or|oro", "Platinum": "platinum|platin|platine|platino", "Palladium": "palladium",
    "Copper": "copper|kupfer|cuivre|cobre", "Bronze": "bronze", "Brass": "brass|messing", "Nickel": "nickel", "Steel": "steel|stahl",
}
#: Words for shipping, for free shipping, and for prices (fixed values).
SHIPPING = r"(?:shipping|postage|versand|porto|frais de port|spedizione|envio|envío)"
FREE = r"(?:free shipping|versandkostenfrei|portofrei|livraison gratuite)"
PRICE = r"(?:price|preis|prix|prezzo|precio)"
#: The longest statement of a material.
MATERIAL_MOST = 100
#: Elements that begin a block of text (fixed values).
BLOCKS = r"(?i)</?(?:table|tr|td|div|section|p|li)\b[^>]*>"
FIELDS = ["primary_metal", "fineness_per_mille", "weight_g", "diameter_mm"]


def label(*words: str) -> str:
    """Any of the words; those of letters only whole."""
    whole, signs = [w for w in words if len(w) > 1], [w for w in words if len(w) == 1]
    return "(?:" + "|".join([rf"\b(?:{'|'.join(whole)})\b", *signs]) + ")"


LABELS = {kind: label(*words) for kind, words in LABEL_WORDS.items()}


def material(block: Column) -> Column:
    """What stands between the first label of a material and the next label of another field, or the end; empty if it is too long."""
    behind = F.regexp_extract(block, rf"(?is){LABELS['metal']}[\s:-]*(.*)$", 1)
    others = label(*OTHER_LABELS, *[w for kind, words in LABEL_WORDS.items() if kind != "metal" for w in words])
    said = F.get(F.split(behind, rf"(?i)\s{others}", 2), 0)
    return F.when(F.length(said) <= MATERIAL_MOST, said).otherwise("")


def plain(html: Column) -> Column:
    """Text without scripts, styles, tags and runs of white space."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), r"\s+", " "))


def spec_blocks(pages: DataFrame, longest: int = 650) -> DataFrame:
    """(page_id, pos, block): text blocks that name two kinds of specification or more and aren't too long."""
    bare = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1>", " ")
    found = pages.select("page_id", F.posexplode(F.split(bare, BLOCKS)).alias("pos", "raw")).select("page_id", "pos", plain(F.col("raw")).alias("block"))
    kinds = sum((F.col("block").rlike("(?i)" + p).cast("int") for p in LABELS.values()), F.lit(0))
    return found.filter((F.length("block") <= longest) & (kinds >= 2))


def _within(value: Column, low: float, high: float) -> Column:
    return F.when((value >= low) & (value <= high), value)


def _metal(said: Column) -> Column:
    """The first metal of the list that a material names, and its fineness where it is written as a fraction of one."""
    metal = F.lit(None).cast("string")
    for name, words in reversed(METALS.items()):
        metal = F.when(said.rlike(rf"(?i)\b(?:{words})\b"), name).otherwise(metal)
    return F.struct(metal.alias("metal"), F.nullif(F.regexp_extract(said, r"(?:^|\s)(?:0[.,]|\.)([0-9]{3})(?![0-9])", 1), F.lit("")).alias("fineness"))


def explicit_specs(blocks: DataFrame) -> DataFrame:
    """Adds the four fields a block states behind their labels; values out of range are null. A bare number is
    never a fineness. Blocks with fewer than two fields are left out."""
    b = F.col("block")
    number = lambda p: F.replace(F.nullif(F.regexp_extract(b, "(?i)" + p, 1), F.lit("")), F.lit(","), F.lit(".")).cast("double")
    size = r"([0-9]+(?:[.,][0-9]+)?)\s*mm\b"
    stuff = t.let(material(b), _metal)
    labelled = F.nullif(F.regexp_extract(b, rf"(?i){LABELS['fineness']}\s*[:\-]?\s*(?:0?[.,])?([0-9]{{3}})\b", 1), F.lit(""))
    found = blocks.select(
        *blocks.columns, stuff["metal"].alias("primary_metal"), _within(F.coalesce(labelled, stuff["fineness"]).cast("int"), 100, 999).alias("fineness_per_mille"),
        _within(number(LABELS["weight"] + r"\s*[:\-]?\s*([0-9]+(?:[.,][0-9]+)?)\s*(?:g|gr|grams?|gramm)\b"), 0.05, 2000).alias("weight_g"),
        _within(number(LABELS["diameter"] + r"\s*[:\-]?\s*" + size), 3, 200).alias("diameter_mm"),
    )
    stated = sum((F.col(f).isNotNull().cast("int") for f in FIELDS), F.lit(0))
    return found.withColumn("n_fields", stated).filter("n_fields >= 2")


def complete_single_spec(specs: DataFrame) -> DataFrame:
    """A row a page: its fullest block (the first of equals), if it states metal, fineness and weight."""
    best = specs.groupBy("page_id").agg(F.max_by(F.struct(*FIELDS), F.struct("n_fields", -F.col("pos"))).alias("b")).select("page_id", "b.*")
    best = best.filter("primary_metal IS NOT NULL AND fineness_per_mille IS NOT NULL AND weight_g IS NOT NULL")
    return best.withColumn("fine_metal_g", F.col("weight_g") * F.col("fineness_per_mille") / 1000)


def price_and_shipping(text: Column, title: Column) -> dict[str, Column]:
    """price, currency, shipping, shipping_currency, shipping_status (known, free, unknown). A labelled price
    comes first, else the first amount behind what the title holds; shipping is labelled, or has a plus before
    it, or a destination behind it; a free-shipping phrase overrides."""
    first = lambda p, x=text: F.regexp_extract(x, "(?i)" + p, 1)
    segment = F.nullif(first(rf"{PRICE}\s*:?\s*({c.MONEY})"), F.lit(""))
    rest = F.when(F.coalesce(title, F.lit("")) != "", F.replace(text, title, F.lit(" "))).otherwise(text)
    price, currency = c.money(F.coalesce(segment, rest))
    forms = [rf"{SHIPPING}[^€$£0-9]{{0,60}}({c.MONEY})", rf"\+\s*({c.MONEY})\s*{SHIPPING}", rf"({c.MONEY})\s*{SHIPPING}\s*\(?\s*to\b"]
    ship, ship_currency = c.money(F.coalesce(*[F.nullif(first(p), F.lit("")) for p in forms]))
    free = text.rlike("(?i)" + FREE)
    return {
        "price": price, "currency": currency, "shipping": F.when(free, 0.0).otherwise(ship), "shipping_currency": F.when(free, currency).otherwise(ship_currency),
        "shipping_status": F.when(free | (ship == 0), "free").when(ship.isNotNull(), "known").otherwise("unknown"),
    }


def bridged(offers: DataFrame, rates: DataFrame) -> DataFrame:
    """offers with shipping in the price's currency, over EUR; rates is (currency, per_eur), a row a currency.
    Without a rate the shipping is null and its status unknown."""
    of = lambda name: rates.select(F.col("currency").alias(name), F.col("per_eur").alias(name + "_rate"))
    rows = offers.join(of("currency"), "currency", "left").join(of("shipping_currency"), "shipping_currency", "left")
    there = F.when(F.col("currency") == F.col("shipping_currency"), F.col("shipping")).otherwise(F.bround(F.col("shipping") / F.col("shipping_currency_rate") * F.col("currency_rate"), 2))
    status = F.when(F.col("shipping").isNotNull() & there.isNull(), "unknown").otherwise(F.col("shipping_status"))
    return rows.select(*[x for x in offers.columns if x not in ("shipping", "shipping_currency", "shipping_status")], there.alias("shipping"), status.alias("shipping_status"))


def shipping_from_page(text: Column, wanted: Column, names: list[str]) -> dict[str, Column]:
    """cost and level: known_target (the amount goes to the wanted country, a pattern), known_other_destination
    (to another of `names`), known_unconfirmed_destination (to none that is named), unknown."""
    amount = rf"(?:{c.MONEY})\s*{SHIPPING}|{SHIPPING}\s*:?\s*(?:{c.MONEY})|{FREE}"
    to = r"\s*\(?\s*(?:to|nach|vers)\s+"
    ours = F.call_function("regexp_extract", text, F.concat(F.lit(rf"(?i)({amount}){to}(?:"), wanted, F.lit(r")\b")), F.lit(1))
    other = F.regexp_extract(text, rf"(?i)({amount}){to}(?:{'|'.join(names)})\b", 1)
    bare = F.regexp_extract(text, f"(?i)({amount})", 1)
    segment = F.coalesce(F.nullif(ours, F.lit("")), F.nullif(other, F.lit("")), F.nullif(bare, F.lit("")))
    cost = F.when(segment.rlike("(?i)" + FREE), 0.0).otherwise(c.money(segment)[0])
    level = F.when(ours != "", "known_target").when(other != "", "known_other_destination").when(bare != "", "known_unconfirmed_destination").otherwise("unknown")
    return {"cost": cost, "level": level}


def discount(html: Column, price: Column) -> dict[str, Column]:
    """original_price and discount_pct where a struck-through amount is above the price; else null."""
    struck = r"(?is)<(?:del|s|strike)\b[^>]*>(.*?)</(?:del|s|strike)>"
    styled = r"(?is)<[a-z]+\b[^>]*line-through[^>]*>(.*?)</"
    parts = F.flatten(F.array(F.regexp_extract_all(html, F.lit(struck), F.lit(1)), F.regexp_extract_all(html, F.lit(styled), F.lit(1))))
    old = F.array_max(F.transform(parts, lambda x: c.money(F.regexp_replace(x, "<[^>]*>", " "))[0]))
    old = F.when(old > price, F.bround(old, 2))
    return {"original_price": old, "discount_pct": F.bround((old - price) / old * 100, 1)}


def marketplace_cards(pages: DataFrame) -> DataFrame:
    """A row an item of the second result layout: page_id, url (without its query), title, price (the first of a
    range), shipping (nothing said is 0). The first of repeated items of a page stays."""
    cards = pages.select("page_id", F.posexplode(F.split("html", r'(?i)<li class="s-item')).alias("pos", "card")).filter("pos > 0")
    inner = lambda name: plain(F.regexp_extract("card", rf'(?is)class="s-item__{name}"[^>]*>(.*?)</(?:span|div|h3)>', 1))
    url = F.regexp_replace(F.regexp_extract("card", r'(?i)<a[^>]*href="([^"]+)"', 1), r"\?.*$", "")
    found = cards.select("page_id", "pos", url.alias("url"), inner("title").alias("title"), c.money(inner("price"))[0].alias("price"), F.coalesce(c.money(inner("shipping"))[0], F.lit(0.0)).alias("shipping"))
    found = found.filter("url <> '' AND title <> '' AND price > 0").groupBy("page_id", "url")
    return found.agg(F.min_by(F.struct("title", "price", "shipping"), "pos").alias("b")).select("page_id", "url", "b.*")


def page_asset_class(html: Column) -> Column:
    """Asset class of title and breadcrumb; the shop's general label of both kinds says nothing."""
    title = F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)
    crumbs = F.regexp_extract(html, r'(?is)<nav class="breadcrumb">(.*?)</nav>', 1)
    said = plain(F.concat(title, F.lit(" "), crumbs))
    return asset_class(F.regexp_replace(said, r"(?i)coins?\s*(?:\+|&|and)\s*(?:banknotes?|paper money)", " "))


def validated(offers: DataFrame, pages: DataFrame) -> DataFrame:
    """offers (offer_id, page_id, ambiguous, wanted words) that are sure, or whose page isn't of a bank note and
    has every wanted word in its title. Ambiguous offers without a page are left out."""
    seen = pages.select("page_id", page_asset_class(F.col("html")).alias("asset"), F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"))
    rows = offers.join(seen, "page_id", "left")
    sure = ~F.col("ambiguous") | F.coalesce((F.col("asset") != "BANKNOTE") & c.says_whole(F.col("title"), t.tokens(F.col("wanted"))), F.lit(False))
    return rows.filter(sure).select("offer_id", "page_id", "ambiguous", "asset")
