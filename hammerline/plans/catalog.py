"""All registered queries of the price-analytics side, with their SQL twins."""

from hammerline.plans import catalogue, identities, landing, listings, market, pages, registry, stated, texts, trade

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (market, trade, texts, listings, identities, catalogue, pages, registry, landing, stated):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
