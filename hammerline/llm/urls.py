"""URL filters: host and path rules, then a blocked Bloom filter of listed URLs before an exact join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path): longest rule first wins.
Rule = tuple[str, str, str]
#: Blocks of 256 bits; 12 bits of filter a listed URL; two of a URL's eight bits in each of four longs.
BITS_A_KEY, BLOCK_BITS = 12, 256
#: A filter of more blocks than this (24 MB) is not broadcast but joined by a shuffle.
MAX_BROADCAST_BLOCKS = 500_000


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading www., and path without trailing slashes; null if there is no host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", "")))


def longest_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule as host and path, its verdict), null where none fits. A rule fits its host and all
    subdomains, if the path starts with the rule's; the longest wins, then the longer host."""
    named = fits = F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r)):
        fit = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        named, fits = F.when(fit, h + p).otherwise(named), F.when(fit, verdict).otherwise(fits)
    return named, fits


def _bits(key: Column) -> list[Column]:
    """A key's two bits in each of the four longs of its block."""
    h = F.xxhash64(key, F.lit(1))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int"))
    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(4)]


def bloom_blocks(listed: DataFrame, n_blocks: int) -> DataFrame:
    """(block, b0 to b3) of the distinct keys in the column `key`."""
    rows = listed.select(F.pmod(F.xxhash64("key"), F.lit(n_blocks)).alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(_bits(F.col("key")))])
    return rows.groupBy("block").agg(*[F.bit_or(f"b{i}").alias(f"b{i}") for i in range(4)])


def judge_urls(
    pages: DataFrame, rules: list[Rule], listed: DataFrame, id_col: str = "page_id", url_col: str = "url", salts: int = 16
) -> DataFrame:
    """One row a page: id_col, host, path, rule, verdict ('block' or 'allow').

    listed has one column of URLs to block; null ones and ones without a host are ignored. Where no rule
    fits, a page is blocked if its canonical URL is one of theirs. The Bloom filter passes all listed and
    few others; only what it passes goes to the exact join, which is salted because one URL may be very
    common. Null and malformed URLs have an empty host and are allowed. Ids may repeat or be null.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    rows = rows.select(id_col, "host", "path", rule.alias("rule"), verdict.alias("ruled"), canonical(F.col("host"), F.col("path")).alias("key"))
    u = F.col(listed.columns[0]).cast("string")
    keys = listed.select(canonical(host_of(u), path_of(u)).alias("key")).filter("key is not null").distinct()
    n_blocks = max(1, -(-keys.count() * BITS_A_KEY // BLOCK_BITS))
    blocks = bloom_blocks(keys, n_blocks)
    if n_blocks <= MAX_BROADCAST_BLOCKS:
        blocks = F.broadcast(blocks)
        probe = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks)))
        on = ["block"]
    else:  # the filter's blocks are dealt with a salt as well
        blocks = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        probe = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks))).withColumn("salt", _salt(id_col, salts))
        on = ["block", "salt"]
    inside = [F.col(f"b{i}").bitwiseAND(b) == b for i, b in enumerate(_bits(F.col("key")))]
    possible = inside[0] & inside[1] & inside[2] & inside[3] & F.col("ruled").isNull() & F.col("key").isNotNull()
    probe = probe.join(blocks, on, "left").withColumn("possible", F.coalesce(possible, F.lit(False)))
    probe = probe.select(id_col, "host", "path", "rule", "ruled", "key", "possible")
    salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    exact = probe.filter("possible").withColumn("salt", _salt(id_col, salts)).join(salted.withColumn("hit", F.lit(True)), ["key", "salt"], "left")
    result = [id_col, "host", "path", "rule"]
    exact = exact.select(*result, F.when(F.col("hit"), "block").otherwise("allow").alias("verdict"))
    return exact.union(probe.filter("not possible").select(*result, F.coalesce("ruled", F.lit("allow")).alias("verdict")))


def _salt(id_col: str, salts: int) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(salts)).cast("int")
