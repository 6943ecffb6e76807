"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hammerline.llm.common import discard, stored, stored_in_few


def _star(links: DataFrame, both: bool, rows: int) -> DataFrame:
    """One step. Every node's least neighbour comes from a map-side combined minimum; the links are
    then joined to that table, a join which Spark can split where a node has very many links."""
    around = links
    if both:
        around = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    least = stored_in_few(least, "least", rows)
    if both:  # each larger neighbour of u goes to u's least
        found = around.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # u and its smaller neighbours go to u's least
        found = around.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        found = found.union(least.select("u", F.col("m").alias("v")))
    found = stored_in_few(found.filter("u <> v").distinct(), "star", rows)
    discard(least)
    return found


def _is_forest(links: DataFrame) -> bool:
    """Whether every node with a link has one, to a node without links of its own: then nothing can change."""
    ends = links.select("u", F.lit(1).alias("lower"), F.lit(0).alias("higher")).union(links.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("u").agg(F.sum("lower").alias("lower"), F.max("higher").alias("higher"))
    return not ends.agg(F.count_if(F.expr("lower > 1 or lower > 0 and higher > 0"))).first()[0]


def connected_components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """links (u, v), of any orderable type, to (node, component): component is the least node that can
    be reached. Nodes without links are not returned. Null ends and self links are ignored. rows: about the
    number of links, where it is known.

    The number of rounds grows with the logarithm of the longest path; each round's links are written
    to the shared folder, so that a lost executor costs one round at most.
    """
    links = links.filter("u is not null and v is not null and u <> v")
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = stored(links, "links") if rows is None else stored_in_few(links, "links", rows)
    while not _is_forest(links):
        rows = 2 * links.count()
        larger = _star(links, True, rows)
        discard(links)
        links = _star(larger, False, rows)
        discard(larger)
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
