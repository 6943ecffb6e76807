"""SimHash near-duplicates, linked by meet-in-the-middle ball hashing."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hammerline.llm.common import released, rows_of, stored
from hammerline.llm.components import connected_components

SEED = 42


_WHITE = re.compile(rb"[ \t-\r]")
#: Bytes of a text whose shingles are counted at once.
SPAN_BYTES = 1 << 20


def _spans(raw: bytes) -> Iterator[bytes]:
    """About SPAN_BYTES of a text at a time, cut behind white space."""
    at = 0
    while at < len(raw):
        end = at + SPAN_BYTES
        if end < len(raw):
            white = _WHITE.search(raw, end)
            end = white.end() if white else len(raw)
        yield raw[at:end]
        at = end


def _set_bits(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def simhash64(text: str | None, shingle_words: int = 3) -> int:
    """Fingerprint of a text: A-Z lower-cased, words between ASCII white space, `shingle_words` words a
    shingle, repeats included; a bit is 1 if over half the shingles' XXH64 have it. No words: 0. Very long
    texts are counted a megabyte at a time."""
    set_in, n, words, digest = np.zeros(64, np.int64), 0, [], xxhash.xxh64_intdigest
    for span in _spans((text or "").encode("utf-8", "surrogatepass")):
        words += span.lower().split()
        if len(words) < shingle_words:
            continue
        if shingle_words == 3:
            hashes = [digest(b"%b %b %b" % w, SEED) for w in zip(words, words[1:], words[2:])]
        else:
            hashes = [digest(b" ".join(words[i : i + shingle_words]), SEED) for i in range(len(words) - shingle_words + 1)]
        set_in, n, words = set_in + _set_bits(hashes), n + len(hashes), words[len(words) - shingle_words + 1 :]
    if not n and words:  # a text of fewer words is one shingle
        set_in, n = _set_bits([digest(b" ".join(words), SEED)]), 1
    return int.from_bytes(np.packbits(set_in * 2 > n).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """(id, x, fp): the 64-bit fingerprint of every whole text, as a signed long, and the text's own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_signed(simhash64(t.as_py(), shingle_words)) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps, pa.int64())], ["id", "x", "fp"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("x"), text.alias("t"))
    return rows.mapInArrow(released(run), "id long, x long, fp long")


def ball_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """fps (fp, distinct) to links (u, v) that connect exactly what pairs within `radius` bits connect.

    Each fingerprint emits every variant within half the radius (rounded up), so two fingerprints within
    the radius meet on a variant. With an even radius all members of a bucket are within the radius of
    each other, and each is linked to the bucket's least member only. With an odd one they need not be:
    then all pairs of a bucket, which has few members by construction, are compared. Links are
    deduplicated and their distance is verified.
    """
    half = -(-radius // 2)
    masks = [_signed(sum(1 << b for b in bits)) for n in range(half + 1) for bits in combinations(range(64), n)]
    flips = F.array(*[F.lit(m).cast("long") for m in masks])
    spread = fps.select("fp", F.explode(F.transform(flips, lambda m: m.bitwiseXOR(F.col("fp")))).alias("variant"))
    if radius == 2 * half:
        from pyspark.sql import Window

        met = spread.withColumn("u", F.min("fp").over(Window.partitionBy("variant")))
        met = met.filter("u <> fp").select("u", F.col("fp").alias("v"))
    else:  # members may lie up to 2 * half apart: all pairs of a bucket, which holds 65 ** half members at most
        met = spread.alias("a").join(spread.alias("b"), "variant").filter("a.fp < b.fp")
        met = met.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    return met.distinct().filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)


def class_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """prints (c distinct, fp; stored) to links (u, v) between the c that connect exactly what fingerprints of
    `radius` or fewer differing bits connect. Those of one fingerprint are linked to the least."""
    least = stored(prints.groupBy("fp").agg(F.min("c").alias("least")), "prints")
    same = prints.join(least, "fp").filter("least <> c").select(F.col("least").alias("u"), F.col("c").alias("v"))
    balls = stored(ball_links(least.select("fp"), radius), "balls")
    u, v = (least.select(F.col("fp").alias(n), F.col("least").alias(f"{n}c")) for n in "uv")
    return same.union(balls.join(u, "u").join(v, "v").select(F.col("uc").alias("u"), F.col("vc").alias("v")))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, radius: int = 2
) -> DataFrame:
    """One row a document: (id_col, fingerprint hex string, component_id, n_links).

    component_id is the smallest id reachable over links of `radius` bits or fewer; n_links counts the
    links of its fingerprint to other fingerprints that the ball hashing kept. Texts without words share
    fingerprint zero and are linked like any other. Rows with a null id keep a row and a component but
    never name one, unless all ids of a component are null. Repeated ids keep all their rows. Copies are
    collapsed to one fingerprint before anything is emitted, so a hot group of copies costs one row.
    """
    prints = stored(fingerprints(docs, id_col, text_col, shingle_words), "prints")
    return _components(prints, radius).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links"
    )


def _components(prints: DataFrame, radius: int) -> DataFrame:
    """prints (id, x, fp) with component (a fingerprint; components may share an id), component_id and n_links."""
    classes = stored(prints.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    links = stored(ball_links(classes.select("fp"), radius), "balls")
    parts = connected_components(links)
    named = parts.join(classes, parts.node == classes.fp).select("node", "component", "least")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ends = links.select(F.col("u").alias("node")).union(links.select(F.col("v").alias("node")))
    degree = ends.groupBy("node").agg(F.count("*").alias("n_links"))
    linked = named.join(least, "component").join(degree, "node").select(F.col("node").alias("fp"), "component", "component_id", "n_links")
    known = classes.join(linked, "fp", "left").select(
        "fp",
        F.coalesce("component", "fp").alias("component"),
        F.coalesce("component_id", "least").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
    known = stored(known, "known")
    return prints.join(known, "fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, radius: int = 2) -> DataFrame:
    """docs with one row of each component of near-duplicates: of the smallest id, and of its texts in the
    component the one of least hash. Different texts of one id are rows of their own. Rows with a null id
    stay, one of each different text."""
    named = docs.filter(F.col(id_col).isNotNull())
    prints = stored(fingerprints(named, id_col, text_col, shingle_words), "prints")
    chosen = _components(prints, radius).groupBy("component").agg(F.min(F.struct("id", "x")).alias("least")).select("least.*")
    kept = rows_of(named, stored(chosen, "chosen"), id_col, text_col)
    return kept.unionByName(docs.filter(F.col(id_col).isNull()).dropDuplicates([text_col]))
