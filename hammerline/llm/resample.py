"""Importance resampling towards a target: documents are drawn by how much their n-grams favour it.

N-grams are hashed into buckets by CRC-32, which comes from prefix CRCs (see prefixcrc): a document is
scanned once and the buckets of its n-grams are stored packed. Bucket counts of corpus and target give
each bucket a gain; a document's weight is its mean gain, and the draw is without replacement, by Gumbel
noise that only the seed and the document's id decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hammerline.llm import prefixcrc
from hammerline.llm.common import released, stored


def _buckets(text: str | None, most: int, n_buckets: int) -> tuple[int, np.ndarray]:
    """Number of words; the bucket of every n-gram. A text is taken span by span, so n-grams of more than
    two words, which could reach over more than one border, take it whole."""
    kind = np.uint16 if n_buckets <= 1 << 16 else np.uint32
    n, found = 0, []
    parts = prefixcrc.spans(text) if most <= 2 else [(w, False)] if (w := [x for p, again in prefixcrc.spans(text) for x in (p[1:] if again else p)]) else []
    for words, again in parts:
        n += len(words) - again
        found.append((prefixcrc.ngram_crcs(words, most, again) % np.uint32(n_buckets)).astype(kind))
    return n, np.concatenate(found) if found else np.empty(0, kind)


def _features(rows: DataFrame, most: int, n_buckets: int) -> DataFrame:
    """rows (id, text) to (id, n_words, packed: the buckets of all n-grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # some megabytes of packed buckets at a time
                words, packed, size, start = [], [], 0, at
                while at < batch.num_rows and size < 1 << 22:
                    n, found = _buckets(batch.column(1)[at].as_py(), most, n_buckets)
                    words.append(n)
                    packed.append(found.tobytes())
                    size, at = size + found.nbytes, at + 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, at - start), pa.array(words, pa.int64()), pa.array(packed, pa.binary())], ["id", "n_words", "packed"]
                )

    return rows.mapInArrow(released(run), "id long, n_words long, packed binary")


def _counts(features: DataFrame, n_buckets: int) -> np.ndarray:
    """How often each bucket occurs. Tasks send a row a bucket; the sums, as many as buckets, go to the driver."""
    kind = "<u2" if n_buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=n_buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    sums = features.select("packed").mapInArrow(released(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(n_buckets, np.int64)
    for r in sums.collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share of the target against that of the corpus."""
    k, s_all, t_all = float(len(corpus)), float(corpus.sum()), float(target.sum())
    of = lambda s, t: math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k))))
    return np.array([of(s, t) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def _weighed(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight); at most as many gains as buckets travel to the tasks."""
    shared = features.sparkSession.sparkContext.broadcast(gain)
    kind = "<u2" if len(gain) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x.as_buffer(), kind) for x in batch.column(2)]
            sums = [int(shared.value[f].sum()) // len(f) if len(f) else 0 for f in found]
            sizes = pa.array([len(f) for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], sizes, pa.array(sums, pa.int64())], ["id", "n_words", "n_features", "weight"])

    return features.mapInArrow(released(run), "id long, n_words long, n_features long, weight long")


def importance(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    most: int = 2,
    n_buckets: int = 10_000,
    least_words: int = 20,
    percent: int = 25,
    seed: int = 7,
) -> DataFrame:
    """One row a document: id_col, n_features, weight, score, rank (null where it isn't drawn).

    Of the documents with an id and `least_words` words or more, `percent` in a hundred are drawn, by score,
    ties by the smaller id. Texts are whole; null and wordless ones have no features and weight 0. A null id
    has no noise, so its score and rank are null. Repeated ids are rows of their own; equal rows take ranks
    one after another. Empty tables give no rows, an empty target no counts. Very long texts are taken in
    spans of a megabyte.
    """
    if not 1 <= n_buckets < 1 << 32:
        raise ValueError("buckets number from 1 to 2**32 - 1")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    features = stored(_features(rows, most, n_buckets), "features")
    wanted = target.select(F.lit(0).cast("long").alias("id"), F.col(target_text_col).cast("string").alias("t"))
    gain = gains(_counts(features, n_buckets), _counts(_features(wanted, most, n_buckets), n_buckets))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    scored = _weighed(features, gain).withColumn("score", (F.col("weight") + noise).cast("long"))
    return _drawn(stored(scored, "scored"), least_words, percent).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def _drawn(scored: DataFrame, least_words: int, percent: int) -> DataFrame:
    """Ranks without a global sort. Scores are whole thousandths of logarithms, of which there are at most
    some 200,000 different ones however many documents there are; their counts give each score its first
    rank and the score at which the draw ends. Documents of one score are ordered among themselves."""
    fit = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    counts = scored.filter(fit).groupBy("score").count().collect()
    total, seen, firsts = sum(r["count"] for r in counts), 0, []
    drawn = percent * total // 100
    for r in sorted(counts, key=lambda r: -r["score"]):
        if seen < drawn:
            firsts.append((r["score"], seen))
        seen += r["count"]
    none = F.lit(None).cast("long")
    if not firsts:
        return scored.withColumn("rank", none)
    first = F.broadcast(scored.sparkSession.createDataFrame(firsts, "score long, first long"))
    end = firsts[-1][0]
    within = F.row_number().over(Window.partitionBy("score").orderBy("id", "weight", "n_features"))
    near = scored.filter(fit & (F.col("score") >= end)).withColumn("place", within).join(first, "score").withColumn("rank", F.col("first") + F.col("place"))
    near = near.select(*scored.columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return scored.filter(~F.coalesce(fit & (F.col("score") >= end), F.lit(False))).withColumn("rank", none).unionByName(near)
