"""Best-fit packing of documents into training sequences by large-item matching.

Lengths are small integers, so the packing is planned for the histogram of lengths (one row a length,
whatever the corpus holds) and is the same for all pieces at once: no group of documents is packed apart
from another. Each piece then finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hammerline.llm import bpe
from hammerline.llm.common import released, stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Packs counts[length] pieces of each length; returns runs (length, first rank, pieces, first
    sequence, pieces a sequence, offset): the pieces of that length and rank lie in that sequence, so
    many in each, from that offset on.

    Lengths above a third of the capacity go at most twice into a sequence: the longest first, each with
    the longest that still fits. Smaller ones follow from the longest down, each into the sequence with
    the smallest gap that holds it (best fit), or into a new one.
    """
    left = {n: c for n, c in counts.items() if c}
    large = sorted(n for n in left if 3 * n > capacity)
    taken: Counter[int] = Counter()
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: ranges of sequences (first, how many) with it
    sizes: list[int] = []  # the gaps that there are, in order
    sequences = 0

    def put(n: int, first: int, many: int, each: int, offset: int, total: int) -> None:
        runs.append((n, taken[n], total, first, each, offset))
        taken[n] += total

    def leave(gap: int, first: int, many: int) -> None:
        if gap and many:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, many))

    while large:
        a = large[-1]
        fit = bisect_left(large, capacity - a + 1) - 1
        if fit < 0:  # nothing large fits beside it
            many = left[a]
            put(a, sequences, many, 1, 0, many)
            leave(capacity - a, sequences, many)
        elif (b := large[fit]) == a:
            many = left[a] // 2
            if many:
                put(a, sequences, many, 2, 0, 2 * many)
                leave(capacity - 2 * a, sequences, many)
                sequences += many
            if not left[a] % 2:
                large.pop()
                continue
            left[a] = 1
            fit = bisect_left(large, a) - 1
            many = 1
            put(a, sequences, 1, 1, 0, 1)
            if fit >= 0 and a + large[fit] <= capacity:
                b = large[fit]
                put(b, sequences, 1, 1, a, 1)
                leave(capacity - a - b, sequences, 1)
                left[b] -= 1
                if not left[b]:
                    large.pop(fit)
            else:
                leave(capacity - a, sequences, 1)
        else:
            many = min(left[a], left[b])
            put(a, sequences, many, 1, 0, many)
            put(b, sequences, many, 1, a, many)
            leave(capacity - a - b, sequences, many)
            left[b] -= many
            if not left[b]:
                large.pop(fit)
        sequences += many
        left[a] -= many
        if not left[a]:
            large.remove(a)

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        want = left[n]
        while want:
            at = bisect_left(sizes, n)
            if at == len(sizes):  # no gap holds it: new sequences, filled with this length
                each = capacity // n
                many = -(-want // each)
                leave(capacity, sequences, many)
                sequences += many
                continue
            gap = sizes[at]
            first, many = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                sizes.pop(at)
            each = min(gap // n, want)
            use = min(many, want // each)
            put(n, first, use, each, capacity - gap, use * each)
            want -= use * each
            leave(gap - each * n, first, use)
            leave(gap, first + use, many - use)
    return runs


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full ones behind a first that may be shorter."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))] if n else []


def pieces(
    docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0
) -> DataFrame:
    """Encodes every whole text (null: empty), appends end_id, and cuts what exceeds the capacity.

    part and nth number the pieces of a length within the task that made them.
    """
    vocabulary = vocabulary or bpe.default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        part = TaskContext.get().partitionId()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, ids, sizes in bpe.encoder(vocabulary).slices(batch.column(1)):
                ids, rows, at = memoryview(bpe.ended(ids, sizes, end_id)).cast("B"), [], 0
                for key, size in zip(keys[first:], (sizes + 1).tolist()):
                    for k, (start, n) in enumerate(cut(size, capacity)):
                        a = 4 * (at + start)
                        rows.append((key, k, start, n, zlib.crc32(ids[a : a + 4 * n]), part, seen[n]))
                        seen[n] += 1
                    at += size
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(released(run, keeps=True), PIECES)


def place(found: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces (length, part, nth; any others)."""
    parts = found.groupBy("length", "part").agg(F.count("*").alias("n"))
    parts = stored(parts, "parts")
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a length
    runs = np.array(plan(counts, capacity) or np.empty((0, 6)), dtype=np.int64)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = parts.select("length", "part", before.alias("base"))
    # Rows of a task and a length are many and short and grow with the corpus: dealt by both, never broadcast.
    ranked = found.join(bases.hint("shuffle_hash"), ["length", "part"]).withColumn("rank", F.col("nth") + F.col("base"))
    kept = [c for c in found.columns if c not in ("part", "nth")]
    shared = found.sparkSession.sparkContext.broadcast(runs)  # a few rows for each length up to the capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        starts = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = table[np.searchsorted(starts, (length << 44) + rank, "right") - 1]
            nth, each = rank - at[:, 1], np.maximum(at[:, 4], 1)
            places = [pa.array(at[:, 3] + nth // each), pa.array(at[:, 5] + nth % each * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *places], [*kept, "sequence_id", "offset"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name in kept)
    return ranked.select(*kept, "rank").mapInArrow(released(run), f"{kind}, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (gapless from 0).

    A document of n ids (its end id included) above the capacity becomes full pieces behind a first one
    that may be shorter; all others stay whole. Null and empty texts are pieces of one id. Repeated ids
    are packed as the rows they are; rows with a null id keep it.
    """
    return place(stored(pieces(docs, capacity, vocabulary, id_col, text_col), "pieces"), capacity)


def sequences(docs: DataFrame, packed: DataFrame, vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves. docs (doc_id unique, text) are encoded anew
    and their pieces meet by sequence, which holds one capacity of ids at most."""
    vocabulary = vocabulary or bpe.default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, ids, sizes in bpe.encoder(vocabulary).slices(batch.column(1)):
                ends = np.concatenate([[0], np.cumsum(sizes + 1)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bpe.ended(ids, sizes, end_id), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sizes)), lists], ["doc_id", "ids"])

    encoded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("t")).mapInArrow(run, "doc_id long, ids array<bigint>")
    parts = packed.join(encoded, "doc_id").select(
        "sequence_id", "offset", F.slice("ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("ids")
    )
    joined = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return joined.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
