"""Language-model scoring by cross-entropy difference.

A target model (of chosen documents) and a background model (of all documents) are bigram models over the
same vocabulary, the ids of one public tokenizer, and of the same form. A document's score is the mean
over its tokens of the background's loss minus the target's: higher, more like the target. A document is
scored by what the models know without it: its own occurrences are taken off the counts first, or every
document, and those of the target most, would score what it had itself taught.

Every text is encoded once and its ids are kept in the shared folder. All pairs of neighbouring ids that
occur are counted, each by itself, so what is gathered grows with the corpus: sources of documents send
their different pairs to slices of the pairs' hashes, which are one to one, and get the totals back. Only
counts of single ids, as many as the vocabulary has, are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hammerline.llm import bpe, packed
from hammerline.llm.common import released, stored

#: A source has so many ids or documents at least, but for the last of a task; a slice about so many pairs.
SOURCE_IDS, SOURCE_DOCS, SLICE_PAIRS = 500_000, 50_000, 1_000_000
#: Weight of the single ids' probabilities in a pair's.
WEIGHT = 50.0
_ODD = 0x9E3779B97F4A7C15


def _encoded(docs: DataFrame, vocabulary: str, id_col: str, text_col: str) -> DataFrame:
    """(src, keys, sizes, ids): stored sources, a row each, ids packed little-endian."""
    kind_of_id = f"<u{bpe.id_width(vocabulary)}"
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, keys, sizes, ids = TaskContext.get().partitionId() << 32, 0, [], [], []

        def close() -> pa.RecordBatch:
            key = pa.concat_arrays(keys)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(key)], pa.int32()), v) for v in (key, pa.array(np.concatenate(sizes), pa.int32()))]
            columns = [pa.array([part + made], pa.int64()), *lists, pa.array([np.concatenate(ids).tobytes()], pa.large_binary()).cast(pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["src", "keys", "sizes", "ids"])

        for batch in batches:
            for at, found, n in bpe.encoder(vocabulary).slices(batch.column(1)):
                ends, first = np.concatenate([[0], np.cumsum(n)]), 0
                while first < len(n):
                    room = SOURCE_IDS - sum(map(len, ids))
                    last = min(int(np.searchsorted(ends, ends[first] + room)), first + SOURCE_DOCS - sum(map(len, sizes)), len(n))
                    last = max(last, first + 1)
                    keys.append(batch.column(0).slice(at + first, last - first))
                    sizes.append(n[first:last])
                    ids.append(found[ends[first] : ends[last]].astype(kind_of_id))
                    first = last
                    if sum(map(len, ids)) >= SOURCE_IDS or sum(map(len, sizes)) >= SOURCE_DOCS:
                        yield close()
                        made, keys, sizes, ids = made + 1, [], [], []
        if keys:
            yield close()

    return stored(rows.mapInArrow(released(run, keeps=True), f"src long, keys array<{kind}>, sizes array<int>, ids binary"), "encoded", **packed.SHORT_GROUPS)


class _Source:
    """A source's documents as arrays: ids, each one's document, the id before it (`size` before the first),
    and the hash of the pair."""

    def __init__(self, sizes: pa.Array, ids: bytes, size: int):
        self.sizes, self.size = sizes.to_numpy().astype(np.int64), size
        self.ids = np.frombuffer(ids, f"<u{len(ids) // max(1, self.sizes.sum()) or 4}").astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.ends = np.cumsum(self.sizes)
        self.before = np.concatenate([[size], self.ids[:-1]]) if len(self.ids) else self.ids
        self.before[(self.ends - self.sizes)[self.sizes > 0]] = size
        self.hash = (self.before * (size + 1) + self.ids).astype(np.uint64) * np.uint64(_ODD)

    def own(self, values: np.ndarray, room: int) -> np.ndarray:
        """For each token, how often its document has its value (below `room`)."""
        _, entry, n = np.unique(self.doc * room + values, return_inverse=True, return_counts=True)
        return n[entry]


def _sources(batches: Iterator[pa.RecordBatch], size: int, flags: str) -> Iterator[tuple[int, pa.Array, _Source, np.ndarray]]:
    """(src, keys, source, whether each document is of the target)."""
    for batch in batches:
        for k in range(batch.num_rows):
            src = batch.column(0)[k].as_py()
            source = _Source(batch.column(2)[k].values, packed.read_row(batch.column(3)[k].as_py(), src, "ids").as_py(), size)
            chosen = np.zeros(len(source.sizes), bool)
            for at in packed.of_source(flags, src, ["at"]).column("at"):
                chosen[at.values.to_numpy()] = True
            yield src, batch.column(1)[k].values, source, chosen


def _singles(rows: DataFrame, size: int, flags: str) -> np.ndarray:
    """Counts of [background, target][as an id, as what stands before one][id]: as many as the vocabulary has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, 2, size + 1), np.int64)
        for _, _, source, chosen in _sources(batches, size, flags):
            mine = chosen[source.doc]
            for k, values in enumerate((source.ids, source.before)):
                totals[0, k] += np.bincount(values, minlength=size + 1)
                totals[1, k] += np.bincount(values[mine], minlength=size + 1)
        flat = totals.reshape(4, size + 1)
        at = np.flatnonzero(flat[0] + flat[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), *map(pa.array, flat[:, at])], ["id", "a", "b", "c", "d"])

    counts = rows.mapInArrow(run, "id long, a long, b long, c long, d long").groupBy("id").agg(*[F.sum(c).alias(c) for c in "abcd"])
    table, out = counts.toArrow(), np.zeros((4, size + 1))
    for k, c in enumerate("abcd"):
        out[k, table.column("id").to_numpy()] = table.column(c).to_numpy()
    return out.reshape(2, 2, size + 1)


def _ask(src: int, source: _Source, chosen: np.ndarray, bits: int) -> pa.RecordBatch:
    """A source's different pairs, how often it has them, and how often in target documents."""
    pairs, n = np.unique(source.hash, return_counts=True)
    here, times = np.unique(source.hash[chosen[source.doc]], return_counts=True)
    m = np.zeros(len(pairs), "<u4")
    m[np.searchsorted(pairs, here)] = times
    n = n.astype("<u4")
    return packed.sent(src, [(s, pairs[a:b].astype("<u8").tobytes() + n[a:b].tobytes() + m[a:b].tobytes()) for s, a, b in packed.slices(pairs, bits)])


def _answer(table: pa.Table) -> pa.Table:
    """Of one slice: the totals of each source's pairs."""
    table = table.combine_chunks()
    s, srcs, parts = table.column("slice")[0].as_py(), table.column("src").to_pylist(), [b.as_py() for b in table.column("packed")]
    sizes = [len(b) // 16 for b in parts]
    pairs = np.concatenate([np.frombuffer(b, "<u8", n) for b, n in zip(parts, sizes)])
    distinct, entry = np.unique(pairs, return_inverse=True)
    totals = np.zeros((2, len(distinct)), np.int64)
    for k in range(2):
        np.add.at(totals[k], entry, np.concatenate([np.frombuffer(b, "<u4", n, (8 + 4 * k) * n) for b, n in zip(parts, sizes)]))
    kind = "<u4" if totals.max() < 1 << 32 else "<u8"
    rows, at = [], 0
    for src, n in zip(srcs, sizes):
        mine = entry[at : at + n]
        at += n
        rows.append((src, totals[0, mine].astype(kind).tobytes() + totals[1, mine].astype(kind).tobytes()))
    return packed.answers(s, rows)


def _losses(pair, single, before, total, size: int) -> np.ndarray:
    """Nats of P(id | before) = (pair + WEIGHT * P(id)) / (before + WEIGHT), with P(id) = (single + 1) / (total + size)."""
    return -np.log((pair + WEIGHT * (single + 1) / (total + size)) / (before + WEIGHT))


def score(
    docs: DataFrame, targets: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row a document: id_col, n_tokens, target_loss, background_loss (mean nats a token), score (their
    difference, background minus target).

    targets has the chosen ids in its first column. Texts without tokens (null, empty) have null losses and
    score 0. Without targets the target model is uniform. Repeated and null ids keep their rows; a repeated
    id that is chosen is so in all of them, a null one never. A very long text is a source of its own.
    Columns but these two don't matter.
    """
    vocabulary = vocabulary or bpe.default_vocabulary()
    size = bpe.vocabulary_size(vocabulary)
    sources = _encoded(docs, vocabulary, id_col, text_col)
    n_ids = sources.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    bits = packed.slice_bits(n_ids // 2, SLICE_PAIRS)
    wanted = targets.select(F.col(targets.columns[0]).alias("k")).filter("k is not null").distinct()
    rows = sources.select("src", "keys", "sizes", F.col("_metadata.file_path"))
    ids = sources.select("src", F.posexplode("keys").alias("at", "k"))
    # Chosen ids grow with the documents: both sides are dealt by id, and a source gets back where its own lie.
    flags = ids.join(wanted.hint("merge"), "k", "left_semi").groupBy("src").agg(F.collect_list("at").alias("at"))
    flags = packed.by_source(flags, "chosen")
    singles = docs.sparkSession.sparkContext.broadcast(_singles(rows, size, flags))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for src, _, source, chosen in _sources(batches, size, flags):
            yield _ask(src, source, chosen, bits)

    totals = packed.exchange(rows.mapInArrow(released(ask), packed.PACKED), _answer, "pairs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = singles.value
        for src, keys, source, chosen in _sources(batches, size, flags):
            n, means = source.sizes, []
            if len(source.ids):
                pairs, entry = np.unique(source.hash, return_inverse=True)
                found = [np.frombuffer(b, f"<u{len(b) // 2 // (hi - lo)}").reshape(2, -1) for (_, lo, hi), b in zip(packed.slices(pairs, bits), packed.read_answers(totals, src).values(), strict=True)]
                found = np.concatenate(found, axis=1)
                own_pair, own_id, length = source.own(entry, len(pairs)), source.own(source.ids, size), n[source.doc]
                # As what stands before: as often as as an id, but for the text's end.
                last = source.ids[source.ends[source.doc] - 1]
                own_before = np.concatenate([[1], own_id[:-1]]) - (source.before == last)
                own_before[source.before == size] = 1
                for k, off in enumerate((np.ones(len(entry), np.int64), chosen[source.doc].astype(np.int64))):
                    single, before = known[k]
                    total = single.sum()
                    loss = _losses(
                        found[k][entry] - off * own_pair, single[source.ids] - off * own_id, before[source.before] - off * own_before, total - off * length, size
                    )
                    means.append(np.bincount(source.doc, loss, len(n)) / np.maximum(n, 1))
            else:
                means = [np.zeros(len(n)), np.zeros(len(n))]
            background, target = means
            empty = n == 0
            columns = [pa.array(n), pa.array(target, mask=empty), pa.array(background, mask=empty), pa.array(np.where(empty, 0.0, background - target))]
            yield pa.RecordBatch.from_arrays([keys, *columns], [id_col, "n_tokens", "target_loss", "background_loss", "score"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return rows.mapInArrow(released(run), f"`{id_col}` {kind}, n_tokens long, target_loss double, background_loss double, score double")
