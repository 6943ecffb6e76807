"""Substring deduplication by fixed-block anchors.

A word is removed if a window of `window` words that covers it also starts in a document with a smaller
id. Non-overlapping reference blocks of half that length are indexed; any window holds one of them whole,
so a repeated window shows a reference block of one document among the rolling blocks of the other. All
rolling blocks probe the index; windows around hits are then compared whole, each with the smallest id
that has it, and the runs of hit windows are the maximal exact repeats.

Probes are many, so they travel packed. Documents are dealt into sources of some megabytes of text, one
row of a stored table each. A source sends every slice of the hash space one row: its distinct hashes of
that slice, sorted. The answer to a source is again a few rows, which its next pass reads from the shared
folder by the source's number. Texts are never shuffled, a passage that a third of all documents share is
one hash of each source, and no pair of documents is ever listed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hammerline.llm import packed
from hammerline.llm.common import free_name, released, stored

#: The multiplier of the rolling hash (fixed value: an odd 64-bit number) and its inverse modulo 2**64.
_K = 0x9E3779B97F4A7C15
_K_INVERSE = pow(_K, -1, 1 << 64)

_WORD = re.compile(rb"[^ \t-\r]+")

SOURCE_BYTES = 4_000_000
#: What a row counts beside its text, so that sources of empty texts are bounded too.
ROW_BYTES = 16
SLICE_WORDS = 1_000_000


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the multiplier and of its inverse."""
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, k, np.uint64))]) for k in (_K, _K_INVERSE))


@cache
def _some_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << 16)


def _spread(h: np.ndarray) -> np.ndarray:
    """Mixes a rolling hash so that all of its bits count (usual fixed multipliers)."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Rolling:
    """Hashes of all runs of consecutive words of a document."""

    def __init__(self, words: list[bytes]):
        n = len(words)
        up, self.down = _some_powers() if n <= 1 << 16 else _powers(n)
        each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
        self.n, self.sums = n, np.concatenate([np.zeros(1, np.uint64), np.cumsum(each * up[:n])])

    def runs(self, length: int, at: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the runs of that length that start at the positions (default: all)."""
        if at is None:
            n = max(0, self.n - length + 1)
            return _spread((self.sums[length : length + n] - self.sums[:n]) * self.down[:n])
        return _spread((self.sums[at + length] - self.sums[at]) * self.down[at])


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, as UTF-8 bytes."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def to_sources(docs: DataFrame, text_col: str) -> DataFrame:
    """(src, n_bytes, n_docs, docs: the documents' rows): each row some megabytes of text, stored."""
    at = docs.columns.index(text_col)
    row = docs.limit(0).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, size = TaskContext.get().partitionId() << 32, 0, [], 0
        kind = pa.list_(pa.struct(list(row)))

        def close() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            rows = table.to_struct_array()
            rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
            offsets = pa.array([0, len(rows)], pa.int32())
            return pa.RecordBatch.from_arrays(
                [*(pa.array([n], pa.int64()) for n in (part + made, size, len(rows))), pa.ListArray.from_arrays(offsets, rows).cast(kind)],
                ["src", "n_bytes", "n_docs", "docs"],
            )

        for batch in batches:
            sizes = [len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(at)]
            start = 0
            for i, n in enumerate(sizes):
                size += n + ROW_BYTES
                if size >= SOURCE_BYTES or i + 1 == len(sizes):
                    held.append(batch.slice(start, i + 1 - start))
                    start = i + 1
                    if size >= SOURCE_BYTES:
                        yield close()
                        made, held, size = made + 1, [], 0
        if held:
            yield close()

    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.schema)
    return stored(docs.mapInArrow(released(run), f"src long, n_bytes long, n_docs long, docs array<struct<{fields}>>"), "sources")


class _Source:
    """A source's documents that have a window: their numbers, ids and rolling hashes."""

    def __init__(self, rows: pa.Array, id_at: int, text_at: int, window: int):
        self.ids, self.texts = rows.field(id_at).to_pylist(), rows.field(text_at)
        self.window = window

    def __iter__(self) -> Iterator[tuple[int, int, Rolling]]:
        for k, key in enumerate(self.ids):
            if key is not None:
                words = split_words(self.texts[k].as_py())
                if len(words) >= self.window:
                    yield k, key, Rolling(words)


def _sources(batches: Iterator[pa.RecordBatch], id_at: int, text_at: int, window: int) -> Iterator[tuple[int, pa.Array, _Source]]:
    for batch in batches:
        for k in range(batch.num_rows):
            rows = batch.column(1)[k].values
            yield batch.column(0)[k].as_py(), rows, _Source(rows, id_at, text_at, window)


def _probe(src: int, source: _Source, block: int, bits: int) -> pa.RecordBatch:
    """Distinct rolling block hashes, 32 bits behind those of the slice, each with two marks: it is a
    reference block here; it occurs twice or more here."""
    found = []
    for _, _, rolling in source:
        h = rolling.runs(block) >> np.uint64(32 - bits)
        marks = np.zeros(len(h), np.uint64)
        marks[::block] = 1
        found.append(h << np.uint64(1) | marks)
    if not found:
        return packed.sent(src, [])
    all_of = np.sort(np.concatenate(found))
    h = all_of >> np.uint64(1)
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    marks = np.maximum.reduceat(all_of & np.uint64(1), first).astype(bool)
    twice = np.diff(np.append(first, len(h))) > 1
    h, parts = h[first], []
    for s, a, b in packed.slices(h << np.uint64(32 - bits), bits):
        low = (h[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4")
        parts.append((s, low.tobytes() + np.packbits(marks[a:b]).tobytes() + np.packbits(twice[a:b]).tobytes()))
    return packed.sent(src, parts)


def _unpack_probe(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = next(n for n in range(max(0, 4 * len(raw) // 17 - 2), len(raw) // 4 + 1) if 4 * n + 2 * (-(-n // 8)) == len(raw))
    marks = np.frombuffer(raw, "u1", offset=4 * n)
    half = len(marks) // 2
    return np.frombuffer(raw, "<u4", n), np.unpackbits(marks[:half], count=n).astype(bool), np.unpackbits(marks[half:], count=n).astype(bool)


def _answer_probes(table: pa.Table) -> pa.Table:
    """Of one slice: each source gets its hashes that are a reference block somewhere and occur twice or more."""
    table = table.combine_chunks()
    s, srcs = table.column("slice")[0].as_py(), table.column("src").to_pylist()
    parts = [_unpack_probe(b.as_buffer().to_pybytes()) for b in table.column("packed")]
    h = np.concatenate([p[0] for p in parts])
    order = np.argsort(h, kind="stable")
    h, marks = h[order], np.concatenate([p[1] for p in parts])[order]
    times = np.concatenate([p[2] for p in parts])[order].astype(np.int64) + 1
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    shared = h[first][np.logical_or.reduceat(marks, first) & (np.add.reduceat(times, first) > 1)]
    rows = []
    for src, part in zip(srcs, parts):
        mine = part[0][np.isin(part[0], shared, assume_unique=True)]
        if len(mine):
            rows.append((src, (mine.astype("<u8") | np.uint64(s << 32)).tobytes()))
    return packed.answers(s, rows)


class _Candidates:
    """The windows of a source that hold a shared block: distinct hashes in order, each with the least
    id that has it here, and all (hash, document, position)."""

    def __init__(self, source: _Source, folder: str, src: int, block: int, bits: int):
        window, shared = source.window, np.sort(np.frombuffer(b"".join(packed.read_answers(folder, src).values()), "<u8"))
        hashes, owners, positions, ids = [], [], [], []
        for k, key, rolling in source if len(shared) else ():
            h = rolling.runs(block) >> np.uint64(32 - bits)
            at = np.minimum(np.searchsorted(shared, h), len(shared) - 1)
            reach = np.concatenate([[0], np.cumsum(shared[at] == h)])
            n, span = rolling.n - window + 1, window - block + 1
            start = np.flatnonzero(reach[span : span + n] > reach[:n])
            if len(start):
                hashes.append(rolling.runs(window, start))
                owners.append(np.full(len(start), k, np.int64))
                ids.append(np.full(len(start), key, np.int64))
                positions.append(start)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        self.hashes, self.owners, self.positions, self.ids = join(hashes, np.uint64), join(owners, np.int64), join(positions, np.int64), join(ids, np.int64)
        self.distinct, self.entry = np.unique(self.hashes, return_inverse=True)
        self.least = np.full(len(self.distinct), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.entry, self.ids)


def _offer(src: int, found: _Candidates, bits: int) -> pa.RecordBatch:
    """Distinct windows of each slice and their least id here, as a number in a list of ids."""
    parts = []
    for s, a, b in packed.slices(found.distinct, bits):
        names, number = np.unique(found.least[a:b], return_inverse=True)
        width = "<u2" if len(names) < 1 << 16 else "<u4"
        head = np.array([b - a, len(names), int(width[-1])], "<u4").tobytes()
        parts.append((s, head + found.distinct[a:b].astype("<u8").tobytes() + names.astype("<i8").tobytes() + number.astype(width).tobytes()))
    return packed.sent(src, parts)


def _answer_offers(table: pa.Table) -> pa.Table:
    """Of one slice: a bit for each window of each source, 1 if another source has it with a smaller id."""
    table = table.combine_chunks()
    s, srcs, hashes, least = table.column("slice")[0].as_py(), table.column("src").to_pylist(), [], []
    for b in table.column("packed"):
        raw = b.as_buffer().to_pybytes()
        n, m, width = np.frombuffer(raw, "<u4", 3).tolist()
        hashes.append(np.frombuffer(raw, "<u8", n, 12))
        names = np.frombuffer(raw, "<i8", m, 12 + 8 * n)
        least.append(names[np.frombuffer(raw, f"<u{width}", n, 12 + 8 * (n + m))])
    h, ids = np.concatenate(hashes), np.concatenate(least)
    distinct, entry = np.unique(h, return_inverse=True)
    best = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(best, entry, ids)
    smaller, rows, at = best[entry] < ids, [], 0
    for src, part in zip(srcs, hashes):
        mine = smaller[at : at + len(part)]
        at += len(part)
        if mine.any():
            rows.append((src, np.packbits(mine).tobytes()))
    return packed.answers(s, rows)


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns kept, and last repeats struct<n_words, n_removed, kept, spans, rest>: the words left,
    joined by one space; the removed runs of words (start, end); and the text without them, all else as it
    was, null where none is removed. Where docs have a column of that name the last
    column has an underscore more.

    Windows are judged on the input. Null and short texts keep their words. Rows of one id count as one
    document, so they never remove each other's words; a row with a null id is left alone and removes
    nothing. 64-bit hashes stand for windows: among n different windows about n * n / 2**65 collide.
    """
    if window < 3:
        raise ValueError("a window has 3 words or more")
    block = (window + 1) // 2
    result = free_name(docs, "repeats")
    docs = docs.withColumns({text_col: F.col(text_col).cast("string"), id_col: F.col(id_col).cast("long")})
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    sources = to_sources(docs, text_col)
    n_bytes = sources.agg(F.sum("n_bytes")).first()[0] or 0
    bits = packed.slice_bits(n_bytes // 6, SLICE_WORDS)
    rows = sources.select("src", "docs")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for src, _, source in _sources(batches, id_at, text_at, window):
            yield _probe(src, source, block, bits)

    shared = packed.exchange(rows.mapInArrow(released(probe), packed.PACKED), _answer_probes, "anchors")

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for src, _, source in _sources(batches, id_at, text_at, window):
            yield _offer(src, _Candidates(source, shared, src, block, bits), bits)

    earlier = packed.exchange(rows.mapInArrow(released(offer), packed.PACKED), _answer_offers, "windows")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for src, table, source in _sources(batches, id_at, text_at, window):
            found = _Candidates(source, shared, src, block, bits)
            bit, answers = np.zeros(len(found.distinct), bool), packed.read_answers(earlier, src)
            for s, a, b in packed.slices(found.distinct, bits):
                if s in answers:
                    bit[a:b] = np.unpackbits(np.frombuffer(answers[s], "u1"), count=b - a)
            hit = bit[found.entry] | (found.ids > found.least[found.entry])
            owners, starts = found.owners[hit], found.positions[hit]
            edges = np.searchsorted(owners, np.arange(len(table) + 1))
            for a in range(0, len(table), 2000):
                part = table.slice(a, 2000)
                results = [_cut(t.as_py(), starts[edges[a + k] : edges[a + k + 1]], window) for k, t in enumerate(part.field(text_at))]
                yield pa.RecordBatch.from_arrays([*part.flatten(), pa.array(results, _REPEATS)], [*names, result])

    names = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    kind = "struct<n_words: bigint, n_removed: bigint, kept: string, spans: array<struct<start: int, end: int>>, rest: string>"
    return rows.mapInArrow(released(extend), f"{fields}, `{result}` {kind}")


_REPEATS = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("kept", pa.string()),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ("rest", pa.string()),
    ]
)


def _cut(text: str | None, starts: np.ndarray, window: int) -> dict:
    words = split_words(text)
    spans: list[dict] = []
    if len(starts):
        new = np.flatnonzero(np.concatenate([[True], starts[1:] > starts[:-1] + window]))
        last = np.append(new[1:], len(starts)) - 1
        spans = [{"start": int(a), "end": int(b) + window} for a, b in zip(starts[new], starts[last])]
    kept, at = [], 0
    for span in spans:
        kept += words[at : span["start"]]
        at = span["end"]
    kept += words[at:]
    rest = cut_words(text, [(s["start"], s["end"]) for s in spans]) if spans else None
    return {"n_words": len(words), "n_removed": len(words) - len(kept), "kept": b" ".join(kept).decode("utf-8", "surrogatepass"), "spans": spans, "rest": rest}


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the white space between them."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [(m.start(), m.end()) for m in _WORD.finditer(raw)]
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : places[a][0]])
        last = places[b - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")


def without_repeats(found: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents of remove_repeats without the removed words, all else as it was; those of which no word
    is left go, those that had none stay."""
    r = F.col(f"`{found.columns[-1]}`")
    left = found.filter((r.n_removed < r.n_words) | (r.n_words == 0))
    return left.withColumn(text_col, F.coalesce(r.rest, F.col(text_col))).drop(found.columns[-1])
