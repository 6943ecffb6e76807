"""Benchmark decontamination: scan documents for word windows of benchmark items."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hammerline.llm.common import free_name, released, stored
from hammerline.llm.substring import Rolling

#: Bytes of a UTF-8 text to word bytes: A-Z lower-cased; 0-9, a-z and all non-ASCII stay; the rest separates.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Windows:
    """The windows of a set of items, and where they occur in a document.

    Of each length of windows the index is three arrays in order of the windows' 64-bit hashes: hash, place
    in the items' words, item; 20 bytes a window. A document's rolling hashes probe it, and every hit is
    compared word by word.
    """

    def __init__(self, items: Iterable[tuple[str | None, str | None]], size: int):
        self.names: list[str | None] = []
        blob, found = [], {}
        at = 0
        for item, text in items:
            words = words_of(text)
            n = min(size, len(words))
            if not n:
                continue
            ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))
            starts = at + np.concatenate([[0], ends[:-1]])[: len(words) - n + 1]
            found.setdefault(n, []).append((Rolling(words).runs(n), starts, np.full(len(starts), len(self.names), np.int32)))
            blob.append(b"".join(w + b" " for w in words))
            at += int(ends[-1])
            self.names.append(item)
        self.blob, self.tables = b"".join(blob), {}
        for n in sorted(found):
            columns = [np.concatenate(c) for c in zip(*found.pop(n))]
            order = np.argsort(columns[0], kind="stable")
            self.tables[n] = [c[order] for c in columns]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Spans (start, end) of all windows that occur, in order of their length, and their items."""
        spans, items = [], set()
        rolling = Rolling(words) if words and self.tables else None
        for n, (hashes, places, owners) in self.tables.items() if rolling else ():
            own = rolling.runs(n)
            first = np.searchsorted(hashes, own)
            for i in np.flatnonzero(hashes[np.minimum(first, len(hashes) - 1)] == own).tolist():
                wanted, hit = b"".join(w + b" " for w in words[i : i + n]), False
                last = int(np.searchsorted(hashes, own[i], side="right"))
                for k in range(int(first[i]), last):
                    name = self.names[owners[k]]
                    if (not hit or name not in items) and self.blob.startswith(wanted, int(places[k])):
                        items.add(name)
                        hit = True
                if hit:
                    spans.append((i, i + n))
        return spans, items


def find_windows(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    slice_chars: int = 32_000_000,
) -> DataFrame:
    """docs, all columns kept, and last contamination struct<n_words, n_hit, items array<string>,
    spans array<struct<start, end>>, rest> (word positions, merged and in order; rest is the text without the
    spans and what lies between their words, null where there are none). Where docs have a column of that
    name the last column has an underscore more.

    The benchmark's texts and the sorted hashes of their windows are broadcast, at most `slice_chars`
    characters of them: five to seven bytes a character. A larger one is cut into slices of items of that
    size; the documents are scanned slice by slice and the hits are merged, so memory stays bounded and no
    window is lost. An item is never cut, so one that is larger than that makes a larger slice. Null texts and items without
    words match nothing; an item with a null id marks words but is in no list.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).cast("string").alias("t"))
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    slices = -(-total // slice_chars)
    found = docs.withColumn(free_name(docs, "contamination"), F.lit(None).cast(_HITS))
    for k in range(max(1, slices)):
        part = items if slices <= 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(slices)) == k)
        found = _scan(found, Windows(((r.i, r.t) for r in part.toLocalIterator()), size), text_col)
        found = stored(found, "scanned") if k + 1 < slices else found
    return found


_HITS = "struct<n_words: bigint, n_hit: bigint, items: array<string>, spans: array<struct<start: int, end: int>>, rest: string>"


def _scan(docs: DataFrame, index: Windows, text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)
    at, schema = docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches:
            hits = []
            for text, old in zip(batch.column(at), batch.column(batch.num_columns - 1)):
                words = words_of(text.as_py())
                spans, found = windows.scan(words)
                if old.is_valid:
                    old = old.as_py()
                    spans += [(s["start"], s["end"]) for s in old["spans"]]
                    found |= set(old["items"])
                spans = merged(spans)
                n_hit = sum(b - a for a, b in spans)
                ids = sorted(i for i in found if i is not None)
                hits.append({"n_words": len(words), "n_hit": n_hit, "items": ids, "spans": [{"start": a, "end": b} for a, b in spans], "rest": cut_words(text.as_py(), spans) if spans else None})
            kind = batch.schema.field(batch.num_columns - 1).type
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(hits, kind)], schema=batch.schema)

    return docs.mapInArrow(released(run), schema)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    c = F.col(f"`{found.columns[-1]}`")
    return found.select(
        id_col,
        c.n_words.alias("n_words"),
        c.n_hit.alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", c["items"]), 256).alias("items_sha256"),
        (c.n_hit > 0).alias("contaminated"),
    )


def without_hits(found: DataFrame, text_col: str = "text", most_share: float = 0.5) -> DataFrame:
    """Documents without their contaminated words: a span goes with all that lies between its words, and
    documents of which more than `most_share` of the words are hit go whole. Clean ones stay as they are."""
    c = F.col(f"`{found.columns[-1]}`")
    left = found.filter(c.n_hit <= most_share * c.n_words)
    return left.withColumn(text_col, F.coalesce(c.rest, F.col(text_col))).drop(found.columns[-1])


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (word positions) and what lies between them."""
    raw = text.encode("utf-8", "surrogatepass")
    places, at = [], 0
    for piece in raw.translate(_FOLD).split(b" "):
        if piece:
            places.append((at, at + len(piece)))
        at += len(piece) + 1
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : places[a][0]])
        last = places[b - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")
