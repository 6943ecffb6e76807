"""Exact duplicates: counting quotient filters say which fingerprints repeat, bytes say which texts do.

Documents are dealt into sources of some megabytes. Each source builds counting quotient filters of its
texts' fingerprints, one for each slice of the hash space; the filters of a slice merge by their sorted
remainders, without loss. A source learns which of its fingerprints have a count above one. Only those
texts go on, each different one once a source, and are grouped by their bytes. Other texts never move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hammerline.llm import packed
from hammerline.llm.common import discard, free_name, released, stored
from hammerline.llm.quotient import QuotientFilter
from hammerline.llm.substring import to_sources

#: Fingerprints in a slice, about.
SLICE_PRINTS = 1_000_000


def normalised(text: str | None) -> bytes:
    """A-Z lower-cased, in UTF-8; nothing else changes. Null: empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _prints(texts: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(normalised(t.as_py())) for t in texts), np.uint64, len(texts))


def _filters(fps: np.ndarray, bits: int) -> list[tuple[int, bytes]]:
    """(slice, filter) of a source's fingerprints."""
    distinct, counts = np.unique(fps, return_counts=True)
    return [(s, QuotientFilter.build(distinct[a:b], counts[a:b], bits).to_bytes()) for s, a, b in packed.slices(distinct, bits)]


def _answer(table: pa.Table) -> pa.Table:
    """Of one slice: a bit for each entry of each source's filter, 1 if its count over all sources is above one."""
    s, srcs = table.column("slice")[0].as_py(), table.column("src").to_pylist()
    filters = [QuotientFilter.from_bytes(b.as_buffer().to_pybytes()) for b in table.column("packed")]
    held, counts = QuotientFilter.merge(filters).entries()
    repeated, rows = held[counts > 1], []
    for src, each in zip(srcs, filters):
        mine = np.isin(each.entries()[0], repeated, assume_unique=True)
        if mine.any():
            rows.append((src, np.packbits(mine).tobytes()))
    return packed.answers(s, rows)


_OWN = pa.schema([("sha", pa.string()), ("cls", pa.int64()), ("lead", pa.bool_()), ("n", pa.int64()), ("top", pa.int64()), ("bytes", pa.binary())])


def _routed(ids: list, texts: pa.Array, src: int, answers: dict[int, bytes], bits: int) -> list[pa.Array]:
    """Columns of _OWN for a source's rows. Texts whose fingerprint repeats get a class by their bytes; the
    class's row of the largest id (the first of several) leads it and carries bytes, rows and largest id."""
    fps = _prints(texts)
    distinct, entry = np.unique(fps, return_inverse=True)
    flagged = np.zeros(len(distinct), bool)
    for s, a, b in packed.slices(distinct, bits):
        if s in answers:
            flagged[a:b] = np.unpackbits(np.frombuffer(answers[s], np.uint8), count=b - a)
    digests, of, rows = [], [None] * len(ids), {}
    for k, (t, go) in enumerate(zip(texts, flagged[entry].tolist())):
        norm = normalised(t.as_py())
        if not go:
            digests.append(hashlib.sha256(norm).hexdigest())
            continue
        if norm not in rows:
            rows[norm] = [len(rows), hashlib.sha256(norm).hexdigest(), k, 0]
        found = rows[norm]
        of[k] = found[0]
        digests.append(found[1])
        found[3] += 1
        if ids[k] is not None and (ids[found[2]] is None or ids[k] > ids[found[2]]):
            found[2] = k
    leads = {x[2]: (norm, x[3]) for norm, x in rows.items()}
    nothing = (None, None)
    first = src >> 32 << 34 | (src & ((1 << 32) - 1)) << 18  # a source has under 2**18 rows
    return [
        pa.array(digests, pa.string()),
        pa.array([None if c is None else first + c for c in of], pa.int64()),
        pa.array([k in leads for k in range(len(ids))], pa.bool_()),
        pa.array([leads.get(k, nothing)[1] for k in range(len(ids))], pa.int64()),
        pa.array([ids[k] if k in leads else None for k in range(len(ids))], pa.int64()),
        pa.array([leads.get(k, nothing)[0] for k in range(len(ids))], pa.binary()),
    ]


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """docs (or the named columns of them), and last copies struct<keep_id, group_size, kept, text_sha256>.
    Where docs have a column of that name the last column has an underscore more.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row of
    the largest id is kept, of several rows of that id one. Rows with a null id are counted in group_size
    and kept only where no equal text has an id (then one of them, with a null keep_id). Very long texts are
    read whole; an empty table gives no rows.
    """
    columns = docs.columns if columns is None else columns
    result = free_name(docs, "copies")
    docs = docs.withColumns({text_col: F.col(text_col).cast("string"), id_col: F.col(id_col).cast("long")})
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    carried = [docs.columns.index(c) for c in columns]
    sources = to_sources(docs, text_col)
    bits = packed.slice_bits(sources.agg(F.sum("n_docs")).first()[0] or 0, SLICE_PRINTS)
    rows = sources.select("src", "docs")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield packed.sent(batch.column(0)[k].as_py(), _filters(_prints(batch.column(1)[k].values.field(text_at)), bits))

    repeated = packed.exchange(rows.mapInArrow(released(probe), packed.PACKED), _answer, "repeated")
    names = [f"c{i}" for i in range(len(carried))]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                src, table = batch.column(0)[k].as_py(), batch.column(1)[k].values
                own = _routed(table.field(id_at).to_pylist(), table.field(text_at), src, packed.read_answers(repeated, src), bits)
                fields = table.flatten()
                yield pa.RecordBatch.from_arrays([*(fields[i] for i in carried), fields[id_at], *own], [*names, "id", *_OWN.names])

    kinds = ", ".join(f"{n} {docs.schema[i].dataType.simpleString()}" for n, i in zip(names, carried))
    own = "id long, sha string, cls long, lead boolean, n long, top long, bytes binary"
    routed = stored(rows.mapInArrow(released(route), f"{kinds}, {own}"), "routed")
    discard(sources)
    leads = routed.filter("lead").select("cls", "n", "top", "bytes")
    least = F.lit(-(1 << 63))
    groups = leads.groupBy("bytes").agg(F.max("top").alias("keep_id"), F.max_by("cls", F.coalesce("top", least)).alias("best"), F.sum("n").alias("group_size"))
    groups = stored(groups, "groups")
    known = leads.select("cls", "bytes").join(groups, "bytes").select("cls", "keep_id", "best", "group_size")
    carry = [F.col(n).alias(docs.columns[i]) for n, i in zip(names, carried)]
    verdict = lambda keep, size, kept: F.struct(keep.alias("keep_id"), size.alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256")).alias(result)
    copies = routed.filter("cls is not null").drop("bytes", "n", "top").join(known, "cls")
    copies = copies.select(*carry, verdict(F.col("keep_id"), F.col("group_size"), F.col("lead") & (F.col("best") == F.col("cls"))))
    single = routed.filter("cls is null").select(*carry, verdict(F.col("id"), F.lit(1).cast("long"), F.lit(True)))
    return single.unionAll(copies)


def without_copies(found: DataFrame) -> DataFrame:
    """Documents of exact_duplicates without those of which another row stays."""
    return found.filter(F.col(f"`{found.columns[-1]}`.kept")).drop(found.columns[-1])
