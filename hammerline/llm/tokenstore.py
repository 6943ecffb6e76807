"""Token-id shards with a minimal perfect hash index: constant-time keyed access over raw id payloads.

A store is a folder of shard files and a manifest table. A shard file holds
  payload   the ids of its documents one behind the other, little-endian, 2 bytes each if the vocabulary
            allows and 4 otherwise,
  keys, starts, null count   the documents in order: id, ids before it in the shard,
  levels, slots, prints      the index: bit arrays of the minimal perfect hash, and for each slot the
            record's number and a 32-bit fingerprint of its key,
  footer    JSON with each section's place, its length in 8 bytes, and a mark.
Shards are ranges of the ids in ascending order, so a key's shard follows from the manifest's bounds and
its record from one hash lookup, checked by the fingerprint.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hammerline.llm import bpe
from hammerline.llm.common import new_folder, open_fs, released, stored

MARK = b"HLTOKS01"
MANIFEST = "shard long, n_records long, n_ids long, n_null long, first_key long, last_key long"


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit finalizer, another one at each level (its multipliers are the usual fixed values of splitmix64)."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def build_hash(keys: np.ndarray, room: float = 2.0) -> list[np.ndarray]:
    """Bit arrays of a minimal perfect hash of distinct 64-bit keys: at each level the keys that fall
    alone on a bit set it, the others go to the next level."""
    levels, left = [], keys
    while len(left):
        size = max(64, int(room * len(left)))
        at = _mix(left, len(levels)) % np.uint64(size)
        alone = np.bincount(at.astype(np.int64), minlength=size) == 1
        levels.append(alone)
        left = left[~alone[at.astype(np.int64)]]
    return levels


class PerfectHash:
    """slot(keys): 0 to n-1 for the n keys it was built of, each once; other keys get any slot or -1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels, self.ranks, before = levels, [], 0
        for bits in levels:
            rank = np.cumsum(bits, dtype=np.int64)
            self.ranks.append(rank - 1 + before)
            before += int(rank[-1])

    def slot(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = (_mix(keys[left], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.ranks[k][at[hit]]
            left = left[~hit]
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1000) >> np.uint64(32)).astype("<u4")


class ShardWriter:
    """Streams a shard's payload out; its index is built of the records' keys at the end."""

    def __init__(self, folder: str, shard: int, width: int):
        self.fs, base = open_fs(folder)
        self.fs.create_dir(base, recursive=True)
        self.path = f"{base}/shard-{shard:08d}.tok"
        self.draft = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out, self.kind, self.shard = self.fs.open_output_stream(self.draft), f"<u{width}", shard
        self.keys: list[int | None] = []
        self.sizes: list[int] = []

    def add(self, keys: list[int | None], ids: np.ndarray, sizes: list[int]) -> None:
        """Documents in order: their keys, all their ids, how many each has."""
        if len(ids) and int(ids.max()) >> 8 * int(self.kind[-1]):
            raise ValueError(f"an id does not fit {self.kind[-1]} bytes")
        self.keys += keys
        self.sizes += sizes
        self.out.write(ids.astype(self.kind).tobytes())

    def close(self) -> dict:
        nulls = sum(k is None for k in self.keys)  # nulls come first
        keys = np.array([0] * nulls + self.keys[nulls:], dtype="<i8")
        ends = np.cumsum([0, *self.sizes], dtype="<i8")
        distinct, first = np.unique(keys[nulls:], return_index=True)
        levels = build_hash(distinct)
        slots = np.empty(len(distinct), "<u4")
        slots[PerfectHash(levels).slot(distinct)] = first + nulls
        prints = fingerprint(keys[slots]) if len(slots) else np.empty(0, "<u4")
        place, sections = int(ends[-1]) * int(self.kind[-1]), {"payload": [0, int(ends[-1])]}
        bits = {f"level{i}": np.packbits(b) for i, b in enumerate(levels)}
        for name, part in {"keys": keys, "starts": ends, "slots": slots, "prints": prints, **bits}.items():
            self.out.write(part.tobytes())
            sections[name] = [place, part.nbytes]
            place += part.nbytes
        footer = json.dumps({"kind": self.kind, "nulls": nulls, "bits": [len(b) for b in levels], "sections": sections}).encode()
        self.out.write(footer + len(footer).to_bytes(8, "little") + MARK)
        self.out.close()
        self.fs.move(self.draft, self.path)
        known = keys[nulls:]
        return {
            "shard": self.shard, "n_records": len(keys), "n_ids": int(ends[-1]), "n_null": nulls,
            "first_key": int(known[0]) if len(known) else None, "last_key": int(known[-1]) if len(known) else None,
        }


class ShardReader:
    def __init__(self, folder: str, shard: int):
        where, base = open_fs(folder)
        self.file = where.open_input_file(f"{base}/shard-{shard:08d}.tok")
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MARK:
            raise ValueError(f"shard {shard} of {folder} is not whole")
        n = int.from_bytes(tail[:8], "little")
        self.about = json.loads(self.file.read_at(n, size - 16 - n))
        self.keys, self.starts = self._section("keys", "<i8"), self._section("starts", "<i8")
        self.slots, self.prints = self._section("slots", "<u4"), self._section("prints", "<u4")
        levels = [np.unpackbits(self._section(f"level{i}", "u1"), count=n).astype(bool) for i, n in enumerate(self.about["bits"])]
        self.hash = PerfectHash(levels)

    def _section(self, name: str, kind: str) -> np.ndarray:
        at, n = self.about["sections"][name]
        return np.frombuffer(self.file.read_at(n, at), dtype=kind)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of all records with one of the distinct keys, through the index; in order."""
        slot = self.hash.slot(keys)
        keys, slot = keys[slot >= 0], slot[slot >= 0]
        good = self.prints[slot] == fingerprint(keys)
        keys, record = keys[good], self.slots[slot[good]].astype(np.int64)
        good = self.keys[record] == keys
        record, found = record[good], []
        while len(record):  # records of one key are neighbours
            found.append(record)
            more = record[record + 1 < len(self.keys)]
            record = more[self.keys[more + 1] == self.keys[more]] + 1
        return np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)

    def ids(self, records: np.ndarray, most: int = 4 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """(record, its ids) for records in order; neighbours are read together, up to `most` ids."""
        width, i = int(self.about["kind"][-1]), 0
        while i < len(records):
            j = i + 1
            while j < len(records) and records[j] == records[j - 1] + 1 and self.starts[records[j] + 1] - self.starts[records[i]] <= most:
                j += 1
            a, b = self.starts[records[i]], self.starts[records[j - 1] + 1]
            run = np.frombuffer(self.file.read_at(int(b - a) * width, int(a) * width), dtype=self.about["kind"])
            for r in records[i:j]:
                yield int(r), run[self.starts[r] - a : self.starts[r + 1] - a]
            i = j


def write_tokens(
    docs: DataFrame,
    vocabulary: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    folder: str | None = None,
    id_bytes: int | None = None,
) -> str:
    """Encodes every whole text (null: empty), appends end_id and writes the store; returns its folder.

    Documents are in ascending order of their id (null ids first; equal ids by a hash of their text, so
    that even a hot id is spread over shards). An id takes 2 bytes where all of the vocabulary's fit and 4
    otherwise, or id_bytes; one that doesn't fit is an error. Other columns don't matter.
    """
    spark, vocabulary = docs.sparkSession, vocabulary or bpe.default_vocabulary()
    folder = folder or new_folder(spark, "tokens")
    width = id_bytes or (bpe.id_width(vocabulary) if end_id < 1 << 16 else 4)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    n = max(1, rows.rdd.getNumPartitions())
    rows = rows.withColumn("h", F.xxhash64("t")).repartitionByRange(n, "id", "h").sortWithinPartitions("id", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at, ids, sizes in bpe.encoder(vocabulary).slices(batch.column(1)):
                out = out or ShardWriter(folder, TaskContext.get().partitionId(), width)
                out.add(keys[at : at + len(sizes)], bpe.ended(ids, sizes, end_id), (sizes + 1).tolist())
        if out:
            row = out.close()
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([(k, pa.int64()) for k in row]))

    made = stored(rows.select("id", "t").mapInArrow(released(run, keeps=True), MANIFEST), "shards")
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    made.withColumn("base", before).coalesce(1).write.parquet(f"{folder}/manifest")
    return folder


def lookup(spark: SparkSession, folder: str, keys: DataFrame, with_ids: bool = True) -> DataFrame:
    """All records of the keys (one column): key, start (ids of all documents before it), n_tokens,
    ids_crc32 (of the ids as unsigned 32-bit), and with_ids the ids as an array.

    Keys are dealt to shards by the manifest's bounds (one row a shard) and looked up in the shards'
    indexes; keys that the store doesn't hold give no row. A null key gives the records without id.
    """
    manifest = spark.read.parquet(f"{folder}/manifest").orderBy("shard").toPandas()
    has = manifest["first_key"].notna().to_numpy()
    first, last = (manifest[c][has].to_numpy(np.int64) for c in ("first_key", "last_key"))
    shards, bases = manifest["shard"][has].to_numpy(np.int64), dict(zip(manifest["shard"], manifest["base"]))
    empty = [int(s) for s in manifest["shard"][manifest["n_null"] > 0]]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(last, known, "left"), np.searchsorted(first, known, "right")
            n = np.maximum(high - low, 0)
            at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            shard, key = list(shards[at]), list(np.repeat(known, n))
            if batch.column(0).null_count:
                shard, key = shard + empty, key + [None] * len(empty)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(key, pa.int64())], ["shard", "key"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, part in _runs(batches):
            reader = ShardReader(folder, shard)
            records = reader.find(part.drop_null().to_numpy(zero_copy_only=False))
            if part.null_count:
                records = np.concatenate([np.arange(reader.about["nulls"]), records])
            rows, held = [], 0
            for r, ids in reader.ids(records):
                ids = ids.astype("<u4")
                key = None if r < reader.about["nulls"] else int(reader.keys[r])
                rows.append((key, bases[shard] + int(reader.starts[r]), len(ids), zlib.crc32(ids.tobytes())) + ((ids,) if with_ids else ()))
                held += len(ids) if with_ids else 1
                if held > 500_000:
                    yield _rows(rows, with_ids)
                    rows, held = [], 0
            if rows:
                yield _rows(rows, with_ids)

    keys = keys.select(F.col(keys.columns[0]).cast("long").alias("key")).distinct()
    dealt = keys.mapInArrow(deal, "shard long, key long").repartition(max(1, len(manifest)), "shard").sortWithinPartitions("shard")
    kind = "key long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return dealt.mapInArrow(read, kind)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array]]:
    """Shard by shard, the keys wanted of it."""
    now, parts = None, []
    for batch in batches:
        shard = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)] if len(shard) else []
        for a, b in zip(cuts, cuts[1:]):
            if shard[a] != now and parts:
                yield now, pa.concat_arrays(parts)
                parts = []
            now = int(shard[a])
            parts.append(batch.column(1).slice(a, b - a))
    if parts:
        yield now, pa.concat_arrays(parts)


def _rows(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    columns = [pa.array(c, pa.int64()) for c in list(zip(*rows))[:4]]
    if with_ids:
        columns.append(pa.array([r[4] for r in rows], pa.list_(pa.int64())))
    return pa.RecordBatch.from_arrays(columns, ["key", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])
