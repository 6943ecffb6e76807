"""Exchange of packed hashes between sources of documents and slices of the hash space.

A source is some megabytes of documents, one row of a stored table. It sends every slice it has hashes in
one row, in which they lie sorted and packed. The slice's answer to a source is again one row, which goes
to the shared folder, where the source's next pass reads it. So a hash that very many documents share
costs a few bytes a source, no pair of documents is listed and the documents themselves stay where they are.

There are never more rows than hashes. Up to that they number sources times slices, of which a slice grows
no fuller with the input: rows get shorter, not bytes more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hammerline.llm.common import new_folder, open_fs

PACKED = "slice int, src long, packed binary"
#: Row groups of some megabytes also where a row holds megabytes, so that one row can be read alone.
SHORT_GROUPS = {"parquet.block.size": 4 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


def slice_bits(n_hashes: int, each: int) -> int:
    """Bits that number the slices, with about `each` hashes in a slice."""
    return min(24, max(3, (n_hashes // each).bit_length()))


def slices(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(slice, from, to) of sorted unsigned 64-bit hashes, by their highest bits; only slices that occur."""
    top = hashes >> np.uint64(64 - bits)
    edges = np.flatnonzero(np.concatenate([[len(top) > 0], top[1:] != top[:-1], [len(top) > 0]])).tolist()
    return ((int(top[a]), a, b) for a, b in zip(edges, edges[1:]))


def sent(src: int, parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
    columns = [pa.array([s for s, _ in parts], pa.int32()), pa.array([src] * len(parts), pa.int64()), pa.array([b for _, b in parts], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["slice", "src", "packed"])


def answers(s: int, rows: list[tuple[int, bytes]]) -> pa.Table:
    columns = [pa.array([s] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())]
    return pa.Table.from_arrays(columns, ["slice", "src", "packed"])


def by_source(rows: DataFrame, name: str) -> str:
    """Writes rows (with src) to a folder of the shared one, those of each task's sources in one place,
    in short row groups in order of the source; returns the folder."""
    folder = new_folder(rows.sparkSession, name)
    rows = rows.withColumn("part", F.shiftright("src", 32)).repartition("part").sortWithinPartitions("part", "src")
    rows.write.partitionBy("part").options(**SHORT_GROUPS).parquet(folder)
    return folder


def of_source(folder: str, src: int, columns: list[str]) -> pa.Table:
    """What by_source wrote for a source; no rows if nothing."""
    where, path = open_fs(f"{folder}/part={src >> 32}")
    files = [f for f in where.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.base_name.endswith(".parquet")]
    tables = []
    for f in files:
        with where.open_input_file(f.path) as file:
            tables.append(pq.read_table(file, columns=columns, filters=[("src", "=", src)], use_threads=False))
    return pa.concat_tables(tables) if tables else pa.table({c: [] for c in columns})


def exchange(rows: DataFrame, answer: Callable[[pa.Table], pa.Table], name: str) -> str:
    """Brings each slice's rows together, answers them, and leaves the answers by source."""
    return by_source(rows.groupBy("slice").applyInArrow(answer, PACKED), name)


def read_row(path: str, src: int, column: str):
    """A column of a source's row in a file of a stored table. It is read beside Spark because the rows of a
    task's Arrow batch, which are counted and not measured, would be too large together."""
    where, path = open_fs(path)
    with where.open_input_file(path) as file:
        return pq.read_table(file, columns=[column], filters=[("src", "=", src)], use_threads=False).column(0)[0]


def read_answers(folder: str, src: int) -> dict[int, bytes]:
    """Slice to answer, in order of the slices."""
    table = of_source(folder, src, ["slice", "packed"])
    return dict(sorted(zip(table.column("slice").to_pylist(), table.column("packed").to_pylist())))
