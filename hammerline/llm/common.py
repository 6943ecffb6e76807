"""Helpers shared by the corpus operators: scratch tables, file access, texts as bytes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the cluster names none and the master is local (tests, one machine) a new temporary folder
    is set; elsewhere executors would not share it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Writes df as Parquet to the shared folder and returns the table read from there.

    This cuts lineage, computes df once, and survives lost executors.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few numbers that a task writes at least, where their number is known.
TASK_ROWS = 500_000


def stored_in_few(df: DataFrame, name: str, rows: int) -> DataFrame:
    """stored(), with tasks and files by the number of rows, which is about known and may be far below what
    the shuffle partitions are meant for; never fewer than the cluster has cores."""
    return stored(df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))), name)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as keep it apart from the columns that df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def rows_of(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs whose id and text are chosen (id, x: the hash that xxhash64 gives of the text), each
    once: only rows that are equal in both are repetitions of one another."""
    own = free_name(docs, "__x")
    keys = chosen.select(F.col("id").alias(f"{own}id"), F.col("x").alias(own)).distinct()
    marked = docs.withColumn(own, F.xxhash64(F.col(text_col).cast("string"))).withColumn(f"{own}id", F.col(id_col).cast("long"))
    return marked.join(keys, [f"{own}id", own], "left_semi").dropDuplicates([f"{own}id", own]).select(docs.columns)


def discard(table: DataFrame) -> None:
    """Deletes the folder of a table that stored() returned and that no later step reads."""
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        where, path = open_fs(folder)
        if where.get_file_info(path).type == fs.FileType.Directory:
            where.delete_dir(path)


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder that all executors share (file, hdfs, s3, gs)."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, parts: list[bytes]) -> None:
    """Writes a file under a name of its own, then moves it: a task that runs twice leaves one whole file."""
    where, path = open_fs(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    with where.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
    where.move(draft, path)


def give_back() -> None:
    """Gives memory that allocators hold back to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(AttributeError, OSError):
            ctypes.CDLL(None).malloc_trim(0)


_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """What a worker process makes once and keeps for later tasks; only the one asked for last is kept."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def drop_kept() -> None:
    _kept.clear()


def collect_garbage(spark: SparkSession) -> None:
    """Has the executors collect their garbage, after which they give free heap back to the system: a heap that one
    stage has filled otherwise stays at its full size beside the Python workers of the next."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def released(
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a mapInArrow, after which the worker gives freed memory back: Spark keeps workers for
    later tasks, also of other stages, and what an allocator holds back would add up beside the executor.
    keeps: it uses what is kept(); others drop that first."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            drop_kept()
        yield from run(batches)
        gc.collect()
        give_back()

    return wrapped
