"""Streaming forms of the time-driven queries. Late rows beyond a query's watermark are dropped.

Each stream reads landed files, runs to the end of what there is (availableNow), in one or more micro-batches,
and leaves its results in a folder of the shared file system, from which the query reads. Nothing of a stream is
held by the driver: a stream that is started again with the same folder goes on where it stopped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from hammerline.operators import advice


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is named and the master is local, a new one for
    this session. Elsewhere executors would not share it, so one must be named."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file:///tmp/spark-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def landed(spark: SparkSession, sf_dir: str, name: str, files: int = 100) -> DataFrame:
    """The files of a table as a stream, so many files a micro-batch at most; event times become instants in UTC."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files)
    rows = reader.parquet(f"{sf_dir}/{name}.parque[t]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the last in the order (which ends in a unique column); combined before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("last"))
    return last.select(*[c if c in keys else F.col(f"last.{c}").alias(c) for c in rows.columns])


def run_to_table(stream: DataFrame, mode: str, keys: list[str] | None = None, order: list[str] | None = None, folder: str | None = None) -> DataFrame:
    """Runs a stream to its end and returns its result.

    Every micro-batch writes a part of its own, so one that runs again replaces its part. In complete mode the
    last part is the result, else all parts together. With keys and order a part holds one row a key, the last of
    its batch, and the result the last of all parts: parts may come late or twice, and no batch reads or rewrites
    what others wrote. folder: where an earlier run of the same stream stopped; it is gone on with."""
    spark = stream.sparkSession
    folder = folder or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def save(batch: DataFrame, number: int) -> None:
        (latest(batch, keys, order) if keys else batch).write.mode("overwrite").parquet(f"{folder}/parts/part={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    # A stream that has seen nothing yet has no parts; an empty one stands in for them.
    stream.sparkSession.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{folder}/parts/part=-1")
    parts = spark.read.schema(StructType([*stream.schema, StructField("part", LongType())])).parquet(f"{folder}/parts")
    if mode == "complete":
        parts = parts.filter(F.col("part") == (parts.agg(F.max("part")).first()[0] or 0))
    found = parts.drop("part")
    return latest(found, keys, order) if keys else found


def rate_count(events: DataFrame, limit: int = 30) -> DataFrame:
    """Requests of each key in each minute and whether they exceed the limit."""
    counts = events.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 minute").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return counts.select("user_id", F.col("w.start").alias("minute"), "n", (F.col("n") > limit).alias("over"))


def latest_by_window(events: DataFrame, key: str, value: str) -> DataFrame:
    """The last value of each key in each day."""
    days = events.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day").alias("w"), key)
    return days.agg(F.max_by(value, F.struct("ts", "event_id")).alias("last"), F.count("*").alias("n")).select(key, F.col("w.start").alias("day"), "last", "n")


def bid_advice(bids: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Stateless: each bid meets the finished snapshots."""
    return advice.bid_advice(bids, snapshots)
