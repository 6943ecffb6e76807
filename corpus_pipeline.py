"""Corpus cleaning: quality rules, near-duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before has kept, and all but the last
return the columns of documents. run() writes each stage's result to the shared folder and reads it again
for the next one. The near-duplicate stage links texts whose SimHash fingerprints differ in two bits or
fewer, as operator 1 does, and also those whose sets of five-word shingles have a Jaccard similarity of 0.8 or
more, most of which fingerprints miss.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hammerline.llm import common, decontaminate, packing, quality, shingles, substring


#: Rows of an Arrow batch at most: batches are bounded by rows, and texts of a few kilobytes each fill one of the
#: usual 10,000 rows with tens of megabytes, several times over in the executor and its Python workers.
BATCH_ROWS = 1000


def _lean(spark: SparkSession) -> None:
    """Before a stage: short batches, and no heap of executors that only garbage of the one before fills."""
    common.collect_garbage(spark)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, BATCH_ROWS)


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows a text that a stage has changed."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _lean(spark)
    judged = quality.judge(docs)
    verdict = judged.columns[-1]
    return judged.filter(F.col(f"`{verdict}`.kept")).drop(verdict)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _lean(spark)
    return shingles.keep_one(docs).select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _lean(spark)
    return _counted(substring.without_repeats(substring.remove_repeats(docs)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _lean(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _counted(decontaminate.without_hits(decontaminate.find_windows(docs, benchmark)))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _lean(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the tokenizer nor the packing; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
