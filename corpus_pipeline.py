"""From documents to shards: language ID, near-duplicate removal, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns the rows that go on; all but the last return the columns of
documents.  Between stages the rows are written as Parquet in the shared
folder and read again.

Defined results: rows without letters or far from every learned language go;
of documents linked at a Jaccard similarity of 0.8 over five-word shingles the
first row stays; documents that hold a benchmark item go; the mix repeats a
document twice at most; an empty table stays empty.  The second and third
stage tell rows by their place in the input's files, so null and repeated
doc_ids are judged row by row, each by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castline.llm import decontamination, jaccard, language_id, mixing, sharding
from castline.llm.shared import small, stored, with_row
from castline.session import ship_package

SHARDS = 24
#: Name of the row numbers inside a stage.
ROW = "pipeline-row"


def _without(docs: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """docs, numbered by ROW, without the rows of the keys (k) and without the number."""
    gone = stored(keys.distinct(), name)
    return docs.join(small(gone, gone.count()), docs[ROW] == gone["k"], "left_anti").drop(ROW)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    model = language_id.train(docs, F.lit(True))
    return language_id.keep_identified(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    rows = with_row(docs, ROW)
    linked = jaccard.link_components(rows, key=ROW, k=5, num=80, den=100)
    return _without(rows, linked.where(F.col(ROW) != F.col("component_id")).select(F.col(ROW).alias("k")), "pipeline-copies")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    rows = with_row(docs, ROW)
    pairs = decontamination.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=ROW)
    return _without(rows, pairs.select(F.col(ROW).alias("k")), "pipeline-leaks")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_in_order(docs, shards=8)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.with_shard(docs, SHARDS)


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The stages are trained or hashed, which SQL cannot say; tests/llm/test_pipeline.py holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
