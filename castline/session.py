"""Session helpers shared by all jobs."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Rows of a batch sent to Python, in place of Spark's default of 10,000: rows of text are some kilobytes each.
BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000")


def ship_package(spark: SparkSession) -> SparkSession:
    """Makes this package importable in Python workers, once an application, and bounds the batches they get."""
    context = spark.sparkContext
    if spark.conf.get(BATCH[0]) == BATCH[1]:
        spark.conf.set(BATCH[0], BATCH[2])
    if context.applicationId not in _shipped:
        top = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="castline-"), "castline.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        archive.write(full, os.path.join("castline", os.path.relpath(full, top)))
        context.addPyFile(path)
        _shipped.add(context.applicationId)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir that all machines share; where a session names none, a local one for a local master, else an error."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="castline-")
        spark.conf.set("spark.checkpoint.dir", given)
    return given.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once into the session's checkpoint folder, which cuts its lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet into the shared folder and read back: columns of many rows that repeat take little room."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
