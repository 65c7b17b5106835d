"""Small Spark helpers of the operators: shared storage, sizes, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only up to this many counted rows; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Labels of components that every round broadcasts anew: some 10 MB on the driver, where rounds follow each other.
LABEL_ROWS = 200_000
#: Spark's option to delete an execution's shuffle files when it ends, instead of when the driver collects its plan.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where a session names none, a local one for a local master (tests), else an error."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="castline-")
        spark.conf.set("spark.checkpoint.dir", given)
    return given.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, which cuts the lineage.

    The table replaces what was shuffled to make it, so those files go with the
    write; a loop of writes then holds the disk of one step, not of all.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` wrote, once what was made of them is stored too."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        for folder in {name.rpartition("/")[0] for name in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the limit, else df."""
    return F.broadcast(df) if rows <= limit else df


def with_row(docs: DataFrame, name: str) -> DataFrame:
    """docs with a long column that numbers its rows: the file's place among the files' names, then the row's place in it.

    Every plan over the same files gives a row the same number, whatever their
    splits.  A table that is not read from files is stored first.
    """
    spark = docs.sparkSession
    try:
        paths = docs.select("_metadata.file_path")
    except AnalysisException:
        return with_row(stored(docs, "rows"), name)
    # one row a file: the driver lists the files of every table that it reads
    files = sorted(r[0] for r in paths.distinct().collect())
    numbers = spark.createDataFrame(list(enumerate(files)), f"`{name}-file` long, `{name}-path` string")
    held = docs.select("*", F.col("_metadata.file_path").alias(f"{name}-at"), F.col("_metadata.row_index").alias(name))
    held = held.join(small(numbers, len(files)), F.col(f"`{name}-at`") == F.col(f"`{name}-path`"))
    return held.select(*[F.col(f"`{c}`") for c in docs.columns], (F.col(f"`{name}-file`") * F.lit(1 << 40) + F.col(f"`{name}`")).alias(name))


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), the component's smallest node.

    In a round every node takes the smallest label among its neighbours, and so does
    the node that its label names, then that label's label, twice: trees of labels
    hook onto each other whole, so long chains take few rounds in any order of
    their nodes.  A round reads the labels of the last one alone, by one exchange or
    broadcast that all its joins share, so its plan stays small on the driver
    however often it is planned anew.
    After every round the labels are written to the shared folder; nothing is
    collected but whether any changed.  Nulls and self loops are dropped; an
    empty input gives no rows.
    """
    both = edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct()
    both = stored(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"{name}-edges")
    first = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    labels = stored(first.withColumn("moved", F.lit(True)), f"{name}-labels")
    nodes = labels.count()

    for step in range(200):
        held = small(labels.select(F.col("node").alias("at"), F.col("component").alias("is")), nodes, LABEL_ROWS)
        seen = both.join(held, F.col("b") == F.col("at")).select("a", F.col("is").alias("near"))
        seen = seen.join(held, F.col("a") == F.col("at")).select("a", "near", "is")
        # to the node itself and, where smaller, to the node that its label names
        told = F.when(F.col("near") < F.col("is"), F.array("a", "is")).otherwise(F.array("a"))
        near = seen.select(F.explode(told).alias("node"), "near").groupBy("node").agg(F.min("near").alias("near"))
        best = near.join(held, F.col("node") == F.col("at")).select("node", F.least("near", "is").alias("component"), F.col("is").alias("old"))
        for _ in range(2):
            best = best.join(held, F.col("component") == F.col("at")).select("node", F.least("component", "is").alias("component"), "old")
        after = stored(best.select("node", "component", (F.col("component") < F.col("old")).alias("moved")), f"{name}-{step}")
        dropped(labels)
        labels = after
        if not labels.where("moved").limit(1).count():
            dropped(both)
            return labels.select("node", "component")
    raise RuntimeError("components did not settle")
