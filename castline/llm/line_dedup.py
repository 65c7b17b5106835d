"""Line dedup over levelled sorted runs of line hashes, by DataFrame operations only.

The lines of all documents are cut and hashed once, in a table partitioned by
batch, from the largest doc ids down.  A batch's distinct lines are
merge-anti-joined with the runs stored so far: lines no run knows are fresh and
name this batch's largest document as holder, known lines only add to the
document count.  The batch's own run is added at level 0; ``fanout`` runs of a
level are merged into one of the next.  After the last batch all runs merge into
the counts, and lines held by ``min_docs`` documents or more go from every
document but their holder.

Runs are tables bucketed and sorted by the line hash, with their files in the
shared folder, so a batch is shuffled once and meets every run in place, and
runs merge in place too.

A line's identity is two xxhash64 values with different salts of its stripped,
ASCII-lower-cased key (128 bits).  Copies inside a document are folded first
and documents are counted with map-side combining, so a line that a third of
all documents share costs each shuffle one row a task.

Defined results: a null or empty text is one empty line and comes back as the
empty text; lines shorter than ``min_length`` code points are never dropped;
rows repeating a doc_id count as one document; a null doc_id is a document
of its own, smaller than the rest; an empty table gives no rows; of further
columns none is read.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import dropped, shared_dir, small, stored

#: Lines of a document dropped by a search in its row; documents with more have their lines joined.
FEW = 64

_SPACE = " \t\n\u000b\f\r"


def line_key(line: Column) -> Column:
    """The line stripped of ASCII white space at both ends."""
    return F.trim(line, F.lit(_SPACE))


def key_hash(key: Column) -> Column:
    """128 bits of the stripped line with A-Z lower-cased.

    Other letters must keep their case, so a line beyond ASCII is lower-cased
    as ISO-8859-1 of its UTF-8 bytes: that also shifts lead bytes C0-DE to
    E0-FE, but as continuation bytes stay, their number still tells the two
    apart and different keys stay different.
    """
    bytewise = F.lower(F.decode(key.cast("binary"), "ISO-8859-1"))
    folded = F.when(F.length(key) == F.octet_length(key), F.lower(key)).otherwise(bytewise)
    return F.struct(F.xxhash64(folded).alias("h1"), F.xxhash64(F.lit("second"), folded).alias("h2"))


class LineRuns:
    """Levels of stored runs; a run has rows (h1, h2, n, holder), bucketed and sorted by hash, holder null where an older run has it."""

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int = 16):
        self.spark, self.fanout, self.buckets = spark, fanout, buckets
        self.levels: list[list[str]] = [[]]
        self.merges = 0

    def all(self) -> list[DataFrame]:
        return [self.spark.table(run) for level in self.levels for run in level]

    def written(self, rows: DataFrame) -> str:
        """Stores rows as a run and names it."""
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = rows.repartition(self.buckets, "h1", "h2")
        dealt.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{shared_dir(self.spark)}/{name}").saveAsTable(name)
        return name

    def delete(self, runs: list[str]) -> None:
        for run in runs:
            dropped(self.spark.table(run))
            self.spark.sql(f"DROP TABLE {run}")

    @staticmethod
    def merged(runs: list[DataFrame]) -> DataFrame:
        """The runs as one, by full outer joins: a merge of sorted sides with distinct keys."""

        def both(one: DataFrame, other: DataFrame) -> DataFrame:
            other = other.select("h1", "h2", F.col("n").alias("_n"), F.col("holder").alias("_holder"))
            n = F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))
            return one.join(other, ["h1", "h2"], "full").select("h1", "h2", n.alias("n"), F.greatest("holder", "_holder").alias("holder"))

        return functools.reduce(both, runs)

    def add(self, batch: DataFrame) -> None:
        """batch: distinct lines (h1, h2, n, holder) of documents that precede all added later."""
        for run in self.all():
            known = run.where("holder is not null").select("h1", "h2", F.lit(True).alias("_known"))
            # the anti-joined rows keep their holder; the others only count
            met = batch.join(known, ["h1", "h2"], "left")
            batch = met.select("h1", "h2", "n", F.when(F.col("_known").isNull(), F.col("holder")).alias("holder"))
        self.levels[0].append(self.written(batch))
        self.compact()

    def compact(self) -> None:
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            run = self.written(self.merged([self.spark.table(r) for r in self.levels[level]]))
            self.delete(self.levels[level])
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(run)
            self.merges += 1
            level += 1

    def frequent(self, least: int) -> DataFrame:
        return self.merged(self.all()).where(F.col("n") >= least)

    def close(self) -> None:
        for level in self.levels:
            self.delete(level)
        self.levels = [[]]


def _doc(key: str) -> Column:
    return F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))


def _lines(docs: DataFrame, key: str, text: str, min_length: int, batch: Column) -> DataFrame:
    """Rows (doc, batch, h1, h2): the lines of min_length code points or more, once a row of docs."""
    long_lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), line_key), lambda k: F.length(k) >= min_length)
    keyed = docs.select(_doc(key).alias("doc"), F.explode(F.array_distinct(long_lines)).alias("k"))
    return keyed.select("doc", batch.alias("batch"), key_hash(F.col("k")).alias("h")).select("doc", "h.h1", "h.h2", "batch")


def drop_repeated_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = 40, min_docs: int = 5, batches: int = 6, fanout: int = 2
) -> DataFrame:
    """Rows (key, n_lines, n_dropped, kept) for every row of docs; kept is the text that stays."""
    spark = docs.sparkSession
    cuts = docs.select(_doc(key).alias("doc")).agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)], 1000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts), reverse=True)
    batch = functools.reduce(lambda n, cut: n + (F.col("doc") <= cut).cast("int"), cuts, F.lit(0))
    path = f"{shared_dir(spark)}/line-dedup-{uuid.uuid4().hex}"
    cut = _lines(docs, key, text, min_length, batch)
    cut.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(cut.schema).parquet(path)
    runs = LineRuns(spark, fanout, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for i in range(len(cuts) + 1):
        runs.add(lines.where(F.col("batch") == i).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("holder")))
    # n counts rows; where rows repeat a doc_id the documents are fewer
    often = stored(runs.frequent(min_docs).select("h1", "h2", "holder"), "line-dedup")
    runs.close()
    met = stored(lines.select("doc", "h1", "h2").join(small(often, often.count()), ["h1", "h2"]).distinct(), "line-dedup")
    frequent = met.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("h1", "h2")
    gone = stored(met.where("doc <> holder").join(frequent, ["h1", "h2"]).select("doc", "h1", "h2"), "line-dedup")
    hits = stored(gone.groupBy("doc").agg(F.count("*").alias("n"), F.when(F.count("*") <= FEW, F.collect_list(F.struct("h1", "h2"))).alias("drop")), "line-dedup")
    dropped(lines, often, met)
    held = docs.select(F.col(key), _doc(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    # the hits grow with the corpus: texts are joined to them, at every size
    joined = held.join(hits.hint("merge"), "doc", "left").withColumn("lines", F.split("body", "\n"))
    stays = lambda line: (F.length(line_key(line)) < min_length) | ~F.array_contains(F.col("drop"), key_hash(line_key(line)))
    out = joined.where(f"coalesce(n, 0) <= {FEW}").withColumn("kept_lines", F.when(F.col("drop").isNotNull(), F.filter("lines", stays)))
    n = F.size("lines").cast("long")
    few = out.select(
        key, n.alias("n_lines"), F.coalesce(n - F.size("kept_lines"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drop").isNull(), F.col("body")).otherwise(F.array_join("kept_lines", "\n")).alias("kept"),
    )
    placed = joined.where(f"n > {FEW}").withColumn("row", F.monotonically_increasing_id()).select(key, "doc", "row", F.posexplode("lines").alias("at", "line"))
    placed = placed.withColumn("h", key_hash(line_key(F.col("line")))).select(key, "doc", "row", "at", "line", "h.h1", "h.h2")
    judged = placed.join(gone.withColumn("drops", F.lit(True)), ["doc", "h1", "h2"], "left").groupBy("row", key)
    stay = F.sort_array(F.collect_list(F.when(F.col("drops").isNull(), F.struct("at", "line"))))
    many = judged.agg(F.count("*").alias("n_lines"), F.count("drops").alias("n_dropped"), F.array_join(F.transform(stay, lambda x: x["line"]), "\n").alias("kept")).drop("row")
    return few.unionByName(many) if hits.where(f"n > {FEW}").limit(1).count() else few
