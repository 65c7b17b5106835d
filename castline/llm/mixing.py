"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources, in code point order with null last, weigh 5, 2, 1, 5, 2, 1, ...; they
share ``share`` times all words by weight, no source above ``most`` times its
own words, the excess going to the others by weight.

A source's documents are dealt into blocks by a hash of the document, so any
block is a random part of its source.  A target of r times the source's words
is floor(r) whole passes plus one pass over blocks in permuted order until the
rest is met; the block at the edge goes in by documents.  Documents larger than
the room left are passed over, and rounds over the others go on until no unused
document fits.

The block draws of all sources are then split among output shards by a tree:
at each node the draws are put in a random order and the first half of the
capacity goes left, which is sampling without replacement, so the sources'
counts in the two halves follow the multivariate hypergeometric law.  After
log2(shards) levels every shard holds a disjoint set of block draws, and rows
are shuffled inside their block.  All randomness is hashing: reruns agree.

The tables that the tree and the targets work on have one row a source or
block draw, at most sources * MAX_BLOCKS * ceil(most); documents meet them only in
joins and map-side sums.

Defined results: a null text has no words; documents of size 0 are taken never (target
words need none); a null source is a source of its own; rows repeating a
doc_id are dealt as one key and counted row by row; an empty table gives no
rows; further columns are ignored, clashing names included.
"""

from __future__ import annotations

import functools
import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_dir, small, stored

WEIGHTS = (5, 2, 1)
#: Rows of a block at the least, and blocks of a source at the most.
BLOCK_ROWS, MAX_BLOCKS = 512, 4096


def word_count(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+, without cutting the text into rows."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(*parts: Column) -> Column:
    """A double in (0, 1) fixed by the parts."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def source_key(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Rows (source_key, source_size, target) from (source, source_key, source_size, source_rows).

    Sources fill up in order of size over weight; the level at which the rest
    share by weight without passing their caps follows from running sums.
    """
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    weighted = sizes.withColumn("_i", F.row_number().over(ranked) - 1).withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") % n + 1).cast("int")))
    weighted = weighted.withColumn("_cap", F.col("source_size") * F.lit(most))
    by_fill = Window.orderBy(F.col("_cap") / F.col("_w"), "_i")
    up_to, everyone = by_fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    sums = weighted.select(
        "*",
        (F.sum("source_size").over(everyone) * F.lit(share)).alias("_all"),
        F.coalesce(F.sum("_cap").over(up_to), F.lit(0.0)).alias("_before"),
        (F.sum("_w").over(everyone) - F.coalesce(F.sum("_w").over(up_to), F.lit(0.0))).alias("_left_w"),
    ).withColumn("_level", (F.col("_all") - F.col("_before")) / F.col("_left_w"))
    # the first source, in fill order, that its level does not fill sets the level of the rest
    level = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), "_i", "_level"))).over(everyone)
    out = sums.withColumn("_open", level["_level"])
    return out.select("source_key", "source_size", "source_rows", F.least("_cap", F.coalesce(F.col("_open") * F.col("_w"), F.col("_cap"))).alias("target"))


def _narrow(docs: DataFrame, key: str, text: str, source: str, seed: int) -> DataFrame:
    size = word_count(F.col(text))
    return docs.select(
        F.col(key).alias("doc"), F.col(source).alias("source"), source_key(F.col(source)).alias("source_key"),
        size.alias("size"), F.xxhash64(F.lit(seed), F.col(key), F.xxhash64(F.col(text))).alias("h"),
    )


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, most: float = 2.0, seed: int = 29) -> DataFrame:
    """One row a document: (doc, source_key, size, h, block, source_size, target, copies)."""
    rows = stored(_narrow(docs, key, text, source, seed), "mixing")
    sizes = rows.groupBy("source", "source_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    goal = stored(targets(sizes, share=share, most=most).withColumn("blocks", F.least(F.lit(MAX_BLOCKS), F.greatest(F.lit(16), F.ceil(F.col("source_rows") / BLOCK_ROWS))).cast("int")), "mixing")
    goal = goal.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    sources = goal.count()
    # the small side is broadcast within the bound, as one source may hold a third of the rows
    dealt = rows.drop("source").join(small(goal, sources), "source_key").withColumn("block", F.pmod("h", "blocks").cast("int"))
    # rows that repeat a document go in together
    unit = F.sum("size").over(Window.partitionBy("source_key", "block", "h", "doc"))
    dealt = stored(dealt.withColumn("unit", unit), "mixing")
    order = Window.partitionBy("source_key").orderBy(uniform(F.lit(seed + 1), F.col("source_key"), F.col("block")), "block")
    run = Window.partitionBy("source_key", "block").orderBy("h", "doc").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    columns = ["doc", "source_key", "h", "block", "size", "unit", "left", "room"]
    pool = dealt.select("doc", "source_key", "h", "block", "size", "unit", F.col("rest").alias("left")).where("size > 0 and unit <= left")
    picks = []
    while True:
        blocks = pool.groupBy("source_key", "block").agg(F.sum("size").alias("block_size"), F.first("left").alias("left"))
        filled = blocks.withColumn("_end", F.sum("block_size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        state = stored(filled.select("source_key", "block", F.when(F.col("_end") <= F.col("left"), 1).when(F.col("_end") - F.col("block_size") < F.col("left"), 2).otherwise(0).alias("fill"), (F.col("left") - F.col("_end") + F.col("block_size")).alias("room")), "mixing")
        n = state.count()
        if not n:
            break
        ranged = pool.join(small(state, n), ["source_key", "block"])
        edge = ranged.where("fill = 2").withColumn("_run", F.sum("size").over(run)).select(*columns, (F.col("_run") <= F.col("room")).alias("pick"))
        marked = stored(ranged.where("fill <> 2").select(*columns, (F.col("fill") == 1).alias("pick")).union(edge).drop("room"), "mixing")
        picks.append(marked.where("pick").select("source_key", "block", "h", "doc").distinct())
        got = marked.where("pick").groupBy("source_key").agg(F.sum("size").alias("_got"))
        # every source in the pool takes its first document at least
        pool = marked.where("not pick").join(small(got, sources), "source_key").withColumn("left", F.col("left") - F.col("_got")).where("unit <= left").drop("pick", "_got")
    if picks:
        taken = functools.reduce(DataFrame.union, picks).select(F.col("source_key").alias("_source"), F.col("block").alias("_block"), F.col("h").alias("_h"), F.col("doc").alias("_doc"), F.lit(1).alias("_extra"))
        same = (F.col("source_key") == F.col("_source")) & (F.col("block") == F.col("_block")) & (F.col("h") == F.col("_h")) & F.col("doc").eqNullSafe(F.col("_doc"))
        dealt = dealt.join(taken, same, "left")
    else:
        dealt = dealt.withColumn("_extra", F.lit(0))
    chosen = dealt.select("doc", "source_key", "size", "h", "block", "source_size", "target", "passes", "rest", F.coalesce("_extra", F.lit(0)).alias("extra"))
    return chosen.withColumn("copies", F.when(F.col("size") > 0, F.col("passes") + F.col("extra")).otherwise(0).cast("int")).drop("passes", "rest", "extra")


def split_blocks(draws: DataFrame, shards: int, seed: int) -> DataFrame:
    """Deals block draws (source_key, block, copy) to shards; adds ``mix_shard``.

    Level by level each node's draws, in an order fixed by the seed, give their
    first part to the left half of the node's shards and the rest to the right.
    """
    # a node is (low, high): the half-open range of its shards
    nodes = draws.withColumn("_low", F.lit(0)).withColumn("_high", F.lit(shards))
    for level in range(max(0, math.ceil(math.log2(shards)))):
        at = Window.partitionBy("_low", "_high")
        nodes = nodes.withColumn("_rank", F.row_number().over(at.orderBy(uniform(F.lit(seed), F.lit(level), F.col("source_key"), F.col("block"), F.col("copy")), "source_key", "block", "copy"))).withColumn("_n", F.count("*").over(at))
        mid = F.floor((F.col("_low") + F.col("_high")) / 2).cast("int")
        left = F.col("_rank") <= F.floor(F.col("_n") * (mid - F.col("_low")) / (F.col("_high") - F.col("_low")))
        leaf = F.col("_high") - F.col("_low") <= 1
        nodes = nodes.withColumn("_mid", mid).withColumn("_go", left).withColumn("_high", F.when(leaf | ~F.col("_go"), F.col("_high")).otherwise(F.col("_mid"))).withColumn("_low", F.when(leaf | F.col("_go"), F.col("_low")).otherwise(F.col("_mid")))
    return nodes.withColumn("mix_shard", F.col("_low")).drop("_low", "_high", "_mid", "_go", "_rank", "_n")


def _placed(planned: DataFrame, shards: int, seed: int) -> DataFrame:
    """Rows (doc, h, source_key, mix_shard, mix_order) of a plan, each as often as the mix takes it."""
    chosen = stored(planned.where("copies > 0").select("doc", "source_key", "h", "block", "copies").distinct(), "mixing")
    counted = chosen.groupBy("source_key", "block").agg(F.max("copies").alias("copies"))
    draws = counted.select("source_key", "block", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    placed = stored(split_blocks(draws, shards, seed + 2), "mixing")
    rows = chosen.select("doc", "h", "source_key", "block", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).join(placed, ["source_key", "block", "copy"])
    return rows.select("doc", "h", "source_key", "mix_shard", F.xxhash64(F.lit(seed + 3), "h", "copy").alias("mix_order"))


def mix_plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", shards: int = 8, seed: int = 29, **options) -> DataFrame:
    """Rows (key, size, source_size, target, taken, mix_shards) for every row of docs: words of its placed draws, repeats counted, and the draws' shards."""
    planned = stored(plan(docs, key, text, source, seed=seed, **options), "mixing")
    drawn = _placed(planned, shards, seed).groupBy(F.col("doc").alias("_doc"), F.col("h").alias("_h"), F.col("source_key").alias("_source"))
    drawn = drawn.agg(F.count("*").alias("_draws"), F.array_join(F.sort_array(F.collect_list("mix_shard")), ",").alias("_shards"))
    joined = planned.join(drawn, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("h") == F.col("_h")) & (F.col("source_key") == F.col("_source")), "left")
    return joined.select(F.col("doc").alias(key), "size", "source_size", "target", (F.col("size") * F.coalesce("_draws", F.lit(0))).alias("taken"), F.coalesce("_shards", F.lit("")).alias("mix_shards"))


def _mixed(docs: DataFrame, key: str, text: str, source: str, shards: int, seed: int, **options) -> DataFrame:
    """Rows (row, mix_shard, mix_order): each row of docs whole, as often as the mix takes it."""
    placed = _placed(plan(docs, key, text, source, seed=seed, **options), shards, seed)
    placed = placed.select(F.col("doc").alias("_doc"), F.col("h").alias("_h"), F.col("source_key").alias("_source"), "mix_shard", "mix_order")
    marked = docs.select(F.struct("*").alias("row"), F.col(key).alias("_key"), F.xxhash64(F.lit(seed), F.col(key), F.xxhash64(F.col(text))).alias("_dh"), source_key(F.col(source)).alias("_ds"))
    return marked.join(placed, F.col("_key").eqNullSafe(F.col("_doc")) & (F.col("_dh") == F.col("_h")) & (F.col("_ds") == F.col("_source"))).select("row", "mix_shard", "mix_order")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", shards: int = 8, seed: int = 29, **options) -> DataFrame:
    """The mixed table: docs' columns plus (mix_shard, mix_order), each row as often as the mix takes it.

    Columns of docs that have these two names already give way to them.
    """
    return _mixed(docs.drop("mix_shard", "mix_order"), key, text, source, shards, seed, **options).select("row.*", "mix_shard", "mix_order")


def mixed_in_order(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", shards: int = 8, seed: int = 29, **options) -> DataFrame:
    """The rows of the mix with the columns of docs alone: files written of it hold a shard's rows in mixed order."""
    return ordered(_mixed(docs, key, text, source, shards, seed, **options)).select("row.*")


def ordered(mixed: DataFrame) -> DataFrame:
    """The mixed table dealt by mix_shard and ranges of mix_order and sorted by them: files written of it hold rows in mixed order."""
    return mixed.repartition("mix_shard", F.shiftright("mix_order", 54)).sortWithinPartitions("mix_shard", "mix_order")


def written(mixed: DataFrame, name: str) -> DataFrame:
    """Writes the mixed table by mix_shard, files in mix_order, and reads it back."""
    spark = mixed.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    ordered(mixed).write.partitionBy("mix_shard").parquet(path)
    return spark.read.schema(mixed.schema).parquet(path).select(*[F.col(f"`{c}`") for c in mixed.columns])
