"""Rendezvous hashing of record keys over weighted shards.

Every (key, shard) pair has a fixed pseudo-random score -w / ln(u); a key lives
in the shard of its largest score.  A new shard wins only the keys on which it
outscores all others, so growing by one moves rows only into the new shard.
All of it is column arithmetic: one shuffle for the slots, nothing collected.

Defined results: a null key is hashed as a value of its own; equal keys share a
shard and take consecutive slots in text order; a null or empty text has size
``overhead`` and crc32 0 (of no bytes); an empty table gives no rows; columns other than the key
and the text are not read, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slots are numbered inside (shard, cell) windows and offset by counts; cells split a shard's rows among tasks.
CELLS = 64


def rendezvous(key: Column, weights: list[float], seed: int = 17) -> Column:
    """The index of the shard with the largest weighted rendezvous score for ``key``."""
    scored = []
    for i, w in enumerate(weights):
        if w <= 0:
            raise ValueError("weights must be positive")
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(f"{seed}:{i}"), F.coalesce(key.cast("string"), F.lit("\u0000"))), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        scored.append(F.struct((F.lit(-float(w)) / F.ln(u)).alias("score"), F.lit(-i).alias("minus")))
    best = scored[0] if len(scored) == 1 else F.greatest(*scored)
    return (-best["minus"]).cast("int")


def with_slots(df: DataFrame, shard: str, order: list[str], cells: int = CELLS) -> DataFrame:
    """Adds ``slot``: gapless from 0 in each shard, the same on every run over the same rows."""
    cell = df.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int"))
    counts = cell.groupBy(shard, "_cell").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(shard).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(shard).alias("_s"), F.col("_cell").alias("_c"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(shard, "_cell").orderBy(*order))
    # starts has shards * cells rows at most
    placed = cell.withColumn("_row", inside).join(F.broadcast(starts), (F.col(shard) == F.col("_s")) & (F.col("_cell") == F.col("_c")))
    return placed.withColumn("slot", F.col("_start") + F.col("_row") - 1).drop("_cell", "_row", "_s", "_c", "_start")


def shard_records(
    docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", weights: list[float] | None = None, overhead: int = 8, seed: int = 17
) -> DataFrame:
    """Rows (key, size, text_crc32, law, shard, slot, grown_shard) for every row of docs."""
    weights = weights or [1.0] * shards
    if len(weights) != shards:
        raise ValueError("one weight a shard")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key),
        (F.octet_length(body).cast("long") + F.lit(overhead)).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), weights, seed).alias("shard"),
        rendezvous(F.col(key), [*weights, sum(weights) / len(weights)], seed).alias("grown_shard"),
    )
    return with_slots(rows, "shard", [key, "text_crc32", "size"]).select(key, "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def with_shard(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", weights: list[float] | None = None, overhead: int = 8, seed: int = 17) -> DataFrame:
    """docs with (shard, shard_size) added; no shuffle, every other column stays.

    A column of docs that has one of the two names already is not overwritten: the added one gets the first free name of
    ``shard_2``, ``shard_3``, ... (``shard_size_2``, ...), and the caller finds it among the new columns.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    taken = {c.lower() for c in docs.columns}
    free = lambda name: next(c for c in (name, *(f"{name}_{i}" for i in range(2, len(taken) + 3))) if c not in taken)
    return docs.withColumn(free("shard"), rendezvous(F.col(key), weights or [1.0] * shards, seed)).withColumn(free("shard_size"), F.octet_length(body).cast("long") + F.lit(overhead))
