"""Keyset paging: predicates after a cursor, and the cursor's codec."""

from __future__ import annotations

import base64
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def after(keys: list[tuple[str, str]], cursor: dict) -> Column:
    """Rows after the cursor in the order of keys [(column, "asc" or "desc")]: an OR of ANDs that stays pushable.

    Nulls come last in either direction: they follow every value, and nothing of the same key follows them.
    """
    same = lambda k: F.col(k).isNull() if cursor[k] is None else F.col(k) == F.lit(cursor[k])
    branches = []
    for i, (name, way) in enumerate(keys):
        if cursor[name] is None:
            continue
        last = F.col(name) > F.lit(cursor[name]) if way == "asc" else F.col(name) < F.lit(cursor[name])
        branches.append(reduce(lambda a, b: a & b, [same(k) for k, _ in keys[:i]], last | F.col(name).isNull()))
    return reduce(lambda a, b: a | b, branches, F.lit(False))


def ordering(keys: list[tuple[str, str]]) -> list[Column]:
    return [F.col(k).asc_nulls_last() if way == "asc" else F.col(k).desc_nulls_last() for k, way in keys]


def numbered(rows: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """rows with their place, from 1, in a total order over the whole table: sorted by ranges, each range's numbers moved by the rows of those before it.

    The sorted ranges are checkpointed, so that the counts and the numbers are of the same ranges; only a row a range is windowed alone.
    """
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    held = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_range": F.spark_partition_id(), "_inside": inside}))
    counts = held.groupBy("_range").agg(F.count("*").alias("_c"))
    before = counts.select("_range", (F.sum("_c").over(Window.orderBy("_range")) - F.col("_c")).alias("_before"))
    return held.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_inside") + 1).drop("_range", "_inside", "_before")


def encode_cursor(mode: str, values: dict) -> str:
    text = json.dumps({"m": mode, **values}, sort_keys=True, separators=(",", ":"))
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def decode_cursor(mode: str, cursor: str, fields: dict[str, type]) -> dict:
    """The cursor's values; ValueError unless it is the canonical text of exactly these fields of this mode."""
    try:
        values = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except Exception as error:
        raise ValueError("cursor is not readable") from error
    if not isinstance(values, dict) or values.pop("m", None) != mode or set(values) != set(fields):
        raise ValueError("cursor is of another kind")
    if any(type(values[k]) is not kind for k, kind in fields.items()) or encode_cursor(mode, values) != cursor:
        raise ValueError("cursor is not canonical")
    return values
