"""The star schema as DataFrames over the Parquet tables, and the same as SQL views.

Facts are catch reports; fish, bases, locations and baits are dimensions, and
memberships say which fish a base holds with which weight bounds.  Two logs
append: activity events and weekly record snapshots.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.texts import collapsed, half_width


class Tables:
    """Lazy DataFrames of one data directory; only the columns a query uses are read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def fish(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("fish_id"), F.col("p_name").alias("name"), F.lower("p_name").alias("name_normalized"),
            (F.col("p_size") % 10 == 0).alias("is_rarest"), (F.col("p_size") % 9 != 0).alias("is_active"),
        )

    @cached_property
    def base(self) -> DataFrame:
        return self.raw("nation").select(
            F.col("n_nationkey").alias("base_id"), F.col("n_name").alias("name"), F.lower("n_name").alias("name_normalized"), (F.col("n_nationkey") % 11 != 3).alias("is_active")
        )

    @cached_property
    def location(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("location_id"), F.col("s_nationkey").alias("base_id"), F.col("s_suppkey").cast("int").alias("number"), F.col("s_name").alias("name"), (F.col("s_acctbal") > -500).alias("is_active")
        )

    @cached_property
    def bait(self) -> DataFrame:
        n = F.col("l_linenumber")
        kinds = self.raw("lineitem").select(n.alias("bait_id")).distinct()
        return kinds.select("bait_id", F.concat(F.lit("bait "), F.col("bait_id").cast("string")).alias("name"), F.when(F.col("bait_id") > 4, "LURE").otherwise("BAIT").alias("type"))

    @cached_property
    def report(self) -> DataFrame:
        joined = self.raw("lineitem").join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        n, flag, status = F.col("l_linenumber"), F.col("l_returnflag"), F.col("l_linestatus")
        tax, external = F.round(F.col("l_tax") * 100).cast("int"), F.col("o_orderstatus") == "P"
        key = F.col("l_orderkey") * 10 + n
        depth = F.round(F.col("l_discount") * 100).cast("int") * 10
        spinning = n > 4
        spelled = F.when(F.col("l_orderkey") % 3 == 0, "Near  Stone").when(F.col("l_orderkey") % 3 == 1, " near stone ").otherwise("NEAR STONE")
        return joined.select(
            key.alias("report_id"), F.col("o_custkey").alias("user_id"),
            F.when(external, F.concat(F.lit("external:"), (F.col("o_custkey") % 50).cast("string"))).otherwise(F.concat(F.lit("local-user:"), F.col("o_custkey").cast("string"))).alias("contributor_key"),
            F.when(external, F.concat(F.lit("imp:"), key.cast("string"))).alias("import_key"),
            F.col("l_suppkey").alias("location_id"), F.col("l_partkey").alias("fish_id"), n.alias("bait_id"),
            F.round(F.col("l_quantity") * 100).cast("int").alias("weight_grams"),
            F.when(spinning, "SPINNING").otherwise("BAIT_FISHING").alias("fishing_method"),
            F.nullif(depth, F.lit(0)).alias("hole_depth_cm"),
            F.when(tax == 0, None).when(tax == 1, "  ").otherwise(spelled).alias("spot_position_raw"),
            F.when(flag == "A", "MIDWATER").when(flag == "N", "FROM_BOTTOM").alias("fishing_note"),
            F.when(spinning & (flag != "N"), F.when(status == "O", "SMALL").otherwise("LARGE")).alias("spinning_size"),
            F.when(spinning & (status == "O"), F.when(flag == "A", "SLOW").when(flag == "N", "MEDIUM").otherwise("FAST")).alias("spinning_speed"),
            F.when(F.col("l_tax") > 0.055, F.concat(F.lit("note "), flag)).alias("user_note_raw"), F.col("l_shipdate").alias("created_at"),
        )

    @cached_property
    def member(self) -> DataFrame:
        pair = self.raw("lineitem").join(self.raw("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("s_nationkey").alias("base_id"), F.col("l_partkey").alias("fish_id"), "l_quantity")
        total = F.col("base_id") + F.col("fish_id")
        most = pair.where(total % 5 != 0).groupBy("base_id", "fish_id").agg(F.max("l_quantity").alias("q"))
        return most.select(
            "base_id", "fish_id", F.when(total % 7 == 0, None).otherwise(F.lit(500)).alias("min_weight_grams"), F.when(total % 6 == 0, None).otherwise(F.round(F.col("q") * 97).cast("int")).alias("max_weight_grams")
        )

    @cached_property
    def event(self) -> DataFrame:
        kind = F.col("event_type")
        kinds = F.when(kind == "signup", "CATCH_REPORT_CREATED").when(kind == "purchase", "CATCH_REPORT_BATCH_CREATED").when(kind == "click", "CATCH_REPORT_UPDATED").when(kind == "error", "CATCH_REPORT_DELETED").otherwise("CATALOG_ITEM_CREATED")
        return self.raw("events").select("event_id", kinds.alias("type"), F.col("user_id").alias("actor_user_id"), F.col("props").alias("payload"), F.col("ts").alias("occurred_at"))

    @cached_property
    def snapshot(self) -> DataFrame:
        return self.raw("events").where("value >= 1").select(
            "event_id", (F.col("user_id") % 40).alias("fish_id"), F.nullif(F.col("user_id") % 5, F.lit(0)).alias("base_id"), F.round(F.col("value") * 100).cast("int").alias("weight_grams"), F.col("ts").alias("caught_at")
        )


def spot_key(raw: Column) -> Column:
    """A spot's name with white space folded, trimmed and lower-cased; blank is null."""
    return F.nullif(F.lower(collapsed(half_width(raw))), F.lit(""))


#: The same views as SQL text, each a CTE for the queries' SQL.
VIEWS = {
    "fish": "SELECT p_partkey AS fish_id, p_name AS name, lower(p_name) AS name_normalized, p_size % 10 = 0 AS is_rarest, p_size % 9 <> 0 AS is_active FROM part",
    "base": "SELECT n_nationkey AS base_id, n_name AS name, lower(n_name) AS name_normalized, n_nationkey % 11 <> 3 AS is_active FROM nation",
    "location": "SELECT s_suppkey AS location_id, s_nationkey AS base_id, CAST(s_suppkey AS INT) AS number, s_name AS name, s_acctbal > -500 AS is_active FROM supplier",
    "bait": "SELECT DISTINCT l_linenumber AS bait_id, concat('bait ', CAST(l_linenumber AS STRING)) AS name, CASE WHEN l_linenumber > 4 THEN 'LURE' ELSE 'BAIT' END AS type FROM lineitem",
    "report": """SELECT l_orderkey * 10 + l_linenumber AS report_id, o_custkey AS user_id,
        CASE WHEN o_orderstatus = 'P' THEN concat('external:', CAST(o_custkey % 50 AS STRING)) ELSE concat('local-user:', CAST(o_custkey AS STRING)) END AS contributor_key,
        CASE WHEN o_orderstatus = 'P' THEN concat('imp:', CAST(l_orderkey * 10 + l_linenumber AS STRING)) END AS import_key,
        l_suppkey AS location_id, l_partkey AS fish_id, l_linenumber AS bait_id, CAST(round(l_quantity * 100) AS INT) AS weight_grams,
        CASE WHEN l_linenumber > 4 THEN 'SPINNING' ELSE 'BAIT_FISHING' END AS fishing_method,
        NULLIF(CAST(round(l_discount * 100) AS INT) * 10, 0) AS hole_depth_cm,
        CASE WHEN CAST(round(l_tax * 100) AS INT) = 0 THEN NULL WHEN CAST(round(l_tax * 100) AS INT) = 1 THEN '  '
             WHEN l_orderkey % 3 = 0 THEN 'Near  Stone' WHEN l_orderkey % 3 = 1 THEN ' near stone ' ELSE 'NEAR STONE' END AS spot_position_raw,
        CASE l_returnflag WHEN 'A' THEN 'MIDWATER' WHEN 'N' THEN 'FROM_BOTTOM' END AS fishing_note,
        CASE WHEN l_linenumber > 4 AND l_returnflag <> 'N' THEN CASE WHEN l_linestatus = 'O' THEN 'SMALL' ELSE 'LARGE' END END AS spinning_size,
        CASE WHEN l_linenumber > 4 AND l_linestatus = 'O' THEN CASE l_returnflag WHEN 'A' THEN 'SLOW' WHEN 'N' THEN 'MEDIUM' ELSE 'FAST' END END AS spinning_speed,
        CASE WHEN l_tax > 0.055 THEN concat('note ', l_returnflag) END AS user_note_raw, l_shipdate AS created_at
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "member": """SELECT s_nationkey AS base_id, l_partkey AS fish_id, CASE WHEN (s_nationkey + l_partkey) % 7 = 0 THEN NULL ELSE 500 END AS min_weight_grams,
        CASE WHEN (s_nationkey + l_partkey) % 6 = 0 THEN NULL ELSE CAST(round(max(l_quantity) * 97) AS INT) END AS max_weight_grams
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE (s_nationkey + l_partkey) % 5 <> 0 GROUP BY s_nationkey, l_partkey""",
    "event": """SELECT event_id, CASE event_type WHEN 'signup' THEN 'CATCH_REPORT_CREATED' WHEN 'purchase' THEN 'CATCH_REPORT_BATCH_CREATED'
        WHEN 'click' THEN 'CATCH_REPORT_UPDATED' WHEN 'error' THEN 'CATCH_REPORT_DELETED' ELSE 'CATALOG_ITEM_CREATED' END AS type,
        user_id AS actor_user_id, props AS payload, ts AS occurred_at FROM events""",
    "snapshot": "SELECT event_id, user_id % 40 AS fish_id, NULLIF(user_id % 5, 0) AS base_id, CAST(round(value * 100) AS INT) AS weight_grams, ts AS caught_at FROM events WHERE value >= 1",
}
SPOT_KEY_SQL = "NULLIF(lower(trim(regexp_replace(spot_position_raw, '\\s+', ' ', 'g'))), '')"


def with_views(sql: str) -> str:
    """The query text with the views it names as CTEs in front."""
    used = [f"{name} AS ({text})" for name, text in VIEWS.items() if f"{{{name}}}" in sql]
    body = sql
    for name in VIEWS:
        body = body.replace(f"{{{name}}}", name)
    body = body.replace("{spot_key}", SPOT_KEY_SQL)
    head = ", ".join(used)
    if body.lstrip().startswith("WITH "):
        return f"WITH {head}, " + body.lstrip()[5:] if used else body
    return (f"WITH {head} " if used else "") + body
