"""Ingestion: lines, HTML pages, exact numbers in text, identities, generated and split files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import decimal_text
from ..plans.registry import query
from ..plans.tables import Tables
from ..sources.html import HtmlBlocks
from .inference import copies

#: Report ids of a cell, the unit in which running sums are taken.
CELL = 1 << 16


@query(
    "text_lines",
    """
SELECT conv_id, turn, CAST(i AS INT) AS line, l AS text FROM (SELECT conv_id, turn, unnest(a) AS l, generate_subscripts(a, 1) AS i FROM (SELECT conv_id, turn, regexp_split_to_array(text, '\\r\\n|[\\n\\r]') AS a FROM conversations)) WHERE trim(l) <> ''
""",
)
def text_lines(t: Tables) -> DataFrame:
    """Non-blank lines with their physical numbers."""
    rows = t.raw("conversations").select("conv_id", "turn", F.posexplode(F.split("text", r"\r\n|[\n\r]")).alias("i", "text"))
    return rows.where(F.trim("text") != "").select("conv_id", "turn", (F.col("i") + 1).alias("line"), "text")


@query("page_links", "SELECT page_id, count(*) AS links, count(DISTINCT u) AS targets, min(u) AS first_target FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS u FROM pages) GROUP BY page_id")
def page_links(t: Tables) -> DataFrame:
    """Links of each page."""
    rows = t.raw("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'))).alias("u"))
    return rows.groupBy("page_id").agg(F.count("*").alias("links"), F.countDistinct("u").alias("targets"), F.min("u").alias("first_target"))


@query("page_blocks")
def page_blocks(t: Tables) -> DataFrame:
    """Text blocks of each page; the parser runs row by row where SQL cannot read HTML."""
    t.spark.udtf.register("castline_html_blocks", HtmlBlocks)
    t.raw("pages").select("page_id", "html").createOrReplaceTempView("castline_pages")
    return t.spark.sql("SELECT page_id, b.kind, b.ordinal, b.body FROM castline_pages, LATERAL castline_html_blocks(html) b")


@query(
    "weight_text",
    """
WITH x AS (SELECT report_id, weight_grams, CASE report_id % 4 WHEN 0 THEN CAST(weight_grams // 1000 AS VARCHAR) || ',' || lpad(CAST(weight_grams % 1000 AS VARCHAR), 3, '0') WHEN 1 THEN CAST(weight_grams // 1000 AS VARCHAR) WHEN 2 THEN 'abc' ELSE ' 12.5 ' END AS s FROM {report})
SELECT report_id, CASE report_id % 4 WHEN 0 THEN CAST(weight_grams AS BIGINT) WHEN 1 THEN CAST(weight_grams // 1000 * 1000 AS BIGINT) WHEN 2 THEN NULL ELSE 12500 END AS grams FROM x
""",
)
def weight_text(t: Tables) -> DataFrame:
    """Weights written as text and read back exactly."""
    g, kind = F.col("weight_grams"), F.col("report_id") % 4
    kilos = F.floor(g / 1000).cast("string")
    text = F.when(kind == 0, F.concat(kilos, F.lit(","), F.lpad((g % 1000).cast("string"), 3, "0"))).when(kind == 1, kilos).when(kind == 2, "abc").otherwise(" 12.5 ")
    return t.report.select("report_id", text.alias("s")).select("report_id", decimal_text(F.col("s"), 3).alias("grams"))


@query("identities", "SELECT report_id, concat('external:', sha256(concat('catch', chr(0), contributor_key))) AS identity, sha256(concat_ws('|', CAST(fish_id AS VARCHAR), CAST(location_id AS VARCHAR), CAST(weight_grams AS VARCHAR))) AS content FROM {report} WHERE import_key IS NOT NULL")
def identities(t: Tables) -> DataFrame:
    """Namespaced identities and content hashes of imported reports."""
    name = F.concat(F.lit("external:"), F.sha2(F.concat(F.lit("catch\0"), F.col("contributor_key")), 256))
    content = F.sha2(F.concat_ws("|", F.col("fish_id").cast("string"), F.col("location_id").cast("string"), F.col("weight_grams").cast("string")), 256)
    return t.report.where("import_key is not null").select("report_id", name.alias("identity"), content.alias("content"))


@query(
    "projected_lines",
    """
WITH c AS (SELECT fish_id, bait_id, count(*) AS i, CAST(('0x' || substr(sha256(concat('count|', fish_id, '|', bait_id)), 1, 2)) AS INT) % 4 AS d FROM {report} GROUP BY ALL),
b AS (SELECT *, CASE WHEN i <= 10 THEN i WHEN i >= 55000 THEN 100 ELSE CAST(floor(10 + 90 * ln(i / 10.0) / ln(5500.0) + 0.5) AS BIGINT) END AS base FROM c),
e AS (SELECT fish_id, bait_id, unnest(range(1, CAST(CASE WHEN i <= 10 THEN base ELSE greatest(10, least(100, base + CASE d WHEN 0 THEN -1 WHEN 3 THEN 1 ELSE 0 END)) END AS BIGINT) + 1)) AS copy FROM b)
SELECT fish_id, bait_id, copy, concat(f.name, ' ', CAST(copy * 10 AS VARCHAR), ' g. ', b.name) AS line FROM e JOIN {fish} f USING (fish_id) JOIN {bait} b USING (bait_id)
""",
)
def projected_lines(t: Tables) -> DataFrame:
    """Each counted pair written out as the 1 to 100 lines that stand for its reports."""
    counts = t.report.groupBy("fish_id", "bait_id").agg(F.count("*").alias("n"))
    rows = counts.select("fish_id", "bait_id", F.explode(F.sequence(F.lit(1).cast("long"), copies(F.col("n"), F.concat_ws("|", F.col("fish_id").cast("string"), F.col("bait_id").cast("string"))))).alias("copy"))
    named = rows.join(t.fish.select("fish_id", "name"), "fish_id").join(t.bait.select("bait_id", F.col("name").alias("bait")), "bait_id")
    return named.select("fish_id", "bait_id", "copy", F.concat("name", F.lit(" "), (F.col("copy") * 10).cast("string"), F.lit(" g. "), "bait").alias("line"))


@query(
    "file_buckets",
    """
WITH s AS (SELECT l.base_id, report_id, length(fishing_method) + 20 AS size, sum(length(fishing_method) + 20) OVER w AS run, row_number() OVER w AS n FROM {report} r JOIN {location} l ON l.location_id = r.location_id WINDOW w AS (PARTITION BY l.base_id ORDER BY report_id ROWS UNBOUNDED PRECEDING))
SELECT base_id, greatest((n - 1) // 500, (run - size) // 10000) AS file, count(*) AS lines, CAST(sum(size) AS BIGINT) AS bytes FROM s GROUP BY ALL
""",
)
def file_buckets(t: Tables) -> DataFrame:
    """Lines of each base dealt to files of at most 500 lines or about 10,000 bytes by running sums.

    Sums run inside cells of report ids, which hold a bounded number of rows, and
    start from what the cells before hold; so no base is ordered in one task.
    """
    size = F.length("fishing_method") + 20
    cell = F.expr(f"report_id div {CELL}")
    rows = t.report.join(t.location.select("location_id", "base_id"), "location_id").select("base_id", "report_id", cell.alias("cell"), size.cast("long").alias("size"))
    earlier = Window.partitionBy("base_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy("base_id", "cell").agg(F.count("*").alias("c"), F.sum("size").alias("s"))
    cells = cells.select("base_id", "cell", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c"), F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("s"))
    w = Window.partitionBy("base_id", "cell").orderBy("report_id")
    rows = rows.withColumn("run", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.row_number().over(w)).join(cells, ["base_id", "cell"])
    return rows.withColumn("file", F.greatest(F.expr("(n + c - 1) div 500"), F.expr("(run + s - size) div 10000"))).groupBy("base_id", "file").agg(F.count("*").alias("lines"), F.sum("size").alias("bytes"))


@query("source_label_counts", "SELECT source, lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, max(n_chars) AS longest FROM documents GROUP BY ALL")
def source_label_counts(t: Tables) -> DataFrame:
    return t.raw("documents").groupBy("source", "lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))
