"""Strict readers and deterministic writers of the file formats that reports and catalogs travel in."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import StringType, StructType

BAD = "_bad_record"


def read_csv(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """RFC 4180 records, quoted commas and line breaks included: (good rows, rejected rows with their raw record)."""
    whole = StructType.fromDDL(schema).add(BAD, StringType())
    rows = spark.read.schema(whole).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).csv(path)
    rows = rows.persist()
    good = rows.where(F.col(BAD).isNull()).drop(BAD)
    # Spark does not read the raw record alone
    return good, rows.where(F.col(BAD).isNotNull()).withColumnRenamed(BAD, "record")


def read_json_exact(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """JSON rows of exactly the schema's types; the first that differs fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", multi_line).json(path)


def require_counts(df: DataFrame, expected: dict[str, int], by: str) -> DataFrame:
    """df, or an error if its rows by column ``by`` are not exactly the expected numbers."""
    found = {r[by]: r["count"] for r in df.groupBy(by).count().limit(len(expected) + 1).collect()}
    if found != expected:
        raise ValueError(f"counts by {by} are {found}, expected {expected}")
    return df


def read_release(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Lines (file, line, text) of the files a manifest (file, sha256, lines) lists; one of other bytes or another number of lines fails the read."""
    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").load(folder).select(name.alias("file"), F.sha2("content", 256).alias("found"), F.decode("content", "UTF-8").alias("body"))
    checked = manifest.join(files, "file", "left").withColumn("ok", F.when(F.col("found").eqNullSafe(F.col("sha256")), True).otherwise(F.raise_error(F.concat(F.lit("release file differs: "), F.col("file"))).cast("boolean")))
    body = checked.where("ok").withColumn("held", F.split(F.regexp_replace("body", "\n$", ""), "\n"))
    counted = F.when(F.size("held") == F.col("lines"), F.col("held")).otherwise(F.raise_error(F.concat(F.lit("line count differs: "), F.col("file"))).cast("array<string>"))
    lines = body.select("file", F.posexplode(counted).alias("i", "text"))
    return lines.select("file", (F.col("i") + 1).alias("line"), "text")


@udtf(returnType="sheet string, row int, column string, kind string, value string")
class WorkbookCells:
    """Cells of an XLSX workbook given as bytes; shared strings are resolved, formulas give their stored value."""

    def eval(self, content: bytes):  # noqa: ANN201
        space = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
        with zipfile.ZipFile(io.BytesIO(bytes(content))) as book:
            names = book.namelist()
            shared = []
            if "xl/sharedStrings.xml" in names:
                shared = ["".join(t.text or "" for t in s.iterfind(".//m:t", space)) for s in ET.fromstring(book.read("xl/sharedStrings.xml")).iterfind("m:si", space)]
            for sheet in sorted(n for n in names if n.startswith("xl/worksheets/") and n.endswith(".xml")):
                for cell in ET.fromstring(book.read(sheet)).iterfind(".//m:c", space):
                    place = cell.get("r", "")
                    kind, value = cell.get("t", "n"), cell.findtext("m:v", None, space)
                    if kind == "s" and value is not None:
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = "".join(t.text or "" for t in cell.iterfind(".//m:t", space))
                    yield sheet.rsplit("/", 1)[1], int(place.lstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ") or 0), place.rstrip("0123456789"), kind, value


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, sheet, row, column, kind, value) of all cells of the workbooks under path."""
    spark.udtf.register("castline_workbook_cells", WorkbookCells)
    spark.read.format("binaryFile").load(path).select("path", "content").createOrReplaceTempView("castline_workbooks")
    return spark.sql("SELECT path, c.* FROM castline_workbooks, LATERAL castline_workbook_cells(content) c")


def write_lines(df: DataFrame, path: str, group: str, line: str, order: str, most: int = 5000) -> None:
    """One folder of text files a group, ``most`` lines a file at the most, each group in order."""
    rows = df.select(group, order, F.col(line).cast("string").alias("value")).repartition(group).sortWithinPartitions(group, order).select(group, "value")
    rows.write.mode("errorifexists").partitionBy(group).option("maxRecordsPerFile", most).text(path)


def write_if_changed(df: DataFrame, path: str, keys: list[str]) -> bool:
    """Writes df as Parquet unless the same rows, each as often, are there; a different content under the path is an error.

    Rows are told apart by sums of two hashes over all columns, which repeated rows cannot cancel; ``keys`` must be among the columns.
    """
    spark, columns = df.sparkSession, sorted(df.columns)
    if not set(keys) <= set(columns):
        raise ValueError(f"keys {keys} are not all columns")
    total = lambda salt: F.sum(F.xxhash64(F.lit(salt), *[F.struct(c) for c in columns]).cast("decimal(38,0)"))
    digest = lambda x: x.agg(F.count("*").alias("n"), total(1).alias("a"), total(2).alias("b")).first()
    try:
        there = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        df.write.mode("errorifexists").parquet(path)
        return True
    if sorted(there.columns) != columns or digest(there) != digest(df):
        raise ValueError(f"{path} holds other rows")
    return False


def write_tsv(df: DataFrame, path: str, order: str, ratios: tuple[str, ...] = ()) -> None:
    """Tab-separated files with a header, in order over all files; tabs and line breaks in cells become spaces, ratios have six decimals, null is empty."""
    cell = lambda c: F.format_string("%.6f", c) if c in ratios else F.regexp_replace(F.col(c).cast("string"), r"[\t\r\n]", " ")
    ordered = df.orderBy(order)
    ordered.select([F.when(F.col(c).isNotNull(), cell(c)).alias(c) for c in df.columns]).write.mode("errorifexists").option("sep", "\t").option("header", True).option("quote", "\0").option("emptyValue", "").csv(path)


def markdown_table(df: DataFrame, order: list, most: int = 25) -> str:
    """The first ``most`` rows in order as a Markdown table, with a line for what is left out."""
    n = df.count()
    head = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    cells = [F.coalesce(F.replace(F.regexp_replace(F.col(c).cast("string"), r"[\r\n]+", " "), F.lit("|"), F.lit("\\|")), F.lit("")) for c in df.columns]
    body = [r[0] for r in df.orderBy(*order).limit(most).select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))).collect()]
    return "\n".join([*head, *body, *([f"({n - most} more)"] if n > most else [])]) + "\n"
