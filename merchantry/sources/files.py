"""File sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def tsv(spark: SparkSession, path: str, columns: Sequence[str], start: int = 0) -> DataFrame:
    """Lines split at tabs into named columns, from line `start` (from 0) of each file on. A reader that skips by line
    reads a file in one piece; without a start, files are split."""
    if start:
        lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
        lines = lines.where((F.col("line") >= start) & (F.col("value") != "")).select("value")
    else:
        lines = spark.read.text(path).where("value <> ''")
    parts = F.split("value", "\t", -1)
    return lines.select(*(F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(columns)))


def write_tsv(rows: DataFrame, path: str) -> None:
    """Rows as tab-separated text, quotes only where a value needs them; nulls as empty fields."""
    rows.write.csv(path, sep="\t", quote="\0", escape="\0", emptyValue="", nullValue="")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """A list with an entry a line: trimmed, without blank lines."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


def captured_pages(spark: SparkSession, path: str, item: str) -> DataFrame:
    """Captured responses of a paged service, each a JSON array, as rows (S14). Empty pages end such a feed and add no
    rows. item: the schema of an element."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", f"array<{item}>")).alias("row")).select("row.*")


def enveloped(c: Column, schema: str) -> Column:
    """JSON inside a script envelope: everything outside the outermost braces or brackets is cut off."""
    return F.from_json(F.regexp_extract(c, r"(?s)([\[{].*[\]}])", 1), schema)


def posted(c: Column, schema: StructType | str) -> Column:
    """A request body as a record (S23): names that are not there are null."""
    return F.from_json(c, schema)


def html_report(rows: DataFrame, order: Sequence[str], title: str) -> DataFrame:
    """A table as lines of HTML in order, odd and even rows told apart (K11). A report is read by people: it is ordered by
    one sort, and written as one file by the caller if wanted."""
    cells = F.concat(*(F.concat(F.lit("<td>"), F.coalesce(_escaped(c), F.lit("")), F.lit("</td>")) for c in rows.columns))
    number = F.monotonically_increasing_id()
    body = rows.orderBy(*order).select(F.concat(F.lit('<tr class="'), F.when(number % 2 == 0, "even").otherwise("odd"), F.lit('">'), cells, F.lit("</tr>")).alias("value"))
    spark = rows.sparkSession
    head = spark.createDataFrame([(f"<table><caption>{title}</caption>",)], "value string")
    return head.union(body).union(spark.createDataFrame([("</table>",)], "value string"))


def _escaped(name: str) -> Column:
    c = F.col(name).cast("string")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def as_response(rows: DataFrame) -> DataFrame:
    """Each row as a JSON text."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
