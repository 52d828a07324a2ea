"""The chunk table over the test tables, and JSON lines scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CHUNK, GOLD

EXTENSIONS = (".txt", ".md", ".pdf", ".py")


def chunk_table(documents: DataFrame) -> DataFrame:
    """Documents as one chunk each, with a path, a page and a date derived from the id."""
    n = F.col("doc_id")
    day = F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (n % 365).cast("int")), "yyyy-MM-dd")
    extension = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (n % 4 + 1).cast("int"))
    name = n.cast("string")
    return documents.select(
        F.concat(F.lit("doc-"), name, F.lit(":000")).alias("chunk_id"),
        F.concat(F.lit("doc-"), name).alias("document_id"),
        F.lit(0).alias("ordinal"),
        "text",
        F.concat("source", F.lit("/"), "lang", F.lit("/"), name, extension).alias("source_path"),
        (n % 7 + 1).cast("int").alias("page"),
        F.col("lang").alias("language"),
        F.when(n % 5 != 0, day).alias("created_at"),
    )


def _json_lines(spark: SparkSession, path: str, schema: str, valid: Column) -> DataFrame:
    """JSON lines, blank ones left out; a bad one fails the whole read, by its file and number.

    All lines are checked before any is returned. The number is looked up in the one file that has the line.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.col("value").rlike(r"\S"))
    parsed = raw.select("value", "file", F.from_json("value", schema).alias("row"))
    bad = parsed.where(~F.coalesce(F.col("row").isNotNull() & valid, F.lit(False))).agg(F.min(F.struct("file", "value")).alias("first")).first()["first"]
    if bad:
        lines = spark.read.text(bad["file"], wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
        number = lines.where(F.col("line") == bad["value"]).agg(F.min("n")).first()[0]
        raise ValueError(f"{bad['file']}:{'?' if number is None else number + 1}: bad line")
    return parsed.select("row.*")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    row = F.col("row")
    return _json_lines(spark, path, CHUNK, row["id"].isNotNull() & row["document_id"].isNotNull() & (row["ordinal"] >= 0) & (F.length(row["text"]) > 0) & row["metadata.source_path"].isNotNull())


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    row = F.col("row")
    return _json_lines(spark, path, GOLD, row["id"].isNotNull() & row["query"].isNotNull() & (F.size(row["relevant_chunk_ids"]) > 0))
