"""Page corpora in, Markdown reports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberkeep.operators.documents import document_report


def read_pages(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """(url, html) rows from Parquet, or from one text or HTML file per page."""
    if format == "parquet":
        return spark.read.parquet(path)
    if format == "text":
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))
    if format == "binary":
        files = spark.read.format("binaryFile").load(path)
        return files.select(F.col("path").alias("url"), F.decode("content", "UTF-8").alias("html"))
    raise ValueError("format must be parquet, text or binary")


def write_markdown_reports(pages: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write reports as text below ``path``, the sections of a document in order.

    Rows are range-partitioned by (doc_id, section_no): a long document spreads
    over neighbouring files instead of filling one task.
    """
    report = document_report(pages)
    keys = ["doc_id", "section_no"]
    placed = report.repartitionByRange(partitions, *keys) if partitions else report.repartitionByRange(*keys)
    placed.sortWithinPartitions(*keys).select("text").write.text(path)
