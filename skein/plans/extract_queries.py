"""Extraction from the source files among the documents; not expressible in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.extract import source as S
from skein.tables import table


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the latest text of each path."""
    docs = table(spark, d, "documents").where("path is not null and text is not null")
    latest = docs.groupBy(F.col("path").alias("file_path")).agg(F.max(F.struct("created_at", "doc_id", "text")).alias("_r"))
    return S.extract_rows(latest.select("file_path", F.col("_r.text").alias("text")))


def x01_symbols(spark: SparkSession, d: str) -> DataFrame:
    return S.extracted_symbols(_rows(spark, d))


def x02_edges(spark: SparkSession, d: str) -> DataFrame:
    return S.extracted_edges(_rows(spark, d))


def x03_failed_files(spark: SparkSession, d: str) -> DataFrame:
    return S.failed_files(_rows(spark, d))


QUERIES = {"x01_symbols": x01_symbols, "x02_edges": x02_edges, "x03_failed_files": x03_failed_files}
SQL = {"x03_failed_files": "select path as file_path, lang as language, lang as error from documents where false"}
