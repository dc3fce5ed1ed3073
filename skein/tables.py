"""Reading the index tables, and the current state of a table of deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the data model.
SYMBOL_KINDS = ("function", "class", "method", "interface", "struct", "enum", "const", "type", "property", "variant")
EDGE_KINDS = ("calls", "imports", "extends", "implements", "instantiates", "references", "references_type")
CLASS_LIKE = ("class", "struct", "interface")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def current_symbols(symbols: DataFrame, columns: list[str]) -> DataFrame:
    """The current row of each id, with the given columns: that of the greatest indexed_at.

    Rows without an id are no symbols. Rows that tie are taken to be identical;
    where they are not, each column has its greatest value among them, so that
    the result is the same on every run. Every column is an aggregate of its
    own, so columns that nobody asks for are neither read nor shuffled, and
    partial aggregation leaves at most one row of an id per task before the shuffle.
    """
    latest = lambda c: F.max(F.struct(F.col("indexed_at"), F.col(c).alias("_v")))["_v"].alias(c)
    rows = symbols.where(F.col("id").isNotNull()).groupBy("id")
    rest = [c for c in columns if c != "id"]
    return rows.agg(*map(latest, rest)) if rest else rows.agg(F.lit(1)).select("id")


def current_edges(edges: DataFrame) -> DataFrame:
    """One row per (from_id, to_id, kind): first insert wins, later ones are ignored.

    Deliveries carry a time, so the first is the one of the smallest
    indexed_at, and of the smallest line where those tie (unknown lines last).
    Line and file are aggregates of their own, of which the longer order begins
    with the shorter one, so both are of the same row and either can be left out.
    """
    order = [F.col("indexed_at"), F.col("line").isNull().alias("_no_line"), F.col("line")]
    return (
        edges.where(F.col("from_id").isNotNull() & F.col("to_id").isNotNull() & F.col("kind").isNotNull())
        .groupBy("from_id", "to_id", "kind")
        .agg(F.min(F.struct(*order, F.col("file_path")))["file_path"].alias("file_path"), F.min(F.struct(*order))["line"].alias("line"))
    )
