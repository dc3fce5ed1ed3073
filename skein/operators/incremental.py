"""Keeping an index up to date: change detection, replacing files' rows, staleness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.graph import CodeGraph


def latest_hashes(file_hashes: DataFrame) -> DataFrame:
    """(file_path, hash, indexed_at): the last known row of each path; a later row replaces an earlier one."""
    row = F.struct("indexed_at", "snapshot_no", "hash")
    return file_hashes.where("file_path is not null").groupBy("file_path").agg(F.max(row).alias("_r")).select(
        "file_path", F.col("_r.hash").alias("hash"), F.col("_r.indexed_at").alias("indexed_at")
    )


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change, file_path) between two listings (file_path, hash): added, modified or deleted."""
    o = old.select("file_path", F.col("hash").alias("_old"), F.lit(True).alias("_was"))
    n = new.select("file_path", F.col("hash").alias("_new"), F.lit(True).alias("_is"))
    change = (
        F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "deleted").when(~F.col("_old").eqNullSafe(F.col("_new")), "modified")
    )
    return o.join(n, "file_path", "full").select(change.alias("change"), "file_path").where("change is not null")


def content_hashes(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(file_path, hash): SHA-256 of each text's UTF-8 bytes, in lower-case hex."""
    return texts.where(F.col(path).isNotNull() & F.col(text).isNotNull()).select(F.col(path).alias("file_path"), F.sha2(text, 256).alias("hash"))


def without_files(graph: CodeGraph, files: DataFrame) -> CodeGraph:
    """The graph without the symbols and edges of the files (file_path), nor members of removed symbols."""
    gone = files.select("file_path").distinct()
    kept = graph.symbols.join(gone, "file_path", "left_anti")
    lost = graph.symbols.join(gone, "file_path", "left_semi").select(F.col("id").alias("parent_id"))
    orphaned = kept.join(lost, "parent_id", "left_semi").select("id")
    return CodeGraph(kept.join(orphaned, "id", "left_anti"), graph.edges.join(gone, "file_path", "left_anti"))


def replace_files(graph: CodeGraph, files: DataFrame, new: CodeGraph) -> CodeGraph:
    """The graph with the rows of the files replaced by those of new; of edges with one key the first stays."""
    base = without_files(graph, files)
    edges = base.edges.withColumn("_new", F.lit(0)).unionByName(new.edges.withColumn("_new", F.lit(1)))
    first = F.min(F.struct("_new", F.col("line").isNull().alias("_no"), "line", "file_path")).alias("_e")
    edges = edges.groupBy("from_id", "to_id", "kind").agg(first)
    edges = edges.select("from_id", "to_id", "kind", F.col("_e.file_path").alias("file_path"), F.col("_e.line").alias("line"))
    return CodeGraph(base.symbols.unionByName(new.symbols), edges)


def stale_files(listing: DataFrame, hashes: DataFrame) -> DataFrame:
    """(file_path, why): files changed since they were indexed, or gone; listing has file_path and mtime (epoch seconds)."""
    both = hashes.select("file_path", "indexed_at").join(listing.select("file_path", "mtime"), "file_path", "left")
    why = F.when(F.col("mtime").isNull(), "gone").when(F.col("mtime") > F.col("indexed_at"), "newer")
    return both.select("file_path", why.alias("why")).where("why is not null")
