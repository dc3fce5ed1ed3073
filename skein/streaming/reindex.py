"""Micro-batch re-indexing: a stream of file changes keeps symbols and edges up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.extract.source import extract_rows, extracted_edges, extracted_symbols
from skein.operators.graph import SYMBOL, CodeGraph
from skein.operators.incremental import replace_files

#: A change: what became of a file, its new text, and the order of changes.
CHANGE = "file_path string, text string, change string, seq bigint"

_SYMBOLS = "id string, name string, kind string, file_path string, line_start int, line_end int, signature string, docstring string, parent_id string, language string, metadata string"
_EDGES = "from_id string, to_id string, kind string, file_path string, line int"


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches that were written to their end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = []
    for entry in fs.listStatus(path):
        name = entry.getPath().getName()
        if name.startswith("batch-") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "edges/_SUCCESS")):
            done.append(int(name.removeprefix("batch-")))
    return sorted(done)


def indexed(spark: SparkSession, folder: str, before: int | None = None) -> CodeGraph:
    """The graph as the last complete batch (ahead of `before`) left it; empty if there is none."""
    known = [v for v in _versions(spark, folder) if before is None or v < before]
    if not known:
        return CodeGraph(spark.createDataFrame([], _SYMBOLS), spark.createDataFrame([], _EDGES))
    at = f"{folder}/batch-{known[-1]}"
    return CodeGraph(spark.read.schema(_SYMBOLS).parquet(f"{at}/symbols"), spark.read.schema(_EDGES).parquet(f"{at}/edges"))


def apply_changes(graph: CodeGraph, changes: DataFrame) -> CodeGraph:
    """The graph after changes (CHANGE): of each file the last one holds; 'deleted' removes it, anything else replaces its rows."""
    last = changes.where("file_path is not null").groupBy("file_path").agg(F.max(F.struct("seq", "change", "text")).alias("_c"))
    last = last.select("file_path", F.col("_c.change").alias("change"), F.col("_c.text").alias("text"))
    rows = extract_rows(last.where("change is null or change <> 'deleted'"))
    new = CodeGraph(extracted_symbols(rows).select(SYMBOL), extracted_edges(rows))
    return replace_files(graph, last, new)


def start(changes: DataFrame, folder: str, checkpoint: str, every: str = "300 milliseconds") -> StreamingQuery:
    """Applies a stream of changes to the tables in folder, one version a batch.

    A batch builds on the version before it and overwrites its own, so a batch
    that is run again after a failure gives the same tables. events/ gets a
    row per batch with its counts.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows.persist()
        after = apply_changes(indexed(spark, folder, number), rows)
        at = f"{folder}/batch-{number}"
        after.symbols.write.mode("overwrite").parquet(f"{at}/symbols")
        after.edges.write.mode("overwrite").parquet(f"{at}/edges")
        event = rows.agg(F.lit("reindex").alias("event"), F.lit(number).alias("batch"), F.countDistinct("file_path").alias("files"), F.count(F.lit(1)).alias("changes"))
        event.coalesce(1).write.mode("overwrite").json(f"{at}/event")
        rows.unpersist()

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
