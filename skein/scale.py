"""Helpers that keep iterative and skewed jobs within bounds.

Three needs recur: cutting the lineage of an iterative job so that it survives
lost executors, sizing buckets by the number of rows, and joining a table whose
key is skewed without one task getting all of a hot key.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key counts as hot from this share of the rows on, so there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.002


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where none is set (tests on one machine) a temporary folder."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-skein-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpoint(df: DataFrame, replaces: DataFrame | list[DataFrame] | None = None) -> DataFrame:
    """df, written as a table to the shared checkpoint folder and read from there: its lineage ends at the files.

    Columnar files are a fraction of the size of a checkpointed RDD, and later
    steps read only the columns they need. A loop whose next state takes the
    place of the last one gives that as `replaces`, and its table is removed as
    soon as the new one is written, as are several that nothing reads any more;
    the others when the Python process ends. The shuffle files behind the table
    are removed as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/skein-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    if not _written:
        atexit.register(_remove_written)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._skein_table = path
    for table in replaces if isinstance(replaces, list) else [replaces]:
        if (old := getattr(table, "_skein_table", None)) in _written:
            _remove(_written.pop(old), old)
    return out


#: Spark's setting that an execution's shuffle files go when it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: dict[str, SparkSession] = {}


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _remove_written() -> None:
    for path, spark in _written.items():
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001 - the session has ended already; its folder is the cluster's to clear
            return


def buckets_for(rows: int, per_bucket: int, spark: SparkSession) -> int:
    """Number of buckets so that each gets about per_bucket rows, and every core has some."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_bucket), 1)


def bucket_of(n: int, *cols: Column | str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def hot_keys(df: DataFrame, keys: list[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys that hold more than `share` of the rows: fewer than 1 / share rows, however large df is."""
    total = df.count()
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > F.lit(max(share * total, 1.0))).select(*keys)


def left_join_skewed(big: DataFrame, lookup: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """big left join lookup on `key`; lookup has one row per key.

    Rows of hot keys meet a broadcast of those keys' lookup rows (fewer than
    1 / share of them), so they stay where they are; the others are shuffled.
    """
    hot = checkpoint(hot_keys(big.where(F.col(key).isNotNull()), [key], share))
    hot_rows = F.broadcast(hot.join(lookup, key, "left"))
    marked = big.join(F.broadcast(hot.select(F.col(key), F.lit(True).alias("_hot"))), key, "left")
    few = marked.where(F.col("_hot")).drop("_hot").join(hot_rows, key, "left")
    rest = marked.where(F.col("_hot").isNull()).drop("_hot").join(lookup, key, "left")
    return few.unionByName(rest)


#: Rows of ids up to which a counted table is broadcast; a larger one is joined by shuffle.
FEW_ROWS = 200_000


def lookup_by(table: DataFrame, key: str, most: int = FEW_ROWS) -> Callable[[DataFrame], DataFrame]:
    """A function that left-joins its argument with table, which has one row per key.

    table is written, unless it is read from a checkpoint already, and counted
    once. With at most `most` rows it is broadcast; else hot keys of the other
    side are kept apart from the shuffle.
    """
    table = table if hasattr(table, "_skein_table") else checkpoint(table)
    if table.count() <= most:
        return lambda big: big.join(F.broadcast(table), key, "left")
    return lambda big: left_join_skewed(big, table, key)


#: Words of 64 bits in which likely_in marks values: some MB in memory, however many values there are.
MARKS = 1 << 18


def likely_in(df: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """df without most rows whose `column` isn't in that of values; no row whose is is left out.

    Marks by the hash of every value are broadcast, so that rows are left out
    where they are read, before any shuffle. They drop fewer the more values
    there are; an exact join has to follow.
    """
    hashed = F.xxhash64(column)
    word = F.pmod(hashed, F.lit(MARKS)).cast("int")
    mark = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(hashed, 18), F.lit(64)).cast("int"))
    marks = values.select(word.alias("_word"), mark.alias("_mark")).groupBy("_word").agg(F.bit_or("_mark").alias("_marks"))
    return df.join(F.broadcast(marks), (word == F.col("_word")) & (F.col("_marks").bitwiseAND(mark) != 0), "left_semi")


#: Pairs of one key that a join makes in one task; more are shared out.
PAIRS_TOGETHER = 1_000_000


def join_pairs(left: DataFrame, right: DataFrame, key: str, together: int = PAIRS_TOGETHER) -> DataFrame:
    """left join right on `key`, of which both sides may have many rows.

    Pairs go straight to whoever reads the join. Of a key with more than
    `together` pairs the left rows are shared out by their hash, and the right
    ones repeated; such keys are at most pairs / together, so they are broadcast.
    """
    sizes = left.groupBy(key).agg(F.count(F.lit(1)).alias("_l")).join(right.groupBy(key).agg(F.count(F.lit(1)).alias("_r")), key)
    pairs = F.col("_l") * F.col("_r")
    hot = sizes.where(pairs > together).select(key, F.least(F.ceil(pairs / together), "_l").cast("int").alias("_parts"))
    hot = F.broadcast(checkpoint(hot))
    parts = F.coalesce("_parts", F.lit(1))
    some = left.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(*left.columns), parts).cast("int")).drop("_parts")
    every = right.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return some.join(every, [key, "_part"]).drop("_part")
