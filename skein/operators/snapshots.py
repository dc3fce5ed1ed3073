"""What changed between full snapshots (problem 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.scale import bucket_of, buckets_for, checkpoint

#: A path whose hash is 0 modulo this begins a chunk, so a chunk has about as many files.
CHUNK = 64
PER_BUCKET = 200_000


def clean_path(path: Column) -> Column:
    """One spelling per relative path: '/' only, no repeated separators, no '.' segments."""
    segments = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda s: (s != "") & (s != "."))
    return F.array_join(segments, "/")


def clean_hash(value: Column) -> Column:
    """Lower-case hex of a SHA-256 value however written; null where it is null or blank."""
    bare = F.regexp_replace(F.lower(value), r"^\s*(?:sha-?256\s*[:=\-]?\s*)?|[\s:\-]+", "")
    return F.when(bare != "", bare)


def listed_files(file_hashes: DataFrame) -> DataFrame:
    """One row (snapshot_no, path, hash) per file and snapshot; hash is null where unknown.

    Of a file listed more than once the row of the greatest indexed_at holds (a
    known hash, the greatest, where those tie). Rows without path or number of
    snapshot say nothing and are left out.
    """
    rows = file_hashes.select(
        F.col("snapshot_no"),
        clean_path(F.col("file_path")).alias("path"),
        F.struct(F.col("indexed_at").alias("at"), clean_hash(F.col("hash")).alias("hash")).alias("r"),
    ).where("snapshot_no is not null and path is not null")
    return rows.groupBy("snapshot_no", "path").agg(F.max("r").alias("r")).select("snapshot_no", "path", F.col("r.hash").alias("hash"))


def snapshot_changes(file_hashes: DataFrame, chunk: int = CHUNK, per_bucket: int = PER_BUCKET) -> DataFrame:
    """(snapshot_no, change, file_path): what each snapshot changed against the delivered one before it.

    The files of a snapshot lie in hash buckets, sorted by path. A path whose
    own hash says so begins a chunk, so chunks are cut alike in every snapshot,
    and what is added or removed moves no other chunk. A chunk's digest is taken
    over its rows; chunks with the digest they had before are dropped, and only
    the rows of the others are joined, by path, and classified.

    A null or blank hash stands for the file's hash in the snapshot before
    (again and again, if need be); where there is none, the hash is unknown,
    and an unknown hash never makes a file 'changed'. The first snapshot has no
    changes; no rows give none.
    """
    spark = file_hashes.sparkSession
    files = listed_files(file_hashes)
    order = files.select("snapshot_no").distinct().select("snapshot_no", F.lit(1).alias("_one"))
    # As many rows as there are snapshots, whatever the number of files.
    before = order.select("snapshot_no", F.lag("snapshot_no").over(Window.partitionBy("_one").orderBy("snapshot_no")).alias("_before"))
    before = F.broadcast(checkpoint(before))
    buckets = buckets_for(file_hashes.count(), per_bucket, spark)
    spread = files.join(before, "snapshot_no").withColumn("_bucket", bucket_of(buckets, "path")).repartition("_bucket")
    of_file = Window.partitionBy("_bucket", "path").orderBy("snapshot_no")
    # A hash is carried on only while the file stays: a gap in its snapshots begins a new stay.
    filled = spread.withColumn("_new", (~F.lag("snapshot_no").over(of_file).eqNullSafe(F.col("_before"))).cast("int"))
    filled = filled.withColumn("_stay", F.sum("_new").over(of_file.rowsBetween(Window.unboundedPreceding, 0)))
    in_stay = Window.partitionBy("_bucket", "path", "_stay").orderBy("snapshot_no").rowsBetween(Window.unboundedPreceding, 0)
    filled = filled.withColumn("hash", F.last("hash", ignorenulls=True).over(in_stay))
    by_path = Window.partitionBy("_bucket").orderBy("path").rangeBetween(Window.unboundedPreceding, 0)
    first_of_path = F.row_number().over(of_file) == 1
    begins = (F.pmod(F.xxhash64("path", F.lit(7)), F.lit(chunk)) == 0) & first_of_path
    chunked = filled.withColumn("_begins", begins.cast("int")).select(
        "_bucket", "snapshot_no", "_before", "path", "hash", F.sum("_begins").over(by_path).alias("_chunk")
    )
    chunked = checkpoint(chunked)
    digests = chunked.groupBy("_bucket", "_chunk", "snapshot_no").agg(
        F.sum(F.xxhash64("path", "hash").cast("decimal(38,0)")).alias("_sum"),
        F.bit_xor(F.xxhash64("hash", "path", F.lit(3))).alias("_xor"),
        F.count(F.lit(1)).alias("_n"),
    )
    # For each chunk, the pairs of consecutive snapshots in which its digest differs; a chunk may be missing on either side.
    pairs = before.where("_before is not null")
    now = digests.join(pairs, "snapshot_no").select("_bucket", "_chunk", "snapshot_no", F.struct("_sum", "_xor", "_n").alias("_now"))
    then = digests.withColumnRenamed("snapshot_no", "_before").join(pairs, "_before")
    then = then.select("_bucket", "_chunk", "snapshot_no", F.struct("_sum", "_xor", "_n").alias("_then"))
    both = now.join(then, ["_bucket", "_chunk", "snapshot_no"], "full")
    unlike = both.where(~F.col("_now").eqNullSafe(F.col("_then"))).select("_bucket", "_chunk", "snapshot_no")
    unlike = checkpoint(unlike)
    new = chunked.drop("_before").join(unlike, ["_bucket", "_chunk", "snapshot_no"]).withColumn("_in", F.lit(True))
    old = (
        chunked.drop("_before")
        .withColumnRenamed("snapshot_no", "_before")
        .join(pairs, "_before")
        .drop("_before")
        .join(unlike, ["_bucket", "_chunk", "snapshot_no"])
        .select("snapshot_no", "path", F.col("hash").alias("_old"), F.lit(True).alias("_was"))
    )
    joined = new.select("snapshot_no", "path", "hash", "_in").join(old, ["snapshot_no", "path"], "full")
    change = (
        F.when(F.col("_was").isNull(), "added")
        .when(F.col("_in").isNull(), "removed")
        .when(F.col("hash") != F.col("_old"), "changed")
    )
    return joined.select("snapshot_no", change.alias("change"), F.col("path").alias("file_path")).where("change is not null")
