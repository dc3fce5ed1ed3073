"""Per-key results where a few keys hold most rows (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default number of salts of a heavy key; each salt's partial is one reduce-side row.
SALTS = 64


def keyed_summary(
    rows: DataFrame,
    keys: list[str],
    distinct_of: str,
    time: str,
    heavy_share: float = 0.001,
    salts: int = SALTS,
) -> DataFrame:
    """Rows, distinct values of one column, and first and last time, for each key, by two salted stages.

    Keys with more than `heavy_share` of all rows (so fewer than 1 / heavy_share
    of them) are salted. The salt is drawn from a hash of the counted value: as
    good as random for the load, yet equal for equal values, so no value is
    counted under two salts and the distinct counts of a key's salts just add
    up. Stage one makes a partial per (key, salt), stage two merges the
    partials of a key. Duplicates of one value are combined before the shuffle.

    Result: the keys, n_rows, n_distinct, first_at, last_at. A null key is a key
    of its own; null values count as rows but not as distinct values; null
    times are passed over. An empty table gives no rows.
    """
    # 128 bits stand for a counted value, so that long values aren't shuffled; they never clash in practice.
    value = F.when(F.col(distinct_of).isNotNull(), F.struct(F.xxhash64(distinct_of).alias("a"), F.xxhash64(F.lit(17), F.col(distinct_of)).alias("b")))
    src = rows.select(*[F.col(k) for k in keys], value.alias("_v"), F.col(time).alias("_t"), F.xxhash64(*keys).alias("_key"))
    total = src.count()
    # Heavy keys by a frequency sketch; it only decides who is salted, the counts themselves are exact.
    most = int(1 / heavy_share)
    sketch = src.select(F.expr(f"approx_top_k(_key, {most}, {10 * most})").alias("_top"))
    heavy = sketch.select(F.explode("_top").alias("_k")).where(F.col("_k.count") > F.lit(heavy_share * total))
    heavy = F.broadcast(heavy.select(F.col("_k.item").alias("_key"), F.lit(True).alias("_heavy")))  # at most 1 / heavy_share rows
    salt = F.when(F.col("_heavy"), F.pmod(F.coalesce("_v.a", F.lit(0)), F.lit(salts))).otherwise(F.lit(0))
    salted = src.join(heavy, "_key", "left").select(*keys, "_v", "_t", salt.cast("int").alias("_salt"))
    values = salted.groupBy(*keys, "_salt", "_v").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_t").alias("_first"), F.max("_t").alias("_last")
    )
    partial = values.groupBy(*keys, "_salt").agg(
        F.sum("_n").alias("_n"),
        F.count("_v").alias("_d"),
        F.min("_first").alias("_first"),
        F.max("_last").alias("_last"),
    )
    return partial.groupBy(*keys).agg(
        F.sum("_n").alias("n_rows"),
        F.sum("_d").alias("n_distinct"),
        F.min("_first").alias("first_at"),
        F.max("_last").alias("last_at"),
    )


def heavy_groups(summary: DataFrame, total: int, share: float = 0.01) -> DataFrame:
    """The keys of a summary that hold more than `share` of `total` rows."""
    return summary.where(F.col("n_rows") > F.lit(share * total))
