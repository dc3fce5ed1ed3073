"""Mixing sources to target weights (problem 8).

The documents of each source are packed, in a fixed pseudorandom order, into one
stream of tokens cut into blocks of equal length. The mixture is a sequence of
slots in shards: each shard draws from a multinomial how many slots each source
gets, a slot's number within its source is mapped through a pseudorandom
permutation of the source's blocks, a new one for each repetition, and the
blocks are joined to their slots by index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.tokens import encoded
from skein.scale import buckets_for, checkpoint

BLOCK = 512
SHARD = 256
#: Shards whose draws one row of the driver's prefix sums stands for.
GROUP = 1024
SEED = 20_260

SLOTS = "shard long, slot int, source_no int, block_no long, use_no int"


def source_name(raw: Column) -> Column:
    """One spelling per source: lower case, no blanks around it, '_' between words."""
    return F.regexp_replace(F.lower(F.trim(raw)), r"[\s\-]+", "_")


def _permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """x mapped through a pseudorandom permutation of 0..n-1: a Feistel network, walked on until inside."""
    half = np.maximum(np.ceil(np.log2(np.maximum(n, 2)) / 2).astype(np.uint64), np.uint64(1))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.astype(np.uint64), np.arange(len(x))
    limit = n.astype(np.uint64)
    while len(todo):
        left, right = out[todo] >> half[todo], out[todo] & mask[todo]
        for r in range(4):
            mixed = (right + key[todo].astype(np.uint64) + np.uint64(r * 0x632BE5AB)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
            left, right = right, left ^ (mixed & mask[todo])
        out[todo] = left << half[todo] | right
        todo = todo[out[todo] >= limit[todo]]
    return out.astype(np.int64)


def _draws(group: int, n_slots: int, shard: int, shares: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard numbers of a group, and the slots each source gets in each."""
    shards = np.arange(group * GROUP, min((group + 1) * GROUP, -(-n_slots // shard)))
    sizes = np.minimum(shard, n_slots - shards * shard)
    drawn = [np.random.default_rng([seed, int(s)]).multinomial(int(k), shares) for s, k in zip(shards, sizes)]
    return shards, np.array(drawn, np.int64).reshape(len(shards), len(shares))


def packed_blocks(documents: DataFrame, block: int = BLOCK, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Blocks (source, block_no, n_tokens, ids) of each source's token stream, and (source, n_docs, n_tokens).

    Every token of every document is in exactly one block; only the last block
    of a source is short. The place of a document in its source's stream is the
    sum of the tokens before it, taken within hash buckets first and then over
    the buckets, so that no task gets a whole source.
    """
    spark = documents.sparkSession
    named = documents.select(
        F.xxhash64("doc_id", "text").alias("_order"), source_name(F.col("source")).alias("source"), F.col("text").alias("_text")
    )
    docs = encoded(named, text="_text", path=path).select("source", "_order", "ids", F.size("ids").alias("n"))
    docs = checkpoint(docs)
    buckets = buckets_for(docs.count(), 50_000, spark)
    docs = docs.withColumn("_bucket", F.pmod(F.shiftright("_order", 8), F.lit(buckets)))
    sizes = checkpoint(docs.groupBy("source", "_bucket").agg(F.sum("n").alias("_sum"), F.count(F.lit(1)).alias("_docs")))
    totals = sizes.groupBy("source").agg(F.sum("_docs").alias("n_docs"), F.sum("_sum").alias("n_tokens"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("source", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("source", "_bucket").orderBy("_order", "n").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.where("n > 0 and source is not null").withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    placed = placed.join(starts, ["source", "_bucket"]).withColumn("_start", F.col("_base") + F.col("_in"))
    block_nos = F.sequence(F.floor(F.col("_start") / block), F.floor((F.col("_start") + F.col("n") - 1) / block))
    first = F.greatest(F.col("_start"), F.col("block_no") * block)
    last = F.least(F.col("_start") + F.col("n"), (F.col("block_no") + 1) * block)
    pieces = placed.withColumn("block_no", F.explode(block_nos)).select(
        "source",
        "_bucket",
        "block_no",
        first.alias("_at"),
        F.slice("ids", (first - F.col("_start") + 1).cast("int"), (last - first).cast("int")).alias("_ids"),
    )
    # A bucket's tokens lie in one task already; only blocks that reach over its ends are shuffled once more.
    parts = F.array_sort(F.collect_list(F.struct("_at", "_ids"))).alias("_parts")
    mine = pieces.groupBy("source", "_bucket", "block_no").agg(parts, F.sum(F.size("_ids")).alias("_n"))
    whole = mine.where(F.col("_n") == block).select("source", "block_no", F.flatten("_parts._ids").alias("ids"))
    torn = mine.where(F.col("_n") < block).groupBy("source", "block_no").agg(F.array_sort(F.flatten(F.collect_list("_parts"))).alias("_parts"))
    blocks = whole.unionByName(torn.select("source", "block_no", F.flatten("_parts._ids").alias("ids")))
    return blocks.withColumn("n_tokens", F.size("ids")), totals


def wanted(targets: DataFrame) -> DataFrame:
    """(source, weight, max_repeats): one row per source, the greatest of each where targets repeat it."""
    t = targets.select(source_name(F.col("source")).alias("source"), "weight", "max_repeats").where("source is not null")
    return t.groupBy("source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))


def plan(totals: DataFrame, targets: DataFrame, block: int = BLOCK, total_tokens: int | None = None) -> pd.DataFrame:
    """Blocks to draw from each source: one row per source named by documents or targets (a few rows).

    Weights are scaled to sum to 1 over the sources that have tokens and a
    weight above 0. Unless total_tokens says otherwise, the mixture is as large
    as it can be with every such source at its share and no block used more
    than max_repeats times; where total_tokens asks for more than a source
    has, that source gives all it may. A source that targets doesn't name, or
    whose weight or max_repeats is null, zero or negative, gives nothing.
    """
    p = totals.join(wanted(targets), "source", "full").where("source is not null").orderBy("source").toPandas()
    p = p.fillna({"n_docs": 0, "n_tokens": 0, "weight": 0.0, "max_repeats": 0})
    p["n_blocks"] = -(-p["n_tokens"].astype("int64") // block)
    cap = p["n_blocks"] * p["max_repeats"].clip(lower=0).astype("int64")
    live = (cap > 0) & (p["weight"] > 0)
    p["share"] = np.where(live, p["weight"], 0.0)
    p["quota"] = 0
    if live.any():
        p["share"] /= p["share"].sum()
        slots = total_tokens / block if total_tokens is not None else (cap[live] / p.loc[live, "share"]).min()
        p["quota"] = np.minimum(np.round(p["share"] * slots), cap).astype("int64")
    return p


def _slots(spark, p: pd.DataFrame, shard: int, seed: int) -> DataFrame:
    quota = p["quota"].to_numpy(np.int64)
    n_blocks, n = p["n_blocks"].to_numpy(np.int64), int(quota.sum())
    shares = quota / max(n, 1)
    groups = -(-n // (shard * GROUP))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for g in f["id"]:
                yield pd.DataFrame({"id": [g], "drawn": [_draws(g, n, shard, shares, seed)[1].sum(0)]})

    wide = min(groups, 10_000) or 1
    sums = spark.range(0, groups, 1, wide).mapInPandas(count, "id long, drawn array<long>").orderBy("id").toPandas()
    drawn = np.array(sums["drawn"].tolist(), np.int64).reshape(groups, len(quota))
    base, total = np.cumsum(drawn, 0) - drawn, drawn.sum(0)
    over, short = np.maximum(total - quota, 0), np.maximum(quota - total, 0)
    over_at, short_at = np.cumsum(over) - over, np.cumsum(short)

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for g in f["id"]:
                shards, counts = _draws(g, n, shard, shares, seed)
                at = base[g].copy()
                for s, k in zip(shards, counts):
                    source = np.repeat(np.arange(len(k)), k)
                    number = np.arange(len(source)) - np.repeat(np.cumsum(k) - k, k) + at[source]
                    at += k
                    # Draws beyond a source's quota go, one by one, to the sources that were drawn too seldom.
                    extra = np.nonzero(number >= quota[source])[0]
                    unit = over_at[source[extra]] + number[extra] - quota[source[extra]]
                    to = np.searchsorted(short_at, unit, side="right")
                    number[extra] = total[to] + unit - (short_at[to] - short[to])
                    source[extra] = to
                    use = number // n_blocks[source]
                    key = source * 1_000_003 + use * 7919 + seed
                    block_no = _permuted(number % n_blocks[source], n_blocks[source], key)
                    slot = np.random.default_rng([seed, int(s), 1]).permutation(len(source))
                    yield pd.DataFrame({"shard": s, "slot": slot.astype("int32"), "source_no": source.astype("int32"), "block_no": block_no, "use_no": use.astype("int32")})

    return spark.range(0, groups, 1, wide).mapInPandas(fill, SLOTS)


def mixture(
    documents: DataFrame,
    targets: DataFrame,
    block: int = BLOCK,
    shard: int = SHARD,
    total_tokens: int | None = None,
    seed: int = SEED,
    path: str | None = None,
) -> DataFrame:
    """The mixture, one row per slot: shard, slot, source, block_no, use_no (from 0), n_tokens, ids.

    A record is used at most max_repeats times because each of its tokens is in
    one block and each block is used at most that often. Shares are exact to a
    block. Texts that are null or empty have no tokens and give nothing, nor do
    documents without source. Without anything to mix there are no rows.
    """
    spark = documents.sparkSession
    blocks, totals = packed_blocks(documents, block, path)
    p = plan(totals, targets, block, total_tokens)
    names = F.array(*[F.lit(s) for s in p["source"]]) if len(p) else F.array().cast("array<string>")
    slots = _slots(spark, p, shard, seed).withColumn("source", F.try_element_at(names, F.col("source_no") + 1))
    return slots.join(blocks, ["source", "block_no"]).select(
        "shard", "slot", "source", "block_no", "use_no", "n_tokens", "ids"
    )


def share_report(documents: DataFrame, targets: DataFrame, mixed: DataFrame) -> DataFrame:
    """Per source: documents, tokens used, target and actual share of the mixture, most uses of one block.

    target_share is the weight scaled over the sources that are in the mixture.
    Documents without source, which give nothing to it, are the row whose source is null.
    """
    used = mixed.groupBy("source").agg(
        F.sum("n_tokens").alias("tokens_used"), (F.max("use_no") + 1).alias("most_uses"), F.countDistinct("block_no").alias("blocks_used")
    )
    used = checkpoint(used)
    docs = documents.groupBy(source_name(F.col("source")).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"))
    every = docs.where("source is not null").join(wanted(targets), "source", "full").join(used, "source", "left")
    every = every.unionByName(docs.where("source is null"), allowMissingColumns=True)
    total, weights = used.agg(F.sum("tokens_used")).first()[0], every.where("tokens_used > 0").agg(F.sum("weight")).first()[0]
    return every.select(
        "source",
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
        "weight",
        "max_repeats",
        F.when(F.col("tokens_used") > 0, F.col("weight") / F.lit(weights)).otherwise(F.lit(0.0)).alias("target_share"),
        (F.coalesce("tokens_used", F.lit(0)) / F.lit(total)).alias("actual_share"),
        F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"),
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        F.coalesce("blocks_used", F.lit(0)).alias("blocks_used"),
    )


def shares_kept(report: DataFrame, block: int = BLOCK) -> DataFrame:
    """A share report's sources with what was asked for, and whether the mixture kept to it.

    share_kept: the actual share is the target's to within one block a use
    (the last block of a source is short); repeats_kept: no block is used more
    than max_repeats times.
    """
    total = report.select(F.sum("tokens_used")).scalar()
    within = F.abs(F.col("actual_share") - F.col("target_share")) <= (F.col("most_uses") + 1) * block / total
    return report.select(
        "source", "n_docs", "weight", "max_repeats", F.round("target_share", 6).alias("target_share"),
        F.coalesce(within, F.lit(True)).alias("share_kept"), (F.col("most_uses") <= F.coalesce("max_repeats", F.lit(0))).alias("repeats_kept"),
    )
