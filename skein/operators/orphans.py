"""References to records that do not exist (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.scale import checkpoint, lookup_by
from skein.tables import SYMBOL_KINDS, current_symbols

#: Ids that stand for a file's own code and are never symbols.
SYNTHETIC = r"::__module__::(?:function|class)$"

def references(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Every referring value (ref_field, holder_id, missing_id, period, _at) of all delivered rows; _at is when.

    A from_id refers unless it is synthetic, a to_id if it has the form of an
    id, a parent_id unless it is empty. Nulls refer to nothing; a row without
    indexed_at has no period and counts as delivered before all else.
    """
    four = F.split("to_id", "::")
    is_id = (F.size(four) == 4) & F.element_at(four, 3).isin(list(SYMBOL_KINDS)) & F.element_at(four, 4).rlike("^[0-9]+$")
    ends = edges.select("from_id", "to_id", "indexed_at")
    both = ends.select(
        "from_id",
        "indexed_at",
        F.explode(
            F.array(
                F.struct(F.lit("edges.from_id").alias("f"), F.when(~F.col("from_id").rlike(SYNTHETIC), F.col("from_id")).alias("v")),
                F.struct(F.lit("edges.to_id").alias("f"), F.when(F.size(four).isNotNull() & is_id, F.col("to_id")).alias("v")),
            )
        ).alias("r"),
    ).select(F.col("r.f").alias("ref_field"), F.col("from_id").alias("holder_id"), F.col("r.v").alias("missing_id"), "indexed_at")
    parents = symbols.select(
        F.lit("symbols.parent_id").alias("ref_field"),
        F.col("id").alias("holder_id"),
        F.when(F.col("parent_id") != "", F.col("parent_id")).alias("missing_id"),
        "indexed_at",
    )
    period = F.date_format(F.timestamp_seconds("indexed_at"), "yyyy-MM")
    every = both.unionByName(parents).where("missing_id is not null")
    return every.select("ref_field", "holder_id", "missing_id", period.alias("period"), F.coalesce("indexed_at", F.lit(-(2**62))).alias("_at"))


def orphans(symbols: DataFrame, edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Orphan references, direct and inherited: ref_field, holder_id, missing_id, reason, period, n_rows, level.

    Direct (level 0) is a reference that found no symbol when it was delivered:
    'late' if the symbol came later, else 'removed' if removed_symbols has it,
    else 'missing'. A current symbol whose parent reference is a direct orphan
    is an orphaned record; a symbol whose parent is an orphaned record is one
    itself, one level further down, and so on until a round finds no more. The
    references that orphaned records hold or that lead to them are the
    inherited orphans, with the reason 'inherited' and the record's level.

    Compared exactly, with letter case. Empty tables give no rows.
    """
    first = symbols.where("id is not null").groupBy(F.col("id").alias("missing_id")).agg(F.min("indexed_at").alias("_since"))
    gone = removed.where("id is not null").select(F.col("id").alias("missing_id")).distinct().withColumn("_gone", F.lit(True))
    refs = checkpoint(references(symbols, edges))
    # One row per id that is referred to: only those absent, or late for their first reference, are looked up again.
    seen = refs.groupBy("missing_id").agg(F.min("_at").alias("_first"))
    looked = seen.join(first, "missing_id", "left").where("_since is null or _since > _first").join(gone, "missing_id", "left")
    with_bad = lookup_by(looked.select("missing_id", "_since", "_gone", F.lit(True).alias("_bad")), "missing_id")
    reason = (
        F.when(F.col("_bad").isNull() | (F.col("_since") <= F.col("_at")), None)
        .when(F.col("_since").isNotNull(), "late")
        .when(F.col("_gone"), "removed")
        .otherwise("missing")
    )
    links = current_symbols(symbols, ["parent_id"]).where("parent_id <> ''")
    held = with_bad(refs.where("ref_field = 'symbols.parent_id'")).where(reason.isNotNull())
    held = held.select(F.col("holder_id").alias("id"), F.col("missing_id").alias("parent_id")).distinct()
    records = orphaned_records(links, held)
    held_by = lookup_by(records.select(F.col("id").alias("holder_id"), F.col("level").alias("_held")), "holder_id")
    leads_to = lookup_by(records.select(F.col("id").alias("_target"), F.col("level").alias("_leads")), "_target")
    target = F.when(F.col("ref_field") == "edges.to_id", F.col("missing_id"))
    full = leads_to(held_by(with_bad(refs)).withColumn("_target", target)).withColumn("reason", reason)
    level = F.when(F.col("reason").isNotNull(), 0).otherwise(F.least("_held", "_leads"))
    full = full.withColumn("level", level).where("level is not null").withColumn("reason", F.coalesce("reason", F.lit("inherited")))
    return full.groupBy("ref_field", "holder_id", "missing_id", "reason", "period").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("level").alias("level")
    )


def orphaned_records(links: DataFrame, held: DataFrame) -> DataFrame:
    """(id, level): the fixpoint of the cascade down the parent links (id, parent_id).

    Level 1 are the records whose link is in held; a record whose parent is of
    level n is of level n + 1, unless it is of level 1 itself. The rounds double
    the links that a record looks up, so they are the logarithm of the depth;
    only records that are parents take part, the others follow at the end.
    """
    links = checkpoint(links)
    own = checkpoint(links.join(held, ["id", "parent_id"], "left_semi").select("id"))
    inner = links.join(links.select(F.col("parent_id").alias("id")).distinct(), "id", "left_semi")
    start = F.when(F.col("_own").isNull(), F.col("parent_id"))
    inner = inner.join(own.withColumn("_own", F.lit(True)), "id", "left").select("id", start.alias("ptr"), F.when(start.isNull(), 0).otherwise(1).alias("n"))
    # ptr is null where an orphaned record is reached, after n links; rows whose way ends elsewhere drop out of the join.
    state, active = checkpoint(inner), -1
    while (left := state.where("ptr is not null").count()) not in (0, active):
        active = left
        step = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("n").alias("_n"))
        todo = state.where("ptr is not null").join(step, "ptr")
        state = checkpoint(state.where("ptr is null").unionByName(todo.select("id", F.col("_ptr").alias("ptr"), (F.col("n") + F.col("_n")).alias("n"))), state)
    reached = state.where("ptr is null").select("id", (F.col("n") + 1).alias("level"))
    leaves = links.join(state.select("id"), "id", "left_anti").join(own, "id", "left_anti")
    leaves = leaves.join(reached.select(F.col("id").alias("parent_id"), "level"), "parent_id").select("id", (F.col("level") + 1).alias("level"))
    return reached.unionByName(leaves).unionByName(own.join(state.select("id"), "id", "left_anti").withColumn("level", F.lit(1)))


def direct_orphans(found: DataFrame) -> DataFrame:
    return found.where("level = 0").select("ref_field", "holder_id", "missing_id", "reason", "period")


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphan references per field, period, reason and level, with the number of delivered rows."""
    return found.groupBy("ref_field", "period", "reason", "level").agg(
        F.count(F.lit(1)).alias("n_refs"), F.sum("n_rows").alias("n_rows")
    )
