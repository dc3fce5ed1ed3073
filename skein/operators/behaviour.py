"""Statistics over sequences of actions: what comes before, after and near what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_summary(actions: DataFrame) -> DataFrame:
    """Per run of actions (run, seq, tool, argument, is_edit, is_look): counts, looks per edit, actions before the first edit, repeated reads.

    looks_per_edit is infinite without edits; before_edit is then all actions.
    """
    is_read = F.col("tool") == "Read"
    base = actions.groupBy("run").agg(
        F.count(F.lit(1)).alias("n_actions"),
        F.count(F.when(F.col("is_edit"), 1)).alias("n_edits"),
        F.count(F.when(F.col("is_look"), 1)).alias("n_looks"),
        F.count(F.when(is_read, 1)).alias("n_reads"),
        F.countDistinct(F.when(is_read, F.col("argument"))).alias("n_read_once"),
        F.min(F.when(F.col("is_edit"), F.col("seq"))).alias("_first"),
    )
    ratio = F.when(F.col("n_edits") == 0, F.lit(float("inf"))).otherwise(F.col("n_looks") / F.col("n_edits"))
    return base.select(
        "run", "n_actions", "n_edits", "n_looks", "n_reads", "n_read_once", (F.col("n_reads") - F.col("n_read_once")).alias("n_read_again"),
        ratio.alias("looks_per_edit"), F.coalesce(F.col("_first") - 1, F.col("n_actions")).cast("long").alias("before_edit"),
    )


def before_first(actions: DataFrame, counted: Column, stop: Column) -> DataFrame:
    """(run, n_before): rows for which `counted` holds ahead of the run's first `stop`."""
    first = F.min(F.when(stop, F.col("seq"))).over(Window.partitionBy("run"))
    marked = actions.select("run", counted.alias("_c"), F.coalesce(F.col("seq") < first, F.lit(True)).alias("_b"))
    return marked.groupBy("run").agg(F.count(F.when(F.col("_c") & F.col("_b"), 1)).alias("n_before"))


def followed_within(actions: DataFrame, first: Column, then: Column, rows: int = 3) -> DataFrame:
    """(run, n_followed): rows `first` with a row `then` among the next `rows` of the run, each counted once."""
    near = F.max(then.cast("int")).over(Window.partitionBy("run").orderBy("seq").rowsBetween(1, rows))
    return actions.select("run", (first & (near == 1)).alias("_f")).groupBy("run").agg(F.count(F.when(F.col("_f"), 1)).alias("n_followed"))


def followed_until(actions: DataFrame, first: Column, then: Column, barrier: Column) -> DataFrame:
    """(run, n_followed): rows `first` after which the run has, ahead of its next `barrier`, a `then` about the same thing.

    That is one whose argument is the argument of the first or a word of it
    (between blanks). A run is cut at its barriers; within such a stretch every
    word of a first meets the last `then` of that argument, so no pairs are made.
    """
    before = Window.partitionBy("run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    cut = actions.select("run", "seq", "argument", first.alias("_f"), then.alias("_t"), barrier.alias("_b"))
    cut = cut.withColumn("_part", F.coalesce(F.sum(F.col("_b").cast("int")).over(before), F.lit(0)))
    last = cut.where("_t and not _b").groupBy("run", "_part", F.col("argument").alias("_word")).agg(F.max("seq").alias("_last"))
    words = F.array_distinct(F.concat(F.array("argument"), F.split("argument", r"\s+")))
    asked = cut.where("_f and argument is not null and not _b").select("run", "_part", "seq", F.explode(words).alias("_word"))
    hits = asked.join(last, ["run", "_part", "_word"]).where(F.col("_last") > F.col("seq")).select("run", "seq").distinct()
    n = hits.groupBy("run").agg(F.count(F.lit(1)).alias("n_followed"))
    return actions.select("run").distinct().join(n, "run", "left").select("run", F.coalesce("n_followed", F.lit(0)).alias("n_followed"))


def same_argument(actions: DataFrame, one: str, other: str) -> DataFrame:
    """(run, both): whether some argument was given to both tools of a run."""
    used = actions.where(F.col("tool").isin(one, other)).groupBy("run", "argument").agg(F.countDistinct("tool").alias("_n"))
    return used.groupBy("run").agg((F.max("_n") == 2).alias("both"))


def sequences(actions: DataFrame) -> DataFrame:
    """(run, tools): the tools of a run in order, as one text."""
    row = F.struct("seq", "tool")
    return actions.groupBy("run").agg(F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["tool"]), ">").alias("tools"))


def condition_report(summary: DataFrame, condition: Column) -> DataFrame:
    """Means and sample deviations of run summaries by condition; infinite ratios count as the greatest finite one."""
    top = summary.where("looks_per_edit < double('inf')").select(F.max("looks_per_edit")).scalar()
    ratio = F.when(F.col("looks_per_edit") == float("inf"), F.coalesce(top, F.lit(0.0))).otherwise(F.col("looks_per_edit"))
    rows = summary.select(condition.alias("condition"), "n_actions", "before_edit", ratio.alias("_r"))
    return rows.groupBy("condition").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.round(F.avg("n_actions"), 6).alias("mean_actions"),
        F.round(F.coalesce(F.stddev_samp("n_actions"), F.lit(0.0)), 6).alias("sd_actions"),
        F.round(F.avg("before_edit"), 6).alias("mean_before_edit"),
        F.round(F.avg("_r"), 6).alias("mean_looks_per_edit"),
    )


def outcome_report(runs: DataFrame, by: list[str]) -> DataFrame:
    """Runs (passed, score, size, ...) by the columns `by`: number, percent passed, mean and sample deviation of score, mean size and its reduction in percent against the greatest mean."""
    out = runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.round(F.avg(F.col("passed").cast("double")) * 100, 6).alias("pct_passed"),
        F.round(F.avg("score"), 6).alias("mean_score"),
        F.round(F.coalesce(F.stddev_samp("score"), F.lit(0.0)), 6).alias("sd_score"),
        F.avg("size").alias("_size"),
    )
    top = out.select(F.max("_size")).scalar()
    cut = F.round((1 - F.col("_size") / top) * 100, 6).alias("pct_smaller")
    return out.select(*by, "n_runs", "pct_passed", "mean_score", "sd_score", F.round("_size", 6).alias("mean_size"), cut)


def score(compiles: Column, passes: Column, coverage: Column, threshold: float = 0.8) -> Column:
    """0 to 100: 40 each for compiling and passing and 20 by coverage, scaled below the threshold; 50 each where coverage is null."""
    share = F.when(coverage >= threshold, 20).otherwise(F.floor(coverage / threshold * 20)).cast("int")
    each = lambda n: F.when(compiles, n).otherwise(0) + F.when(passes, n).otherwise(0)
    return F.when(coverage.isNull(), each(50)).otherwise(each(40) + share)


def recommendations(report: DataFrame, patterns: DataFrame, limit: float = 5.0) -> DataFrame:
    """(condition, advice): rules over a condition report joined with pattern sums (condition, n_followed, n_within).

    'followed' where looking at what was just reported occurs, 'searched' where
    searching again does, 'many actions' over `limit` actions a run, 'late
    edits' where a condition edits later than condition 0 does.
    """
    base = report.where("condition = 0").select(F.max("mean_before_edit")).scalar()
    full = report.join(patterns, "condition", "left")
    rules = {
        "followed": F.col("n_followed") > 0, "searched": F.col("n_within") > 0, "many actions": F.col("mean_actions") > limit,
        "late edits": F.col("mean_before_edit") > base,
    }
    return full.select("condition", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))).alias("advice"))


def near_lines(points: DataFrame, changed: DataFrame, reach: int = 5) -> DataFrame:
    """points (file_path, line, ...) with covered: whether a changed line (file_path, line) is within `reach` lines.

    An equi-join on (file, line div bucket) over the three buckets that can
    hold such a line, not a comparison of all pairs.
    """
    width = 2 * reach + 1
    slots = changed.select("file_path", F.col("line").alias("_at")).distinct().select(
        "file_path", "_at", F.explode(F.sequence(F.floor((F.col("_at") - reach) / width), F.floor((F.col("_at") + reach) / width))).alias("_slot")
    )
    keyed = points.withColumn("_slot", F.floor(F.col("line") / width))
    near = (keyed["file_path"] == slots["file_path"]) & (keyed["_slot"] == slots["_slot"]) & (F.abs(keyed["line"] - slots["_at"]) <= reach)
    hit = keyed.join(slots, near, "left_semi").withColumn("covered", F.lit(True))
    miss = keyed.join(slots, near, "left_anti").withColumn("covered", F.lit(False))
    return hit.unionByName(miss).drop("_slot")
