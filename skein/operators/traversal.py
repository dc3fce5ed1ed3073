"""Closures and paths over the graph: transitive dependencies, impact, call paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators.graph import CodeGraph, match_names, resolved, sources_of
from skein.scale import checkpoint, join_pairs, lookup_by


def transitive_deps(graph: CodeGraph, ids: DataFrame, depth: int = 3) -> DataFrame:
    """Dependencies up to `depth` steps: as deps(), each (id, kind) at its least depth.

    Breadth first, level by level, over exact ids; an id once reached is not
    gone on from again, which leaves the least depths as they are and keeps
    cycles finite.
    """
    graph = narrow(graph)
    out = graph.edges
    src = checkpoint(sources_of(graph, ids))
    found = checkpoint(out.join(src, "from_id").select("target", "to_id", "kind").distinct().withColumn("depth", F.lit(1)))
    # Only what has edges of its own is gone on from, once a target.
    begins = out.select(F.col("from_id").alias("to_id")).distinct()
    frontier = checkpoint(found.select("target", "to_id").distinct().join(begins, "to_id", "left_semi"))
    seen = frontier
    for level in range(2, depth + 1):
        step = out.join(frontier.withColumnRenamed("to_id", "from_id"), "from_id").select("target", "to_id", "kind").distinct()
        step = checkpoint(step.withColumn("depth", F.lit(level)))
        found = found.unionByName(step)
        if level == depth:
            break
        frontier = step.select("target", "to_id").distinct().join(begins, "to_id", "left_semi").join(seen, ["target", "to_id"], "left_anti")
        frontier = checkpoint(frontier)
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    least = found.groupBy("target", "to_id", "kind").agg(F.min("depth").alias("depth"))
    own = src.select("target", F.col("from_id").alias("to_id"))
    return resolved(graph, least.join(own, ["target", "to_id"], "left_anti"))


def narrow(graph: CodeGraph) -> CodeGraph:
    """The graph with what traversals need of it, written once: they read it in every step."""
    symbols = checkpoint(graph.symbols.select("id", "name", "kind", "file_path", "line_start", "parent_id"))
    return CodeGraph(symbols, checkpoint(graph.edges.select("from_id", "to_id", "kind")))


def impact(graph: CodeGraph, ids: DataFrame, depth: int = 3) -> DataFrame:
    """(target, id, name, file_path, kind, depth, is_test, label): symbols that a change of the targets may reach.

    The first level matches any spelling of the target (and of a class's
    members), further levels exact ids; edges of every kind count, code outside
    of symbols doesn't. A symbol has its least depth; the targets themselves
    and their members are left out at the end only.

    Steps are made once for each name, however many targets it stands for, and on
    numbers instead of ids. Targets and what their names reach are paired on the way out.
    """
    nodes = graph.symbols.select("id", "name", "kind", "file_path", "parent_id").withColumn("n", F.monotonically_increasing_id())
    graph = CodeGraph(checkpoint(nodes), graph.edges)
    numbers = graph.symbols.select("id", "n")
    seeds = checkpoint(match_names(graph, ids))
    keys = checkpoint(seeds.select("key").distinct().withColumn("k", F.monotonically_increasing_id()))
    reach = checkpoint(_key_reach(graph, keys, depth))

    targets = numbers.select(F.col("id").alias("target"), F.col("n").alias("t"))
    named = seeds.join(keys, "key").join(reach.select("k").distinct(), "k", "left_semi").join(targets, "target")
    named = checkpoint(named.select("t", "target", "k"))
    own = seeds.withColumnRenamed("key", "id").join(numbers, "id").join(targets, "target")
    own = checkpoint(own.select("t", "n"), replaces=seeds)
    but = checkpoint(_left_out(reach, named.select("t", "k"), own), replaces=own)
    named = checkpoint(named.join(but, ["t", "k"], "left").select("k", "target", "_not"), replaces=named)
    facts = {"is_test": X.is_test_file(F.col("file_path")), "label": X.impact_label(F.col("depth"))}
    full = reach.join(graph.symbols.select("n", "id", "name", "file_path", "kind"), "n").withColumns(facts)
    pairs = join_pairs(checkpoint(full, replaces=reach), named, "k").where("_not is null or not array_contains(_not, n)")
    return pairs.select("id", "target", "depth", "name", "file_path", "kind", "is_test", "label")


def _key_reach(graph: CodeGraph, keys: DataFrame, depth: int) -> DataFrame:
    """(k, n, depth): symbols (n) within `depth` steps back from the edges that fit a key (key, k), each at its least depth."""
    numbers = graph.symbols.select("id", "n")
    edges = checkpoint(graph.edges.select("from_id", "to_id").join(numbers.withColumnRenamed("id", "from_id"), "from_id").select("n", "to_id"))
    spelled = edges.select("to_id").distinct()
    hits = spelled.withColumn("key", F.explode(X.tails(F.col("to_id")))).join(keys, "key").groupBy("to_id").agg(F.collect_set("k").alias("_ks"))
    known = spelled.join(hits, "to_id", "left").join(numbers.select(F.col("id").alias("to_id"), F.col("n").alias("to")), "to_id", "left")
    known = known.where("_ks is not null or to is not null")
    edges = checkpoint(lookup_by(known, "to_id")(edges).where("_ks is not null or to is not null").select("n", "_ks", "to"), replaces=edges)
    found = checkpoint(edges.select(F.explode("_ks").alias("k"), "n").distinct().withColumn("depth", F.lit(1)))
    into = checkpoint(edges.where("to is not null").select(F.col("to").alias("n"), F.col("n").alias("next")).distinct())
    frontier = found.select("k", "n")
    for level in range(2, depth + 1):
        step = into.join(frontier, "n").select("k", F.col("next").alias("n")).distinct()
        new = checkpoint(step.join(found.select("k", "n"), ["k", "n"], "left_anti").withColumn("depth", F.lit(level)))
        if not new.limit(1).count():
            break
        found, frontier = found.unionByName(new), new.select("k", "n")
    return found


def _left_out(reach: DataFrame, named: DataFrame, own: DataFrame) -> DataFrame:
    """(t, k, _not): what of the reach of a key k isn't to be paired with its target t.

    That is what another key of the target reaches with fewer steps (or as many, and
    is the first), and what is the target's own (t, n). The first is found from two keys of
    one target and two keys that reach one symbol, so nothing is paired for it.
    """
    a, b = (named.select("t", F.col("k").alias(k)) for k in ("k1", "k2"))
    two = a.join(b, "t").where("k1 < k2")
    a, b = (reach.select("n", F.col("k").alias(f"k{i}"), F.col("depth").alias(f"d{i}")) for i in (1, 2))
    both = a.join(b, "n").where("k1 < k2").select("n", "k1", "k2", F.expr("if(d1 <= d2, k2, k1)").alias("k"))
    again = two.join(both, ["k1", "k2"]).select("t", "k", "n")
    mine = own.join(reach.select("n", "k"), "n").join(named, ["t", "k"], "left_semi").select("t", "k", "n")
    return again.unionByName(mine).groupBy("t", "k").agg(F.collect_set("n").alias("_not"))


def _reach(seeds: DataFrame, links: DataFrame, depth: int) -> DataFrame:
    """Nodes within depth links of the seeds (node)."""
    seen = frontier = checkpoint(seeds.select("node").distinct())
    for _ in range(depth):
        frontier = checkpoint(links.join(frontier, "node", "left_semi").select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti"))
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen


def flow(graph: CodeGraph, starts: DataFrame, ends: DataFrame, depth: int = 10, limit: int | None = 5) -> DataFrame:
    """(start, end, n_steps, path): for every two symbols of `starts` and `ends` (id) the first `limit` simple call paths, over exact ids.

    Paths are of at most `depth` calls and come by length, then by their ids
    (path is the array of them). They are made longer step by step, along nodes
    from which an end can still be reached; a start whose ends all have their
    paths goes on no further. Without a limit every simple path is made.
    """
    links = checkpoint(graph.calls.select(F.col("from_id").alias("node"), F.col("to_id").alias("next")).where("node <> next").distinct())
    back = links.select(F.col("next").alias("node"), F.col("node").alias("next"))
    on = checkpoint(_reach(ends.select(F.col("id").alias("node")), back, depth))
    links = checkpoint(links.join(on.select(F.col("node").alias("next")), "next", "left_semi").select("node", "next"))
    ends = checkpoint(ends.select(F.col("id").alias("end")).distinct())
    n_ends, done = ends.count(), None
    first = starts.select(F.col("id").alias("node")).distinct()
    level = first.select(F.col("node").alias("start"), "node", F.array("node").alias("path"))
    for n in range(1, depth + 1):
        longer = level.join(links, "node").where(~F.array_contains("path", F.col("next")))
        level = checkpoint(longer.select("start", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path")))
        if not level.limit(1).count():
            break
        here = level.join(ends, F.col("node") == F.col("end")).select("start", "end", F.lit(n).alias("n_steps"), "path")
        done = here if done is None else done.unionByName(here)
        if limit is not None:
            full = done.groupBy("start", "end").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= limit)
            full = full.groupBy("start").agg(F.count(F.lit(1)).alias("_full")).where(F.col("_full") >= n_ends)
            level = level.join(full, "start", "left_anti")
    if done is None:
        return level.select("start", F.col("node").alias("end"), F.lit(0).alias("n_steps"), "path").where("false")
    if limit is None:
        return done
    w = Window.partitionBy("start", "end").orderBy("n_steps", "path")
    return done.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= limit).drop("_k")


def step_keys(id_: Column) -> Column:
    """Spellings by which a call leads to an id on the way back: the id, its name, kind, name::kind and line."""
    p = F.split(id_, "::")
    at = lambda i: F.try_element_at(p, F.lit(i))
    return F.array_distinct(F.array_compact(F.array(id_, at(2), at(3), F.concat_ws("::", at(2), at(3)), F.element_at(p, -1))))


def trace(graph: CodeGraph, target: DataFrame, depth: int = 10, limit: int | None = 20) -> DataFrame:
    """(start, n_steps, path): simple call paths from code that nothing calls to the target symbol (id).

    The last step matches any spelling of the target, earlier ones an id or a
    bare name. Paths are ordered by length and text before the limit, so once
    the paths of some length are as many as the limit no longer ones are made.
    """
    graph, target = narrow(graph), checkpoint(target)
    name = target.join(graph.names, "id").select(F.explode(F.array("id", "name")).alias("key")).distinct()
    calls = graph.calls
    into = calls.withColumn("key", F.explode(X.tails(F.col("to_id")))).join(name, "key").select("from_id").distinct()
    into = into.withColumn("_t", target.select("id").scalar()).where("from_id <> _t")
    seeds = into.select(
        F.col("from_id").alias("start"), F.col("from_id").alias("node"), F.array("from_id", "_t").alias("path")
    )
    callers = calls.select("from_id").unionByName(calls.select(F.col("to_id").alias("from_id"))).distinct()
    keyed = callers.select(F.col("from_id").alias("node"), F.explode(step_keys(F.col("from_id"))).alias("to_id"))
    links = checkpoint(keyed.join(calls.select("to_id", F.col("from_id").alias("next")), "to_id").select("node", "next").distinct())
    called = links.select("node").distinct()
    levels, level, n, enough = [], checkpoint(seeds), 1, 0
    while n <= depth and level.limit(1).count():
        levels.append(level.join(called, "node", "left_anti").select(F.col("node").alias("start"), F.lit(n).alias("n_steps"), "path"))
        enough += levels[-1].count() if limit else 0
        if limit and enough >= limit:
            break
        longer = level.join(links, "node").where(~F.array_contains("path", F.col("next")))
        level = checkpoint(longer.select("start", F.col("next").alias("node"), F.concat(F.array("next"), "path").alias("path")))
        n += 1
    out = levels[0] if levels else seeds.select("start", F.lit(1).alias("n_steps"), "path")
    for more in levels[1:]:
        out = out.unionByName(more)
    out = out.withColumn("path", F.array_join("path", " > ")).distinct()
    return out.orderBy("n_steps", "path").limit(limit) if limit else out


def entrypoints(graph: CodeGraph) -> DataFrame:
    """(id, name, kind, file_path, grp, method_count, outgoing_call_count): what nothing calls, outside of tests.

    Functions, methods and classes that no call names by id, by name or as a
    member. A member of a class that is an entrypoint itself is left out.
    """
    mine = graph.symbols.where("kind in ('function', 'method', 'class')").where(~X.is_test_file(F.col("file_path")))
    spelled = graph.calls.select("to_id").distinct()
    keys = spelled.select(F.explode(F.array_compact(F.array("to_id", X.member_tail(F.col("to_id"))))).alias("key")).distinct()
    free = mine.join(spelled.select(F.col("to_id").alias("id")), "id", "left_anti").join(keys.select(F.col("key").alias("name")), "name", "left_anti")
    free = free.select("id", "name", "kind", "file_path", "parent_id")
    classes = free.where("kind = 'class'").select(F.col("id").alias("parent_id"))
    top = free.where("parent_id is null").unionByName(free.where("parent_id is not null").join(classes, "parent_id", "left_anti").select(free.columns))
    members = graph.symbols.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("_m"))
    calls = graph.calls.groupBy(F.col("from_id").alias("id")).agg(F.count(F.lit(1)).alias("_c"))
    full = top.join(members, "id", "left").join(calls, "id", "left")
    return full.select(
        "id", "name", "kind", "file_path", X.entry_group(F.col("file_path")).alias("grp"),
        F.when(F.col("kind") == "class", F.coalesce("_m", F.lit(0))).otherwise(F.lit(0)).alias("method_count"),
        F.coalesce("_c", F.lit(0)).alias("outgoing_call_count"),
    )
