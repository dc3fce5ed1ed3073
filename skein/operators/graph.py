"""The code graph: symbols, edges and the match between spellings and symbols."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.scale import checkpoint, join_pairs, likely_in, lookup_by
from skein.tables import CLASS_LIKE, current_edges, current_symbols, table

SYMBOL = ["id", "name", "kind", "file_path", "line_start", "line_end", "signature", "docstring", "parent_id", "language", "metadata"]
CALLABLE = ("function", "method")


@dataclass(frozen=True)
class CodeGraph:
    """Current symbols (one row per id) and edges (one row per from_id, to_id, kind)."""

    symbols: DataFrame
    edges: DataFrame

    @classmethod
    def of_deliveries(cls, symbols: DataFrame, edges: DataFrame) -> CodeGraph:
        now = current_symbols(symbols, SYMBOL).withColumn("parent_id", F.when(F.col("parent_id") != "", F.col("parent_id")))
        return cls(now, current_edges(edges))

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> CodeGraph:
        return cls.of_deliveries(table(spark, folder, "symbols"), table(spark, folder, "edges"))

    @cached_property
    def calls(self) -> DataFrame:
        return self.edges.where("kind = 'calls'")

    @cached_property
    def names(self) -> DataFrame:
        return self.symbols.select("id", "name")

    def keyed_edges(self) -> DataFrame:
        """Edges, once for each name their spelling refers to: the equi-join form of the spelling match.

        An edge's to_id matches a symbol's id or name n if it is n or ends with
        '::n' or '.n'; key holds each such n.
        """
        return self.edges.withColumn("key", F.explode(X.tails(F.col("to_id"))))


# ---- lookups --------------------------------------------------------------------------------------------------------


def find_symbols(graph: CodeGraph) -> DataFrame:
    """For every name the one symbol it means: one without parent first, then by file, line and id."""
    order = F.struct(F.col("parent_id").isNotNull().alias("inner"), "file_path", "line_start", "id")
    return graph.symbols.groupBy("name").agg(F.min(order).alias("_s"), F.count(F.lit(1)).alias("n_symbols")).select(
        "name", F.col("_s.id").alias("id"), F.col("_s.file_path").alias("file_path"), "n_symbols"
    )


def find_symbol(graph: CodeGraph, name: str) -> DataFrame:
    """The symbol a name means, at most one row; 'Class.member' is split at its first dot if no symbol is called so."""
    order = [F.when(F.col("parent_id").isNull(), 0).otherwise(1), "file_path", "line_start", "id"]
    plain = graph.symbols.where(F.col("name") == name).withColumn("_rank", F.lit(0))
    found = plain
    if "." in name:
        outer, member = name.split(".", 1)
        parents = graph.symbols.where(F.col("name") == outer).select(F.col("id").alias("parent_id"))
        inside = graph.symbols.where(F.col("name") == member).join(parents, "parent_id", "left_semi")
        found = plain.unionByName(inside.withColumn("_rank", F.lit(1)))
    return found.orderBy("_rank", *order).limit(1).drop("_rank")


def find_by_prefix(graph: CodeGraph, prefix: str) -> DataFrame:
    """The first symbol whose id is the prefix or goes on with '::' after it."""
    return graph.symbols.where((F.col("id") == prefix) | F.col("id").startswith(prefix + "::")).orderBy("id").limit(1)


class SymbolNotFoundError(LookupError):
    pass


class AmbiguousSymbolError(LookupError):
    def __init__(self, name: str, choices: list[str]):
        super().__init__(f"{name} may be:\n" + "\n".join(f"{i}. {c}" for i, c in enumerate(choices, 1)))
        self.choices = choices


def resolve_symbol(graph: CodeGraph, name: str) -> DataFrame:
    """The one symbol meant by an id prefix or a name; raises if there is none, or several of that name."""
    if "::" in name:
        hit = find_by_prefix(graph, name)
        if hit.count():
            return hit
    same = graph.symbols.where(F.col("name") == name).select("id", "file_path", "line_start")
    choices = [r["id"] for r in same.orderBy("file_path", "line_start", "id").limit(21).collect()]
    if len(choices) > 1:
        raise AmbiguousSymbolError(name, choices)
    hit = find_symbol(graph, name)
    if not hit.count():
        raise SymbolNotFoundError(f"{name} not found; try a search for parts of the name")
    return hit


def qualified_members(graph: CodeGraph) -> DataFrame:
    """For every 'Parent.member' the symbol it means: the first by file, line and id."""
    parents = graph.symbols.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    order = F.struct("file_path", "line_start", "id")
    return (
        graph.symbols.join(parents, "parent_id")
        .groupBy(F.concat_ws(".", "parent_name", "name").alias("qualified"))
        .agg(F.min(order).alias("_s"), F.count(F.lit(1)).alias("n_symbols"))
        .select("qualified", F.col("_s.id").alias("id"), "n_symbols")
    )


def children(graph: CodeGraph) -> DataFrame:
    """Members of every symbol that has some: counts by kind and the span of their lines."""
    return graph.symbols.where("parent_id is not null").groupBy("parent_id", "kind").agg(
        F.count(F.lit(1)).alias("n_members"), F.min("line_start").alias("first_line"), F.max("line_end").alias("last_line")
    )


def names_of_ids(graph: CodeGraph, ids: DataFrame, column: str) -> DataFrame:
    """ids with a column <column>_name: the symbol's name, else the second part of the id, else the id."""
    known = graph.names.select(F.col("id").alias(column), F.col("name").alias("_name"))
    named = F.coalesce("_name", X.name_in_id(F.col(column)))
    return ids.join(known, column, "left").withColumn(f"{column}_name", named).drop("_name")


def caller_names(graph: CodeGraph, ids: DataFrame, column: str = "from_id") -> DataFrame:
    """ids with display_name: 'Parent.name' or 'name'; the file's stem for code outside of symbols."""
    parents = graph.names.select(F.col("id").alias("_parent"), F.col("name").alias("_parent_name"))
    known = graph.symbols.select(F.col("id").alias(column), F.col("name").alias("_name"), F.col("parent_id").alias("_parent"))
    known = known.join(parents, "_parent", "left").select(column, "_name", "_parent_name")
    own_code = F.try_element_at(F.split(column, "::"), F.lit(2)) == "__module__"
    shown = (
        F.when(F.col("_name").isNotNull(), F.concat_ws(".", "_parent_name", "_name"))
        .when(own_code, X.file_stem(F.substring_index(column, "::", 1)))
        .otherwise(X.name_in_id(F.col(column)))
    )
    return ids.join(known, column, "left").withColumn("display_name", shown).drop("_name", "_parent_name")


# ---- counts ---------------------------------------------------------------------------------------------------------


def caller_counts(graph: CodeGraph) -> DataFrame:
    """(id, n_callers) of every symbol that is called: distinct callers by id, by name, or as a member '.name'.

    Calls are counted per spelling first, so that symbols of the same name
    share one row of counts and hot spellings are one row before any join.
    """
    spelled = graph.calls.groupBy("to_id").agg(F.count(F.lit(1)).alias("n"))
    keys = spelled.select(F.explode(F.array_compact(F.array("to_id", X.member_tail(F.col("to_id"))))).alias("key"), "n")
    counts = keys.groupBy("key").agg(F.sum("n").alias("n"))
    by_id = counts.select(F.col("key").alias("id"), F.col("n").alias("n_id"))
    by_name = counts.select(F.col("key").alias("name"), F.col("n").alias("n_name"))
    both = graph.names.join(by_id, "id", "left").join(by_name, "name", "left")
    n = F.coalesce("n_id", F.lit(0)) + F.when(F.col("name") != F.col("id"), F.coalesce("n_name", F.lit(0))).otherwise(0)
    return both.select("id", n.alias("n_callers")).where("n_callers > 0")


def core_symbols(graph: CodeGraph, limit: int = 10) -> DataFrame:
    """The most-called functions and methods: name, kind, file_path, n_callers."""
    mine = graph.symbols.where(F.col("kind").isin(*CALLABLE)).select("id", "name", "kind", "file_path")
    return mine.join(caller_counts(graph), "id").orderBy(F.desc("n_callers"), "name", "id").limit(limit)


def importance(graph: CodeGraph) -> DataFrame:
    """(to_id, score): calls of a spelling by the calls of the most-called one."""
    n = graph.calls.groupBy("to_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("to_id", (F.col("n") / n.select(F.max("n")).scalar()).alias("score"))


def callers_by_key(graph: CodeGraph) -> DataFrame:
    """(name, from_id, n_edges): calls of each name or id, by the spelling match of counts."""
    keyed = graph.calls.select("from_id", F.explode(F.array_compact(F.array("to_id", X.member_tail(F.col("to_id"))))).alias("name"))
    return keyed.groupBy("name", "from_id").agg(F.count(F.lit(1)).alias("n_edges"))


def incoming_callers(graph: CodeGraph) -> DataFrame:
    """(name, from_id, n_edges, display_name): who calls each symbol name."""
    return caller_names(graph, callers_by_key(graph).join(graph.symbols.select("name").distinct(), "name", "left_semi"))


def outgoing_calls(graph: CodeGraph) -> DataFrame:
    """(from_id, to_name): distinct names that each caller calls."""
    named = names_of_ids(graph, graph.calls.select("from_id", "to_id").distinct(), "to_id")
    return named.select("from_id", F.col("to_id_name").alias("to_name")).distinct()


def _first_names(named: DataFrame, key: str, as_: str, limit: int) -> DataFrame:
    """(key, as_): the first `limit` distinct names of each key as one text; no more than those are ever brought together."""
    w = Window.partitionBy(key).orderBy("name")
    some = named.select(key, "name").distinct().withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit)
    return some.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("name")), " ").alias(as_))


def callees_of(graph: CodeGraph, limit: int = 10) -> DataFrame:
    """(from_id, callees): names of the symbols that each caller calls by id, at most `limit`, as one text."""
    calls = graph.calls.select("from_id", F.col("to_id").alias("id"))
    return _first_names(calls.join(graph.names, "id"), "from_id", "callees", limit)


def callers_of(graph: CodeGraph, limit: int = 10) -> DataFrame:
    """(to_id, callers): names of the symbols that call each spelling, at most `limit`, as one text."""
    calls = graph.calls.select("to_id", F.col("from_id").alias("id"))
    return _first_names(calls.join(graph.names, "id"), "to_id", "callers", limit)


def fan_out(graph: CodeGraph) -> DataFrame:
    return graph.calls.groupBy("from_id").agg(F.count(F.lit(1)).alias("n_calls"))


def directories(graph: CodeGraph) -> DataFrame:
    return graph.symbols.groupBy(X.directory(F.col("file_path")).alias("directory")).agg(
        F.countDistinct("file_path").alias("n_files"), F.count(F.lit(1)).alias("n_symbols")
    )


def language_stats(graph: CodeGraph) -> DataFrame:
    return graph.symbols.groupBy("language").agg(F.countDistinct("file_path").alias("n_files"), F.count(F.lit(1)).alias("n_symbols"))


def totals(graph: CodeGraph) -> DataFrame:
    """One row: n_symbols, n_files, n_edges."""
    edges = graph.edges.select(F.count(F.lit(1))).scalar()
    s = graph.symbols.agg(F.count(F.lit(1)).alias("n_symbols"), F.countDistinct("file_path").alias("n_files"))
    return s.select("n_symbols", "n_files", edges.alias("n_edges"))


# ---- references and dependencies ------------------------------------------------------------------------------------


def match_names(graph: CodeGraph, ids: DataFrame) -> DataFrame:
    """(target, key): what refers to each of the symbols `ids` (id): its id and name, and those of a class's members."""
    mine = graph.symbols.join(ids.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("target"), "id", "name", "kind")
    classes = mine.where(F.col("kind").isin(*CLASS_LIKE)).select("target", F.col("id").alias("parent_id"))
    members = graph.symbols.join(classes, "parent_id").select("target", "id", "name")
    both = mine.select("target", "id", "name").unionByName(members)
    return both.select("target", F.explode(F.array("id", "name")).alias("key")).distinct()


def grouped_refs(graph: CodeGraph, names: DataFrame, kinds: list[str] | None = None, named: bool = True) -> tuple[DataFrame, DataFrame]:
    """(edges with group and, if named, from_name) and (group, target): the references to targets by their names (target, key), not paired yet.

    An edge is in one group and a target in a group once, so joined by group
    they give every reference once. Edges of spellings that one key fits are that key's
    group; a spelling that fits several keys is a group of its own. Edges whose
    spelling fits nothing are left out before the current ones are chosen.
    """
    names = checkpoint(names)
    edges = graph.edges.where(F.col("kind").isin(*kinds)) if kinds else graph.edges
    spelled = edges.select("to_id").distinct().withColumn("key", F.explode(X.tails(F.col("to_id"))))
    hits = checkpoint(spelled.join(names.select("key").distinct(), "key", "left_semi"))
    own = hits.groupBy("to_id").agg(F.count(F.lit(1)).alias("_n"), F.min("key").alias("_key"))
    own = checkpoint(own.select("to_id", "_n", F.when(F.col("_n") == 1, F.concat(F.lit("k"), "_key")).otherwise(F.concat(F.lit("s"), "to_id")).alias("group")))
    by_key = own.where("_n = 1").select("group").distinct()
    targets = names.select("target", F.concat(F.lit("k"), "key").alias("group")).join(by_key, "group", "left_semi")
    several = hits.join(own.where("_n > 1"), "to_id").join(names, "key").select("target", "group").distinct()
    targets = checkpoint(targets.unionByName(several), replaces=[names, hits])
    edges = checkpoint(likely_in(edges, own, "to_id"))
    found = checkpoint(lookup_by(own, "to_id")(edges).drop("_n").where("group is not null"), replaces=[edges, own])
    if not named:
        return found, targets
    shown = names_of_ids(graph, found, "from_id").withColumnRenamed("from_id_name", "from_name")
    return checkpoint(shown, replaces=found), targets


def refs(graph: CodeGraph, ids: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(target, from_id, to_id, kind, file_path, line, from_name): every reference to the symbols `ids`.

    An edge that fits several names of a target is one row.
    """
    graph = CodeGraph(checkpoint(graph.symbols.select("id", "name", "kind", "parent_id")), graph.edges)
    edges, targets = grouped_refs(graph, match_names(graph, ids), kinds)
    return join_pairs(edges, targets, "group").select("from_id", "to_id", "kind", "file_path", "line", "target", "from_name")


def picked_refs(edges: DataFrame, targets: DataFrame, limit: int = 20) -> DataFrame:
    """(target, totals, alone, picks): which of its references (grouped_refs) are the first `limit` of each target, in first_refs' order.

    picks has the place and the columns of every such reference in one group; alone says
    that the target has picks in no other group, so that the row is all it has. totals has
    (kind, n) of all references to the target. A target's first ones are
    among the first of its groups, so no more than those are ever joined, and
    they are merged by their numbers in the order of all groups' first ones. The tables of
    edges and targets are removed once they have been read.
    """
    order = ["kind", "file_path", "line", "from_id", "to_id"]
    shown = [c for c in (*order, "from_name") if c in edges.columns]
    place = F.row_number().over(Window.partitionBy("group").orderBy(*order))
    first = checkpoint(edges.withColumn("_i", place).where(F.col("_i") <= limit).drop("_i"))
    ranked = checkpoint(first.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), replaces=first)
    rows = ranked.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("_at", *shown))).alias("_rows"))
    counts = edges.groupBy("group", "kind").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.groupBy("group").agg(F.collect_list(F.struct("kind", "n")).alias("_kinds"))
    groups = checkpoint(rows.join(counts, "group"), replaces=[ranked, edges])

    own = targets.join(groups.select("group", "_kinds", F.col("_rows._at").alias("_ats")), "group")
    own = own.groupBy("target").agg(F.collect_list(F.struct("group", "_ats", "_kinds")).alias("_g"))
    each = F.flatten(F.transform("_g", lambda g, k: F.transform(g["_ats"], lambda at, i: F.named_struct(F.lit("at"), at, F.lit("k"), k, F.lit("i"), i))))
    own = own.withColumn("_all", F.slice(F.array_sort(each), 1, limit)).withColumn("_kinds", F.flatten("_g._kinds"))
    totals = F.transform(
        F.array_distinct("_kinds.kind"),
        lambda kind: F.named_struct(F.lit("kind"), kind, F.lit("n"), F.aggregate(F.filter("_kinds", lambda x: x["kind"] == kind), F.lit(0).cast("long"), lambda a, x: a + x["n"])),
    )
    at = F.transform("_all", lambda x, p: F.named_struct(F.lit("place"), p + 1, F.lit("k"), x["k"], F.lit("i"), x["i"]))
    own = own.select("target", totals.alias("totals"), (F.size(F.array_distinct("_all.k")) == 1).alias("alone"), at.alias("_all"), F.posexplode("_g.group").alias("_k", "group"))
    own = own.withColumn("_all", F.filter("_all", lambda x: x["k"] == F.col("_k"))).where(F.size("_all") > 0)
    own = checkpoint(own.drop("_k"), replaces=targets)

    def pick(x):  # noqa: ANN001, ANN202
        row = F.element_at("_rows", x["i"] + 1)
        return F.named_struct(F.lit("place"), x["place"], *[y for c in shown for y in (F.lit(c), row[c])])

    full = own.join(groups.select("group", "_rows"), "group")
    return full.select("target", "totals", "alone", F.transform("_all", pick).alias("picks"))


def first_refs_of(edges: DataFrame, targets: DataFrame, limit: int = 20) -> DataFrame:
    """first_refs of references that aren't paired yet (grouped_refs)."""
    total = F.aggregate("totals", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("total")
    return picked_refs(edges, targets, limit).select("target", total, F.explode("picks").alias("_p")).select("target", "_p.*", "total")


def top_refs_of(edges: DataFrame, targets: DataFrame, limit: int = 20) -> DataFrame:
    """top_refs of references that aren't paired yet (grouped_refs); only targets with picks in several groups are brought together."""
    picked = picked_refs(edges, targets, limit)
    mixed = picked.where("not alone").groupBy("target").agg(F.first("totals").alias("totals"), F.flatten(F.collect_list("picks")).alias("picks"))
    full = picked.where("alone").select("target", "totals", "picks").unionByName(mixed)
    kind = F.explode(F.array_distinct("picks.kind"))
    full = full.withColumn("kind", kind).withColumn("refs", F.array_sort(F.filter("picks", lambda x: x["kind"] == F.col("kind"))))
    total = F.filter("totals", lambda x: x["kind"] == F.col("kind"))[0]["n"]
    return full.select("target", "kind", F.size("refs").cast("long").alias("shown"), "refs", total.alias("total"), X.kind_words(F.col("kind")).alias("how"))


def first_refs(found: DataFrame, target: str = "target", limit: int = 20) -> DataFrame:
    """The first `limit` references to each target by kind, file and line, with place and the untruncated total."""
    order = ["kind", "file_path", "line", "from_id", "to_id"]
    totals = found.groupBy(target).agg(F.count(F.lit(1)).alias("total"))
    placed = found.withColumn("place", F.row_number().over(Window.partitionBy(target).orderBy(*order)))
    return placed.where(F.col("place") <= limit).join(totals, target)


def top_refs(found: DataFrame, limit: int = 20) -> DataFrame:
    """first_refs of each target grouped by kind, in order, beside the shown and the untruncated number of the kind."""
    rows = F.array_sort(F.collect_list(F.struct("place", "file_path", "line", "from_name", "to_id")))
    grouped = first_refs(found, limit=limit).groupBy("target", "kind").agg(F.count(F.lit(1)).alias("shown"), rows.alias("refs"))
    totals = found.groupBy("target", "kind").agg(F.count(F.lit(1)).alias("total"))
    return grouped.join(totals, ["target", "kind"]).withColumn("how", X.kind_words(F.col("kind")))


def callers(graph: CodeGraph, ids: DataFrame) -> DataFrame:
    """References of kind calls to the symbols `ids`; deeper callers are those of traversal.impact."""
    return refs(graph, ids, ["calls"])


def file_names(graph: CodeGraph) -> DataFrame:
    """(target, key): ids and names of the symbols of each file (target)."""
    return graph.symbols.select(F.col("file_path").alias("target"), F.explode(F.array("id", "name")).alias("key")).distinct()


def file_refs(graph: CodeGraph, kinds: list[str] | None = None) -> DataFrame:
    """(target, from_id, to_id, kind, file_path, line): every reference to a symbol of each file (target), one row an edge and file."""
    edges, targets = grouped_refs(graph, file_names(graph), kinds, named=False)
    return join_pairs(edges, targets, "group").select("from_id", "to_id", "kind", "file_path", "line", "target")


def file_deps(graph: CodeGraph) -> DataFrame:
    """Direct dependencies of each file (target): those of all its symbols and of its own code, as deps()."""
    mine = graph.symbols.select(F.col("file_path").alias("target"), F.col("id").alias("from_id"))
    own = mine.select("target", F.concat("target", F.lit("::__module__::function")).alias("from_id"))
    return _direct(graph, mine.unionByName(own).distinct())


def refs_by_name(graph: CodeGraph) -> DataFrame:
    """(name, kind, n_refs, n_holders) of every symbol name that something refers to."""
    known = graph.symbols.select(F.col("name").alias("key")).distinct()
    return graph.keyed_edges().join(known, "key", "left_semi").groupBy(F.col("key").alias("name"), "kind").agg(
        F.count(F.lit(1)).alias("n_refs"), F.countDistinct("from_id").alias("n_holders")
    )


def sources_of(graph: CodeGraph, ids: DataFrame) -> DataFrame:
    """(target, from_id): ids whose edges are a symbol's own: itself, a class's members, and the code of its file."""
    mine = graph.symbols.join(ids.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("target"), "id", "kind", "file_path")
    classes = mine.where(F.col("kind").isin(*CLASS_LIKE)).select("target", F.col("id").alias("parent_id"))
    members = graph.symbols.join(classes, "parent_id").select("target", F.col("id").alias("from_id"))
    of_file = mine.select("target", F.concat("file_path", F.lit("::__module__::function")).alias("from_id"))
    return mine.select("target", F.col("id").alias("from_id")).unionByName(members).unionByName(of_file).distinct()


def resolved(graph: CodeGraph, deps: DataFrame) -> DataFrame:
    """deps (target, to_id, kind, depth) with name, file_path and is_external: by id, else by the name's one symbol.

    Of several that have the same name and kind the one of the least depth,
    then the smallest to_id, remains.
    """
    # A spelling is resolved once, however many dependencies have it: distinct spellings have no hot key, and lookup_by keeps hot ones apart.
    by_id = graph.symbols.select(F.col("id").alias("to_id"), F.col("name").alias("_name"), F.col("file_path").alias("_file"))
    by_name = find_symbols(graph).select(F.col("name").alias("to_id"), F.col("file_path").alias("_any"))
    known = graph.edges.select("to_id").distinct().join(by_id, "to_id", "left").join(by_name, "to_id", "left")
    known = known.select("to_id", F.coalesce("_name", X.name_in_id(F.col("to_id"))).alias("name"), F.coalesce("_file", "_any").alias("file_path"))
    full = lookup_by(known, "to_id")(deps)
    full = full.select("target", "kind", "name", F.struct("depth", "to_id", "file_path").alias("_d"))
    return full.groupBy("target", "name", "kind").agg(F.min("_d").alias("_d")).select(
        "target", "name", "kind", F.col("_d.depth").alias("depth"), F.col("_d.file_path").alias("file_path"), F.col("_d.file_path").isNull().alias("is_external")
    )


def _direct(graph: CodeGraph, src: DataFrame) -> DataFrame:
    """Direct dependencies of targets by their sources (target, from_id), without what is a source itself."""
    direct = graph.edges.join(src, "from_id").select("target", "to_id", "kind").distinct().withColumn("depth", F.lit(1))
    own = src.select("target", F.col("from_id").alias("to_id"))
    return resolved(graph, direct.join(own, ["target", "to_id"], "left_anti"))


def deps(graph: CodeGraph, ids: DataFrame) -> DataFrame:
    """Direct dependencies of the symbols `ids`: target, name, kind, depth, file_path, is_external."""
    return _direct(graph, sources_of(graph, ids))


def implementors(graph: CodeGraph) -> DataFrame:
    """(interface_id, from_id): implements edges that name a symbol by its id."""
    ids = graph.symbols.select(F.col("id").alias("to_id"))
    return graph.edges.where("kind = 'implements'").join(ids, "to_id", "left_semi").select(F.col("to_id").alias("interface_id"), "from_id")


def class_relationships(graph: CodeGraph) -> DataFrame:
    """(class_id, relation, name): what each class extends, implements and otherwise depends on.

    extends and implements are also read from the code outside of symbols of
    the class's file; dependencies are those of the class and its members.
    """
    classes = graph.symbols.where(F.col("kind").isin(*CLASS_LIKE)).select(F.col("id").alias("class_id"), "file_path")
    own = classes.select("class_id", F.explode(F.array("class_id", F.concat("file_path", F.lit("::__module__::class")))).alias("from_id"))
    up = graph.edges.where("kind in ('extends', 'implements')").join(own, "from_id")
    up = up.select("class_id", F.col("kind").alias("relation"), "to_id").distinct()
    members = graph.symbols.select(F.col("id").alias("from_id"), F.col("parent_id").alias("class_id")).join(classes, "class_id", "left_semi")
    inside = members.select("class_id", "from_id").unionByName(classes.select("class_id", F.col("class_id").alias("from_id"))).distinct()
    uses = graph.edges.where("kind not in ('extends', 'implements')").join(inside, "from_id").where("to_id <> class_id")
    uses = uses.select("class_id", F.lit("depends").alias("relation"), "to_id").distinct()
    named = names_of_ids(graph, up.unionByName(uses), "to_id")
    return named.select("class_id", "relation", F.col("to_id_name").alias("name")).distinct()
