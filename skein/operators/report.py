"""Composite reports over the graph, and source texts beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import graph as G
from skein.operators import traversal as T
from skein.operators.graph import CodeGraph
from skein.scale import checkpoint, join_pairs
from skein.tables import CLASS_LIKE


def class_sketches(graph: CodeGraph) -> DataFrame:
    """(class_id, class_name, kind, id, name, signature, line_start, n_callers): members of every class, struct, interface and enum."""
    owners = graph.symbols.where(F.col("kind").isin("class", "struct", "interface", "enum")).select(F.col("id").alias("class_id"), F.col("name").alias("class_name"))
    members = graph.symbols.where("parent_id is not null").withColumn("class_id", F.col("parent_id")).join(owners, "class_id")
    counted = members.join(G.caller_counts(graph), "id", "left")
    return counted.select("class_id", "class_name", "kind", "id", "name", "signature", "line_start", F.coalesce("n_callers", F.lit(0)).alias("n_callers"))


def shown_callers(graph: CodeGraph, code: DataFrame) -> DataFrame:
    """(id, display_name, n_edges): the calls of each symbol of `code` (id, name) by its id or name, by the caller's display name.

    Callers are named and summed up once a name, however many symbols have it.
    What calls a symbol by its id too is found from the few calls by id, so that
    the many pairs of symbols and callers by name are only filtered.
    """
    spelled = code.select(F.explode(F.array("id", "name")).alias("name")).distinct()
    by_key = G.caller_names(graph, G.callers_by_key(graph).join(spelled, "name", "left_semi"))
    by_key = checkpoint(by_key.groupBy("name", "display_name").agg(F.sum("n_edges").alias("n_edges")))
    by_id = by_key.select(F.col("name").alias("id"), "display_name", F.col("n_edges").alias("_by_id"))
    by_id = checkpoint(by_id.join(code.where("not (id <=> name)"), "id"))
    twice = checkpoint(by_id.join(by_key, ["name", "display_name"]).select("id", "display_name", (F.col("_by_id") + F.col("n_edges")).alias("n_edges")))
    once = by_id.select("id", "display_name", F.col("_by_id").alias("n_edges")).join(twice, ["id", "display_name"], "left_anti")
    skip = twice.groupBy("id").agg(F.collect_list("display_name").alias("_skip"))
    named = join_pairs(by_key, checkpoint(code.join(skip, "id", "left")), "name")
    named = named.where(F.col("_skip").isNull() | ~F.array_contains("_skip", F.col("display_name")))
    return twice.unionByName(once).unionByName(named.select("id", "display_name", "n_edges"))


def sketches(graph: CodeGraph) -> DataFrame:
    """(id, section, item, n): what the sketch of each symbol says, by its kind.

    Classes and structs: member (id, its callers) and what they extend,
    implement and depend on; functions and methods: calls (names) and
    called_by (display names, edges); interfaces: member and implementor (id);
    enums: variant (id) and callers (their number). n is null where nothing is counted.
    """
    part = lambda df, id_, section, item, n=None: df.select(
        F.col(id_).alias("id"), section.alias("section"), F.col(item).alias("item"), (F.col(n) if n else F.lit(None)).cast("long").alias("n")
    )
    symbols = checkpoint(graph.symbols.select("id", "name", "kind", "file_path", "line_start", "signature", "parent_id"))
    graph = CodeGraph(symbols, checkpoint(graph.edges.select("from_id", "to_id", "kind")))
    kinds = graph.symbols.select("id", "name", "kind")
    counts = checkpoint(G.caller_counts(graph))
    members = class_sketches(graph).join(kinds.select(F.col("id").alias("class_id"), F.col("kind").alias("_of")), "class_id")
    inside = part(members.where("_of <> 'enum'"), "class_id", F.lit("member"), "id", "n_callers")
    variants = part(members.where("_of = 'enum' and kind = 'variant'"), "class_id", F.lit("variant"), "id")
    classy = kinds.where("kind in ('class', 'struct')").select(F.col("id").alias("class_id"))
    related = part(G.class_relationships(graph).join(classy, "class_id", "left_semi"), "class_id", F.col("relation"), "name")
    code = kinds.where(F.col("kind").isin(*G.CALLABLE))
    calls = G.outgoing_calls(graph).join(code.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    by = shown_callers(graph, code.select("id", "name"))
    done_by = G.implementors(graph).join(kinds.where("kind = 'interface'").select(F.col("id").alias("interface_id")), "interface_id", "left_semi")
    enums = kinds.where("kind = 'enum'").join(counts, "id", "left").select("id", F.lit("callers").alias("item"), F.coalesce("n_callers", F.lit(0)).alias("n"))
    return (
        inside.unionByName(variants).unionByName(checkpoint(related))
        .unionByName(checkpoint(part(calls, "from_id", F.lit("calls"), "to_name")))
        .unionByName(part(by, "id", F.lit("called_by"), "display_name", "n_edges"))
        .unionByName(part(done_by, "interface_id", F.lit("implementor"), "from_id"))
        .unionByName(part(enums, "id", F.lit("callers"), "item", "n"))
    )


def symbol_summaries(graph: CodeGraph) -> DataFrame:
    """(id, n_callers, n_deps, n_methods, n_fields) of every symbol; n_deps are a class's dependencies, else the distinct names called."""
    prop = F.col("kind") == "property"
    members = graph.symbols.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(
        F.count(F.when(~prop, 1)).alias("n_methods"), F.count(F.when(prop, 1)).alias("n_fields")
    )
    kinds = graph.symbols.select("id", "kind")
    classy = kinds.where(F.col("kind").isin(*CLASS_LIKE)).select("id")
    of_class = G.deps(graph, classy).groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("_deps"))
    calls = G.outgoing_calls(graph).groupBy(F.col("from_id").alias("id")).agg(F.count(F.lit(1)).alias("_calls"))
    full = kinds.join(G.caller_counts(graph), "id", "left").join(members, "id", "left").join(calls, "id", "left").join(of_class, "id", "left")
    full = full.withColumn("n_deps", F.when(F.col("kind").isin(*CLASS_LIKE), F.col("_deps")).otherwise(F.col("_calls")))
    return full.select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_callers", "n_deps", "n_methods", "n_fields")])


def file_summaries(graph: CodeGraph) -> DataFrame:
    """(file_path, n_symbols, top_level): 'kind name' of each file's symbols without parent, in order."""
    row = F.when(F.col("parent_id").isNull(), F.struct("line_start", "id", F.concat_ws(" ", "kind", "name").alias("t")))
    return graph.symbols.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_symbols"), F.sort_array(F.collect_list(row)).alias("_r")).select(
        "file_path", "n_symbols", F.array_join(F.transform("_r", lambda r: r["t"]), "; ").alias("top_level")
    )


def overview(graph: CodeGraph, limit: int = 10) -> DataFrame:
    """(section, item, n): totals, languages, directories, the most-called symbols and the entrypoints of each group, as one table."""
    part = lambda df, section, item, n: df.select(F.lit(section).alias("section"), F.col(item).alias("item"), F.col(n).alias("n"))
    sums = G.totals(graph).select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"n_{k}").alias("n")) for k in ("symbols", "files", "edges")])).alias("t")
    ).select(F.col("t.k").alias("k"), F.col("t.n").alias("n"))
    return (
        part(G.core_symbols(graph, limit), "core", "id", "n_callers")
        .unionByName(part(T.entrypoints(graph).groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "entrypoints", "grp", "n"))
        .unionByName(part(G.directories(graph), "directory", "directory", "n_symbols"))
        .unionByName(part(G.language_stats(graph), "language", "language", "n_symbols"))
        .unionByName(part(sums, "total", "k", "n"))
    )


def status(graph: CodeGraph, hashes: DataFrame, now: Column | None = None) -> DataFrame:
    """One row: totals, time of the last indexing, how long that is ago (now is in epoch seconds, else the clock's), state."""
    last = hashes.select(F.max("indexed_at")).scalar()
    now = F.unix_timestamp() if now is None else now
    state = F.when(F.col("n_symbols") == 0, "empty").otherwise("up to date")
    return G.totals(graph).select("*", last.alias("last_indexed_at"), X.relative_time(now - last).alias("age"), state.alias("state"))


def changed_symbols(graph: CodeGraph, files: DataFrame) -> DataFrame:
    """The symbols of changed files (change, file_path)."""
    columns = ["id", "name", "kind", "file_path", "line_start", "line_end", "signature", "change"]
    return graph.symbols.join(files, "file_path").select(columns)


def latest_texts(documents: DataFrame) -> DataFrame:
    """(file_path, text): the latest text of each path."""
    row = F.struct("created_at", "doc_id", "text")
    latest = documents.where("path is not null and text is not null").groupBy(F.col("path").alias("file_path")).agg(F.max(row).alias("_r"))
    return latest.select("file_path", F.col("_r.text").alias("text"))


def file_lines(documents: DataFrame) -> DataFrame:
    """(file_path, lines): the latest text of each path, as an array of lines; line ends of any kind."""
    return latest_texts(documents).select("file_path", F.split("text", "\r\n|\n|\r").alias("lines"))


def sources(graph: CodeGraph, documents: DataFrame) -> DataFrame:
    """(id, source): the lines of every symbol whose file's text is known and long enough."""
    s = graph.symbols.select("id", "file_path", "line_start", "line_end").join(file_lines(documents), "file_path")
    fits = (F.col("line_start") >= 1) & (F.col("line_start") <= F.size("lines")) & (F.col("line_start") <= F.col("line_end"))
    n = F.least(F.col("line_end"), F.size("lines")) - F.col("line_start") + 1
    return s.where(fits).select("id", F.array_join(F.slice("lines", F.col("line_start"), n), "\n").alias("source"))


def snippets(graph: CodeGraph, documents: DataFrame, around: int = 1) -> DataFrame:
    """Edges (from_id, to_id, kind) with the line they stand on, right-trimmed, and `around` lines on either side; nulls where unknown."""
    e = graph.edges.select("from_id", "to_id", "kind", "file_path", "line").join(file_lines(documents), "file_path", "left")
    known = F.col("lines").isNotNull() & (F.col("line") >= 1) & (F.col("line") <= F.size("lines"))
    first = F.greatest(F.col("line") - around, F.lit(1))
    last = F.least(F.col("line") + around, F.size("lines"))
    return e.select(
        "from_id", "to_id", "kind", "file_path", "line",
        F.when(known, F.rtrim(F.try_element_at("lines", F.greatest(F.col("line"), F.lit(1))))).alias("context"),
        F.when(known, F.array_join(F.slice("lines", first, F.greatest(last - first + 1, F.lit(0))), "\n")).alias("snippet"),
    )


def json_rows(command: str, rows: DataFrame, symbol: str | None = None, total: Column | None = None, truncated: Column | None = None) -> DataFrame:
    """Each row as the JSON envelope of a report: command, symbol (a column), data (the other columns), truncated, total."""
    data = F.struct(*[c for c in rows.columns if c != symbol])
    envelope = F.struct(
        F.lit(command).alias("command"), (F.col(symbol) if symbol else F.lit(None).cast("string")).alias("symbol"), data.alias("data"),
        (F.lit(False) if truncated is None else truncated).alias("truncated"), (F.lit(1) if total is None else total).cast("long").alias("total"),
    )
    return rows.select(F.to_json(envelope).alias("value"))
