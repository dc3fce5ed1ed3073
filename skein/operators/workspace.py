"""Queries over several projects at once; a project is the first part of a path unless a column says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import graph as G
from skein.operators import traversal as T
from skein.operators.graph import CodeGraph


def project_of(path: Column) -> Column:
    return F.substring_index(X.slashes(path), "/", 1)


def status(graph: CodeGraph, hashes: DataFrame) -> DataFrame:
    """(project, n_files, n_symbols, n_edges, last_indexed_at, state) of each project."""
    s = graph.symbols.groupBy(project_of(F.col("file_path")).alias("project")).agg(F.countDistinct("file_path").alias("n_files"), F.count(F.lit(1)).alias("n_symbols"))
    e = graph.edges.groupBy(project_of(F.col("file_path")).alias("project")).agg(F.count(F.lit(1)).alias("n_edges"))
    h = hashes.groupBy(project_of(F.col("file_path")).alias("project")).agg(F.max("indexed_at").alias("last_indexed_at"))
    full = s.join(e, "project", "full").join(h, "project", "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    state = F.when(F.coalesce("n_symbols", F.lit(0)) == 0, "empty").otherwise("up to date")
    return full.select("project", zero("n_files"), zero("n_symbols"), zero("n_edges"), "last_indexed_at", state.alias("state"))


def totals(members: DataFrame) -> DataFrame:
    """One row of a status table (status()): projects, sums over them, the last indexing of any, whether all are indexed."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_files", "n_symbols", "n_edges")]
    return members.agg(F.count(F.lit(1)).alias("n_projects"), *sums, F.max("last_indexed_at").alias("last_indexed_at"), F.coalesce(F.bool_and(F.col("n_symbols") > 0), F.lit(True)).alias("all_indexed"))


def find_symbols(graph: CodeGraph) -> DataFrame:
    """(project, name, id, n_symbols): for every name the one symbol that it means in each project."""
    order = F.struct(F.col("parent_id").isNotNull().alias("inner"), "file_path", "line_start", "id")
    by = graph.symbols.groupBy(project_of(F.col("file_path")).alias("project"), "name")
    return by.agg(F.min(order)["id"].alias("id"), F.count(F.lit(1)).alias("n_symbols"))


def languages(graph: CodeGraph) -> DataFrame:
    """(language, n_projects, n_files): the languages of all projects."""
    return graph.symbols.groupBy("language").agg(F.countDistinct(project_of(F.col("file_path"))).alias("n_projects"), F.countDistinct("file_path").alias("n_files"))


def refs(graph: CodeGraph, name: str, limit: int = 20) -> DataFrame:
    """References to a name in all projects: at most twice the limit of each project, the first `limit` by kind and holder.

    Edges don't cross projects: an edge counts where its own file's project has a symbol of that name.
    """
    owners = graph.symbols.where(F.col("name") == name).select(project_of(F.col("file_path")).alias("project")).distinct()
    hits = graph.keyed_edges().where(F.col("key") == name).drop("key").withColumn("project", project_of(F.col("file_path")))
    hits = hits.join(owners, "project", "left_semi")
    w = Window.partitionBy("project").orderBy("kind", "file_path", "line", "from_id", "to_id")
    some = hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= 2 * limit).drop("_n")
    named = G.names_of_ids(graph, some, "from_id").withColumnRenamed("from_id_name", "from_name")
    return named.orderBy("kind", "from_name", "project", "file_path", "line", "to_id", "from_id").limit(limit)


def entrypoint_groups(graph: CodeGraph) -> DataFrame:
    """(label, n_entrypoints, n_files): entrypoints of each project by group."""
    e = T.entrypoints(graph).withColumn("project", project_of(F.col("file_path")))
    return e.groupBy(F.concat_ws(" — ", "project", "grp").alias("label")).agg(F.count(F.lit(1)).alias("n_entrypoints"), F.countDistinct("file_path").alias("n_files"))


def core_symbols(graph: CodeGraph, limit: int = 10) -> DataFrame:
    """The most-called callables of each project (at most `limit`), by project."""
    mine = graph.symbols.where(F.col("kind").isin(*G.CALLABLE)).select("id", "name", F.col("file_path"))
    counted = mine.join(G.caller_counts(graph), "id").withColumn("project", project_of(F.col("file_path")))
    w = Window.partitionBy("project").orderBy(F.desc("n_callers"), "name", "id")
    return counted.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).drop("file_path")


def directories(graph: CodeGraph) -> DataFrame:
    """(directory, n_files, n_symbols): 'project/dir/' of every project."""
    p = project_of(F.col("file_path"))
    inner = F.regexp_replace("file_path", "^[^/]*/", "")
    return graph.symbols.groupBy(F.concat(p, F.lit("/"), X.directory(inner)).alias("directory")).agg(
        F.countDistinct("file_path").alias("n_files"), F.count(F.lit(1)).alias("n_symbols")
    )
