"""Lookups, counts, references, dependencies and traversals: queries and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import graph as G
from skein.operators import traversal as T
from skein.operators.graph import CodeGraph

#: Shared beginning of the SQL: current symbols s and edges e.
BASE = """s as (
  select id, name, kind, file_path, line_start, line_end, signature, docstring, nullif(parent_id, '') as parent_id, language, metadata
  from (select *, row_number() over (partition by id order by indexed_at desc) as r from symbols where id is not null) where r = 1
), e as (
  select from_id, to_id, kind, file_path, line from (
    select *, row_number() over (partition by from_id, to_id, kind order by indexed_at nulls first, line nulls last, file_path) as r
    from edges where from_id is not null and to_id is not null and kind is not null) where r = 1
)"""
TAIL = "regexp_extract(to_id, '\\.([^.]*)$', 1)"
COUNTS = f"""spelled as (select to_id, count(*) as n from e where kind = 'calls' group by to_id),
ck as (select key, sum(n) as n from (
  select to_id as key, n from spelled union all select {TAIL}, n from spelled where contains(to_id, '.')) group by key),
cc as (select id, n_callers from (
  select s.id, coalesce(a.n, 0) + case when s.name <> s.id then coalesce(b.n, 0) else 0 end as n_callers
  from s left join ck a on a.key = s.id left join ck b on b.key = s.name) where n_callers > 0)"""
FIRST = """fs as (select * from (select name, id, file_path,
  row_number() over (partition by name order by parent_id is not null, file_path, line_start, id) as r,
  count(*) over (partition by name) as n_symbols from s) where r = 1)"""
TAILS = """ek as (
  select distinct from_id, to_id, kind, file_path, line, key from (
    select *, to_id as key from e
    union all select *, unnest(list_transform(range(2, len(string_split(to_id, '::')) + 1), lambda i: array_to_string(string_split(to_id, '::')[i:], '::'))) as key from e
    union all select *, unnest(list_transform(range(2, len(string_split(to_id, '.')) + 1), lambda i: array_to_string(string_split(to_id, '.')[i:], '.'))) as key from e
  ) where key <> '')"""
NAMED = "case when n.name is not null then n.name when coalesce(string_split(x.to_id, '::')[2], '') <> '' then string_split(x.to_id, '::')[2] else x.to_id end"
CLASSY = "('class', 'struct', 'interface')"


def _top(graph: CodeGraph, n: int) -> DataFrame:
    """The most-called functions and methods: what a search for paths leads to."""
    return G.core_symbols(graph, n).select("id")


def _top_sql(n: int) -> str:
    return f"""{COUNTS}, top as (select s.id from s join cc using (id) where s.kind in ('function', 'method')
  order by n_callers desc, name, s.id limit {n})"""


def s04_current_symbols(spark: SparkSession, d: str) -> DataFrame:
    return CodeGraph.read(spark, d).symbols.select("id", "name", "kind", "file_path", "line_start", "line_end", "parent_id", "language")


def s05_current_edges(spark: SparkSession, d: str) -> DataFrame:
    return CodeGraph.read(spark, d).edges


def s03_languages(spark: SparkSession, d: str) -> DataFrame:
    s = CodeGraph.read(spark, d).symbols
    return s.groupBy(X.language_of(F.col("file_path")).alias("by_extension"), "language").agg(F.countDistinct("file_path").alias("n_files"))


def l01_find_symbol(spark: SparkSession, d: str) -> DataFrame:
    return G.find_symbols(CodeGraph.read(spark, d))


def l01_qualified(spark: SparkSession, d: str) -> DataFrame:
    return G.qualified_members(CodeGraph.read(spark, d))


def l03_ambiguous(spark: SparkSession, d: str) -> DataFrame:
    g = CodeGraph.read(spark, d)
    return g.symbols.groupBy("name").agg(
        F.count(F.lit(1)).alias("n_symbols"), F.countDistinct("file_path").alias("n_files"), F.countDistinct("kind").alias("n_kinds")
    ).where("n_symbols > 1")


def l03_matching(spark: SparkSession, d: str) -> DataFrame:
    """All symbols of every name, in their order."""
    s = CodeGraph.read(spark, d).symbols
    place = F.row_number().over(Window.partitionBy("name").orderBy("file_path", "line_start", "id"))
    return s.select("name", "id", "kind", "file_path", "line_start", place.alias("place"))


def l05_members(spark: SparkSession, d: str) -> DataFrame:
    s = CodeGraph.read(spark, d).symbols.where("parent_id is not null")
    place = F.row_number().over(Window.partitionBy("parent_id").orderBy("line_start", "id"))
    return s.select("parent_id", "id", "name", "kind", "signature", place.alias("place"))


def l09_spellings(spark: SparkSession, d: str) -> DataFrame:
    """What every spelling looks like, and names in ids from their end."""
    t = F.col("to_id")
    return CodeGraph.read(spark, d).edges.select("to_id").distinct().select("to_id", X.looks_like_path(t).alias("is_path"), X.parent_in_id(t).alias("parent"))


def l18_enrichment(spark: SparkSession, d: str) -> DataFrame:
    s = CodeGraph.read(spark, d).symbols
    access = F.when(F.col("language") == "python", X.inferred_access(F.col("name")))
    return s.select("id", X.enrichment(F.col("language"), F.col("metadata")).alias("prefix"), access.alias("access"), X.is_general_name(F.col("name"), F.col("language")).alias("is_general"))


def l05_children(spark: SparkSession, d: str) -> DataFrame:
    return G.children(CodeGraph.read(spark, d))


def l06_file_outline(spark: SparkSession, d: str) -> DataFrame:
    s = CodeGraph.read(spark, d).symbols
    row = F.struct("line_start", "line_end", "id", F.concat_ws(" ", "kind", "name").alias("t"))
    return s.groupBy("file_path").agg(F.sort_array(F.collect_list(row)).alias("_r")).select(
        "file_path", F.size("_r").cast("long").alias("n_symbols"), F.array_join(F.transform("_r", lambda r: r["t"]), "; ").alias("outline")
    )


def l07_names_of_ids(spark: SparkSession, d: str) -> DataFrame:
    g = CodeGraph.read(spark, d)
    return G.names_of_ids(g, g.edges.select("to_id").distinct(), "to_id")


def l08_caller_names(spark: SparkSession, d: str) -> DataFrame:
    g = CodeGraph.read(spark, d)
    return G.caller_names(g, g.edges.select("from_id").distinct())


def l10_path_classes(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("file_path")
    return CodeGraph.read(spark, d).symbols.select("file_path").distinct().select(
        X.slashes(p).alias("file_path"), X.is_test_file(p).alias("is_test"), X.is_vendor_path(p).alias("is_vendor"), X.entry_group(p).alias("grp"), X.directory(p).alias("directory")
    )


def l14_compact(spark: SparkSession, d: str) -> DataFrame:
    s = CodeGraph.read(spark, d).symbols
    return s.select("id", "name", "kind", "signature", "file_path", X.line_range(F.col("line_start"), F.col("line_end")).alias("lines"))


def l17_method_lines(spark: SparkSession, d: str) -> DataFrame:
    s = CodeGraph.read(spark, d).symbols.where("kind in ('function', 'method') and signature is not null")
    mods = X.modifiers(F.col("metadata"))
    return s.select("id", F.array_join(mods, " ").alias("modifiers"), X.method_line(F.col("signature"), mods).alias("shown"))


def a02_caller_counts(spark: SparkSession, d: str) -> DataFrame:
    return G.caller_counts(CodeGraph.read(spark, d))


def a03_incoming_callers(spark: SparkSession, d: str) -> DataFrame:
    return G.incoming_callers(CodeGraph.read(spark, d))


def a04_outgoing_calls(spark: SparkSession, d: str) -> DataFrame:
    return G.outgoing_calls(CodeGraph.read(spark, d))


def a05_name_lists(spark: SparkSession, d: str) -> DataFrame:
    g = CodeGraph.read(spark, d)
    called = G.callers_of(g).withColumnRenamed("to_id", "id")
    return G.callees_of(g).withColumnRenamed("from_id", "id").join(called, "id", "full").select("id", "callees", "callers")


def a06_importance(spark: SparkSession, d: str) -> DataFrame:
    return G.importance(CodeGraph.read(spark, d)).withColumn("score", F.round("score", 6))


def a07_core_symbols(spark: SparkSession, d: str) -> DataFrame:
    return G.core_symbols(CodeGraph.read(spark, d), 10)


def a08_directories(spark: SparkSession, d: str) -> DataFrame:
    return G.directories(CodeGraph.read(spark, d))


def a10_totals(spark: SparkSession, d: str) -> DataFrame:
    return G.totals(CodeGraph.read(spark, d))


def a13_fan_out(spark: SparkSession, d: str) -> DataFrame:
    return G.fan_out(CodeGraph.read(spark, d))


def a16_language_stats(spark: SparkSession, d: str) -> DataFrame:
    return G.language_stats(CodeGraph.read(spark, d))


def q01_refs(spark: SparkSession, d: str) -> DataFrame:
    """The references to every symbol."""
    g = CodeGraph.read(spark, d)
    return G.refs(g, g.symbols.select("id"))


def q01_refs_first(spark: SparkSession, d: str) -> DataFrame:
    """Of two kinds of references to every symbol the first 20, with the total."""
    g = CodeGraph.read(spark, d)
    found = G.grouped_refs(g, G.match_names(g, g.symbols.select("id")), ["calls", "instantiates"])
    return G.first_refs_of(*found).select("target", "place", "from_id", "to_id", "kind", "total")


def q03_file_refs(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 references to the symbols of every file, with the total."""
    g = CodeGraph.read(spark, d)
    return G.first_refs_of(*G.grouped_refs(g, G.file_names(g), named=False)).select("target", "place", "from_id", "to_id", "kind", "line", "total")


def q04_callers(spark: SparkSession, d: str) -> DataFrame:
    g = CodeGraph.read(spark, d)
    return G.callers(g, g.symbols.select("id")).select("target", "from_id", "to_id", "line", "from_name")


def q07_file_deps(spark: SparkSession, d: str) -> DataFrame:
    return G.file_deps(CodeGraph.read(spark, d))


def q01_refs_by_name(spark: SparkSession, d: str) -> DataFrame:
    return G.refs_by_name(CodeGraph.read(spark, d))


def q05_deps(spark: SparkSession, d: str) -> DataFrame:
    g = CodeGraph.read(spark, d)
    return G.deps(g, g.symbols.select("id"))


def q06_transitive_deps(spark: SparkSession, d: str) -> DataFrame:
    g = CodeGraph.read(spark, d)
    return T.transitive_deps(g, g.symbols.select("id"), 3)


def q08_impact(spark: SparkSession, d: str) -> DataFrame:
    g = CodeGraph.read(spark, d)
    return T.impact(g, g.symbols.select("id"), 3)


def q09_entrypoints(spark: SparkSession, d: str) -> DataFrame:
    return T.entrypoints(CodeGraph.read(spark, d))


def q10_trace(spark: SparkSession, d: str) -> DataFrame:
    g = CodeGraph.read(spark, d)
    return T.trace(g, _top(g, 1), 10, 20)


def _flow(g: CodeGraph) -> DataFrame:
    """From every function and method to the ten most-called ones, as deep and as many as by default."""
    return T.flow(g, g.symbols.where("kind in ('function', 'method')").select("id"), _top(g, 10))


def q11_flow(spark: SparkSession, d: str) -> DataFrame:
    return _flow(CodeGraph.read(spark, d)).withColumn("path", F.array_join("path", " > "))


def q12_path_steps(spark: SparkSession, d: str) -> DataFrame:
    g = CodeGraph.read(spark, d)
    steps = _flow(g).select(F.array_join("path", " > ").alias("path"), F.posexplode("path").alias("step", "id"))
    facts = g.symbols.select("id", "name", "file_path", "line_start", "kind")
    return steps.join(facts, "id", "left").select(
        "path", "step", F.coalesce("name", X.name_in_id(F.col("id"))).alias("name"), F.coalesce("file_path", F.substring_index("id", "::", 1)).alias("file_path"), F.coalesce("line_start", F.lit(0)).alias("line")
    )


def q13_class_relationships(spark: SparkSession, d: str) -> DataFrame:
    return G.class_relationships(CodeGraph.read(spark, d))


def q14_implementors(spark: SparkSession, d: str) -> DataFrame:
    return G.implementors(CodeGraph.read(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        s03_languages, s04_current_symbols, s05_current_edges, l01_find_symbol, l01_qualified, l03_ambiguous, l03_matching, l05_children, l05_members, l09_spellings, l18_enrichment, l06_file_outline,
        l07_names_of_ids, l08_caller_names, l10_path_classes, l14_compact, l17_method_lines, a02_caller_counts, a03_incoming_callers,
        a04_outgoing_calls, a05_name_lists, a06_importance, a07_core_symbols, a08_directories, a10_totals, a13_fan_out, a16_language_stats,
        q01_refs, q01_refs_first, q01_refs_by_name, q03_file_refs, q04_callers, q07_file_deps, q05_deps, q06_transitive_deps, q08_impact, q09_entrypoints, q10_trace, q11_flow, q12_path_steps,
        q13_class_relationships, q14_implementors,
    )
}

_DIR = "case when contains(regexp_replace(file_path, '^src/', ''), '/') then string_split(regexp_replace(file_path, '^src/', ''), '/')[1] else '(root)' end || '/'"
_GROUP = """case when contains(lower(file_path), 'controller') then 'API Controllers'
  when contains(lower(file_path), 'worker') or contains(lower(file_path), 'job') then 'Background Workers'
  when contains(lower(file_path), 'handler') or contains(lower(file_path), 'listener') then 'Event Handlers' else 'Other' end"""
_TEST = "(regexp_matches(lower(file_path), '(^|/)tests?/') or regexp_matches(lower(file_path), '[._](test|spec)\\.'))"
_LANG = """case regexp_extract(file_path, '\\.([^./\\\\]+)$', 1) when 'ts' then 'typescript' when 'tsx' then 'typescript' when 'cs' then 'csharp'
  when 'py' then 'python' when 'go' then 'go' when 'java' then 'java' when 'rs' then 'rust' end"""
_MATCH = f"""mine as (select * from s),
mem as (select m.id as target, c.id, c.name from mine m join s c on c.parent_id = m.id where m.kind in {CLASSY}),
mk as (select distinct target, key from (
  select id as target, id as key from mine union all select id, name from mine
  union all select target, id from mem union all select target, name from mem))"""


_OF_SYMBOL = f"""tg as (select * from s),
src as (select id as target, id as from_id from tg union
  select t.id, c.id from tg t join s c on c.parent_id = t.id where t.kind in {CLASSY} union
  select id, file_path || '::__module__::function' from tg)"""
_OF_FILE = "src as (select file_path as target, id as from_id from s union select file_path, file_path || '::__module__::function' from s)"


def _deps_sql(sources: str, depth: int) -> str:
    return f"""with recursive {BASE}, {FIRST}, {sources},
walk(target, to_id, kind, depth) as (
  select target, to_id, kind, 1 from src join e using (from_id)
  union
  select w.target, e.to_id, e.kind, w.depth + 1 from walk w join e on e.from_id = w.to_id where w.depth < {depth}
), least as (select target, to_id, kind, min(depth) as depth from walk w
  where not exists (select 1 from src where src.target = w.target and src.from_id = w.to_id) group by all),
named as (select target, {NAMED} as name, x.kind, depth, x.to_id, coalesce(n.file_path, f.file_path) as file_path
  from least x left join s n on n.id = x.to_id left join fs f on f.name = x.to_id)
select target, name, kind, depth, file_path, file_path is null as is_external from (
  select *, row_number() over (partition by target, name, kind order by depth, to_id) as r from named) where r = 1"""


_NAME_OF = "coalesce(n.name, nullif(string_split(from_id, '::')[2], ''), from_id)"
_REFS = f"""{_MATCH}, {TAILS},
rf as (select distinct target, from_id, to_id, ek.kind, ek.file_path, line from ek join mk using (key))"""
_FIRST20 = "select *, row_number() over (partition by target order by kind, file_path, line nulls first, from_id, to_id) as place, count(*) over (partition by target) as total"
_FLOW = f"""{_top_sql(10)}, f as (select id from s where kind in ('function', 'method')), c as (select distinct from_id, to_id from e where kind = 'calls' and from_id <> to_id),
behind(id) as (select id from top union select c.from_id from behind b join c on c.to_id = b.id),
walk(start_, node, path, n) as (
  select id, id, [id], 0 from f
  union all
  select w.start_, c.to_id, list_append(w.path, c.to_id), w.n + 1 from walk w join c on c.from_id = w.node
  where w.n < 10 and c.to_id in (select id from behind) and not list_contains(w.path, c.to_id)
), fl as (select * from (select start_, node, n, path, row_number() over (partition by start_, node order by n, path) as k from walk where n > 0 and node in (select id from top)) where k <= 5)"""


SQL = {
    "s03_languages": f"with {BASE} select {_LANG} as by_extension, language, count(distinct file_path) as n_files from s group by all",
    "s04_current_symbols": f"with {BASE} select id, name, kind, file_path, line_start, line_end, parent_id, language from s",
    "s05_current_edges": f"with {BASE} select * from e",
    "l01_find_symbol": f"with {BASE}, {FIRST} select name, id, file_path, n_symbols from fs",
    "l01_qualified": f"""with {BASE}, q as (select p.name || '.' || s.name as qualified, s.* from s join s p on p.id = s.parent_id)
select qualified, id, n_symbols from (select *, row_number() over (partition by qualified order by file_path, line_start, id) as r,
  count(*) over (partition by qualified) as n_symbols from q) where r = 1""",
    "l03_ambiguous": f"with {BASE} select name, count(*) as n_symbols, count(distinct file_path) as n_files, count(distinct kind) as n_kinds from s group by name having count(*) > 1",
    "l03_matching": f"with {BASE} select name, id, kind, file_path, line_start, row_number() over (partition by name order by file_path, line_start, id)::int as place from s",
    "l05_members": f"with {BASE} select parent_id, id, name, kind, signature, row_number() over (partition by parent_id order by line_start, id)::int as place from s where parent_id is not null",
    "l09_spellings": f"""with {BASE} select distinct to_id, contains(to_id, '/') or contains(to_id, '\\') or list_contains(['ts','tsx','js','jsx','cs','py','go','java','rs'], regexp_extract(to_id, '\\.([a-z]+)$', 1)) as is_path,
  case when contains(to_id, '::') then string_split(to_id, '::')[-2] end as parent from e""",
    "l17_method_lines": f"""with {BASE}, j as (select *, case when json_valid(metadata) then metadata::json end as m from s where kind in ('function', 'method') and signature is not null),
w as (select id, signature, list_filter([case when coalesce(m ->> 'access', m ->> 'visibility') not in ('public', '') then coalesce(m ->> 'access', m ->> 'visibility') end,
  case when m ->> 'is_async' = 'true' then 'async' end, case when m ->> 'is_static' = 'true' then 'static' end, case when m ->> 'is_abstract' = 'true' then 'abstract' end,
  case when m ->> 'is_virtual' = 'true' then 'virtual' end, case when m ->> 'is_override' = 'true' then 'override' end], lambda x: x is not null) as mods from j)
select id, array_to_string(mods, ' ') as modifiers, array_to_string(list_append(list_filter(mods, lambda x: not contains(signature, x)), signature), ' ') as shown from w""",
    "l18_enrichment": f"""with {BASE}, j as (select *, case when json_valid(metadata) then metadata::json end as m from s),
k as (select *, case language when 'java' then m -> 'annotations' when 'python' then m -> 'decorators' end as marks from j)
select id, case when language in ('java', 'python') then case when json_type(marks) = 'ARRAY' then coalesce(array_to_string(list_transform(
    list_filter(marks::json[], lambda x: json_type(x) = 'VARCHAR' and x ->> '$' <> ''), lambda x: '@' || (x ->> '$')), ' '), '') else '' end
  when language = 'go' and json_type(m -> 'receiver') = 'VARCHAR' and m ->> 'receiver' <> ''
    then '(' || lower(left(m ->> 'receiver', 1)) || ' ' || case when m ->> 'is_pointer_receiver' = 'true' then '*' else '' end || (m ->> 'receiver') || ')' else '' end as prefix,
  case when language = 'python' then case when starts_with(name, '__') and not ends_with(name, '__') then 'name_mangled' when starts_with(name, '_') then 'private' else 'public' end end as access,
  list_contains(case language when 'typescript' then ['constructor', 'toString', 'valueOf', 'render', 'default'] when 'csharp' then ['ToString', 'GetHashCode', 'Equals', 'Dispose', 'GetType', 'Main']
    when 'python' then ['__init__', '__str__', '__repr__', '__eq__', '__hash__', '__len__', '__iter__', '__next__'] when 'rust' then ['new', 'default', 'from', 'into', 'run', 'build', 'try_from', 'fmt', 'clone', 'drop']
    when 'go' then ['String', 'Error', 'Close', 'Read', 'Write', 'New', 'Init', 'Run'] when 'java' then ['toString', 'hashCode', 'equals', 'get', 'set', 'of', 'main', 'run', 'close'] else [] end, name) as is_general from k""",
    "l05_children": f"with {BASE} select parent_id, kind, count(*) as n_members, min(line_start) as first_line, max(line_end) as last_line from s where parent_id is not null group by all",
    "l06_file_outline": f"with {BASE} select file_path, count(*) as n_symbols, string_agg(kind || ' ' || name, '; ' order by line_start, line_end, id) as outline from s group by file_path",
    "l07_names_of_ids": f"with {BASE}, x as (select distinct to_id from e) select x.to_id, {NAMED} as to_id_name from x left join s n on n.id = x.to_id",
    "l08_caller_names": f"""with {BASE}, x as (select distinct from_id from e)
select from_id, case when n.name is not null then coalesce(p.name || '.', '') || n.name
  when string_split(from_id, '::')[2] = '__module__' then regexp_replace(string_split(string_split(from_id, '::')[1], '/')[-1], '(.)\\.[^.]*$', '\\1')
  when coalesce(string_split(from_id, '::')[2], '') <> '' then string_split(from_id, '::')[2] else from_id end as display_name
from x left join s n on n.id = x.from_id left join s p on p.id = n.parent_id""",
    "l10_path_classes": f"""with {BASE} select distinct replace(file_path, '\\', '/') as file_path, {_TEST} as is_test,
list_has_any(string_split(replace(file_path, '\\', '/'), '/'), ['node_modules', 'vendor', 'target', '.cargo', 'venv', 'site-packages', '.m2', 'third_party']) as is_vendor,
{_GROUP} as grp, {_DIR} as directory from s""",
    "l14_compact": f"with {BASE} select id, name, kind, signature, file_path, case when line_start = line_end then line_start::varchar else line_start || '-' || line_end end as lines from s",
    "a02_caller_counts": f"with {BASE}, {COUNTS} select id, n_callers::bigint as n_callers from cc",
    "a03_incoming_callers": f"""with {BASE}, k as (select from_id, to_id as name from e where kind = 'calls'
  union all select from_id, {TAIL} from e where kind = 'calls' and contains(to_id, '.')),
c as (select name, from_id, count(*) as n_edges from k where name in (select name from s) group by all)
select c.name, from_id, n_edges, case when n.name is not null then coalesce(p.name || '.', '') || n.name
  when string_split(from_id, '::')[2] = '__module__' then regexp_replace(string_split(string_split(from_id, '::')[1], '/')[-1], '(.)\\.[^.]*$', '\\1')
  when coalesce(string_split(from_id, '::')[2], '') <> '' then string_split(from_id, '::')[2] else from_id end as display_name
from c left join s n on n.id = c.from_id left join s p on p.id = n.parent_id""",
    "a04_outgoing_calls": f"with {BASE}, x as (select distinct from_id, to_id from e where kind = 'calls') select distinct from_id, {NAMED} as to_name from x left join s n on n.id = x.to_id",
    "a05_name_lists": f"""with {BASE}, c as (select from_id, to_id from e where kind = 'calls'),
o as (select from_id as id, array_to_string(list_sort(list(distinct name))[1:10], ' ') as callees from c join s on s.id = c.to_id group by from_id),
i as (select to_id as id, array_to_string(list_sort(list(distinct name))[1:10], ' ') as callers from c join s on s.id = c.from_id group by to_id)
select id, callees, callers from o full join i using (id)""",
    "a06_importance": f"with {BASE}, n as (select to_id, count(*) as n from e where kind = 'calls' group by to_id) select to_id, round(n / (select max(n) from n), 6) as score from n",
    "a07_core_symbols": f"""with {BASE}, {COUNTS} select s.id, name, kind, file_path, n_callers::bigint as n_callers from s join cc using (id)
where kind in ('function', 'method') order by n_callers desc, name, s.id limit 10""",
    "a08_directories": f"with {BASE} select {_DIR} as directory, count(distinct file_path) as n_files, count(*) as n_symbols from s group by all",
    "a10_totals": f"with {BASE} select (select count(*) from s) as n_symbols, (select count(distinct file_path) from s) as n_files, (select count(*) from e) as n_edges",
    "a13_fan_out": f"with {BASE} select from_id, count(*) as n_calls from e where kind = 'calls' group by from_id",
    "a16_language_stats": f"with {BASE} select language, count(distinct file_path) as n_files, count(*) as n_symbols from s group by language",
    "q01_refs": f"""with {BASE}, {_REFS}
select rf.*, {_NAME_OF} as from_name from rf left join s n on n.id = from_id""",
    "q01_refs_first": f"""with {BASE}, {_REFS} select target, place::int as place, from_id, to_id, kind, total from ({_FIRST20} from rf where kind in ('calls', 'instantiates')) where place <= 20""",
    "q03_file_refs": f"""with {BASE}, {TAILS}, fk as (select distinct file_path as target, unnest([id, name]) as key from s),
rf as (select distinct target, from_id, to_id, ek.kind, ek.file_path, line from ek join fk using (key))
select target, place::int as place, from_id, to_id, kind, line, total from ({_FIRST20} from rf) where place <= 20""",
    "q04_callers": f"""with {BASE}, {_REFS} select target, from_id, to_id, line, {_NAME_OF} as from_name from rf left join s n on n.id = from_id where rf.kind = 'calls'""",
    "q07_file_deps": _deps_sql(_OF_FILE, 1),
    "q01_refs_by_name": f"with {BASE}, {TAILS} select key as name, kind, count(*) as n_refs, count(distinct from_id) as n_holders from ek where key in (select name from s) group by all",
    "q05_deps": _deps_sql(_OF_SYMBOL, 1),
    "q06_transitive_deps": _deps_sql(_OF_SYMBOL, 3),
    "q08_impact": f"""with recursive {BASE}, {_MATCH}, {TAILS},
walk(target, id, depth) as (
  select target, from_id, 1 from ek join mk using (key) where from_id in (select id from s)
  union
  select w.target, e.from_id, w.depth + 1 from walk w join e on e.to_id = w.id join s n on n.id = e.from_id where w.depth < 3
), least as (select target, id, min(depth) as depth from walk w
  where not exists (select 1 from mk where mk.target = w.target and mk.key = w.id) group by all)
select target, id, name, file_path, kind, depth, {_TEST} as is_test,
  case depth when 1 then 'Direct callers' when 2 then 'Second-degree' when 3 then 'Third-degree' else 'Further impact' end as label from least join s using (id)""",
    "q09_entrypoints": f"""with {BASE}, k as (select to_id as key from e where kind = 'calls'
  union select {TAIL} from e where kind = 'calls' and contains(to_id, '.')),
free as (select * from s where kind in ('function', 'method', 'class') and not {_TEST}
  and not exists (select 1 from e where e.kind = 'calls' and e.to_id = s.id) and name not in (select key from k))
select id, name, kind, file_path, {_GROUP} as grp,
  case when kind = 'class' then (select count(*) from s c where c.parent_id = f.id) else 0 end as method_count,
  (select count(*) from e where e.kind = 'calls' and e.from_id = f.id) as outgoing_call_count
from free f where parent_id is null or parent_id not in (select id from free where kind = 'class')""",
    "q11_flow": f"""with recursive {BASE}, {_FLOW} select start_ as start, node as "end", n as n_steps, array_to_string(path, ' > ') as path from fl""",
    "q12_path_steps": f"""with recursive {BASE}, {_FLOW}, st as (select array_to_string(path, ' > ') as path, unnest(path) as id, unnest(range(len(path))) as step from fl)
select path, step::int as step, coalesce(name, string_split(st.id, '::')[2]) as name, coalesce(file_path, string_split(st.id, '::')[1]) as file_path, coalesce(line_start, 0) as line
from st left join s on s.id = st.id""",
    "q13_class_relationships": f"""with {BASE}, c as (select * from s where kind in {CLASSY}),
x as (
  select distinct c.id as class_id, e.kind as relation, e.to_id from c join e on e.from_id = c.id or e.from_id = c.file_path || '::__module__::class' where e.kind in ('extends', 'implements')
  union all
  select distinct i.class_id, 'depends', e.to_id from (select id as class_id, id from c union select c.id, m.id from c join s m on m.parent_id = c.id) i
  join e on e.from_id = i.id where e.kind not in ('extends', 'implements') and e.to_id <> i.class_id)
select distinct class_id, relation, {NAMED} as name from x left join s n on n.id = x.to_id""",
    "q14_implementors": f"with {BASE} select to_id as interface_id, from_id from e where kind = 'implements' and to_id in (select id from s)",
}
