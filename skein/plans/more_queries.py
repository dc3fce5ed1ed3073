"""Composite reports, search, incremental, workspace and action statistics: queries and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import behaviour as B
from skein.operators import graph as G
from skein.operators import incremental as I
from skein.operators import report as R
from skein.operators import search as S
from skein.operators import workspace as W
from skein.operators.graph import CodeGraph
from skein.plans.graph_queries import _DIR, _FIRST20, _GROUP, _NAME_OF, _REFS, _TEST, BASE, CLASSY, COUNTS, FIRST, TAILS
from skein.tables import table

QUERY = "retry invoice"


def f01_documents(spark: SparkSession, d: str) -> DataFrame:
    return S.document_texts(CodeGraph.read(spark, d)).select("id", F.sha2("body", 256).alias("body_hash"), F.length("body").alias("n_chars"))


def f02_name_parts(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("name")
    return CodeGraph.read(spark, d).symbols.select("name").distinct().select("name", X.camel_split(n).alias("camel"), X.snake_split(n).alias("snake"))


def f08_token_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = S.document_texts(CodeGraph.read(spark, d))
    return S.postings(docs, stems=False).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_docs"))


def f09_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of every symbol that holds one of two plain words."""
    docs = S.document_texts(CodeGraph.read(spark, d))
    return S.ranked(docs, [[w] for w in QUERY.split()], stems=False).select("id", F.round("rank", 6).alias("rank"))


def q22_find(spark: SparkSession, d: str) -> DataFrame:
    return S.find(CodeGraph.read(spark, d), QUERY, limit=10).withColumns({"rank": F.round("rank", 6), "score": F.round("score", 6)})


def q22_find_plain(spark: SparkSession, d: str) -> DataFrame:
    """As q22_find, with words as they stand."""
    out = S.find(CodeGraph.read(spark, d), QUERY, limit=10, stems=False)
    return out.select("id", "is_vendor", F.round("rank", 6).alias("rank"), F.round("score", 6).alias("score"))


def q21_similar(spark: SparkSession, d: str) -> DataFrame:
    g = CodeGraph.read(spark, d)
    name = G.core_symbols(g, 1).first()["name"]
    return S.similar(g, name).withColumns({"rank": F.round("rank", 6), "score": F.round("score", 6)})


def s08_latest_hashes(spark: SparkSession, d: str) -> DataFrame:
    return I.latest_hashes(table(spark, d, "file_hashes"))


def s06_without_files(spark: SparkSession, d: str) -> DataFrame:
    """The symbols that remain when the files that the last snapshot no longer has are taken out."""
    gone = i03_changed_files(spark, d).where("change = 'deleted'")
    return I.without_files(CodeGraph.read(spark, d), gone).symbols.select("id", "file_path")


def s05_replace_files(spark: SparkSession, d: str) -> DataFrame:
    """Edges after the test files' rows are replaced by their functions and methods only."""
    g = CodeGraph.read(spark, d)
    files = g.symbols.where(X.is_test_file(F.col("file_path"))).select("file_path").distinct()
    mine = g.edges.join(files, "file_path", "left_semi").where("kind = 'calls'")
    new = CodeGraph(g.symbols.join(files, "file_path", "left_semi").where("kind in ('function', 'method')"), mine)
    return I.replace_files(g, files, new).edges


def x10_content_hashes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return I.content_hashes(docs.withColumn("path", F.col("doc_id").cast("string")))


def i03_changed_files(spark: SparkSession, d: str) -> DataFrame:
    """First against last snapshot, paths and hashes taken as they stand, unknown ones included."""
    h = table(spark, d, "file_hashes").where("file_path is not null")
    ends = h.agg(F.min("snapshot_no").alias("lo"), F.max("snapshot_no").alias("hi")).first()
    one = lambda n: h.where(F.col("snapshot_no") == n).groupBy("file_path").agg(F.max("hash").alias("hash"))
    return I.changed_files(one(ends["lo"]), one(ends["hi"]))


def i04_stale_files(spark: SparkSession, d: str) -> DataFrame:
    """Files whose symbols were delivered after the file was last hashed, or have no symbols."""
    seen = table(spark, d, "symbols").groupBy("file_path").agg(F.max("indexed_at").alias("mtime"))
    return I.stale_files(seen, I.latest_hashes(table(spark, d, "file_hashes")))


def q15_sketch(spark: SparkSession, d: str) -> DataFrame:
    return R.class_sketches(CodeGraph.read(spark, d))


def q15_sketches(spark: SparkSession, d: str) -> DataFrame:
    """The sketch of every symbol, by its kind."""
    return R.sketches(CodeGraph.read(spark, d))


def q16_summary(spark: SparkSession, d: str) -> DataFrame:
    return R.symbol_summaries(CodeGraph.read(spark, d))


def q16_file_summary(spark: SparkSession, d: str) -> DataFrame:
    return R.file_summaries(CodeGraph.read(spark, d))


def q17_map(spark: SparkSession, d: str) -> DataFrame:
    return R.overview(CodeGraph.read(spark, d))


def q18_status(spark: SparkSession, d: str) -> DataFrame:
    """As of the last delivery, so that the age doesn't change with the clock."""
    now = table(spark, d, "symbols").select(F.max("indexed_at")).scalar()
    return R.status(CodeGraph.read(spark, d), I.latest_hashes(table(spark, d, "file_hashes")), now)


def q19_diff(spark: SparkSession, d: str) -> DataFrame:
    g = CodeGraph.read(spark, d)
    return R.changed_symbols(g, i03_changed_files(spark, d).where("change <> 'deleted'"))


def a15_refs_grouped(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 references to every symbol, by kind."""
    g = CodeGraph.read(spark, d)
    out = G.top_refs_of(*G.grouped_refs(g, G.match_names(g, g.symbols.select("id"))), 20)
    told = F.transform("refs", lambda r: F.concat_ws(" ", F.concat_ws(":", r["file_path"], r["line"]), r["from_name"], r["to_id"]))
    return out.select("target", "kind", "how", "shown", "total", F.array_join(told, "; ").alias("refs"))


def s10_snippets(spark: SparkSession, d: str) -> DataFrame:
    return R.snippets(CodeGraph.read(spark, d), table(spark, d, "documents"))


def s09_sources(spark: SparkSession, d: str) -> DataFrame:
    return R.sources(CodeGraph.read(spark, d), table(spark, d, "documents"))


def s15_json(spark: SparkSession, d: str) -> DataFrame:
    total = F.sum("n_members").over(Window.partitionBy("parent_id"))
    return R.json_rows("children", G.children(CodeGraph.read(spark, d)), "parent_id", total)


def w01_refs(spark: SparkSession, d: str) -> DataFrame:
    g = CodeGraph.read(spark, d)
    return W.refs(g, G.core_symbols(g, 1).first()["name"], 20)


def w02_find(spark: SparkSession, d: str) -> DataFrame:
    out = S.find_in_projects(CodeGraph.read(spark, d), QUERY, 10)
    return out.withColumns({"rank": F.round("rank", 6), "score": F.round("score", 6)})


def w02_find_plain(spark: SparkSession, d: str) -> DataFrame:
    """As w02_find, with words as they stand."""
    out = S.find_in_projects(CodeGraph.read(spark, d), QUERY, 10, stems=False)
    return out.select("project", "id", F.round("rank", 6).alias("rank"), F.round("score", 6).alias("score"))


def w06_find_symbols(spark: SparkSession, d: str) -> DataFrame:
    return W.find_symbols(CodeGraph.read(spark, d))


def w06_languages(spark: SparkSession, d: str) -> DataFrame:
    return W.languages(CodeGraph.read(spark, d))


def w05_totals(spark: SparkSession, d: str) -> DataFrame:
    return W.totals(w05_status(spark, d))


def w03_entrypoints(spark: SparkSession, d: str) -> DataFrame:
    return W.entrypoint_groups(CodeGraph.read(spark, d))


def w04_core(spark: SparkSession, d: str) -> DataFrame:
    return W.core_symbols(CodeGraph.read(spark, d), 10)


def w04_directories(spark: SparkSession, d: str) -> DataFrame:
    return W.directories(CodeGraph.read(spark, d))


def w05_status(spark: SparkSession, d: str) -> DataFrame:
    return W.status(CodeGraph.read(spark, d), I.latest_hashes(table(spark, d, "file_hashes")))


def _actions(spark: SparkSession, d: str) -> DataFrame:
    """events as the actions of runs, one run per user."""
    e = table(spark, d, "events")
    tool = F.create_map(*[F.lit(x) for p in (("view", "Read"), ("click", "Grep"), ("purchase", "Edit"), ("signup", "Write"), ("error", "Bash")) for x in p])
    seq = F.row_number().over(B.Window.partitionBy("user_id").orderBy("ts", "event_id"))
    a = e.select(F.col("user_id").alias("run"), seq.alias("seq"), tool[F.col("event_type")].alias("tool"), F.floor(F.col("value") / 10).cast("string").alias("argument"))
    return a.withColumns({"is_edit": F.col("tool").isin("Edit", "Write"), "is_look": F.col("tool").isin("Read", "Grep", "Bash")})


def h03_run_summary(spark: SparkSession, d: str) -> DataFrame:
    return B.run_summary(_actions(spark, d)).withColumn("looks_per_edit", F.round("looks_per_edit", 6))


def h06_before_first(spark: SparkSession, d: str) -> DataFrame:
    return B.before_first(_actions(spark, d), F.col("tool") == "Bash", F.col("is_edit"))


def h07_followed_within(spark: SparkSession, d: str) -> DataFrame:
    return B.followed_within(_actions(spark, d), F.col("tool") == "Bash", F.col("tool") == "Grep", 3)


def h08_followed_until(spark: SparkSession, d: str) -> DataFrame:
    return B.followed_until(_actions(spark, d), F.col("tool") == "Bash", F.col("tool") == "Read", F.col("is_edit"))


def h09_same_argument(spark: SparkSession, d: str) -> DataFrame:
    return B.same_argument(_actions(spark, d), "Read", "Grep")


def h10_sequences(spark: SparkSession, d: str) -> DataFrame:
    return B.sequences(_actions(spark, d))


def h11_condition_report(spark: SparkSession, d: str) -> DataFrame:
    return B.condition_report(B.run_summary(_actions(spark, d)), F.col("run") % 3)


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Runs with what came of them: whether the last action was no error, and how much of what was read was read once."""
    runs = B.run_summary(_actions(spark, d))
    seen = F.when(F.col("n_reads") > 0, F.col("n_read_once") / F.col("n_reads"))
    return runs.select(
        "run", (F.col("run") % 3).alias("condition"), (F.col("run") % 2).alias("category"), (F.col("n_edits") > 0).alias("passed"),
        B.score(F.col("n_edits") > 0, F.col("n_looks") > 1, seen).alias("score"), F.col("n_actions").alias("size"),
    )


def h15_scores(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d).select("run", "score")


def h16_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return B.outcome_report(_outcomes(spark, d), ["condition", "category"])


def h12_recommendations(spark: SparkSession, d: str) -> DataFrame:
    runs = _actions(spark, d)
    followed = B.followed_until(runs, F.col("tool") == "Bash", F.col("tool") == "Read", F.col("is_edit"))
    within = B.followed_within(runs, F.col("tool") == "Bash", F.col("tool") == "Grep", 3).withColumnRenamed("n_followed", "n_within")
    sums = followed.join(within, "run").groupBy((F.col("run") % 3).alias("condition")).agg(F.sum("n_followed").alias("n_followed"), F.sum("n_within").alias("n_within"))
    return B.recommendations(B.condition_report(B.run_summary(runs), F.col("run") % 3), sums)


def h17_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Contents of the documents' files against the hashes of the last snapshot: missing, extra or changed."""
    h = table(spark, d, "file_hashes").where("file_path is not null")
    last = h.where(F.col("snapshot_no") == h.select(F.max("snapshot_no")).scalar()).groupBy("file_path").agg(F.max("hash").alias("hash"))
    texts = R.latest_texts(table(spark, d, "documents"))
    return I.changed_files(last, I.content_hashes(texts, "file_path")).replace({"added": "extra", "deleted": "missing", "modified": "changed"}, subset="change")


def h14_near_lines(spark: SparkSession, d: str) -> DataFrame:
    """Edges with a line, and whether a symbol of their file begins within five lines."""
    g = CodeGraph.read(spark, d)
    points = g.edges.where("line is not null").select("from_id", "to_id", "kind", "file_path", "line")
    return B.near_lines(points, g.symbols.select("file_path", F.col("line_start").alias("line")))


QUERIES = {
    f.__name__: f
    for f in (
        s05_replace_files, s06_without_files, s08_latest_hashes, s09_sources, s10_snippets, s15_json, x10_content_hashes, f01_documents, f02_name_parts, f08_token_counts,
        f09_ranks, q15_sketch, q15_sketches, q16_summary, q16_file_summary, q17_map, q18_status, q19_diff, q21_similar, q22_find, q22_find_plain, a15_refs_grouped, i03_changed_files, i04_stale_files,
        w01_refs, w02_find, w02_find_plain, w05_totals, w06_find_symbols, w06_languages, w03_entrypoints, w04_core, w04_directories, w05_status, h03_run_summary, h06_before_first, h07_followed_within, h08_followed_until, h09_same_argument,
        h10_sequences, h11_condition_report, h12_recommendations, h14_near_lines, h15_scores, h16_outcomes, h17_manifest,
    )
}

_LATEST = "lh as (select file_path, hash, indexed_at from (select *, row_number() over (partition by file_path order by indexed_at desc nulls last, snapshot_no desc nulls last, hash desc nulls last) as r from file_hashes where file_path is not null) where r = 1)"
_ENDS = """h as (select file_path, snapshot_no, max(hash) as hash from file_hashes where file_path is not null group by all),
o as (select * from h where snapshot_no = (select min(snapshot_no) from h)), n as (select * from h where snapshot_no = (select max(snapshot_no) from h)),
ch as (select case when o.file_path is null then 'added' when n.file_path is null then 'deleted' else 'modified' end as change, coalesce(n.file_path, o.file_path) as file_path
  from o full join n on o.file_path = n.file_path where o.file_path is null or n.file_path is null or o.hash is distinct from n.hash)"""
_SPLIT = r"regexp_replace(regexp_replace(%s, '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g'), '(\p{Ll})(\p{Lu})', '\1 \2', 'g')"
_DOCS = rf"""c as (select from_id, to_id from e where kind = 'calls'),
nl as (select from_id, array_to_string(list_sort(list(distinct name))[1:10], ' ') as callees from c join s on s.id = c.to_id group by from_id),
nr as (select to_id, array_to_string(list_sort(list(distinct name))[1:10], ' ') as callers from c join s on s.id = c.from_id group by to_id),
nc as (select to_id, count(*) as n from c group by to_id), im as (select to_id, n / (select max(n) from nc) as score from nc),
gn as (select unnest(['typescript', 'csharp', 'python', 'rust', 'go', 'java']) as language, unnest([['constructor', 'toString', 'valueOf', 'render', 'default'],
  ['ToString', 'GetHashCode', 'Equals', 'Dispose', 'GetType', 'Main'], ['__init__', '__str__', '__repr__', '__eq__', '__hash__', '__len__', '__iter__', '__next__'],
  ['new', 'default', 'from', 'into', 'run', 'build', 'try_from', 'fmt', 'clone', 'drop'], ['String', 'Error', 'Close', 'Read', 'Write', 'New', 'Init', 'Run'],
  ['toString', 'hashCode', 'equals', 'get', 'set', 'of', 'main', 'run', 'close']]) as names),
dd as (select s.id, s.name, s.kind, s.file_path, concat_ws(' | ', s.kind || ' ' || s.name, nullif({_SPLIT % "s.name"}, s.name), nullif(replace(s.name, '_', ' '), s.name),
  s.signature, s.docstring, 'in ' || p.name, 'in ' || nullif({_SPLIT % "p.name"}, p.name),
  case when len(fl) > 0 then 'path ' || array_to_string(fl, ' ') end, 'called-by ' || nr.callers, 'calls ' || nl.callees,
  case when not coalesce(list_contains(gn.names, s.name), false) then case when score > 0.7 then 'importance high core' when score > 0.3 then 'importance medium' end end) as body
  from (select *, list_filter(string_split(file_path, '/'), lambda q: q <> 'src' and not contains(q, '.')) as fl from s) s
  left join s p on p.id = s.parent_id left join nl on nl.from_id = s.id left join nr on nr.to_id = s.id left join im on im.to_id = s.id left join gn on gn.language = s.language)"""
_TOKENS = r"""tk as (select id, field, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(t), '\p{M}+', '', 'g'), '[^\p{L}\p{N}]+'), lambda w: w <> '')) as token
  from (select id, 'name' as field, name as t from dd union all select id, 'body', body from dd))"""
_RANKS = f"""q as (select unnest(['{QUERY.split()[0]}', '{QUERY.split()[1]}']) as w), pr as (select id, %s as project, file_path from dd),
f as (select project, tk.id, w, sum(case field when 'name' then 5.0 else 10.0 end) as f from tk join q on starts_with(token, w) join pr on pr.id = tk.id group by all),
df as (select project, w, count(*) as df from f group by all), ln as (select tk.id, project, count(*) as len from tk join pr using (id) group by all),
nn as (select project, count(*) as n, sum(coalesce(len, 0)) as t from pr left join ln using (id, project) group by project),
rk as (select f.project, f.id, -sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / (t / n)))) as rank
  from f join df on df.project = f.project and df.w = f.w join ln on ln.id = f.id join nn on nn.project = f.project group by all),
tp as (select * from (select rk.*, pr.file_path, row_number() over (partition by rk.project order by rank, rk.id) as k from rk join pr on pr.id = rk.id) where k <= 10),
sc as (select *, case when max(rank) over (partition by project) - min(rank) over (partition by project) < 1e-9 then 0.95
  else 1 - 0.5 * (rank - min(rank) over (partition by project)) / (max(rank) over (partition by project) - min(rank) over (partition by project)) end as score from tp)"""
_NAMED_AS = "coalesce(%s.name, nullif(string_split(%s, '::')[2], ''), e.to_id)"
_SHOWN = """case when n.name is not null then coalesce(p.name || '.', '') || n.name
  when string_split(from_id, '::')[2] = '__module__' then regexp_replace(string_split(string_split(from_id, '::')[1], '/')[-1], '(.)\\.[^.]*$', '\\1')
  when coalesce(string_split(from_id, '::')[2], '') <> '' then string_split(from_id, '::')[2] else from_id end"""
_COLUMNS_OF_CLASS = f"""cl as (select * from s where kind in {CLASSY}),
rx as (
  select distinct c.id as class_id, e.kind as relation, e.to_id from cl c join e on e.from_id = c.id or e.from_id = c.file_path || '::__module__::class' where e.kind in ('extends', 'implements')
  union all
  select distinct i.class_id, 'depends', e.to_id from (select id as class_id, id from cl union select c.id, m.id from cl c join s m on m.parent_id = c.id) i
  join e on e.from_id = i.id where e.kind not in ('extends', 'implements') and e.to_id <> i.class_id),
rel as (select distinct class_id, relation, {_NAMED_AS % ("n", "e.to_id")} as name from rx e left join s n on n.id = e.to_id)"""
_CASES = "case event_type when 'view' then 'Read' when 'click' then 'Grep' when 'purchase' then 'Edit' when 'signup' then 'Write' when 'error' then 'Bash' end"
_ACTS = f"""a as (select user_id as run, row_number() over (partition by user_id order by ts, event_id) as seq, {_CASES} as tool, cast(cast(floor(value / 10) as bigint) as varchar) as argument from events),
x as (select *, tool in ('Edit', 'Write') as is_edit, tool in ('Read', 'Grep', 'Bash') as is_look from a)"""
_RUNS = """rs as (select run, count(*) as n_actions, count(*) filter (is_edit) as n_edits, count(*) filter (is_look) as n_looks, count(*) filter (tool = 'Read') as n_reads,
  count(distinct case when tool = 'Read' then argument end) as n_read_once, min(case when is_edit then seq end) as f from x group by run)"""
_FREE = f"""ck_ as (select to_id as key from e where kind = 'calls' union select regexp_extract(to_id, '\\.([^.]*)$', 1) from e where kind = 'calls' and contains(to_id, '.')),
free as (select * from s where kind in ('function', 'method', 'class') and not {_TEST}
  and not exists (select 1 from e where e.kind = 'calls' and e.to_id = s.id) and name not in (select key from ck_)),
ep as (select * from free where parent_id is null or parent_id not in (select id from free where kind = 'class'))"""
_PROJECT = "string_split(replace(file_path, '\\', '/'), '/')[1]"
_INNER = "regexp_replace(file_path, '^[^/]*/', '')"
_LT = """lt as (select path as file_path, text from (select *, row_number() over (partition by path order by created_at desc nulls last, doc_id desc) as r from documents where path is not null and text is not null) where r = 1)"""
_LINES = f"""{_LT}, ln_ as (select file_path, regexp_split_to_array(text, '\\r\\n|\\n|\\r') as lines from lt)"""
_FOLLOWED = """pt as (select *, coalesce(sum(is_edit::int) over (partition by run order by seq rows between unbounded preceding and 1 preceding), 0) as part from x),
fo as (select r.run, count(distinct p.seq) as n_followed from (select distinct run from x) r left join (
  select a.run, a.seq from pt a join pt b on a.run = b.run and a.part = b.part and b.seq > a.seq and b.argument = a.argument and a.tool = 'Bash' and b.tool = 'Read') p on p.run = r.run group by r.run)"""
_SCORED = """so as (select *, case when n_reads = 0 then case when n_edits > 0 then 50 else 0 end + case when n_looks > 1 then 50 else 0 end
  else case when n_edits > 0 then 40 else 0 end + case when n_looks > 1 then 40 else 0 end
    + case when n_read_once / n_reads >= 0.8 then 20 else floor(n_read_once / n_reads / 0.8 * 20)::int end end as score from rs)"""

SQL = {
    "s08_latest_hashes": f"with {_LATEST} select * from lh",
    "s06_without_files": f"""with {BASE}, {_ENDS}, g as (select file_path from ch where change = 'deleted'),
k as (select * from s where file_path not in (select file_path from g))
select id, file_path from k where parent_id is null or parent_id not in (select id from s where file_path in (select file_path from g))""",
    "s05_replace_files": f"with {BASE} select * from e where file_path not in (select file_path from s where {_TEST}) or kind = 'calls'",
    "x10_content_hashes": "select doc_id::varchar as file_path, sha256(text) as hash from documents where text is not null",
    "f01_documents": f"with {BASE}, {_DOCS} select id, sha256(body) as body_hash, length(body)::int as n_chars from dd",
    "f02_name_parts": f"with {BASE} select distinct name, {_SPLIT % 'name'} as camel, replace(name, '_', ' ') as snake from s",
    "f08_token_counts": f"with {BASE}, {_DOCS}, {_TOKENS} select token, count(*) as n, count(distinct id) as n_docs from tk group by token",
    "f09_ranks": f"""with {BASE}, {_DOCS}, {_TOKENS}, q as (select unnest(['{QUERY.split()[0]}', '{QUERY.split()[1]}']) as w),
f as (select id, w, sum(case field when 'name' then 5.0 else 10.0 end) as f from tk join q on starts_with(token, w) group by all),
df as (select w, count(*) as df from f group by w), ln as (select id, count(*) as len from tk group by id),
nn as (select (select count(*) from dd) as n, (select count(*) from tk) as t)
select id, round(-sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / (t / n)))), 6) as rank
from f join df using (w) join ln using (id), nn group by id""",
    "i03_changed_files": f"with {_ENDS} select * from ch",
    "i04_stale_files": f"""with {_LATEST}, m as (select file_path, max(indexed_at) as mtime from symbols group by file_path)
select lh.file_path, case when mtime is null then 'gone' else 'newer' end as why from lh left join m on m.file_path = lh.file_path where mtime is null or mtime > lh.indexed_at""",
    "q15_sketch": f"""with {BASE}, {COUNTS} select p.id as class_id, p.name as class_name, c.kind, c.id, c.name, c.signature, c.line_start, coalesce(n_callers, 0)::bigint as n_callers
from s p join s c on c.parent_id = p.id left join cc on cc.id = c.id where p.kind in ('class', 'struct', 'interface', 'enum')""",
    "q15_sketches": f"""with {BASE}, {COUNTS}, {_COLUMNS_OF_CLASS}, nx as (select e.*, {_NAMED_AS % ("n", "e.to_id")} as to_name from e left join s n on n.id = e.to_id where e.kind = 'calls'),
cm as (select id, name from s where kind in ('function', 'method')),
ky as (select from_id, to_id as key from e where kind = 'calls' union all select from_id, regexp_extract(to_id, '\\.([^.]*)$', 1) from e where kind = 'calls' and contains(to_id, '.')),
by_ as (select cm.id, from_id, count(*) as n from cm join ky on ky.key = cm.id or ky.key = cm.name group by all)
select p.id, 'member' as section, c.id as item, coalesce(n_callers, 0)::bigint as n from s p join s c on c.parent_id = p.id left join cc on cc.id = c.id where p.kind in ('class', 'struct', 'interface')
union all select p.id, 'variant', c.id, null from s p join s c on c.parent_id = p.id where p.kind = 'enum' and c.kind = 'variant'
union all select class_id, relation, name, null from rel where class_id in (select id from s where kind in ('class', 'struct'))
union all select distinct from_id, 'calls', to_name, null from nx where from_id in (select id from cm)
union all select b.id, 'called_by', {_SHOWN}, sum(b.n)::bigint from by_ b left join s n on n.id = b.from_id left join s p on p.id = n.parent_id group by 1, 2, 3
union all select to_id, 'implementor', from_id, null from e where kind = 'implements' and to_id in (select id from s where kind = 'interface')
union all select s.id, 'callers', 'callers', coalesce(n_callers, 0)::bigint from s left join cc on cc.id = s.id where s.kind = 'enum'""",
    "q16_summary": f"""with {BASE}, {COUNTS}, {FIRST}, tg as (select * from s where kind in {CLASSY}),
src as (select id as target, id as from_id from tg union select t.id, c.id from tg t join s c on c.parent_id = t.id union select id, file_path || '::__module__::function' from tg),
dp as (select distinct src.target, e.kind, {_NAMED_AS % ("n", "e.to_id")} as name from src join e on e.from_id = src.from_id left join s n on n.id = e.to_id
  where not exists (select 1 from src o where o.target = src.target and o.from_id = e.to_id)),
nd as (select target as id, count(*) as n from dp group by 1 union all
  select from_id, count(distinct {_NAMED_AS % ("n", "e.to_id")}) from e left join s n on n.id = e.to_id where e.kind = 'calls' and from_id in (select id from s where kind not in {CLASSY}) group by 1),
ch as (select parent_id, count(*) filter (kind <> 'property') as n_methods, count(*) filter (kind = 'property') as n_fields from s where parent_id is not null group by 1)
select s.id, coalesce(n_callers, 0)::bigint as n_callers, coalesce(nd.n, 0) as n_deps, coalesce(n_methods, 0) as n_methods, coalesce(n_fields, 0) as n_fields
from s left join cc on cc.id = s.id left join ch on ch.parent_id = s.id left join nd on nd.id = s.id""",
    "q16_file_summary": f"""with {BASE} select file_path, count(*) as n_symbols,
coalesce(string_agg(kind || ' ' || name, '; ' order by line_start, id) filter (parent_id is null), '') as top_level from s group by file_path""",
    "q17_map": f"""with {BASE}, {COUNTS}, top as (select name, id, n_callers from s join cc using (id) where kind in ('function', 'method') order by n_callers desc, name, id limit 10), {_FREE}
select 'core' as section, id as item, n_callers::bigint as n from top
union all select 'entrypoints', {_GROUP}, count(*) from ep group by 2
union all select 'directory', {_DIR}, count(*) from s group by 2
union all select 'language', language, count(*) from s group by 2
union all select 'total', 'symbols', count(*) from s union all select 'total', 'edges', count(*) from e union all select 'total', 'files', count(distinct file_path) from s""",
    "q18_status": f"""with {BASE}, {_LATEST}, x as (select (select max(indexed_at) from lh) as l, (select max(indexed_at) from symbols) - (select max(indexed_at) from lh) as d)
select (select count(*) from s) as n_symbols, (select count(distinct file_path) from s) as n_files, (select count(*) from e) as n_edges, l as last_indexed_at,
case when d < 60 then 'just now' when d < 3600 then d // 60 || ' min ago' when d < 86400 then d // 3600 || ' h ago' else d // 86400 || ' d ago' end as age,
case when (select count(*) from s) = 0 then 'empty' else 'up to date' end as state from x""",
    "q19_diff": f"with {BASE}, {_ENDS} select s.id, s.name, s.kind, s.file_path, line_start, line_end, signature, change from ch join s using (file_path) where change <> 'deleted'",
    "w03_entrypoints": f"""with {BASE}, k as (select to_id as key from e where kind = 'calls' union select regexp_extract(to_id, '\\.([^.]*)$', 1) from e where kind = 'calls' and contains(to_id, '.')),
free as (select * from s where kind in ('function', 'method', 'class') and not {_TEST}
  and not exists (select 1 from e where e.kind = 'calls' and e.to_id = s.id) and name not in (select key from k))
select {_PROJECT} || ' — ' || {_GROUP} as label, count(*) as n_entrypoints, count(distinct file_path) as n_files
from free where parent_id is null or parent_id not in (select id from free where kind = 'class') group by 1""",
    "w01_refs": f"""with {BASE}, {COUNTS}, {TAILS}, tn as (select name from s join cc using (id) where kind in ('function', 'method') order by n_callers desc, name, s.id limit 1),
r as (select *, row_number() over (partition by {_PROJECT} order by kind, file_path, line nulls first, from_id, to_id) as rn from ek
  where key = (select name from tn) and {_PROJECT} in (select {_PROJECT} from s where name = (select name from tn)))
select from_id, to_id, r.kind, r.file_path, line, {_PROJECT.replace("file_path", "r.file_path")} as project, coalesce(n.name, nullif(string_split(from_id, '::')[2], ''), from_id) as from_name
from r left join s n on n.id = from_id where rn <= 40 order by r.kind, from_name, project, r.file_path, line nulls first, to_id, from_id limit 20""",
    "w02_find_plain": f"""with {BASE}, {_DOCS}, {_TOKENS}, {_RANKS % "string_split(replace(file_path, '\\', '/'), '/')[1]"} select project, id, round(rank, 6) as rank, round(score, 6) as score from sc order by sc.score desc, project, sc.rank, id limit 10""",
    "w05_totals": f"""with {BASE}, {_LATEST}, a as (select {_PROJECT} as project, count(distinct file_path) as n_files, count(*) as n_symbols from s group by 1),
b as (select {_PROJECT} as project, count(*) as n_edges from e group by 1), c as (select {_PROJECT} as project, max(indexed_at) as last_indexed_at from lh group by 1)
select count(*) as n_projects, sum(n_files)::bigint as n_files, sum(n_symbols)::bigint as n_symbols, sum(n_edges)::bigint as n_edges, max(last_indexed_at) as last_indexed_at,
  bool_and(coalesce(n_symbols, 0) > 0) as all_indexed from a full join b using (project) full join c using (project)""",
    "w06_find_symbols": f"""with {BASE}, p as (select *, {_PROJECT} as project from s) select project, name, id, n_symbols from (
  select *, row_number() over (partition by project, name order by parent_id is not null, file_path, line_start, id) as r, count(*) over (partition by project, name) as n_symbols from p) where r = 1""",
    "w06_languages": f"with {BASE} select language, count(distinct {_PROJECT}) as n_projects, count(distinct file_path) as n_files from s group by language",
    "q22_find_plain": f"""with {BASE}, {_DOCS}, {_TOKENS}, {_RANKS % "''"} select id,
  list_has_any(string_split(replace(file_path, '\\', '/'), '/'), ['node_modules', 'vendor', 'target', '.cargo', 'venv', 'site-packages', '.m2', 'third_party']) as is_vendor,
  round(rank, 6) as rank, round(score, 6) as score from sc""",
    "a15_refs_grouped": f"""with {BASE}, {_REFS}, ft as (select * from ({_FIRST20} from rf) where place <= 20),
g as (select target, ft.kind, count(*) as shown, string_agg(concat_ws(' ', concat_ws(':', ft.file_path, ft.line), {_NAME_OF}, to_id), '; ' order by place) as refs from ft left join s n on n.id = from_id group by all),
t as (select target, kind, count(*) as total from rf group by all)
select target, kind, case kind when 'calls' then 'called' when 'imports' then 'imported' when 'extends' then 'extended' when 'implements' then 'implemented' when 'instantiates' then 'instantiated'
  when 'references' then 'referenced' else 'used as type' end as how, shown, total, refs from g join t using (target, kind)""",
    "s15_json": f"""with {BASE}, x as (select parent_id, kind, count(*) as n_members, min(line_start) as first_line, max(line_end) as last_line from s where parent_id is not null group by all)
select to_json({{'command': 'children', 'symbol': parent_id, 'data': {{'kind': kind, 'n_members': n_members, 'first_line': first_line, 'last_line': last_line}}, 'truncated': false, 'total': sum(n_members) over (partition by parent_id)::bigint}})::varchar as value from x""",
    "s09_sources": f"""with {BASE}, {_LINES} select id, array_to_string(lines[line_start:least(line_end, len(lines))], chr(10)) as source from s join ln_ using (file_path) where line_start between 1 and len(lines) and line_start <= line_end""",
    "s10_snippets": f"""with {BASE}, {_LINES} select from_id, to_id, kind, file_path, line, case when line between 1 and len(lines) then rtrim(lines[line], ' ') end as context,
  case when line between 1 and len(lines) then array_to_string(lines[greatest(line - 1, 1):least(line + 1, len(lines))], chr(10)) end as snippet from e left join ln_ using (file_path)""",
    "h12_recommendations": f"""with {_ACTS}, {_RUNS}, {_FOLLOWED}, wi as (select run, tool = 'Bash' and coalesce(max((tool = 'Grep')::int) over (partition by run order by seq rows between 1 following and 3 following), 0) = 1 as f from x),
z as (select run % 3 as condition, avg(n_actions) as a, round(avg(coalesce(f - 1, n_actions)), 6) as b from rs group by 1),
y as (select run % 3 as condition, sum(n_followed) as n from fo group by 1), w as (select run % 3 as condition, count(*) filter (f) as n from wi group by 1)
select z.condition, unnest(list_filter([case when y.n > 0 then 'followed' end, case when w.n > 0 then 'searched' end, case when a > 5 then 'many actions' end,
  case when b > (select b from z where condition = 0) then 'late edits' end], lambda q: q is not null)) as advice from z join y using (condition) join w using (condition)""",
    "h15_scores": f"with {_ACTS}, {_RUNS}, {_SCORED} select run, score from so",
    "h16_outcomes": f"""with {_ACTS}, {_RUNS}, {_SCORED}, g as (select run % 3 as condition, run % 2 as category, count(*) as n_runs, round(avg((n_edits > 0)::int) * 100, 6) as pct_passed, round(avg(score), 6) as mean_score,
  round(coalesce(stddev_samp(score), 0), 6) as sd_score, avg(n_actions) as m from so group by all)
select condition, category, n_runs, pct_passed, mean_score, sd_score, round(m, 6) as mean_size, round((1 - m / (select max(m) from g)) * 100, 6) as pct_smaller from g""",
    "h17_manifest": f"""with {_LT}, n as (select file_path, sha256(text) as hash from lt), o as (select file_path, max(hash) as hash from file_hashes where file_path is not null and snapshot_no = (select max(snapshot_no) from file_hashes where file_path is not null) group by 1)
select case when o.file_path is null then 'extra' when n.file_path is null then 'missing' else 'changed' end as change, coalesce(n.file_path, o.file_path) as file_path
from o full join n on o.file_path = n.file_path where o.file_path is null or n.file_path is null or o.hash is distinct from n.hash""",
    "w04_core": f"""with {BASE}, {COUNTS} select * from (select id, name, n_callers::bigint as n_callers, {_PROJECT} as project,
row_number() over (partition by {_PROJECT} order by n_callers desc, name, id)::int as place from s join cc using (id) where kind in ('function', 'method')) where place <= 10""",
    "w04_directories": f"with {BASE} select {_PROJECT} || '/' || {_DIR.replace('file_path', _INNER)} as directory, count(distinct file_path) as n_files, count(*) as n_symbols from s group by 1",
    "w05_status": f"""with {BASE}, {_LATEST}, a as (select {_PROJECT} as project, count(distinct file_path) as n_files, count(*) as n_symbols from s group by 1),
b as (select {_PROJECT} as project, count(*) as n_edges from e group by 1), c as (select {_PROJECT} as project, max(indexed_at) as last_indexed_at from lh group by 1)
select project, coalesce(n_files, 0) as n_files, coalesce(n_symbols, 0) as n_symbols, coalesce(n_edges, 0) as n_edges, last_indexed_at,
case when coalesce(n_symbols, 0) = 0 then 'empty' else 'up to date' end as state from a full join b using (project) full join c using (project)""",
    "h03_run_summary": f"""with {_ACTS}, {_RUNS} select run, n_actions, n_edits, n_looks, n_reads, n_read_once, n_reads - n_read_once as n_read_again,
case when n_edits = 0 then 'inf'::double else round(n_looks / n_edits, 6) end as looks_per_edit, coalesce(f - 1, n_actions) as before_edit from rs""",
    "h06_before_first": f"with {_ACTS}, y as (select *, min(case when is_edit then seq end) over (partition by run) as f from x) select run, count(*) filter (tool = 'Bash' and coalesce(seq < f, true)) as n_before from y group by run",
    "h07_followed_within": f"""with {_ACTS}, y as (select run, tool = 'Bash' and coalesce(max((tool = 'Grep')::int) over (partition by run order by seq rows between 1 following and 3 following), 0) = 1 as f from x)
select run, count(*) filter (f) as n_followed from y group by run""",
    "h08_followed_until": f"with {_ACTS}, {_FOLLOWED} select run, n_followed from fo",
    "h09_same_argument": f"with {_ACTS}, y as (select run, argument, count(distinct tool) as n from x where tool in ('Read', 'Grep') group by all) select run, max(n) = 2 as \"both\" from y group by run",
    "h10_sequences": f"with {_ACTS} select run, string_agg(tool, '>' order by seq) as tools from x group by run",
    "h11_condition_report": f"""with {_ACTS}, {_RUNS}, z as (select run % 3 as condition, n_actions, coalesce(f - 1, n_actions) as before_edit, case when n_edits = 0 then null else n_looks / n_edits end as r from rs)
select condition, count(*) as n_runs, round(avg(n_actions), 6) as mean_actions, round(coalesce(stddev_samp(n_actions), 0), 6) as sd_actions, round(avg(before_edit), 6) as mean_before_edit,
round(avg(coalesce(r, (select coalesce(max(r), 0) from z))), 6) as mean_looks_per_edit from z group by condition""",
    "h14_near_lines": f"""with {BASE} select from_id, to_id, kind, file_path, line, exists (select 1 from s where s.file_path = e.file_path and abs(s.line_start - e.line) <= 5) as covered from e where line is not null""",
}
