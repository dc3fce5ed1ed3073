"""Queries of the general problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.operators import hierarchy as H
from skein.operators import hot_groups as G
from skein.operators import nested as N
from skein.operators import orphans as O
from skein.operators import snapshots as S
from skein.tables import current_symbols, table


def _summary(spark: SparkSession, d: str) -> DataFrame:
    return G.keyed_summary(table(spark, d, "edges"), ["to_id", "kind"], "from_id", "indexed_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    total = table(spark, d, "edges").count()
    return G.heavy_groups(_summary(spark, d), total).select("to_id", "kind")


def _triples(spark: SparkSession, d: str, values: bool = True) -> DataFrame:
    return N.nested_triples(current_symbols(table(spark, d, "symbols"), ["metadata"]), values=values)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return N.nodes(_triples(spark, d, values=False)).select("id", "node_path", "parent_path")


#: Array fields and fields of the pivoted tables of problem 2; p2_remaining has what they leave.
PIVOTED = {
    "p2_parameters": (["parameters", "params"], ["name", "type", "optional", "has_default", "is_mutable", "is_final"]),
    "p2_types": (["type_args", "type_params", "bounds", "throws"], ["name", "origin.module"]),
    "p2_annotations": (["annotations", "decorators", "attributes"], ["name"]),
    "p2_arguments": (["args"], ["key", "value"]),
}


def p2_parameters(spark: SparkSession, d: str) -> DataFrame:
    return N.pivot_table(_triples(spark, d), *PIVOTED["p2_parameters"], elements=True)


def p2_types(spark: SparkSession, d: str) -> DataFrame:
    return N.pivot_table(_triples(spark, d), *PIVOTED["p2_types"], elements=True)


def p2_annotations(spark: SparkSession, d: str) -> DataFrame:
    return N.pivot_table(_triples(spark, d), *PIVOTED["p2_annotations"], elements=True)


def p2_arguments(spark: SparkSession, d: str) -> DataFrame:
    return N.pivot_table(_triples(spark, d), *PIVOTED["p2_arguments"], elements=True)


def p2_record(spark: SparkSession, d: str) -> DataFrame:
    return N.record_fields(_triples(spark, d))


def p2_remaining(spark: SparkSession, d: str) -> DataFrame:
    return N.remaining(_triples(spark, d), list(PIVOTED.values()))


def _tree(spark: SparkSession, d: str, paths: bool = True) -> DataFrame:
    return H.hierarchy(current_symbols(table(spark, d, "symbols"), ["parent_id"]), paths)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return H.endless(_tree(spark, d, paths=False))


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).selectExpr("id", "root_id", "depth", "array_join(path, ' > ') as path", "state", "cycle_id", "missing_parent")


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return H.descendants(_tree(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return S.snapshot_changes(table(spark, d, "file_hashes"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return O.orphans(*(table(spark, d, t) for t in ("symbols", "edges", "removed_symbols")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return O.direct_orphans(_orphans(spark, d))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return O.orphan_report(_orphans(spark, d))


QUERIES = {
    "p1_found": p1_found,
    "p1_summary": _summary,
    "p2_found": p2_found,
    "p2_parameters": p2_parameters,
    "p2_types": p2_types,
    "p2_annotations": p2_annotations,
    "p2_arguments": p2_arguments,
    "p2_record": p2_record,
    "p2_remaining": p2_remaining,
    "p3_found": p3_found,
    "p3_paths": p3_paths,
    "p3_descendants": p3_descendants,
    "p4_found": p4_found,
    "p6_found": p6_found,
    "p6_report": p6_report,
}

_CURRENT = """cur as (
  select id, any_value(nullif(parent_id, '')) as parent_id from (
    select *, rank() over (partition by id order by indexed_at desc) as r from symbols where id is not null
  ) where r = 1 group by id
), link as (
  select c.id, c.parent_id, p.id as up from cur c left join cur p on c.parent_id = p.id
)"""

_ENDLESS = f"""with recursive {_CURRENT}, way(id, top) as (
  select id, up from link where up is not null
  union
  select w.id, l.up from way w join link l on l.id = w.top where l.up is not null
), on_cycle as (select id from way where id = top),
cyc as (select o.id, min(w.top) as cycle_id from on_cycle o join way w on w.id = o.id group by o.id),
lost as (
  select w.id, min(c.cycle_id) as cycle_id from way w join cyc c on c.id = w.top group by w.id
)"""

#: Every way up (from id to top, the ids passed) that meets no id twice.
_UP = """up(id, top, ids) as (
  select id, id, [id] from cur
  union all
  select u.id, l.up, list_append(u.ids, l.up) from up u join link l on l.id = u.top where l.up is not null and not list_contains(u.ids, l.up)
)"""

_DIRECT = """with first as (select id, min(indexed_at) as since from symbols where id is not null group by id),
refs as (
  select 'edges.from_id' as ref_field, from_id as holder_id, from_id as missing_id, indexed_at from edges
  where not regexp_matches(from_id, '::__module__::(function|class)$')
  union all
  select 'edges.to_id', from_id, to_id, indexed_at from edges
  where len(string_split(to_id, '::')) = 4 and string_split(to_id, '::')[3] in
    ('function','class','method','interface','struct','enum','const','type','property','variant')
    and regexp_matches(string_split(to_id, '::')[4], '^[0-9]+$')
  union all
  select 'symbols.parent_id', id, parent_id, indexed_at from symbols where parent_id <> ''
), direct as (
  select ref_field, holder_id, missing_id, indexed_at,
    case when f.id is not null then 'late'
         when missing_id in (select id from removed_symbols where id is not null) then 'removed' else 'missing' end as reason,
    strftime(make_timestamp(indexed_at * 1000000), '%Y-%m') as period
  from refs left join first f on f.id = missing_id
  where f.id is null or f.since > indexed_at
)"""

_ARRAYS = "(" + ", ".join(f"'{f}'" for f in sorted(N.ARRAY_FIELDS)) + ")"
#: Every value of the records' JSON (walk) and, of those, the triples.
_TRIPLES = f"""with recursive cur as (
  select id, metadata from (select *, row_number() over (partition by id order by indexed_at desc) as r from symbols where id is not null) where r = 1
), walk(id, path, key, element, tab, node, below, v) as (
  select id, '', '', false, '', '', '', case when json_valid(metadata) then metadata::json end from cur
  union all
  select w.id, x.path, x.key, x.element, x.tab, x.node, x.below, x.v from (
    select *, json_type(v) as t, element or key in {_ARRAYS} as row_, case when element or key not in {_ARRAYS} then path else path || '[0]' end as p,
      case when json_type(v) = 'VARCHAR' then v ->> '$' end as s from walk) w, lateral (
    select w.path, w.key as key, w.element as element, w.tab as tab, w.node as node, w.below as below, s::json as v
    where t = 'VARCHAR' and ltrim(s, E' \\t\\n\\r')[1] in ('{{', '[', '"') and json_valid(s)
    union all
    select case when w.p = '' then e.key else w.p || '.' || e.key end, e.key, false, case when row_ then w.key else w.tab end,
      case when row_ then w.p else w.node end, case when row_ or w.below = '' then e.key else w.below || '.' || e.key end, e.value
    from json_each(v) e where t = 'OBJECT'
    union all
    select w.path || '[' || e.key || ']', w.key, true, w.tab, w.node, w.below || '[' || e.key || ']', e.value from json_each(v) e where t = 'ARRAY'
  ) x
), ends as (
  select *, element or key in {_ARRAYS} as row_, v ->> '$' as s from walk where json_type(v) <> 'ARRAY'
), rows_ as (
  select id, key as node_table, case when element then path else path || '[0]' end as node_path, node as parent_path, '' as field, null::varchar as value
  from ends where json_type(v) = 'OBJECT' and row_
  union all
  select id, case when element then key else tab end, case when element then path else node end, case when element then node end, case when element then '[]' else below end,
    case when json_type(v) <> 'NULL' then s end
  from ends where json_type(v) <> 'OBJECT' and not (json_type(v) = 'VARCHAR' and ltrim(s, E' \\t\\n\\r')[1] in ('{{', '[', '"') and json_valid(s))
), triples as (
  select id, node_table, node_path, parent_path, coalesce(nullif(regexp_extract(node_path, '\\[([0-9]+)\\]$', 1), '')::int, 0) as ordinal, field, value from rows_
)"""


def _pivot_sql(tables: list[str], fields: list[str]) -> str:
    columns = ", ".join(f"max(case when field = '{f}' and not e then value end) as \"{f.replace('.', '_')}\"" for f in fields)
    mine, wanted = ", ".join(f"'{t}'" for t in tables), ", ".join(f"'{f}'" for f in ["", *fields])
    return f"""{_TRIPLES} select id, node_path, max(parent_path) as parent_path, max(ordinal) as ordinal, {columns}, max(case when e then value end) as element
from (select *, field = '[]' and parent_path is not null as e from triples) where node_table in ({mine}) and (field in ({wanted}) or e) group by id, node_path"""


_PIVOTED_ROWS = " or ".join(
    f"node_table in ({', '.join(repr(t) for t in tables)}) and (field in ({', '.join(repr(f) for f in ['', *fields])}) or field = '[]' and parent_path is not null)"
    for tables, fields in PIVOTED.values()
)

SQL = {
    "p2_found": f"{_TRIPLES} select id, node_path, parent_path from triples where field = '' and parent_path is not null",
    **{name: _pivot_sql(*spec) for name, spec in PIVOTED.items()},
    "p2_record": f"{_TRIPLES} select id, field, value from triples where node_path = ''",
    "p2_remaining": f"{_TRIPLES} select * from triples where node_path <> '' and not ({_PIVOTED_ROWS})",
    "p1_found": """select to_id, kind from edges group by to_id, kind
having count(*) > 0.01 * (select count(*) from edges)""",
    "p1_summary": """select to_id, kind, count(*) as n_rows, count(distinct from_id) as n_distinct,
min(indexed_at) as first_at, max(indexed_at) as last_at from edges group by to_id, kind""",
    "p3_found": f"""{_ENDLESS} select l.id, case when o.id is null then 'below' else 'on' end as state, l.cycle_id
from lost l left join on_cycle o on o.id = l.id""",
    "p3_descendants": f"""with recursive {_CURRENT}, {_UP}
select top as id, id as descendant_id, len(ids) - 1 as distance from up where len(ids) > 1""",
    "p3_paths": f"""{_ENDLESS}, {_UP}, ways as (
  select u.*, row_number() over (partition by u.id order by len(ids) desc) as r from up u
  where not exists (select 1 from on_cycle o where o.id <> u.top and list_contains(ids[:-2], o.id)) and not (len(ids) > 1 and ids[1] in (select id from on_cycle))
) select w.id, case when c.cycle_id is null then w.top end as root_id, len(ids) - 1 as depth, array_to_string(list_reverse(ids), ' > ') as path,
  case when o.id is not null then 'on' when c.cycle_id is not null then 'below' end as state, c.cycle_id,
  case when k.parent_id not in (select id from cur) then k.parent_id end as missing_parent
from ways w join cur k on k.id = w.id left join lost c on c.id = w.id left join on_cycle o on o.id = w.id where r = 1""",
    "p4_found": r"""with rows_ as (
  select snapshot_no, indexed_at,
    array_to_string(list_filter(string_split(replace(file_path, '\', '/'), '/'), lambda s: s <> '' and s <> '.'), '/') as path,
    nullif(regexp_replace(regexp_replace(lower(hash), '^\s*(sha-?256\s*[:=\-]?\s*)?', ''), '[\s:\-]+', '', 'g'), '') as hash
  from file_hashes where snapshot_no is not null and file_path is not null
), listed as (
  select snapshot_no, path, hash from (
    select *, row_number() over (partition by snapshot_no, path order by indexed_at desc nulls last, hash desc nulls last) as r from rows_
  ) where r = 1
), snaps as (
  select snapshot_no, lag(snapshot_no) over (order by snapshot_no) as before from (select distinct snapshot_no from listed)
), stays as (
  select *, sum(new_) over (partition by path order by snapshot_no) as stay from (
    select l.*, s.before,
      case when lag(l.snapshot_no) over (partition by path order by l.snapshot_no) is not distinct from s.before then 0 else 1 end as new_
    from listed l join snaps s using (snapshot_no)
  )
), filled as (
  select snapshot_no, before, path,
    last_value(hash ignore nulls) over (partition by path, stay order by snapshot_no
      rows between unbounded preceding and current row) as hash
  from stays
), old as (select s.snapshot_no, f.path, f.hash from filled f join snaps s on s.before = f.snapshot_no)
select coalesce(n.snapshot_no, o.snapshot_no) as snapshot_no,
  case when o.path is null then 'added' when n.path is null then 'removed' else 'changed' end as change,
  coalesce(n.path, o.path) as file_path
from (select * from filled where before is not null) n full join old o on n.snapshot_no = o.snapshot_no and n.path = o.path
where o.path is null or n.path is null or n.hash <> o.hash""",
    "p6_report": f"""{_DIRECT.replace("with first", "with recursive first")}, {_CURRENT.replace("cur as", "now as", 1).split(", link as")[0]},
own as (select id from now where exists (select 1 from direct where ref_field = 'symbols.parent_id' and holder_id = now.id and direct.missing_id = now.parent_id)),
down(id, level) as (
  select id, 1 from own
  union all
  select n.id, d.level + 1 from down d join now n on n.parent_id = d.id where n.id not in (select id from own)
), near as (
  select r.*, least(h.level, t.level) as level from refs r left join down h on h.id = r.holder_id
  left join down t on r.ref_field = 'edges.to_id' and t.id = r.missing_id left join first f on f.id = r.missing_id
  where (h.id is not null or t.id is not null) and f.since <= r.indexed_at
), every as (
  select ref_field, holder_id, missing_id, reason, period, count(*) as n_rows, 0 as level from direct group by all
  union all
  select ref_field, holder_id, missing_id, 'inherited', strftime(make_timestamp(indexed_at * 1000000), '%Y-%m'), count(*), min(level) from near group by 1, 2, 3, 4, 5
) select ref_field, period, reason, level, count(*) as n_refs, sum(n_rows)::bigint as n_rows from every group by all""",
    "p6_found": f"{_DIRECT} select distinct ref_field, holder_id, missing_id, reason, period from direct",
}
