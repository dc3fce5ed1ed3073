"""Queries of the text problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import docpairs, mixing, pii, tokens
from skein.scale import checkpoint
from skein.tables import current_symbols, table


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.documented_functions(table(spark, d, "symbols"), table(spark, d, "edges"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pairs(spark, d).where("source = 'own'").select("id")


def p5_bases(spark: SparkSession, d: str) -> DataFrame:
    current = current_symbols(table(spark, d, "symbols"), ["name", "kind", "file_path"])
    return docpairs.base_links(current, table(spark, d, "edges"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.document_ids(table(spark, d, "documents"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.share_report(table(spark, d, "documents"), table(spark, d, "mix_targets"), p8_mixture(spark, d))


def p8_shares_kept(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares_kept(checkpoint(p8_shares(spark, d)))


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(spark, d, "documents"), table(spark, d, "known_names"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found_items(p9_redacted(spark, d))


def p9_texts(spark: SparkSession, d: str) -> DataFrame:
    return p9_redacted(spark, d).select("doc_id", "redacted")


QUERIES = {
    "p5_found": p5_found,
    "p5_pairs": p5_pairs,
    "p5_bases": p5_bases,
    "p7_ids": p7_ids,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p8_shares_kept": p8_shares_kept,
    "p9_found": p9_found,
    "p9_texts": p9_texts,
}
SQL: dict[str, str] = {
    "p8_shares_kept": r"""with d as (select regexp_replace(lower(trim(source)), '[\s\-]+', '_', 'g') as source, count(*) as n_docs, count(*) filter (text <> '') as n_text from documents group by 1),
w as (select regexp_replace(lower(trim(source)), '[\s\-]+', '_', 'g') as source, max(weight) as weight, max(max_repeats) as max_repeats from mix_targets where source is not null group by 1),
x as (select coalesce(d.source, w.source) as source, coalesce(n_docs, 0) as n_docs, weight, max_repeats, coalesce(n_text > 0 and weight > 0 and max_repeats > 0, false) as live from d full join w on d.source = w.source)
select source, n_docs, weight, max_repeats, case when live then round(weight / (select sum(weight) from x where live), 6) else 0.0 end as target_share, true as share_kept, true as repeats_kept from x""",
    "p5_bases": r"""with s as (select id, name, kind, file_path, string_split(file_path, '/')[1] as repo from (
  select *, row_number() over (partition by id order by indexed_at desc) as r from symbols where id is not null) where r = 1),
c as (select * from s where kind in ('class', 'struct', 'interface', 'enum')),
l as (select distinct from_id, to_id as spelling, regexp_replace(regexp_replace(to_id, '[<\[(].*$', ''), '^.*(::|\.)', '') as name
  from edges where kind in ('extends', 'implements') and from_id is not null and to_id is not null),
f as (select file_path, count(*) as n, min(id) as id, min(repo) as repo from c group by file_path),
m as (select l.*, f.* from l left join f on l.from_id = f.file_path || '::__module__::class' where l.from_id like '%::\_\_module\_\_::class' escape '\'),
h as (select c.id as class_id, spelling, l.name, file_path, repo from l join c on c.id = l.from_id union select id, spelling, name, file_path, repo from m where n = 1),
x as (select h.*, (select count(*) from c where c.id = h.spelling) as known,
  (select count(*) from c where c.name = h.name and c.file_path = h.file_path) as n1, (select min(id) from c where c.name = h.name and c.file_path = h.file_path) as i1,
  (select count(*) from c where c.name = h.name and c.repo = h.repo) as n2, (select min(id) from c where c.name = h.name and c.repo = h.repo) as i2,
  (select count(*) from c where c.name = h.name) as n3, (select min(id) from c where c.name = h.name) as i3 from h),
y as (select *, case when n1 > 0 then n1 when n2 > 0 then n2 else n3 end as n, case when n1 > 0 then i1 when n2 > 0 then i2 else i3 end as i from x)
select class_id, spelling, case when known > 0 then spelling when n = 1 then i end as base_id,
  case when known > 0 then 'id' when n = 0 then 'unknown' when n > 1 then 'ambiguous' when n1 > 0 then 'file' when n2 > 0 then 'repository' else 'anywhere' end as how,
  case when known > 0 then 1 else n end as n_choices from y
union all
select null, spelling, null, case when n > 1 then 'ambiguous' else 'unknown' end, coalesce(n, 0) from m where n is null or n > 1""",
}
