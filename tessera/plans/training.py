"""Queries of the general training-data operators (problems 1, 4 and 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import orphans, rowparse, units
from tessera.session import table

RERUN = "phase_1_7a_citation_format_correction_rerun"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return units.common_units(table(spark, d, "facts"), table(spark, d, "evidence_records"))


def p1_by_unit(spark: SparkSession, d: str) -> DataFrame:
    return p1_found(spark, d).groupBy("source_table", "common_unit").agg(F.count("*").alias("records"))


def p1_mismatches(spark: SparkSession, d: str) -> DataFrame:
    return units.mismatches(table(spark, d, "facts"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return rowparse.rejected(table(spark, d, "raw_lines"))


def p4_facts(spark: SparkSession, d: str) -> DataFrame:
    return rowparse.typed_facts(table(spark, d, "raw_lines"))


def p4_submissions(spark: SparkSession, d: str) -> DataFrame:
    return rowparse.typed_submissions(table(spark, d, "raw_lines"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    facts = orphans.fact_orphans(table(spark, d, "facts"), table(spark, d, "submissions"))
    return facts.unionByName(orphans.citation_orphans(table(spark, d, RERUN), table(spark, d, "chunks"), RERUN))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.by_month(p6_found(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_by_unit, p1_mismatches, p4_found, p4_facts, p4_submissions, p6_found, p6_report)}

_LAYOUT = r"""^(?:"(?:[^"]|"")*"|[^"\t][^\t]*|)(?:\t(?:"(?:[^"]|"")*"|[^"\t][^\t]*|))*$"""
_FIELDS = r"""(?:^|\t)("(?:[^"]|"")*"|[^"\t][^\t]*|)"""
_SPLIT = rf"""
with lines as (select line_id, coalesce(line, '') as line, regexp_extract(file_name, '(num|sub)\.txt$', 1) as kind from raw_lines),
ok as (select *, regexp_matches(line, '{_LAYOUT}') as fits from lines),
cut as (select *, case when fits then list_transform(regexp_extract_all(line, '{_FIELDS}', 1),
    lambda f: case when f like '"%' then replace(f[2:-2], '""', '"') else f end) end as f from ok),
said as (select *, case when not fits then 'quoting'
    when len(f) <> case kind when 'num' then 9 else 8 end then 'column_count'
    when kind = 'num' and f[9] <> '' and not regexp_full_match(f[9], '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') then 'bad_value'
    when kind = 'num' and f[5] <> '' and not regexp_full_match(f[5], '[0-9]{{1,2}}') then 'bad_qtrs'
    when kind = 'sub' and f[5] <> '' and not regexp_full_match(f[5], '(19|20)[0-9]{{2}}') then 'bad_fy' end as reason from cut)
"""
_ORPHANS = f"""
with kids as (
    select 'facts' as child_table, cast(fact_id as varchar) as child_key, regexp_replace(adsh, '[^0-9]', '', 'g') as k, loaded_at as at_time from facts where adsh is not null
    union all
    select distinct '{RERUN}', case_id, regexp_replace(lower(replace(trim(regexp_replace(u.chunk_id, '[\\s\\[\\]]', '', 'g')), '：', ':')), '::chunk0*([0-9]+)$', '::chunk\\1'), run_ts
    from (select case_id, run_ts, unnest(citation_checks) as u from {RERUN}) where u.chunk_id is not null),
parents as (
    select 'facts' as child_table, regexp_replace(adsh, '[^0-9]', '', 'g') as k, min(loaded_at) as arrived, min(withdrawn_at) as removed from submissions group by all
    union all select '{RERUN}', lower(chunk_id), min(indexed_at), min(removed_at) from chunks group by all),
found as (select c.child_table, c.child_key,
    case c.child_table when 'facts' then c.k[1:10] || '-' || c.k[11:12] || '-' || c.k[13:18] else c.k end as parent_key,
    case when p.k is null then 'missing' when p.arrived > c.at_time then 'late' when p.removed <= c.at_time then 'deleted' end as kind,
    strftime(c.at_time, '%Y-%m') as period
    from kids c left join parents p using (child_table, k))
"""

ORACLE = {
    "p4_found": _SPLIT + "select line_id, reason from said where reason is not null",
    "p4_facts": _SPLIT
    + """select line_id, nullif(f[1], '') as adsh, nullif(f[2], '') as tag, nullif(f[3], '') as version, nullif(f[4], '') as ddate, try_cast(nullif(f[5], '') as integer) as qtrs,
    nullif(f[6], '') as uom, nullif(f[7], '') as coreg, nullif(f[8], '') as segments, try_cast(nullif(f[9], '') as double) as value from said where reason is null and kind = 'num'""",
    "p4_submissions": _SPLIT
    + """select line_id, nullif(f[1], '') as adsh, try_cast(nullif(f[2], '') as bigint) as cik, nullif(f[3], '') as name, nullif(f[4], '') as form, try_cast(nullif(f[5], '') as integer) as fy,
    nullif(f[6], '') as fp, nullif(f[7], '') as period, nullif(f[8], '') as filed from said where reason is null and kind = 'sub'""",
    "p6_found": _ORPHANS + "select * from found where kind is not null",
    "p6_report": _ORPHANS + "select child_table, period, kind, count(*) as orphans, count(distinct parent_key) as parents from found where kind is not null group by all",
}
