"""Queries of the engine's own operators over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import audit, documents, facts, fulltext, guards, matching, metrics, sampling, search
from tessera.plans.registering import registry
from tessera.session import table
from tessera.streaming import events as stream

RERUN = "phase_1_7a_citation_format_correction_rerun"
QUERIES, ORACLE, query = registry()


def _integer(column: str, kind: str):
    """Digits, also those written as a decimal, as an integer; other text is null."""
    return F.expr(f"coalesce(try_cast({column} as {kind}), try_cast(try_cast({column} as double) as {kind}))")


# --- structured facts

# Spelled out here a second time, so that the SQL does not repeat a slip of the operator.
_REG = """(values ('Assets', 0, 'USD'), ('Liabilities', 0, 'USD'), ('StockholdersEquity', 0, 'USD'), ('CashAndCashEquivalentsAtCarryingValue', 0, 'USD'), ('Revenues', 4, 'USD'),
('ResearchAndDevelopmentExpense', 4, 'USD'), ('NetIncomeLoss', 4, 'USD'), ('OperatingIncomeLoss', 4, 'USD'), ('CostOfRevenue', 4, 'USD'), ('GrossProfit', 4, 'USD'),
('RevenueFromContractWithCustomerExcludingAssessedTax', 4, 'USD'), ('OperatingExpenses', 4, 'USD'), ('EarningsPerShareBasic', 4, 'USD'), ('EarningsPerShareDiluted', 4, 'USD'), ('IncomeTaxExpenseBenefit', 4, 'USD')) r(tag, want_qtrs, want_uom)"""
_BAD = {
    "wrong_form": "coalesce(form <> '10-K', true)", "wrong_year": "coalesce(fiscal_year not between 2016 and 2020, true)", "coregistrant": "coalesce(coreg, '') <> ''", "segmented": "coalesce(segments, '') <> ''",
    "custom_taxonomy": "coalesce(version not like 'us-gaap/%', true)", "no_value": "(value is null or isnan(value) or isinf(value))", "wrong_qtrs": "coalesce(qtrs <> want_qtrs, true)", "wrong_unit": "coalesce(uom <> want_uom, true)",
}
_ELIGIBLE = f"""e as (select adsh, f.tag, ddate, qtrs, uom, min(cik) as cik, min(fiscal_year) as fiscal_year, min(value) as value, min(value) <> max(value) as conflict
from facts f join {_REG} on f.tag = r.tag where {' and '.join(f'not {b}' for b in _BAD.values())} and exists (select 1 from submissions s where s.adsh = f.adsh and s.period = f.ddate)
group by adsh, f.tag, ddate, qtrs, uom),
k as (select cik, fiscal_year, tag, count(*) as candidates, min(value) as value, count(distinct value) as vals from e group by all)"""


def _eligible(s: SparkSession, d: str) -> DataFrame:
    return facts.eligible(table(s, d, "facts"), table(s, d, "submissions"), facts.registry(s))


@query(f"with {_ELIGIBLE} select * from e")
def f1_eligible_facts(s, d):
    return _eligible(s, d)


_FUNNEL = f"with j as (select * from facts f join {_REG} on f.tag = r.tag) select 'known_tag' as rule, count(*) as facts from j " + " ".join(f"union all select '{n}', count(*) filter ({b}) from j" for n, b in _BAD.items())


@query(_FUNNEL)
def f1_eligibility_funnel(s, d):
    return facts.funnel(table(s, d, "facts"), facts.registry(s))


@query(f"""with {_ELIGIBLE}, q as (select evidence_id as request_id, cik, fiscal_year, concept_name as tag from evidence_records)
select request_id, q.cik, q.fiscal_year, q.tag, case when q.tag not in (select tag from {_REG}) or q.tag is null then 'unsupported_tag' when candidates is null then 'not_found' when vals > 1 then 'ambiguous' else 'found' end as status,
case when vals = 1 then value end as value, coalesce(candidates, 0) as candidates from q left join k on q.cik = k.cik and q.fiscal_year = k.fiscal_year and q.tag = k.tag""")
def f2_fact_lookup(s, d):
    requests = table(s, d, "evidence_records").select(F.col("evidence_id").alias("request_id"), "cik", "fiscal_year", F.col("concept_name").alias("tag"))
    return facts.lookup(requests, _eligible(s, d), facts.registry(s))


@query(f"with {_ELIGIBLE}, o as (select * from k where vals = 1) select a.cik, a.tag, a.fiscal_year, a.value - b.value as change from o a join o b on a.cik = b.cik and a.tag = b.tag and a.fiscal_year = b.fiscal_year + 1")
def f3_changes(s, d):
    return facts.changes(_eligible(s, d))


@query(f"""with {_ELIGIBLE}, o as (select *, row_number() over (partition by tag, fiscal_year order by cik) as n from k where vals = 1)
select a.tag, a.fiscal_year, a.cik as cik_a, b.cik as cik_b, case when a.value > b.value then 'a' when a.value < b.value then 'b' else 'tie' end as greater
from o a join o b on a.tag = b.tag and a.fiscal_year = b.fiscal_year and b.n = a.n + 1 where a.n % 2 = 1""")
def f4_compare(s, d):
    return facts.compare(_eligible(s, d))


_REVISION = """with o as (select {k}, adsh, min(value) as lo, max(value) as hi from facts where value is not null group by all),
g as (select {k}, count(*) as n, min(lo) as lo, max(hi) as hi from o group by {k})
select count(*) as repeated, count(*) filter (lo <> hi) as revised from g where n > 1"""


@query(_REVISION.format(k="cik, tag, ddate, qtrs, uom, coreg, segments"))
def a8_revision_strict(s, d):
    return facts.revision_rate(table(s, d, "facts"), ("cik", "tag", "ddate", "qtrs", "uom", "coreg", "segments"))


@query(_REVISION.format(k="cik, tag, ddate, qtrs"))
def a8_revision_loose(s, d):
    return facts.revision_rate(table(s, d, "facts"), ("cik", "tag", "ddate", "qtrs"))


@query("""with q as (select distinct cik, fiscal_year from documents where cik is not null and fiscal_year is not null),
e as (select try_cast(cik as bigint) as cik, try_cast(year as int) as fiscal_year, count(*) as n, min(filename) as document_id from edgar group by all)
select q.cik, q.fiscal_year, case when n is null then 'not_found' when n > 1 then 'ambiguous' else 'found' end as status, case when n = 1 then document_id end as document_id from q left join e using (cik, fiscal_year)""")
def f5_resolve_filing(s, d):
    requests = table(s, d, "documents").where("cik is not null and fiscal_year is not null").select("cik", "fiscal_year").distinct()
    filings = table(s, d, "edgar").select(_integer("cik", "bigint").alias("cik"), _integer("year", "int").alias("fiscal_year"), F.col("filename").alias("document_id"))
    return facts.resolve_filing(requests, filings)


# --- audits, joins and aggregates

_SECTION_COLUMNS = [f"section_{x}" for x in documents.SECTIONS]


@query(" union all ".join(f"select '{c}' as field, count(*) filter (regexp_matches({c}, '\\S')) as filled, avg(length({c})) filter (regexp_matches({c}, '\\S')) as average_length from edgar" for c in _SECTION_COLUMNS))
def a3_fill_rates(s, d):
    return audit.fill_rates(table(s, d, "edgar"), _SECTION_COLUMNS)


_KEY = ["adsh", "tag", "version", "ddate", "qtrs", "uom", "coreg", "segments"]


@query(f"select count(*) as keys, coalesce(sum(n), 0)::bigint as rows from (select count(*) as n from facts group by {', '.join(_KEY)} having count(*) > 1)")
def a4_duplicate_facts(s, d):
    return audit.duplicates(table(s, d, "facts"), _KEY)


@query("select rows_per_key, count(*) as keys from (select cik, count(*) as rows_per_key from documents where cik is not null group by 1) group by 1")
def a5_documents_per_company(s, d):
    return audit.histogram(table(s, d, "documents"), "cik")


@query("select tag, uom, n from (select *, row_number() over (partition by tag order by n desc, uom) as r from (select tag, uom, count(*) as n from facts where uom is not null group by all)) where r = 1")
def a10_mode_unit(s, d):
    return audit.mode(table(s, d, "facts"), "tag", "uom")


@query("select tag, count(*) as n from facts group by 1 order by n desc, tag nulls first limit 10")
def a9_top_tags(s, d):
    return audit.top(table(s, d, "facts"), "tag", 10)


@query("select cik, filed, adsh, form from (select *, row_number() over (partition by cik order by filed desc nulls last, adsh desc, form desc) as r from submissions) where r = 1")
def a14_latest_submission(s, d):
    return audit.latest(table(s, d, "submissions"), "cik", ["filed", "adsh"], ["filed", "adsh", "form"])


@query("""with r as (select section_id, n_chars, row_number() over (partition by section_id order by n_chars) as rn, count(*) over (partition by section_id) as n from documents where n_chars is not null)
select section_id, """ + ", ".join(f"max(n_chars) filter (rn - 1 = round_even({p} * (n - 1), 0)) as {a}" for a, p in (("p50", 0.5), ("p95", 0.95))) + " from r group by 1")
def a12_percentiles(s, d):
    return audit.percentiles(table(s, d, "documents"), "section_id", "n_chars", {"p50": 0.5, "p95": 0.95})


@query()
def a23_fingerprint(s, d):
    return audit.fingerprint(table(s, d, "facts"))


@query("select count(*) as children, count(o_custkey) as with_key, count(c.c_custkey) as found from orders o left join (select distinct c_custkey from customer) c on o.o_custkey = c.c_custkey")
def j3_order_integrity(s, d):
    return audit.integrity(table(s, d, "orders"), table(s, d, "customer"), "o_custkey", "c_custkey")


@query("""with k as (select distinct cik from submissions where cik is not null), h as (select distinct cik from facts where cik is not null)
select count(*) as keys, count(h.cik) as shared, count(h.cik) / count(*) as share from k left join h on k.cik = h.cik""")
def a28_key_overlap(s, d):
    return audit.key_overlap(table(s, d, "facts"), table(s, d, "submissions"), "cik")


@query("""with f as (select filename as document_id, try_cast(cik as bigint) as cik, try_cast(year as int) as year from edgar),
s as (select distinct cik, fiscal_year as y from submissions where fiscal_year is not null)
select document_id, cik, year, case when exists (select 1 from s where s.cik = f.cik and s.y = f.year) then 'matched' when exists (select 1 from s where s.cik = f.cik and abs(s.y - f.year) = 1) then 'off_by_one'
when exists (select 1 from s where s.cik = f.cik) then 'other_years' else 'no_company' end as cause, (select min(y) from s where s.cik = f.cik) as first_year, (select max(y) from s where s.cik = f.cik) as last_year from f""")
def j11_alignment_cause(s, d):
    filings = table(s, d, "edgar").select(F.col("filename").alias("document_id"), _integer("cik", "bigint").alias("cik"), _integer("year", "int").alias("year"))
    return audit.alignment_cause(filings, table(s, d, "submissions"))


_RULES = {"company": "company is not null", "text": "length(trim(text)) > 0", "chunk_id": "chunk_id = document_id || '::chunk' || ordinal", "token_count": "token_count > 0", "removed_after_indexed": "removed_at is null or removed_at >= indexed_at"}


@query(" union all ".join(f"select chunk_id, '{n}' as rule from chunks where not coalesce({c}, false)" for n, c in _RULES.items()))
def chunk_rule_violations(s, d):
    return audit.violations(table(s, d, "chunks"), "chunk_id", {n: F.expr(c) for n, c in _RULES.items()})


@query("""with c as (""" + " union all ".join(f"select '{n}' as check_name, count(*) filter (not coalesce({c}, false)) as bad, count(*) as total from chunks" for n, c in _RULES.items()) + """)
select *, case when total = 0 then 'SKIP' when bad / total > 0.05 then 'FAIL' when bad / total > 0.01 then 'WARN' else 'PASS' end as level from c""")
def a25_chunk_verdicts(s, d):
    one = table(s, d, "chunks").agg(*(F.count_if(~F.coalesce(F.expr(c), F.lit(False))).alias(n) for n, c in _RULES.items()), F.count("*").alias("total"))
    return audit.verdicts(one.unpivot(["total"], list(_RULES), "check_name", "bad"), 0.01, 0.05)


@query("select s.form, count(*) as facts, count(distinct f.cik) as companies from facts f join (select adsh, min(form) as form from submissions group by 1) s on f.adsh = s.adsh group by 1")
def j1_facts_by_form(s, d):
    forms = table(s, d, "submissions").groupBy("adsh").agg(F.min("form").alias("form"))
    return table(s, d, "facts").select("adsh", "cik").join(forms, "adsh").groupBy("form").agg(F.count("*").alias("facts"), F.countDistinct("cik").alias("companies"))


@query("select cik, fiscal_year, count(distinct adsh) as filings, min(name) as name from submissions where fiscal_year is not null group by 1, 2")
def j7_population(s, d):
    return table(s, d, "submissions").where("fiscal_year is not null").groupBy("cik", "fiscal_year").agg(F.countDistinct("adsh").alias("filings"), F.min("name").alias("name"))


@query("select filename from edgar e where exists (select 1 from submissions s where s.cik = try_cast(e.cik as bigint) and abs(s.fiscal_year - try_cast(e.year as int)) = 1)")
def j11_semi_off_by_one(s, d):
    e = table(s, d, "edgar").select("filename", _integer("cik", "bigint").alias("cik"), _integer("year", "int").alias("year"))
    years = table(s, d, "submissions").select("cik", F.explode(F.array(F.col("fiscal_year") - 1, F.col("fiscal_year") + 1)).alias("year")).distinct()
    return e.join(years, ["cik", "year"], "left_semi").select("filename")


@query("select c_custkey from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey)")
def j9_customers_without_orders(s, d):
    c, o = table(s, d, "customer"), table(s, d, "orders")
    return c.join(o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("""select n_name, r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as lines from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2""")
def j4_revenue_by_nation(s, d):
    t = lambda n: table(s, d, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("lines"))


@query("select l_returnflag, l_linestatus, sum(l_quantity) as quantity, count(*) as lines, grouping(l_returnflag) + grouping(l_linestatus) as level from lineitem group by rollup (l_returnflag, l_linestatus)")
def a17_rollup(s, d):
    return table(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("lines"), (F.grouping("l_returnflag") + F.grouping("l_linestatus")).cast("bigint").alias("level"))


@query("""select c_nationkey, c_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by c_nationkey order by o_totalprice desc, o_orderkey) as r from
(select c_nationkey, c_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) o join customer on c_custkey = o_custkey where n = 1)) where r <= 3""")
def w1_latest_order_top3(s, d):
    from pyspark.sql.window import Window

    last = table(s, d, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("x"))
    j = last.join(table(s, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("c_nationkey", "c_custkey", "x.o_orderkey", "x.o_totalprice")
    return j.withColumn("r", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))).where("r <= 3").drop("r")


@query("""select coalesce(a.cik, b.cik) as cik, case when b.cik is null then 'facts_only' when a.cik is null then 'filings_only' else 'both' end as side from (select distinct cik from facts where cik is not null) a
full join (select distinct try_cast(cik as bigint) as cik from edgar where try_cast(cik as bigint) is not null) b on a.cik = b.cik""")
def t4_key_sets(s, d):
    a = table(s, d, "facts").select("cik").where("cik is not null").distinct().withColumn("a", F.lit(1))
    b = table(s, d, "edgar").select(_integer("cik", "bigint").alias("cik")).where("cik is not null").distinct().withColumn("b", F.lit(1))
    return a.join(b, "cik", "full_outer").select("cik", F.when(F.col("b").isNull(), "facts_only").when(F.col("a").isNull(), "filings_only").otherwise("both").alias("side"))


# --- search and metrics

_DIMS = 64
_KNN = """with q as (select vec_id, embedding::double[] as e from embeddings where vec_id % 100 = 0),
v as (select vec_id, label, embedding::double[] as e from embeddings{w}),
s as (select q.vec_id as query_id, v.vec_id as id, list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))) as c from q, v where q.vec_id <> v.vec_id)
select query_id, row_number() over (partition by query_id order by round(c, 9) desc, id) as rank, id, round(c, 6) as score from s qualify rank <= {k}"""


def _knn(s, d, k, where=None):
    v = table(s, d, "embeddings")
    return search.knn(v.where(where) if where else v, v.where("vec_id % 100 = 0"), k, _DIMS)


@query(_KNN.format(w="", k=10))
def r1_knn(s, d):
    return _knn(s, d, 10)


@query(_KNN.format(w=" where label < 3", k=5))
def r2_knn_prefiltered(s, d):
    return _knn(s, d, 5, "label < 3")


@query("select count(*) as vectors, count(*) filter (abs(sqrt(list_dot_product(embedding::double[], embedding::double[])) - 1) > 1e-3) as not_unit, min(len(embedding)) as least_dims, max(len(embedding)) as most_dims from embeddings")
def r4_norm_audit(s, d):
    return search.norm_audit(table(s, d, "embeddings"))


_POSTINGS = "p as (select doc_id, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from documents where text is not null) where length(term) between 1 and 40 group by all)"
_QUERIES = "q as (select distinct row_number as query_id, term from (select row_number() over (order by subject) as row_number, unnest(regexp_extract_all(lower(description), '[a-z0-9]+')) as term from subjects))"
_BM25 = f"""{_POSTINGS}, {_QUERIES}, l as (select doc_id, sum(tf) as length from p group by 1),
t as (select count(*) as docs, avg(length) as mean from l),
df as (select term, count(*) as df from p group by 1),
bs as (select query_id, doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) as score from p join q using (term) join df using (term) join l using (doc_id), t group by all),
b as (select query_id, row_number() over (partition by query_id order by score desc, doc_id) as rank, doc_id, score from bs qualify rank <= 50)"""
_OVERLAP = "o as (select query_id, row_number() over (partition by query_id order by n desc, doc_id) as rank, doc_id, n from (select query_id, doc_id, count(*) as n from p join q using (term) group by all) qualify rank <= 50)"


def _queries(s, d):
    numbered = table(s, d, "subjects").withColumn("query_id", F.expr("row_number() over (order by subject)").cast("bigint"))  # ten rows
    return numbered.select("query_id", F.explode(F.regexp_extract_all(F.lower("description"), F.lit("([a-z0-9]+)"))).alias("term")).distinct()


def _index(s, d, how=fulltext.Analysis()):
    return fulltext.Index.of(table(s, d, "documents"), "doc_id", "text", how)


def _bm25(s, d, k=50):
    return _index(s, d).search(_queries(s, d), k)


def _overlap(s, d, k=50):
    return _index(s, d).overlap(_queries(s, d), k)


@query(f"with {_BM25} select * from b")
def r6_bm25(s, d):
    return _bm25(s, d)


@query(f"with {_POSTINGS} select term, count(*) as df, sum(tf)::bigint as tf from p group by 1")
def r6_term_statistics(s, d):
    return _index(s, d).postings().groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


_FULL = "f as (select coalesce(o.query_id, b.query_id) as query_id, coalesce(o.doc_id, b.doc_id) as id, o.rank as dense_rank, b.rank as sparse_rank from o full join b on o.query_id = b.query_id and o.doc_id = b.doc_id)"
_FUSED = _FULL + """, fs as (select *, coalesce(1 / (60.0::double + dense_rank), 0) + coalesce(1 / (60.0::double + sparse_rank), 0) as sc from f),
fr as (select query_id, row_number() over (partition by query_id order by round(sc, 12) desc, least(coalesce(dense_rank, 1e9), coalesce(sparse_rank, 1e9)), coalesce(dense_rank, 1e9), coalesce(sparse_rank, 1e9), id) as rank, id, dense_rank, sparse_rank, round(sc, 9) as score from fs qualify rank <= 50)"""


def _two(s, d):
    return _overlap(s, d), _bm25(s, d).withColumnRenamed("doc_id", "id")


@query(f"with {_BM25}, {_OVERLAP}, {_FUSED} select * from fr")
def r8_rank_fusion(s, d):
    return search.fuse(*_two(s, d))


@query(f"with {_BM25}, {_OVERLAP}, {_FULL} select query_id, count(*) filter (dense_rank is not null and sparse_rank is not null) as both, count(*) filter (sparse_rank is null) as dense_only, count(*) filter (dense_rank is null) as sparse_only from f group by 1")
def j17_complementarity(s, d):
    return search.complementarity(*_two(s, d))


@query(f"with {_BM25}, {_OVERLAP}, {_FULL} select case when dense_rank is null then 'entered' when sparse_rank is null then 'left' when sparse_rank < dense_rank then 'up' when sparse_rank > dense_rank then 'down' else 'same' end as movement, count(*) as n from f group by 1")
def a26_rank_movement(s, d):
    return search.movement(*_two(s, d))


@query(f"with {_BM25} select query_id, doc_id as id, n_chars as score, rank as base_rank, row_number() over (partition by query_id order by n_chars desc, rank) as rank from b join documents using (doc_id) qualify row_number() over (partition by query_id order by n_chars desc, rank) <= 10")
def r10_rerank(s, d):
    candidates = _bm25(s, d).withColumnRenamed("doc_id", "id")
    lengths = candidates.join(table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("new")), "id").select("query_id", "id", F.col("new").alias("score"))
    return search.rerank(candidates.drop("score"), lengths, 10, 50)


_HITS = f"h as ({_KNN.format(w='', k=10)})"
_TOP = """c as (select query_id, max(score) filter (rank = 1) as top1, round(avg(score) filter (rank <= 3), 6) as mean3, round(max(score) filter (rank = 1) - min_by(score, -rank) filter (rank <= 5), 6) as lead from h group by 1)"""


@query(f"with {_HITS}, {_TOP} select * from c")
def r15_confidence(s, d):
    return search.confidence(_knn(s, d, 10))


def _good(s, d):
    labels = table(s, d, "embeddings").select("vec_id", "label")
    first = _knn(s, d, 1).join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("a")), "query_id").join(labels.select(F.col("vec_id").alias("id"), F.col("label").alias("b")), "id")
    return first.select("query_id", F.col("score").alias("top1"), (F.col("a") == F.col("b")).cast("int").alias("good"))


@query(f"""with {_HITS}, g as (select score as top1, (x.label = y.label)::int as good from h join embeddings x on x.vec_id = query_id join embeddings y on y.vec_id = id where rank = 1),
t as (select sum(good) as p, count(*) - sum(good) as n from g),
c as (select distinct top1 as threshold from g),
j as (select threshold, round((select count(*) from g where top1 < threshold and good = 0) / nullif(n, 0) - (select count(*) from g where top1 < threshold and good = 1) / nullif(p, 0), 9) as j from c, t)
select threshold, j from j order by j desc, threshold limit 1""")
def r16_youden(s, d):
    return search.youden(_good(s, d))


def _relevant(s, d):
    v = table(s, d, "embeddings").select("vec_id", "label")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    return q.join(v.select(F.col("vec_id").alias("id"), "label"), "label").where("query_id != id").select("query_id", "id")


_MET = f"""{_HITS}, r as (select x.vec_id as query_id, y.vec_id as id, x.label from embeddings x join embeddings y on x.label = y.label and x.vec_id <> y.vec_id where x.vec_id % 100 = 0),
w as (select query_id, count(*) as wanted from r group by 1),
g as (select query_id, count(*) as hits, min(rank) as best, sum(1 / log2(rank + 1)) as dcg from h join r using (query_id, id) group by 1),
m as (select query_id, round(coalesce(hits / wanted, 0), 9) as recall, round(coalesce(hits / 10, 0), 9) as precision, round(coalesce(1 / best, 0), 9) as rr, round(coalesce(dcg / list_sum(list_transform(range(1, least(10, wanted) + 1), lambda i: 1 / log2(i + 1))), 0), 9) as ndcg from w left join g using (query_id))"""


@query(f"with {_MET} select * from m")
def d22_retrieval_metrics(s, d):
    return metrics.retrieval(_knn(s, d, 10), _relevant(s, d), 10)


@query(f"with {_MET}, l as (select m.*, label::varchar as label from m join embeddings on vec_id = query_id) select coalesce(label, 'all') as label, count(*) as queries, round(avg(recall), 9) as recall, round(avg(precision), 9) as precision, round(avg(rr), 9) as rr, round(avg(ndcg), 9) as ndcg from l group by rollup (label)")
def a17_metrics_by_label(s, d):
    per = metrics.retrieval(_knn(s, d, 10), _relevant(s, d), 10).join(table(s, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("label")), "query_id")
    return metrics.means(per, "label")


_SAYS = "case when regexp_matches(answer, '(cannot|unable|not able|decline|does not contain|not enough|no answer)') then 'abstain' else 'answer' end"
_CASES = f"t as (select expected_behavior as a, {_SAYS} as p from {RERUN})"
_CELLS = "m as (select x.a as actual, y.a as predicted, (select count(*) from t where t.a = x.a and t.p = y.a) as n from (select distinct a from t where a is not null) x, (select distinct a from t where a is not null) y)"


def _matrix(s, d):
    says = F.when(F.col("answer").rlike("(cannot|unable|not able|decline|does not contain|not enough|no answer)"), "abstain").otherwise("answer")
    t = table(s, d, RERUN).select("expected_behavior", says.alias("said"))
    return metrics.confusion(t, "expected_behavior", "said", t.select(F.col("expected_behavior").alias("class")).where("class is not null"))


@query(f"with {_CASES}, {_CELLS} select * from m")
def a19_confusion(s, d):
    return _matrix(s, d)


@query(f"""with {_CASES}, {_CELLS}, c as (select actual, n, sum(n) over (partition by actual) as support, sum(n) over (partition by predicted) as named, predicted from m),
x as (select actual as class, case when named = 0 then 0 else n / named end as p, case when support = 0 then 0 else n / support end as r, support from c where actual = predicted)
select class, round(p, 9) as precision, round(r, 9) as recall, round(case when p + r = 0 then 0 else 2 * p * r / (p + r) end, 9) as f1, support::bigint as support from x""")
def a20_class_scores(s, d):
    return metrics.scores(_matrix(s, d))


_RATE = f"t as (select (case_status = 'PASS')::int as a, (len(malformed_citation_attempts) = 0)::int as b from {RERUN})"


@query(f"""with {_RATE}, x as (select count(*) as n, count(*) filter (a = b) as same, sum(a) as pa, sum(b) as pb, count(*) filter (a > b) as over, count(*) filter (a < b) as under from t where a is not null and b is not null),
y as (select *, (pa * pb + (n - pa) * (n - pb)) / (n * n) as pe from x)
select n, round(same / n, 9) as agreement, round(case when pe >= 1 then 1 else (same / n - pe) / (1 - pe) end, 9) as kappa, over, under from y""")
def a21_agreement(s, d):
    # size(null) is -1 or null by setting; the case says what is meant.
    clean = F.when(F.col("malformed_citation_attempts").isNotNull(), (F.size("malformed_citation_attempts") == 0).cast("int"))
    return metrics.kappa(table(s, d, RERUN).select((F.col("case_status") == "PASS").cast("int").alias("a"), clean.alias("b")), "a", "b")


@query()
def d23_bootstrap(s, d):
    return metrics.bootstrap(metrics.retrieval(_knn(s, d, 10), _relevant(s, d), 10), "query_id", "ndcg")


# --- samples and splits

_SHA = "sha256(cast(o_orderkey as varchar) || chr(0) || 'sample')"


def _order_key():
    return sampling.selection_key(F.col("o_orderkey").cast("string"), "sample")


@query(f"select o_orderkey, {_SHA} as selection_key from orders order by selection_key limit 200")
def o5_sha_sample(s, d):
    return sampling.first_n(table(s, d, "orders").select("o_orderkey"), _order_key(), 200)


@query(f"select o_orderkey, o_orderpriority, {_SHA} as selection_key, row_number() over (partition by o_orderpriority order by selection_key) as place from orders qualify place <= 20")
def o7_stratified(s, d):
    return sampling.stratified(table(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", _order_key(), 20)


@query("select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) as rn from orders) where (rn - 1) % 50 = 0")
def o8_strided(s, d):
    return sampling.strided(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 50)


@query("""with c as (select form as name, count(*) as n from submissions where form is not null group by 1),
e as (select name, 1000 * n / sum(n) over () as exact from c),
f as (select name, floor(exact) as q, round(exact - floor(exact), 9) as rest from e)
select name, (q + (row_number() over (order by rest desc, name) <= 1000 - sum(q) over ())::int)::bigint as quota from f""")
def w14_quotas(s, d):
    counts = table(s, d, "submissions").where("form is not null").groupBy(F.col("form").alias("name")).agg(F.count("*").alias("n"))
    return sampling.quotas(counts, "name", 1000)


@query("select split, count(*) as documents from (select case when ('0x' || sha256(cast(doc_id as varchar))[1:8])::bigint / 4294967296.0 < 0.2 then 'dev' else 'test' end as split from documents) group by 1")
def d20_hash_split(s, d):
    return sampling.hash_split(table(s, d, "documents").select("doc_id"), F.col("doc_id").cast("string"), 0.2).groupBy("split").agg(F.count("*").alias("documents"))


def _company_edges(s, d):
    names = table(s, d, "submissions").where("cik is not null and name is not null")
    return names.select(F.concat(F.lit("c"), F.col("cik").cast("string")).alias("a"), F.concat(F.lit("n"), F.lower("name")).alias("b")).distinct()


@query("""with recursive e as (select distinct 'c' || cik as a, 'n' || lower(name) as b from submissions where cik is not null and name is not null),
b as (select a, b from e union select b, a from e),
r(node, reach) as (select a, a from b union select r.node, b.b from r join b on r.reach = b.a) select node, min(reach) as component from r group by 1""")
def d20_company_components(s, d):
    return sampling.components(_company_edges(s, d))


# --- documents, guards, streams

_STRIP = "regexp_replace({c}, '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g')"
_NL = "regexp_replace({c}, '\\r\\n?', chr(10), 'g')"


def _clean_sql(c):
    return _STRIP.format(c=_NL.format(c=c))


_LONG = " union all ".join(f"select filename as document_id, {i} as ordinal, 'item_{x}' as section_id, {_clean_sql('section_' + x)} as text from edgar" for i, x in enumerate(documents.SECTIONS))


@query(f"select document_id, ordinal, section_id, length(text) as chars, sha256(text) as mark from ({_LONG}) where length(text) > 0")
def d4_sections(s, d):
    return documents.sections(table(s, d, "edgar")).select("document_id", "ordinal", "section_id", F.length("text").alias("chars"), F.sha2("text", 256).alias("mark"))


@query(f"select document_id, sha256(string_agg('## Item ' || upper(section_id[6:]) || chr(10) || chr(10) || text, chr(10) || chr(10) order by ordinal) || chr(10)) as mark, count(*)::int as headings from ({_LONG}) where length(text) > 0 group by 1 union all select filename, null, 0 from edgar where not coalesce({' or '.join(f'''length({_clean_sql('section_' + x)}) > 0''' for x in documents.SECTIONS)}, false)")
def d1_markdown(s, d):
    return documents.markdown(table(s, d, "edgar")).select("document_id", F.sha2("body", 256).alias("mark"), "headings")


def _windows_sql(size, overlap):
    stride = size - overlap
    return f"""with w as (select doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '') as w from documents where text is not null),
n as (select doc_id, w, unnest(range(0, greatest(0, ceil((len(w) - {size}) / {stride}.0))::bigint + 1)) as n from w where len(w) > 0)
select doc_id, n::int as ordinal, (n * {stride})::int as first_token, len(w[n * {stride} + 1:n * {stride} + {size}])::int as tokens, sha256(array_to_string(w[n * {stride} + 1:n * {stride} + {size}], ' ')) as mark from n"""


def _windows(s, d, size, overlap):
    return documents.token_windows(table(s, d, "documents"), "doc_id", "text", size, overlap).select("doc_id", "ordinal", "first_token", "tokens", F.sha2("chunk", 256).alias("mark"))


@query(_windows_sql(256, 0))
def d3_windows_256(s, d):
    return _windows(s, d, 256, 0)


@query(_windows_sql(256, 64))
def d3_windows_256_64(s, d):
    return _windows(s, d, 256, 64)


@query("select chunk_id, document_id || '::chunk' || ordinal as derived_id, sha256(document_id || chr(0) || 'config' || chr(0) || ordinal || chr(0) || text) as chunk_uid from chunks where text is not null")
def d3_chunk_uid(s, d):
    named = documents.chunk_uid(table(s, d, "chunks").where("text is not null").withColumnRenamed("chunk_id", "given"), "config")
    return named.select(F.col("given").alias("chunk_id"), F.col("chunk_id").alias("derived_id"), "chunk_uid")


@query("select document_id, count(*) as chunks, min(ordinal) as least, max(ordinal) as most from chunks group by 1 having min(ordinal) <> 0 or max(ordinal) + 1 <> count(*)")
def w8_ordinal_gaps(s, d):
    return documents.ordinal_gaps(table(s, d, "chunks"))


@query("""with h as (select evidence_id, chunk_id from evidence_records e join chunks c on e.document_id = c.document_id and length(raw_display_value) > 0 and contains(c.text, raw_display_value)),
g as (select evidence_id, count(*) as nodes, min(chunk_id) as node_id from h group by 1)
select evidence_id, case when nodes is null then 'none' when nodes = 1 then 'exact' else 'ambiguous' end as status, coalesce(nodes, 0) as nodes, case when nodes = 1 then node_id end as node_id from evidence_records left join g using (evidence_id)""")
def d9_evidence_alignment(s, d):
    evidence = table(s, d, "evidence_records").select("evidence_id", "document_id", F.col("raw_display_value").alias("needle"))
    return documents.aligned(evidence, table(s, d, "chunks").select("document_id", F.col("chunk_id").alias("node_id"), "text"))


@query(f"""with c as (select distinct case_id, supplied_chunk_ids as given, unnest(list_distinct(regexp_extract_all(answer, '\\[([^\\[\\]]+::chunk\\d+)\\]', 1))) as id from {RERUN} where answer is not null)
select case_id, count(*) as cited, count(*) filter (id not in (select chunk_id from chunks where chunk_id is not null)) as unknown, count(*) filter (not coalesce(list_contains(given, id), false)) as not_supplied from c group by 1""")
def d16_citation_verdicts(s, d):
    return guards.citation_verdicts(table(s, d, RERUN), table(s, d, "chunks"), "case_id", "answer", "supplied_chunk_ids")


@query("""with m as (select cik, doc_id, sha256(lower(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r]+', ' ', 'g')))) as mark from documents where cik is not null)
select doc_id, nullif(min(doc_id) over (partition by cik, mark), doc_id) as duplicate_of, count(*) over (partition by cik, mark) as copies from m""")
def w11_duplicate_collapse(s, d):
    docs = table(s, d, "documents").where("cik is not null").withColumn("place", F.col("doc_id"))
    return guards.collapse(docs, "cik", "place", "doc_id", "text")


@query("select event_id, user_id, event_type, coalesce(epoch(ts)::bigint - epoch(lag(ts) over (partition by user_id, event_type order by ts, event_id))::bigint <= 86400, false) as hit from events")
def r14_cache_hits(s, d):
    return guards.cache_hits(table(s, d, "events"), ["user_id", "event_type"], "ts", 86400)


@query("select date_trunc('hour', ts) as window_start, event_type, count(*) as events, round(sum(value), 4) as total from events group by 1, 2")
def events_tumbling(s, d):
    return stream.tumbling(table(s, d, "events"))


@query("""with g as (select *, case when ts > lag(ts) over (partition by user_id order by ts) + interval 30 minutes then 1 else 0 end as fresh from events),
n as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as n from g)
select user_id, min(ts) as session_start, count(*) as events from n group by user_id, n""")
def events_sessions(s, d):
    return stream.sessions(table(s, d, "events"))


# --- matching and selection


@query("""with i as (select chunk_id as item_id, document_id, ordinal + 1 as page, text as needle from chunks where length(text) > 0),
h as (select item_id, page, c.ordinal as near from i join chunks c on i.document_id = c.document_id and c.ordinal between page - 1 and page + 1 and contains(c.text, needle)),
g as (select item_id, max((near = page)::int) as own, count(*) as n, min(near) as nat from h group by 1)
select item_id, case when own = 1 then 'stated' when n > 1 then 'ambiguous' when n = 1 then 'neighbour' else 'none' end as status, case when own = 1 then page when n = 1 then nat end as "at" from i left join g using (item_id)""")
def j22_neighbour_pages(s, d):
    c = table(s, d, "chunks")
    items = c.where("length(text) > 0").select(F.col("chunk_id").alias("item_id"), "document_id", (F.col("ordinal") + 1).alias("page"), F.col("text").alias("needle"))
    return matching.neighbour(items, c.select("document_id", F.col("ordinal").alias("page"), "text"))


@query()
def j25_companies_in_questions(s, d):
    names = table(s, d, "submissions").select("name", F.col("cik").alias("id"))
    return matching.gazetteer(table(s, d, RERUN), "case_id", "question", names)


@query(f"select sha256(lower(trim(regexp_replace(question, '[ \\t\\n\\r]+', ' ', 'g')))) as fingerprint, count(*) as n, min(case_id) as first from {RERUN} where question is not null group by 1 having count(*) > 1")
def d11_repeated_questions(s, d):
    return matching.repeated_texts(table(s, d, RERUN), "case_id", "question")


@query("""with c as (select case when o_orderpriority = '1-URGENT' then 'urgent' when o_orderstatus = 'F' then 'filled' else 'open' end as category, o_custkey, sha256(cast(o_orderkey as varchar) || chr(0) || 'pick') as k from orders),
a as (select 'urgent' as category, o_custkey, min(k) as selection_key from c where category = 'urgent' group by 2 order by 3, 2 limit 40),
b as (select 'filled' as category, o_custkey, min(k) as selection_key from c where category = 'filled' and o_custkey not in (select o_custkey from a) group by 2 order by 3, 2 limit 40),
e as (select 'open' as category, o_custkey, min(k) as selection_key from c where category = 'open' and o_custkey not in (select o_custkey from a union all select o_custkey from b) group by 2 order by 3, 2 limit 40)
select * from a union all select * from b union all select * from e""")
def o6_sequential_selection(s, d):
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").when(F.col("o_orderstatus") == "F", "filled").otherwise("open")
    c = table(s, d, "orders").select(kind.alias("category"), "o_custkey", sampling.selection_key(F.col("o_orderkey").cast("string"), "pick").alias("selection_key"))
    return matching.sequential(c, ["urgent", "filled", "open"], 40, "o_custkey")


@query("select o_orderkey, 'ord_' || o_orderstatus || '_' || case when n < 1000000 then lpad(cast(n as varchar), 6, '0') else cast(n as varchar) end as assigned_id from (select *, row_number() over (partition by o_orderstatus order by o_orderdate, o_orderkey) as n from orders)")
def o10_assigned_ids(s, d):
    return matching.numbered(table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate"), "o_orderstatus", ["o_orderdate", "o_orderkey"], "ord").select("o_orderkey", "assigned_id")


@query("""with recursive e as (select distinct 'c' || cik as a, 'n' || lower(name) as b from submissions where cik is not null and name is not null),
b as (select a, b from e union select b, a from e),
r(node, reach) as (select a, a from b union select r.node, b.b from r join b on r.reach = b.a), k as (select node, min(reach) as component from r group by 1)
select case when ('0x' || sha256(component)[1:8])::bigint / 4294967296.0 < 0.2 then 'dev' else 'test' end as split, count(*) as filings from submissions join k on node = 'c' || cik group by 1""")
def d20_component_split(s, d):
    found = sampling.components(_company_edges(s, d))
    keyed = table(s, d, "submissions").select(F.concat(F.lit("c"), F.col("cik").cast("string")).alias("node")).join(found, "node")
    return sampling.hash_split(keyed, F.col("component"), 0.2).groupBy("split").agg(F.count("*").alias("filings"))


@query("select count(*) as sampled, count(*) filter (found) as found from (select vec_id % 100 = 0 as s, true as found from embeddings) where s")
def r13_self_retrieval(s, d):
    """Every sampled vector finds itself, or one as near to within 1e-6, first."""
    v = table(s, d, "embeddings")
    hits = search.knn(v, v.where("vec_id % 100 = 0"), 5, _DIMS, skip_self=False)
    per = hits.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("best"), F.max(F.when(F.col("id") == F.col("query_id"), F.col("score"))).alias("own"))
    return per.agg(F.count("*").alias("sampled"), F.count_if(F.expr("best - own <= 1e-6")).alias("found"))


@query("select cast(cast(try_cast(cik as bigint) as bigint) as varchar) as cik, list_sort(list(distinct filename)) as filenames from edgar where try_cast(cik as bigint) is not null group by 1")
def d25_grouped_keys(s, d):
    e = table(s, d, "edgar").select(_integer("cik", "bigint").cast("string").alias("cik"), "filename").where("cik is not null")
    return e.groupBy("cik").agg(F.sort_array(F.collect_set("filename")).alias("filenames"))
