"""Queries of audits, samples, splits, metrics and evaluation sets, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import audit, evaluation, facts, matching, metrics, sampling
from tessera.operators import phrases as P
from tessera.plans.catalog import _CASES, _CELLS, _ELIGIBLE, _HITS, _MET, _REG, RERUN, _eligible, _knn, _matrix, _relevant
from tessera.plans.registering import registry
from tessera.session import table

QUERIES, ORACLE, query = registry()


# --- audits

SUITES = {
    "facts": {
        "adsh_form": ("adsh rlike '^[0-9]{10}-[0-9]{2}-[0-9]{6}$'", 0.01, 0.2), "tag_present": ("tag is not null and tag <> ''", 0.0, 0.05), "value_present": ("value is not null", 0.05, 0.3), "qtrs_not_negative": ("qtrs >= 0", 0.01, 0.1), "ddate_form": ("ddate rlike '^[0-9]{8}$'", 0.01, 0.1),
        "us_gaap": ("version like 'us-gaap/%'", 0.2, 0.9), "unit_present": ("uom is not null and trim(uom) <> ''", 0.02, 0.2), "undivided": ("coalesce(coreg, '') = '' and coalesce(segments, '') = ''", 0.5, 1.0),
    },
    "submissions": {"adsh_form": ("adsh rlike '^[0-9]{10}-[0-9]{2}-[0-9]{6}$'", 0.01, 0.2), "period_present": ("period is not null", 0.01, 0.2), "period_form": ("period rlike '^[0-9]{8}$'", 0.01, 0.2), "fy_agrees": ("cast(fiscal_year as varchar(9)) = fy", 0.01, 0.2), "filed_after_period": ("filed >= period", 0.01, 0.2), "not_withdrawn": ("withdrawn_at is null", 0.01, 0.2)},
    "edgar": {"cik_digits": ("cik rlike '^[0-9]+$'", 0.0, 0.1), "year_digits": ("year rlike '^[0-9]{4}$'", 0.0, 0.1), "business_filled": ("length(trim(section_1)) > 0", 0.01, 0.2), "discussion_filled": ("length(trim(section_7)) > 0", 0.01, 0.2), "statements_filled": ("length(trim(section_8)) > 0", 0.05, 0.5)},
    "chunks": {"id_form": ("chunk_id rlike '::chunk[0-9]+$'", 0.0, 0.01), "ordinal_not_negative": ("ordinal >= 0", 0.0, 0.01), "text_filled": ("length(trim(text)) > 0", 0.0, 0.01), "company_present": ("company is not null", 0.01, 0.2), "config_hash_form": ("chunk_config_hash rlike '^[0-9a-f]+$'", 0.0, 0.5), "removed_after_indexed": ("removed_at is null or removed_at >= indexed_at", 0.0, 0.01), "id_names_document": ("chunk_id like concat(document_id, '::chunk%')", 0.0, 0.01), "year_plausible": ("fiscal_year between 1990 and 2030", 0.0, 0.01)},
    "documents": {"text_filled": ("length(trim(text)) > 0", 0.01, 0.1), "lang_known": ("lang in ('en', 'de', 'fr', 'es')", 0.01, 0.2), "length_agrees": ("n_chars = length(text)", 0.0, 0.01), "company_present": ("company is not null", 0.01, 0.2)},
    "evidence_records": {"accession_form": ("accession rlike '^[0-9]{10}-[0-9]{2}-[0-9]{6}$'", 0.01, 0.2), "display_filled": ("length(trim(raw_display_value)) > 0", 0.01, 0.2), "unit_present": ("canonical_unit is not null and canonical_unit <> ''", 0.05, 0.5), "node_filled": ("length(trim(node_text)) > 0", 0.05, 0.5), "year_in_window": ("fiscal_year between 2016 and 2020", 0.1, 0.6)},
}


def _duck(c: str) -> str:
    import re

    return re.sub(r"(\w+) rlike ('[^']*')", r"regexp_matches(\1, \2)", c)


def _levels(bad: str) -> str:
    return f"case when total = 0 then 'SKIP' when {bad} / total > fail then 'FAIL' when {bad} / total > warn then 'WARN' else 'PASS' end"


@query("with c as (" + " union all ".join(f"select '{t}' as suite, '{n}' as check_name, count(*) filter (not coalesce({_duck(c)}, false)) as bad, count(*) as total, {w}::double as warn, {f}::double as fail from {t}" for t, cs in SUITES.items() for n, (c, w, f) in cs.items()) + f") select suite, check_name, bad, total, {_levels('bad')} as level from c")
def audit_suites(s, d):
    """The checks of every table, each table read once."""
    out = None
    for name, checks in SUITES.items():
        part = audit.suite(table(s, d, name), name, checks)
        out = part if out is None else out.unionByName(part)
    return out


_CROSS = [("facts", "adsh", "submissions", "adsh"), ("evidence_records", "accession", "submissions", "adsh"), ("chunks", "document_id", "edgar", "filename"), ("evidence_records", "document_id", "edgar", "filename"), ("subject_labels", "doc_id", "documents", "doc_id")]


@query(" union all ".join(f"select '{c}.{ck}' as reference, count({ck}) as with_key, count(*) filter ({ck} is not null and {ck} in (select {pk} from {p} where {pk} is not null)) as found from {c}" for c, ck, p, pk in _CROSS))
def audit_cross_source(s, d):
    """How many references of each kind have a key, and how many of these exist."""
    out = None
    for child, ck, parent, pk in _CROSS:
        part = audit.integrity(table(s, d, child).select(F.col(ck).alias("__k")), table(s, d, parent).select(F.col(pk).alias("__p")), "__k", "__p").select(F.lit(f"{child}.{ck}").alias("reference"), "with_key", "found")
        out = part if out is None else out.unionByName(part)
    return out


_GRAIN = ["adsh", "tag", "ddate", "qtrs", "uom"]


@query(f"select count(distinct ({', '.join(_GRAIN)})) as tuples from facts")
def a2_distinct_grains(s, d):
    return audit.distinct_tuples(table(s, d, "facts"), _GRAIN)


@query("select tag, count(*) as facts, count(distinct adsh) as filings, count(distinct cik) as companies, count(distinct value) as values from facts where tag is not null group by 1")
def a6_multi_distinct(s, d):
    return table(s, d, "facts").where("tag is not null").groupBy("tag").agg(F.count("*").alias("facts"), F.countDistinct("adsh").alias("filings"), F.countDistinct("cik").alias("companies"), F.countDistinct("value").alias("values"))


@query("select cik, count(distinct name) as values, max(name) as greatest from submissions group by 1 having count(distinct name) > 1")
def a11_inconsistent_names(s, d):
    return audit.inconsistent(table(s, d, "submissions"), "cik", "name")


_SORTED = "r as (select section_id, n_chars, row_number() over (partition by section_id order by n_chars) - 1 as i, count(*) over (partition by section_id) as n from documents where n_chars is not null)"


@query(f"with {_SORTED} select section_id, max(n_chars) filter (i = floor(n * 0.5)) as p50, max(n_chars) filter (i = floor(n * 0.95)) as p95 from r group by 1")
def a12_share_of_count(s, d):
    return audit.percentiles(table(s, d, "documents"), "section_id", "n_chars", {"p50": 0.5, "p95": 0.95}, "share_of_count")


@query(f"with {_SORTED} select section_id, max(n_chars) filter (i = floor(0.95 * (n - 1))) as p95 from r group by 1")
def a12_share_of_last(s, d):
    return audit.percentiles(table(s, d, "documents"), "section_id", "n_chars", {"p95": 0.95}, "share_of_last")


@query(f"with {_SORTED} select section_id, max(n_chars) filter (i = round_even(0.5 * (n - 1), 0) and n >= 20) as p50, max(n_chars) filter (i = round_even(0.99 * (n - 1), 0) and n >= 20) as p99 from r group by 1")
def a12_latency_percentiles(s, d):
    return audit.percentiles(table(s, d, "documents"), "section_id", "n_chars", {"p50": 0.5, "p99": 0.99}, least=20)


@query("select section_id, median(n_chars)::double as median from documents where n_chars is not null group by 1")
def a12_medians(s, d):
    return audit.medians(table(s, d, "documents"), "section_id", "n_chars")


@query("""with c as (select count(*) as n from facts where cik is not null group by cik),
r as (select n, row_number() over (order by n) - 1 as i, count(*) over () as k from c)
select min(n) as least, max(n) filter (i = floor(k * 0.5)) as median, max(n) filter (i = floor(k * 0.95)) as p95, max(n) as most, count(*) as keys from r""")
def a24_facts_per_company(s, d):
    return audit.spread(table(s, d, "facts"), "cik")


@query("select name, max_by(cik, cik) as cik from (select name, cik, row_number() over (partition by name order by loaded_at desc nulls last, cik desc) as r from submissions where name is not null) where r = 1 group by 1")
def a15_last_name_wins(s, d):
    """The company of a name by its latest delivery, the greater number of equals."""
    return audit.latest(table(s, d, "submissions").where("name is not null"), "name", ["loaded_at", "cik"], ["loaded_at", "cik"]).select("name", "cik")


@query(f"with a as (select (case_status = 'PASS') as ok from {RERUN}) select round(count(*) filter (coalesce(ok, false)) / count(*), 9) as rate, count(*) filter (coalesce(ok, false)) as hits, count(*) as total from a")
def a16_pass_rate(s, d):
    return metrics.rate(table(s, d, RERUN).select((F.col("case_status") == "PASS").alias("ok")), "ok")


_STATES = ("full", "partial", "none", "na")
_STATE = "case when citation_checks is null then 'na' when len(citation_checks) = 0 then 'none' when len(list_filter(citation_checks, lambda c: coalesce(c.was_supplied, false))) = len(citation_checks) then 'full' when len(list_filter(citation_checks, lambda c: coalesce(c.was_supplied, false))) > 0 then 'partial' else 'none' end"


@query(f"with c as (select expected_behavior, {_STATE} as state from {RERUN}) select expected_behavior, " + ", ".join(f"count(*) filter (state = '{x}') as {x}" for x in _STATES) + " from c group by 1")
def a18_citation_coverage(s, d):
    given = F.size(F.filter("citation_checks", lambda c: F.coalesce(c["was_supplied"], F.lit(False))))
    state = F.when(F.col("citation_checks").isNull(), "na").when(F.size("citation_checks") == 0, "none").when(given == F.size("citation_checks"), "full").when(given > 0, "partial").otherwise("none")
    return metrics.coverage(table(s, d, RERUN).select("expected_behavior", state.alias("state")), "expected_behavior", "state", _STATES)


@query(f"""with {_CASES}, {_CELLS}, c as (select actual, predicted, n, sum(n) over (partition by actual) as support, sum(n) over (partition by predicted) as named from m),
x as (select case when named = 0 then 0 else n / named end as p, case when support = 0 then 0 else n / support end as r from c where actual = predicted)
select (select round(sum(n) filter (actual = predicted) / sum(n), 9) from m) as accuracy, round(avg(round(case when p + r = 0 then 0 else 2 * p * r / (p + r) end, 9)), 9) as macro_f1 from x""")
def a20_overall(s, d):
    return metrics.overall(_matrix(s, d))


# --- retrieval metrics of two systems: all vectors, and those of the first five labels




_REL = "r as (select x.vec_id as query_id, y.vec_id as id from embeddings x join embeddings y on x.label = y.label and x.vec_id <> y.vec_id where x.vec_id % 100 = 0)"
_FIRST = f"{_HITS}, {_REL}, q as (select distinct query_id from r), a as (select query_id, min(rank) as a from h join r using (query_id, id) where rank <= 2 group by 1), b as (select query_id, min(rank) as b from h join r using (query_id, id) group by 1)"


@query(f"with {_FIRST} select case when a is null and b is null then 'never' when a is null then 'only_after' when b is null then 'only_before' when b < a then 'earlier' when b > a then 'later' else 'same' end as outcome, count(*) as queries from q left join a using (query_id) left join b using (query_id) group by 1")
def a26_first_hits(s, d):
    """First hits among two neighbours against those among ten."""
    hits = _knn(s, d, 10)
    return metrics.first_hits(hits.where("rank <= 2"), hits, _relevant(s, d), 10)


@query(f"with {_MET}, t as (select query_id, round(coalesce(count(*) filter (rank <= 2) / 2, 0), 9) as p from h join r using (query_id, id) group by 1), j as (select m.query_id, m.precision as b, coalesce(t.p, 0) as a from m left join t using (query_id)) select case when b > a then 'gain' when b < a then 'loss' else 'same' end as outcome, count(*) as n from j group by 1")
def j17_gains(s, d):
    """Precision of two neighbours against that of ten."""
    hits, rel = _knn(s, d, 10), _relevant(s, d)
    return metrics.gains(metrics.retrieval(hits, rel, 2), metrics.retrieval(hits, rel, 10), "query_id", "precision")


@query(f"with {_HITS}, x as (select h.query_id, h.rank, y.label as document_id, row_number() over (partition by query_id, y.label order by rank) as nth, z.label as own from h join embeddings y on y.vec_id = h.id join embeddings z on z.vec_id = h.query_id) select query_id, document_id, rank, (document_id = own and nth = 1)::int as gain from x")
def w4_first_occurrence(s, d):
    """Labels stand for documents: the first neighbour of a query's own label counts, further ones do not."""
    labels = table(s, d, "embeddings").select("vec_id", "label")
    hits = _knn(s, d, 10).join(labels.select(F.col("vec_id").alias("id"), F.col("label").alias("document_id")), "id")
    return metrics.first_occurrence(hits, labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("document_id")), 10)


@query("select true as inside, true as ordered")
def d23_paired_bootstrap(s, d):
    """The interval of the paired difference of two systems holds the difference; the bounds themselves depend on the random stream."""
    hits, rel = _knn(s, d, 10), _relevant(s, d)
    paired = metrics.deltas(metrics.retrieval(hits, rel, 10), metrics.retrieval(hits, rel, 3), "query_id", "ndcg")
    return metrics.bootstrap(paired, "query_id", "delta").select(F.expr("delta between low and high").alias("inside"), F.expr("low <= high").alias("ordered"))


@query("select * from (values ('d', 1), ('b', 2), ('a', 3), ('c', 4)) t(row_id, place)")
def o11_quality_ranks(s, d):
    rows = [("a", 0.9, 0.5, 0.5, 0.8, 100, "section_aware"), ("b", 0.9, 0.5, 0.5, 0.8, 100, "fixed"), ("c", 0.8, 0.9, 0.9, 0.9, 10, "fixed"), ("d", 0.9, 0.6, 0.5, 0.8, 900, "fixed")]
    systems = s.createDataFrame(rows, "row_id string, recall_50 double, mrr double, ndcg_10 double, recall_10 double, chunk_count int, split_mode string")
    for c in metrics.ECONOMY[1:]:
        systems = systems.withColumn(c, F.lit(0))
    return metrics.by_quality(systems).select("row_id", "place")


_ROUNDS = [
    ("reference is best", "r", "best", 0.9, 0.8, (-3, (-0.2, -0.1), (-0.2, -0.1))), ("practical tie", "x", "economy", 0.9, 0.91, (1, (-0.1, 0.1), (-0.1, 0.1))), ("improvement", "x", "improvement", 0.8, 0.95, (9, (0.1, 0.2), (0.1, 0.2))), ("regression", None, "regression", 0.8, 0.95, (9, (-0.3, -0.1), (-0.1, 0.1))),
]


@query("select * from (values " + ", ".join(f"('{n}', {'null' if w is None else repr(w)}, '{why}')" for n, w, why, *_ in _ROUNDS) + ") t(case_name, winner, reason)")
def d24_round_winners(s, d):
    """The system x against the reference r, which needs more chunks."""
    out = []
    for name, _, _, ref, other, (hits, mrr, ndcg) in _ROUNDS:
        both = [{"row_id": i, "recall_50": q, "mrr": q, "ndcg_10": q, "recall_10": q, "chunk_count": n} for i, q, n in (("r", ref, 200), ("x", other, 100))]
        out.append((name, *metrics.winner(both, "r", {"x": {"recall_hits": hits, "mrr": mrr, "ndcg": ndcg}})))
    return s.createDataFrame(out, "case_name string, winner string, reason string")


# --- samples and splits


@query("select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) - 1 as i, count(*) over () as n from orders) where i in (select round_even(k * (n - 1) / 49.0, 0)::bigint from range(50) t(k))")
def o9b_evenly_spaced(s, d):
    return sampling.evenly(table(s, d, "orders").select("o_orderkey"), ["o_orderkey"], 50)


@query("""select distinct doc_id from (select min(doc_id) as doc_id from documents group by section_id union all select first(doc_id order by n_chars, doc_id) from documents where n_chars > 0 union all select first(doc_id order by n_chars desc, doc_id desc) from documents where n_chars > 0 union all select min(doc_id) from documents where coalesce(n_chars, 0) = 0) where doc_id is not null""")
def o9_pilot(s, d):
    return sampling.pilot(table(s, d, "documents"), "section_id", "doc_id", "n_chars")


@query("select 300::bigint as rows, true as again")
def o4_hash_sample(s, d):
    """300 orders, and the same ones when drawn again from the table in another order."""
    orders = table(s, d, "orders").select("o_orderkey")
    one, two = sampling.hash_sample(orders, "o_orderkey", 300, 7), sampling.hash_sample(orders.repartition(5), "o_orderkey", 300, 7)
    return one.withColumn("a", F.lit(1)).join(two.withColumn("b", F.lit(1)), "o_orderkey", "full_outer").agg(F.count("a").alias("rows"), (F.count_if(F.expr("a is null or b is null")) == 0).alias("again"))




@query("""with u as (select adsh, min(form) as form from submissions where form is not null group by 1),
k as (select *, row_number() over (partition by form order by sha256('draw' || chr(0) || form || chr(0) || adsh), adsh) as place from u),
t as (select adsh, form, false as backfilled from k where place <= 30),
r as (select adsh, form, true as backfilled, row_number() over (order by sha256('draw backfill' || chr(0) || adsh), adsh) as n from k where adsh not in (select adsh from t)) select * from t union all select adsh, form, backfilled from r where n <= 120 - (select count(*) from t)""")
def o7_backfilled(s, d):
    forms = table(s, d, "submissions").where("form is not null").groupBy("adsh").agg(F.min("form").alias("form"))
    quota = forms.select("form").distinct().withColumn("quota", F.lit(30))
    return sampling.filled_quotas(forms, "form", "adsh", quota, 120, "draw")


@query("""with recursive c as (select cik::varchar as component, count(*) as weight from submissions where cik is not null group by 1),
o as (select *, row_number() over (order by sha256('balance' || chr(0) || component), component) as n, sum(weight) over () as total from c),
w as (select *, round_even(0.2 * total, 0)::bigint as dev from o),
s(n, component, weight, split, d, t) as (select n, component, weight, 'dev', weight::bigint, 0::bigint from w where n = 1 union all
select w.n, w.component, w.weight, case when s.d / w.dev <= s.t / (w.total - w.dev) then 'dev' else 'test' end, s.d + case when s.d / w.dev <= s.t / (w.total - w.dev) then w.weight else 0 end, s.t + case when s.d / w.dev <= s.t / (w.total - w.dev) then 0 else w.weight end from s join w on w.n = s.n + 1)
select component, weight, split from s""")
def w13_balanced_split(s, d):
    weights = table(s, d, "submissions").where("cik is not null").groupBy(F.col("cik").alias("component")).agg(F.count("*").alias("weight"))
    return sampling.balanced_split(weights, 0.2, "balance")


@query("select 0::bigint as both, 0::bigint as missing, 0::bigint as extra")
def t4_split_completeness(s, d):
    keyed = table(s, d, "submissions").select(F.col("cik").cast("string").alias("k")).where("k is not null").distinct()
    split = sampling.hash_split(keyed, F.col("k"), 0.2)
    return sampling.completeness(keyed, split.where("split = 'dev'").select("k"), split.where("split = 'test'").select("k"), "k")


@query("select not exists ((select distinct cik from submissions where cik is not null) except (select distinct cik from facts where cik is not null)) and not exists ((select distinct cik from facts where cik is not null) except (select distinct cik from submissions where cik is not null)) as equal")
def t7_equal_sets(s, d):
    return evaluation.equal_sets(table(s, d, "submissions").select("cik"), table(s, d, "facts").select("cik"))


@query("""select adsh, tag, ddate, qtrs, uom from facts where value is null and adsh is not null and not exists (select 1 from facts g where g.value is not null and g.adsh = facts.adsh and g.tag = facts.tag and g.ddate = facts.ddate and g.qtrs = facts.qtrs and g.uom = facts.uom)""")
def j10_composite_anti(s, d):
    f = table(s, d, "facts").select(*_GRAIN, "value")
    return f.where("value is null and adsh is not null").drop("value").join(f.where("value is not null").drop("value"), _GRAIN, "left_anti")


_O1 = "select adsh, tag, ddate, qtrs, uom, value, row_number() over (order by adsh, tag, ddate, qtrs, uom) as place from e"


@query(f"with {_ELIGIBLE} {_O1}")
def o1_total_order(s, d):
    return sampling.ranked(_eligible(s, d).select(*_GRAIN, "value"), *_GRAIN).withColumnRenamed("rank", "place")


@query("select * from (values ('r1', 'complete', 10, 10), ('r2', 'partial', 7, 10), ('r3', 'running', 3, 10), ('r4', 'failed', 0, null)) t(run_id, status, written, expected)")
def s23_latest_status(s, d):
    rows = [("r1", 1, "running", 4, 10), ("r1", 2, "complete", 6, None), ("r1", 3, "failed", 0, None), ("r2", 1, "running", 7, 10), ("r2", 2, "complete", 0, None), ("r3", 1, "running", 3, 10), ("r4", 1, "running", 0, None), ("r4", 2, "failed", None, None)]
    return audit.latest_status(s.createDataFrame(rows, "run_id string, seq int, status string, written int, expected int"))


# --- evaluation sets

_LABELS = "l(tag, phrase, qtrs) as (values " + ", ".join(f"('{t}', '{(label[0].lower() + label[1:]).replace(chr(39), chr(39) * 2)}', {q})" for t, label, q, _ in P.CONCEPTS) + ")"
_ONE = "o as (select cik, tag, fiscal_year, min(adsh) as accession, min(value) as value from e group by all having min(value) = max(value))"


@query(f"""with {_ELIGIBLE}, {_LABELS}, {_ONE}, f as (select o.*, row_number() over (partition by cik, tag order by fiscal_year, accession) as nth from o),
p as (select *, row_number() over (partition by tag order by sha256(tag || chr(0) || cik), cik) as place from f where nth = 1)
select 'numeric' as category, tag, cik, fiscal_year, 'What was the amount of company ' || cik || '''s ' || phrase || case when qtrs = 0 then ' at the end of fiscal year ' else ' for fiscal year ' end || fiscal_year || '?' as question, value as expected from p join l using (tag) where place <= 20""")
def d21_numeric_questions(s, d):
    return evaluation.numeric_questions(_eligible(s, d), 20)


@query(f"""with {_ELIGIBLE}, {_LABELS}, {_ONE}, p as (select a.tag, a.cik, a.fiscal_year as year_a, b.value - a.value as expected, row_number() over (partition by a.tag order by sha256(a.tag || chr(0) || a.cik || chr(0) || a.fiscal_year), a.cik) as place from o a join o b on b.cik = a.cik and b.tag = a.tag and b.fiscal_year = a.fiscal_year + 1)
select 'comparative' as category, tag, cik, year_a, 'How much did company ' || cik || '''s ' || phrase || ' change from fiscal year ' || year_a || ' to fiscal year ' || (year_a + 1) || '?' as question, expected from p join l using (tag) where place <= 15""")
def d21_change_questions(s, d):
    return evaluation.change_questions(_eligible(s, d), 15)


@query(f"""with {_ELIGIBLE}, {_LABELS}, {_ONE}, n as (select *, row_number() over (partition by tag, fiscal_year order by sha256(tag || chr(0) || fiscal_year || chr(0) || cik), cik) as n from o),
p as (select a.tag, a.fiscal_year, a.cik as cik_a, b.cik as cik_b, case when a.value >= b.value then a.cik else b.cik end as expected,
row_number() over (partition by a.tag order by sha256(a.tag || chr(0) || a.fiscal_year || chr(0) || a.cik), a.cik) as place from n a join n b on a.tag = b.tag and a.fiscal_year = b.fiscal_year and b.n = a.n + 1 where a.n % 2 = 1)
select 'comparative' as category, tag, fiscal_year, cik_a, cik_b, 'Which company reported higher ' || phrase || ' for fiscal year ' || fiscal_year || ': company ' || cik_a || ' or company ' || cik_b || '?' as question, expected from p join l using (tag) where place <= 10""")
def d21_comparison_questions(s, d):
    return evaluation.comparison_questions(_eligible(s, d), 10)


@query(f"""with {_ELIGIBLE}, {_LABELS}, {_ONE}, c as (select tag, cik, max(fiscal_year) as fiscal_year from o group by all),
p as (select *, row_number() over (partition by tag order by sha256('unans_year' || chr(0) || tag || chr(0) || cik), cik) as place from c)
select 'unanswerable' as category, tag, cik, 2021 + place % 4 as fiscal_year, 'What was the amount of company ' || cik || '''s ' || phrase || case when qtrs = 0 then ' at the end of fiscal year ' else ' for fiscal year ' end || (2021 + place % 4) || '?' as question from p join l using (tag) where place <= 8""")
def d21_unanswerable_questions(s, d):
    return evaluation.unanswerable_questions(_eligible(s, d), 8)


@query(f"""select 0::bigint as leaks""")
def d10_question_leaks(s, d):
    """No question of the numeric set holds its concept's name or its expected value."""
    return evaluation.leaks(evaluation.numeric_questions(_eligible(s, d), 20), "question", ["tag", "expected"]).agg(F.count("*").alias("leaks"))


@query("select item_id, count(*) as documents from eval_items join documents on length(question) > 0 and contains(text, question) group by 1")
def d10_gold_leakage(s, d):
    """Documents that hold the question of an item word for word; the items are a fixed small table."""
    return evaluation.held(table(s, d, "documents"), table(s, d, "eval_items"), "item_id", "question").groupBy("item_id").agg(F.count("*").alias("documents"))


_ASKED = [("q1", "comparative", "cross_entity_comparison", "Assets", None, 2018, [(1, 2018), (2, 2018)]), ("q2", "comparative", "cross_entity_comparison", "Assets", None, 2018, [(2, 2018), (1, 2018)]), ("q3", "comparative", "year_over_year_difference", "Assets", 1, None, [(1, 2018), (1, 2019)]), ("q4", "comparative", "year_over_year_difference", "Assets", 1, None, [(1, 2019), (1, 2018)]), ("q5", "numeric", None, "Assets", 1, 2018, None), ("q6", "numeric", None, "Assets", 1, 2018, None), ("q7", "numeric", None, "Assets", 1, 2018, None)]


@query("select * from (values (2, 'q1'), (3, 'q5')) t(n, first)")
def d11_repeated_meaning(s, d):
    """Two comparisons of the same companies in another order, and three questions for the same amount; years the other way round differ."""
    asked = s.createDataFrame(_ASKED, "question_id string, category string, subtype string, tag string, cik bigint, fiscal_year int, operands array<struct<cik:bigint, fiscal_year:int>>")
    return matching.repeated_meaning(asked).select("n", "first")
