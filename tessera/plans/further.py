"""Queries of evidence pages, section windows, detected sections, prompts, telemetry and small rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import cache
from tessera.operators import documents, evaluation, guards, metrics, sampling, security
from tessera.plans.catalog import _BM25, _LONG, RERUN, _bm25, _integer
from tessera.plans.contracts import _POISON, _examples, _expected
from tessera.plans.corpus import _outcome
from tessera.plans.registering import registry
from tessera.session import table

QUERIES, ORACLE, query = registry()

_SECTION_WORDS = "regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')"


@query(f"""with s as (select document_id, ordinal, section_id, len({_SECTION_WORDS}) as n from ({_LONG}) where length(text) > 0),
o as (select *, unnest(range(0, greatest(0, ceil((n - 64) / 64.0))::bigint + 1)) as k from s where n > 0)
select document_id, section_id, (row_number() over (partition by document_id order by ordinal, k) - 1)::int as ordinal, least(64, n - k * 64)::int as tokens from o""")
def d4_section_windows(s, d):
    return documents.section_windows(table(s, d, "edgar"), 64, 0).select("document_id", "section_id", "ordinal", "tokens")


# (order, kind, text, section)
_SEEN = [(0, "heading", "Item 1. Business (page 3)", None), (1, "heading", "Item 7A. Market risk (page 9)", None), (2, "text", "contents", None), (3, "heading", "ITEM 1. Business", "item_1"), (4, "text", "We sell.", "item_1"), (5, "heading", "Overview", "item_1"), (6, "text", "More.", "item_1"), (7, "heading", "Item 7A. Market risk", "item_7a"), (8, "table_row", "1 | 2", "item_7a")]


@query(_expected("source_order, section_id", [(r[0], r[3]) for r in _SEEN]))
def w5_last_heading_wins(s, d):
    nodes = _examples(s, [("d", *r[:3]) for r in _SEEN], "key string, source_order int, node_type string, text string")
    return documents.detected_sections(nodes).select("source_order", "section_id")


# pages of a document, and (item, stated page, evidence, status, page found)
_PAGES = [(1, "Revenue rose."), (2, "• Debt   fell\nin 2019."), (3, "Assets grew."), (4, "Assets grew."), (5, "x")]
_EVIDENCE = [("i1", 1, "Revenue rose", "exact", 1), ("i2", 2, "Debt fell in 2019.", "normalized", 2), ("i3", 2, "Revenue rose.", "adjacent", 1), ("i4", 9, "Assets grew.", "none", None), ("i5", 5, "Assets grew.", "adjacent", 4), ("i6", 1, " ", "none", None), ("i7", 1, None, "none", None)]


@query(_expected("item_id, status, page", [(i, st, p) for i, _, _, st, p in _EVIDENCE]))
def d9_evidence_pages(s, d):
    pages = _examples(s, [("d", *p) for p in _PAGES], "document_id string, page int, text string")
    items = _examples(s, [(i, "d", p, e) for i, p, e, _, _ in _EVIDENCE], "item_id string, document_id string, page int, evidence_text string")
    return documents.evidence_pages(items, pages)


@query("select chunk_id as item_id, [document_id || '::p' || lpad(ordinal::varchar, 4, '0') || '::chunk0'] as chunk_ids from chunks where len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')) between 1 and 60 and ordinal < 10000")
def d9_gold_chunks(s, d):
    """The evidence is the whole text of a page of at most a window, so its gold chunk is the page's first."""
    c = table(s, d, "chunks").where("ordinal < 10000")
    pages = c.select("document_id", F.col("ordinal").alias("page"), "text")
    short = c.where(F.size(F.regexp_extract_all("text", F.lit("([^ \\t\\n\\r\\f\\x0B]+)"))).between(1, 60))
    items = short.select(F.col("chunk_id").alias("item_id"), "document_id", F.col("ordinal").alias("page"), F.col("text").alias("evidence_text"))
    return documents.gold_chunks(items, documents.page_chunks(pages, 60, 0).select("document_id", "page", "chunk_id", "chunk"))


@query("select s.cik, s.fiscal_year, count(distinct s.adsh) as filings, min(s.name) as name from submissions s where exists (select 1 from edgar e where try_cast(e.cik as bigint) = s.cik and try_cast(e.year as int) = s.fiscal_year) group by 1, 2")
def j7_joined_population(s, d):
    """Companies and years that have a filing text, with their submissions."""
    e = table(s, d, "edgar").select(_integer("cik", "bigint").alias("cik"), _integer("year", "int").alias("fiscal_year")).distinct()
    return table(s, d, "submissions").join(e, ["cik", "fiscal_year"]).groupBy("cik", "fiscal_year").agg(F.countDistinct("adsh").alias("filings"), F.min("name").alias("name"))


_COLUMNS = ("chunk_id", "document_id", "cik", "company", "form_type", "fiscal_year", "ordinal", "text", "token_count", "chunk_config_hash", "indexed_at", "removed_at")


@query(" union all ".join(f"select '{c}' as field, count({c}) as present, round(count({c}) / nullif(count(*), 0), 9) as share from chunks" for c in _COLUMNS))
def a22_field_coverage(s, d):
    """How many rows have each field, in one pass."""
    one = table(s, d, "chunks").agg(*(F.count(c).alias(c) for c in _COLUMNS), F.count("*").alias("__all"))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("present"), F.round(F.col(c) / F.nullif(F.col("__all"), F.lit(0)), 9).alias("share")) for c in _COLUMNS))))


@query("select * from (values (2, 4, 1, 1)) t(hits, misses, expired, evicted)")
def a27_cache_counters(s, d):
    """Two places for ten seconds: a twice again in time, b beside it, c in the place of b, which is longest unused, and a once more, too late."""
    counts = cache.replay(["a", "a", "b", "a", "c", "a"], 2, 10, [0, 1, 2, 3, 4, 20])
    return s.createDataFrame([tuple(counts[k] for k in ("hits", "misses", "expired", "evicted"))], "hits int, misses int, expired int, evicted int")


@query(f"with {_BM25}, blocks as (select query_id, string_agg('<<<BEGIN_RETRIEVED_EVIDENCE chunk_id=''' || b.doc_id || '''>>>' || chr(10) || 'Chunk ID: ' || b.doc_id || chr(10) || 'Company: ' || coalesce(company, 'None') || ' | Fiscal Year: ' || coalesce(fiscal_year::varchar, 'None') || ' | Document: ' || coalesce(source, 'None') || chr(10) || text || chr(10) || '<<<END_RETRIEVED_EVIDENCE>>>', chr(10) || chr(10) order by rank) as blocks from b join documents d on d.doc_id = b.doc_id where rank <= 5 group by 1), qs as (select row_number() over (order by subject) as query_id, description from subjects) select query_id, sha256(coalesce(blocks || chr(10) || chr(10), '') || 'Question: ' || description) as mark from qs left join blocks using (query_id)")
def d26_prompts(s, d):
    """The prompt of each question: its five best texts as evidence blocks, then the question."""
    hits = _bm25(s, d, 5)
    docs = table(s, d, "documents").select("doc_id", "company", "fiscal_year", F.col("source").alias("document_id"), "text")
    evidence = hits.join(docs, "doc_id").withColumn("chunk_id", F.col("doc_id").cast("string"))
    questions = table(s, d, "subjects").withColumn("query_id", F.expr("row_number() over (order by subject)").cast("bigint"))  # ten rows
    return guards.prompts(questions, evidence, "query_id", "description", "rank").select("query_id", F.sha2("prompt", 256).alias("mark"))


# (got, want, unit got, unit wanted, match) and (now, then, state)
_MATCHES = [(5.0, 5.0, "USD", "USD", True), (5.0, 5.0, "USD", None, False), (5.0, 5.1, "USD", "USD", False), (None, 5.0, "USD", "USD", False), (5.0, 5.0, None, None, True)]
_DRIFTS = [(100.0, 100.0, "ok"), (104.0, 100.0, "ok"), (106.0, 100.0, "drifted"), (None, 1.0, "unknown"), (0.0, 0.0, "ok")]


@query(_expected("got, want, got_unit, want_unit, same", [(*r[:4], str(r[4]).lower()) for r in _MATCHES]).replace("'true'", "true").replace("'false'", "false"))
def numeric_match_examples(s, d):
    df = _examples(s, [r[:4] for r in _MATCHES], "got double, want double, got_unit string, want_unit string")
    return df.withColumn("same", metrics.numeric_match(F.col("got"), F.col("want"), F.col("got_unit"), F.col("want_unit")))


@query(_expected("now, earlier, state", _DRIFTS))
def drift_examples(s, d):
    df = _examples(s, [r[:2] for r in _DRIFTS], "now double, earlier double")
    return df.withColumn("state", metrics.drift(F.col("now"), F.col("earlier"), 0.05))


@query("select * from (values ('numeric', null, true), ('adversarial', 'advice', false), ('unknown', 'x', null)) t(category, subtype, applicable)")
def applicability(s, d):
    shapes = _examples(s, [("numeric", None, True), ("adversarial", "advice", False)], "category string, subtype string, applicable boolean")
    known = evaluation.applicability(_examples(s, [("numeric", None), ("adversarial", "advice")], "category string, subtype string"), shapes)
    other = _outcome(lambda: evaluation.applicability(_examples(s, [("unknown", "x")], "category string, subtype string"), shapes).collect())
    return known.unionByName(_examples(s, [("unknown", "x", None if other != "[]" and "Row" not in other else True)], "category string, subtype string, applicable boolean"))


@query("select * from (values (0, '1'), (2, '3'), (3, 'PermissionError')) t(before, number)")
def w12_access_budget(s, d):
    log = lambda n: _examples(s, [("held out",)] * n + [("other",)] * 5, "test_set string")
    return s.createDataFrame([(n, _outcome(lambda n=n: evaluation.next_access(log(n), "held out"))) for n in (0, 2, 3)], "before int, number string")


@query("select 250::bigint as rows, 250::bigint as different")
def o3_random_sample(s, d):
    """A sample that a seed decides: two seeds give different ones of the same size."""
    orders = table(s, d, "orders").select("o_orderkey")
    a = sampling.hash_sample(orders, "o_orderkey", 250, 1)
    return a.agg(F.count("*").alias("rows"), F.countDistinct("o_orderkey").alias("different"))


@query("select " + ", ".join(f"{sum(st == x for *_, st, _ in _POISON)}::bigint as {x}" for x in ("approved", "suspicious", "blocked")))
def security_telemetry(s, d):
    """Outcomes of the examples, summed as the guard counts them."""
    done = security.scanned(_examples(s, [(r[0], r[2]) for r in _POISON], "id string, text string"), "text")
    return done.agg(*(F.count_if(F.col("status") == x).alias(x) for x in ("approved", "suspicious", "blocked")))


_MARKED = f"select case_id, trim(regexp_replace(regexp_replace(answer, '(?m)^[ \\t]*[•●▪◦‣·*–—-][ \\t]+', ' ', 'g'), '\\s+', ' ', 'g')) as even from {RERUN} where answer is not null"


@query(f"select case_id, sha256(even) as mark from ({_MARKED} and not regexp_matches(answer, '[^\\x00-\\x7F]'))")
def even_texts(s, d):
    """Answers without list marks and with white space made even (plain ones: engines differ in what is white space beyond ASCII)."""
    even = documents.even_text(F.col("answer"))
    return table(s, d, RERUN).where(~F.col("answer").rlike("[^\\x00-\\x7F]")).select("case_id", F.sha2(even, 256).alias("mark"))
