"""Queries of search: analysis, hybrid retrieval, reranking, results, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import fulltext, metrics, search
from tessera.plans.catalog import _BM25, _FULL, _HITS, _TOP, _bm25, _index, _knn, _relevant
from tessera.plans.registering import registry
from tessera.session import table

QUERIES, ORACLE, query = registry()

# (word, its stem)
_STEMS = [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("caress", "caress"), ("agreed", "agree"), ("feed", "feed"), ("plastered", "plaster"), ("bled", "bled"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflate"), ("troubled", "trouble"), ("sized", "size"), ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"), ("filing", "fil"), ("happy", "happi"), ("sky", "sky"), ("2019", "2019")]


@query("select * from (values " + ", ".join(f"('{a}', '{b}')" for a, b in _STEMS) + ") t(word, stem)")
def r6_stems(s, d):
    return s.createDataFrame([(w, fulltext.stemmed(w)) for w, _ in _STEMS], "word string, stem string")


@query("select * from (values (1, 'the ''umsatz'' of 2019'), (2, 'net income'), (3, null), (4, null)) t(id, query)")
def r7_sanitised(s, d):
    out = []
    for i, q in enumerate(("the 'umsatz' of \"2019\"", ' "net income" ', '""', None), 1):
        try:
            out.append((i, fulltext.sanitized(q)))
        except (TypeError, ValueError):
            out.append((i, None))
    return s.createDataFrame(out, "id int, query string")


_FOLDED = "regexp_extract_all(translate(replace(replace(replace(lower(text), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ', 'aaaaaaceeeeiiiinoooooouuuuyy'), '[a-z0-9]+')"
_STOPS = "(" + ", ".join(f"'{w}'" for w in "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()) + ")"


@query(f"select term, count(*) as df, sum(tf)::bigint as tf from (select doc_id, term, count(*) as tf from (select doc_id, unnest({_FOLDED}) as term from documents where text is not null) where length(term) between 1 and 40 and term not in {_STOPS} group by all) group by 1")
def r6_folded_terms(s, d):
    """Terms with marks folded and stop words left out."""
    return _index(s, d, fulltext.Analysis(fold=True, stop=True)).postings().groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


# The embedding in SQL: a row a text and dimension.
_PLACE = "(('0x' || md5(term)[1:6])::bigint % 64)", "(case when ('0x' || md5(term)[7])::int < 8 then 1 else -1 end)"


def _vectors(table_sql: str) -> str:
    return f"select id, dim, sum(w) as w from (select id, {_PLACE[0]} as dim, {_PLACE[1]} * (1 + ln(tf)) as w from (select id, term, count(*) as tf from (select id, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) as term from ({table_sql})) where length(term) <= 40 group by all)) group by all"


_DENSE = f"""dv as ({_vectors("select doc_id as id, text as t from documents where text is not null")}),
qv as ({_vectors("select row_number() over (order by subject) as id, description as t from subjects")}),
dn as (select id, sqrt(sum(w * w)) as n from dv group by 1), qn as (select id, sqrt(sum(w * w)) as n from qv group by 1),
cs as (select qv.id as query_id, dv.id as id, sum(qv.w * dv.w) as dot from qv join dv using (dim) group by 1, 2),
zs as (select qn.id as query_id, t.doc_id as id, coalesce(dot / nullif(qn.n * dn.n, 0), 0) as c from qn cross join (select doc_id from documents where text is not null) t left join dn on dn.id = t.doc_id left join cs on cs.query_id = qn.id and cs.id = t.doc_id),
o as (select query_id, row_number() over (partition by query_id order by round(c, 9) desc, id) as rank, id as doc_id, round(c, 6) as score from zs qualify rank <= 50)"""


def _questions(s, d):
    return table(s, d, "subjects").withColumn("query_id", F.expr("row_number() over (order by subject)").cast("bigint"))  # ten rows


def _dense(s, d, k=50):
    vectors = fulltext.embedded(table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id", "text")
    asked = fulltext.embedded(_questions(s, d).select(F.col("query_id").alias("vec_id"), F.col("description").alias("t")), "vec_id", "t", kind="query")
    return search.knn(vectors, asked, k, 64, skip_self=False)


@query(f"with {_DENSE} select query_id, rank, doc_id as id, score from o")
def d6_dense_search(s, d):
    return _dense(s, d)


_FUSED = _FULL + """, fs as (select *, coalesce(1 / (60.0::double + dense_rank), 0) + coalesce(1 / (60.0::double + sparse_rank), 0) as sc from f),
fr as (select query_id, row_number() over (partition by query_id order by round(sc, 12) desc, least(coalesce(dense_rank, 1e9), coalesce(sparse_rank, 1e9)), coalesce(dense_rank, 1e9), coalesce(sparse_rank, 1e9), id) as rank, id, dense_rank, sparse_rank, round(sc, 9) as score from fs qualify rank <= 50)"""


@query(f"with {_BM25}, {_DENSE}, {_FUSED} select * from fr")
def r9_hybrid(s, d):
    """Fifty neighbours by embedding and fifty texts by BM25, fused."""
    return search.fuse(_dense(s, d), _bm25(s, d).withColumnRenamed("doc_id", "id"))


@query(f"with {_HITS} select query_id, true as same from h group by 1")
def r11_same_candidates(s, d):
    """Ten neighbours in reverse order find the same ones."""
    hits, rel = _knn(s, d, 10), _relevant(s, d)
    turned = hits.withColumn("rank", F.lit(11) - F.col("rank"))
    return search.same_candidates(hits, turned, rel, 10).select("query_id", "same")


@query(f"with {_BM25} select query_id, rank, 'documents::' || b.doc_id as citation_id, coalesce(nullif(trim(company), ''), 'CIK ' || cik) as company, sha256(text) as mark, score from b join documents d on d.doc_id = b.doc_id")
def r12_results(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.lit("documents").alias("document_id"), F.col("doc_id").cast("string").alias("local_id"), "company", "cik", "text")
    return search.shaped(_bm25(s, d).withColumnRenamed("doc_id", "id"), docs).select("query_id", "rank", "citation_id", "company", F.sha2("text", 256).alias("mark"), "score")


@query(f"with {_HITS}, {_TOP}, g as (select query_id, (x.label = y.label) as good from h join embeddings x on x.vec_id = query_id join embeddings y on y.vec_id = id where rank = 1), z as (select c.query_id, good, top1 < 0.5 as refused from c join g using (query_id)) select case when good and not refused then 'answered' when not good and refused then 'true_refusal' when good and refused then 'false_refusal' else 'missed_refusal' end as outcome, count(*) as queries from z group by 1")
def r15_refusals(s, d):
    features = search.refused(search.confidence(_knn(s, d, 10)), 0.5)
    labels = table(s, d, "embeddings").select("vec_id", "label")
    first = _knn(s, d, 1).join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("a")), "query_id").join(labels.select(F.col("vec_id").alias("id"), F.col("label").alias("b")), "id").select("query_id", (F.col("a") == F.col("b")).alias("good"))
    j = features.join(first, "query_id")
    return j.groupBy(metrics.refused_rightly(F.col("good"), F.col("refused")).alias("outcome")).agg(F.count("*").alias("queries"))
