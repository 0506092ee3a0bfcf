from pyspark.sql import functions as F

from tessera.functions.cache import ResultCache, result_key
from tessera.operators import matching
from tessera.plans import catalog
from tessera.sources import inline


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_gazetteer_takes_the_longest(spark):
    names = spark.createDataFrame([("Acme Corp", 1), ("Acme Corp Holdings Inc.", 2), ("ACME CORP", 0), ("Beta", 3), (None, 4), ("", 5)], "name string, id bigint")
    texts = spark.createDataFrame([(1, "Did acme corp holdings inc and Beta, or Acme Corp. grow?"), (2, None), (3, ""), (4, "nothing")], "k int, t string")
    assert [(r[0], r[3]) for r in rows(matching.gazetteer(texts, "k", "t", names))] == [(1, 2), (1, 3), (1, 0)]


def test_gazetteer_finds_long_names(spark):
    long = "The First National Trust of the Holders of Common Shares of Acme"
    names = spark.createDataFrame([(long, 1), ("Acme", 2)], "name string, id bigint")
    texts = spark.createDataFrame([(1, f"Did {long.lower()} grow?"), (2, "Acme"), (3, "")], "k int, t string")
    assert [(r[0], r[1], r[3]) for r in rows(matching.gazetteer(texts, "k", "t", names))] == [(1, 2, 1), (2, 1, 2)]
    assert matching.gazetteer(texts, "k", "t", names.limit(0)).count() == 0


def test_neighbours(spark):
    pages = spark.createDataFrame([("d", 1, "alpha x"), ("d", 2, "beta"), ("d", 3, "alpha"), ("d", 4, None)], "document_id string, page int, text string")
    items = spark.createDataFrame([(1, "d", 2, "alpha"), (2, "d", 2, "beta"), (3, "d", 2, "x"), (4, "d", 2, "zz"), (5, "e", 1, "beta"), (6, "d", 2, None)], "item_id int, document_id string, page int, needle string")
    assert [r[1] for r in rows(matching.neighbour(items, pages))] == ["ambiguous", "stated", "neighbour", "none", "none", "none"]


def test_neighbour_query_looks_for_whole_texts(spark, tmp_path):
    head = "A table head that a filing repeats on every page, of more than sixty characters: "
    chunks = [("c0", "d", 0, head + "first"), ("c1", "d", 1, head + "second"), ("c2", "d", 2, head + "third"), ("c3", "d", 3, head + "third and more")]
    spark.createDataFrame(chunks, "chunk_id string, document_id string, ordinal int, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    assert rows(catalog.j22_neighbour_pages(spark, str(tmp_path))) == [("c0", "neighbour", 0), ("c1", "neighbour", 1), ("c2", "stated", 3), ("c3", "neighbour", 3)]


def test_selection_without_reuse(spark):
    c = spark.createDataFrame([("a", 1, "1"), ("a", 1, "2"), ("a", 2, "3"), ("b", 1, "0"), ("b", 3, "5")], "category string, e int, selection_key string")
    assert rows(matching.sequential(c, ["a", "b"], 1, "e").select("category", "e")) == [("a", 1), ("b", 3)]


def test_corrupted_numbers_keep_their_format(spark):
    df = spark.createDataFrame([("was $1,200.50 and 3",), ("none",), (None,), ("5",), ("0.1234567",)], "t string")
    assert [r[0] for r in df.select(matching.corrupted(F.col("t"))).collect()] == ["was $2,401.00 and 3", "none This was confirmed by the auditors.", None, "10", "0.12345670.1234567"]


def test_numbers_beyond_the_padding_stay_apart(spark):
    df = spark.range(250).selectExpr("id", "if(id % 2 = 0, 'a', null) as s", "'x' as assigned")
    got = matching.numbered(df, "s", ["id"], "p", digits=2)
    ids = {r.id: r.assigned_id for r in got.collect()}
    assert len(set(ids.values())) == 250 and ids[0] == "p_a_01" and ids[248] == "p_a_125" and ids[1] == "p__01"
    assert matching.numbered(df.limit(0), "s", ["id"], "p").count() == 0


def test_navigation_has_five_outcomes(spark):
    filings = spark.createDataFrame([("d1", 1, 2018), ("d2", 2, 2018), ("d3", 2, 2018), ("d4", 3, 2018), ("d5", None, 2018)], "document_id string, cik bigint, fiscal_year int")
    sections = spark.createDataFrame([("d1", "item_1", "ab"), ("d1", "item_1", "c"), ("d1", "item_7", "d")], "document_id string, section_id string, text string")
    asked = spark.createDataFrame([(1, 1, 2018, "item_1"), (2, 1, 2018, "item_9"), (3, 2, 2018, "item_1"), (4, 3, 2018, "item_1"), (5, 9, 2018, "item_1"), (6, None, None, None)], "request_id int, cik bigint, fiscal_year int, section_id string")
    got = {r.request_id: r for r in matching.navigate(asked, filings, sections).collect()}
    assert [got[i].outcome for i in range(1, 7)] == ["found", "section_not_found", "ambiguous", "filing_not_parsed", "not_found", "not_found"]
    assert (got[1].chars, got[1].nodes, got[1].all_nodes) == (3, 2, 3)


def test_questions_of_the_same_meaning(spark):
    op = "array<struct<cik:bigint, fiscal_year:int>>"
    q = [("q1", "comparative", "cross_entity_comparison", "Assets", None, 2018, [(1, 2018), (2, 2018)]), ("q2", "comparative", "cross_entity_comparison", "Assets", None, 2018, [(2, 2018), (1, 2018)]), ("q3", "comparative", "year_over_year_difference", "Assets", 1, None, [(1, 2018), (1, 2019)]), ("q4", "comparative", "year_over_year_difference", "Assets", 1, None, [(1, 2019), (1, 2018)]), ("q5", None, None, None, None, None, None)]
    df = spark.createDataFrame(q, f"question_id string, category string, subtype string, tag string, cik bigint, fiscal_year int, operands {op}")
    assert [(r.n, r.first) for r in matching.repeated_meaning(df).collect()] == [(2, "q1")]


XML = """<html xmlns:ix="x" xmlns:xbrli="y"><xbrli:context id="c"><xbrli:entity><xbrli:identifier>7</xbrli:identifier></xbrli:entity><xbrli:period><xbrli:startDate>2019-01-01</xbrli:startDate><xbrli:endDate>2019-12-31</xbrli:endDate></xbrli:period></xbrli:context>
<xbrli:unit id="u"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit><ix:nonFraction name="Assets" contextRef="c" unitRef="u" scale="3" sign="-">1,2</ix:nonFraction>
<ix:nonNumeric name="Note" contextRef="z" continuedAt="p">A</ix:nonNumeric><ix:continuation id="p" continuedAt="p">B</ix:continuation></html>"""


def test_inline_facts(spark):
    df = spark.createDataFrame([("d", XML), ("bad", "no markup"), ("n", None)], "id string, xml string")
    got = {(r.document_id, r.fact_order): r for r in inline.inline_facts(df, "id", "xml").collect()}
    a, n = got["d", 0], got["d", 1]
    assert (a.name, a.entity, a.end, a.unit, a.scale, a.sign, a.display, a.error) == ("Assets", "7", "2019-12-31", "iso4217:USD", 3, "-", "1,2", None)
    assert (n.display, n.error) == ("AB", "continuation_cycle") and got["bad", 0].error == "not_parsed" and len(got) == 3


def test_cache():
    now = [0.0]
    c = ResultCache(2, 10, lambda: now[0])
    key = result_key("v", " Net  income ", 5)
    assert key == result_key("v", "Net income", 5) != result_key("v", "Net income", 6)
    c.put(key, [1])
    c.get(key).append(2)
    assert c.get(key) == [1]
    c.put("b", 1)
    c.put("c", 1)
    assert c.get(key) is None
    now[0] = 11
    assert c.get("b") is None and c.counts == {"hits": 2, "misses": 2, "expired": 1, "evicted": 1}
