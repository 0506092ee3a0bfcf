"""Documents, sources and sinks on nulls, empty tables, ties and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import documents, evaluation, sampling
from tessera.sources import files, inline


def test_offsets_give_the_text_back(spark):
    rows = [(1, "a  b\tc\nd  e"), (2, "   "), (3, None), (4, ""), (5, "é" * 9 + " ü"), (6, " ".join(map(str, range(5000))))]
    df = spark.createDataFrame(rows, "k int, t string").withColumn("ordinal", F.lit("clash"))
    text = dict(rows)
    got = documents.offset_windows(df, "k", "t", 2, 1).collect()
    assert {r.k for r in got} == {1, 5, 6} and all(text[r.k][r.char_start : r.char_end] == r.chunk for r in got)
    assert [r.chunk for r in got if r.k == 1] == ["a  b", "b\tc", "c\nd", "d  e"] and sum(r.k == 6 for r in got) == 4999
    assert documents.offset_windows(df.limit(0), "k", "t", 2, 0).count() == 0
    with pytest.raises(ValueError):
        documents.offset_windows(df, "k", "t", 2, 2)


def test_front_matter_is_read_again(spark):
    df = spark.createDataFrame([('a"\\b.htm', 'x "y" \\ z', None), ("c.htm", None, "T")], "filename string, name string, section_1 string")
    for x in documents.SECTIONS[1:]:
        df = df.withColumn(f"section_{x}", F.lit(None).cast("string"))
    texts = documents.rendered(df, {"id": "filename", "name": "name"}).withColumnRenamed("document_id", "key")
    got = {r.key: r for r in documents.parsed(texts, "key", "text", ["id", "name", "other"]).collect()}
    assert all(k == r.id and r.other is None for k, r in got.items()) and got['a"\\b.htm'].name == 'x "y" \\ z' and got["c.htm"].name is None
    assert got["c.htm"].body == "## Item 1\n\nT\n" and got['a"\\b.htm'].body == ""


def test_table_parts_without_header_and_rows(spark):
    t = spark.createDataFrame([("a", 1, "1", False), ("a", 2, "2", False), ("b", 0, "h", True)], "k string, o int, t string, h boolean")
    assert [(r.k, r.part, r.table) for r in documents.table_parts(t, "k", "o", "t", "h", 1).orderBy("part").collect()] == [("a", 0, "| 1 |"), ("a", 1, "| 2 |")]


def test_hot_partition_values_are_split(spark, tmp_path):
    df = spark.createDataFrame([(i, "hot" if i % 3 else None) for i in range(90)], "n int, by string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are written by one task
    assert files.write_partitioned(df, str(tmp_path / "t"), ["by"], rows=10) is True
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 90 and len(list((tmp_path / "t" / "by=hot").glob("*.parquet"))) > 1
    assert files.write_partitioned(df, str(tmp_path / "t"), ["by"], rows=10) is False
    with pytest.raises(ValueError):
        files.write_partitioned(df.limit(5), str(tmp_path / "t"), ["by"])
    files.write_partitioned(df.limit(0), str(tmp_path / "e"), ["by"])


def test_damaged_markup_keeps_its_facts():
    facts = inline.facts_of("d", '<a><b>x<ix:nonFraction name="n" contextRef="q" scale="x">1</ix:nonFraction>')
    assert [(f[2], f[-2], f[-1]) for f in facts] == [("n", "1", "no_context")]
    assert inline.facts_of("d", "")[0][-1] == "not_parsed"
    entity = '<!DOCTYPE a [<!ENTITY e "boom">]><a><ix:nonFraction name="n">&e;</ix:nonFraction></a>'
    assert "boom" not in str(inline.facts_of("d", entity))


@pytest.mark.parametrize(("text", "form", "scale", "sign", "want"), [("1,234", None, 3, None, "1234000"), ("(7)", None, None, "-", "7"), ("no", "numwordsen", None, None, "0"), ("one hundred and two thousand five", "numwordsen", None, None, "102005"), ("x1", None, None, None, None), ("—", None, None, None, "0"), ("", None, None, None, None), ("12", None, -2, None, "0.12")])
def test_inline_numbers(text, form, scale, sign, want):
    assert inline.number_of(text, form, scale, sign) == want


def test_ranks_and_samples(spark):
    df = spark.range(1000).selectExpr("pmod(xxhash64(id), 700) as v", "id", "'x' as rank_")
    got = sampling.ranked(df.drop("rank_"), "v", "id").collect()
    assert [r["rank"] for r in sorted(got, key=lambda r: (r.v, r.id))] == list(range(1, 1001))
    some = [r.id for r in sampling.evenly(spark.range(101), ["id"], 11).orderBy("id").collect()]
    assert some == list(range(0, 101, 10)) and sampling.evenly(spark.range(3), ["id"], 11).count() == 3
    assert sampling.ranked(df.limit(0), "v").count() == 0 and sampling.evenly(df.limit(0), ["v"], 5).count() == 0
    p = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("b", 3, None), (None, 4, 1)], "s string, k int, n int")
    assert {r.k for r in sampling.pilot(p, "s", "k", "n").collect()} == {1, 2, 3, 4}


def test_backfill_and_balance(spark):
    df = spark.createDataFrame([("a", i) for i in range(3)] + [("b", 10 + i) for i in range(50)] + [(None, 99)], "s string, k int")
    quota = df.select("s").distinct().withColumn("quota", F.lit(10))
    got = sampling.filled_quotas(df, "s", "k", quota, 20, "p").collect()
    assert len(got) == 20 and sum(r.backfilled for r in got) == 7 and sum(r.s == "a" for r in got) == 3
    c = spark.createDataFrame([(f"c{i}", 1 + i % 7) for i in range(200)], "component string, weight int")
    split = sampling.balanced_split(c, 0.2)
    dev = split.where("split = 'dev'").agg(F.sum("weight")).first()[0]
    assert abs(dev / split.agg(F.sum("weight")).first()[0] - 0.2) < 0.03 and sampling.balanced_split(c.limit(0), 0.2).count() == 0


def test_leaks(spark):
    q = spark.createDataFrame([("What of Assets?", "Assets", None), ("What of 5?", "x", 5.0), ("What?", None, None), (None, "x", 1.0)], "question string, tag string, expected double")
    assert [(r.question, r.leaked) for r in evaluation.leaks(q, "question", ["tag", "expected"]).collect()] == [("What of Assets?", ["tag"])]


def test_gold_chunks_share_the_evidence(spark):
    words = [f"w{i:03d}" for i in range(60)]
    chunks = spark.createDataFrame([("d", 1, f"c{k}", " ".join(words[20 * k : 20 * k + 20])) for k in range(3)] + [("d", 1, "other", "none of it"), ("d", 2, "z", "far")], "document_id string, page int, chunk_id string, chunk string")
    items = [("whole", " ".join(words[22:30])), ("over", " ".join(words[8:45])), ("nothing", "absent"), ("begins alike", " ".join(words[8:18]) + " but ends otherwise")]
    df = spark.createDataFrame([(i, "d", 1, e) for i, e in items] + [("no page", "d", None, "x")], "item_id string, document_id string, page int, evidence_text string")
    got = {r.item_id: r.chunk_ids for r in documents.gold_chunks(df, chunks, 12).collect()}
    assert got == {"whole": ["c1"], "over": ["c0", "c1", "c2"], "nothing": ["c0", "c1", "c2", "other"], "begins alike": ["c0", "c1", "c2", "other"]}
