import random
from datetime import datetime, timedelta

from tessera.operators import orphans

T0 = datetime(2020, 1, 1)


def test_runs_are_contiguous_and_bounded(spark):
    keys = [*range(10), 12, 13, *range(250, 600)]
    df = spark.createDataFrame([("s", k, T0, None) for k in keys * 2], "space string, key bigint, arrived timestamp_ntz, removed timestamp_ntz")
    rows = orphans.runs(df).collect()
    got = sorted((r.start, r.end) for row in rows for r in row.runs)
    assert got == [(0, 9), (12, 13), (250, 255), (256, 511), (512, 599)]


def test_against_brute_force(spark):
    rng = random.Random(3)
    parents, subs = {}, []
    for k in rng.sample(range(2000), 700):
        at, gone = T0 + timedelta(days=rng.randrange(400)), T0 + timedelta(days=rng.randrange(200, 900)) if rng.random() < 0.2 else None
        parents[k] = (at, gone)
        subs += [(f"0000000001-20-{k:06d}", at, gone)] * rng.choice((1, 1, 2))
    facts, want = [], set()
    for i in range(3000):
        k = 77 if i % 3 == 0 else rng.randrange(2100)  # a hot key
        at = T0 + timedelta(days=rng.randrange(800))
        plain = f"0000000001-20-{k:06d}"
        facts.append((i, rng.choice((plain, plain.replace("-", ""), f" {plain} ", plain.replace("-", "–"), f"[{plain}]")), at))
        kind = "missing" if k not in parents else "late" if parents[k][0] > at else "deleted" if parents[k][1] and parents[k][1] <= at else None
        if kind:
            want.add(("facts", str(i), plain, kind, at.strftime("%Y-%m")))
    facts += [(9001, None, T0), (9002, " ", T0), (9003, "x1", None)]
    f = spark.createDataFrame(facts, "fact_id bigint, adsh string, loaded_at timestamp_ntz").withColumn("extra", orphans.F.lit(1))
    s = spark.createDataFrame(subs, "adsh string, loaded_at timestamp_ntz, withdrawn_at timestamp_ntz").withColumn("extra", orphans.F.lit(2))
    got = {tuple(r) for r in orphans.fact_orphans(f, s).collect()}
    assert got == want | {("facts", "9003", "x1", "missing", None)}
    assert {tuple(r) for r in orphans.fact_orphans(f, s, hot=50).collect()} == got  # many buckets are salted
    assert orphans.fact_orphans(f.limit(0), s).count() == 0
    assert orphans.fact_orphans(f, s.limit(0)).count() == 3001


def test_chunk_keys(spark):
    c = spark.createDataFrame([("D.htm::chunk7", T0, None)], "chunk_id string, indexed_at timestamp_ntz, removed_at timestamp_ntz")
    rows = [("a", T0, [(x,) for x in ("d.htm::chunk007", "[D.htm：：Chunk7]", "d.htm::chunk8", " d.htm::chunk8", None)]), ("b", T0, None)]
    r = spark.createDataFrame(rows, "case_id string, run_ts timestamp_ntz, citation_checks array<struct<chunk_id:string>>")
    assert [tuple(x) for x in orphans.citation_orphans(r, c, "t").collect()] == [("t", "a", "d.htm::chunk8", "missing", "2020-01")]


def test_keys_without_integer_form_meet_the_same_text(spark):
    s = spark.createDataFrame([("ABC-1", T0 + timedelta(days=9), None), ("x2", T0, None)], "adsh string, loaded_at timestamp_ntz, withdrawn_at timestamp_ntz")
    f = spark.createDataFrame([(1, "[abc-1]", T0), (2, "x2", T0), (3, "x3", T0)], "fact_id bigint, adsh string, loaded_at timestamp_ntz")
    assert sorted(tuple(r) for r in orphans.fact_orphans(f, s).collect()) == [("facts", "1", "abc-1", "late", "2020-01"), ("facts", "3", "x3", "missing", "2020-01")]
