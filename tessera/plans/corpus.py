"""Queries of sources, sinks and documents, with their SQL: what is written is read again and compared with the table it came from."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from tessera.operators import audit, documents
from tessera.plans.catalog import _LONG, _clean_sql
from tessera.plans.contracts import _examples, _expected, _text
from tessera.plans.registering import registry
from tessera.session import table, with_checkpoints
from tessera.sources import files, inline

QUERIES, ORACLE, query = registry()


def _place(s, name: str) -> str:
    """A fresh place in the shared folder."""
    import uuid

    return f"{with_checkpoints(s)}/{name}-{uuid.uuid4().hex}"


# --- sources


@query("select cast(n_nationkey as varchar) as n_nationkey, n_name, cast(n_regionkey as varchar) as n_regionkey from nation")
def s2_tsv(s, d):
    """A table of text columns written with tabs and a header; a line of too few fields is left out."""
    at = _place(s, "tsv")
    table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey").write.csv(f"{at}/a", sep="\t", header=True)
    s.createDataFrame([("n_nationkey\tn_name\tn_regionkey",), ("99\tBROKEN",)], "line string").coalesce(1).write.text(f"{at}/b")
    return files.tsv(s, [f"{at}/a", f"{at}/b"], ["n_nationkey", "n_name", "n_regionkey"]).where("n_name is not null and n_regionkey is not null")


@query("select r_regionkey, r_name from region")
def s3_typed_tsv(s, d):
    at = _place(s, "typed")
    table(s, d, "region").select("r_regionkey", "r_name").write.csv(at, sep="\t")
    return files.typed_tsv(s, at, "r_regionkey int, r_name string")


@query("select cik, tag, value from facts where fiscal_year = 2018 and value is not null")
def s4_pruned_partition(s, d):
    """Facts written by fiscal year; one year's directory is read."""
    at = _place(s, "facts")
    files.write_partitioned(table(s, d, "facts").where("value is not null and fiscal_year is not null").select("cik", "tag", "value", "fiscal_year"), at, ["fiscal_year"])
    return files.partitioned(s, at, fiscal_year=2018).select("cik", "tag", "value")


@query("select n_name, count(*) as customers from customer join nation on c_nationkey = n_nationkey group by 1")
def s5_attached(s, d):
    files.attach(s, d, ["customer", "nation"], "attached_")
    return s.sql("select n_name, count(*) as customers from attached_customer join attached_nation on c_nationkey = n_nationkey group by n_name")


@query("select 'train' as split, doc_id from documents where doc_id % 2 = 0 union all select 'test', doc_id from documents where doc_id % 2 = 1")
def s6_labelled_union(s, d):
    docs = table(s, d, "documents").select("doc_id")
    return files.labelled_union({"train": docs.where("doc_id % 2 = 0"), "test": docs.where("doc_id % 2 = 1")})


@query("select * from (values ('num.txt', 3), ('sub.txt', 2)) t(member, lines)")
def s7_zip_members(s, d):
    """Of an archive of three members the two that are wanted."""
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, text in (("2019q1/num.txt", "a\nb\nc"), ("2019q1/sub.txt", "a\nb"), ("2019q1/readme.htm", "x")):
            z.writestr(name, text)
    at = _place(s, "zip")
    path = s._jvm.org.apache.hadoop.fs.Path(f"{at}/a.zip")
    out = path.getFileSystem(s._jsc.hadoopConfiguration()).create(path, False)
    out.write(bytearray(data.getvalue()))
    out.close()
    found = files.zip_members(s, f"{at}/*.zip", ("num.txt", "sub.txt"))
    return found.select(F.substring_index("member", "/", -1).alias("member"), F.size(F.split(F.col("content").cast("string"), "\n")).alias("lines"))


@query("select event_id, event_type, true as good from events union all select null, null, false from range(2)")
def s9_json_lines(s, d):
    """Events as JSON lines, with two lines that are none."""
    at = _place(s, "json")
    table(s, d, "events").select("event_id", "event_type").write.json(f"{at}/a")
    s.createDataFrame([('{"event_id": 1',), ("no json",)], "line string").write.text(f"{at}/b")
    good, bad = files.json_lines(s, f"{at}/*", "event_id bigint, event_type string")
    return good.withColumn("good", F.lit(True)).unionByName(bad.select(F.lit(None).cast("bigint").alias("event_id"), F.lit(None).cast("string").alias("event_type"), F.lit(False).alias("good")))


_REGISTRY = "Assets:\n  enabled: true\n  period_type: instant\n  qtrs: 0\n  unit: USD\n  label: Total assets\nRevenues:\n  enabled: false # off\n  period_type: duration\n  qtrs: 4\n  unit: USD\n"


@query("select * from (values ('Assets', true, 0, 'USD', 'Total assets'), ('Revenues', false, 4, 'USD', null)) t(name, enabled, quarters, unit, label)")
def s10_typed_registry(s, d):
    return files.typed_registry(s, _REGISTRY)


@query("select * from (values (false, 2, 2), (true, 1, 1)) t(empty, files, least_copies)")
def s13_file_inventory(s, d):
    """Two files of the same content and an empty one."""
    at = _place(s, "files")
    for name, text in (("a", b"same"), ("b", b"same"), ("c", b"")):
        path = s._jvm.org.apache.hadoop.fs.Path(f"{at}/{name}.htm")
        out = path.getFileSystem(s._jsc.hadoopConfiguration()).create(path, False)
        out.write(bytearray(text))
        out.close()
    return files.file_inventory(s, f"{at}/*.htm").groupBy("empty").agg(F.count("*").cast("int").alias("files"), F.min("copies").cast("int").alias("least_copies"))


# --- sinks


@query("select fiscal_year, count(*) as rows, sum(value) as total, true as again from facts where fiscal_year is not null group by 1")
def s15_partitioned_twice(s, d):
    """Facts by year, split among several writers a year, written a second time without change."""
    at = _place(s, "twice")
    rows = table(s, d, "facts").where("fiscal_year is not null").select("fact_id", "value", "fiscal_year")
    files.write_partitioned(rows, at, ["fiscal_year"], rows=200)
    kept = not files.write_partitioned(rows.repartition(3), at, ["fiscal_year"], rows=200)
    return s.read.parquet(at).groupBy("fiscal_year").agg(F.count("*").alias("rows"), F.sum("value").alias("total"), F.lit(kept).alias("again"))


@query("select count(*) as rows, true as bounded, true as hashed from documents")
def s17_shards(s, d):
    """Documents in shards of 40 rows at most, published as a whole, each with its hash."""
    at = _place(s, "shards")
    shards = files.write_shards(table(s, d, "documents").select("doc_id", "text").coalesce(2), at, 40)
    again = files.write_shards(table(s, d, "documents").limit(0), at, 40)  # what is there is kept
    marks = shards.join(again.select("shard", F.col("sha256").alias("again")), "shard").agg(F.count_if(F.col("sha256") == F.col("again")).alias("same"), F.count("*").alias("n"))
    sizes = s.read.parquet(at).groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.max("n").alias("most"))
    return sizes.join(marks, F.lit(True)).select("rows", (F.col("most") <= 40).alias("bounded"), (F.col("same") == F.col("n")).alias("hashed"))


def _outcome(f) -> str:
    try:
        return str(f())
    except Exception as e:
        return type(e).__name__


@query("select * from (values ('fresh', 'False'), ('same', 'True'), ('other', 'ValueError')) t(checkpoint, outcome)")
def s18_resumed(s, d):
    mine = files.identity({"size": 256, "mode": "fixed"})
    cases = (("fresh", None), ("same", files.identity({"mode": "fixed", "size": 256})), ("other", files.identity({"size": 512})))
    return s.createDataFrame([(n, _outcome(lambda i=i: files.resumable(i, mine))) for n, i in cases], "checkpoint string, outcome string")


@query("select count(*) as rows, 'ValueError' as repeated, 'ValueError' as twice, 'ValueError' as other_schema from submissions where adsh in (select adsh from submissions group by 1 having count(*) = 1)")
def s19_append_unique(s, d):
    at = _place(s, "append")
    one = table(s, d, "submissions").groupBy("adsh").agg(F.count("*").alias("n"), F.min("form").alias("form")).where("n = 1").select("adsh", "form")
    files.append_unique(one, at, ["adsh"])
    repeated, twice = _outcome(lambda: files.append_unique(one, at, ["adsh"])), _outcome(lambda: files.append_unique(one.union(one), f"{at}2", ["adsh"]))
    other = _outcome(lambda: files.append_unique(one.select("adsh", F.lit(1).alias("form")), at, ["adsh"]))
    return s.read.parquet(at).agg(F.count("*").alias("rows"), F.lit(repeated).alias("repeated"), F.lit(twice).alias("twice"), F.lit(other).alias("other_schema"))


@query("select c_custkey, c_name from customer")
def s20_upsert(s, d):
    """A table of the first customers, with all of them put in: equal rows change nothing."""
    rows = table(s, d, "customer").select("c_custkey", "c_name")
    return files.upsert(rows, rows.where("c_custkey <= 70"), "c_custkey")


@query("select 'FileExistsError' as again, 'ValueError' as changed, 256 as size")
def s22_run_record(s, d):
    at = f"{_place(s, 'run')}.json"
    files.write_record(at, {"size": 256}, s)
    again = _outcome(lambda: files.write_record(at, {"size": 1}, s))
    s.createDataFrame([('{"size": 1, "record_sha256": "x"}',)], "line string").coalesce(1).write.text(f"{at}.changed")
    changed = _outcome(lambda: files.read_record(f"{at}.changed", s))
    return s.createDataFrame([(again, changed, files.read_record(at, s)["size"])], "again string, changed string, size int")


_HEADERS = {"2019q1": ["adsh", "tag", "value"], "2019q2": ["value", "tag", "adsh"], "2019q3": ["adsh", "tag", "value", "footnote"], "2019q4": ["adsh", "value"]}


@query("select * from (values ('2019q3', 'footnote', ''), ('2019q4', '', 'tag')) t(archive, more, fewer)")
def audit_schema_drift(s, d):
    return s.createDataFrame([(a, ",".join(m), ",".join(f)) for a, m, f in audit.drifted_headers(_HEADERS)], "archive string, more string, fewer string")


# --- documents

_FRONT = {"document_id": "filename", "cik": "cik", "year": "year"}
_JSON = "coalesce('\"' || replace(replace({c}, '\\', '\\\\'), '\"', '\\\"') || '\"', 'null')"
_BODY = f"select document_id, string_agg('## Item ' || upper(section_id[6:]) || chr(10) || chr(10) || text, chr(10) || chr(10) order by ordinal) || chr(10) as body from ({_LONG}) where length(text) > 0 group by 1"
_RENDERED = f"select filename as document_id, '---' || chr(10) || {' || chr(10) || '.join(_text(n + ': ') + ' || ' + _JSON.format(c=c) for n, c in _FRONT.items())} || chr(10) || '---' || chr(10) || coalesce(chr(10) || body, '') as text from edgar left join ({_BODY}) on document_id = filename"


@query(f"select document_id, sha256(text) as mark from ({_RENDERED})")
def d1_rendered(s, d):
    return documents.rendered(table(s, d, "edgar"), _FRONT).select("document_id", F.sha2("text", 256).alias("mark"))


@query(f"select filename as document_id, filename as named, cik, year, coalesce(sha256(body), sha256('')) as mark from edgar left join ({_BODY}) on document_id = filename")
def d1_parsed_again(s, d):
    """What was rendered is read again: the same fields and body."""
    texts = documents.rendered(table(s, d, "edgar"), _FRONT).withColumnRenamed("document_id", "key")
    return documents.parsed(texts, "key", "text", list(_FRONT)).select(F.col("key").alias("document_id"), F.col("document_id").alias("named"), "cik", "year", F.sha2("body", 256).alias("mark"))


@query(f"select document_id, 'headings' as fault from ({_BODY}) where length(body) - length(replace(body, chr(10) || '## Item ', chr(10) || '## ')) < 0")
def d2_render_faults(s, d):
    """Rendered filings have no fault."""
    edgar = table(s, d, "edgar").where(F.exists(F.array(*(F.coalesce(F.length(documents.stripped(F.col(f"section_{x}"))), F.lit(0)) for x in documents.SECTIONS)), lambda n: n > 0))
    return documents.render_faults(edgar, documents.rendered(edgar, _FRONT))


# (id, text, fault that it must have)
_TEXTS = [("a.htm", "---\nx: null\n---\n\n## Item 1\n\nBusiness.\n", None), ("b.htm", "---\nx: null\n---\n\n## Item 1\n\nBusiness.\n\n", "end"), ("c.htm", "## Item 1\n\nBusiness.\n", "front_matter"), ("d.htm", "---\nx: null\n---\n\nBusiness.\n", "headings"), ("e.htm", None, "missing"), ("f.htm", "---\nx: null\n---\n\n## Item 1\n\nBusi\r\nness.\n", "carriage_return")]


@query(_expected("document_id, fault", [(i, f) for i, _, f in _TEXTS if f]))
def d2_fault_examples(s, d):
    filings = _examples(s, [(i,) for i, _, _ in _TEXTS], "filename string")
    for x in documents.SECTIONS:
        filings = filings.withColumn(f"section_{x}", F.lit("Business." if x == "1" else None).cast("string"))
    return documents.render_faults(filings, _examples(s, [r[:2] for r in _TEXTS if r[1]], "document_id string, text string"))


_WORDS = "regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')"


@query(f"""with w as (select doc_id, len({_WORDS}) as n from documents where text is not null),
o as (select doc_id, n, unnest(range(0, greatest(0, ceil((n - 64) / 48.0))::bigint + 1)) as k from w where n > 0)
select doc_id, k::int as ordinal, least(64, n - k * 48)::int as tokens, true as exact from o""")
def d3_offset_windows(s, d):
    """Windows whose text is the slice of the document between their offsets."""
    docs = table(s, d, "documents").select("doc_id", "text")
    cut = documents.offset_windows(docs, "doc_id", "text", 64, 16)
    return cut.join(docs, "doc_id").select("doc_id", "ordinal", "tokens", (F.col("chunk") == F.expr("substring(text, char_start + 1, char_end - char_start)")).alias("exact"))


@query("""with p as (select document_id, ordinal as page, text, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')) as n from chunks where text is not null),
o as (select *, unnest(range(0, greatest(0, ceil((n - 40) / 40.0))::bigint + 1)) as k from p where n > 0)
select document_id || '::p' || case when page < 10000 then lpad(page::varchar, 4, '0') else left(page::varchar, 4) end || '::chunk' || k as chunk_id, least(40, n - k * 40)::int as tokens from o""")
def d5_page_chunks(s, d):
    """Chunks stand for pages."""
    pages = table(s, d, "chunks").select("document_id", F.col("ordinal").alias("page"), "text")
    return documents.page_chunks(pages, 40, 0).select("chunk_id", "tokens")


@query("select o_custkey, floor((n - 1) / 3)::int as part, count(*)::int as rows, '| key |' || chr(10) || '| --- |' || chr(10) || string_agg('| ' || o_orderkey || ' |', chr(10) order by o_orderkey) as table_text from (select *, row_number() over (partition by o_custkey order by o_orderkey) as n from orders) group by 1, 2")
def w10_table_parts(s, d):
    """The orders of a customer as a table of three rows a part."""
    orders = table(s, d, "orders").select("o_custkey", F.col("o_orderkey").alias("place"), F.col("o_orderkey").cast("string").alias("t"), F.lit(False).alias("header"))
    heads = orders.select("o_custkey").distinct().select("o_custkey", F.lit(-1).cast("bigint").alias("place"), F.lit("key").alias("t"), F.lit(True).alias("header"))
    return documents.table_parts(orders.unionByName(heads), "o_custkey", "place", "t", "header", 3).withColumnRenamed("table", "table_text")


_SPAN = "regexp_split_to_array(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n')"


@query(f"""with l as (select doc_id, unnest({_SPAN}) as line, unnest(range(1, len({_SPAN}) + 1)) as i from documents where text is not null),
g as (select *, sum((line like '## %')::int) over (partition by doc_id order by i) as part from l),
p as (select doc_id, part, string_agg(line, chr(10) order by i) as body, min(line) filter (line like '## %') as head from g group by all),
q as (select doc_id, part, case when part > 0 then {_clean_sql('head[4:]')} end as heading from p where length({_clean_sql('body')}) > 0),
m as (select *, part = max(part) over (partition by doc_id, heading) as current from q)
select heading, count(*) as spans, count(*) filter (current) as current from m group by 1""")
def w7_heading_spans(s, d):
    return documents.heading_spans(table(s, d, "documents"), "doc_id", "text").groupBy("heading").agg(F.count("*").alias("spans"), F.count_if(F.expr("current")).alias("current"))


_PAGE = "<title>T</title><h2>Item 1</h2><p>a <b>b</b></p><script>x</script><ul><li>one<li>two</ul><div style='display: none'>no</div><h2>Item 7</h2><table><tr><th>k<th>v</tr><tr><td>1<td>2</table><p>open"
_NODES = [(0, "title", None, "T"), (1, "heading", "Item 1", "Item 1"), (2, "text", "Item 1", "a b"), (3, "list_item", "Item 1", "one"), (4, "list_item", "Item 1", "two"), (5, "heading", "Item 7", "Item 7"), (6, "table_row", "Item 7", "k | v"), (7, "table_row", "Item 7", "1 | 2"), (8, "text", "Item 7", "open")]


@query(_expected("source_order, node_type, section, text", _NODES))
def d7_html_nodes(s, d):
    return documents.html_nodes(_examples(s, [("p", _PAGE), ("q", None)], "id string, html string"), "id", "html").select("source_order", "node_type", "section", "text")


@query("select doc_id, last_value(section_id ignore nulls) over (partition by cik order by doc_id rows unbounded preceding) as section_id from (select doc_id, cik, case when doc_id % 3 = 0 then section_id end as section_id from documents where cik is not null)")
def w6_filled_sections(s, d):
    some = table(s, d, "documents").where("cik is not null").select("doc_id", "cik", F.when(F.col("doc_id") % 3 == 0, F.col("section_id")).alias("section_id"))
    return documents.filled_sections(some, "cik", "doc_id", "section_id").select("doc_id", "section_id")


_XML = """<html xmlns:ix="i" xmlns:x="x"><x:context id="c"><x:entity><x:identifier>7</x:identifier><x:segment><x:explicitMember dimension="axis">North</x:explicitMember></x:segment></x:entity><x:period><x:startDate>2019-01-01</x:startDate><x:endDate>2019-12-31</x:endDate></x:period></x:context>
<x:context id="i"><x:entity><x:identifier>7</x:identifier></x:entity><x:period><x:instant>2019-12-31</x:instant></x:period></x:context><x:unit id="u"><x:measure>iso4217:USD</x:measure></x:unit>
<ix:nonFraction name="a" contextRef="c" unitRef="u" scale="3" format="ixt:num-dot-decimal">1,234.5</ix:nonFraction><ix:nonFraction name="b" contextRef="i" unitRef="u" sign="-" format="ixt:num-comma-decimal">1.234,5</ix:nonFraction><ix:nonFraction name="c" contextRef="i" unitRef="u" format="ixt:fixed-zero">none</ix:nonFraction>
<ix:nonFraction name="d" contextRef="i" format="ixt-sec:numwordsen">Two thousand and twenty-five</ix:nonFraction><ix:nonNumeric name="e" contextRef="i" continuedAt="k">outer <ix:nonFraction name="f" contextRef="i">(5)</ix:nonFraction></ix:nonNumeric><ix:continuation id="k">and more</ix:continuation><ix:nonFraction name="g" contextRef="zz">7</ix:nonFraction></html>"""
_BROKEN = '<html><x:context id="i"><x:identifier>7</x:identifier><x:instant>2019-12-31</x:instant></x:context><p>open<ix:nonFraction name="a" contextRef="i">8</ix:nonFraction></div>'
_FACTS = [
    ("x", "a", "2019-12-31", "axis=North", "1234500", None), ("x", "b", "2019-12-31", None, "-1234.5", None), ("x", "c", "2019-12-31", None, "0", None), ("x", "d", "2019-12-31", None, "2025", None), ("x", "e", "2019-12-31", None, None, None), ("x", "f", "2019-12-31", None, "-5", None), ("x", "g", None, None, "7", "no_context"), ("y", "a", "2019-12-31", None, "8", None), ("z", None, None, None, None, "not_parsed"),
]


@query(_expected("document_id, name, \"end\", members, value, error", _FACTS))
def d8_inline_facts(s, d):
    """Facts with their contexts and members, one within another, a document that is not well formed, and one without markup."""
    return inline.inline_facts(_examples(s, [("x", _XML), ("y", _BROKEN), ("z", "no markup"), ("n", None)], "id string, xml string"), "id", "xml").select("document_id", "name", "end", "members", "value", "error")


_PERIODS = [(None, "2019-12-31", "20191231", 0), ("2019-01-01", "2019-12-31", "20191231", 4), ("2019-10-01", "2019-12-31", "20191231", 1), ("2019-05-16", "2019-12-31", "20191231", 3), ("2019-06-30", "2019-12-15", "20191215", 2), ("2019-12-01", "2019-12-31", "20191231", 1), ("2019-01-01", "2019-13-31", None, None), ("x", "2019-12-31", "20191231", None)]


@query(_expected("start, \"end\", ddate, qtrs", _PERIODS))
def period_examples(s, d):
    """Eight months are three quarters, five months and a half are two."""
    return _examples(s, [r[:2] for r in _PERIODS], "start string, end string").select("start", "end", documents.period_of(F.col("start"), F.col("end")).alias("p")).select("start", "end", "p.ddate", "p.qtrs")


_ANSWERS = [("j1", '{"label": "Supported", "reason": "ok"}', "supported", "ok"), ("j2", '```json\n{"label": "unsupported", "reason": "no"}\n```', "unsupported", "no"), ("j3", '{"label": "maybe"}', None, None), ("j4", "supported", None, None), ("j5", None, None, None)]


@query(_expected("id, label, reason", [(i, a, b) for i, _, a, b in _ANSWERS]))
def judge_examples(s, d):
    return _examples(s, [r[:2] for r in _ANSWERS], "id string, response string").select("id", documents.judged(F.col("response")).alias("j")).select("id", "j.label", "j.reason")


@query("select chunk_id, coalesce(null, 'body') || '::' || lpad(ordinal::varchar, 6, '0') as local_id, document_id || '#fact-order-' || lpad(ordinal::varchar, 5, '0') as evidence_id, regexp_replace(document_id, '[^A-Za-z0-9._-]', '_', 'g') || '.md' as output from chunks")
def id_builders(s, d):
    none = F.lit(None).cast("string")
    i = documents.IDS
    return table(s, d, "chunks").select("chunk_id", i["local"](F.col("ordinal"), none).alias("local_id"), i["evidence"](F.col("document_id"), none, F.col("ordinal")).alias("evidence_id"), i["output"](F.col("document_id")).alias("output"))
