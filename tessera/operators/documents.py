"""Documents: wide rows to long sections and Markdown, token windows, chunk records, alignment, HTML and inline facts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Section columns in document order.
SECTIONS = ("1", "1a", "1b", "2", "3", "4", "5", "6", "7", "7a", "8", "9", "9a", "9b", "10", "11", "12", "13", "14", "15")


def plain_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\\r\\n?", "\n")


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, "^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$", "")


def sections(filings: DataFrame) -> DataFrame:
    """(document_id, ordinal, section_id, text): the non-blank sections of wide filings in document order."""
    parts = F.array(*(F.struct(F.lit(i).alias("ordinal"), F.lit(f"item_{s}").alias("section_id"), stripped(plain_newlines(F.col(f"section_{s}"))).alias("text")) for i, s in enumerate(SECTIONS)))
    return filings.select(F.col("filename").alias("document_id"), F.inline(F.filter(parts, lambda p: F.length(p["text"]) > 0)))


def markdown(filings: DataFrame) -> DataFrame:
    """(document_id, body, headings): each non-blank section under a heading, one newline at the end; a filing without text has a null body."""
    parts = [F.when(F.length(stripped(F.col(f"section_{s}"))) > 0, F.concat(F.lit(f"## Item {s.upper()}\n\n"), stripped(plain_newlines(F.col(f"section_{s}"))))) for s in SECTIONS]
    filled = F.array_compact(F.array(*parts))
    return filings.select(F.col("filename").alias("document_id"), F.when(F.size(filled) > 0, F.concat(F.array_join(filled, "\n\n"), F.lit("\n"))).alias("body"), F.size(filled).alias("headings"))


def _quoted(c: str) -> Column:
    """A value of the front matter: a JSON text, or null."""
    return F.coalesce(F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), "\\\\", "\\\\\\\\"), '"', "\\\\\""), F.lit('"')), F.lit("null"))


def rendered(filings: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(document_id, text, headings): the Markdown of a filing under front matter with the named columns (name: column); one without text has no body."""
    named = [F.concat(F.lit(f"{name}: "), _quoted(column)) for name, column in fields.items()]
    front = filings.select(F.col("filename").alias("document_id"), F.concat(F.lit("---\n"), F.array_join(F.array(*named), "\n"), F.lit("\n---\n")).alias("front"))
    return front.join(markdown(filings), "document_id").select("document_id", F.concat("front", F.coalesce(F.concat(F.lit("\n"), "body"), F.lit(""))).alias("text"), "headings")


def parsed(texts: DataFrame, key: str, text: str, fields: list[str]) -> DataFrame:
    """(key, fields, body) of rendered texts; a field that is not there is null, a text without front matter is all body."""
    whole = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---\n\n?(.*)\z", 1)
    has = F.col(text).rlike(r"(?s)\A---\n.*?\n---\n")

    def field(name: str) -> Column:
        line = F.regexp_extract(F.concat(F.lit("\n"), whole, F.lit("\n")), rf'\n{name}: "((?:[^"\\]|\\.)*)"\n', 1)
        there = F.concat(F.lit("\n"), whole, F.lit("\n")).rlike(rf'\n{name}: "')
        return F.when(there, F.regexp_replace(line, r"\\(.)", "$1")).alias(name)

    return texts.select(key, *(field(f) for f in fields), F.when(has, F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---\n\n?(.*)\z", 2)).otherwise(F.col(text)).alias("body"))


def render_faults(filings: DataFrame, texts: DataFrame) -> DataFrame:
    """(document_id, fault) of rendered texts (document_id, text): headings that are not as many as non-blank sections, no newline or several at the end, carriage returns, no front matter; missing texts."""
    want = markdown(filings).select("document_id", F.col("headings").alias("want"))
    j = want.join(texts.select("document_id", "text"), "document_id", "left")
    got = F.size(F.regexp_extract_all("text", F.lit(r"(?m)^(## Item (?:1[0-5]?|[2-9])[A-C]?)$"), 1))
    rules = ((F.col("text").isNull(), "missing"), (F.col("text").isNotNull() & (got != F.col("want")), "headings"), (~F.col("text").rlike(r"(?s)[^\n]\n\z"), "end"), (F.col("text").contains("\r"), "carriage_return"), (~F.col("text").startswith("---\n"), "front_matter"))
    return j.select("document_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in rules)))).alias("fault"))


def offset_windows(texts: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """(key, ordinal, char_start, char_end, tokens, chunk): windows of blank-separated words with their half-open range of characters; chunk is the text's own slice, blanks within it kept."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the size")
    stride = size - overlap
    word = re.compile(r"[^ \t\n\r\f\v]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                spans = [m.span() for m in word.finditer(t)]
                start = n = 0
                while start < len(spans):
                    last = min(start + size, len(spans))
                    a, z = spans[start][0], spans[last - 1][1]
                    at.append(i)
                    rows.append((n, a, z, last - start, t[a:z]))
                    if last == len(spans):
                        break
                    start, n = start + stride, n + 1
            types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array([r[k] for r in rows], ty) for k, ty in enumerate(types))], names=[key, "ordinal", "char_start", "char_end", "tokens", "chunk"])

    slim = texts.where(F.col(text).isNotNull()).select(key, F.col(text).alias("__t"))
    return slim.mapInArrow(run, f"{key} {slim.schema[key].dataType.simpleString()}, ordinal int, char_start int, char_end int, tokens int, chunk string")


def page_chunks(pages: DataFrame, size: int, overlap: int) -> DataFrame:
    """Windows of pages (document_id, page, text) that cross no page, with ids document::p0001::chunk0."""
    marked = pages.withColumn("__page", F.concat_ws("\0", "document_id", F.col("page").cast("string")))
    cut = offset_windows(marked, "__page", "text", size, overlap)
    parts = F.split("__page", "\0")
    named = cut.withColumns({"document_id": parts[0], "page": parts[1].cast("int")})
    return named.select("document_id", "page", F.concat(F.col("document_id"), F.lit("::p"), F.lpad(F.col("page").cast("string"), 4, "0"), F.lit("::chunk"), F.col("ordinal").cast("string")).alias("chunk_id"), "ordinal", "char_start", "char_end", "tokens", "chunk")


def table_parts(rows: DataFrame, key: str, order: str, text: str, header: str, most: int = 50) -> DataFrame:
    """(key, part, rows, table): a table's body rows in groups of ``most``, each a Markdown table under the repeated header row."""
    body = rows.where(~F.col(header)).withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    grouped = body.groupBy(key, F.floor((F.col("__n") - 1) / most).cast("int").alias("part")).agg(F.count("*").cast("int").alias("rows"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__n", F.col(text).alias("t")))), lambda x: F.concat(F.lit("| "), x["t"], F.lit(" |"))), "\n").alias("__body"))  # ``most`` rows a group
    heads = rows.where(F.col(header)).groupBy(key).agg(F.min_by(text, order).alias("__head"))
    bar = F.array_join(F.transform(F.split("__head", "\\|"), lambda _: F.lit("---")), " | ")
    head = F.concat(F.lit("| "), F.col("__head"), F.lit(" |\n| "), bar, F.lit(" |\n"))
    return grouped.join(heads, key, "left").select(key, "part", "rows", F.concat(F.coalesce(head, F.lit("")), "__body").alias("table"))


def period_of(start: Column, end: Column) -> Column:
    """(ddate, qtrs) of a context: its end as YYYYMMDD, and its quarters; 0 for an instant, else the months (a begun one counts if its day is reached) by three, rounded, one at least. A date that cannot be read gives null."""
    a, z = F.try_to_date(start, "yyyy-MM-dd"), F.try_to_date(end, "yyyy-MM-dd")
    months = (F.year(z) - F.year(a)) * 12 + F.month(z) - F.month(a) + (F.dayofmonth(z) >= F.dayofmonth(a)).cast("int")
    quarters = F.when(start.isNull(), 0).otherwise(F.greatest(F.lit(1), F.bround(months / 3))).cast("int")
    return F.struct(F.date_format(z, "yyyyMMdd").alias("ddate"), F.when(z.isNotNull() & (start.isNull() | a.isNotNull()), quarters).alias("qtrs"))


def iso_date(text: Column) -> Column:
    """Whether a text is a real date written YYYY-MM-DD."""
    return F.coalesce(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


#: ids by what they name
IDS = {
    "chunk": lambda document, ordinal: F.concat(document, F.lit("::chunk"), ordinal.cast("string")),
    "local": lambda ordinal, section: F.concat(F.coalesce(section, F.lit("body")), F.lit("::"), F.lpad(ordinal.cast("string"), 6, "0")),
    "evidence": lambda document, element, order: F.concat(document, F.lit("#fact-"), F.coalesce(element, F.concat(F.lit("order-"), F.lpad(order.cast("string"), 5, "0")))),
    "page_chunk": lambda document, page, ordinal: F.concat(document, F.lit("::p"), F.lpad(page.cast("string"), 4, "0"), F.lit("::chunk"), ordinal.cast("string")),
    "output": lambda document: F.concat(F.regexp_replace(document, "[^A-Za-z0-9._-]", "_"), F.lit(".md")),
    "document": lambda cik, accession: F.concat(cik.cast("string"), F.lit("_"), accession),
    "uid": lambda *parts: F.sha2(F.concat_ws("\0", *parts), 256),
}


def judged(response: Column) -> Column:
    """(label, reason) of a judge's JSON answer, also one within a code fence; anything but supported or unsupported gives no label."""
    bare = F.regexp_replace(F.trim(response), r"(?s)\A```(?:json)?\s*|\s*```\z", "")
    read = F.from_json(bare, "label string, reason string")
    label = F.lower(F.trim(read["label"]))
    return F.struct(F.when(label.isin("supported", "unsupported"), label).alias("label"), read["reason"].alias("reason"))


def token_windows(texts: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """(key, ordinal, first_token, tokens, chunk): windows of blank-separated words; the last one ends at the last word."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the size")
    stride = size - overlap
    words = F.filter(F.split(F.col(text), "[ \\t\\n\\r\\f\\x0B]+"), lambda w: w != "")
    cut = texts.select(key, words.alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("words") - size) / F.lit(float(stride)))).cast("int")
    placed = cut.select(key, "words", F.posexplode(F.sequence(F.lit(0), last)).alias("ordinal", "n"))
    window = F.slice("words", F.col("n") * stride + 1, size)
    return placed.select(key, "ordinal", (F.col("n") * stride).alias("first_token"), F.size(window).alias("tokens"), F.array_join(window, " ").alias("chunk"))


def chunk_uid(df: DataFrame, config_hash: str) -> DataFrame:
    """Chunks with an id made of document and ordinal, and one that also holds the configuration and the text."""
    uid = F.sha2(F.concat_ws("\0", "document_id", F.lit(config_hash), F.col("ordinal").cast("string"), "text"), 256)
    return df.withColumns({"chunk_id": F.concat(F.col("document_id"), F.lit("::chunk"), F.col("ordinal").cast("string")), "chunk_uid": uid})


def ordinal_gaps(chunks: DataFrame) -> DataFrame:
    """Documents whose ordinals are not 0..n-1."""
    return chunks.groupBy("document_id").agg(F.count("*").alias("chunks"), F.min("ordinal").alias("least"), F.max("ordinal").alias("most")).where("least != 0 or most + 1 != chunks")


def heading_spans(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, heading, body): parts under '## ' headings; text before the first heading has a null heading. The last of equal headings counts as ``current``."""
    lines = F.filter(F.split(plain_newlines(F.col(text)), "(?m)^(?=## )"), lambda p: F.length(stripped(p)) > 0)
    parts = texts.where(F.col(text).isNotNull()).select(key, F.posexplode(lines).alias("place", "part"))
    heading = F.when(F.col("part").startswith("## "), stripped(F.substring_index(F.substring(F.col("part"), 4, 1 << 20), "\n", 1)))
    body = F.when(F.col("part").startswith("## "), F.when(F.instr("part", "\n") > 0, F.expr("substring(part, instr(part, '\n') + 1)")).otherwise(F.lit(""))).otherwise(F.col("part"))
    w = Window.partitionBy(key, "heading")
    return parts.select(key, "place", heading.alias("heading"), stripped(body).alias("body")).withColumn("current", F.col("place") == F.max("place").over(w))


def aligned(evidence: DataFrame, nodes: DataFrame) -> DataFrame:
    """status of each evidence (evidence_id, document_id, needle): exact, ambiguous or none, by the nodes (document_id, node_id, text) that contain the needle."""
    hit = evidence.join(nodes, "document_id").where(F.length("needle") > 0).where(F.expr("instr(text, needle) > 0"))
    found = hit.groupBy("evidence_id").agg(F.count("*").alias("nodes"), F.min("node_id").alias("node_id"))
    status = F.when(F.col("nodes").isNull(), "none").when(F.col("nodes") == 1, "exact").otherwise("ambiguous")
    return evidence.select("evidence_id").join(found, "evidence_id", "left").select("evidence_id", status.alias("status"), F.coalesce("nodes", F.lit(0)).alias("nodes"), F.when(status == "exact", F.col("node_id")).alias("node_id"))


#: marks that begin list entries, taken away where texts are compared
_BULLETS = "[•●▪◦‣·*–—-]"


def even_text(c: Column) -> Column:
    """A text for comparison: list marks at the beginning of lines and runs of white space taken away, lower case kept."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, f"(?m)^[ \\t]*{_BULLETS}[ \\t]+", " "), "\\s+", " "))


def evidence_pages(items: DataFrame, pages: DataFrame) -> DataFrame:
    """(item_id, status, page) of evidence (item_id, document_id, page, evidence_text): exact on its page, normalized there, adjacent (the only one of both neighbours), ambiguous (both), or none.

    pages: (document_id, page, text), a page number once a document. Blank evidence is found nowhere.
    """
    near = items.where(F.length(F.trim("evidence_text")) > 0).select("item_id", "document_id", "page", "evidence_text", F.explode(F.array(F.col("page") - 1, F.col("page"), F.col("page") + 1)).alias("near"))
    j = near.join(pages.select("document_id", F.col("page").alias("near"), "text"), ["document_id", "near"])
    exact = F.expr("instr(text, evidence_text) > 0")
    same = j.select("item_id", "page", "near", exact.alias("exact"), (exact | even_text(F.col("text")).contains(even_text(F.col("evidence_text")))).alias("even"))
    own, beside = F.col("near") == F.col("page"), F.col("near") != F.col("page")
    found = same.groupBy("item_id").agg(F.max((own & F.col("exact")).cast("int")).alias("e"), F.max((own & F.col("even")).cast("int")).alias("n"), F.count_if(beside & F.col("even")).alias("k"), F.min(F.when(beside & F.col("even"), F.col("near"))).alias("at"))
    status = F.when(F.col("e") == 1, "exact").when(F.col("n") == 1, "normalized").when(F.col("k") == 1, "adjacent").when(F.col("k") > 1, "ambiguous").otherwise("none")
    return items.select("item_id", F.col("page").alias("__p")).join(found, "item_id", "left").select("item_id", status.alias("status"), F.when(status.isin("exact", "normalized"), F.col("__p")).when(status == "adjacent", F.col("at")).alias("page"))


def gold_chunks(aligned_items: DataFrame, chunks: DataFrame, least: int = 40) -> DataFrame:
    """(item_id, chunk_ids) of aligned evidence (item_id, document_id, page, evidence_text): the chunks (document_id, page, chunk_id, chunk) of its page that hold it, lie within it, or hold its beginning up to their end, or its end from their beginning, of ``least`` characters at least; all chunks of the page where none does."""
    here = aligned_items.where(F.col("page").isNotNull()).join(chunks, ["document_id", "page"])
    both = here.withColumns({"__n": even_text(F.col("evidence_text")), "__c": even_text(F.col("chunk"))})
    # The first and last characters only tell where the rest has to be compared.
    begins = F.expr(f"instr(__c, left(__n, {least}))")
    ends = F.expr(f"instr(__c, right(__n, {least}))")
    opening = (begins > 0) & F.startswith("__n", F.substr("__c", begins))
    closing = (ends > 0) & F.endswith("__n", F.substr("__c", F.lit(1), ends + F.length(F.expr(f"right(__n, {least})")) - 1))
    marked = both.withColumn("hit", F.col("__c").contains(F.col("__n")) | F.col("__n").contains(F.col("__c")) | opening | closing)
    ids = marked.groupBy("item_id").agg(F.sort_array(F.collect_set(F.when(F.col("hit"), F.col("chunk_id")))).alias("some"), F.sort_array(F.collect_set("chunk_id")).alias("every"))
    return ids.select("item_id", F.when(F.size("some") > 0, F.col("some")).otherwise(F.col("every")).alias("chunk_ids"))


def section_windows(filings: DataFrame, size: int, overlap: int) -> DataFrame:
    """(document_id, section_id, ordinal, char_start, char_end, tokens, chunk): windows of each section, none across a heading; ordinals count through the document, offsets are within the section."""
    parts = sections(filings).withColumn("__key", F.concat_ws("\0", "document_id", F.lpad(F.col("ordinal").cast("string"), 3, "0"), "section_id")).select("__key", "text")
    cut = offset_windows(parts, "__key", "text", size, overlap)
    piece = F.split("__key", "\0")
    w = Window.partitionBy("document_id").orderBy("__key", "ordinal")  # the windows of a filing
    return cut.withColumns({"document_id": piece[0], "section_id": piece[2]}).withColumn("__n", F.row_number().over(w) - 1).select("document_id", "section_id", F.col("__n").alias("ordinal"), "char_start", "char_end", "tokens", "chunk")


#: a heading that names an item of the canonical list
_CANONICAL = r"(?i)^\s*item\s+(1[0-5]|[1-9])([abc]?)\b"


def detected_sections(nodes: DataFrame, key: str = "key", order: str = "source_order") -> DataFrame:
    """Nodes (key, order, node_type, text) with section_id: that of the last heading before them that names an item.

    Of several headings of an item the last one counts, so that a table of contents
    opens no section. Nodes before the first section have none.
    """
    item = F.concat(F.lit("item_"), F.regexp_extract("text", _CANONICAL, 1), F.lower(F.regexp_extract("text", _CANONICAL, 2)))
    named = nodes.withColumn("__item", F.when((F.col("node_type") == "heading") & F.col("text").rlike(_CANONICAL), item))
    last = F.max(F.when(F.col("__item").isNotNull(), F.col(order))).over(Window.partitionBy(key, "__item"))
    opening = named.withColumn("section_id", F.when(F.col("__item").isNotNull() & (F.col(order) == last), F.col("__item")))
    return filled_sections(opening, key, order, "section_id").drop("__item")


class _Nodes(HTMLParser):
    """Headings, paragraphs, list items and table rows in source order; scripts, styles and hidden parts are skipped."""

    BLOCKS = frozenset(("p", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "title", "div"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.kind, self.text, self.skip, self.section = [], None, [], [], None

    def handle_starttag(self, tag, attrs):
        if self.skip or tag in ("script", "style") or "display:none" in (dict(attrs).get("style") or "").replace(" ", "").lower():
            if tag not in ("br", "img", "hr", "input", "meta", "link"):
                self.skip.append(tag)
        elif tag in self.BLOCKS:
            self.close_node()
            self.kind = tag
        elif tag in ("td", "th"):
            self.text.append(" | " if "".join(self.text).strip() else "")

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                del self.skip[len(self.skip) - 1 - self.skip[::-1].index(tag) :]
        elif tag in self.BLOCKS:
            self.close_node()

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)

    def close_node(self):
        text = " ".join("".join(self.text).split())
        if text:
            kind = "heading" if self.kind and self.kind[0] == "h" and self.kind[1:].isdigit() else {"li": "list_item", "tr": "table_row", "title": "title"}.get(self.kind, "text")
            if kind == "heading":
                self.section = text
            self.nodes.append((kind, self.section, text))
        self.kind, self.text = None, []


def html_nodes(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, source_order, node_type, section, text) of HTML pages; broken markup is read as far as it goes, null pages have no nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parser = _Nodes()
                parser.feed(page)
                parser.close()
                parser.close_node()
                rows += [(k, i, *n) for i, n in enumerate(parser.nodes)]
            types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["key", "source_order", "node_type", "section", "text"])

    return pages.where(F.col(html).isNotNull()).select(F.col(key).cast("string"), html).mapInArrow(run, "key string, source_order int, node_type string, section string, text string")


def filled_sections(nodes: DataFrame, key: str, order: str, section: str) -> DataFrame:
    """Nodes with the last section named at or before them."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return nodes.withColumn(section, F.last(section, ignorenulls=True).over(w))


def inline_number(display: Column, fmt: Column, scale: Column, sign: Column) -> Column:
    """Value of an inline fact: comma or point decimals, dashes as zero, parentheses or a sign attribute as negative, scale as power of ten. Unreadable: null."""
    text = F.trim(F.translate(display, "  $€£¥", "  "))
    zero = text.isin("-", "–", "—", "") | F.coalesce(fmt.contains("zero"), F.lit(False))
    comma = F.coalesce(fmt.contains("comma"), F.lit(False))
    bare = F.regexp_replace(text, "[() ]", "")
    digits = F.when(comma, F.translate(F.regexp_replace(bare, "\\.", ""), ",", ".")).otherwise(F.regexp_replace(bare, ",", ""))
    number = F.when(zero & display.isNotNull(), F.lit(0.0)).otherwise(digits.try_cast("double"))
    negative = F.coalesce(sign == "-", F.lit(False)) != (text.startswith("(") & text.endswith(")"))
    return F.when(negative, -number).otherwise(number) * F.pow(F.lit(10.0), F.coalesce(scale, F.lit(0)))
