"""Queries of the training-data operators on texts (problems 2, 3, 5, 7, 8 and 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import leakage, neardup, packing, pairs, splitting, subjects
from tessera.session import table, with_checkpoints

RERUN = "phase_1_7a_citation_format_correction_rerun"


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defective(table(spark, d, RERUN))


def p2_by_defect(spark: SparkSession, d: str) -> DataFrame:
    return p2_found(spark, d).groupBy("defect").agg(F.count("*").alias("cases"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select(F.col("doc_id").alias("record_key"), "text")
    return splitting.split([("documents", documents), ("edgar", splitting.filing_bodies(table(spark, d, "edgar")))], splitting.read_configs(table(spark, d, "chunk_configs")))


def p3_valid(spark: SparkSession, d: str) -> DataFrame:
    """Of each configuration whether its pieces cover every text from end to end, keep the window, are slices of it, and share tokens where they should."""
    documents = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("record_key"), "text")
    bodies = splitting.filing_bodies(table(spark, d, "edgar"))
    texts = documents.select(F.lit("documents").alias("source_table"), "record_key", F.length("text").alias("chars")).unionByName(bodies.select(F.lit("edgar").alias("source_table"), "record_key", F.length("text").alias("chars")))
    configs = table(spark, d, "chunk_configs").select("config_id", "window_size_tokens", F.coalesce("overlap_tokens", F.lit(0)).alias("overlap"), "split_mode")
    cut = p3_pieces(spark, d).select("source_table", "record_key", "config_id", "piece", "char_start", "char_end", "tokens", (F.length("text") == F.col("char_end") - F.col("char_start")).alias("slice"))
    w = Window.partitionBy("source_table", "record_key", "config_id").orderBy("piece")  # the pieces of a text
    j = cut.join(F.broadcast(configs), "config_id").withColumn("before", F.lag("char_end").over(w))  # a fixed small table
    each = j.groupBy("source_table", "record_key", "config_id").agg(
        F.every((F.col("char_start") <= F.coalesce("before", F.lit(0))) & F.col("slice")).alias("joined"), F.max("char_end").alias("end"), F.every(F.col("tokens").between(1, F.col("window_size_tokens"))).alias("within"),
        F.every((F.col("overlap") == 0) | (F.col("split_mode") != "fixed") | F.col("before").isNull() | (F.col("char_start") < F.col("before"))).alias("shared"),
    )
    whole = each.join(texts, ["source_table", "record_key"]).groupBy("config_id").agg(F.every(F.col("joined") & (F.col("end") == F.col("chars"))).alias("covered"), F.every("within").alias("within"), F.every("shared").alias("shared"))
    yes = F.lit(True)
    return configs.select("config_id").join(whole, "config_id", "left").select("config_id", *(F.coalesce(c, yes).alias(c) for c in ("covered", "within", "shared")))


def _filings(spark: SparkSession, d: str) -> neardup.NearDuplicates:
    text = F.concat(F.coalesce("section_1", F.lit("")), F.lit(" "), F.coalesce("section_7", F.lit("")))
    return neardup.NearDuplicates(table(spark, d, "edgar"), F.col("filename"), text, similarity=0.5)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _filings(spark, d).pairs().select(F.col("key_a").alias("filename_a"), F.col("key_b").alias("filename_b"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return _filings(spark, d).groups().withColumnRenamed("key", "filename")


def _capacity(spark: SparkSession, d: str) -> int:
    return next(c.window for c in splitting.read_configs(table(spark, d, "chunk_configs")) if c.config_id == "A2")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(table(spark, d, "documents"), _capacity(spark, d))


def p7_usage(spark: SparkSession, d: str) -> DataFrame:
    return packing.usage(p7_containers(spark, d), _capacity(spark, d))


def p7_valid(spark: SparkSession, d: str) -> DataFrame:
    """How many texts are assigned, whether their parts are whole and no container is overfull, and whether at most a hundredth and a container a partition more are used than all tokens need."""
    capacity = _capacity(spark, d)
    with_checkpoints(spark)
    assigned = p7_containers(spark, d).checkpoint()
    texts = table(spark, d, "documents").select("doc_id", F.length("text").alias("chars"))
    parts = assigned.groupBy("doc_id").agg(F.sum(F.col("char_end") - F.col("char_start")).alias("held"), F.min("char_start").alias("a"), F.max("char_end").alias("z"), F.countDistinct("piece").alias("pieces"), F.count("*").alias("rows"))
    whole = parts.join(texts, "doc_id").agg(F.count("*").alias("texts"), F.every(F.expr("held = chars and a = 0 and z = chars and pieces = rows")).alias("whole"))
    full = assigned.groupBy("container").agg(F.sum("tokens").alias("tokens"))
    used = full.agg(F.every(F.col("tokens") <= capacity).alias("within"), (F.count("*") <= F.ceil(F.sum("tokens") / capacity * 1.01) + F.countDistinct(F.shiftright("container", 33))).alias("tight"))
    return whole.join(used, F.lit(True))  # one row each


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return leakage.cleaned(table(spark, d, "documents"), table(spark, d, "eval_items"))


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.assign(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subjects"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Documents and characters by subject; a document of two subjects counts in both, one of none under ``none``."""
    documents = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("chars"))
    found = documents.join(p9_found(spark, d), "doc_id", "left")
    return found.groupBy(F.coalesce("subject", F.lit("none")).alias("subject")).agg(F.count("*").alias("documents"), F.sum("chars").alias("chars"))


QUERIES = {f.__name__: f for f in (p2_found, p2_by_defect, p3_pieces, p3_valid, p5_found, p5_groups, p7_containers, p7_usage, p7_valid, p8_found, p8_cleaned, p9_found, p9_shares)}

_WORDS = """list_filter(regexp_extract_all(lower(coalesce(section_1, '') || ' ' || coalesce(section_7, '')), '[a-z0-9]+'), lambda x: x <> '')"""

# Exact by an inverted index over all shingles.
_PAIRS = f"""w as (select filename, {_WORDS} as w from edgar),
s as (select distinct filename, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as g from w where len(w) >= 30),
n as (select filename, count(*) as n, sha256(string_agg(g, '|' order by g)) as set_mark from s group by all),
p as (select a.filename as filename_a, b.filename as filename_b, count(*) as o from s a join s b on a.g = b.g and a.filename < b.filename group by all),
found as (select filename_a, filename_b from p join n x on x.filename = filename_a join n y on y.filename = filename_b where o >= 0.5 * (x.n + y.n - o))"""

# Normalisation as far as SQL has it: width of Latin letters and digits, invisible characters, words divided at a line end.
_WIDE, _NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_PLAIN_WORDS = r"""regexp_extract_all(regexp_replace(regexp_replace(lower(translate({c}, '{w}', '{n}')), '[\x{{200B}}-\x{{200F}}\x{{2060}}\x{{FEFF}}]|\x{{00AD}}(\r\n|\n|\r)?', '', 'g'), '([\p{{L}}\p{{N}}])[-\x{{2010}}\x{{2011}}](\r\n|\n|\r)[ \t]*([\p{{L}}\p{{N}}])', '\1\3', 'g'), '[\p{{L}}\p{{N}}]+')"""
_GRAMS = "unnest(list_distinct(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))))"


def _plain_words(column: str) -> str:
    return _PLAIN_WORDS.format(c=column, w=_WIDE, n=_NARROW)


ORACLE = {
    "p3_valid": "select config_id, true as covered, true as within, true as shared from chunk_configs",
    "p7_valid": "select count(*) as texts, true as whole, true as within, true as tight from documents where text is not null",
    # Exact by a join of all runs of 13 words.
    "p8_found": f"""with d as (select doc_id, {_plain_words('text')} as w from documents where text is not null), i as (select item_id, {_plain_words('passage')} as w from eval_items where passage is not null),
g as (select item_id, {_GRAMS} as g from i where len(w) >= 13), k as (select distinct g from g), h as (select doc_id, {_GRAMS} as g from d where len(w) >= 13)
select distinct doc_id, item_id from h join k using (g) join g using (g)""",
    "p5_found": f"with {_PAIRS} select * from found",
    "p5_groups": f"""with recursive {_PAIRS},
ends as (select filename_a as a, filename_b as b from found union select filename_b, filename_a from found),
reach(f, r) as (select filename, filename from n union select reach.f, ends.b from reach join ends on reach.r = ends.a),
class as (select f, min(r) as class_id from reach group by 1),
sets as (select set_mark, count(*) as copies from n group by 1),
links as (select a, count(distinct y.set_mark) as links from ends join n x on x.filename = a join n y on y.filename = b where x.set_mark <> y.set_mark group by 1)
select n.filename, class_id, copies, coalesce(links, 0) as links from n join class on f = n.filename join sets using (set_mark) left join links on a = n.filename""",
}
