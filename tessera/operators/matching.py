"""Matching of names, passages and requests: by equal keys made from the texts, never by comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import with_checkpoints

_TOKEN = "[\\p{L}\\p{N}.&'\\-]+"


def name_key(text: Column) -> Column:
    """A name as its words: upper case, one blank between, no final full stop."""
    return F.regexp_replace(F.array_join(F.regexp_extract_all(F.upper(text), F.lit(f"({_TOKEN})"), 1), " "), "[.]+$", "")


def gazetteer(texts: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """(key, place, name, id): names (name, id) found in texts, the longest first, none overlapping another.

    Every run of as many words as some name has is a key for an equi-join; the
    numbers of words are read from the names first. A name of several ids gives the least.
    """
    known = names.where("name is not null").groupBy(name_key(F.col("name")).alias("name_key")).agg(F.min("id").alias("id"), F.min("name").alias("name")).where("name_key != ''")
    # Equal keys have equally many blanks, so runs of other lengths cannot meet a name.
    lengths = F.array(*(F.lit(r.n) for r in known.select(F.size(F.split("name_key", " ")).alias("n")).distinct().orderBy("n").collect())).cast("array<int>")
    words = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("__key"), F.regexp_extract_all(F.upper(text), F.lit(f"({_TOKEN})"), 1).alias("w"))
    starts = words.select("__key", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1)))).alias("place"))
    runs = starts.select("__key", "place", F.explode(lengths).alias("n"), "w").where("n <= size(w) - place + 1")
    keyed = runs.select("__key", "place", "n", F.regexp_replace(F.array_join(F.slice("w", F.col("place"), F.col("n")), " "), "[.]+$", "").alias("name_key"))
    hits = keyed.join(known, "name_key").groupBy("__key").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("rank"), "place", "n", "id", "name"))).alias("h"))
    # The hits of one text, longest first; each is kept if it overlaps none kept before.
    kept = F.expr("""aggregate(h, cast(array() as array<struct<rank: int, place: int, n: int, id: bigint, name: string>>),
        (acc, x) -> if(exists(acc, k -> x.place < k.place + k.n and k.place < x.place + x.n), acc, array_append(acc, x)))""")
    return hits.select("__key", F.explode(kept).alias("kept")).select(F.col("__key").alias(key), "kept.place", "kept.name", "kept.id")


def neighbour(items: DataFrame, pages: DataFrame) -> DataFrame:
    """status of items (item_id, document_id, page, needle): on the stated page, else on the page before or after, ambiguous if on both, else none.

    pages: (document_id, page, text); a page number stands once a document.
    """
    near = items.select("*", F.explode(F.array(F.col("page") - 1, F.col("page"), F.col("page") + 1)).alias("near")).where(F.length("needle") > 0)
    there = pages.select("document_id", F.col("page").alias("near"), "text")
    hit = near.join(there, ["document_id", "near"]).where(F.expr("instr(text, needle) > 0"))
    found = hit.groupBy("item_id").agg(F.max((F.col("near") == F.col("page")).cast("int")).alias("own"), F.count("*").alias("n"), F.min("near").alias("at"))
    status = F.when(F.col("own") == 1, "stated").when(F.col("n") > 1, "ambiguous").when(F.col("n") == 1, "neighbour").otherwise("none")
    return items.select("item_id", "page").join(found, "item_id", "left").select("item_id", status.alias("status"), F.when(status == "stated", F.col("page")).when(status == "neighbour", F.col("at")).alias("at"))


def navigate(requests: DataFrame, filings: DataFrame, sections: DataFrame) -> DataFrame:
    """(request_id, outcome, document_id, chars, nodes, all_nodes) of requests (request_id, cik, fiscal_year, section_id).

    filings: (document_id, cik, fiscal_year); sections: (document_id, section_id, text), a
    row a node. not_found and ambiguous: no filing, or several; filing_not_parsed: it has
    no section; section_not_found; found, with the characters and nodes of the section
    and the nodes of the whole document.
    """
    per_key = filings.where("cik is not null and fiscal_year is not null").groupBy("cik", "fiscal_year").agg(F.countDistinct("document_id").alias("n"), F.min("document_id").alias("document_id"))
    whole = sections.groupBy("document_id").agg(F.count("*").alias("all_nodes"))
    one = sections.groupBy("document_id", "section_id").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("nodes"))
    j = requests.join(per_key, ["cik", "fiscal_year"], "left").withColumn("document_id", F.when(F.col("n") == 1, F.col("document_id")))
    j = j.join(whole, "document_id", "left").join(one, ["document_id", "section_id"], "left")
    outcome = F.when(F.col("n").isNull(), "not_found").when(F.col("n") > 1, "ambiguous").when(F.col("all_nodes").isNull(), "filing_not_parsed").when(F.col("nodes").isNull(), "section_not_found").otherwise("found")
    return j.select("request_id", outcome.alias("outcome"), "document_id", "chars", "nodes", "all_nodes")


def scope_leaks(navigated: DataFrame) -> DataFrame:
    """How many navigations found their section, and how many of these gave as many nodes as the whole document of several has."""
    found = F.col("outcome") == "found"
    return navigated.agg(F.count("*").alias("attempts"), F.count_if(found).alias("found"), F.count_if(found & (F.col("nodes") >= F.col("all_nodes"))).alias("whole_document"))


def repeated_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(fingerprint, n, first): texts that are equal but for case and blanks, more than once."""
    mark = F.sha2(F.lower(F.trim(F.regexp_replace(text, "[ \\t\\n\\r]+", " "))), 256)
    return df.where(F.col(text).isNotNull()).groupBy(mark.alias("fingerprint")).agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1")


def repeated_meaning(questions: DataFrame) -> DataFrame:
    """(meaning, n, first): questions (question_id, category, subtype, tag, cik, fiscal_year, operands of (cik, fiscal_year)) that ask the same.

    A comparison of companies is told by tag, year and its companies in any order, one
    of years by company, tag and years in order, others by company, tag and year.
    """
    ciks = F.array_join(F.array_sort(F.transform("operands", lambda o: o["cik"].cast("string"))), ",")
    order = F.array_join(F.transform("operands", lambda o: o["fiscal_year"].cast("string")), ",")
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    own = F.when(F.col("subtype") == "cross_entity_comparison", F.concat_ws("|", s("tag"), s("fiscal_year"), ciks)).when(F.col("subtype") == "year_over_year_difference", F.concat_ws("|", s("cik"), s("tag"), order)).otherwise(F.concat_ws("|", s("cik"), s("tag"), s("fiscal_year")))
    meaning = F.concat_ws("|", s("category"), s("subtype"), own)
    return questions.groupBy(meaning.alias("meaning")).agg(F.count("*").alias("n"), F.min("question_id").alias("first")).where("n > 1")


#: a number with thousands separators and decimals
_NUMBER = "([0-9][0-9,]*(?:[.][0-9]+)?)"


def corrupted(text: Column, clause: str = " This was confirmed by the auditors.") -> Column:
    """The text with its first number doubled in the same format (separators, number of decimals); one without a number gets a clause nothing supports."""
    number = F.regexp_extract(text, _NUMBER, 1)
    plain = F.regexp_replace(number, ",", "")
    twice = (plain.try_cast("decimal(30,6)") * 2).cast("decimal(32,6)")
    decimals = F.when(plain.contains("."), F.length(F.substring_index(plain, ".", -1))).otherwise(0)
    whole = F.regexp_extract(twice.cast("string"), "^([0-9]+)", 1)
    grouped = F.when(number.contains(","), F.regexp_replace(whole, "(?<=[0-9])(?=(?:[0-9]{3})+$)", ",")).otherwise(whole)
    part = F.substring(F.substring_index(twice.cast("string"), ".", -1), F.lit(1), decimals)
    said = F.when(decimals > 0, F.concat(grouped, F.lit("."), part)).otherwise(grouped)
    at = F.instr(text, number)
    # Seven decimals or more, and more than 24 digits, are beyond the type: such a number is repeated instead of doubled.
    new = F.when(twice.isNull() | (decimals > 6), F.concat(number, number)).otherwise(said)
    return F.when(number == "", F.concat(text, F.lit(clause))).otherwise(F.concat(F.substr(text, F.lit(1), at - 1), new, F.substr(text, at + F.length(number))))


def sequential(candidates: DataFrame, categories: list[str], quota: int, entity: str) -> DataFrame:
    """The first ``quota`` rows of each category in order of selection_key, an entity in one category only; categories in the given order.

    candidates: (category, entity, selection_key). One pass a category, each without the entities taken before.
    """
    taken, out = None, None
    for c in categories:
        rest = candidates.where(F.col("category") == c)
        if taken is not None:
            rest = rest.join(taken, entity, "left_anti")
        best = rest.groupBy(entity).agg(F.min("selection_key").alias("selection_key"))
        picked = best.orderBy("selection_key", entity).limit(quota).select(F.lit(c).alias("category"), entity, "selection_key")
        out = picked if out is None else out.unionByName(picked)
        taken = picked.select(entity) if taken is None else taken.union(picked.select(entity))
    return out


def numbered(df: DataFrame, stratum: str, order: list[str], prefix: str, digits: int = 6) -> DataFrame:
    """Rows with ids such as prefix_stratum_000001, counted within each stratum in order; larger numbers keep all their digits.

    Rows are sorted by range into blocks, so that no task sees a whole stratum: a row's
    number is its place within its block and the rows of its stratum before.
    """
    ranged = df.repartitionByRange(stratum, *order).withColumn("__block", F.spark_partition_id())
    # The plan is cut here: the blocks must be the same for the counts and for the places.
    with_checkpoints(df.sparkSession)
    ranged = ranged.checkpoint()
    counts = ranged.groupBy(stratum, "__block").agg(F.count("*").alias("n"))
    before = counts.select(stratum, "__block", (F.sum("n").over(Window.partitionBy(stratum).orderBy("__block")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy(stratum, "__block").orderBy(*order))
    placed = ranged.withColumn("__place", place).join(before.withColumnRenamed(stratum, "__s"), F.col(stratum).eqNullSafe(F.col("__s")) & (ranged["__block"] == before["__block"])).drop(before["__block"])
    number = (F.col("__place") + F.col("before")).cast("string")
    padded = F.when(F.length(number) >= digits, number).otherwise(F.lpad(number, digits, "0"))
    return placed.withColumn("assigned_id", F.concat(F.lit(f"{prefix}_"), F.coalesce(F.col(stratum), F.lit("")), F.lit("_"), padded)).drop("__block", "__place", "before", "__s")
