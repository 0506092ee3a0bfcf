"""Evaluation sets built from facts, and checks that they give nothing away."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.phrases import CONCEPTS, LAST_YEAR
from tessera.operators.sampling import selection_key


def unambiguous(facts: DataFrame) -> DataFrame:
    """(cik, tag, fiscal_year, accession, value) of eligible facts, where a company states one value for the year."""
    one = facts.groupBy("cik", "tag", "fiscal_year").agg(F.min("adsh").alias("accession"), F.min("value").alias("value"), F.max("value").alias("other"))
    return one.where("value = other").drop("other")


def _phrase(tag: str = "tag") -> Column:
    """A concept's label as it stands within a sentence."""
    return reduce(lambda rest, c: F.when(F.col(tag) == c[0], c[1][0].lower() + c[1][1:]).otherwise(rest), CONCEPTS, F.lit(None).cast("string"))


def _named(cik: str) -> Column:
    return F.concat(F.lit("company "), F.col(cik).cast("string"))


def _amount(year: Column) -> Column:
    """The question for the amount of a concept in a year; of a balance at its end."""
    balance = [t for t, _, quarters, _ in CONCEPTS if quarters == 0]
    when = F.when(F.col("tag").isin(balance), " at the end of fiscal year ").otherwise(" for fiscal year ")
    return F.concat(F.lit("What was the amount of "), _named("cik"), F.lit("'s "), _phrase(), when, year.cast("string"), F.lit("?"))


def _first(df: DataFrame, quota: int, *key: Column | str, tie: str = "cik") -> DataFrame:
    """The first ``quota`` rows of each concept in the order of the selection key of ``key``."""
    w = Window.partitionBy("tag").orderBy("__k", tie)
    return df.withColumn("__k", selection_key(*key)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= quota).drop("__k")


def _s(c: str) -> Column:
    return F.col(c).cast("string")


def numeric_questions(facts: DataFrame, quota: int) -> DataFrame:
    """(category, tag, cik, fiscal_year, question, expected): of every concept the first companies in hash order, each with its first year."""
    first = unambiguous(facts).groupBy("cik", "tag").agg(F.min(F.struct("fiscal_year", "accession", "value")).alias("x")).select("cik", "tag", "x.fiscal_year", "x.value")
    return _first(first, quota, F.col("tag"), _s("cik")).select(F.lit("numeric").alias("category"), "tag", "cik", "fiscal_year", _amount(F.col("fiscal_year")).alias("question"), F.col("value").alias("expected"))


def change_questions(facts: DataFrame, quota: int) -> DataFrame:
    """(category, tag, cik, year_a, question, expected): the change from a year to the next."""
    one = unambiguous(facts)
    after = one.select("cik", "tag", (F.col("fiscal_year") - 1).alias("fiscal_year"), F.col("value").alias("later"))
    both = one.join(after, ["cik", "tag", "fiscal_year"])
    said = F.concat(F.lit("How much did "), _named("cik"), F.lit("'s "), _phrase(), F.lit(" change from fiscal year "), _s("fiscal_year"), F.lit(" to fiscal year "), (F.col("fiscal_year") + 1).cast("string"), F.lit("?"))
    return _first(both, quota, F.col("tag"), _s("cik"), _s("fiscal_year")).select(F.lit("comparative").alias("category"), "tag", "cik", F.col("fiscal_year").alias("year_a"), said.alias("question"), (F.col("later") - F.col("value")).alias("expected"))


def comparison_questions(facts: DataFrame, quota: int) -> DataFrame:
    """(category, tag, fiscal_year, cik_a, cik_b, question, expected): neighbours in hash order among the companies of a concept and year; of equal values the first is expected."""
    key = selection_key(F.col("tag"), _s("fiscal_year"), _s("cik"))
    n = unambiguous(facts).withColumn("__k", key).withColumn("n", F.row_number().over(Window.partitionBy("tag", "fiscal_year").orderBy("__k", "cik")))
    pair = n.groupBy("tag", "fiscal_year", F.floor((F.col("n") - 1) / 2).alias("pair")).agg(F.count("*").alias("k"), F.min_by(F.struct("cik", "value"), "n").alias("a"), F.max_by(F.struct("cik", "value"), "n").alias("b")).where("k = 2")
    pair = pair.select("tag", "fiscal_year", F.col("a.cik").alias("cik_a"), F.col("b.cik").alias("cik_b"), F.when(F.col("a.value") >= F.col("b.value"), F.col("a.cik")).otherwise(F.col("b.cik")).alias("expected"))
    said = F.concat(F.lit("Which company reported higher "), _phrase(), F.lit(" for fiscal year "), _s("fiscal_year"), F.lit(": "), _named("cik_a"), F.lit(" or "), _named("cik_b"), F.lit("?"))
    return _first(pair, quota, F.col("tag"), _s("fiscal_year"), _s("cik_a"), tie="cik_a").select(F.lit("comparative").alias("category"), "tag", "fiscal_year", "cik_a", "cik_b", said.alias("question"), "expected")


def unanswerable_questions(facts: DataFrame, quota: int, span: int = 4) -> DataFrame:
    """(category, tag, cik, fiscal_year, question): known companies and concepts in years after the supported ones."""
    known = unambiguous(facts).select("cik", "tag").distinct()
    asked = _first(known, quota, F.lit("unans_year"), F.col("tag"), _s("cik")).withColumn("fiscal_year", F.lit(LAST_YEAR + 1) + F.col("place") % span)
    return asked.select(F.lit("unanswerable").alias("category"), "tag", "cik", "fiscal_year", _amount(F.col("fiscal_year")).alias("question"))


def leaks(questions: DataFrame, question: str, secrets: list[str]) -> DataFrame:
    """Questions that hold one of their own secret fields; blank fields give nothing away."""
    said = [F.when((F.length(_s(c)) > 0) & F.col(question).contains(_s(c)), F.lit(c)) for c in secrets]
    return questions.withColumn("leaked", F.array_compact(F.array(*said))).where("size(leaked) > 0")


def held(documents: DataFrame, items: DataFrame, key: str, passage: str, most: int = 10_000) -> DataFrame:
    """(doc_id, key): documents that hold an item's passage word for word.

    The passages are looked for one after the other while a text is read; ``most`` of
    them are allowed (more of them: llm.leakage, which reads them as an automaton).
    """
    rows = items.where(F.length(passage) > 0).select(key, passage).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} passages")
    import pyarrow as pa

    known = [(r[0], r[1]) for r in rows]

    def run(batches):
        for b in batches:
            hits = [(d, k) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, p in known if p in t]
            yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in hits], pa.int64()) for i in (0, 1)], names=["doc_id", key])

    return documents.where("text is not null").select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, f"doc_id bigint, {key} bigint")


def equal_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Whether two one-column tables hold the same values, nulls apart."""
    name = left.columns[0]
    sides = left.select(name, F.lit(1).alias("l"), F.lit(0).alias("r")).union(right.select(F.col(right.columns[0]).alias(name), F.lit(0), F.lit(1))).where(F.col(name).isNotNull())
    each = sides.groupBy(name).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return each.agg((F.count_if(F.expr("l = 0 or r = 0")) == 0).alias("equal"))


def applicability(questions: DataFrame, shapes: DataFrame) -> DataFrame:
    """Questions with whether retrieval applies to their (category, subtype); a shape that is not in the table is an error while read.

    shapes: (category, subtype, applicable), a small table; a null subtype is a shape of its own.
    """
    known = shapes.select(F.col("category").alias("__c"), F.col("subtype").alias("__s"), "applicable", F.lit(1).alias("__k"))
    j = questions.join(F.broadcast(known), F.col("category").eqNullSafe(F.col("__c")) & F.col("subtype").eqNullSafe(F.col("__s")), "left")
    unknown = F.raise_error(F.concat(F.lit("an unknown shape: "), F.coalesce("category", F.lit("-")), F.lit(" "), F.coalesce("subtype", F.lit("-")))).cast("boolean")
    return j.withColumn("applicable", F.when(F.col("__k").isNull(), unknown).otherwise(F.col("applicable"))).drop("__c", "__s", "__k")


def next_access(log: DataFrame, test_set: str, most: int = 3) -> int:
    """The number of the next access to a held-out set, from the log of accesses (test_set); beyond ``most`` it is refused."""
    number = log.where(F.col("test_set") == test_set).count() + 1
    if number > most:
        raise PermissionError(f"{test_set} was read {most} times already")
    return number
