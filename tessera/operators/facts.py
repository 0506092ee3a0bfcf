"""Structured-fact operators: eligibility, lookups and calculations over reported facts.

Requests join facts that were reduced to one row a key first, so a request never
fans out and every outcome is one row. Null keys match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.phrases import CONCEPTS, FIRST_YEAR, LAST_YEAR, SUPPORTED_FORM

#: (tag, quarters of its period, unit)
REGISTRY = tuple((tag, quarters, unit) for tag, _, quarters, unit in CONCEPTS)
GRAIN = ("adsh", "tag", "ddate", "qtrs", "uom")


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGISTRY, "tag string, want_qtrs int, want_uom string")


def blank(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c) == "")


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def rules(first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR) -> dict[str, Column]:
    """What each eligibility rule rejects; a fact may be rejected by several."""
    return {
        "wrong_form": ~F.coalesce(F.col("form") == SUPPORTED_FORM, F.lit(False)),
        "wrong_year": ~F.coalesce(F.col("fiscal_year").between(first_year, last_year), F.lit(False)),
        "coregistrant": ~blank("coreg"),
        "segmented": ~blank("segments"),
        "custom_taxonomy": ~F.coalesce(F.col("version").like("us-gaap/%"), F.lit(False)),
        "no_value": ~finite("value"),
        "wrong_qtrs": ~F.coalesce(F.col("qtrs") == F.col("want_qtrs"), F.lit(False)),
        "wrong_unit": ~F.coalesce(F.col("uom") == F.col("want_uom"), F.lit(False)),
    }


def eligible(facts: DataFrame, submissions: DataFrame, tags: DataFrame, first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR) -> DataFrame:
    """Facts that pass every rule and state the period of their own submission, one row a grain; ``in_order`` sorts them.

    ``conflict`` marks a grain with different values; identical repeats collapse.
    """
    keep = facts.join(F.broadcast(tags), "tag")  # the registry is a fixed table of a few rows
    for bad in rules(first_year, last_year).values():
        keep = keep.where(~bad)
    periods = submissions.where("period is not null").select("adsh", F.col("period").alias("ddate")).distinct()
    aligned = keep.join(periods, ["adsh", "ddate"], "left_semi")
    return aligned.groupBy(*GRAIN).agg(F.min("cik").alias("cik"), F.min("fiscal_year").alias("fiscal_year"), F.min("value").alias("value"), (F.min("value") != F.max("value")).alias("conflict"))


def in_order(facts: DataFrame) -> DataFrame:
    """Facts in the total order of their grain."""
    return facts.orderBy(*GRAIN)


def require_consistent(facts: DataFrame) -> DataFrame:
    """The facts, or an error while they are read if a grain has conflicting values."""
    return facts.where(F.when(F.col("conflict"), F.raise_error(F.concat(F.lit("conflicting values for "), F.col("adsh"), F.lit(" "), F.col("tag"))).cast("boolean")).otherwise(True))


def funnel(facts: DataFrame, tags: DataFrame) -> DataFrame:
    """How many facts each rule rejects, counted in one pass."""
    known = facts.join(F.broadcast(tags), "tag")
    counts = known.agg(F.count("*").alias("known_tag"), *(F.count_if(c).alias(n) for n, c in rules().items()))
    return counts.unpivot([], ["known_tag", *rules()], "rule", "facts")


def by_key(facts: DataFrame) -> DataFrame:
    return facts.groupBy("cik", "fiscal_year", "tag").agg(F.count("*").alias("candidates"), F.min("value").alias("value"), F.countDistinct("value").alias("values"))


def lookup(requests: DataFrame, facts: DataFrame, tags: DataFrame) -> DataFrame:
    """status of each request (request_id, cik, fiscal_year, tag): found, not_found, ambiguous or unsupported_tag."""
    known = tags.select("tag", F.lit(True).alias("supported"))
    found = requests.join(F.broadcast(known), "tag", "left").join(by_key(facts), ["cik", "fiscal_year", "tag"], "left")
    status = F.when(F.col("supported").isNull(), "unsupported_tag").when(F.col("candidates").isNull(), "not_found").when(F.col("values") > 1, "ambiguous").otherwise("found")
    return found.select("request_id", "cik", "fiscal_year", "tag", status.alias("status"), F.when(status == "found", F.col("value")).alias("value"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


def changes(facts: DataFrame) -> DataFrame:
    """The change of each (cik, tag) from a year to the next one, where both are unambiguous."""
    one = by_key(facts).where("values = 1").select("cik", "tag", "fiscal_year", "value")
    before = one.select("cik", "tag", (F.col("fiscal_year") + 1).alias("fiscal_year"), F.col("value").alias("previous"))
    return one.join(before, ["cik", "tag", "fiscal_year"]).select("cik", "tag", "fiscal_year", (F.col("value") - F.col("previous")).alias("change"))


def _operands(requests: DataFrame, facts: DataFrame, tags: DataFrame, sides: dict[str, tuple[str, str]]) -> DataFrame:
    """Requests with status and value of both operands; a side is its (cik, fiscal_year) columns."""
    out = requests
    for side, (cik, year) in sides.items():
        asked = requests.select("request_id", F.col(cik).alias("cik"), F.col(year).alias("fiscal_year"), "tag")
        found = lookup(asked, facts, tags).select("request_id", F.col("status").alias(f"status_{side}"), F.col("value").alias(f"value_{side}"))
        out = out.join(found, "request_id")
    return out


def _unavailable() -> Column:
    return F.when(F.col("status_a") != "found", "operand_a_unavailable").when(F.col("status_b") != "found", "operand_b_unavailable")


def difference(requests: DataFrame, facts: DataFrame, tags: DataFrame) -> DataFrame:
    """outcome and value (b less a) of requests (request_id, cik, tag, year_a, year_b): computed, or the first operand that is unavailable, a before b. request_id is unique."""
    j = _operands(requests, facts, tags, {"a": ("cik", "year_a"), "b": ("cik", "year_b")})
    return j.select("request_id", _unavailable().otherwise("computed").alias("outcome"), F.when(_unavailable().isNull(), F.col("value_b") - F.col("value_a")).alias("value"))


def greater_than(requests: DataFrame, facts: DataFrame, tags: DataFrame) -> DataFrame:
    """outcome and winner of requests (request_id, cik_a, cik_b, tag, fiscal_year): computed, tie, or the first operand that is unavailable, a before b. request_id is unique."""
    j = _operands(requests, facts, tags, {"a": ("cik_a", "fiscal_year"), "b": ("cik_b", "fiscal_year")})
    outcome = _unavailable().when(F.col("value_a") == F.col("value_b"), "tie").otherwise("computed")
    winner = F.when(F.col("value_a") > F.col("value_b"), F.col("cik_a")).otherwise(F.col("cik_b"))
    return j.select("request_id", outcome.alias("outcome"), F.when(outcome == "computed", winner).alias("winner_cik"))


def compare(facts: DataFrame) -> DataFrame:
    """Neighbouring filers (by cik) of a tag and year in pairs, with the outcome of a > b; every filer is in one pair at most."""
    from pyspark.sql.window import Window

    one = by_key(facts).where("values = 1").select("cik", "tag", "fiscal_year", "value")
    ranked = one.withColumn("n", F.row_number().over(Window.partitionBy("tag", "fiscal_year").orderBy("cik")))
    pair = ranked.groupBy("tag", "fiscal_year", F.floor((F.col("n") - 1) / 2).alias("pair")).agg(F.min_by("value", "n").alias("a"), F.max_by("value", "n").alias("b"), F.count("*").alias("k"), F.min("cik").alias("cik_a"), F.max("cik").alias("cik_b"))
    outcome = F.when(F.col("a") > F.col("b"), "a").when(F.col("a") < F.col("b"), "b").otherwise("tie")
    return pair.where("k = 2").select("tag", "fiscal_year", "cik_a", "cik_b", outcome.alias("greater"))


def path_rates(asked: DataFrame) -> DataFrame:
    """(path, attempted, found, exact, leaked): the rates of rows (path, attempted, found, exact, trap).

    attempted over all rows that are no trap, found and exact over the attempted of
    these, leaked (found) over the traps; a rate over no row is null.
    """
    real = ~F.coalesce("trap", F.lit(False))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    rate = lambda of, hit: F.round(F.count_if(of & hit) / F.nullif(F.count_if(of), F.lit(0)), 9)
    tried = real & yes("attempted")
    return asked.groupBy("path").agg(rate(real, yes("attempted")).alias("attempted"), rate(tried, yes("found")).alias("found"), rate(tried, yes("exact")).alias("exact"), rate(~real, yes("found")).alias("leaked"))


def raw_match(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """match of requests (request_id, adsh, cik, tag, ddate, qtrs, uom, value) with undivided facts of the same six keys: exact, unmatched or ambiguous (different values)."""
    keys = ["adsh", "cik", "tag", "ddate", "qtrs", "uom"]
    plain = facts.where(blank("coreg") & blank("segments") & F.col("value").isNotNull())
    known = plain.groupBy(*keys).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    match = F.when(F.col("low").isNull(), "unmatched").when(F.col("low") != F.col("high"), "ambiguous").when(F.col("low") == F.col("value"), "exact").otherwise("unmatched")
    return requests.join(known, keys, "left").select("request_id", match.alias("match"))


def alignment_status(tag_supported: Column, dimension_free: Column, year_in_window: Column, match: Column, nodes: Column) -> Column:
    """The status of a piece of evidence: the first rule that fails decides; a match that was not looked up counts as unmatched."""
    return (
        F.when(~F.coalesce(tag_supported, F.lit(False)), "unsupported_tag")
        .when(~F.coalesce(dimension_free, F.lit(False)), "ineligible_dimensional")
        .when(match == "ambiguous", "ambiguous")
        .when(F.coalesce(match, F.lit("unmatched")) == "unmatched", "unmatched")
        .when(~F.coalesce(year_in_window, F.lit(False)), "ineligible_year_window")
        .when(F.coalesce(nodes, F.lit(0)) == 0, "exact_no_node")
        .otherwise("exact")
    )


def built_evidence(found: DataFrame, facts: DataFrame, nodes: DataFrame, tags: DataFrame, first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR) -> DataFrame:
    """(request_id, status, eligible, node_ids) of facts found in documents.

    found: (request_id, document_id, adsh, cik, fiscal_year, tag, ddate, qtrs, uom,
    segments, value, display); nodes: (document_id, node_id, text). A missing period
    or fiscal year, or a supported tag without unit, is a parse_error. Nodes are
    searched only for exact matches; all that hold the display, blanks made even, are
    named in order.
    """
    even = lambda c: F.trim(F.regexp_replace(c, "\\s+", " "))
    known = F.broadcast(tags.select("tag", "want_qtrs", "want_uom", F.lit(True).alias("supported")))  # a fixed table of a few rows
    keyed = found.join(known, "tag", "left")
    broken = F.col("ddate").isNull() | F.col("fiscal_year").isNull() | (F.coalesce("supported", F.lit(False)) & blank("uom"))
    matched = keyed.join(raw_match(found, facts), "request_id", "left").withColumn("broken", broken)
    searched = matched.where((F.col("match") == "exact") & blank("segments") & ~F.col("broken") & (F.length(even("display")) > 0)).select("request_id", "document_id", even("display").alias("needle"))
    hit = searched.join(nodes.select("document_id", "node_id", even("text").alias("body")), "document_id").where(F.expr("instr(body, needle) > 0"))
    named = hit.groupBy("request_id").agg(F.sort_array(F.collect_set("node_id")).alias("node_ids"))
    in_window = F.col("fiscal_year").between(first_year, last_year)
    status = F.when(F.col("broken"), "parse_error").otherwise(alignment_status(F.col("supported"), blank("segments"), in_window, F.col("match"), F.coalesce(F.size("node_ids"), F.lit(0))))
    fits = F.coalesce((F.col("qtrs") == F.col("want_qtrs")) & (F.col("uom") == F.col("want_uom")), F.lit(False))
    return matched.join(named, "request_id", "left").select("request_id", status.alias("status"), ((status == "exact") & fits).alias("eligible"), F.coalesce("node_ids", F.array().cast("array<string>")).alias("node_ids"))


def wanted(cik: int | None = None, fiscal_year: int | None = None) -> Column:
    """A filter on company and year, each left out where it is None; only whole numbers are taken."""
    out = F.lit(True)
    for name, value in (("cik", cik), ("fiscal_year", fiscal_year)):
        if value is not None:
            if isinstance(value, bool) or not isinstance(value, int):
                raise TypeError(f"{name} is a whole number")
            out = out & (F.col(name) == value)
    return out


def revision_rate(facts: DataFrame, key: tuple[str, ...], filing: str = "adsh") -> DataFrame:
    """How many keys are reported by several filings, and of these how many with different values.

    Two stages instead of two distinct counts a group.
    """
    once = facts.where("value is not null").groupBy(*key, filing).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    keys = once.groupBy(*key).agg(F.count("*").alias("filings"), F.min("low").alias("low"), F.max("high").alias("high"))
    again = keys.where("filings > 1")
    return again.agg(F.count("*").alias("repeated"), F.count_if(F.expr("low != high")).alias("revised"))


def resolve_filing(requests: DataFrame, filings: DataFrame) -> DataFrame:
    """The one filing of each requested (cik, fiscal_year); none or several are named so."""
    per_key = filings.groupBy("cik", "fiscal_year").agg(F.count("*").alias("n"), F.min("document_id").alias("document_id"))
    found = requests.join(per_key, ["cik", "fiscal_year"], "left")
    status = F.when(F.col("n").isNull(), "not_found").when(F.col("n") > 1, "ambiguous").otherwise("found")
    return found.select("cik", "fiscal_year", status.alias("status"), F.when(status == "found", F.col("document_id")).alias("document_id"))
