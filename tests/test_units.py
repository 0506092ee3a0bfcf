from decimal import Decimal

import pytest

from tessera.functions import units as U
from tessera.operators import units


@pytest.mark.parametrize(
    ("concept", "uom", "note", "want"),
    [
        ("Assets", "USD", None, ("USD", "1")),
        ("Assets", "USDth", "Amounts in thousands of U.S. dollars", ("USD", "1E+3")),
        ("Assets", "USD", "presented in millions of U.S. dollars; totals may not add", ("USD", "1E+6")),
        ("Assets", "kUSD", None, ("USD", "1E+3")),
        ("Assets", "EUR '000", None, ("EUR", "1E+3")),
        ("Assets", None, "Amounts in whole yen", ("JPY", "1")),
        ("Assets", "USD", "Rounded to the nearest thousand, shown in full units.", ("USD", "1")),
        ("Assets", "USD", "Includes one million-dollar settlement; full amount shown.", ("USD", "1")),
        ("EarningsPerShareBasic", "GBp", "pence per share", ("GBP/shares", "0.01")),
        ("EarningsPerShareBasic", "Gbp", None, ("GBP/shares", "1")),
        ("EarningsPerShareBasic", "cents (CAD) per share", None, ("CAD/shares", "0.01")),
        ("EarningsPerShareBasic", "USD", "In thousands, unaudited (USD)", ("USD/shares", "1")),
        ("CommonStockSharesOutstanding", "shares_thousands", None, ("shares", "1E+3")),
        ("CommonStockSharesOutstanding", None, "Number of shares, in millions", ("shares", "1E+6")),
        ("EffectiveIncomeTaxRateContinuingOperations", "pure", "in basis points", ("pure", "0.0001")),
        ("EffectiveIncomeTaxRateContinuingOperations", "%", None, ("pure", "0.01")),
        ("AreaOfRealEstateProperty", "sqft '000", None, ("sqm", "92.90304")),
        ("AreaOfRealEstateProperty", "sqft", "in thousands of square feet", ("sqm", "92.90304")),
        ("OreProcessed", "short tons", None, ("t", "0.90718474")),
        ("ElectricityGenerated", "Kilowatt-hours", None, ("MWh", "0.001")),
        ("ProvedDevelopedReservesVolume", "MMBbl", None, ("bbl", "1000000")),
    ],
)
def test_recorded_units(concept, uom, note, want):
    unit, factor = units.recorded_factor(concept, uom, note)
    assert unit == want[0] and factor == Decimal(want[1])


def test_no_unit_anywhere():
    assert units.recorded_factor("Assets", None, None) is None
    assert units.recorded_factor("Assets", " ", "Restated.") is None


@pytest.mark.parametrize(
    ("display", "concept", "canonical", "note", "want"),
    [
        ("$ (17.80) per share", "EarningsPerShareDiluted", None, None, ("USD/shares", -178000)),
        ("€4.315.172", "Revenues", None, "Revenues was €4.315.172 (EUR in thousands)", ("EUR", 43151720000000)),
        ("1,3 Mrd. EUR", "Revenues", None, None, ("EUR", 13000000000000)),
        ("€35.912bn", "Revenues", None, None, ("EUR", 359120000000000)),
        ("13\u202f010\u202f204", "Revenues", None, None, ("USD", 130102040000)),
        ("USD −4,373,719", "Liabilities", None, None, ("USD", -43737190000)),
        ("$5", "Revenues", "CAD", None, ("CAD", 50000)),
        ("24.7 million USD", "Revenues", None, "Details are given in the table (in thousands) on the following page.", ("USD", 247000000000)),
        ("three million shares", "CommonStockSharesOutstanding", None, None, ("shares", 30000000000)),
        ("519.3c", "EarningsPerShareBasic", "EUR", None, ("EUR/shares", 51930)),
        ("1,322 bp", "EffectiveIncomeTaxRate", None, None, ("pure", 1322)),
        ("191,936 m²", "AreaOfRealEstateProperty", None, None, ("sqm", 1919360000)),
        ("8.2 MMBbl", "ProvedDevelopedReservesVolume", None, None, ("bbl", 82000000000)),
        ("111.47\u200b", "Revenues", None, "All amounts are stated in billions of Canadian dollars unless otherwise indicated.", ("CAD", 1114700000000000)),
    ],
)
def test_displays(display, concept, canonical, note, want):
    assert units.read_display(display, concept, canonical, note) == want


@pytest.mark.parametrize("display", [None, "", " ", "n/m", "—", "see note 4", "*"])
def test_displays_without_number(display):
    assert units.read_display(display, "Revenues", "USD", None) is None


def test_dimensions_and_offset():
    unit, unknown = U.parse_unit("USD/bbl")
    assert dict(unit.dims) == {"USD": 1, "bbl": -1} and not unknown
    assert U.parse_unit("degC")[0].offset == Decimal("273.15")
    assert U.parse_unit("furlongs")[1] == ["furlongs"]


def test_table_with_nulls_and_extra_columns(spark):
    f = spark.createDataFrame(
        [(1, "Assets", "USDm", None, 2.5, "x"), (2, "Assets", None, None, 1.0, "x"), (3, None, None, "USD mm", 1.0, None), (4, "Assets", "USDm", None, None, None), (5, "Assets", "USDm", None, float("nan"), None), (6, "Assets", "USDbn", None, 1e300, None)],
        "fact_id bigint, tag string, uom string, footnote string, value double, common_unit string",
    )
    e = spark.createDataFrame([("a", "$5", "Revenues", None, None), ("b", None, None, None, None)], "evidence_id string, raw_display_value string, concept_name string, canonical_unit string, node_text string")
    got = {tuple(r) for r in units.common_units(f, e).collect()}
    assert got == {("facts", "1", "USD", 25000000000), ("facts", "3", "USD", 10000000000), ("facts", "6", "USD", None), ("evidence_records", "a", "USD", 50000)}
    assert units.common_units(f.limit(0), e.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("concept", "uom"),
    [("AreaOfRealEstateProperty", "MWh"), ("CommonStockSharesOutstanding", "USD thousands"), ("OreProcessed", "MMbbl"), ("Assets", "shares"), ("EffectiveIncomeTaxRateContinuingOperations", "USD"), ("Revenues", "%"), ("Assets", "USD/shares"), ("LoanLossReserves", "bbl/shares")],
)
def test_other_dimensions_give_no_value(concept, uom):
    assert units.recorded(concept, uom, None) == units.MISMATCH and units.recorded_factor(concept, uom, None) is None


def test_offsets_and_unknown_concepts():
    assert units.read_display("25 degC", "AverageTemperature", None, None) == ("K", 2981500)
    assert units.read_display("77 degF", "AverageTemperature", None, None) == ("K", 2981500)
    assert units.read_display("25 degC", "Assets", None, None) is None
    assert units.recorded_factor("LoanLossReserves", "USD thousands", None) == ("USD", Decimal("1E+3"))
    assert U.parse_unit("m/s")[1] and not U.parse_unit("m/s")[0].scaled


def test_mismatches_of_a_table(spark):
    df = spark.createDataFrame([(1, "OreProcessed", "MWh", None, 1.0, "x"), (2, "OreProcessed", "kt", None, 1.0, "x"), (3, None, None, None, None, "x")], "fact_id bigint, tag string, uom string, footnote string, value double, concept string")
    assert [tuple(r) for r in units.mismatches(df).collect()] == [("1", "OreProcessed", "MWh")]
    assert units.mismatches(df.limit(0)).count() == 0
