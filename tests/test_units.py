from __future__ import annotations

from decimal import Decimal

from millrace.operators import units

RATES = [("USD", Decimal("1")), ("EUR", Decimal("1.084")), ("INR", Decimal("0.0119")), ("GBP", Decimal("1.271"))]
PERIODS = [("hour", 2080), ("day", 260), ("week", 52), ("fortnight", 26), ("month", 12), ("year", 1)]
CASES = [
    (("50000", "60000", "USD", "YEAR"), {"min": 50000, "max": 60000}),
    (("60000", "50000", "USD", "YEAR"), {"min": 50000, "max": 60000}),
    ((None, "US$34500 annual", "", ""), {"max": 34500}),
    (("0.00", "50,000", "usd", "per year"), {"max": 50000}),
    (("11600 – 15000 USD monthly", None, "", "tbc"), {"min": 139200, "max": 180000}),
    (("78.5 to 119k", None, "USD", "YEAR"), {"min": 78500, "max": 119000}),
    (("24 - 29 thousand", None, "US Dollars", "ANNUAL"), {"min": 24000, "max": 29000}),
    (("9,50,000", "12,00,000", "INR (₹)", "/yr"), {"min": 11305, "max": 14280}),
    (("14.5 lakhs", "20 lakhs", "INR", "YEAR"), {"min": 17255, "max": 23800}),
    (("12 LPA", None, "Rs.", None), {"min": 14280}),
    (("31,50", "35,00", "EUR", "Stunde"), {"min": 71024, "max": 78915}),
    (("35.000", "42.500,00", "EUR", "Jahr"), {"min": 37940, "max": 46070}),
    (("51 000", "162 000", "€", "par an"), {"min": 55284, "max": 175608}),
    (("45’000", None, "GBP (000s)", "bogus year"), {"min": 57195000000 // 1000}),
    (("2500", None, "pence", "HOUR"), {"min": 66092}),
    (("40", "50", "TEUR", "Jahr"), {"min": 43360, "max": 54200}),
    (("3.1", "3.45", "US$", "'000 per calendar month"), {"min": 37200, "max": 41400}),
    (("39", None, "USD", "thousands YEAR"), {"min": 39000}),
    (("50000", "60000", "KES", "YEAR"), {}),
    (("50000", "60000", "USD", "other"), {}),
    (("competitive", "DOE", "USD", "YEAR"), {}),
    ((None, None, None, None), {}),
    (("0.5", None, "US cents", "hour"), {"min": 10}),
]


def test_notations(spark):
    rows = [(i, *c[0]) for i, c in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id long, lo string, hi string, cur string, per string").selectExpr("*", "1 as unit", "2 as bound", "3 as value")
    got: dict = {}
    for r in _convert(spark, df).filter("value is not null").collect():
        got.setdefault(r["id"], {})[r["bound"]] = int(r["value"])
    wrong = [(c, got.get(i, {})) for i, c in enumerate(CASES) if i != 13 and got.get(i, {}) != c[1]]
    assert not wrong
    assert got[13] == {"min": 57195000}  # the scale in the currency field multiplies the amount


def _convert(spark, df):
    rates = spark.createDataFrame(RATES, "currency string, usd_per_unit decimal(12,6)")
    spans = spark.createDataFrame(PERIODS, "pay_unit string, units_per_year int")
    return units.convert(df, "id", "lo", "hi", "cur", "per", rates, spans)


def test_edges(spark):
    df = spark.createDataFrame([(None, "5", "5", "USD", "hour")] * 2 + [(1, "9" * 5000, "", "USD", "year")], "id long, lo string, hi string, cur string, per string")
    rows = _convert(spark, df).collect()
    assert sorted((r["bound"], int(r["value"])) for r in rows) == [("max", 10400)] * 2 + [("min", 10400)] * 2
    assert _convert(spark, df.limit(0)).count() == 0
