import pytest
from pyspark.sql import functions as F

from xylem.functions import lexical
from xylem.functions.builtins import BUILTINS
from xylem.functions.facets import Simple, check, with_check
from xylem.functions.patterns import PatternError, translate
from xylem.plans.values import canonical, in_space, problem, space

CASES = {
    "boolean": ("true false 1 0", "TRUE yes t"), "int": (" 42 |+7|007", "1.0|1e3|2147483648"), "decimal": ("1. .5 +1.00 -0", ". 1e3 1,0"), "double": ("1e5 INF -INF NaN .5", "inf Infinity 0x1p3"),
    "date": ("2024-02-29 2024-12-01Z -0001-01-01", "2023-02-29 24-01-01"), "time": ("24:00:00 00:00:00.123", "24:00:01 23:59:60"), "dateTime": ("2024-12-31T24:00:00", "2024-12-31"), "duration": ("P1Y PT0S -P1M P1DT2H", "P PT P1M1Y P1.5D"),
    "gMonthDay": ("--02-29", "--02-30"), "hexBinary": ("0A", "0"), "base64Binary": ("YWJj", "YW=j"), "language": ("en-GB", "en_GB"), "NCName": ("a.b-c", "a:b"), "unsignedByte": ("255", "256 -1"), "QName": ("a:x x", "a:b:c"),
}


def test_lexical_spaces_agree(spark):
    rows = [(k, v, ok) for k, both in CASES.items() for ok, vs in zip((True, False), both, strict=True) for v in (vs.split("|") if "|" in vs else vs.split())]
    for kind, v, ok in rows:
        assert in_space(space(v, BUILTINS[kind].space), kind) == ok, (kind, v)
    df = spark.createDataFrame(rows, "kind string, v string, ok boolean")
    for kind in CASES:
        bad = df.where(F.col("kind") == kind).where(lexical.is_valid(F.col("v"), kind) != F.col("ok")).collect()
        assert not bad


def test_facets_agree(spark):
    types = [Simple().restrict(("[A-Z]{2}-[0-9]{4}",)), Simple("int").restrict(minInclusive=0).restrict(maxInclusive=100), Simple("decimal").restrict(totalDigits=3, fractionDigits=1), Simple("string", item=Simple("int")).restrict(maxLength=2), Simple(members=(Simple("int"), Simple("boolean"))), Simple("decimal").restrict(enumeration=("1.0", "2")), Simple("token").restrict(minLength=2), Simple("date").restrict(explicitTimezone="required")]
    values = ["AB-1234", "AB-12", "5", "-1", "101", "1.25", "12.5", "1000", "1 2", "1 2 3", "true", "x", "1", "02", "  a  ", "2024-01-01Z", "2024-01-01", ""]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for t in types:
        got = {r.v: r.c for r in df.select("v", check(F.col("v"), t).alias("c")).collect()}
        assert got == {v: problem(v, t) for v in values}, t


def test_patterns():
    assert translate("a.b$") == r"a[^\n\r]b\$" and translate("[a-z-[aeiou]]") == "[[a-z]&&[^[aeiou]]]"
    for bad in ("(", ")", "[a", "a\\", "\\q"):
        with pytest.raises(PatternError):
            translate(bad)


def test_durations(spark):
    df = spark.createDataFrame([("P1M", "P30D", None), ("P1M", "P32D", -1), ("P1Y", "P12M", 0), ("PT25H", "P1D", 1)], "a string, b string, want int")
    assert df.where(~lexical.compare_durations(lexical.duration(F.col("a")), lexical.duration(F.col("b"))).eqNullSafe(F.col("want"))).isEmpty()


def test_canonical(spark):
    df = spark.createDataFrame([("decimal", "+01.50", "1.5"), ("decimal", "-0.0", "0"), ("boolean", " 1 ", "true"), ("hexBinary", "0a", "0A"), ("dateTime", "2024-12-31T24:00:00", "2025-01-01T00:00:00")], "k string, v string, want string")
    for r in df.collect():
        assert df.limit(1).select(lexical.canonical(F.lit(r.v), r.k)).first()[0] == r.want


VALUES = {
    "dateTime": ["2024-02-29T13:45:06.5+02:00", "2024-12-31T24:00:00", "2024-12-31T24:00:00Z", "2025-01-01T00:00:00", "-0001-12-31T23:59:59Z", "12024-01-01T00:00:00Z", "2024-01-01T12:00:00", "2024-01-01T12:00:00Z", "2024-01-01T13:00:00.0+01:00", "2024-01-02T02:00:01", "2023-02-29T00:00:00", "0000-01-01T00:00:00"],
    "date": ["2024-02-29", "2024-03-01+01:00", "2024-03-01-14:00", "-0044-03-15", "12024-01-01", "2024-01-01Z", "1900-02-29", "2000-02-29"], "time": ["24:00:00", "00:00:00Z", "23:59:59.999", "12:00:00+14:00", "12:00:00"],
    "gYear": ["2024", "-0044", "2024Z"], "gYearMonth": ["2024-02", "2024-02-05:00"], "gMonth": ["--02", "--12Z"], "gDay": ["---05", "---31"], "gMonthDay": ["--02-29", "--12-25", "--12-25Z", "--02-30"],
    "duration": ["P1M", "P30D", "P31D", "P10D", "P9D", "-P1D", "PT36H", "P1Y2M3DT4H5M6.5S", "P14M", "PT0S", "P0Y", "PT0.5S", "-P1Y", "P1DT"], "double": ["1.0", "1", "-0", "1e3", "1.5E-9", "123456789.25", "1e25", "NaN", "INF", "-INF", "0.1", "+INF"], "float": ["0.1", "16777216", "1e10"],
    "decimal": ["1.0", "1", "-0.0", "100000000000000000000", "100000000000000000001", "99999999999999999999.5", "-1e", "-100000000000000000000", "0.0000000000000000000000000000001", "-2", "05.50"], "integer": ["7", "+7", "-0", "99999999999999999999999999999999999999", "100000000000000000000000000000000000000"], "base64Binary": ["YWJj", "YW Jj", "YWI=", "YQ=="], "hexBinary": ["0a", "0A", "0"], "boolean": ["1", "true", "0"],
}
STEPS = {
    "dateTime": [{"minInclusive": "2024-01-01T12:00:00Z"}, {"maxExclusive": "2025-01-01T00:00:00"}, {"enumeration": ("2025-01-01T00:00:00", "2024-01-01T12:00:00Z")}, {"explicitTimezone": "required"}], "date": [{"minInclusive": "2024-01-01"}, {"maxInclusive": "2024-03-01"}, {"enumeration": ("2024-02-29",)}],
    "time": [{"maxInclusive": "12:00:00Z"}, {"enumeration": ("00:00:00",)}], "gYear": [{"minExclusive": "-0044"}], "gYearMonth": [{"maxInclusive": "2024-02"}], "gMonth": [{"minInclusive": "--03"}], "gDay": [{"maxInclusive": "---30"}], "gMonthDay": [{"minInclusive": "--12-25"}],
    "duration": [{"maxInclusive": "P9D"}, {"minExclusive": "P1M"}, {"enumeration": ("P1Y2M", "PT24H")}], "double": [{"enumeration": ("1", "NaN", "100e-3")}, {"minInclusive": "1"}, {"maxExclusive": "INF"}], "float": [{"enumeration": ("0.1",)}, {"maxInclusive": "0.1"}],
    "decimal": [{"maxInclusive": "100000000000000000000"}, {"minExclusive": "-2"}, {"enumeration": ("1.00", "5.5")}, {"totalDigits": 3}, {"fractionDigits": 2}], "integer": [{"minInclusive": "7"}, {"maxExclusive": "99999999999999999999999999999999999999"}, {"enumeration": ("07",)}], "base64Binary": [{"enumeration": ("YWJj",)}, {"length": 2}], "hexBinary": [{"enumeration": ("0A",)}], "boolean": [{"enumeration": ("true",)}],
}


def test_columns_and_workers_agree(spark):
    """Both forms give the same verdict, and the same canonical form, on values whose text says little about their order."""
    for kind, values in VALUES.items():
        plain = Simple(kind)
        types = [plain, *(plain.restrict(**f) for f in STEPS[kind]), Simple("string", item=plain).restrict(enumeration=(f"{values[0]} {values[1]}", values[0])), Simple(members=(plain, Simple("token"))).restrict(enumeration=(values[0], "other"))]
        df = spark.createDataFrame([(v,) for v in [*values, f" {values[0]}  {values[1]}", "other", ""]], "v string")
        rows = df.select("v", lexical.canonical(F.col("v"), kind).alias("canonical"), *(check(F.col("v"), t).alias(f"c{i}") for i, t in enumerate(types))).collect()
        for r in rows:
            for i, t in enumerate(types):
                assert r[f"c{i}"] == problem(r.v, t), (kind, r.v, t)
            if problem(r.v, plain) is None:
                assert r.canonical == canonical(r.v, plain), (kind, r.v)
        if kind in ("duration", "date", "dateTime"):
            checked = with_check(df, F.col("v"), types[1], "c").collect()
            assert [r.c for r in checked] == [problem(r.v, types[1]) for r in checked]


def test_precision_decimal(spark):
    t = Simple("precisionDecimal").restrict(totalDigits=4).restrict(maxScale=2, minScale=0)
    want = {"1.50": None, "15E-1": None, "1.500": "maxScale", "1.5E3": "minScale", "12345": "totalDigits", "INF": None, "-INF": None, "NaN": None, "x": "value", "-0": None}
    assert {v: problem(v, t) for v in want} == want
    assert {r.v: r.c for r in spark.createDataFrame([(v,) for v in want], "v string").select("v", check(F.col("v"), t).alias("c")).collect()} == want
    assert [canonical(v, Simple("precisionDecimal")) for v in ("+1.50", "15E-1", "1.5E3", "-INF")] == ["1.50", "1.5", "15E2", "-INF"]
    assert problem("1.0", Simple("precisionDecimal").restrict(enumeration=("1.00",))) is None and problem("2", Simple("precisionDecimal").restrict(maxInclusive="1.99")) == "maxInclusive"


def test_versions():
    assert problem("+INF", Simple("double")) == "value" and problem("+INF", Simple("double"), "1.1") is None
    assert problem("0000", Simple("gYear")) == "value" and problem("0000", Simple("gYear"), "1.1") is None


def test_long_values(spark):
    """Values of a megabyte pass without a stack for each character."""
    df = spark.createDataFrame([("YWJj" * 300_000, "0a" * 500_000, "ab1 " * 250_000, "a" * 1_000_000)], "b string, h string, t string, n string")
    got = df.select(check(F.col("b"), Simple("base64Binary")).alias("b"), check(F.col("h"), Simple("hexBinary")).alias("h"), check(F.col("t"), Simple("string").restrict((r"([a-z]+[0-9]|\s)*",))).alias("t"), check(F.col("n"), Simple("NCName")).alias("n"),
                    check(F.col("t"), Simple("string", item=Simple("token").restrict(("([a-z]|[0-9])+",)))).alias("l"), check(F.col("t"), Simple("NMTOKENS")).alias("k")).first()
    assert list(got) == [None] * 6
