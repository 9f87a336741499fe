import pytest
from pyspark.sql import functions as F

from schedulesmith.functions import ops

CASES = {
    "strip_currency": [("$1,500,000", "1500000.0"), ("($500)", "-500.0"), ("TBD", None), ("-", None), ("", None),
                       (" 12.50 ", "12.5"), (None, None), ("nan", None), ("1_000", None), ("1d", None)],
    "to_float": [("1234.56", "1234.56"), ("1,234.56", "1234.56"), ("TBD", None), ("(5)", None)],
    "to_int": [("1985", "1985"), ("10.0", "10"), ("1.5", "1.5"), ("abc", None), ("3", "3"), ("2.0", "2"), ("1,200", "1200")],
    "to_str": [("  a ", "a"), ("  ", None)],
    "trim_whitespace": [("  a ", "a"), ("  ", "")],
    "normalize_spaces": [(" a \t b c ", "a b c")],
    "state_to_abbrev": [("California", "CA"), ("NY", "NY"), ("new york", "NY"), ("texas", "TX"), ("V.I.", "VI"),
                        ("N. Y.", "NY"), (" Ontario ", "Ontario")],
    "normalize_sprinkler_code": [("yes", "Y"), ("no", "N"), ("Y13", "Y13"), ("Y", "Y"), ("y (13r)", "Y(13R)"),
                                 ("Partial", "Partial")],
    "to_zip": [("10001", "10001"), ("10001-1234", "10001"), ("00802", "802"), ("2134", "2134"), ("2134.0", "2134"), ("12", None)],
    "to_year_int": [("1985", "1985"), ("Built in 1990", "1990"), ("1950 / 2012", "1950"), ("1600", None)],
    "normalize_date": [("2024-1-5", "2024-01-05"), ("03/15/2024", "2024-03-15"), ("25/12/2023", "2023-12-25"),
                       ("20240131", "2024-01-31"), ("2024131", "2024-01-31"), ("2024-02-30", "2024-02-30"), ("soon", "soon")],
    "flag_for_review": [("x", "x"), (None, None)],
}


def test_every_whitelisted_operation(spark):
    assert set(CASES) == set(ops.WHITELIST)
    rows = [(op, v, want) for op, pairs in CASES.items() for v, want in pairs]
    df = spark.createDataFrame(rows, "op string, v string, want string")
    got = df.select("op", "v", "want", ops.apply_named(F.col("op"), F.col("v")).alias("got")).collect()
    assert [(r.op, r.v, r.got) for r in got] == [(r.op, r.v, r.want) for r in got]


def test_null_stays_null_and_unknown_operation_is_refused(spark):
    null = F.lit(None).cast("string")
    row = spark.range(1).select(*[ops.apply_operation(o, null).alias(o) for o in sorted(ops.WHITELIST)]).first()
    assert all(v is None for v in row)
    with pytest.raises(ValueError, match="whitelist"):
        ops.apply_operation("drop_table", null)


def test_operations_fold_in_order(spark):
    v = F.lit("Built in 1990")
    row = spark.range(1).select(
        ops.apply_operations(["to_year_int", "to_int"], v).alias("a"),
        ops.apply_operations(["to_int", "to_year_int"], v).alias("b")).first()
    assert row.a == "1990" and row.b is None


def test_mask(spark):
    df = spark.createDataFrame([("2345 Reagan Street",), ("$1,500,000",), ("risk@client.com",), ("x" * 100,)], "v string")
    got = [r[0] for r in df.select(ops.mask_value(F.col("v"))).collect()]
    assert got == ["9999 Reagan Street", "$9,999,999", "<email>", "x" * 32 + "…"]
