import random

import pytest
from pyspark.sql import functions as F

from helpers import YEAR
from schedulesmith.operators import quality as q
from schedulesmith.operators import validate as v
from schedulesmith.schema import TARGET_FIELDS


def table(spark, rows, fields):
    schema = "file_id string, sheet_name string, row_idx bigint, " + ", ".join(f"`{f}` string" for f in fields)
    return spark.createDataFrame(rows, schema)


def test_every_rule_on_the_issue_fixture(spark):
    fields = ["Reference", "Building Value", "Year Built", "Storeys", "State", "Fire Sprinklers (Y/N)", "Zip"]
    df = table(spark, [
        ("f", "s", 0, "L001", "$1,000,000", "1985", "5", "NY", "Y", "10001"),
        ("f", "s", 1, "L002", "$-500,000", "2030", "0", "California", "Yes", "9001"),
        ("f", "s", 2, "L001", "2000000", "1990", "3", "TX", "N", "60601")], fields)
    got = [(r.issue_id, r.issue_type, r.severity, r.affected_field, list(r.affected_rows), r.affected_row_count,
            r.before_example, r.suggested_operation) for r in q.detect_issues(df, YEAR).orderBy("ord").collect()]
    assert got == [
        ("QI-0001", "format", "medium", "Building Value", [], 2, "$1,000,000", "strip_currency"),
        ("QI-0002", "logical_error", "high", "Building Value", [1], 1, "$-500,000", "flag_for_review"),
        ("QI-0003", "logical_error", "high", "Year Built", [1], 1, "2030", "to_year_int"),
        ("QI-0004", "logical_error", "medium", "Storeys", [1], 1, "0", "flag_for_review"),
        ("QI-0005", "format", "medium", "Fire Sprinklers (Y/N)", [1], 1, "Yes", "normalize_sprinkler_code"),
        ("QI-0006", "format", "medium", "State", [1], 1, "California", "state_to_abbrev"),
        ("QI-0007", "duplicate", "high", "Reference", [0, 2], 2, "L001", "flag_for_review"),
        ("QI-0008", "format", "low", "Zip", [1], 1, "9001", "to_zip"),
    ]


def test_row_lists_and_duplicates_against_brute_force(spark):
    """A sheet with a hot reference and many findings: counts, first 50 rows and first values."""
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        ref = "HOT" if rng.random() < 0.33 else f"R{rng.randrange(4000)}"
        state = rng.choice(["NY", "ny", "Ontario", "Bavaria", None, "Kent", "Uri", "Tokyo", "X"])
        rows.append(("f", "s", i * 37, ref, state))
    df = table(spark, rows, ["Reference", "State"]).repartition(7)
    got = {r.issue_type: r for r in q.detect_issues(df, YEAR).collect()}
    codes = {"NY"}
    bad = [(i, s) for _, _, i, _, s in rows if s is not None and s.upper() not in codes]
    assert got["format"].affected_row_count == len(bad)
    assert list(got["format"].affected_rows) == [i for i, _ in bad[:50]]
    first = list(dict.fromkeys(s for _, s in bad))[:5]
    assert got["format"].evidence.endswith(": " + ", ".join(first) + ".")
    count = {}
    for r in rows:
        count[r[3]] = count.get(r[3], 0) + 1
    dup = [(r[2], r[3]) for r in rows if count[r[3]] > 1]
    assert got["duplicate"].affected_row_count == len(dup)
    assert list(got["duplicate"].affected_rows) == [i for i, _ in dup[:50]]
    assert got["duplicate"].before_example == dup[0][1]
    first = list(dict.fromkeys(s for _, s in dup))[:5]
    assert got["duplicate"].evidence.endswith(": " + ", ".join(first) + ".")


def test_only_the_head_of_a_long_sheet_is_searched_for_listed_rows(spark):
    """Rules broken everywhere, late, rarely or only without a row number; rows past the needed bands are not looked at again."""
    rows = [("f", "s", i, "Ontario" if i % 2 else "NY", "10001" if i < 40_000 or i % 9 else "1", "0" if i in (7, 59_999) else "2") for i in range(60_000)]
    rows += [("f", "s", None, "Kent", "10001", "2"), ("f", "t", 5, "Uri", "1", None), (None, "s", 1, "Uri", None, None)]
    df = table(spark, rows, ["State", "Zip", "Storeys"]).repartition(5)
    rules = q.row_rules(YEAR, ["State", "Zip", "Storeys"])
    at = {r.name: i for i, r in enumerate(rules)}
    banded = q.banded_counts(df, rules).cache()
    assert q.summed_counts(banded).count() == 3 and q.summed_counts(banded).where("n_rows = 60001 and file_id = 'f'").count() == 1
    until = q.listed_until(banded, len(rules)).collect()
    assert [(r.file_id, r.sheet_name) for r in until] == [("f", "s")]
    ends = until[0]["_until"]
    assert ends[at["state_code"]] == 4095 and ends[at["zip_length"]] == 59_999 and ends[at["storeys_below_one"]] == 59_999 and until[0]["_most"] == 59_999
    head = q._listed_cells(df, rules, q.listed_until(banded, len(rules)))
    assert head.where(f"rule = {at['state_code']} and sheet_name = 's' and file_id = 'f'").count() == 2048 + 1
    got, want = ({(r.file_id, r.sheet_name, r.rule): (list(r.affected_rows), r.example) for r in q.first_broken_rows(df, rules, banded=b).collect()} for b in (banded, None))
    assert got == want
    assert got["f", "s", at["state_code"]] == ([None, *range(1, 99, 2)], "Kent")
    assert got["f", "s", at["zip_length"]][0] == [i for i in range(40_000, 60_000) if i % 9 == 0][:50]
    assert got["f", "s", at["storeys_below_one"]][0] == [7, 59_999] and got["f", "t", at["state_code"]] == ([5], "Uri")


def test_completeness_score_and_grade(spark):
    df = table(spark, [("f", "s", i, None if i < 3 else "A", "" if i < 2 else "1 St") for i in range(10)],
               ["Reference", "Address"])
    complete = {r.field: r.completeness for r in q.completeness(df).collect()}
    assert len(complete) == 17 and complete["Reference"] == 70 and complete["Address"] == 100 and complete["City"] == 0
    issues = q.detect_issues(df, YEAR)
    found = {(r.issue_type, r.affected_field): r.severity for r in issues.collect()}
    assert found["completeness", "Reference"] == "medium" and found["completeness", "Address"] == "low"
    mapping = spark.createDataFrame(
        [("f", "s", "a", "Reference", 0.9), ("f", "s", "b", "Address", 0.7), ("f", "s", "c", None, 0.0)],
        "file_id string, sheet_name string, source_column string, target string, confidence double")
    row = q.quality_score(mapping, mapping, q.completeness(df), issues, digits=None).first()
    # findings: two completeness (medium, low) and one duplicate reference (high)
    want = 100 * (0.35 * (2 / 17) * 0.8 + 0.30 * (170 / 17 / 100) + 0.35 * (1 - 0.08 - 0.02 - 0.20))
    assert row.score == pytest.approx(want) and row.grade == "F"
    alone = q.quality_score(mapping, digits=None).first()
    assert alone.score == pytest.approx(100 * (0.30 * 0.5 + 0.35))
    status = {r.field: r.status for r in q.completeness_status(q.completeness(df), mapping).collect()}
    assert status["Address"] == "Mapped" and status["Zip"] == "No source column"
    grades = spark.createDataFrame([(80.0,), (79.9,), (50.0,), (35.0,), (0.0,)], "s double").select(q.grade(F.col("s")))
    assert [r[0] for r in grades.collect()] == ["A", "B", "C", "D", "F"]


def test_schema_and_conformance(spark):
    assert v.schema_errors(TARGET_FIELDS) == []
    assert any("Missing" in e for e in v.schema_errors(TARGET_FIELDS[:-1]))
    assert any("wrong order" in e for e in v.schema_errors(TARGET_FIELDS[::-1]))
    base = {f: None for f in TARGET_FIELDS}
    rows = []
    for i, (bv, yr, z) in enumerate([("100.5", "1985", "802"), ("Included", "1980's", "99999999999"), (None, "1.5", None)]):
        rows.append(("f", "s", i, *{**base, "Building Value": bv, "Year Built": yr, "Zip": z}.values()))
    df = table(spark, rows, TARGET_FIELDS)
    out = v.typed_table(df).orderBy("row_idx").collect()
    assert out[0]["Building Value"] == 100.5 and out[0]["Year Built"] == 1985 and out[0]["Zip"] == 802
    assert out[1]["Building Value"] is None and out[1]["Year Built"] is None and out[2]["Year Built"] is None
    lost = {(r.row_idx, r.field, r.value) for r in v.nonconforming(df).collect()}
    assert lost == {(1, "Building Value", "Included"), (1, "Year Built", "1980's"), (1, "Zip", "99999999999"),
                    (2, "Year Built", "1.5")}
    errors = {r.field: r.message for r in v.conformance_errors(df).collect()}
    assert errors == {"Building Value": "Building Value: 1 non-numeric value(s), e.g. 'Included'",
                      "Year Built": "Year Built: 2 non-integer value(s), e.g. '1980's'"}
    report = {r.field: r["values"] for r in v.conformance_report(df).collect()}
    assert report["Building Value"] == "1 non-numeric" and report["City"] == "Empty" and report["Zip"] == "OK"
    assert [f.name for f in v.enforce_columns(df.drop("City").withColumn("x", F.lit(1))).schema] == TARGET_FIELDS
    assert spark.range(1).select(v.zip_display(F.lit(802))).first()[0] == "00802"
