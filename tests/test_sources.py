import pytest
from pyspark.sql import functions as F

import helpers as h
from schedulesmith.operators import structure as s
from schedulesmith.sources import files, sinks, workbook


def as_rows(df):
    out = {}
    for r in df.orderBy("row_idx").collect():
        out.setdefault(r.sheet_name, []).append((r.row_idx, r["values"], r.types))
    return out


def test_workbooks(spark, tmp_path):
    (tmp_path / "book.xlsx").write_bytes(h.xlsx_bytes(
        {"Sched": [["Location Info", None, "Financial Info"], ["Loc ID", "Address", "Value"],
                   ["L001", "1 Main & Co", 1000000], [None, "2 Main", 2.5], [None, None, True], [None, None, 45292]],
         "Empty": []},
        merges={"Sched": ["A1:B1", "A3:A4"]}, dates={"Sched": {"C6"}}))
    (tmp_path / "broken.xlsx").write_bytes(b"not a zip file")
    (tmp_path / "notes.pdf").write_bytes(b"x")
    parsed = workbook.read_workbooks(spark, str(tmp_path)).cache()
    rows = files.sheet_rows(parsed)
    got = as_rows(rows)["Sched"]
    assert got[1] == (1, ["Loc ID", "Address", "Value"], ["s", "s", "s"])
    assert got[2] == (2, ["L001", "1 Main & Co", "1000000"], ["s", "s", "n"])
    assert got[3][1][1:] == ["2 Main", "2.5"] and got[4][1:] == ([None, None, "True"], ["s", "s", "b"])
    assert got[5][1:] == ([None, None, "2024-01-01 00:00:00"], ["s", "s", "d"])
    assert [(r.sheet_name, r.sheet_pos) for r in files.sheets(parsed).orderBy("sheet_pos").collect()] == [("Sched", 0), ("Empty", 1)]
    ranges = files.merged_ranges(parsed)
    assert {r.range_name for r in s.merged_range_names(ranges).collect()} == {"A1:B1", "A3:A4"}
    filled = as_rows(s.fill_down(rows, ranges))["Sched"]
    assert filled[3][1] == ["L001", "2 Main", "2.5"] and filled[0][1] == ["Location Info", None, "Financial Info"]
    bad = files.bad_files(parsed, files.list_files(spark, str(tmp_path))).collect()
    errors = {r.file_id.split("/")[-1]: r.error for r in bad}
    assert errors["broken.xlsx"].startswith("Failed to read file") and "Unsupported file type '.pdf'" in errors["notes.pdf"]


def test_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Loc #,Address\nL1,"1 Main, Unit 2"\n\nL2,"two\nlines"\nL3,\n', encoding="utf-8")
    (tmp_path / "b.csv").write_bytes("Loc #,City\nL1,Orl\xe9ans\n".encode("latin-1"))
    got = {}
    for r in files.sheet_rows(files.read_csv_files(spark, str(tmp_path))).orderBy("row_idx").collect():
        got.setdefault(r.file_id.split("/")[-1], []).append(r["values"])
    assert got["a.csv"] == [["Loc #", "Address"], ["L1", "1 Main, Unit 2"], ["L2", "two\nlines"], ["L3", None]]
    assert got["b.csv"] == [["Loc #", "City"], ["L1", "Orléans"]]


def csv_rows(spark, path, split=None):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = {}
        for r in files.sheet_rows(files.read_csv_files(spark, str(path))).collect():
            found.setdefault(r.file_id.split("/")[-1], []).append((r.row_idx, r["values"]))
        return {k: sorted(v) for k, v in found.items()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


def expected_rows(data):
    import csv
    import io

    csv.field_size_limit(10 ** 9)
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    cells = [c for c in csv.reader(io.StringIO(text, newline="")) if c]
    return [(i, [x or None for x in c]) for i, c in enumerate(cells)]


def test_csv_files_split_and_unsplit(spark, tmp_path):
    import random

    rnd = random.Random(4)
    parts = ["a", "", '"q, uoted"', '"two\nlines"', '"a ""b"" c"', '5" pipe', '"closed" tail', " ", "é", '"cr\r\nlf\n\n"', 'x"y"z']
    contents = {
        "long.csv": b"a,b\n" + b"1," + b"x" * 200_000 + b"\n" + b"".join(b"%d,z\n" % i for i in range(60)),
        "broken.csv": b'a,b\n1,2\n3,4,5,6\n"7\n \n\n\r\n8,9\n',
        "narrow.csv": b'a,b\n1,"x,y,z"\n', "old.csv": "a,b\nOrl\xe9ans,\n".encode("latin-1"), "blank.csv": b"\n\r\n",
        "cr.csv": b'a,b\r1,"x\ry"\r2,"p\nq"\r3,4\n5,6\rtail', "bom.csv": "\ufeffé,b\n1,2".encode(), "open.csv": b'a,b\n1,"never\nclosed\n' * 1,
        "random.csv": "".join(",".join(rnd.choices(parts, k=rnd.randrange(1, 5))) + rnd.choice(["\n", "\r\n"]) for _ in range(900)).encode(),
        "text.csv": ("a,b\n" + '1,"' + "line, of ""text""\n" * 900 + '"\n2,3\n').encode(),
    }
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    want = {k: rows for k, v in contents.items() if (rows := expected_rows(v))}
    assert csv_rows(spark, tmp_path) == want
    assert csv_rows(spark, tmp_path, split=1500) == want
    parsed = files.read_csv_files(spark, str(tmp_path))
    assert {r.file_id.split("/")[-1] for r in files.sheets(parsed).collect()} == set(contents) and files.bad_files(parsed).count() == 0


def test_mixed_folder_loses_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    book = h.xlsx_bytes({"Good": [["Loc ID", "Value"], ["L1", 5]], "Half": [["x"]] * 20})
    (tmp_path / "in/book.xlsx").write_bytes(book)
    (tmp_path / "in/half.xlsx").write_bytes(h.cut_sheet(book, "Half"))
    (tmp_path / "in/a b.csv").write_text("x,y\n1,2\n")
    for name in ("old.xls", "notes.pdf", "none", "bad.xlsx"):
        (tmp_path / "in" / name).write_bytes(b"x")
    parsed = files.read_files(spark, str(tmp_path)).cache()
    rows, bad = files.sheet_rows(parsed), files.bad_files(parsed)
    read = {(r.file_id.split("/")[-1], r.sheet_name) for r in files.sheets(parsed).collect()}
    failed = {(r.file_id.split("/")[-1], r.sheet_name): r.error for r in bad.collect()}
    assert read == {("book.xlsx", "Good"), ("book.xlsx", "Half"), ("half.xlsx", "Good"), ("a%20b.csv", "Sheet1")}
    assert set(failed) == {("half.xlsx", "Half"), ("old.xls", None), ("notes.pdf", None), ("none", None), ("bad.xlsx", None)}
    assert {(r.file_id.split("/")[-1], r.sheet_name) for r in rows.select("file_id", "sheet_name").distinct().collect()} == read
    assert "no reader for '.xls'" in failed["old.xls", None] and "Unsupported" in failed["notes.pdf", None]
    parsed.unpersist()


def test_reindex_and_cells_round_trip(spark):
    rows = spark.createDataFrame(
        [("f", "s", i * 1000, ["a", None, str(i)], None) for i in range(300)], h.ROWS_SCHEMA).repartition(5)
    got = sorted((r.row_idx, r.data_idx) for r in s.reindex_rows(rows, band=4096).collect())
    assert got == [(i * 1000, i) for i in range(300)]
    back = s.cells_to_rows(s.rows_to_cells(rows))
    assert sorted((r.row_idx, tuple(r["values"])) for r in back.collect()) == [(i * 1000, ("a", None, str(i))) for i in range(300)]


def test_sinks(spark, tmp_path):
    audit = spark.createDataFrame(
        [], "file_id string, sheet_name string, " + ", ".join(f"{c} string" for c in sinks.AUDIT_COLUMNS))
    empty = sinks.audit_export(audit, "2024").collect()
    assert [r["Entry ID"] for r in empty] == ["No transformations applied"] and empty[0]["Timestamp"] == "2024"
    one = spark.createDataFrame([("f", "s", *["x"] * 11)], audit.schema)
    assert [r["Entry ID"] for r in sinks.audit_export(one, "2024").collect()] == ["x"]
    sinks.write_audit_json(one, str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 1
    from schedulesmith.operators import validate as v
    cleaned = spark.createDataFrame([("f", "My Sheet!", 0, "802")], "file_id string, sheet_name string, row_idx bigint, Zip string")
    typed = v.typed_table(v.enforce_columns(cleaned, ["file_id", "sheet_name", "row_idx"]))
    ranked = spark.createDataFrame([("f", "My Sheet!", True)], "file_id string, sheet_name string, is_primary boolean")
    sinks.write_cleaned(typed, str(tmp_path / "out"), ranked)
    assert spark.read.parquet(str(tmp_path / "out/cleaned")).first().Zip == 802
    assert spark.read.parquet(str(tmp_path / "out/primary")).count() == 1
    sinks.write_cleaned_csv(typed, str(tmp_path / "csv"))
    shown = spark.read.option("header", True).csv(str(tmp_path / "csv")).first()
    assert shown.sheet.startswith("My_Sheet-") and spark.read.option("header", True).schema("Reference string, Address string, City string, State string, Zip string").csv(
        str(tmp_path / "csv")).first().Zip == "00802"
    m = spark.createDataFrame([("f", "s", "Loc #", None)], "file_id string, sheet_name string, source_column string, target string")
    assert sinks.mapping_json(m).first().json == '{"source_column":"Loc #","target":null}'
    with pytest.raises(Exception):
        sinks.write_scores(m, str(tmp_path / "out"), mode="error")
    assert F.lit(1) is not None
