import helpers as h
from schedulesmith.sources import files
from schedulesmith.sources.workbook_source import WorkbookReader, WorkbookSource


def folder(tmp_path):
    root = tmp_path / "in"
    (root / "deep").mkdir(parents=True)
    book = h.xlsx_bytes({"One": [["a", None, 5]], "Two": [["b"]] * 30, "Three": []}, merges={"One": ["A1:B1"]})
    (root / "deep/book.xlsx").write_bytes(book)
    (root / "half.xlsx").write_bytes(h.cut_sheet(h.xlsx_bytes({"One": [["c"]], "Two": [["x"]] * 30}), "Two"))
    (root / "bad.xlsx").write_bytes(b"no archive")
    (root / "list.csv").write_text("a,b\n1,2\n")
    return root


def test_sheets_are_partitions_and_filters_leave_them_unread(spark, tmp_path):
    root = folder(tmp_path)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorkbookSource)
    read = spark.read.format("workbook").load(str(root))
    assert read.rdd.getNumPartitions() == 6  # five sheets and a file that is none
    rows = sorted((r.file_id.split("/")[-1], r.sheet_name, r.row_idx, r["values"], r.types) for r in files.sheet_rows(read).collect())
    assert rows == [("book.xlsx", "One", 0, ["a", None, "5"], ["s", "s", "n"]), *[("book.xlsx", "Two", i, ["b"], ["s"]) for i in range(30)], ("half.xlsx", "One", 0, ["c"], ["s"])]
    assert {(r.file_id.split("/")[-1], r.sheet_name, r.sheet_pos) for r in files.sheets(read).collect()} == {
        ("book.xlsx", "One", 0), ("book.xlsx", "Two", 1), ("book.xlsx", "Three", 2), ("half.xlsx", "One", 0)}
    assert {(r.file_id.split("/")[-1], r.sheet_name, r.error[:14]) for r in files.bad_files(read).collect()} == {("half.xlsx", "Two", "Failed to read"), ("bad.xlsx", None, "Failed to read")}
    assert files.merged_ranges(read).count() == 1
    one = read.where("sheet_name = 'One'")
    assert one.rdd.getNumPartitions() == 2 and one.where("row_idx is not null").count() == 2
    assert read.where("sheet_name in ('Two', 'Three') and file_id like '%book%'").where("row_idx is null").count() == 2
    assert read.where("sheet_name is null").count() == 1


def test_the_reader_of_workbooks_agrees(spark, tmp_path):
    root = folder(tmp_path)
    spark.dataSource.register(WorkbookSource)
    from schedulesmith.sources.workbook import read_workbooks

    shown = lambda df: sorted((r.file_id.split("/")[-1], str(r.sheet_name), r.sheet_pos or 0, -1 if r.row_idx is None else r.row_idx, str(r["values"]), str(r.merges), (r.error or "")[:20]) for r in df.collect())
    assert shown(read_workbooks(spark, str(root))) == shown(spark.read.format("workbook").load(str(root)))
    assert WorkbookReader(str(root)).partitions()[0].path.endswith("bad.xlsx")


def test_ingest_reconciles_every_file(spark, tmp_path):
    root = folder(tmp_path)
    for name in ("empty.csv", "empty.xlsx", "a b.pdf"):
        (root / name).write_bytes(b"")
    (root / "old.xls").write_bytes(b"x")
    (root / "note.txt").write_bytes(b"x")
    parsed, totals = files.ingest(spark, str(root), str(tmp_path / "out"))
    assert totals.first().asDict() == {
        "files_listed": 9, "files_read": 3, "files_refused": 3, "files_empty": 3, "sheets_read": 5, "sheets_refused": 1, "rows_written": 34, "reconciled": True}
    named = {r.file_id.split("/")[-1] for r in parsed.select("file_id").distinct().collect()}
    assert named == {"book.xlsx", "half.xlsx", "bad.xlsx", "list.csv", "empty.csv", "empty.xlsx", "a%20b.pdf", "old.xls", "note.txt"}
    assert parsed.where("row_idx is not null").count() == 34


def test_large_csv_files_go_through_the_reader_of_spark(spark, tmp_path):
    text = 'a,b\n1,"x, ""y""\nz"\n\n2,\n,é\n' * 50
    (tmp_path / "big file.csv").write_text(text, encoding="utf-8")
    (tmp_path / "wide.csv").write_text(",".join("abcdefghij") * 40 + "\n")
    (tmp_path / "small.csv").write_text("p,q\n")
    whole = files.read_csv_files(spark, str(tmp_path))
    dealt = files.read_csv_files(spark, str(tmp_path), max_bytes=100, max_columns=5)

    def rows(parsed):
        cut = lambda v: [x for i, x in enumerate(v) if any(y is not None for y in v[i:])]
        return sorted((r.file_id.split("/")[-1], r.row_idx, str(cut(r["values"]))) for r in files.sheet_rows(parsed).collect())

    assert rows(dealt) == [r for r in rows(whole) if r[0] != "wide.csv"]
    bad = files.bad_files(dealt).collect()
    assert [r.file_id.split("/")[-1] for r in bad] == ["wide.csv"] and "more than 5 cells" in bad[0].error


def test_only_changed_files_are_parsed_again(spark, tmp_path):
    import os

    root, out = folder(tmp_path), str(tmp_path / "parsed")
    shown = lambda df: sorted((r.file_id.split("/")[-1], str(r.sheet_name), -1 if r.row_idx is None else r.row_idx, str(r["values"])) for r in df.collect())
    first = shown(files.ingest_changed(spark, str(root), out))
    assert first == shown(files.read_files(spark, str(root)))
    written = {f: f.stat().st_mtime_ns for f in (tmp_path / "parsed").rglob("*.parquet")}
    assert shown(files.ingest_changed(spark, str(root), out)) == first
    assert {f: f.stat().st_mtime_ns for f in (tmp_path / "parsed").rglob("*.parquet")} == written
    (root / "list.csv").write_text("a,b\n3,4\n5,6\n")
    os.utime(root / "list.csv", (2_000_000_000, 2_000_000_000))
    (root / "bad.xlsx").unlink()
    (root / "new.csv").write_text("n\n")
    assert shown(files.ingest_changed(spark, str(root), out)) == shown(files.read_files(spark, str(root)))
    left = {f for f in (tmp_path / "parsed").rglob("*.parquet")}
    assert sum(f in left for f in written) >= len(written) - 2


def test_many_files_share_partitions(spark, tmp_path, monkeypatch):
    from schedulesmith.sources import workbook_source as ws

    root = folder(tmp_path)
    shown = lambda reader: sorted(str(r) for p in reader.partitions() for r in reader.read(p))
    alone = shown(WorkbookReader(str(root)))
    monkeypatch.setattr(ws, "LISTED", 2)
    monkeypatch.setattr(ws, "PARTITIONS", 1)
    reader = WorkbookReader(str(root))
    assert len(reader.partitions()) == 1 and shown(reader) == alone
    monkeypatch.setattr(ws, "HELD_BYTES", 0)
    assert shown(reader) == alone
    reader.wanted = {"Two"}
    assert {str(r[1]) for p in reader.partitions() for r in reader.read(p)} == {"Two"}
