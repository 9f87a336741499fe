"""Files written from the given tables in tasks, and read back: workbooks, CSV and what is neither."""

from __future__ import annotations

import io
import uuid
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from schedulesmith.session import checkpoint_folder
from schedulesmith.sources import files
from schedulesmith.sources.workbook_source import WorkbookSource, open_folder

from .inputs import RAW_DUCK, raw, spark_sql

Q, SQL = {}, {}
CELLS = ["ref_raw", "zip_raw", "year_raw", "country_raw"]
# Rows of a book.
BOOK_ROWS = 2000


def add(name, fn, sql=None):
    Q[name] = fn
    if sql:
        SQL[name] = sql


def _sheet_xml(rows: list[list]) -> str:
    body = "".join("<row>" + "".join(
        "<c/>" if v is None else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for v in row) + "</row>" for row in rows)
    return f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>'


def book_bytes(sheets: dict[str, str]) -> bytes:
    """A minimal workbook of the given sheet documents."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    names = "".join(f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="r{i}"/>' for i, n in enumerate(sheets))
    rels = "".join(f'<Relationship Id="r{i}" Type="worksheet" Target="worksheets/{i}.xml"/>' for i in range(len(sheets)))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("xl/workbook.xml", f"<workbook {main}><sheets>{names}</sheets></workbook>")
        archive.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        for i, xml in enumerate(sheets.values()):
            archive.writestr(f"xl/worksheets/{i}.xml", xml)
    return out.getvalue()


def write_file(folder: str, name: str, content: bytes) -> None:
    """Written under another name first, so a task that runs twice leaves one whole file."""
    system, path = open_folder(folder)
    system.create_dir(path)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as stream:
        stream.write(content)
    system.move(part, f"{path}/{name}")


def _folder(spark) -> str:
    return f"{checkpoint_folder(spark)}/books-{uuid.uuid4().hex}"


# --- S2: a book per file and 2000 order numbers, a sheet per priority; one book has a sheet that breaks off ---
def books(spark, sf):
    folder = _folder(spark)

    def write(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row_idx")
        sheets = {n: _sheet_xml([[None if pd.isna(v) else v for v in row] for row in rows[CELLS].itertuples(index=False)]) for n, rows in group.groupby("sheet_name")}
        name = group["book"].iloc[0]
        if name == "F-0":
            sheets["Broken"] = _sheet_xml([["a", "b"]])[:-20]
        write_file(folder, f"{name}.xlsx", book_bytes(sheets))
        return pd.DataFrame({"n": [len(group)]})

    rows = raw(spark, sf).select("sheet_name", "row_idx", *CELLS, F.concat("file_id", F.lit("-"), F.floor(F.col("row_idx") / BOOK_ROWS).cast("string")).alias("book"))
    rows.groupBy("book").applyInPandas(write, "n long").agg(F.sum("n")).collect()
    write = book_bytes({"Gone": "x"})
    write_file(folder, "cut.xlsx", write[:len(write) // 2])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("workbook").load(folder)


def _name():
    return F.regexp_extract("file_id", r"([^/]+)\.xlsx$", 1).alias("book")


_BOOKS = f"""select concat(file_id, '-', row_idx // {BOOK_ROWS}) as book, sheet_name, row_number() over (partition by file_id, row_idx // {BOOK_ROWS}, sheet_name order by row_idx) - 1 as row_idx,
  concat_ws('|', coalesce(ref_raw, '~'), coalesce(zip_raw, '~'), coalesce(year_raw, '~'), country_raw) as record from ({RAW_DUCK})"""
add("workbook_rows", lambda spark, sf: books(spark, sf).where("row_idx is not null").select(_name(), "sheet_name", "row_idx", F.array_join("values", "|", "~").alias("record")), _BOOKS)
add("workbook_one_sheet",
    lambda spark, sf: books(spark, sf).where("sheet_name = '1-URGENT'").where("row_idx is not null").select(_name(), "sheet_name", "row_idx", F.array_join("values", "|", "~").alias("record")),
    f"select * from ({_BOOKS}) where sheet_name = '1-URGENT'")
add("workbook_sheets",
    lambda spark, sf: books(spark, sf).where("row_idx is null").select(_name(), "sheet_name", F.regexp_extract("error", "^Failed to read (sheet|file)", 0).alias("error")),
    f"select distinct book, sheet_name, null as error from ({_BOOKS}) union all select 'F-0', 'Broken', 'Failed to read sheet' union all select 'cut', null, 'Failed to read file'")


# --- S4: a folder with a file of some kind per 1/40 of the customers, taken in once and reconciled ---
KINDS = "case c_custkey % 8 when 0 then 'pdf' when 1 then 'empty' when 2 then 'cut' when 3 then 'xls' when 4 then 'book' when 5 then 'half' else 'csv' end"
CUSTOMERS = f"select c_custkey % 40 as k, {KINDS} as kind, c_custkey, c_name, c_mktsegment from {{customer}}"


def mixed_folder(spark, sf):
    folder = _folder(spark)

    def write(group: pd.DataFrame) -> pd.DataFrame:
        k, kind = group[["k", "kind"]].iloc[0]
        rows = [[str(a), b, c] for a, b, c in group.sort_values("c_custkey")[["c_custkey", "c_name", "c_mktsegment"]].itertuples(index=False)]
        book = book_bytes({"List": _sheet_xml(rows)} | ({"Half": _sheet_xml(rows)[:-30]} if kind == "half" else {}))
        content, end = {"pdf": (b"%PDF", "pdf"), "empty": (b"", "csv"), "cut": (book[:len(book) // 2], "xlsx"), "xls": (b"old", "xls"), "book": (book, "xlsx"), "half": (book, "xlsx"),
                        "csv": ("".join(",".join(r) + "\r\n" for r in rows).encode(), "csv")}[kind]
        write_file(folder, f"{k}.{end}", content)
        return pd.DataFrame({"n": [len(group)]})

    spark_sql(spark, sf, CUSTOMERS).groupBy("k").applyInPandas(write, "n long").agg(F.sum("n")).collect()
    return files.ingest(spark, folder, _folder(spark))


_FILES = f"with c as ({CUSTOMERS.replace('{customer}', 'customer')}), f as (select k, any_value(kind) as kind, count(*) as n from c group by k)"
add("ingest_totals", lambda spark, sf: mixed_folder(spark, sf)[1],
    f"""{_FILES} select count(*) as files_listed, count(*) filter (kind in ('book', 'half', 'csv')) as files_read, count(*) filter (kind in ('pdf', 'xls', 'cut')) as files_refused,
      count(*) filter (kind = 'empty') as files_empty, count(*) filter (kind in ('book', 'half', 'csv')) as sheets_read, count(*) filter (kind = 'half') as sheets_refused,
      cast(sum(n) filter (kind in ('book', 'half', 'csv')) as bigint) as rows_written, true as reconciled from f""")


def _file():
    return F.regexp_extract("file_id", r"([^/]+)$", 1).alias("file")


add("ingested_rows", lambda spark, sf: mixed_folder(spark, sf)[0].where("row_idx is not null").select(_file(), "row_idx", F.array_join("values", "|").alias("record")),
    f"""{_FILES} select concat(k, case when kind = 'csv' then '.csv' else '.xlsx' end) as file, row_number() over (partition by k order by c_custkey) - 1 as row_idx,
      concat_ws('|', c_custkey, c_name, c_mktsegment) as record from c where kind in ('book', 'half', 'csv')""")
add("quarantined_files", lambda spark, sf: files.bad_files(mixed_folder(spark, sf)[0]).select(_file(), "sheet_name", F.regexp_extract("error", "^(Unsupported file type|Failed to read (sheet|file))", 0).alias("error")),
    f"""{_FILES} select concat(k, case kind when 'pdf' then '.pdf' when 'empty' then '.csv' when 'xls' then '.xls' else '.xlsx' end) as file, case when kind = 'half' then 'Half' end as sheet_name,
      case kind when 'pdf' then 'Unsupported file type' when 'half' then 'Failed to read sheet' else 'Failed to read file' end as error from f where kind not in ('book', 'csv')""")


# --- a folder taken in twice, with half of its files changed in between: these are parsed again, the others are not ---
def changed_folder(spark, sf):
    folder, out = _folder(spark), _folder(spark)

    def write(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("c_custkey")[["c_custkey", "c_name"]].itertuples(index=False)
        write_file(folder, f"{group['k'].iloc[0]}.csv", "".join(f"{a},{b}\r\n" for a, b in rows).encode())
        return pd.DataFrame({"n": [len(group)]})

    customers = spark_sql(spark, sf, CUSTOMERS)
    for part in (customers, customers.where("k % 2 = 0").withColumn("c_name", F.upper("c_name"))):
        part.groupBy("k").applyInPandas(write, "n long").agg(F.sum("n")).collect()
        parsed = files.ingest_changed(spark, folder, out)
    return parsed


add("changed_files", lambda spark, sf: changed_folder(spark, sf).where("row_idx is not null").select(_file(), "row_idx", F.array_join("values", "|").alias("record")),
    f"""{_FILES} select concat(k, '.csv') as file, row_number() over (partition by k order by c_custkey) - 1 as row_idx,
      concat_ws('|', c_custkey, case when k % 2 = 0 then upper(c_name) else c_name end) as record from c""")
