"""File listing, extension gate, mixed folders and CSV files.

Every listed file ends up in exactly one of three places: rows and sheets, bad files, or empty files. Readers
report what they cannot read, and a sheet's rows leave the task only if the whole sheet can be parsed.
"""

from __future__ import annotations

import csv
import io
import re
import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import folder_name
from ..session import attach, settle

SUPPORTED = ["xlsx", "xls", "csv"]

# One record per sheet row; a record without row_idx describes a sheet (its merged ranges)
# or, with ``error`` set, a file or sheet that could not be read.
PARSED_SCHEMA = (
    "file_id string, sheet_name string, sheet_pos int, row_idx bigint, values array<string>, types array<string>, "
    "merges array<struct<min_row:bigint,max_row:bigint,min_col:int,max_col:int>>, error string"
)
BATCH = 5000


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def gate_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Mark files of unsupported type with a readable error (S3)."""
    ext = extension(F.col(path))
    error = F.when(~ext.isin(SUPPORTED), F.concat(
        F.lit("Unsupported file type '."), ext, F.lit("'. Please upload .xlsx or .csv files.")))
    return files.withColumn("extension", ext).withColumn("error", error)


def list_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files below ``path`` with the gate applied; contents are not read."""
    return gate_files(_listing(spark, path).select(F.col("file_id").alias("path"), "length"))


def _names(spark: SparkSession, path: str | list[str]) -> list[str]:
    """Names of all files, in the spelling of the file metadata."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return [re.sub("^file:/+", "file:/", name) for name in files.inputFiles()]


def _listing(spark: SparkSession, path: str | list[str]) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("_metadata.file_path").alias("file_id"), "path", "length")


def _parsed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` in the layout of parsed records, columns not given null."""
    fields = [f.split(" ", 1) for f in PARSED_SCHEMA.split(", ")]
    return df.select(*[columns.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields])


def empty_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files of no bytes, which Spark's readers pass over, as error records.

    Spark's own listing names them; it holds the names of all files on the driver for any read.
    """
    names = spark.createDataFrame([(name,) for name in _names(spark, path)], "file_id string")
    empty = names.join(_listing(spark, path).select("file_id"), "file_id", "left_anti")
    return _parsed(empty, file_id=F.col("file_id"), error=F.lit("Failed to read file: the file is empty."))


def read_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All files of a mixed folder, each by the reader of its type.

    A file of a type that no reader takes, and one of no bytes, becomes an error record, so ``sheets`` and
    ``bad_files`` of the result together name every file. Parse once and store the result.
    """
    from .workbook import read_workbooks

    ext = extension(F.col("path"))
    others = list_files(spark, path).where(~ext.isin("xlsx", "csv"))
    unread = F.concat(F.lit("Failed to read file: no reader for '."), ext, F.lit("' files; save it as .xlsx or .csv."))
    refused = _parsed(others, file_id=F.col("path"), error=F.coalesce("error", unread))
    return read_workbooks(spark, path).unionByName(read_csv_files(spark, path)).unionByName(refused).unionByName(empty_files(spark, path))


def ingest(spark: SparkSession, path: str | list[str], out: str) -> tuple[DataFrame, DataFrame]:
    """Parses a folder once into ``out`` (Parquet) and reconciles what became of its files.

    The counts are metrics observed by the write itself, so they hold for what was written and cost no pass.
    Returns the parsed records and one row: files_listed (by the listing), files_read, files_refused, files_empty,
    sheets_read, sheets_refused, rows_written, and reconciled: every listed file was read, refused or empty.
    A file counts as read if one of its sheets was reached, even a broken one.
    """
    is_sheet = F.col("row_idx").isNull() & F.col("sheet_name").isNotNull()
    failed = F.col("error").isNotNull()
    empty = failed & F.col("error").endswith("the file is empty.")
    count = lambda c: F.count(F.when(c, 1))
    seen = Observation()
    parsed = read_files(spark, path).observe(
        seen, count(is_sheet & (F.col("sheet_pos") == 0)).alias("files_read"), count(failed & F.col("sheet_name").isNull() & ~empty).alias("files_refused"),
        count(empty).alias("files_empty"), count(is_sheet & ~failed).alias("sheets_read"), count(is_sheet & failed).alias("sheets_refused"),
        count(F.col("row_idx").isNotNull()).alias("rows_written"))
    parsed.write.mode("overwrite").parquet(out)
    found = {"files_listed": len(_names(spark, path)), **seen.get}
    names = ["files_listed", "files_read", "files_refused", "files_empty", "sheets_read", "sheets_refused", "rows_written"]
    totals = spark.createDataFrame([tuple(int(found[n]) for n in names)], ", ".join(f"{n} long" for n in names))
    reconciled = F.col("files_listed") == F.col("files_read") + F.col("files_refused") + F.col("files_empty")
    return spark.read.schema(PARSED_SCHEMA).parquet(out), totals.withColumn("reconciled", reconciled)


def ingest_changed(spark: SparkSession, path: str | list[str], out: str) -> DataFrame:
    """Parsed records of a folder, of which only files new or changed since the last call are parsed.

    ``out`` holds the records, a folder per file, with the time the file was changed. A file whose name and time are
    there is not read again; a changed one replaces its folder when the job commits, so a failed call
    can be repeated. Records of files that are gone are left out of what is returned. Only the names of the files
    to read come to the driver. Files of no bytes are not listed here; ``ingest`` names them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    listed = settle(files.select(F.col("_metadata.file_path").alias("file_id"), "path", F.col("modificationTime").alias("modified")))
    on = ["file_id", "modified"]
    schema = f"{PARSED_SCHEMA}, modified timestamp, file string"

    def known() -> DataFrame:
        return spark.read.schema(schema).parquet(out)

    try:
        changed = settle(listed.join(known().where("row_idx is null").select(*on).distinct(), on, "left_anti"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        changed = listed
    paths = [r["path"] for r in changed.select("path").collect()]
    if paths:
        fresh = attach(read_files(spark, paths), changed.select(*on), ["file_id"]).withColumn("file", folder_name(F.col("file_id")))
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").parquet(out)
    return attach(known().drop("file"), listed.select(*on), on).drop("modified")


def read_parsed(spark: SparkSession, path: str | list[str], ext: str, parse, max_bytes: int | None = None) -> DataFrame:
    """Parse every ``.ext`` file as a whole, files spread over the tasks.

    ``parse(file_id, content)`` yields ``PARSED_SCHEMA`` tuples, the rows of a sheet before the
    sheet's own record. A first run tells which sheets can be read to their end, a second one hands on the
    rows of these, so a sheet that fails half way leaves its error only and no rows are held; an exception becomes
    an error record of the file (S4).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if max_bytes is not None:
        files = files.where(F.col("length") <= max_bytes)
    files = files.select(F.col("_metadata.file_path").alias("path"), "content").where(extension(F.col("path")) == ext)
    columns = [c.split()[0] for c in PARSED_SCHEMA.split(", ")]

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({"sheet_pos": "Int32", "row_idx": "Int64"})

    def whole_sheets(file_id: str, content: bytes) -> Iterator[pd.DataFrame]:
        ends = {row[2]: row for row in parse(file_id, content) if row[3] is None}
        held: list = []
        for row in parse(file_id, content):
            if row[3] is None:
                held.append(ends[row[2]])
            elif ends[row[2]][7] is None:
                held.append(row)
            if len(held) >= BATCH:
                yield frame(held)
                held = []
        if held:
            yield frame(held)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file_id, content in zip(batch["path"], batch["content"]):
                try:
                    yield from whole_sheets(file_id, bytes(content))
                except Exception as e:  # noqa: BLE001 - any unreadable file is reported, not fatal
                    yield frame([(file_id, None, None, None, None, None, None, f"Failed to read file: {e}")])

    return files.mapInPandas(run, PARSED_SCHEMA)


def sheet_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where("row_idx is not null").select("file_id", "sheet_name", "row_idx", "values", "types")


def sheets(parsed: DataFrame) -> DataFrame:
    """Every readable sheet with its position, also sheets without rows."""
    return parsed.where("error is null and row_idx is null").select("file_id", "sheet_name", "sheet_pos")


def merged_ranges(parsed: DataFrame) -> DataFrame:
    return parsed.where("merges is not null").select("file_id", "sheet_name", F.inline("merges"))


def bad_files(parsed: DataFrame, gated: DataFrame | None = None) -> DataFrame:
    """Unreadable files and sheets plus files refused by the gate."""
    bad = parsed.where("error is not null").select("file_id", "sheet_name", "error")
    if gated is None:
        return bad
    return bad.unionByName(gated.where("error is not null").select(
        F.col("path").alias("file_id"), F.lit(None).cast("string").alias("sheet_name"), "error"))


# --- CSV --------------------------------------------------------------------------------

# Files of up to this size are parsed whole in a task, larger ones by Spark's CSV reader.
MAX_CSV_BYTES = 128 << 20
# Columns of a larger file; a record with more makes the file a bad one.
MAX_CSV_COLUMNS = 512


def _parse_csv(file_id: str, content: bytes) -> Iterator[tuple]:
    """Records of a file in UTF-8, or Latin-1 if it is not that; empty records are left out."""
    csv.field_size_limit(sys.maxsize)
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = content.decode("latin-1")
    records = (cells for cells in csv.reader(io.StringIO(text, newline="")) if cells)
    for i, cells in enumerate(records):
        yield (file_id, "Sheet1", 0, i, [c or None for c in cells], ["s"] * len(cells), None, None)
    yield (file_id, "Sheet1", 0, None, None, None, [], None)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the records of each file, which follow each other; cells after the last filled one are not part of a record."""
    last, at = None, 0
    for batch in batches:
        files, cells = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        places, values = [], []
        for file_id, row in zip(files, cells):
            last, at = file_id, at + 1 if file_id == last else 0
            size = next((i for i in range(len(row), 0, -1) if row[i - 1] is not None), 0)
            places.append(at)
            values.append(row[:size])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(places, pa.int64()), pa.array(values, pa.list_(pa.string()))], ["file_id", "row_idx", "values"])


def read_large_csv(spark: SparkSession, paths: list[str], max_columns: int = MAX_CSV_COLUMNS) -> DataFrame:
    """CSV files of any size as (file_id, row_idx, values), by Spark's reader: one file is read as a stream in one task, in UTF-8."""
    names = [f"c{i}" for i in range(max_columns + 1)]
    read = spark.read.schema(", ".join(f"{n} string" for n in names)).csv(paths, header=False, multiLine=True, quote='"', escape='"', mode="PERMISSIVE")
    return read.select(F.col("_metadata.file_path").alias("file_id"), F.array(*names).alias("values")).mapInArrow(
        _numbered, "file_id string, row_idx bigint, values array<string>")


def read_csv_files(spark: SparkSession, path: str | list[str], max_bytes: int = MAX_CSV_BYTES, max_columns: int = MAX_CSV_COLUMNS) -> DataFrame:
    """CSV files as sheets of text rows, headerless, quoted line breaks kept.

    Files of up to ``max_bytes`` are parsed whole, each in one task. Larger ones go through Spark's CSV reader; there a
    record of more than ``max_columns`` cells makes the file a bad one, and empty cells at the end of a record are dropped.
    """
    small = read_parsed(spark, path, "csv", _parse_csv, max_bytes)
    large = _listing(spark, path).where((extension(F.col("file_id")) == "csv") & (F.col("length") > max_bytes)).select("path").collect()
    if not large:
        return small
    rows = read_large_csv(spark, [r["path"] for r in large], max_columns)
    wide = settle(rows.groupBy("file_id").agg(F.max(F.size("values")).alias("width")))
    bad = wide.where(F.col("width") > max_columns).select("file_id")
    good = wide.where(F.col("width") <= max_columns).select("file_id")
    sheet = {"sheet_name": F.lit("Sheet1"), "sheet_pos": F.lit(0)}
    return (
        small
        .unionByName(_parsed(rows.join(F.broadcast(good), "file_id"), file_id=F.col("file_id"), row_idx=F.col("row_idx"), values=F.col("values"),
                             types=F.transform("values", lambda _: F.lit("s")), **sheet))
        .unionByName(_parsed(good, file_id=F.col("file_id"), merges=F.array(), **sheet))
        .unionByName(_parsed(bad, file_id=F.col("file_id"), error=F.lit(f"Failed to read file: a record has more than {max_columns} cells.")))
    )
