"""Sinks: cleaned tables, audit trail, mapping and score reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from ..functions.ops import NUMERIC
from ..functions.text import folder_name
from ..operators.transform import AUDIT_COLUMNS
from ..operators.validate import zip_display
from ..schema import KEYS, TARGET_FIELDS
from ..session import attach, settle

# Rows of one file of the cleaned table.
FILE_ROWS = 1_000_000

# Values come back as they were: blanks at their ends, quotes and line breaks included.
CSV = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
READ_CSV = CSV | {"multiLine": "true"}

# Exported audit headings in column order.
AUDIT_HEADINGS = dict(zip(AUDIT_COLUMNS, [
    "Entry ID", "Source Column", "Target Column", "Transformation Applied", "Before Value", "After Value",
    "Confidence", "Approved By", "Timestamp", "Recommendation ID", "Row Index"]))


def _by_folder(typed: DataFrame, folders: list[str], columns: list[str] | None = None) -> DataFrameWriter:
    """A writer that replaces the folders it has rows for and leaves all others.

    The rows of a sheet meet in one task and lie sorted in one file; a sheet of more than ``FILE_ROWS``
    rows is dealt by row number into as many files as it needs.
    """
    named = typed.withColumns({"file": folder_name(F.col("file_id")), "sheet": folder_name(F.col("sheet_name"))})
    dealt = named.repartition(*KEYS, F.floor(F.col("row_idx") / FILE_ROWS)).sortWithinPartitions(*folders, *KEYS, "row_idx")
    shown = dealt.select(*folders, *[F.col(f"`{c}`") for c in columns or typed.columns])
    return shown.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders)


def write_cleaned(typed: DataFrame, path: str, ranked: DataFrame | None = None) -> None:
    """Cleaned table, one folder per file and sheet, plus the primary alias: one folder per file.

    Sheets that are not in ``typed`` stay as they were exported before; a sheet that is, is replaced as a whole
    when the job commits, so a failed or repeated export neither loses nor doubles rows. A sheet that has lost all
    its rows has none to replace its folder with: ``clear_cleaned`` empties it.
    """
    _by_folder(typed, ["file", "sheet"]).parquet(f"{path}/cleaned")
    if ranked is not None:
        primary = ranked.where("is_primary").select(*KEYS)
        _by_folder(attach(typed, primary, KEYS), ["file"]).parquet(f"{path}/primary")


def clear_cleaned(sheets: DataFrame, path: str) -> None:
    """Empties the folders of ``sheets`` (KEYS): each is replaced by a row without a number, which ``read_cleaned`` leaves out."""
    held = sheets.sparkSession.read.parquet(f"{path}/cleaned").drop("file", "sheet")
    rows = sheets.select(*KEYS).distinct()
    marks = [F.lit(None).cast(f.dataType).alias(f.name) for f in held.schema if f.name not in KEYS]
    _by_folder(rows.select(*KEYS, *marks).select(*held.columns), ["file", "sheet"]).parquet(f"{path}/cleaned")


def read_cleaned(spark: SparkSession, path: str, part: str = "cleaned") -> DataFrame:
    """What ``write_cleaned`` exported so far: ``cleaned`` or ``primary``. Names come back as they were, spelled or null."""
    return spark.read.parquet(f"{path}/{part}").drop("file", "sheet").where("row_idx is not null")


def write_cleaned_csv(typed: DataFrame, path: str) -> None:
    """CSV export with the Zip shown as five digits (S8), in folders of their own per sheet (S13), replaced as in ``write_cleaned``."""
    shown = typed.withColumn("Zip", zip_display(F.col("Zip")))
    _by_folder(shown, ["file", "sheet"], TARGET_FIELDS).options(**CSV).csv(path)


def _exported(audit: DataFrame) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(h) for c, h in AUDIT_HEADINGS.items()]


def _nothing_applied(audit: DataFrame, stamp: str) -> DataFrame:
    """One placeholder row if there are no entries."""
    empty = {h: "" for h in AUDIT_HEADINGS.values()} | {"Entry ID": "No transformations applied", "Timestamp": stamp}
    nothing = audit.agg(F.count(F.lit(1)).alias("_n")).where("_n = 0")
    return nothing.select(*[F.lit(v).alias(h) for h, v in empty.items()])


def audit_export(audit: DataFrame, stamp: str) -> DataFrame:
    """The 11 exported columns as text; one placeholder row when nothing was applied."""
    return audit.select(*_exported(audit)).unionByName(_nothing_applied(audit, stamp))


def _append_new(rows: DataFrame, path: str, held: Callable[[], DataFrame], key: str) -> DataFrame:
    """The rows whose ``key`` is not among those ``held`` in their folder (column ``file``) yet, each once.

    Only the folders of the new rows are read for the keys they hold. An append becomes visible as a whole when
    its job commits, so it may be run again after a failure, or by mistake. Two appends of the same
    entries at the same time are not told apart.
    """
    rows = settle(rows.dropDuplicates(["file", key]))
    try:
        there = attach(held(), rows.select("file").distinct(), ["file"])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return rows
    return rows.join(there, ["file", key], "left_anti")


def write_audit(audit: DataFrame, path: str, stamp: str) -> None:
    """The exported audit as CSV, a folder per file; entries already there are not written again."""
    rows = audit.select(folder_name(F.col("file_id")).alias("file"), *_exported(audit))
    rows = rows.unionByName(_nothing_applied(audit, stamp).withColumn("file", F.lit("none")))
    schema = ", ".join(f"`{h}` string" for h in AUDIT_HEADINGS.values()) + ", file string"
    held = lambda: rows.sparkSession.read.schema(schema).options(**READ_CSV).csv(path).select("file", "Entry ID")
    _append_new(rows, path, held, "Entry ID").write.mode("append").options(**CSV).partitionBy("file").csv(path)


def native_audit(audit: DataFrame) -> DataFrame:
    """Audit entries with before and after as VARIANT: what a numeric operation made a number is one, all else is text."""
    after = F.col("after_value")
    number = F.when(F.col("transformation_applied").isin(*NUMERIC) & after.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), after)
    typed = F.coalesce(number.try_cast("bigint").cast("variant"), number.try_cast("double").cast("variant"), after.cast("variant"))
    return audit.select(*KEYS, *AUDIT_COLUMNS).withColumns({"before_value": F.col("before_value").cast("variant"), "after_value": typed})


def write_audit_json(audit: DataFrame, path: str) -> None:
    """Audit trail as JSON lines with native values, a folder per file; entries already there are not written again."""
    body = F.to_json(F.struct(*KEYS, *AUDIT_COLUMNS), {"ignoreNullFields": "false"})
    lines = native_audit(audit).select(folder_name(F.col("file_id")).alias("file"), "entry_id", body.alias("line"))
    held = lambda: lines.sparkSession.read.schema("line string, file string").text(path).select(
        "file", F.get_json_object("line", "$.entry_id").alias("entry_id"))
    _append_new(lines, path, held, "entry_id").select("file", "line").write.mode("append").partitionBy("file").text(path)


def read_audit_json(spark: SparkSession, path: str) -> DataFrame:
    """The entries as text columns, before and after as VARIANT with the types they were written with."""
    entry = spark.read.schema("line string, file string").text(path).select(F.parse_json("line").alias("entry"))
    texts = [F.variant_get("entry", f"$.{c}", "string").alias(c) for c in [*KEYS, *AUDIT_COLUMNS] if c not in ("before_value", "after_value")]
    return entry.select(*texts, *[F.variant_get("entry", f"$.{c}", "variant").alias(c) for c in ("before_value", "after_value")])


def mapping_json(mapping: DataFrame) -> DataFrame:
    """One JSON text per source column with method, confidence and evidence."""
    body = [c for c in mapping.columns if c not in KEYS]
    return mapping.select(*KEYS, F.to_json(F.struct(*body), {"ignoreNullFields": "false"}).alias("json"))


def write_mapping_json(mapping: DataFrame, path: str, mode: str = "overwrite") -> None:
    mapping.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_scores(scores: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Score report."""
    scores.write.mode(mode).json(path)
