"""Schema enforcement, typing and validation of the cleaned table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import number
from ..schema import INTEGER_FIELDS, KEYS, MONETARY_FIELDS, TARGET_DTYPES, TARGET_FIELDS, spark_type

CHECKED_FIELDS = [f for f in TARGET_FIELDS if f in MONETARY_FIELDS + INTEGER_FIELDS]
MAX_INT = 2**31 - 1


def enforce_columns(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Exactly the 17 fields in order; missing ones null, extra ones dropped."""
    have = set(df.columns)
    return df.select(
        *keep, *[(F.col(f"`{f}`") if f in have else F.lit(None).cast("string")).alias(f) for f in TARGET_FIELDS])


def schema_errors(columns: list[str]) -> list[str]:
    """Messages about column count, names and order (T12); metadata only."""
    errors = []
    if len(columns) != len(TARGET_FIELDS):
        errors.append(f"Expected {len(TARGET_FIELDS)} columns, got {len(columns)}: {columns}")
    missing = [f for f in TARGET_FIELDS if f not in columns]
    extra = [c for c in columns if c not in TARGET_FIELDS]
    if missing:
        errors.append(f"Missing columns: {missing}")
    if extra:
        errors.append(f"Extra columns: {extra}")
    if not missing and not extra and list(columns) != TARGET_FIELDS:
        errors.append(f"Columns in wrong order. Expected: {TARGET_FIELDS}")
    return errors


def schema_check(outputs: DataFrame) -> DataFrame:
    """The same messages for a table of column lists ``columns``, one list per output."""
    wanted = F.array(*[F.lit(f) for f in TARGET_FIELDS])
    shown = lambda x: F.concat(F.lit("["), F.array_join(F.transform(x, lambda c: F.concat(F.lit("'"), c, F.lit("'"))), ", "), F.lit("]"))
    missing, extra = F.array_except(wanted, "columns"), F.array_except("columns", wanted)
    complete = (F.size(missing) == 0) & (F.size(extra) == 0)
    return outputs.withColumn("errors", F.array_compact(F.array(
        F.when(F.size("columns") != len(TARGET_FIELDS), F.concat(
            F.lit(f"Expected {len(TARGET_FIELDS)} columns, got "), F.size("columns").cast("string"), F.lit(": "), shown(F.col("columns")))),
        F.when(F.size(missing) > 0, F.concat(F.lit("Missing columns: "), shown(missing))),
        F.when(F.size(extra) > 0, F.concat(F.lit("Extra columns: "), shown(extra))),
        F.when(complete & (F.col("columns") != wanted), F.concat(F.lit("Columns in wrong order. Expected: "), shown(wanted))))))


def with_numbers(cleaned: DataFrame) -> DataFrame:
    """The number of every checked cell as ``_n <field>``, parsed once for all that read it."""
    return cleaned.select("*", *[number(F.col(f"`{f}`")).alias(f"_n {f}") for f in CHECKED_FIELDS])


def nonconforming_cell(field: str) -> Column:
    """A non-null cell that is not the number its field asks for (T13); reads ``with_numbers``."""
    d = F.col(f"`_n {field}`")
    odd = d.isNull() | (d != F.floor(d)) if field in INTEGER_FIELDS else d.isNull()
    return F.col(f"`{field}`").isNotNull() & odd


def typed_table(cleaned: DataFrame, keep: list[str] = ("file_id", "sheet_name", "row_idx")) -> DataFrame:
    """Typed output: STRING, INT and DOUBLE. Cells that do not conform are null here and
    listed by ``nonconforming``, so nothing is lost between the two tables."""

    def typed(field: str) -> Column:
        if TARGET_DTYPES[field] == "str":
            return F.col(f"`{field}`").alias(field)
        d = F.col(f"`_n {field}`")
        if field in INTEGER_FIELDS:
            return F.when((d == F.floor(d)) & (F.abs(d) <= MAX_INT), F.floor(d)).try_cast(spark_type(field)).alias(field)
        return d.alias(field)

    return with_numbers(cleaned).select(*keep, *[typed(f) for f in TARGET_FIELDS])


def _bad_cells(cleaned: DataFrame, bad) -> DataFrame:
    """Cells for which ``bad(field)`` holds as (keys, row_idx, field, value)."""
    items = F.array(*[F.when(bad(f), F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("value"))) for f in CHECKED_FIELDS])
    return with_numbers(cleaned).select(*KEYS, "row_idx", F.inline(F.array_compact(items)))


def nonconforming(cleaned: DataFrame) -> DataFrame:
    """Cells the typed table cannot hold: (keys, row_idx, field, value)."""
    def lost(field: str) -> Column:
        if field in INTEGER_FIELDS:
            return nonconforming_cell(field) | (F.col(f"`{field}`").isNotNull() & (F.abs(F.col(f"`_n {field}`")) > MAX_INT))
        return nonconforming_cell(field)

    return _bad_cells(cleaned, lost)


def conformance_errors(cleaned: DataFrame) -> DataFrame:
    """Fields with non-conforming cells: count, first example and message.

    One pass: only bad cells leave their row, and their counts and first values are added up
    on the map side.
    """
    first = F.min(F.struct("row_idx", "value"))
    found = _bad_cells(cleaned, nonconforming_cell).groupBy(*KEYS, "field").agg(F.count("*").alias("n_bad"), first["value"].alias("example"))
    place = F.create_map(*[F.lit(x) for i, f in enumerate(TARGET_FIELDS) for x in (f, i)])
    kind = F.when(F.col("field").isin(INTEGER_FIELDS), "integer").otherwise("numeric")
    message = F.concat("field", F.lit(": "), F.col("n_bad").cast("string"), F.lit(" non-"), kind, F.lit(" value(s), e.g. '"), "example", F.lit("'"))
    return found.select(*KEYS, place[F.col("field")].alias("field_pos"), "field", kind.alias("kind"), "n_bad", "example", message.alias("message"))


def conformance_report(cleaned: DataFrame) -> DataFrame:
    """Per sheet and field: OK, Empty, "n non-numeric" or "n non-integer" (T14)."""
    def parts(i: int, f: str) -> list[Column]:
        cell = F.col(f"`{f}`")
        cols = [F.count(cell).alias(f"n{i}")]
        if f in CHECKED_FIELDS:
            d = F.col(f"`_n {f}`")
            cols.append(F.count(F.when(cell.isNotNull() & d.isNull(), 1)).alias(f"x{i}"))
            cols.append(F.count(F.when(d != F.floor(d), 1)).alias(f"f{i}"))
        return cols

    sums = with_numbers(cleaned).groupBy(*KEYS).agg(*[c for i, f in enumerate(TARGET_FIELDS) for c in parts(i, f)])

    def verdict(i: int, f: str) -> Column:
        out = F.when(F.col(f"n{i}") == 0, "Empty")
        if f in CHECKED_FIELDS:
            out = out.when(F.col(f"x{i}") > 0, F.concat(F.col(f"x{i}").cast("string"), F.lit(" non-numeric")))
        if f in INTEGER_FIELDS:
            out = out.when(F.col(f"f{i}") > 0, F.concat(F.col(f"f{i}").cast("string"), F.lit(" non-integer")))
        return out.otherwise("OK")

    items = F.array(*[
        F.struct(F.lit(i + 1).alias("position"), F.lit(f).alias("field"), F.lit(TARGET_DTYPES[f]).alias("expected_type"),
                 verdict(i, f).alias("values")) for i, f in enumerate(TARGET_FIELDS)])
    return sums.select(*KEYS, F.inline(items))


def validation_rollup(errors: DataFrame, sheets: DataFrame) -> DataFrame:
    """Per file: did all sheets pass, and their messages prefixed with the sheet.

    A sheet has at most one message per checked field.
    """
    text = F.concat(F.lit("["), "sheet_name", F.lit("] "), "message")
    by_file = errors.groupBy("file_id").agg(
        F.array_sort(F.collect_list(F.struct("sheet_name", "field_pos", text.alias("text")))).alias("_e"))
    files = sheets.groupBy("file_id").agg(F.count_distinct("sheet_name").alias("n_sheets"))
    return files.join(by_file, "file_id", "left").select(
        "file_id", "n_sheets", F.col("_e").isNull().alias("passed"),
        F.coalesce(F.col("_e.text"), F.array().cast("array<string>")).alias("errors"))


def zip_display(zip_code: Column) -> Column:
    """Zip as shown on export: five digits with leading zeros."""
    return F.lpad(zip_code.cast("string"), 5, "0")
