"""Structure recovery: sheets of raw rows -> header row, sheet class, records.

A sheet is stored as ``rows(file_id, sheet_name, row_idx, values, types)``: one record per
sheet row holding its cells as arrays. Row filters then stay narrow, and only header
candidates (the first rows of every sheet) are ever exploded into cells. ``types`` holds
"s" text, "n" number, "b" bool, "d" date per cell; a null array means all text. Blank rows
may be missing from the table: a sheet has ``max(row_idx) + 1`` rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fixed, in_list, let, looks_numeric, rounded, shows, strip
from ..schema import KEYS, TARGET_FIELDS, TARGET_SYNONYMS, TOTAL_WORDS
from ..session import attach, is_small, settle

# Rows of a sheet that may hold its header; a larger bound can be given to ``detect_headers``.
MAX_HEADER_ROWS = 30
PRIMARY, SECONDARY, REJECT = "Primary", "Secondary", "Reject"

# Header scorers as (match, text, fill, numeric below) weights and the characters read as blanks.
SCORER = {"weights": (0.4, 0.2, 0.2, 0.2), "separators": r"(?U)[\s_\-.#()/]", "blank_rows_score": True}
ALTERNATIVE_SCORER = {"weights": (0.35, 0.25, 0.20, 0.20), "separators": r"(?U)[\s_\-.#]", "blank_rows_score": False}


def _known_headers(separators: str, both_forms: bool) -> list[str]:
    import re

    names = [n.lower() for f in TARGET_FIELDS for n in [f, *TARGET_SYNONYMS[f]]]
    pattern = separators.replace("(?U)", "")
    if both_forms:
        names += [re.sub(pattern, " ", n).strip() for n in names]
    return sorted(set(names))


def text_cells(values: Column, types: Column) -> Column:
    """Cells that hold text; other cells become null."""
    return F.when(types.isNull(), values).otherwise(
        F.zip_with(values, types, lambda v, t: F.when(t == "s", v))
    )


def is_blank_row(values: Column) -> Column:
    return ~F.exists(values, lambda v: v.isNotNull())


def nullify_blanks(rows: DataFrame) -> DataFrame:
    """Empty text reads as no value (R2)."""
    return rows.withColumn("values", F.transform("values", lambda v: F.nullif(v, F.lit(""))))


def sheet_dims(rows: DataFrame) -> DataFrame:
    """Height and width of every sheet."""
    return rows.groupBy(*KEYS).agg(
        (F.max("row_idx") + 1).alias("n_rows"), F.max(F.size("values")).alias("n_cols")
    )


# --- header detection -------------------------------------------------------------------

def header_scores(rows: DataFrame, dims: DataFrame, max_rows: int = MAX_HEADER_ROWS,
                  scorer: dict = SCORER) -> DataFrame:
    """Score of every candidate header row (R4, R6). Reads only the first rows of each sheet."""
    known = _known_headers(scorer["separators"], both_forms=scorer["blank_rows_score"])
    w_match, w_text, w_fill, w_below = scorer["weights"]

    def matches(v: Column) -> Column:
        low = F.lower(v)
        hit = in_list(strip(F.regexp_replace(low, scorer["separators"], " ")), known)
        return hit | in_list(low, known) if scorer["blank_rows_score"] else hit

    text = text_cells(F.col("values"), F.col("types"))
    counted = (
        rows.where(F.col("row_idx") <= max_rows)
        .select(
            *KEYS, "row_idx",
            F.size(F.filter("values", lambda v: v.isNotNull())).alias("n_cells"),
            F.size(F.filter(text, lambda v: v.isNotNull() & ~looks_numeric(v))).alias("n_text"),
            F.size(F.filter(text, matches)).alias("field_matches"),
            F.size(F.filter("values", looks_numeric)).alias("n_numeric"),
        )
    )
    order = Window.partitionBy(*KEYS).orderBy("row_idx")
    cells = F.greatest(F.col("n_cells"), F.lit(1))
    below = F.when(
        F.lead("row_idx").over(order) == F.col("row_idx") + 1, F.lead(F.col("n_numeric") / cells).over(order)
    )
    return (
        counted.withColumn("numeric_below", F.coalesce(below, F.lit(0.0)))
        .where((F.col("row_idx") < max_rows) & (F.col("n_cells") > 0))
        .join(dims, KEYS)
        .withColumn("score", w_match * (F.col("field_matches") / cells) + w_text * (F.col("n_text") / cells)
                    + w_fill * (F.col("n_cells") / F.col("n_cols")) + w_below * F.col("numeric_below"))
        .select(*KEYS, "row_idx", "n_cells", "n_text", "field_matches", "numeric_below", "score")
    )


def detect_headers(rows: DataFrame, dims: DataFrame, max_rows: int = MAX_HEADER_ROWS,
                   scorer: dict = SCORER) -> DataFrame:
    """Best header row per sheet, first one on ties; row 0 when the first rows are all blank."""
    best = Window.partitionBy(*KEYS).orderBy(F.desc("score"), "row_idx")
    top = (
        header_scores(rows, dims, max_rows, scorer)
        .withColumn("_r", F.row_number().over(best)).where("_r = 1")
        .select(*KEYS, F.col("row_idx").alias("header_row"), "score", "field_matches")
    )
    return dims.join(top, KEYS, "left").select(
        *KEYS, "n_rows", "n_cols",
        F.coalesce("header_row", F.lit(0)).alias("header_row"),
        F.coalesce("score", F.lit(0.0)).alias("header_score"),
        F.coalesce("field_matches", F.lit(0)).alias("field_matches"),
    )


# --- sheet scoring ----------------------------------------------------------------------

def sheet_profile(rows: DataFrame) -> DataFrame:
    """Density profile of every sheet (R7) in one pass with map-side sums."""
    filled = F.size(F.filter("values", lambda v: v.isNotNull()))
    numeric = F.size(F.filter("values", looks_numeric))
    nonblank = F.size(F.filter("values", lambda v: strip(v) != ""))
    sums = rows.select(
        *KEYS, "row_idx", F.size("values").alias("_w"), filled.alias("_f"), numeric.alias("_n"), nonblank.alias("_b"),
    ).groupBy(*KEYS).agg(
        (F.max("row_idx") + 1).alias("row_count"), F.max("_w").alias("col_count"),
        F.sum("_f").alias("_f"), F.sum("_n").alias("_n"), F.sum("_b").alias("_b"),
        F.sum((F.col("_f") > 0).cast("bigint")).alias("_filled_rows"),
    )
    cells = F.col("row_count") * F.col("col_count")
    data = F.nullif(F.col("_b"), F.lit(0))
    return sums.select(
        *KEYS, "row_count", "col_count",
        F.coalesce(rounded(F.col("_f") / F.nullif(cells, F.lit(0)), 4), F.lit(0.0)).alias("non_null_ratio"),
        F.coalesce(rounded((F.col("_b") - F.col("_n")) / data, 4), F.lit(0.0)).alias("text_density"),
        F.coalesce(rounded(F.col("_n") / data, 4), F.lit(0.0)).alias("numeric_density"),
        (F.col("row_count") - F.col("_filled_rows")).alias("blank_row_count"),
    )


def below_header(rows: DataFrame, headers: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """Type consistency and data continuity of every sheet below its header, in one pass.

    The whole sheet counts, or its first ``sample_rows`` rows there. Cells are added up per
    column on the map side; the first filled cell of a row stands for the row.
    """
    below = attach(rows.select(*KEYS, "row_idx", "values"), headers.select(*KEYS, "header_row"), KEYS).where("row_idx > header_row")
    if sample_rows is not None:
        below = below.where(F.col("row_idx") - F.col("header_row") <= sample_rows)
    first = F.array_position(F.transform("values", lambda v: v.isNotNull()), F.lit(True)) - 1
    marks = below.select(*KEYS, "values", first.alias("_first"))  # below the generator: once for a row
    cells = marks.select(*KEYS, "_first", F.posexplode("values").alias("col_idx", "value")).where("value is not null")
    by_column = cells.groupBy(*KEYS, "col_idx").agg(
        F.avg(looks_numeric(F.col("value")).cast("int")).alias("_ratio"), F.sum((F.col("col_idx") == F.col("_first")).cast("bigint")).alias("_rows"))
    steady = (F.col("_ratio") > 0.80) | (F.col("_ratio") < 0.20)
    by_sheet = by_column.groupBy(*KEYS).agg(F.sum(steady.cast("int")).alias("_steady"), F.sum("_rows").alias("_filled"))
    height = F.col("n_rows") - F.col("header_row") - 1
    window = height if sample_rows is None else F.least(F.lit(sample_rows), height)
    return headers.join(by_sheet, KEYS, "left").select(
        *KEYS, F.coalesce(F.col("_steady") / F.nullif("n_cols", F.lit(0)), F.lit(0.0)).alias("type_consistency"),
        F.coalesce(F.col("_filled") / F.nullif(window, F.lit(0)), F.lit(0.0)).alias("data_continuity"))


def type_consistency(rows: DataFrame, headers: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """Share of columns that are mostly numeric or mostly text below the header."""
    return below_header(rows, headers, sample_rows).drop("data_continuity")


def data_continuity(rows: DataFrame, headers: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """Share of non-blank rows below the header."""
    return below_header(rows, headers, sample_rows).drop("type_consistency")


def sheet_figures(rows: DataFrame, headers: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """``sheet_profile`` and ``below_header`` of every sheet together: each cell is looked at once.

    Cells are added up per column on the map side; the first filled cell of a row stands for it.
    """
    at = F.col("row_idx") - F.col("header_row")
    judged = at > 0 if sample_rows is None else at.between(1, sample_rows)
    first = F.array_position(F.transform("values", lambda v: v.isNotNull()), F.lit(True)) - 1
    # What holds for the row is computed below the generator, once and not for each of its cells.
    marks = attach(rows.select(*KEYS, "row_idx", "values"), headers.select(*KEYS, "header_row"), KEYS).select(
        *KEYS, "values", judged.alias("_judged"), first.alias("_first"))
    cells = marks.select(*KEYS, "_judged", "_first", F.posexplode("values").alias("col_idx", "value")).where("value is not null")
    marked = cells.select(*KEYS, "col_idx", "_judged", (F.col("col_idx") == F.col("_first")).alias("_lead"),
                          looks_numeric(F.col("value")).alias("_number"), shows(F.col("value")).alias("_shown"))
    count = lambda *flags: F.count(F.when(reduce(lambda x, y: x & y, [F.col(f) for f in flags]), 1))
    by_column = marked.groupBy(*KEYS, "col_idx").agg(
        F.count(F.lit(1)).alias("_f"), count("_number").alias("_n"), count("_shown").alias("_b"), count("_lead").alias("_filled_rows"),
        count("_judged").alias("_jf"), count("_judged", "_number").alias("_jn"), count("_judged", "_lead").alias("_jrows"))
    ratio = F.col("_jn") / F.nullif("_jf", F.lit(0))
    sums = by_column.groupBy(*KEYS).agg(
        *[F.sum(c).alias(c) for c in ("_f", "_n", "_b", "_filled_rows", "_jrows")], F.count(F.when((ratio > 0.80) | (ratio < 0.20), 1)).alias("_steady"))
    joined = headers.join(sums, KEYS, "left").fillna(0, ["_f", "_n", "_b", "_filled_rows", "_jrows", "_steady"])
    height = F.col("n_rows") - F.col("header_row") - 1
    window = height if sample_rows is None else F.least(F.lit(sample_rows), height)
    share = lambda part, of: F.coalesce(F.col(part) / F.nullif(of, F.lit(0)), F.lit(0.0))
    return joined.select(
        *KEYS, F.col("n_rows").alias("row_count"), F.col("n_cols").alias("col_count"),
        rounded(share("_f", F.col("n_rows") * F.col("n_cols")), 4).alias("non_null_ratio"),
        rounded(F.coalesce((F.col("_b") - F.col("_n")) / F.nullif("_b", F.lit(0)), F.lit(0.0)), 4).alias("text_density"),
        rounded(share("_n", F.col("_b")), 4).alias("numeric_density"), (F.col("n_rows") - F.col("_filled_rows")).alias("blank_row_count"),
        share("_steady", F.col("n_cols")).alias("type_consistency"), share("_jrows", window).alias("data_continuity"))


def score_sheets(rows: DataFrame, headers: DataFrame, merges: DataFrame | None = None, sample_rows: int | None = None) -> DataFrame:
    """Composite score, class, reasons and issues per sheet."""
    joined = headers.join(sheet_figures(rows, headers, sample_rows), KEYS)
    if merges is None:
        joined = joined.withColumn("merged_cell_count", F.lit(0).cast("bigint"))
    else:
        counts = merges.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("merged_cell_count"))
        joined = joined.join(counts, KEYS, "left").fillna(0, ["merged_cell_count"])
    below = F.col("n_rows") - F.col("header_row") - 1
    match = F.least(F.lit(1.0), F.col("field_matches") / F.lit(len(TARGET_FIELDS)) * 3)
    volume = F.least(F.lit(1.0), below / 100.0)
    scored = joined.withColumn("rows_below", below).withColumn("header_match", match).withColumn(
        "composite", 0.35 * match + 0.25 * F.col("non_null_ratio") + 0.20 * F.col("type_consistency") + 0.20 * volume)
    composite, matches = F.col("composite"), F.col("field_matches")
    return scored.withColumn(
        "classification",
        F.when((composite >= 0.45) & (matches >= 3), PRIMARY)
        .when((composite >= 0.25) | (matches >= 1), SECONDARY).otherwise(REJECT),
    ).withColumn("confidence", rounded(composite, 4)).withColumn(
        "reasoning",
        F.array_compact(F.array(
            F.format_string("Header row detected at row %d (0-indexed).", F.col("header_row").cast("bigint")),
            F.format_string("Synonym field matches: %d out of 17 target fields.", matches.cast("bigint")),
            F.concat(F.lit("Header match score: "), fixed("header_match", 2), F.lit(", Data density: "), fixed("non_null_ratio", 2),
                     F.lit(".")),
            F.concat(F.lit("Type consistency: "), fixed("type_consistency", 2), F.lit(", Data continuity: "),
                     fixed("data_continuity", 2), F.lit(".")),
            F.format_string("Data rows below header: %d.", below.cast("bigint")),
            F.concat(F.lit("Composite score: "), fixed(composite, 3), F.lit(" → "), F.col("classification"), F.lit(".")),
            F.when(F.col("merged_cell_count") > 0, F.format_string(
                "Merged cells detected (%d ranges) — unmerged for processing.", "merged_cell_count")),
        )),
    ).withColumn(
        "issues",
        F.array_compact(F.array(
            F.when(matches < 2, F.format_string(
                "Very few SOV field matches (%d) — may not be a SOV sheet.", matches.cast("bigint"))),
            F.when(below < 5, F.lit("Fewer than 5 data rows below the detected header.")),
        )),
    )


def rank_sheets(scored: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """Order the sheets of each file and mark its primary and data sheets.

    ``sheets(file_id, sheet_name, sheet_pos)`` adds sheets without any row (Reject) and the
    workbook order for ties; without it ties fall to the sheet name.
    """
    if sheets is not None:
        scored = sheets.select(*KEYS, "sheet_pos").join(scored, KEYS, "left")
        empty = F.col("classification").isNull()
        scored = (
            scored.withColumn("reasoning", F.when(empty, F.array(F.lit("Sheet is empty."))).otherwise(F.col("reasoning")))
            .withColumn("issues", F.when(empty, F.array(F.lit("Empty sheet"))).otherwise(F.col("issues")))
            .fillna(REJECT, ["classification"])
            .fillna(0.0, [c for c in ["confidence", "composite", "header_score", "non_null_ratio", "text_density",
                                      "numeric_density", "type_consistency", "data_continuity"]])
            .fillna(0, ["header_row", "field_matches", "n_rows", "n_cols", "row_count", "col_count",
                        "blank_row_count", "merged_cell_count", "rows_below"])
        )
        tie = F.col("sheet_pos")
    else:
        tie = F.col("sheet_name")
    rank = F.when(F.col("classification") == PRIMARY, 0).when(F.col("classification") == SECONDARY, 1).otherwise(2)
    order = Window.partitionBy("file_id").orderBy(rank, F.desc("confidence"), tie)
    return (
        scored.withColumn("sheet_rank", F.row_number().over(order))
        .withColumn("is_primary", F.col("sheet_rank") == 1)
        .withColumn("is_data", F.col("is_primary") | (F.col("classification") == PRIMARY))
    )


def sheet_manifest(ranked: DataFrame) -> DataFrame:
    """Sheet report."""
    return ranked.select(
        *KEYS, "sheet_rank", "classification", "confidence", "header_row",
        F.greatest(F.lit(0), F.col("n_rows") - F.col("header_row") - 1).alias("data_rows"),
        "field_matches", "non_null_ratio", "merged_cell_count",
    )


# --- headers and records ----------------------------------------------------------------

def header_names(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Source column names: cleaned, positional when unnamed, unique within the sheet."""
    lowest = headers.agg(F.max("header_row")).first()[0] or 0  # so that only the first rows are read
    near = rows.where(F.col("row_idx") <= lowest).select(*KEYS, "row_idx", "values")
    names = attach(near, headers.select(*KEYS, "header_row"), KEYS).where("row_idx = header_row")
    at_header = headers.join(names.select(*KEYS, "values"), KEYS, "left")
    cells = at_header.where("n_cols > 0").select(
        *KEYS, "values", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("col_idx"))
    raw = strip(F.regexp_replace(F.get("values", F.col("col_idx")), r"[\r\n\t]+", " "))
    low = F.lower(raw)
    unnamed = raw.isNull() | (raw == "") | (low == "nan") | low.startswith("unnamed:")
    name = F.when(unnamed, F.concat(F.lit("_col_"), F.col("col_idx").cast("string"))).otherwise(raw)
    repeat = Window.partitionBy(*KEYS, "_name").orderBy("col_idx")
    n = F.row_number().over(repeat) - 1
    return cells.withColumn("_name", name).select(
        *KEYS, "col_idx",
        F.when(n > 0, F.concat("_name", F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(F.col("_name"))
        .alias("source_column"),
    )


def visible_cells(values: Column) -> Column:
    """Stripped cells that show something."""
    return F.filter(F.transform(values, strip), lambda v: v != "")


def is_total_row(visible: Column) -> Column:
    """Any visible cell is exactly a total or footer word."""
    longest = max(len(w) for w in TOTAL_WORDS)
    return F.exists(visible, lambda v: (F.length(v) <= longest) & F.lower(v).isin(TOTAL_WORDS))


def is_note_row(visible: Column, values: Column, types: Column) -> Column:
    """No visible cell, or a single visible cell that is free text.

    Blank rows count as notes, so this also drops them (R16).
    """
    texts = F.filter(text_cells(values, types), lambda v: strip(v) != "")
    return (F.size(visible) == 0) | ((F.size(visible) == 1) & (F.size(texts) == 1) & ~looks_numeric(F.get(visible, F.lit(0))))


def extract_records(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Data rows below each header without blank, total and note rows.

    Narrow apart from the lookup of the sheet's header row.
    """
    values, types = F.col("values"), F.col("types")
    is_data = let(visible_cells(values), lambda seen: ~is_note_row(seen, values, types) & ~is_total_row(seen))
    return (
        attach(rows, headers.select(*KEYS, "header_row"), KEYS)
        .where((F.col("row_idx") > F.col("header_row")) & is_data)
        .drop("header_row")
    )


def reindex_rows(records: DataFrame, band: int = 65536, name: str = "data_idx") -> DataFrame:
    """Dense position 0..n-1 within each sheet.

    Rows are counted per band of ``row_idx``; a running sum over the band counts gives every
    band its first position, and rows are only numbered inside their band. No task sees more
    than one band of a sheet.
    """
    banded = records.withColumn("_band", F.floor(F.col("row_idx") / band))
    before = Window.partitionBy(*KEYS).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(
        banded.groupBy(*KEYS, "_band").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    )
    inside = Window.partitionBy(*KEYS, "_band").orderBy("row_idx")
    return (
        attach(banded, starts, [*KEYS, "_band"])
        .withColumn(name, F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_band", "_start")
    )


def positions_of(records: DataFrame, wanted: DataFrame, band: int = 65536, name: str = "data_idx") -> DataFrame:
    """Dense positions of a few rows ``wanted(keys, row_idx)`` among the records of their sheets.

    Rows are counted per band of ``row_idx``; only bands that hold a wanted row are numbered. No
    cells move, and no row outside those bands.
    """
    banded = records.select(*KEYS, "row_idx", F.floor(F.col("row_idx") / band).alias("_band"))
    before = Window.partitionBy(*KEYS).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    starts = banded.groupBy(*KEYS, "_band").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    spots = settle(wanted.select(*KEYS, "row_idx", F.floor(F.col("row_idx") / band).alias("_band")).distinct())
    bands = settle(starts.join(spots.select(*KEYS, "_band").distinct(), [*KEYS, "_band"]))
    inside = Window.partitionBy(*KEYS, "_band").orderBy("row_idx")
    numbered = attach(banded, bands, [*KEYS, "_band"]).withColumn(name, F.col("_start") + F.row_number().over(inside) - 1)
    return numbered.select(*KEYS, "row_idx", name).join(spots.select(*KEYS, "row_idx"), [*KEYS, "row_idx"])


def rows_to_cells(rows: DataFrame) -> DataFrame:
    """Rows -> long cells, non-null only."""
    kinds = F.coalesce(F.col("types"), F.transform("values", lambda v: F.lit("s")))
    zipped = F.arrays_zip(F.col("values").alias("value"), kinds.alias("cell_type"))
    return (
        rows.select(*KEYS, "row_idx", F.posexplode(zipped).alias("col_idx", "_c"))
        .select(*KEYS, "row_idx", "col_idx", "_c.value", "_c.cell_type").where("value is not null")
    )


def cells_to_rows(cells: DataFrame) -> DataFrame:
    """Long cells -> rows (R20). Groups hold the cells of one sheet row."""
    packed = cells.groupBy(*KEYS, "row_idx").agg(
        F.max("col_idx").alias("_last"),
        F.map_from_entries(F.collect_list(F.struct("col_idx", F.struct("value", "cell_type")))).alias("_m"),
    )
    at = F.sequence(F.lit(0), F.col("_last"))
    return packed.select(
        *KEYS, "row_idx",
        F.transform(at, lambda i: F.try_element_at("_m", i)["value"]).alias("values"),
        F.transform(at, lambda i: F.coalesce(F.try_element_at("_m", i)["cell_type"], F.lit("s"))).alias("types"),
    )


def column_values(records: DataFrame) -> DataFrame:
    """Every cell of every record, including nulls: (keys, row_idx, col_idx, value)."""
    return records.select(*KEYS, "row_idx", F.posexplode("values").alias("col_idx", "value"))


# --- merged ranges ----------------------------------------------------------------------

def fill_down(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Copy the top-left value of merged ranges down their first column.

    ``ranges(file_id, sheet_name, min_row, max_row, min_col, max_col)``. Banner ranges that
    span columns only keep their top-left cell. Rows that exist only through a fill are added.
    """
    corners = rows.select(*KEYS, F.col("row_idx").alias("min_row"), "values", "types").join(
        ranges.select(*KEYS, "min_row", "max_row", "min_col"), [*KEYS, "min_row"])
    cell = F.struct(
        F.get("values", F.col("min_col")).alias("v"),
        F.coalesce(F.get("types", F.col("min_col")), F.lit("s")).alias("t"),
    )
    row_type = rows.schema["row_idx"].dataType
    fills = settle(
        corners.select(*KEYS, "min_col", cell.alias("cell"),
                       F.explode(F.sequence(F.col("min_row"), F.col("max_row").cast(row_type))).alias("row_idx"))
        .groupBy(*KEYS, "row_idx").agg(
            F.map_from_entries(F.collect_list(F.struct("min_col", "cell"))).alias("_fill"),
            F.max("min_col").alias("_last"))
    )
    on = [*KEYS, "row_idx"]
    side = F.broadcast(fills) if is_small(fills) else fills
    present = rows.select(*on).join(side.select(*on), on)
    missing = fills.join(present, on, "left_anti").select(
        *on, F.array().cast("array<string>").alias("values"), F.array().cast("array<string>").alias("types"),
        "_fill", "_last")
    joined = rows.select(*on, "values", "types").join(side, on, "left").unionByName(missing)
    width = F.greatest(F.size("values"), F.coalesce(F.col("_last") + 1, F.lit(0)))
    at = F.sequence(F.lit(0), width - 1)
    filled = F.col("_fill").isNotNull()

    def pick(source: str, part: str, default: Column):
        return lambda i: F.when(F.array_contains(F.map_keys("_fill"), i), F.try_element_at("_fill", i)[part]).otherwise(
            F.coalesce(F.get(source, i), default))

    nothing = F.lit(None).cast("string")
    return joined.select(
        *on,
        F.when(filled, F.transform(at, pick("values", "v", nothing))).otherwise(F.col("values")).alias("values"),
        F.when(filled, F.transform(at, pick("types", "t", F.lit("s")))).otherwise(F.col("types")).alias("types"),
    )


def _column_letters(idx: Column) -> Column:
    def letter(i: Column) -> Column:
        return F.chr(i + 65)

    i = idx.cast("bigint")
    second = F.floor(i / 26) - 1
    third = F.floor(second / 26) - 1
    return F.when(i < 26, letter(i)).when(i < 702, F.concat(letter(second), letter(i % 26))).otherwise(
        F.concat(letter(third), letter(second % 26), letter(i % 26)))


def merged_range_names(ranges: DataFrame) -> DataFrame:
    """One row per merged range with its A1-style name."""
    name = F.concat(
        _column_letters(F.col("min_col")), (F.col("min_row") + 1).cast("string"), F.lit(":"),
        _column_letters(F.col("max_col")), (F.col("max_row") + 1).cast("string"))
    return ranges.select(*KEYS, name.alias("range_name"))


# --- several sheets ---------------------------------------------------------------------

def concat_sheets(frames: list[DataFrame]) -> DataFrame:
    """Union of a few tables over the union of their columns (S6); ``concat_records`` takes any number of sheets."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def concat_records(rows: DataFrame, names: DataFrame) -> DataFrame:
    """All sheets as one table over the union of their columns, each row with its sheet as lineage.

    ``rows(keys, row_idx, values)``, ``names(keys, col_idx, source_column)``, names distinct within a sheet. Columns
    come in the order of their first position, then by name; a column that a sheet lacks is null.

    A row becomes an object of its named values, read back with the merged schema of all sheets, so the plan is
    the same for one family of columns and for thousands: one narrow pass after the names are attached. Only the
    distinct names, which are the schema of the result, come to the driver.
    """
    merged = names.groupBy("source_column").agg(F.min("col_idx").alias("at")).orderBy("at", "source_column").collect()
    schema = T.StructType([T.StructField(r["source_column"], T.StringType()) for r in merged])
    if not merged:
        return rows.select(*KEYS, "row_idx")
    packed = names.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("col_idx", "source_column"))).alias("_names"))
    named = attach(rows.select(*KEYS, "row_idx", "values"), packed, KEYS)
    pairs = F.transform("_names", lambda c: F.struct(c["source_column"], F.get("values", c["col_idx"])))
    filled = F.map_from_entries(F.filter(pairs, lambda p: p["col2"].isNotNull()))
    read = named.select(*KEYS, "row_idx", F.from_json(F.to_json(filled), schema).alias("_row"))
    return read.select(*KEYS, "row_idx", *[F.col("_row").getField(f.name).alias(f.name) for f in schema])


# --- one row per record, one column per field -------------------------------------------

def wide_by_field(cells: DataFrame, fields: list[str], field: str = "target", value: str = "value") -> DataFrame:
    """Long cells -> one row per record with a column per field.

    ``fields`` are given, so Spark need not read the data once more for the distinct values. Of several cells of
    one record and field the least value counts. A record without any of the fields has a row of nulls.
    """
    return cells.groupBy(*KEYS, "row_idx").pivot(field, fields).agg(F.min(value))


def long_by_field(wide: DataFrame, fields: list[str], field: str = "target", value: str = "value") -> DataFrame:
    """Wide records -> long cells, null cells left out (R20); a narrow plan."""
    columns = [F.col(f"`{f}`") for f in fields]
    return wide.unpivot([*KEYS, "row_idx"], columns, field, value).where(F.col(value).isNotNull())


def column_lineage(names: DataFrame) -> DataFrame:
    """Sheets of a file that carry each source column (S6); groups hold sheets of one file."""
    return names.groupBy("file_id", "source_column").agg(F.array_sort(F.collect_set("sheet_name")).alias("sheets"))


def coalesce_by_position(values: Column, positions: list[Column]) -> Column:
    """First non-null of several source cells in priority order."""
    return F.coalesce(*[F.get(values, p) for p in positions])
