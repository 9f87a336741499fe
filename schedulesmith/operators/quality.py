"""Quality rules, completeness, score and grade (Q1-Q19).

Input is the mapped wide table: ``file_id, sheet_name, row_idx`` plus one text column per
target field (17-field table of ``transform.mapped_table``). All rules are counted in one
projection and one map-side-combined aggregate. Row lists and examples come from a second
pass that keeps at most 50 rows per rule before anything is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fixed, in_list, number, rounded, strip, strip_cell
from ..schema import INTEGER_FIELDS, KEYS, MONETARY_FIELDS, SPRINKLER_CODES, STATE_CODES, TARGET_FIELDS
from ..session import attach, first_rows, settle

LISTED_ROWS = 50
NAMED_VALUES = 5
# Rows below this number are one band of their sheet; from there on every doubling of the row number is one.
BAND_ROWS = 4096


@dataclass(frozen=True)
class Rule:
    """One row rule: which cells break it and how the finding is reported."""

    name: str
    field: str
    broken: Column
    issue_type: str
    severity: str
    operation: str
    confidence: float
    evidence: str  # "{n}" is the number of rows, "{values}" the first distinct values
    lists_rows: bool = True


def with_numbers(mapped: DataFrame) -> DataFrame:
    """Parsed numbers of the numeric fields as ``_n <field>``, once for all rules that use them."""
    def parsed(f: str) -> Column:
        cell = F.col(f"`{f}`")
        return number(cell, "$,", parens="wrapped") if f in MONETARY_FIELDS else number(cell, ",")

    fields = [f for f in MONETARY_FIELDS + INTEGER_FIELDS if f in mapped.columns]
    return mapped.select("*", *[parsed(f).alias(f"_n {f}") for f in fields])


def row_rules(current_year: int, fields: list[str] | None = None) -> list[Rule]:
    """All rules that judge one cell at a time (Q2-Q9, Q11, Q12), in reporting order.

    They read the columns of ``with_numbers``.
    """
    fields = TARGET_FIELDS if fields is None else fields
    rules: list[Rule] = []

    def add(field: str, name: str, broken: Column, *spec, lists_rows: bool = True) -> None:
        if field in fields:
            cell = F.col(f"`{field}`")
            rules.append(Rule(name, field, cell.isNotNull() & F.coalesce(broken, F.lit(True)), *spec, lists_rows))

    for f in MONETARY_FIELDS:
        cell = F.col(f"`{f}`")
        amount = F.col(f"`_n {f}`")
        add(f, "currency_format", cell.rlike(r"[$,]"), "format", "medium", "strip_currency", 0.98,
            f"{f}: {{n}} rows contain currency symbols/commas.", lists_rows=False)
        add(f, "negative_amount", F.coalesce(amount < 0, F.lit(False)), "logical_error", "high", "flag_for_review", 1.0,
            f"{f}: {{n}} rows have negative monetary values.")
        add(f, "non_numeric_amount", amount.isNull(), "type_error", "medium", "flag_for_review", 1.0,
            f"{f}: {{n}} rows contain non-numeric values.")
    year = F.col("`_n Year Built`")
    # The year is cut to a whole number towards zero before the comparison.
    whole_year = F.when(year >= 0, F.floor(year)).otherwise(F.ceil(year))
    add("Year Built", "year_range", (whole_year > current_year) | (whole_year < 1700), "logical_error", "high",
        "to_year_int", 1.0, f"Year Built: {{n}} rows have invalid years (expected 1700–{current_year}).")
    add("Storeys", "storeys_below_one", F.col("`_n Storeys`") < 1, "logical_error", "medium",
        "flag_for_review", 0.95, "Storeys: {n} rows have values < 1.")
    add("Number of Buildings", "buildings_below_one",
        F.coalesce(F.col("`_n Number of Buildings`") < 1, F.lit(False)), "logical_error", "medium",
        "flag_for_review", 0.95, "Number of Buildings: {n} rows have values < 1.")
    add("Fire Sprinklers (Y/N)", "sprinkler_code",
        ~F.upper(strip_cell(F.col("`Fire Sprinklers (Y/N)`"))).isin(SPRINKLER_CODES), "format", "medium",
        "normalize_sprinkler_code", 0.95,
        "Fire Sprinklers (Y/N): {n} rows have non-standard codes: {values}.")
    add("State", "state_code", ~in_list(F.upper(strip_cell(F.col("State"))), STATE_CODES), "format", "medium",
        "state_to_abbrev", 0.90, "State: {n} rows have non-standard values: {values}.")
    zip_digits = F.regexp_replace(F.substring_index(F.translate(strip_cell(F.col("Zip")), ",", ""), ".", 1), r"\D", "")
    add("Zip", "zip_length", F.length(zip_digits) != 5, "format", "low", "to_zip", 0.90,
        "Zip: {n} rows have non-5-digit ZIP codes.")
    for f in INTEGER_FIELDS:
        d = F.col(f"`_n {f}`")
        add(f, "non_integer", d != F.floor(d), "type_error", "low", "to_int", 0.95,
            f"{f}: {{n}} rows have non-integer values.")
    return rules


# Position of the duplicate rule among the row rules (after State).
def _order(rules: list[Rule]) -> dict[str, int]:
    out, at = {}, len(TARGET_FIELDS)
    for i, r in enumerate(rules):
        if r.name in ("zip_length", "non_integer") and "duplicate" not in out:
            out["duplicate"] = at + i
            at += 1
        out[f"{r.name}/{r.field}"] = at + i
    out.setdefault("duplicate", at + len(rules))
    return out


def row_band(row: Column) -> Column:
    """Band of a sheet row, growing with the row number; rows without a number, which come first, are band -1."""
    return F.when(row.isNull(), -1).when(row < BAND_ROWS, 0).otherwise(F.floor(F.log2(row / BAND_ROWS)).cast("int") + 1)


def banded_counts(mapped: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rule_counts`` per sheet and band of rows, and the last row of the band; ``summed_counts`` adds up the bands.

    They tell how far into a sheet the first broken rows of a rule reach. Their number grows with the logarithm of
    the longest sheet.
    """
    banded = mapped.withColumn("_band", row_band(F.col("row_idx")))
    return rule_counts(banded, rules, [*KEYS, "_band"], [F.max("row_idx").alias("_last")])


def summed_counts(banded: DataFrame) -> DataFrame:
    return banded.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in banded.columns if c not in (*KEYS, "_band", "_last")])


def listed_until(banded: DataFrame, n_rules: int, n: int = LISTED_ROWS) -> DataFrame:
    """Per sheet of more than one band, the row up to which each rule needs to be searched for its first ``n`` broken rows.

    ``_until`` has a row per rule, null where none is broken; ``_most`` is the last of them.
    """
    tall = banded.where("_band > 0").select(*KEYS).distinct()
    items = F.array(*[F.struct(F.lit(i).alias("rule"), F.col(f"rule_{i}").alias("n")) for i in range(n_rules)])
    found = banded.join(tall, KEYS, "left_semi").select(*KEYS, "_band", "_last", F.inline(items))
    before = Window.partitionBy(*KEYS, "rule").orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    needed = found.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).where((F.col("_before") < n) & (F.col("n") > 0))
    ends = needed.groupBy(*KEYS, "rule").agg(F.max("_last").alias("_end")).groupBy(*KEYS).agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "_end"))).alias("_ends"), F.max("_end").alias("_most"))
    sheets = tall.join(ends.hint("merge"), KEYS, "left")
    return sheets.select(*KEYS, F.array(*[F.try_element_at("_ends", F.lit(i)) for i in range(n_rules)]).alias("_until"),
                         F.coalesce("_most", F.lit(-1)).alias("_most"))


def rule_counts(mapped: DataFrame, rules: list[Rule], keys: list[str] = KEYS, more: list[Column] = ()) -> DataFrame:
    """Rows, empty cells per field and broken cells per rule: one row per sheet, one pass. ``more`` are further aggregates."""
    present = [f for f in TARGET_FIELDS if f in mapped.columns]
    # Each rule is tested once per row; the aggregate only adds up booleans.
    tested = with_numbers(mapped).select(
        *keys, *(["row_idx"] if more else []),
        *[F.col(f"`{f}`").isNull().alias(f"null_{i}") for i, f in enumerate(present)],
        *[F.coalesce(F.col(f"`{f}`") == "", F.lit(False)).alias(f"blank_{i}") for i, f in enumerate(present)],
        *[r.broken.alias(f"rule_{i}") for i, r in enumerate(rules)],
    )

    def total(name: str) -> Column:
        return F.sum(F.col(name).cast("bigint")).alias(name)

    return tested.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[total(f"null_{i}") for i in range(len(present))],
        *[total(f"blank_{i}") for i in range(len(present))],
        *[total(f"rule_{i}") for i in range(len(rules))],
        *more,
    )


def _listed_cells(mapped: DataFrame, rules: list[Rule], until: DataFrame | None = None) -> DataFrame:
    """Broken cells as (keys, row_idx, rule, value); with ``until`` (``listed_until``) only up to the row it names."""
    wanted = lambda i: F.lit(True)
    if until is not None:
        mapped = attach(mapped, until, KEYS, "left").where("_most is null or row_idx is null or row_idx <= _most")
        wanted = lambda i: F.col("_most").isNull() | F.col("row_idx").isNull() | (F.col("row_idx") <= F.get("_until", F.lit(i)))
    hits = F.filter(
        F.array(*[
            F.when(wanted(i) & r.broken, F.struct(F.lit(i).alias("rule"), F.col(f"`{r.field}`").alias("value")))
            for i, r in enumerate(rules)
        ]), lambda x: x.isNotNull())
    return with_numbers(mapped).select(*KEYS, "row_idx", F.explode(hits).alias("_h")).select(
        *KEYS, "row_idx", F.col("_h.rule").alias("rule"), F.col("_h.value").alias("value"))


def first_broken_rows(mapped: DataFrame, rules: list[Rule], n: int = LISTED_ROWS, banded: DataFrame | None = None) -> DataFrame:
    """Example and first ``n`` row positions per rule (at most ``n`` entries are collected).

    ``banded`` are stored ``banded_counts``: they name the rows that can be among the first, so that of a long sheet
    only its head is tested again and the rest of its broken cells is neither sorted nor ranked.
    """
    until = None if banded is None else settle(listed_until(banded, len(rules), n))
    first = first_rows(_listed_cells(mapped, rules, until), [*KEYS, "rule"], n)
    packed = first.groupBy(*KEYS, "rule").agg(F.array_sort(F.collect_list(F.struct("_rank", "row_idx"))).alias("_r"),
                                              F.max(F.when(F.col("_rank") == 1, F.col("value"))).alias("example"))
    return packed.select(*KEYS, "rule", F.col("_r.row_idx").alias("affected_rows"), "example")


def first_distinct_values(mapped: DataFrame, rules: list[Rule], n: int = NAMED_VALUES) -> DataFrame:
    """First ``n`` distinct stripped values that break each rule, in row order, as one text."""
    cells = _listed_cells(mapped, rules).withColumn("value", strip(F.col("value")))
    seen = cells.groupBy(*KEYS, "rule", "value").agg(F.min("row_idx").alias("first_row"))
    first = first_rows(seen, [*KEYS, "rule"], n, order="first_row")
    packed = first.groupBy(*KEYS, "rule").agg(F.array_sort(F.collect_list(F.struct("_rank", "value"))).alias("_v"))
    return packed.select(*KEYS, "rule", F.array_join(F.col("_v.value"), ", ").alias("named"))


def duplicate_references(mapped: DataFrame) -> DataFrame:
    """Reference values used more than once: (keys, value, n, first_row) (Q10).

    Counted with map-side combine, so a reference on a third of all rows is one counter.
    """
    return (
        mapped.where(F.col("Reference").isNotNull()).groupBy(*KEYS, F.col("Reference").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first_row")).where("n > 1")
    )


def duplicate_issue(mapped: DataFrame, duplicates: DataFrame, n: int = LISTED_ROWS) -> DataFrame:
    """Duplicate finding per sheet with example, first rows and first repeated values (Q10).

    A duplicate row among the first ``n`` must belong to one of the ``n`` values that start
    earliest, so only those values are looked up in the data; the result is exact.
    """
    totals = duplicates.groupBy(*KEYS).agg(F.sum("n").alias("affected_row_count"))
    early = settle(first_rows(duplicates, KEYS, n, order="first_row", rank="_start"))
    refs = early.select(*KEYS, F.col("value").alias("Reference"))
    rows = attach(mapped.select(*KEYS, "row_idx", "Reference"), refs, [*KEYS, "Reference"])
    listed = first_rows(rows, KEYS, n).groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.struct("_rank", "row_idx"))).alias("_r"))
    named = early.where(F.col("_start") <= NAMED_VALUES).groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.struct("_start", "value"))).alias("_v"))
    return totals.join(listed, KEYS).join(named, KEYS).select(
        *KEYS, "affected_row_count", F.col("_r.row_idx").alias("affected_rows"),
        F.col("_v.value")[0].alias("example"), F.array_join(F.col("_v.value"), ", ").alias("named"))


def completeness_issues(counts: DataFrame, present: list[str]) -> DataFrame:
    """Fields with more than 5, 20 or 50 percent missing values (Q1)."""
    items = F.array(*[
        F.struct(F.lit(TARGET_FIELDS.index(f)).alias("ord"), F.lit(f).alias("affected_field"),
                 (F.col(f"null_{i}") + F.col(f"blank_{i}")).alias("missing"))
        for i, f in enumerate(present)
    ])
    flat = counts.select(*KEYS, "n_rows", F.inline(items))
    pct = F.col("missing") / F.col("n_rows") * 100
    severity = F.when(pct > 50, "high").when(pct > 20, "medium").when(pct > 5, "low")
    return flat.withColumn("severity", severity).where("severity is not null").select(
        *KEYS, "ord", F.lit("completeness").alias("issue_type"), "severity", "affected_field",
        F.array().cast("array<bigint>").alias("affected_rows"), F.col("missing").alias("affected_row_count"),
        F.concat("affected_field", F.format_string(": %d/%d (", "missing", "n_rows"), fixed(pct, 1),
                 F.lit("%) values are null/empty.")).alias("evidence"),
        F.lit("<null>").alias("before_example"), F.lit("flag_for_review").alias("suggested_operation"),
        F.lit(1.0).alias("confidence"))


def detect_issues(mapped: DataFrame, current_year: int, mapping: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """All findings of every sheet, numbered in reporting order (Q1-Q13).

    ``mapping(keys, target)`` limits the findings to fields the sheet really maps; without
    it every field column of the table counts as mapped. ``counts`` are stored ``banded_counts``.
    """
    present = [f for f in TARGET_FIELDS if f in mapped.columns]
    rules = row_rules(current_year, present)
    order = _order(rules)
    banded = settle(banded_counts(mapped, rules)) if counts is None else counts
    counts = settle(summed_counts(banded))

    parts = [completeness_issues(counts, present)]
    if rules:
        parts.append(_rule_issues(mapped, counts, banded, rules, order))
    if "Reference" in present:
        duplicates = settle(duplicate_references(mapped))
        text = F.concat(F.format_string("Reference: %d rows have duplicate IDs: ", "affected_row_count"), "named", F.lit("."))
        parts.append(duplicate_issue(mapped, duplicates).select(
            *KEYS, F.lit(order["duplicate"]).alias("ord"), F.lit("duplicate").alias("issue_type"),
            F.lit("high").alias("severity"), F.lit("Reference").alias("affected_field"),
            F.col("affected_rows").cast("array<bigint>").alias("affected_rows"), "affected_row_count",
            text.alias("evidence"), F.col("example").alias("before_example"),
            F.lit("flag_for_review").alias("suggested_operation"), F.lit(1.0).alias("confidence")))
    issues = parts[0]
    for part in parts[1:]:
        issues = issues.unionByName(part)
    if mapping is not None:
        wanted = mapping.where("target is not null").select(*KEYS, F.col("target").alias("affected_field"))
        issues = issues.join(wanted, [*KEYS, "affected_field"], "left_semi")
    seq = F.row_number().over(Window.partitionBy(*KEYS).orderBy("ord"))
    return issues.withColumn("issue_id", F.format_string("QI-%04d", seq)).select(
        *KEYS, "issue_id", "ord", "issue_type", "severity", "affected_field", "affected_rows", "affected_row_count",
        "evidence", "before_example", "suggested_operation", "confidence")


def _rule_issues(mapped: DataFrame, counts: DataFrame, banded: DataFrame, rules: list[Rule], order: dict[str, int]) -> DataFrame:
    """Findings of the row rules, with examples, row lists and named values."""
    items = F.array(*[
        F.struct(F.lit(i).alias("rule"), F.lit(order[f"{r.name}/{r.field}"]).alias("ord"),
                 F.lit(r.issue_type).alias("issue_type"), F.lit(r.severity).alias("severity"),
                 F.lit(r.field).alias("affected_field"), F.col(f"rule_{i}").alias("affected_row_count"),
                 F.lit(r.evidence).alias("evidence"), F.lit(r.operation).alias("suggested_operation"),
                 F.lit(r.confidence).alias("confidence"), F.lit(r.lists_rows).alias("_lists"))
        for i, r in enumerate(rules)
    ])
    found = counts.select(*KEYS, F.inline(items)).where("affected_row_count > 0")
    broken = found.join(first_broken_rows(mapped, rules, banded=banded), [*KEYS, "rule"], "left")
    named = [i for i, r in enumerate(rules) if "{values}" in r.evidence]
    if named:
        values = first_distinct_values(mapped, [rules[i] for i in named])
        place = F.get(F.array(*[F.lit(i) for i in named]), F.col("rule"))
        broken = broken.join(values.withColumn("rule", place), [*KEYS, "rule"], "left")
    else:
        broken = broken.withColumn("named", F.lit(None).cast("string"))
    evidence = F.replace(
        F.replace("evidence", F.lit("{n}"), F.col("affected_row_count").cast("string")),
        F.lit("{values}"), F.coalesce("named", F.lit("")))
    none = F.array().cast("array<bigint>")
    return broken.select(
        *KEYS, "ord", "issue_type", "severity", "affected_field",
        F.when(F.col("_lists"), F.col("affected_rows").cast("array<bigint>")).otherwise(none).alias("affected_rows"),
        "affected_row_count", evidence.alias("evidence"), F.col("example").alias("before_example"),
        "suggested_operation", "confidence")


# --- completeness, score, grade ---------------------------------------------------------

def completeness(mapped: DataFrame, digits: int | None = 2, sheets: DataFrame | None = None) -> DataFrame:
    """Share of non-null cells per sheet and target, 0 for absent fields (Q14); 17 rows per sheet.

    ``sheets`` adds those without any record; all their fields are 0.
    """
    present = [f for f in TARGET_FIELDS if f in mapped.columns]
    sums = mapped.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count(F.col(f"`{f}`")).alias(f"_c{i}") for i, f in enumerate(present)])

    def pct(f: str) -> Column:
        if f not in present:
            return F.lit(0.0)
        share = F.coalesce(F.col(f"_c{present.index(f)}") / F.col("_n") * 100, F.lit(0.0))
        return rounded(share, digits)

    if sheets is not None:
        sums = sheets.select(*KEYS).distinct().join(sums, KEYS, "left")
    items = F.array(*[
        F.struct(F.lit(i).alias("field_pos"), F.lit(f).alias("field"), pct(f).alias("completeness"))
        for i, f in enumerate(TARGET_FIELDS)])
    return sums.select(*KEYS, F.inline(items))


def counted_completeness(counts: DataFrame, sheets: DataFrame, digits: int | None = 2) -> DataFrame:
    """The same from ``rule_counts`` of all fields: no pass of its own. Sheets without records are 0 throughout."""
    joined = sheets.select(*KEYS).distinct().join(counts, KEYS, "left")
    share = lambda i: (F.col("n_rows") - F.col(f"null_{i}")) / F.nullif("n_rows", F.lit(0)) * 100
    items = F.array(*[
        F.struct(F.lit(i).alias("field_pos"), F.lit(f).alias("field"), rounded(F.coalesce(share(i), F.lit(0.0)), digits).alias("completeness"))
        for i, f in enumerate(TARGET_FIELDS)])
    return joined.select(*KEYS, F.inline(items))


def completeness_status(complete: DataFrame, mapping: DataFrame) -> DataFrame:
    """Completeness of all 17 fields with their mapping status (Q19)."""
    mapped = mapping.where("target is not null").select(*KEYS, F.col("target").alias("field")).distinct()
    joined = complete.join(mapped.withColumn("_m", F.lit(True)), [*KEYS, "field"], "left")
    return joined.select(
        *KEYS, "field", (F.col("completeness") / 100).alias("completeness"),
        F.when(F.col("_m"), "Mapped").otherwise("No source column").alias("status"))


SEVERITY_WEIGHT = {"high": 0.20, "medium": 0.08, "low": 0.02}


def quality_score(sheets: DataFrame, mapping: DataFrame | None = None, complete: DataFrame | None = None,
                  issues: DataFrame | None = None, digits: int | None = 1) -> DataFrame:
    """Score 0..100 and grade per sheet (Q15, Q16).

    Parts that were not computed count as in the definition: no mapping 0, no completeness 0.5,
    no report 1.0. A sheet that is missing from a computed part has nothing there.
    """
    out = sheets.select(*KEYS).distinct()
    if mapping is None:
        out = out.withColumn("mapping_score", F.lit(0.0))
    else:
        mapped = F.col("target").isNotNull()
        part = mapping.groupBy(*KEYS).agg(
            (F.count("target") / len(TARGET_FIELDS)
             * F.coalesce(F.avg(F.when(mapped, F.col("confidence"))), F.lit(0.0))).alias("mapping_score"))
        out = out.join(part, KEYS, "left").fillna(0.0, ["mapping_score"])
    if complete is None:
        out = out.withColumn("completeness_score", F.lit(0.5))
    else:
        part = complete.groupBy(*KEYS).agg((F.avg("completeness") / 100).alias("completeness_score"))
        out = out.join(part, KEYS, "left").fillna(0.0, ["completeness_score"])
    if issues is None:
        out = out.withColumn("anomaly_score", F.lit(1.0))
    else:
        counts = {s: F.count(F.when(F.col("severity") == s, 1)) for s in SEVERITY_WEIGHT}
        penalty = sum((counts[s] * w for s, w in SEVERITY_WEIGHT.items()), F.lit(0.0))
        part = issues.groupBy(*KEYS).agg(F.greatest(F.lit(0.0), 1 - penalty).alias("anomaly_score"))
        out = out.join(part, KEYS, "left").fillna(1.0, ["anomaly_score"])
    score = (F.col("mapping_score") * 0.35 + F.col("completeness_score") * 0.30 + F.col("anomaly_score") * 0.35) * 100
    out = out.withColumn("score", rounded(score, digits))
    return out.withColumn("grade", grade(F.col("score"))).withColumn("label", grade_label(F.col("score")))


def grade(score: Column) -> Column:
    return F.when(score >= 80, "A").when(score >= 65, "B").when(score >= 50, "C").when(score >= 35, "D").otherwise("F")


def grade_label(score: Column) -> Column:
    return (
        F.when(score >= 80, "Excellent").when(score >= 65, "Good").when(score >= 50, "Fair")
        .when(score >= 35, "Poor").otherwise("Critical")
    )


def report_summary(issues: DataFrame, counts: DataFrame) -> DataFrame:
    """Issues, touched fields, critical findings and rows per sheet (Q17). ``counts(keys, n_rows)``."""
    sums = issues.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_issues"), F.count_distinct("affected_field").alias("n_fields"),
        F.count(F.when(F.col("severity") == "high", 1)).alias("n_critical"))
    return counts.select(*KEYS, F.col("n_rows").alias("total_rows")).join(sums, KEYS, "left").fillna(
        0, ["n_issues", "n_fields", "n_critical"]).withColumn(
        "issue_summary", F.format_string("%d issues detected across %d fields.", "n_issues", "n_fields"))
