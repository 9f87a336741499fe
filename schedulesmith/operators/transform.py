"""Controlled transformation: approved renames, operations, merges and their audit.

One plan row per sheet says where every target comes from and which operations were approved
for it. The plan row is looked up for each data row, so data rows are never shuffled to be
mapped or cleaned. The cleaned table is lossless: every field is text, exactly as produced
by the operations; ``validate.typed_table`` casts it afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ops import NUMERIC, PREPARED, WHITELIST, apply_operation
from ..functions.text import number
from ..schema import KEYS, TARGET_FIELDS
from ..session import attach, settle

REJECTED = "__rejected__"
AUDIT_COLUMNS = ["entry_id", "source_column", "target_column", "transformation_applied", "before_value",
                 "after_value", "confidence", "approved_by", "timestamp", "recommendation_id", "row_index"]


# --- which column feeds which target ----------------------------------------------------

def claim_targets(recs: DataFrame, columns: DataFrame) -> DataFrame:
    """Approved renames with one claim per (sheet, target), strongest first.

    ``recs`` are recommendation rows; ``columns(keys, col_idx, source_column)``. A source
    column is renamed once, by its strongest approved mapping.
    """
    approved = recs.where("action_type = 'column_mapping' and status = 'approved'").select(
        *KEYS, "rec_id", "source_column", F.col("target_column").alias("target"), "confidence")
    known = approved.join(columns, [*KEYS, "source_column"])
    by_source = Window.partitionBy(*KEYS, "source_column").orderBy(F.desc("confidence"), "rec_id")
    by_target = Window.partitionBy(*KEYS, "target").orderBy(F.desc("confidence"), "col_idx", "rec_id")
    return (
        known.withColumn("_r", F.row_number().over(by_source)).where("_r = 1")
        .withColumn("_r", F.row_number().over(by_target)).where("_r = 1").drop("_r")
    )


def positions_from_mapping(mapping: DataFrame) -> DataFrame:
    """Per sheet the source position of every target, from a mapping table (Q18).

    A sheet none of whose columns is mapped has no position, but is there: its records count.
    """
    order = Window.partitionBy(*KEYS, "target").orderBy(F.desc("confidence"), "col_idx")
    best = mapping.where("target is not null").withColumn("_r", F.row_number().over(order)).where("_r = 1")
    return every_sheet(mapping, _positions(best))


def every_sheet(sheets: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with a row for every sheet; the targets of sheets it lacks come from nowhere."""
    nowhere = F.array(*[F.lit(None).cast("int") for _ in TARGET_FIELDS])
    return sheets.select(*KEYS).distinct().join(plan.hint("merge"), KEYS, "left").withColumn("positions", F.coalesce("positions", nowhere))


def _positions(claims: DataFrame) -> DataFrame:
    m = claims.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("target", "col_idx"))).alias("_m"))
    return m.select(*KEYS, F.array(*[F.try_element_at("_m", F.lit(t)) for t in TARGET_FIELDS]).alias("positions"))


def mapped_table(records: DataFrame, positions: DataFrame, index: str = "row_idx") -> DataFrame:
    """Records as one text column per target.

    Only positions named by the plan are read, so a source column that merely carries a
    target's name never reaches the output.
    """
    joined = attach(records, positions, KEYS)
    return joined.select(
        *KEYS, F.col(index).alias("row_idx"),
        *[F.get("values", F.get("positions", F.lit(i))).alias(t) for i, t in enumerate(TARGET_FIELDS)])


def rename_claimed(records: DataFrame, claims: DataFrame, columns: DataFrame) -> DataFrame:
    """Long form of the renames: every cell under its target or its ``_unmapped_`` name."""
    stray = F.when(F.col("source_column").isin(TARGET_FIELDS), F.concat(F.lit("_unmapped_"), "source_column")).otherwise(
        F.col("source_column"))
    names = columns.join(claims.select(*KEYS, "col_idx", "target"), [*KEYS, "col_idx"], "left").select(
        *KEYS, "col_idx", F.coalesce("target", stray).alias("column_name"))
    cells = records.select(*KEYS, "row_idx", F.posexplode("values").alias("col_idx", "value"))
    return attach(cells, names, [*KEYS, "col_idx"]).select(*KEYS, "row_idx", "column_name", "value")


def resolve_duplicates(candidates: DataFrame) -> DataFrame:
    """Of several columns with the same target name keep the fullest, first on ties.

    ``candidates(keys, target, col_idx, n_nonnull)``.
    """
    pick = F.max_by("col_idx", F.struct("n_nonnull", -F.col("col_idx")))
    return candidates.groupBy(*KEYS, "target").agg(pick.alias("col_idx"))


def coalesce_sources(table: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Combine wide source columns per target in priority order, first non-null wins."""
    used = {s for sources in groups.values() for s in sources}
    kept = [F.col(f"`{c}`") for c in table.columns if c not in used]
    merged = [F.coalesce(*[F.col(f"`{s}`") for s in sources]).alias(t) for t, sources in groups.items()]
    return table.select(*kept, *merged)


# --- unclaimed columns ------------------------------------------------------------------

def scope_decisions(decisions: DataFrame, sheets: DataFrame) -> DataFrame:
    """Unclaimed-column decisions brought to the sheets they are meant for.

    Sheet names match without case and outer blanks; a decision without a sheet name goes
    to every sheet of its file.
    """
    d, s = decisions.alias("d"), sheets.select(*KEYS).distinct()
    key = F.lower(F.trim("sheet_name"))
    named = decisions.where("sheet_name is not null").withColumn("_k", key).drop("sheet_name").join(
        s.withColumn("_k", key), ["file_id", "_k"]).drop("_k")
    everywhere = decisions.where("sheet_name is null").drop("sheet_name").join(s, "file_id")
    fields = [*KEYS, "source_column", "decision", "seq"]
    return named.select(*fields).unionByName(everywhere.select(*fields))


def unclaimed_plan(decisions: DataFrame, columns: DataFrame, claims: DataFrame,
                   rejected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assigned and rejected unclaimed columns.

    Only columns still present count: neither renamed to a target nor dropped before.
    """
    taken = claims.select(*KEYS, "col_idx").unionByName(rejected.select(*KEYS, "col_idx"))
    present = columns.join(taken, [*KEYS, "col_idx"], "left_anti")
    known = decisions.where("decision is not null and decision <> ''").join(present, [*KEYS, "source_column"])
    dropped = known.where(F.col("decision") == REJECTED)
    assigned = known.where(F.col("decision").isin(TARGET_FIELDS)).withColumnRenamed("decision", "target")
    return assigned.select(*KEYS, "col_idx", "source_column", "target", "seq"), dropped.select(
        *KEYS, "col_idx", "source_column", "seq")


def rejected_columns(recs: DataFrame, columns: DataFrame, claims: DataFrame) -> DataFrame:
    """Columns whose mapping was rejected and that no other approval renamed."""
    return (
        recs.where("action_type = 'column_mapping' and status = 'rejected'").select(*KEYS, "source_column").distinct()
        .join(columns, [*KEYS, "source_column"])
        .join(claims.select(*KEYS, "col_idx"), [*KEYS, "col_idx"], "left_anti")
    )


def space_merge(parts: list[Column]) -> Column:
    """Values joined by one blank, skipping nulls; null when all are null."""
    some = F.filter(F.array(*parts), lambda v: v.isNotNull())
    return F.when(F.size(some) > 0, F.array_join(some, " "))


# --- the cleaning plan ------------------------------------------------------------------

def operation_steps(recs: DataFrame) -> DataFrame:
    """Approved whitelisted operations per (sheet, target), numbered in recommendation order (T4)."""
    wanted = recs.where(
        "action_type in ('standardisation', 'data_correction') and status = 'approved'"
    ).where(F.col("operation").isin(sorted(WHITELIST - {"flag_for_review"})) & F.col("target_column").isin(TARGET_FIELDS))
    order = Window.partitionBy(*KEYS, "target_column").orderBy("rec_order")
    return wanted.select(
        *KEYS, F.col("target_column").alias("target"), (F.row_number().over(order) - 1).alias("step"), "operation",
        "rec_id", "source_column", "confidence")


def refused_operations(recs: DataFrame) -> DataFrame:
    """Approved data changes that name an operation outside the whitelist."""
    return recs.where(
        "action_type in ('standardisation', 'data_correction') and status = 'approved'"
    ).where(~F.col("operation").isin(sorted(WHITELIST)))


def cleaning_plan(claims: DataFrame, steps: DataFrame, assigned: DataFrame | None = None) -> DataFrame:
    """One row per sheet: target positions, operation names per target, columns merged into targets."""
    positions = _positions(claims)
    ops = steps.groupBy(*KEYS, "target").agg(
        F.array_sort(F.collect_list(F.struct("step", "operation"))).getField("operation").alias("_o"))
    ops = ops.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("target", "_o"))).alias("_ops"))
    plan = positions.join(ops, KEYS, "full_outer")
    if assigned is None:
        plan = plan.withColumn("_extra", F.lit(None).cast("map<string,array<int>>"))
    else:
        extra = assigned.groupBy(*KEYS, "target").agg(
            F.array_sort(F.collect_list(F.struct("seq", "col_idx"))).getField("col_idx").alias("_e"))
        extra = extra.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("target", "_e"))).alias("_extra"))
        plan = plan.join(extra, KEYS, "full_outer")
    nowhere = F.array(*[F.lit(None).cast("int") for _ in TARGET_FIELDS])
    return plan.select(
        *KEYS, F.coalesce("positions", nowhere).alias("positions"),
        F.array(*[F.try_element_at("_ops", F.lit(t)) for t in TARGET_FIELDS]).alias("ops"),
        F.array(*[F.try_element_at("_extra", F.lit(t)) for t in TARGET_FIELDS]).alias("extra"),
    )


def step_choices(steps: DataFrame) -> dict[tuple[str, int], list[str]]:
    """Distinct operations used per (target, step). Bounded by the schema, not by the data."""
    found = steps.select("target", "step", "operation").distinct().orderBy("target", "step", "operation").collect()
    out: dict[tuple[str, int], list[str]] = {}
    for r in found:
        out.setdefault((r["target"], r["step"]), []).append(r["operation"])
    return out


def changed(before: Column, after: Column, was_number: Column, is_number: Column) -> Column:
    """Null-safe difference; a number that stays the same number is no change in any spelling (T5).

    Text that becomes a number, or a number that becomes text, has changed.
    """
    both = was_number & is_number
    same_number = both & F.coalesce(number(before) == number(after), F.lit(False))
    same = (before.isNull() & after.isNull()) | same_number | (before.eqNullSafe(after) & (was_number == is_number))
    return ~same


def _staged(records: DataFrame, plan: DataFrame, choices: dict[tuple[str, int], list[str]]) -> tuple[DataFrame, dict]:
    """Records with every intermediate value as a column ``v{target}_{step}``, and whether it is a number as ``k...``."""
    out = attach(records, plan, KEYS)
    place = {i: F.get("positions", F.lit(i)) for i in range(len(TARGET_FIELDS))}
    out = out.select("*", *[F.get("values", place[i]).alias(f"v{i}_0") for i in place],
                     *[F.coalesce(F.get("types", place[i]) == "n", F.lit(False)).alias(f"k{i}_0") for i in place])
    last = {i: 0 for i in place}
    depth = max((s for _, s in choices), default=-1) + 1
    for step in range(depth):
        spots = [(i, choices[t, step]) for i, t in enumerate(TARGET_FIELDS) if choices.get((t, step))]
        prepared = {(i, name): PREPARED[name](F.col(f"v{i}_{last[i]}")) for i, names in spots for name in names if name in PREPARED}
        out = out.select("*", *[c.alias(f"p{i}_{name}") for (i, name), c in prepared.items()])
        added = []
        for i, names in spots:
            before, number_before = F.col(f"v{i}_{last[i]}"), F.col(f"k{i}_{last[i]}")
            wanted = F.get(F.get("ops", F.lit(i)), F.lit(step))
            after, is_number = before, number_before
            for name in names:
                parsed = F.col(f"p{i}_{name}") if (i, name) in prepared else None
                after = F.when(wanted == name, apply_operation(name, before, parsed)).otherwise(after)
                turns = F.lit(name in NUMERIC) if name != "to_int" else number_before | (parsed == F.floor(parsed))
                if name == "normalize_date":  # what is no date stays what it was
                    turns = number_before & apply_operation(name, before, parsed).eqNullSafe(before)
                is_number = F.when(wanted == name, F.coalesce(turns, F.lit(False))).otherwise(is_number)
            added += [after.alias(f"v{i}_{step + 1}"), is_number.alias(f"k{i}_{step + 1}")]
        out = out.select("*", *added).drop(*[f"p{i}_{name}" for i, name in prepared])
        for i, _ in spots:
            last[i] = step + 1
    return out, last


def clean_records(records: DataFrame, plan: DataFrame, choices: dict[tuple[str, int], list[str]]) -> DataFrame:
    """Apply the plan: 17 text columns per record, in output order."""
    staged, last = _staged(records, plan, choices)

    def final(i: int) -> Column:
        extra = F.get("extra", F.lit(i))
        value = F.col(f"v{i}_{last[i]}")
        merged = F.filter(
            F.concat(F.array(value), F.transform(extra, lambda p: F.get("values", p))), lambda v: v.isNotNull())
        return F.when(extra.isNull(), value).when(F.size(merged) > 0, F.array_join(merged, " "))

    return staged.select(*KEYS, "row_idx", *[final(i).alias(t) for i, t in enumerate(TARGET_FIELDS)])


# --- audit ------------------------------------------------------------------------------

def change_counts(records: DataFrame, plan: DataFrame, steps: DataFrame,
                  choices: dict[tuple[str, int], list[str]]) -> DataFrame:
    """Changed rows and the first changed value per approved operation (T5).

    One aggregate adds up the changes and the lowest changed row. Only those rows, one per
    operation at most, are read again for their values, so no text is carried through the
    aggregate and the operations run once over the data.
    """
    staged, _ = _staged(records, plan, choices)
    spots = sorted(((TARGET_FIELDS.index(t), s) for t, s in choices))
    previous: dict[tuple[int, int], int] = {}
    seen: dict[int, int] = {}
    for i, s in sorted(spots, key=lambda x: x[1]):
        previous[(i, s)] = seen.get(i, 0)
        seen[i] = s + 1
    if not spots:
        return steps.withColumn("n_changed", F.lit(0).cast("bigint")).withColumn(
            "before_sample", F.lit("")).withColumn("after_sample", F.lit(""))

    def pair(kind: str, i: int, s: int) -> tuple[Column, Column]:
        return F.col(f"{kind}{i}_{previous[(i, s)]}"), F.col(f"{kind}{i}_{s + 1}")

    flags = staged.select(*KEYS, "row_idx", *[changed(*pair("v", i, s), *pair("k", i, s)).alias(f"c{i}_{s}") for i, s in spots])
    sums = flags.groupBy(*KEYS).agg(
        F.min("row_idx").alias("_first"),
        *[F.sum(F.col(f"c{i}_{s}").cast("bigint")).alias(f"n{i}_{s}") for i, s in spots],
        *[F.min(F.when(F.col(f"c{i}_{s}"), F.col("row_idx"))).alias(f"r{i}_{s}") for i, s in spots])
    items = F.array(*[
        F.struct(F.lit(TARGET_FIELDS[i]).alias("target"), F.lit(s).alias("step"), F.col(f"n{i}_{s}").alias("n_changed"),
                 F.coalesce(F.col(f"r{i}_{s}"), F.col("_first")).alias("row_idx"))
        for i, s in spots])
    totals = sums.select(*KEYS, F.inline(items))
    counted = settle(steps.join(totals, [*KEYS, "target", "step"]))
    picked, _ = _staged(attach(records, counted.select(*KEYS, "row_idx").distinct(), [*KEYS, "row_idx"]), plan, choices)
    pairs = F.array(*[
        F.struct(F.lit(TARGET_FIELDS[i]).alias("target"), F.lit(s).alias("step"),
                 pair("v", i, s)[0].alias("before_sample"), pair("v", i, s)[1].alias("after_sample")) for i, s in spots])
    samples = picked.select(*KEYS, "row_idx", F.inline(pairs))
    return counted.join(samples, [*KEYS, "row_idx", "target", "step"], "left")


def _entry(df: DataFrame, source: Column, target: Column, what: str | Column, before: Column, after: Column,
           conf: Column, rec_id: Column, order: Column, stamp: str) -> DataFrame:
    what = F.lit(what) if isinstance(what, str) else what
    row = df.select(
        *KEYS, order.alias("entry_order"), source.alias("source_column"), target.alias("target_column"),
        what.alias("transformation_applied"), before.alias("before_value"), after.alias("after_value"),
        conf.cast("double").alias("confidence"), F.lit("human").alias("approved_by"), F.lit(stamp).alias("timestamp"),
        rec_id.alias("recommendation_id"), F.lit(None).cast("int").alias("row_index"))
    digest = F.sha2(F.concat_ws("|", *KEYS, "transformation_applied", "source_column", "target_column",
                                "recommendation_id", "before_value"), 256)
    return row.withColumn("entry_id", F.concat(F.lit("AUD-"), F.upper(F.substring(digest, 1, 16)))).select(
        *KEYS, "entry_order", *AUDIT_COLUMNS)


def audit_trail(claims: DataFrame, rejected: DataFrame, changes: DataFrame, assigned: DataFrame, dropped: DataFrame,
                stamp: str) -> DataFrame:
    """One entry per rename, dropped column, operation and manual assignment."""
    none, one = F.lit(None).cast("string"), F.lit(1.0)

    def column(c: str) -> Column:
        return F.concat(F.lit("Column '"), F.col(c), F.lit("'"))

    parts = [
        _entry(claims.where("source_column <> target"), F.col("source_column"), F.col("target"), "column_rename",
               column("source_column"), column("target"), F.col("confidence"), F.col("rec_id"), F.lit(1), stamp),
        _entry(rejected, F.col("source_column"), F.lit(""), "column_rejected_dropped", column("source_column"),
               F.lit("Dropped (rejected by reviewer)"), one, none, F.lit(2), stamp),
        _entry(changes, F.col("source_column"), F.col("target"), F.col("operation"),
               F.concat(F.coalesce("before_sample", F.lit("<NA>")), F.lit(" (sample; "),
                        F.col("n_changed").cast("string"), F.lit(" rows changed)")),
               F.coalesce("after_sample", F.lit("<NA>")), F.col("confidence"), F.col("rec_id"), F.lit(3), stamp),
        _entry(dropped, F.col("source_column"), F.lit(""), "unclaimed_reject", column("source_column"),
               F.lit("Dropped (rejected by reviewer)"), one, none, F.lit(4), stamp),
    ]
    merged = assigned.groupBy(*KEYS, "target").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("seq", "source_column"))).getField("source_column"), ", ")
        .alias("sources"))
    parts.append(_entry(
        merged, F.col("sources"), F.col("target"), "unclaimed_manual_assign",
        F.concat(F.lit("Unmapped column(s): "), "sources"),
        F.concat(F.lit("Merged into '"), "target", F.lit("' (space-separated)")), one, none, F.lit(5), stamp))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def apply_approved(records: DataFrame, columns: DataFrame, recs: DataFrame, decisions: DataFrame | None = None,
                   stamp: str = "") -> tuple[DataFrame, Callable[[], DataFrame]]:
    """Cleaned lossless table of everything the reviewers approved, and its audit trail.

    ``recs`` carry their status; ``decisions`` are scoped unclaimed-column decisions. The
    audit trail needs its own pass over the data, so it is a function called when wanted.
    """
    claims = settle(claim_targets(recs, columns))
    rejected = settle(rejected_columns(recs, columns, claims))
    steps = operation_steps(recs).join(claims.select(*KEYS, "target"), [*KEYS, "target"], "left_semi")
    steps = settle(steps)
    if decisions is None:
        empty = columns.sparkSession.createDataFrame(
            [], "file_id string, sheet_name string, source_column string, decision string, seq int")
        decisions = empty
    assigned, dropped = unclaimed_plan(decisions, columns, claims, rejected)
    assigned, dropped = settle(assigned), settle(dropped)
    choices = step_choices(steps)
    # Sheets without any approved mapping still produce their (empty) 17 columns.
    plan = settle(every_sheet(columns, cleaning_plan(claims, steps, assigned)))
    cleaned = clean_records(records, plan, choices)

    def audit() -> DataFrame:
        changes = change_counts(records, plan, steps, choices)
        return audit_trail(claims, rejected, changes, assigned, dropped, stamp)

    return cleaned, audit


def preview(records: DataFrame, columns: DataFrame, recs: DataFrame, n: int = 15) -> DataFrame:
    """Approved changes on the first ``n`` records of every sheet, nothing written.

    Like the export, sheets with nothing approved included, except that manual decisions on
    unclaimed columns are not applied.
    """
    from ..session import first_rows

    head = first_rows(records, KEYS, n).drop("_rank")
    claims = claim_targets(recs, columns)
    steps = settle(operation_steps(recs))
    plan = settle(every_sheet(columns, cleaning_plan(claims, steps)))
    return clean_records(head, plan, step_choices(steps))
