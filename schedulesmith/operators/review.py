"""Recommendations and human review as tables and joins.

Recommendation rows: (keys, rec_id, rec_order, action_type, source_column, target_column,
operation, before_example, after_example, rationale, confidence, uncertainty, affected_rows,
affected_row_indices, status, rejection_note, re_reason_count, feedback_processed,
issue_type, review_required, decided_until). They number a few dozen per sheet at most.
``decided_until`` is the time of the newest decision an item has seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ops import WHITELIST, apply_named
from ..functions.text import fixed
from ..schema import KEYS, TARGET_FIELDS
from .mapping import HIGH_CONFIDENCE

MAX_REREASON = 2
REC_COLUMNS = [
    *KEYS, "rec_id", "rec_order", "action_type", "source_column", "target_column", "operation", "before_example",
    "after_example", "rationale", "confidence", "uncertainty", "affected_rows", "affected_row_indices", "status",
    "rejection_note", "re_reason_count", "feedback_processed", "issue_type", "review_required", "decided_until",
]
# Fixed value: the remark on an item whose target a reviewer chose.
EDITED = "User manually assigned target (saved as human feedback)."


def _rec_id(prefix: str, *parts: Column | str) -> Column:
    digest = F.sha2(F.concat_ws("|", *KEYS, *parts), 256)
    return F.concat(F.lit(prefix), F.upper(F.substring(digest, 1, 16)))


def _pending(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("status", F.lit("pending")).withColumn("rejection_note", F.lit(""))
        .withColumn("re_reason_count", F.lit(0)).withColumn("feedback_processed", F.lit(False))
        .withColumn("decided_until", F.lit(None).cast("timestamp")).select(*REC_COLUMNS)
    )


def issue_recommendations(issues: DataFrame) -> DataFrame:
    """One recommendation per finding (H1)."""
    op = F.col("suggested_operation")
    action = (
        F.when(F.col("issue_type").isin("format", "type_error"), "standardisation")
        .when((F.col("issue_type") == "logical_error") & (op != "flag_for_review"), "data_correction")
        .otherwise("flag_for_review")
    )
    fixes = (op != "flag_for_review") & F.col("before_example").isNotNull() & (F.col("before_example") != "")
    after = F.when(fixes, F.coalesce(apply_named(op, F.col("before_example")), F.lit("<NA>"))).otherwise(
        "[flagged — no transformation applied]")
    return _pending(issues.select(
        *KEYS, _rec_id("REC-", "issue_type", "affected_field", "suggested_operation").alias("rec_id"),
        (F.col("ord") + 10_000).alias("rec_order"), action.alias("action_type"),
        F.col("affected_field").alias("source_column"), F.col("affected_field").alias("target_column"),
        op.alias("operation"), "before_example", after.alias("after_example"), F.col("evidence").alias("rationale"),
        "confidence", F.lit("").alias("uncertainty"), F.col("affected_row_count").alias("affected_rows"),
        F.col("affected_rows").alias("affected_row_indices"), "issue_type",
        ((F.col("confidence") < HIGH_CONFIDENCE) | F.col("severity").isin("high", "medium")).alias("review_required")))


def mapping_recommendations(mapping: DataFrame) -> DataFrame:
    """One recommendation per mapped column (H2)."""
    conf = F.col("confidence")
    why = F.concat(
        F.lit("Map '"), "source_column", F.lit("' → '"), "target", F.lit("' (method="), "method",
        F.lit(", confidence="), fixed(conf, 2), F.lit("). "),
        F.array_join(F.slice("evidence", 1, 2), "; "))
    return _pending(mapping.where("target is not null").select(
        *KEYS, _rec_id("MAP-", "source_column").alias("rec_id"), F.col("col_idx").cast("int").alias("rec_order"),
        F.lit("column_mapping").alias("action_type"), "source_column", F.col("target").alias("target_column"),
        F.lit("trim_whitespace").alias("operation"),
        F.concat(F.lit("Column: '"), "source_column", F.lit("'")).alias("before_example"),
        F.concat(F.lit("Renamed to: '"), "target", F.lit("'")).alias("after_example"), why.alias("rationale"),
        "confidence",
        F.when(conf >= HIGH_CONFIDENCE, "").otherwise(
            F.concat(F.lit("Confidence "), fixed(conf * 100, 0), F.lit("% — review recommended."))).alias("uncertainty"),
        F.lit(0).cast("bigint").alias("affected_rows"), F.array().cast("array<bigint>").alias("affected_row_indices"),
        F.lit("").alias("issue_type"), (F.col("review_required") | (conf < HIGH_CONFIDENCE)).alias("review_required")))


def all_recommendations(mapping: DataFrame, issues: DataFrame) -> DataFrame:
    """Recommendations of all sheets, tagged by sheet through their keys."""
    return mapping_recommendations(mapping).unionByName(issue_recommendations(issues))


# --- decisions --------------------------------------------------------------------------

def carry_over(new: DataFrame, previous: DataFrame) -> DataFrame:
    """Keep identity and decisions of recommendations that are proposed again (H3).

    Mappings match on their source column, everything else on source, target, operation and
    issue type; several with the same key are matched in order.
    """
    is_map = F.col("action_type") == "column_mapping"
    key = F.when(is_map, F.concat_ws("|", "action_type", "source_column")).otherwise(
        F.concat_ws("|", "action_type", "source_column", "target_column", "operation", "issue_type"))
    nth = F.row_number().over(Window.partitionBy(*KEYS, "_key").orderBy("rec_order", "rec_id"))
    on = [*KEYS, "_key", "_nth"]
    fresh = new.withColumn("_key", key).withColumn("_nth", nth)
    old = previous.withColumn("_key", key).withColumn("_nth", nth)
    kept = ["rec_id", "status", "rejection_note", "re_reason_count", "feedback_processed", "target_column",
            "confidence", "uncertainty", "decided_until"]
    side = old.select(*on, *[F.col(c).alias(f"_old_{c}") for c in kept])
    joined = fresh.join(side, on, "left")
    found = F.col("_old_rec_id").isNotNull()
    decided_map = found & is_map & (F.col("_old_status") != "pending")
    noted = found & F.col("_old_feedback_processed")

    def take(c: str, cond: Column) -> Column:
        return F.when(cond, F.col(f"_old_{c}")).otherwise(F.col(c)).alias(c)

    always = {"rec_id", "status", "rejection_note", "re_reason_count", "feedback_processed", "decided_until"}
    cols = []
    for c in REC_COLUMNS:
        if c in always:
            cols.append(take(c, found))
        elif c in ("target_column", "confidence"):
            cols.append(take(c, decided_map))
        elif c == "uncertainty":
            cols.append(take(c, decided_map | noted))
        else:
            cols.append(F.col(c))
    leftovers = old.join(fresh.select(*on), on, "left_anti").where(
        (F.col("status") == "escalated")
        | (is_map & (F.col("status") != "pending") & F.col("feedback_processed")))
    return joined.select(*cols).unionByName(leftovers.select(*REC_COLUMNS))


def latest_decisions(decisions: DataFrame, key: list[str]) -> DataFrame:
    """Newest decision per key (H4). Only per-task maxima are shuffled."""
    rest = [c for c in decisions.columns if c not in key and c != "ts"]
    newest = decisions.groupBy(*key).agg(F.max(F.struct("ts", *rest)).alias("_d"))
    return newest.select(*key, *[F.col(f"_d.{c}").alias(c) for c in ["ts", *rest]])


def apply_decisions(recs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply the newest decision per recommendation (H4).

    ``decisions(keys, rec_id, decision, note, new_target, ts)`` with decision approve, revert,
    reject or edit. Every rejection counts towards the re-reasoning limit. Decisions up to
    ``decided_until`` of an item are left out, so the whole history can be given every time.
    """
    on = [*KEYS, "rec_id"]
    new = decisions.withColumn("ts", F.col("ts").cast("timestamp")).join(recs.select(*on, "decided_until"), on).where(
        F.col("decided_until").isNull() | (F.col("ts") > F.col("decided_until")))
    counts = new.groupBy(*on).agg(
        F.max(F.struct("ts", "decision", "note", "new_target")).alias("_d"),
        F.count(F.when(F.col("decision") == "reject", 1)).cast("int").alias("_rejections"))
    joined = recs.join(counts, on, "left")
    what = F.col("_d.decision")
    edit = (what == "edit") & F.col("_d.new_target").isin(TARGET_FIELDS)
    return joined.withColumns({
        "status": F.when((what == "approve") | edit, "approved").when(what == "reject", "rejected")
        .when(what == "revert", "pending").otherwise(F.col("status")),
        "rejection_note": F.when(what == "reject", F.coalesce(F.col("_d.note"), F.lit(""))).otherwise(F.col("rejection_note")),
        "re_reason_count": F.col("re_reason_count") + F.coalesce("_rejections", F.lit(0)),
        "target_column": F.when(edit, F.col("_d.new_target")).otherwise(F.col("target_column")),
        "confidence": F.when(edit, 1.0).otherwise(F.col("confidence")),
        "uncertainty": F.when(edit, EDITED).otherwise(F.col("uncertainty")),
        "decided_until": F.coalesce(F.col("_d.ts"), F.col("decided_until")),
    }).select(*REC_COLUMNS)


def edited_mapping(mapping: DataFrame, recs: DataFrame) -> DataFrame:
    """The mapping with the targets that reviewers chose (H4)."""
    edits = recs.where((F.col("action_type") == "column_mapping") & (F.col("status") == "approved") & (F.col("uncertainty") == EDITED)).select(
        *KEYS, "source_column", F.col("target_column").alias("_new"))
    joined = mapping.join(edits, [*KEYS, "source_column"], "left")
    hit = F.col("_new").isNotNull()
    return joined.select(*[{
        "target": F.coalesce("_new", "target"),
        "confidence": F.when(hit, 1.0).otherwise(F.col("confidence")),
        "rationale": F.when(hit, F.concat(F.lit("Manually assigned by reviewer to '"), "_new", F.lit("' (feedback)."))).otherwise(F.col("rationale")),
    }.get(c, F.col(c)).alias(c) for c in mapping.columns])


def approved_entries(recs: DataFrame) -> DataFrame:
    """Memory rows for the column mappings that reviewers approved or edited."""
    from .memory import memory_entries

    done = recs.where("action_type = 'column_mapping' and status = 'approved' and decided_until is not null")
    entries = memory_entries(done.select("source_column", F.col("target_column").alias("target_field"), "confidence", F.col("decided_until").alias("ts"),
                                         (F.col("uncertainty") == EDITED).alias("_edited")), keep=["_edited"])
    return entries.withColumn("method", F.when(F.col("_edited"), "human_feedback").otherwise("human_approved")).drop("_edited")


def to_rereason(recs: DataFrame) -> DataFrame:
    """Rejected with a note, not processed, and still within the limit (H5)."""
    return recs.where(
        (F.col("status") == "rejected") & (F.coalesce("rejection_note", F.lit("")) != "")
        & ~F.col("feedback_processed") & (F.col("re_reason_count") < MAX_REREASON))


def next_best(rejected: DataFrame, candidates: DataFrame, mapping: DataFrame) -> DataFrame:
    """Best alternative target per rejected mapping (H6).

    ``candidates`` are viable candidates. The rejected target and the targets other columns
    of the sheet use are excluded.
    """
    wanted = rejected.where("action_type = 'column_mapping'").select(
        *KEYS, "source_column", F.col("target_column").alias("_rejected"))
    used = mapping.where("target is not null").select(*KEYS, "target", F.col("source_column").alias("_user"))
    # Sort-merged by hint, since the size of a compressed file says little about the size in memory.
    options = candidates.join(wanted.hint("merge"), [*KEYS, "source_column"]).where(F.col("target") != F.col("_rejected"))
    options = options.join(used.hint("merge"), [*KEYS, "target"], "left")
    free = options.where(F.col("_user").isNull() | (F.col("_user") == F.col("source_column")))
    order = Window.partitionBy(*KEYS, "source_column").orderBy(
        "tier", F.when(F.col("tier") < 2, 0.0).otherwise(-F.col("confidence")), "cand_order")
    return free.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(
        *KEYS, "source_column", F.col("target").alias("alternative"), F.col("confidence").alias("alt_confidence"),
        F.col("method").alias("alt_method"), F.col("rationale").alias("alt_rationale"))


def apply_rereason(recs: DataFrame, rejected: DataFrame, alternatives: DataFrame) -> DataFrame:
    """Outcome of re-reasoning on every rejected item (H7).

    A mapping with an alternative goes back to review, one without is escalated, a rejected
    data fix stays rejected; each carries the explanation.
    """
    marked = rejected.select(*KEYS, "rec_id", F.lit(True).alias("_hit"))
    alts = alternatives.select(*KEYS, "source_column", "alternative", "alt_confidence", "alt_rationale")
    joined = recs.join(marked.hint("merge"), [*KEYS, "rec_id"], "left").join(alts.hint("merge"), [*KEYS, "source_column"], "left")
    hit = F.coalesce("_hit", F.lit(False))
    is_map = F.col("action_type") == "column_mapping"
    swap = hit & is_map & F.col("alternative").isNotNull()
    stuck = hit & is_map & F.col("alternative").isNull()
    note = F.concat(F.lit('"'), "rejection_note", F.lit('"'))
    lead = F.concat(F.lit("Re-reasoned with reviewer feedback "), note)
    return joined.select(*[{
        "target_column": F.when(swap, F.col("alternative")).otherwise(F.col("target_column")),
        "confidence": F.when(swap, F.col("alt_confidence")).otherwise(F.col("confidence")),
        "after_example": F.when(swap, F.concat(F.lit("Renamed to: '"), "alternative", F.lit("'")))
        .otherwise(F.col("after_example")),
        "rationale": F.when(swap, F.concat(
            F.lit("Re-reasoned after reviewer rejected '"), "target_column", F.lit("' ("), note, F.lit("). "),
            "alt_rationale")).otherwise(F.col("rationale")),
        "status": F.when(swap, "pending").when(stuck, "escalated").otherwise(F.col("status")),
        "review_required": F.when(swap, True).otherwise(F.col("review_required")),
        "uncertainty": F.when(swap, F.concat(
            lead, F.lit(": '"), "target_column", F.lit("' withdrawn; alternative '"), "alternative",
            F.lit("' proposed for review.")))
        .when(stuck, F.concat(lead, F.lit(
            ": no alternative target fits this column. Escalated to a human reviewer; the column stays unmapped "
            "unless a target is assigned.")))
        .when(hit, F.concat(lead, F.lit(": change withdrawn; the values stay as they are in the source.")))
        .otherwise(F.col("uncertainty")),
        "feedback_processed": F.when(hit, True).otherwise(F.col("feedback_processed")),
    }.get(c, F.col(c)).alias(c) for c in REC_COLUMNS])


def apply_alternatives(mapping: DataFrame, rejected: DataFrame, alternatives: DataFrame) -> DataFrame:
    """Mapping table after re-reasoning: alternative target, or unmapped (H6, H7)."""
    wanted = rejected.where("action_type = 'column_mapping'").select(
        *KEYS, "source_column", F.col("target_column").alias("_was"), F.col("rejection_note").alias("_note"))
    joined = mapping.join(wanted.hint("merge"), [*KEYS, "source_column"], "left").join(alternatives.hint("merge"), [*KEYS, "source_column"], "left")
    hit = F.col("_was").isNotNull()
    prefix = F.concat(F.lit("Re-reasoned after reviewer rejected '"), "_was", F.lit("' (\""), "_note", F.lit("\"). "))
    tail = F.coalesce("alt_rationale", F.lit("No alternative target found; escalated to a human reviewer."))
    return joined.select(*[{
        "target": F.when(hit, F.col("alternative")).otherwise(F.col("target")),
        "confidence": F.when(hit, F.coalesce("alt_confidence", F.lit(0.0))).otherwise(F.col("confidence")),
        "method": F.when(hit, F.coalesce("alt_method", F.lit("unresolved"))).otherwise(F.col("method")),
        "rationale": F.when(hit, F.concat(prefix, tail)).otherwise(F.col("rationale")),
        "review_required": F.when(hit, True).otherwise(F.col("review_required")),
    }.get(c, F.col(c)).alias(c) for c in mapping.columns])


# --- gates and indicators ---------------------------------------------------------------

def export_gate(recs: DataFrame) -> DataFrame:
    """Per sheet the next step: re-reason, wait for review, or export (H8)."""
    again = (
        (F.col("status") == "rejected") & (F.coalesce("rejection_note", F.lit("")) != "")
        & ~F.col("feedback_processed") & (F.col("re_reason_count") < MAX_REREASON))
    blocking = (F.col("status") == "pending") & F.col("review_required")
    sums = recs.groupBy(*KEYS).agg(
        F.count(F.when(again, 1)).alias("n_rereason"), F.count(F.when(blocking, 1)).alias("n_blocking"))
    return sums.withColumn(
        "route", F.when(F.col("n_rereason") > 0, "re_reason").when(F.col("n_blocking") > 0, "human_review")
        .otherwise("transform_export"))


def ready_sheets(table: DataFrame, gate: DataFrame) -> DataFrame:
    """Rows of sheets that may be exported (H8)."""
    from ..session import attach

    return attach(table, gate.where("route = 'transform_export'").select(*KEYS), KEYS)


def bulk_approve(recs: DataFrame) -> DataFrame:
    """Approve pending items of high confidence; a sheet without any approves the remaining
    ones that need no review (H9)."""
    high = (F.col("status") == "pending") & (F.col("confidence") >= HIGH_CONFIDENCE)
    any_high = F.max(high.cast("int")).over(Window.partitionBy(*KEYS)) == 1
    rest = (F.col("status") == "pending") & ~F.col("review_required")
    approve = F.when(F.col("_any"), high).otherwise(rest)
    return recs.withColumn("_any", any_high).withColumn(
        "status", F.when(approve, "approved").otherwise(F.col("status"))).drop("_any")


def status_counts(recs: DataFrame) -> DataFrame:
    """Items per status at sheet, file and portfolio level."""
    return recs.rollup(*KEYS).agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n_total"),
        *[F.count(F.when(F.col("status") == s, 1)).alias(f"n_{s}") for s in ("pending", "approved", "rejected", "escalated")])


def mapping_accuracy(recs: DataFrame) -> DataFrame:
    """Approved share of the proposed mappings per sheet, in percent."""
    maps = F.col("action_type") == "column_mapping"
    n = F.count(F.when(maps, 1))
    ok = F.count(F.when(maps & (F.col("status") == "approved"), 1))
    return recs.groupBy(*KEYS).agg(
        n.alias("n_mappings"), ok.alias("n_approved_mappings"),
        F.coalesce(ok * 100.0 / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("mapping_accuracy"))


# Reviewer texts per operation as (title, summary, reason, impact).
TEXTS = {
    "strip_currency": (
        "Clean amounts in '{tgt}'", "Drops $ signs and thousands commas so that amounts are plain numbers.",
        "{n} row(s) of '{tgt}' are written as currency.", "'$1,500,000' becomes 1500000.0.",
    ),
    "normalize_sprinkler_code": (
        "Unify sprinkler codes in '{tgt}'", "Rewrites informal wording as Y, N, Y13 or Y(13R).",
        "{n} value(s) of '{src}' are not a known code.", "'Yes' becomes Y and 'No' becomes N.",
    ),
    "state_to_abbrev": (
        "Unify state codes in '{tgt}'", "Rewrites state names and dotted codes as two-letter codes.",
        "{n} row(s) hold something other than a state code.", "'California' becomes CA.",
    ),
    "to_year_int": (
        "Unify years in '{tgt}'", "Takes the four-digit year out of each value.",
        "{n} row(s) do not hold a plain valid year.", "Years are stored as whole numbers.",
    ),
    "to_float": (
        "Store '{tgt}' as numbers", "Reads amounts written as text as numbers.",
        "{n} row(s) hold numbers written as text.", "Text amounts become decimal numbers.",
    ),
    "to_int": (
        "Store '{tgt}' as whole numbers", "Reads whole numbers written as decimals or text.",
        "{n} row(s) are not written as whole numbers.", "Whole values become integers; 1.5 stays 1.5 and is never cut.",
    ),
    "flag_for_review": (
        "Check '{tgt}'", "{n} row(s) need a look, for example missing or impossible values.",
        "{why}", "No value changes: approving notes the finding, rejecting dismisses it.",
    ),
    "": (
        "Apply {op_title} to '{tgt}'", "Runs the whitelisted operation '{op}' on '{tgt}'.",
        "{why}", "Up to {n} row(s) change.",
    ),
}
# Reviewer texts for column mappings; the reason depends on the confidence.
MAPPING_TEXTS = (
    "Map column '{src}' → '{tgt}'",
    "Uses source column '{src}' as the standard field '{tgt}'.",
    [(0.95, "'{src}' is a known name of '{tgt}'."),
     (0.85, "The header and the values of '{src}' both look like '{tgt}'."),
     (0.0, "'{src}' resembles '{tgt}' only moderately; please check it.")],
    "The column is called '{tgt}' in the cleaned table.",
)


def describe(recs: DataFrame) -> DataFrame:
    """Plain title, summary, reason and impact for every recommendation."""
    op = F.coalesce("operation", F.lit(""))
    why = F.when(F.coalesce("rationale", F.lit("")) != "", F.col("rationale")).otherwise(
        F.when(op == "flag_for_review", F.concat(F.lit("Potential irregularity detected in '"), "target_column", F.lit("'.")))
        .otherwise(F.lit("")))
    slots = {
        "{src}": F.col("source_column"), "{tgt}": F.col("target_column"), "{n}": F.col("affected_rows").cast("string"),
        "{why}": why, "{op}": op, "{op_title}": F.initcap(F.replace(op, F.lit("_"), F.lit(" "))),
    }

    def fill(template: str) -> Column:
        import re

        parts = [slots[p] if p in slots else F.lit(p) for p in re.split(r"(\{\w+\})", template) if p]
        return F.concat(*parts)

    is_map = (F.col("action_type") == "column_mapping") | op.isin("column_rename", "trim_whitespace", "")
    out = recs
    for i, name in enumerate(["title", "summary", "reason", "impact"]):
        text = fill(TEXTS[""][i])
        for key, texts in TEXTS.items():
            if key:
                aliases = ["state_to_abbrev", "normalize_state"] if key == "state_to_abbrev" else [key]
                text = F.when(op.isin(aliases), fill(texts[i])).otherwise(text)
        if name == "reason":
            mapped = fill(MAPPING_TEXTS[2][-1][1])
            for bound, template in reversed(MAPPING_TEXTS[2][:-1]):
                mapped = F.when(F.col("confidence") >= bound, fill(template)).otherwise(mapped)
        else:
            mapped = fill(MAPPING_TEXTS[i])
        out = out.withColumn(name, F.when(is_map, mapped).otherwise(text))
    return out


def merge_suggestions(recs: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Take over external suggestions within the rules.

    ``suggestions(rec_id, s_operation, s_rationale, s_uncertainty, s_confidence)``. An
    operation counts only if whitelisted and not on a column mapping; confidence may only
    fall and the review flag may only tighten.
    """
    joined = recs.join(suggestions, "rec_id", "left")
    found = F.col("s_confidence").isNotNull() | F.col("s_operation").isNotNull() | F.col("s_rationale").isNotNull()
    ok = F.col("s_operation").isin(sorted(WHITELIST)) & (F.col("action_type") != "column_mapping")
    lowered = F.least(F.col("confidence"), F.greatest(F.lit(0.0), F.coalesce("s_confidence", F.col("confidence"))))
    return joined.select(*[{
        "operation": F.when(ok, F.col("s_operation")).otherwise(F.col("operation")),
        "rationale": F.coalesce("s_rationale", "rationale"),
        "uncertainty": F.coalesce("s_uncertainty", "uncertainty"),
        "confidence": F.when(found, lowered).otherwise(F.col("confidence")),
        "review_required": F.col("review_required") | (found & (lowered < HIGH_CONFIDENCE)),
    }.get(c, F.col(c)).alias(c) for c in recs.columns])


def unclaimed_columns(mapping: DataFrame, samples: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Unmapped source columns with four short samples and the current decision."""
    short = F.transform(F.slice("samples", 1, 4), lambda v: F.substring(v, 1, 30))
    out = mapping.where("target is null").select(*KEYS, "col_idx", "source_column").join(
        samples.select(*KEYS, "col_idx", short.alias("samples")), [*KEYS, "col_idx"], "left")
    if decisions is None:
        return out.withColumn("decision", F.lit(None).cast("string")).withColumn("state", F.lit("No action"))
    joined = out.join(decisions.select(*KEYS, "source_column", "decision"), [*KEYS, "source_column"], "left")
    return joined.withColumn(
        "state", F.when(F.col("decision") == "__rejected__", "REJECTED")
        .when(F.coalesce("decision", F.lit("")) != "", F.concat(F.lit("ASSIGNED → "), "decision")).otherwise("No action"))
