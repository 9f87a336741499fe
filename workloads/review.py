"""Queries over recommendations and review.

Recommendations are derived from the orders: one item per order, sheets are customers, so
every item kind, status and decision occurs many times.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from schedulesmith.functions.ops import WHITELIST
from schedulesmith.operators import review as r
from schedulesmith.schema import KEYS, TARGET_FIELDS
from schedulesmith.session import settle, store

from . import duck as d
from . import mapping as mp
from . import quality as ql
from . import values as vl
from .inputs import duck_sql, spark_sql, table
from .mapping import _pick

Q, SQL = {}, {}
K = "file_id, sheet_name"


def add(name, fn, sql=None):
    Q[name] = fn
    if sql:
        SQL[name] = sql


OPS = ["strip_currency", "to_float", "to_int", "to_year_int", "state_to_abbrev", "normalize_sprinkler_code", "flag_for_review", "drop_table"]
KINDS = ["column_mapping", "standardisation", "data_correction", "flag_for_review"]
STATUSES = ["pending", "approved", "rejected", "escalated", "pending"]
NOTES = ["", "wrong column", None, "check values"]

RECS = f"""select o_orderstatus as file_id, concat('sheet ', cast(o_custkey as string)) as sheet_name,
  concat('REC-', cast(o_orderkey as string)) as rec_id, cast(o_orderkey as int) as rec_order,
  {_pick('o_orderkey', KINDS)} as action_type, concat('col ', cast(o_orderkey % 7 as string)) as source_column,
  {_pick('o_orderkey * 3', TARGET_FIELDS)} as target_column,
  case when o_orderkey % 4 = 0 then 'trim_whitespace' else {_pick('o_orderkey * 5 + o_custkey', OPS)} end as operation,
  concat('$', cast(o_orderkey as string)) as before_example, 'after' as after_example,
  case when o_orderkey % 10 = 0 then '' else concat('because of ', cast(o_orderkey as string)) end as rationale,
  cast(o_orderkey % 60 + 40 as double) / 100 as confidence, '' as uncertainty, cast(o_orderkey % 31 as bigint) as affected_rows,
  cast(null as bigint) as affected_row_indices, {_pick('o_orderkey * 7 + o_custkey', STATUSES)} as status,
  {_pick('o_orderkey + o_custkey', NOTES)} as rejection_note, cast(o_custkey % 4 as int) as re_reason_count,
  o_orderkey % 3 = 0 as feedback_processed, {_pick('o_orderkey', ['', 'format', 'type_error', 'duplicate'])} as issue_type,
  o_orderkey % 2 = 0 as review_required from {{orders}}"""
RECS_DUCK = duck_sql(RECS)


def recs(spark, sf):
    return _queue(spark, sf, RECS)


def flat(df):
    return df.drop("affected_row_indices", "decided_until")


_FLAT = [c for c in r.REC_COLUMNS if c not in ("affected_row_indices", "decided_until")]

# --- H1, H2 -----------------------------------------------------------------------------
_after = (
    f"case suggested_operation when 'strip_currency' then coalesce({{cur}}, '<NA>') "
    f"when 'to_year_int' then coalesce(cast({{year}} as varchar), '<NA>') when 'to_int' then coalesce({{int}}, '<NA>') "
    f"when 'to_zip' then coalesce(cast({{zip}} as varchar), '<NA>') when 'state_to_abbrev' then {{state}} "
    f"when 'normalize_sprinkler_code' then {{spr}} end")


def _over_example(sql: str, column: str) -> str:
    return sql.replace(column, "before_example")


_cur = d.currency("before_example")
_int = d.plain("before_example", ",")
_year = _over_example(vl.YEAR_SQL, "year_raw")
AFTER = _after.format(
    cur=f"(case when {_cur} = floor({_cur}) then concat(cast(cast({_cur} as bigint) as varchar), '.0') else cast({_cur} as varchar) end)",
    year=_year, int=f"(case when {_int} = floor({_int}) then cast(cast({_int} as bigint) as varchar) when {_int} is not null then before_example end)",
    zip=_over_example(vl.ZIP_SQL, "zip_raw"), state=_over_example(vl.STATE_SQL, "state_raw"), spr=_over_example(vl.SPRINKLER_SQL, "sprinkler_raw"))
add("issue_recommendations",
    lambda spark, sf: r.issue_recommendations(ql.issues(spark, sf)).select(
        *KEYS, "action_type", "target_column", "operation", "before_example", "after_example", "rationale", "confidence",
        "affected_rows", "review_required", "issue_type"),
    ql.ISSUES + f""" select {K}, case when issue_type in ('format', 'type_error') then 'standardisation'
        when issue_type = 'logical_error' and suggested_operation <> 'flag_for_review' then 'data_correction' else 'flag_for_review' end as action_type,
      affected_field as target_column, suggested_operation as operation, before_example,
      case when suggested_operation = 'flag_for_review' then '[flagged — no transformation applied]' else {AFTER} end as after_example,
      evidence as rationale, confidence, affected_row_count as affected_rows, confidence < 0.9 or severity in ('high', 'medium') as review_required, issue_type from numbered""")
add("mapping_recommendations",
    lambda spark, sf: r.mapping_recommendations(settle(mp.mapping(spark, sf))).select(
        *KEYS, "source_column", "target_column", "operation", "before_example", "after_example", "confidence", "uncertainty", "review_required"),
    mp.MAPPED + f""" select {K}, source_column, target as target_column, 'trim_whitespace' as operation, concat('Column: ''', source_column, '''') as before_example,
      concat('Renamed to: ''', target, '''') as after_example, confidence,
      case when confidence >= 0.9 then '' else concat('Confidence ', printf('%.0f', confidence * 100), '% — review recommended.') end as uncertainty,
      review_required or confidence < 0.9 as review_required from mapping where target is not null""")

# --- H3: the previous round is the same queue with another customer's view of it -----------
PREVIOUS = f"""select file_id, sheet_name, concat('OLD-', rec_id) as rec_id, rec_order, action_type, source_column,
  case when action_type = 'column_mapping' then 'Other' else target_column end as target_column, operation, before_example, after_example, rationale,
  confidence / 2 as confidence, 'noted' as uncertainty, affected_rows, affected_row_indices, {_pick('rec_order', ['approved', 'rejected', 'pending', 'escalated', 'approved'])} as status,
  'note' as rejection_note, re_reason_count, feedback_processed, issue_type, review_required from ({RECS})
  where issue_type <> 'duplicate' or status <> 'approved'"""
FRESH = f"select * from ({RECS}) where operation <> 'drop_table'"


def _queue(spark, sf, sql):
    return spark_sql(spark, sf, sql).withColumn("affected_row_indices", F.array().cast("array<bigint>")).withColumn(
        "decided_until", F.lit(None).cast("timestamp"))


_key = "case when action_type = 'column_mapping' then concat_ws('|', action_type, source_column) else concat_ws('|', action_type, source_column, target_column, operation, issue_type) end"
add("carry_over_decisions",
    lambda spark, sf: flat(r.carry_over(_queue(spark, sf, FRESH), _queue(spark, sf, PREVIOUS))),
    f"""with fresh as (select *, row_number() over (partition by {K}, key order by rec_order, rec_id) as nth from (select *, {_key} as key from ({duck_sql(FRESH)}))),
      old as (select *, row_number() over (partition by {K}, key order by rec_order, rec_id) as nth from (select *, {_key} as key from ({duck_sql(PREVIOUS)}))),
      kept as (select f.*, o.rec_id as o_id, o.status as o_status, o.rejection_note as o_note, o.re_reason_count as o_count, o.feedback_processed as o_done,
          o.target_column as o_target, o.confidence as o_conf, o.uncertainty as o_unc from fresh f left join old o using ({K}, key, nth))
      select {K}, coalesce(o_id, rec_id) as rec_id, rec_order, action_type, source_column,
        case when o_id is not null and action_type = 'column_mapping' and o_status <> 'pending' then o_target else target_column end as target_column, operation, before_example, after_example, rationale,
        case when o_id is not null and action_type = 'column_mapping' and o_status <> 'pending' then o_conf else confidence end as confidence,
        case when o_id is not null and (o_done or (action_type = 'column_mapping' and o_status <> 'pending')) then o_unc else uncertainty end as uncertainty,
        affected_rows, coalesce(o_status, status) as status, case when o_id is not null then o_note else rejection_note end as rejection_note,
        coalesce(o_count, re_reason_count) as re_reason_count, coalesce(o_done, feedback_processed) as feedback_processed, issue_type, review_required from kept
      union all
      select {", ".join(_FLAT)} from old o where not exists (select 1 from fresh f where f.file_id = o.file_id and f.sheet_name = o.sheet_name and f.key = o.key and f.nth = o.nth)
        and (status = 'escalated' or (action_type = 'column_mapping' and status <> 'pending' and feedback_processed))""")

# --- H4: decisions are the line items of an order, in shipping order ------------------------
DECISIONS = f"""select o_orderstatus as file_id, concat('sheet ', cast(o_custkey as string)) as sheet_name, concat('REC-', cast(o_orderkey as string)) as rec_id,
  {_pick('l_partkey + l_linenumber', ['approve', 'reject', 'revert', 'edit', 'reject'])} as decision, {_pick('l_suppkey', NOTES)} as note,
  {_pick('l_partkey', [*TARGET_FIELDS, 'Elevation'])} as new_target, l_shipdate as ts from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey"""
_newest = f"""dec as ({duck_sql(DECISIONS)}), newest as (select *, count(case when decision = 'reject' then 1 end) over (partition by {K}, rec_id) as rejections
    from dec qualify row_number() over (partition by {K}, rec_id order by ts desc, decision desc, note desc nulls last, new_target desc) = 1)"""
add("apply_decisions",
    lambda spark, sf: r.apply_decisions(recs(spark, sf), spark_sql(spark, sf, DECISIONS)).select(
        *KEYS, "rec_id", "status", "rejection_note", "re_reason_count", "target_column", "confidence", "uncertainty"),
    f"""with recs as ({RECS_DUCK}), {_newest}, j as (select r.*, n.decision, n.note, n.new_target, n.rejections,
        n.decision = 'edit' and n.new_target <> 'Elevation' as edit from recs r left join newest n using ({K}, rec_id))
      select {K}, rec_id, case when decision = 'approve' or edit then 'approved' when decision = 'reject' then 'rejected' when decision = 'revert' then 'pending' else status end as status,
        case when decision = 'reject' then coalesce(note, '') else rejection_note end as rejection_note, (re_reason_count + coalesce(rejections, 0))::int as re_reason_count,
        case when edit then new_target else target_column end as target_column, case when edit then 1.0::double else confidence end as confidence,
        case when edit then 'User manually assigned target (saved as human feedback).' else uncertainty end as uncertainty from j""")
# The same history applied to its own result changes nothing.
add("decisions_replayed",
    lambda spark, sf: r.apply_decisions(settle(r.apply_decisions(recs(spark, sf), spark_sql(spark, sf, DECISIONS))), spark_sql(spark, sf, DECISIONS)).select(
        *KEYS, "rec_id", "status", "rejection_note", "re_reason_count", "target_column", "confidence", "uncertainty"), SQL["apply_decisions"])


def _reviewed(spark, sf):
    """A decision on every mapped column: approved, edited to Other, or rejected, by position."""
    mapping = settle(mp.mapping(spark, sf))
    items = settle(r.mapping_recommendations(mapping))
    decisions = items.select(
        *KEYS, "rec_id", _pick_by(F.col("rec_order"), ["approve", "edit", "reject"]).alias("decision"), F.lit("").alias("note"), F.lit("Other").alias("new_target"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("rec_order")).alias("ts"))
    return mapping, r.apply_decisions(items, decisions)


def _pick_by(index, options):
    return F.get(F.array(*[F.lit(o) for o in options]), (index % len(options)).cast("int"))


def _edited(spark, sf):
    mapping, decided = _reviewed(spark, sf)
    return r.edited_mapping(mapping, decided)


add("edited_mapping", lambda spark, sf: _edited(spark, sf).select(*KEYS, "col_idx", "target", "confidence", "method", "rationale"),
    mp.MAPPED + f""" select {K}, col_idx, case when target is not null and col_idx % 3 = 1 then 'Other' else target end as target,
      case when target is not null and col_idx % 3 = 1 then 1.0::double else confidence end as confidence, method,
      case when target is not null and col_idx % 3 = 1 then 'Manually assigned by reviewer to ''Other'' (feedback).' else rationale end as rationale from mapping""")
add("remembered_approvals",
    lambda spark, sf: r.approved_entries(_reviewed(spark, sf)[1]).select(
        "normalized_source", "source_column", "target_field", "confidence", "method", F.date_format("ts", "ss").alias("second")),
    mp.MAPPED + f""" select {d.normalize_memory('source_column')} as normalized_source, source_column, case when col_idx % 3 = 1 then 'Other' else target end as target_field,
      case when col_idx % 3 = 1 then 1.0::double else confidence end as confidence, case when col_idx % 3 = 1 then 'human_feedback' else 'human_approved' end as method,
      lpad(col_idx::varchar, 2, '0') as second from mapping where target is not null and col_idx % 3 < 2""")
add("latest_decisions",
    lambda spark, sf: r.latest_decisions(
        table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"]).select(
        "user_id", "event_type", "event_id", "value"),
    "select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1")
_again = "status = 'rejected' and coalesce(rejection_note, '') <> '' and not feedback_processed and re_reason_count < 2"
add("rereason_selection", lambda spark, sf: flat(r.to_rereason(recs(spark, sf))),
    f"select {', '.join(_FLAT)} from ({RECS_DUCK}) where {_again}")

# --- H6, H7 over the assigned sheets ------------------------------------------------------
REJECT_NOTE = "values do not fit"


def _review(spark, sf):
    """Every third customer's mappings are rejected with a note."""
    every = store(mp.candidates(spark, sf))
    cands, mapping = mp.m.viable_candidates(every), store(mp.mapping(spark, sf, every))
    items = store(r.mapping_recommendations(mapping).withColumns({
        "status": F.when(F.col("confidence") < 0.8, "rejected").otherwise("approved"),
        "rejection_note": F.when(F.col("confidence") < 0.8, REJECT_NOTE).otherwise("")}))
    rejected = store(r.to_rereason(items))
    return items, mapping, rejected, store(r.next_best(rejected, cands, mapping))


_next = f"""rej as (select {K}, col_idx, source_column, target from mapping where target is not null and confidence < 0.8),
  opts as (select v.*, r.target as was from viable v join rej r on v.file_id = r.file_id and v.sheet_name = r.sheet_name and v.col_idx = r.col_idx
    where v.target <> r.target and not exists (select 1 from mapping u where u.file_id = v.file_id and u.sheet_name = v.sheet_name and u.target = v.target and u.col_idx <> v.col_idx)),
  alt as (select * from opts qualify row_number() over (partition by {K}, col_idx order by seq) = 1)"""
add("next_best_targets",
    lambda spark, sf: _review(spark, sf)[3].select(*KEYS, "source_column", "alternative", "alt_confidence", "alt_method"),
    mp.MAPPED + f", {_next} select {K}, source_column, target as alternative, confidence as alt_confidence, method as alt_method from alt")


def _outcomes(spark, sf):
    items, _, rejected, alternatives = _review(spark, sf)
    return r.apply_rereason(items, rejected, alternatives)


add("rereason_outcomes",
    lambda spark, sf: _outcomes(spark, sf).select(*KEYS, "source_column", "target_column", "status", "confidence", "uncertainty", "feedback_processed"),
    mp.MAPPED + f""", {_next} select m.file_id, m.sheet_name, m.source_column, coalesce(a.target, m.target) as target_column,
      case when r.col_idx is null then 'approved' when a.target is null then 'escalated' else 'pending' end as status, coalesce(a.confidence, m.confidence) as confidence,
      case when r.col_idx is null then case when m.confidence >= 0.9 then '' else concat('Confidence ', printf('%.0f', m.confidence * 100), '% — review recommended.') end
        when a.target is null then 'Re-reasoned with reviewer feedback "{REJECT_NOTE}": no alternative target fits this column. Escalated to a human reviewer; the column stays unmapped unless a target is assigned.'
        else concat('Re-reasoned with reviewer feedback "{REJECT_NOTE}": ''', m.target, ''' withdrawn; alternative ''', a.target, ''' proposed for review.') end as uncertainty,
      r.col_idx is not null as feedback_processed
      from mapping m left join rej r using ({K}, col_idx) left join alt a using ({K}, col_idx) where m.target is not null""")


def _alternative_mapping(spark, sf):
    _, mapping, rejected, alternatives = _review(spark, sf)
    return r.apply_alternatives(mapping, rejected, alternatives)


add("rereasoned_mapping",
    lambda spark, sf: _alternative_mapping(spark, sf).select(*KEYS, "col_idx", "target", "confidence", "method", "review_required"),
    mp.MAPPED + f""", {_next} select m.file_id, m.sheet_name, m.col_idx, case when r.col_idx is null then m.target else a.target end as target,
      case when r.col_idx is null then m.confidence else coalesce(a.confidence, 0) end as confidence,
      case when r.col_idx is null then m.method else coalesce(a.method, 'unresolved') end as method, r.col_idx is not null or m.review_required as review_required
      from mapping m left join rej r using ({K}, col_idx) left join alt a using ({K}, col_idx)""")

# --- H8-H13 -----------------------------------------------------------------------------
_gate = f"""gate as (select {K}, count(case when {_again} then 1 end) as n_rereason, count(case when status = 'pending' and review_required then 1 end) as n_blocking from ({RECS_DUCK}) group by all),
  routed as (select *, case when n_rereason > 0 then 're_reason' when n_blocking > 0 then 'human_review' else 'transform_export' end as route from gate)"""
add("export_gate", lambda spark, sf: r.export_gate(recs(spark, sf)), f"with {_gate} select * from routed")
add("ready_items",
    lambda spark, sf: r.ready_sheets(recs(spark, sf).withColumn("row_idx", F.col("rec_order")), settle(r.export_gate(recs(spark, sf)))).select(*KEYS, "rec_id"),
    f"with {_gate} select {K}, rec_id from ({RECS_DUCK}) semi join (select * from routed where route = 'transform_export') using ({K})")
add("bulk_approval", lambda spark, sf: r.bulk_approve(recs(spark, sf)).select(*KEYS, "rec_id", "status"),
    f"""select {K}, rec_id, case when status = 'pending' and case when any_high then confidence >= 0.9 else not review_required end then 'approved' else status end as status
      from (select *, bool_or(status = 'pending' and confidence >= 0.9) over (partition by {K}) as any_high from ({RECS_DUCK}))""")
add("status_counts", lambda spark, sf: r.status_counts(recs(spark, sf)).withColumn("level", F.col("level").cast("int")),
    f"""select {K}, grouping(file_id, sheet_name)::int as level, count(*) as n_total, count(case when status = 'pending' then 1 end) as n_pending, count(case when status = 'approved' then 1 end) as n_approved,
      count(case when status = 'rejected' then 1 end) as n_rejected, count(case when status = 'escalated' then 1 end) as n_escalated from ({RECS_DUCK}) group by rollup ({K})""")
add("mapping_accuracy_kpi", lambda spark, sf: r.mapping_accuracy(recs(spark, sf)),
    f"""select {K}, n as n_mappings, ok as n_approved_mappings, coalesce(ok * 100.0::double / nullif(n, 0), 0) as mapping_accuracy from (
      select {K}, count(case when action_type = 'column_mapping' then 1 end) as n, count(case when action_type = 'column_mapping' and status = 'approved' then 1 end) as ok from ({RECS_DUCK}) group by all)""")


def _text_sql(which: int) -> str:
    def fill(t: str) -> str:
        import re

        slots = {"{src}": "source_column", "{tgt}": "target_column", "{n}": "affected_rows::varchar", "{why}": "why", "{op}": "operation",
                 "{op_title}": "array_to_string(list_transform(string_split(operation, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ')"}
        return "(" + " || ".join(slots[p] if p in slots else d.quoted(p) for p in re.split(r"(\{\w+\})", t) if p) + ")"

    ops = " ".join(f"when operation = '{k}' then {fill(t[which])}" for k, t in r.TEXTS.items() if k)
    if which == 2:
        (b1, t1), (b2, t2), (_, t3) = r.MAPPING_TEXTS[2]
        mapped_text = f"case when confidence >= {b1} then {fill(t1)} when confidence >= {b2} then {fill(t2)} else {fill(t3)} end"
    else:
        mapped_text = fill(r.MAPPING_TEXTS[which])
    return f"case when action_type = 'column_mapping' or operation = 'trim_whitespace' then {mapped_text} {ops} else {fill(r.TEXTS[''][which])} end"


add("recommendation_texts", lambda spark, sf: r.describe(recs(spark, sf)).select("rec_id", "title", "summary", "reason", "impact"),
    f"""select rec_id, {_text_sql(0)} as title, {_text_sql(1)} as summary, {_text_sql(2)} as reason, {_text_sql(3)} as impact from (
      select *, case when rationale <> '' then rationale when operation = 'flag_for_review' then concat('Potential irregularity detected in ''', target_column, '''.') else '' end as why from ({RECS_DUCK}))""")
SUGGESTIONS = f"""select concat('REC-', cast(l_orderkey as string)) as rec_id, {_pick('max(l_partkey)', OPS)} as s_operation,
  {_pick('max(l_suppkey)', ['clear', None])} as s_rationale, {_pick('max(l_suppkey)', [None, 'unsure'])} as s_uncertainty,
  case when max(l_partkey) % 5 = 0 then null else max(l_discount) * 12 - 0.1 end as s_confidence from {{lineitem}} group by l_orderkey"""
add("merged_suggestions",
    lambda spark, sf: r.merge_suggestions(recs(spark, sf), spark_sql(spark, sf, SUGGESTIONS)).select(
        "rec_id", "operation", "rationale", "uncertainty", F.round("confidence", 9).alias("confidence"), "review_required"),
    f"""with j as (select r.*, s.*, least(confidence, greatest(0, coalesce(s_confidence, confidence))) as low, s.rec_id is not null as found
        from ({RECS_DUCK}) r left join ({duck_sql(SUGGESTIONS)}) s using (rec_id))
      select rec_id, case when s_operation in {d.in_list(sorted(WHITELIST))} and action_type <> 'column_mapping' then s_operation else operation end as operation,
        coalesce(s_rationale, rationale) as rationale, coalesce(s_uncertainty, uncertainty) as uncertainty,
        round(case when found then low else confidence end, 9) as confidence, review_required or (found and low < 0.9) as review_required from j""")

# --- H14 --------------------------------------------------------------------------------
UNCLAIMED = f"""select c_mktsegment as file_id, c_name as sheet_name, {_pick('c_custkey * 5 + 14', mp.HEADERS)} as source_column,
  {_pick('c_custkey', ['Occupancy', '__rejected__', ''])} as decision from {{customer}}"""


def _samples(spark, sf):
    return mp.columns(spark, sf).select(
        *KEYS, "col_idx", F.transform(F.array(*[F.lit(i) for i in range(5)]), lambda i: F.concat(
            F.col("source_column"), F.lit(" sample value number "), i.cast("string"))).alias("samples"))


add("unclaimed_columns",
    lambda spark, sf: r.unclaimed_columns(settle(mp.mapping(spark, sf)), _samples(spark, sf), spark_sql(spark, sf, UNCLAIMED)).withColumn(
        "samples", F.array_join("samples", "|")),
    mp.MAPPED + f""" select m.file_id, m.sheet_name, m.source_column, m.col_idx::int as col_idx,
      array_to_string(list_transform(range(4), lambda i: substr(concat(m.source_column, ' sample value number ', i), 1, 30)), '|') as samples, u.decision,
      case when u.decision = '__rejected__' then 'REJECTED' when coalesce(u.decision, '') <> '' then concat('ASSIGNED → ', u.decision) else 'No action' end as state
      from mapping m left join ({duck_sql(UNCLAIMED)}) u using ({K}, source_column) where m.target is null""")
