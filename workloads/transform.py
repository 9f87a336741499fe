"""Queries over controlled transformation, enforcement and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from schedulesmith.operators import transform as t
from schedulesmith.operators import validate as v
from schedulesmith.schema import INTEGER_FIELDS, KEYS, MONETARY_FIELDS, TARGET_DTYPES, TARGET_FIELDS
from schedulesmith.session import settle
from schedulesmith.sources import sinks

from . import duck as d
from . import mapping as mp
from . import review as rv
from . import values as vl
from .inputs import MAPPED_DUCK, RAW_COLUMNS, RAW_DUCK, RAW_FIELDS, duck_sql, mapped, raw, spark_sql, table
from .mapping import _pick

Q, SQL = {}, {}
K = "file_id, sheet_name"


def add(name, fn, sql=None):
    Q[name] = fn
    if sql:
        SQL[name] = sql


# --- claims over the customer sheets ------------------------------------------------------
CLAIM_RECS = f"""select file_id, sheet_name, concat('MAP-', source_column) as rec_id, col_idx as rec_order, 'column_mapping' as action_type, source_column,
  coalesce(target, 'Other') as target_column, {_pick('col_idx + length(source_column)', ['approved', 'approved', 'rejected', 'pending'])} as status, confidence"""
_claim_recs = f"recs as ({CLAIM_RECS} from ({duck_sql(mp.CLAIMS)}))"
_claims = f"""{_claim_recs}, claims as (select * from (select *, target_column as target, rec_order as col_idx from recs where status = 'approved')
    qualify row_number() over (partition by {K}, target order by confidence desc, col_idx, rec_id) = 1)"""


def claim_recs(spark, sf):
    items = mp.claims(spark, sf)
    return spark.sql(CLAIM_RECS + " from {items}", items=items)


def claims(spark, sf):
    return t.claim_targets(claim_recs(spark, sf), mp.columns(spark, sf).drop("k"))


def customer_records(spark, sf):
    """One record per order of the customer's sheet, twelve cells each."""
    cells = F.transform(F.sequence(F.lit(0), F.lit(mp.WIDTH - 1)), lambda j: F.when(
        (F.col("o_orderkey") + j) % 5 != 0, F.concat(F.lit("v"), j.cast("string"), F.lit("-"), F.col("o_orderkey").cast("string"))))
    return table(spark, sf, "orders").join(table(spark, sf, "customer").hint("merge"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("file_id"), F.col("c_name").alias("sheet_name"), F.col("o_orderkey").alias("row_idx"),
        cells.alias("values"), F.lit(None).cast("array<string>").alias("types"))


_cells = f"""cells as (select c_mktsegment as file_id, c_name as sheet_name, o_orderkey as row_idx, j as col_idx,
    case when (o_orderkey + j) % 5 <> 0 then concat('v', j, '-', o_orderkey) end as value
  from orders join customer on o_custkey = c_custkey, (select unnest(range({mp.WIDTH})) as j))"""
add("claimed_targets", lambda spark, sf: claims(spark, sf).select(*KEYS, "source_column", "target", "confidence"),
    f"with {_claims} select {K}, source_column, target, confidence from claims")
add("rejected_columns",
    lambda spark, sf: t.rejected_columns(claim_recs(spark, sf), mp.columns(spark, sf).drop("k"), claims(spark, sf)).select(*KEYS, "source_column"),
    f"with {_claims} select {K}, source_column from recs where status = 'rejected'")
add("renamed_cells",
    lambda spark, sf: t.rename_claimed(customer_records(spark, sf), settle(claims(spark, sf)), mp.columns(spark, sf).drop("k")),
    f"""with {_claims}, {_cells}, cols as ({mp.COLUMNS_DUCK}),
      names as (select {K}, col_idx, coalesce(c.target, case when cols.source_column in {d.in_list(TARGET_FIELDS)} then concat('_unmapped_', cols.source_column) else cols.source_column end) as column_name
        from cols left join (select {K}, col_idx, target from claims) c using ({K}, col_idx))
      select {K}, row_idx, column_name, value from cells join names using ({K}, col_idx)""")
_pivot = ", ".join(f'max(case when target = {d.quoted(f)} then value end) as "{f}"' for f in TARGET_FIELDS)
add("mapped_table",
    lambda spark, sf: t.mapped_table(customer_records(spark, sf), settle(t.positions_from_mapping(mp.mapping(spark, sf)))),
    mp.MAPPED + f""", {_cells} select {K}, row_idx, {_pivot} from cells semi join (select distinct {K} from mapping) using ({K})
      left join (select {K}, col_idx, target from mapping where target is not null) m using ({K}, col_idx) group by all""")
add("fullest_duplicates",
    lambda spark, sf: t.resolve_duplicates(
        customer_records(spark, sf).select(*KEYS, "row_idx", F.posexplode("values").alias("col_idx", "value"))
        .groupBy(*KEYS, "col_idx").agg(F.count("value").alias("n_nonnull"))
        .withColumn("target", F.concat(F.lit("target "), (F.col("col_idx") % 4).cast("string")))),
    f"""with {_cells}, n as (select {K}, col_idx, count(value) as n_nonnull, concat('target ', col_idx % 4) as target from cells group by all)
      select {K}, target, col_idx::int as col_idx from n qualify row_number() over (partition by {K}, target order by n_nonnull desc, col_idx) = 1""")

# --- cleaning the dirty schedule ----------------------------------------------------------
# Approved operations as (step order, target, operation); State is rejected on one sheet and
# Contents is left alone on another. Dates are assigned to Occupancy or rejected by file.
STEPS = [("Building Value", "strip_currency"), ("Contents", "strip_currency"), ("Year Built", "to_year_int"),
         ("Fire Sprinklers (Y/N)", "normalize_sprinkler_code"), ("State", "state_to_abbrev"), ("Zip", "to_zip"),
         ("Storeys", "to_int"), ("Zip", "to_int"), ("City", "trim_whitespace"), ("City", "normalize_spaces")]
STAMP = "2024-01-01T00:00:00"


def schedule_columns(spark, sf):
    names = F.array(*[F.lit(c) for c in RAW_COLUMNS])
    sheets = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("file_id"), F.col("o_orderpriority").alias("sheet_name")).distinct()
    return sheets.select(*KEYS, F.posexplode(names).alias("col_idx", "source_column"))


def schedule_records(spark, sf):
    return raw(spark, sf).select(*KEYS, "row_idx", F.array(*RAW_COLUMNS).alias("values"), F.lit(None).cast("array<string>").alias("types"))


def schedule_recs(spark, sf):
    """Approved recommendations for every sheet, with the two exceptions."""
    items = [F.struct(F.lit(i).alias("rec_order"), F.lit("column_mapping").alias("action_type"), F.lit(c).alias("source_column"),
                      F.lit(f).alias("target_column"), F.lit("trim_whitespace").alias("operation"), F.lit(0.95).alias("confidence"))
             for i, (c, f) in enumerate(RAW_FIELDS.items())]
    items += [F.struct(F.lit(100 + i).alias("rec_order"), F.lit("standardisation").alias("action_type"), F.lit(f).alias("source_column"),
                       F.lit(f).alias("target_column"), F.lit(op).alias("operation"), F.lit(0.9).alias("confidence")) for i, (f, op) in enumerate(STEPS)]
    sheets = schedule_columns(spark, sf).select(*KEYS).distinct()
    no_state = (F.col("sheet_name") == "2-HIGH") & (F.col("target_column") == "State")
    no_contents = (F.col("sheet_name") == "1-URGENT") & (F.col("operation") == "strip_currency") & (F.col("target_column") == "Contents")
    return sheets.select(*KEYS, F.inline(F.array(*items))).withColumn(
        "rec_id", F.concat(F.lit("R-"), F.col("rec_order").cast("string"))).withColumn(
        "status", F.when(no_state & (F.col("action_type") == "column_mapping"), "rejected").when(no_contents, "pending").otherwise("approved"))


def schedule_decisions(spark, sf):
    sheets = schedule_columns(spark, sf).select(*KEYS).distinct()
    named = sheets.where("file_id <> 'P'").select("file_id", F.concat(F.lit(" "), F.upper("sheet_name")).alias("sheet_name"))
    whole = sheets.where("file_id = 'P'").select("file_id").distinct().withColumn("sheet_name", F.lit(None).cast("string"))
    raw_decisions = named.unionByName(whole).withColumn("source_column", F.lit("date_raw")).withColumn(
        "decision", F.when(F.col("file_id") == "O", "__rejected__").otherwise("Occupancy")).withColumn("seq", F.lit(1))
    return t.scope_decisions(raw_decisions, sheets)


_sheets = "(select distinct o_orderstatus as file_id, o_orderpriority as sheet_name from orders)"
add("scoped_decisions", lambda spark, sf: schedule_decisions(spark, sf),
    f"select {K}, 'date_raw' as source_column, case when file_id = 'O' then '__rejected__' else 'Occupancy' end as decision, 1 as seq from {_sheets}")


def _text(num: str) -> str:
    """Text of a parsed number: "5.0" for whole values, shortest digits otherwise."""
    return f"(case when {num} = floor({num}) then concat(cast(cast({num} as bigint) as varchar), '.0') else cast({num} as varchar) end)"


_zip2 = f"cast({vl.ZIP_SQL} as varchar)"
_int = d.plain("storeys_raw", ",")
CLEAN = {
    "Building Value": _text(d.currency("building_raw")),
    "Contents": f"case when sheet_name = '1-URGENT' then contents_raw else {_text(d.currency('contents_raw'))} end",
    "Year Built": f"cast({vl.YEAR_SQL} as varchar)", "Fire Sprinklers (Y/N)": vl.SPRINKLER_SQL,
    "State": f"case when sheet_name <> '2-HIGH' then {vl.STATE_SQL} end", "Zip": _zip2,
    "Storeys": f"case when {_int} = floor({_int}) then cast(cast({_int} as bigint) as varchar) when {_int} is not null then storeys_raw end",
    "City": "regexp_replace(trim(city_raw), ' +', ' ', 'g')",
    "Occupancy": "case when file_id = 'O' then occupancy_raw else concat(occupancy_raw, ' ', date_raw) end",
}
_source = {f: c for c, f in RAW_FIELDS.items()}
CLEANED = f"(select {K}, row_idx, " + ", ".join(f'{CLEAN.get(f, _source[f])} as "{f}"' for f in TARGET_FIELDS) + f" from ({RAW_DUCK}))"


def cleaned(spark, sf):
    """Cleaned table and audit function of the dirty schedule."""
    return t.apply_approved(schedule_records(spark, sf), schedule_columns(spark, sf), schedule_recs(spark, sf),
                            schedule_decisions(spark, sf), STAMP)


add("cleaned_table", lambda spark, sf: cleaned(spark, sf)[0], f"select * from {CLEANED}")
# Changes per operation: before and after text of every step.
_year = f"cast({vl.YEAR_SQL} as varchar)"
# All cells are text: what becomes a number has changed in any spelling, fractions of to_int stay text.
_TEXT, _NUMBER = "before_v is distinct from after_v", "before_v is not null"
_STEP_SQL = [
    ("Building Value", "strip_currency", "building_raw", CLEAN["Building Value"], "true", _NUMBER),
    ("Contents", "strip_currency", "contents_raw", _text(d.currency("contents_raw")), "sheet_name <> '1-URGENT'", _NUMBER),
    ("Year Built", "to_year_int", "year_raw", _year, "true", _NUMBER),
    ("Fire Sprinklers (Y/N)", "normalize_sprinkler_code", "sprinkler_raw", vl.SPRINKLER_SQL, "true", _TEXT),
    ("State", "state_to_abbrev", "state_raw", vl.STATE_SQL, "sheet_name <> '2-HIGH'", _TEXT),
    ("Zip", "to_zip", "zip_raw", _zip2, "true", _NUMBER),
    ("Storeys", "to_int", "storeys_raw", CLEAN["Storeys"], "true", f"coalesce({_int} = floor({_int}), before_v is not null and after_v is null)"),
    ("Zip", "to_int", _zip2, _zip2, "true", _TEXT),
    ("City", "trim_whitespace", "city_raw", "trim(city_raw)", "true", _TEXT),
    ("City", "normalize_spaces", "trim(city_raw)", CLEAN["City"], "true", _TEXT),
]
_steps = " union all ".join(
    f"select {K}, row_idx, {100 + i} as rec_order, {d.quoted(f)} as target, {d.quoted(op)} as operation, before_v, after_v, {h} as hit "
    f"from (select *, {b} as before_v, {a} as after_v from r where {w})"
    for i, (f, op, b, a, w, h) in enumerate(_STEP_SQL))
CHANGES = f"""with r as materialized ({RAW_DUCK}), steps as materialized ({_steps}),
  totals as (select {K}, rec_order, target, operation, count(case when hit then 1 end) as n_changed,
      coalesce(min(case when hit then row_idx end), min(row_idx)) as row_idx from steps group by all),
  changes as (select {K}, rec_order, target, operation, n_changed, before_v as before_sample, after_v as after_sample
    from totals join steps using ({K}, rec_order, target, operation, row_idx))"""


def changes(spark, sf):
    recs, columns = schedule_recs(spark, sf), schedule_columns(spark, sf)
    found = settle(t.claim_targets(recs, columns))
    steps = settle(t.operation_steps(recs).join(found.select(*KEYS, "target"), [*KEYS, "target"], "left_semi"))
    plan = settle(t.cleaning_plan(found, steps))
    return t.change_counts(schedule_records(spark, sf), plan, steps, t.step_choices(steps))


add("change_counts",
    lambda spark, sf: changes(spark, sf).select(*KEYS, "target", "operation", "n_changed", "before_sample", "after_sample"),
    CHANGES + f" select {K}, target, operation, n_changed, before_sample, after_sample from changes")
AUDIT = CHANGES + f""", renames as ({" union all ".join(f"select {K}, {d.quoted(c)} as s, {d.quoted(f)} as t from {_sheets}" for c, f in RAW_FIELDS.items())}),
  audit as (
    select {K}, s as source_column, t as target_column, 'column_rename' as transformation_applied, concat('Column ''', s, '''') as before_value, concat('Column ''', t, '''') as after_value,
      0.95::double as confidence from renames where not (sheet_name = '2-HIGH' and t = 'State')
    union all select {K}, 'state_raw', '', 'column_rejected_dropped', 'Column ''state_raw''', 'Dropped (rejected by reviewer)', 1.0 from {_sheets} where sheet_name = '2-HIGH'
    union all select {K}, target, target, operation, concat(coalesce(before_sample, '<NA>'), ' (sample; ', n_changed, ' rows changed)'), coalesce(after_sample, '<NA>'), 0.9 from changes
    union all select {K}, 'date_raw', '', 'unclaimed_reject', 'Column ''date_raw''', 'Dropped (rejected by reviewer)', 1.0 from {_sheets} where file_id = 'O'
    union all select {K}, 'date_raw', 'Occupancy', 'unclaimed_manual_assign', 'Unmapped column(s): date_raw', 'Merged into ''Occupancy'' (space-separated)', 1.0 from {_sheets} where file_id <> 'O')"""
_AUDITED = ["source_column", "target_column", "transformation_applied", "before_value", "after_value", "confidence"]
add("audit_trail", lambda spark, sf: cleaned(spark, sf)[1]().select(*KEYS, *_AUDITED), AUDIT + " select * from audit")
add("audit_export",
    lambda spark, sf: sinks.audit_export(cleaned(spark, sf)[1](), STAMP).drop("Entry ID", "Recommendation ID"),
    AUDIT + f""" select source_column as "Source Column", target_column as "Target Column", transformation_applied as "Transformation Applied", before_value as "Before Value",
      after_value as "After Value", case confidence when 1 then '1.0' else confidence::varchar end as "Confidence", 'human' as "Approved By", '{STAMP}' as "Timestamp", '' as "Row Index" from audit""")
add("refused_operations",
    lambda spark, sf: t.refused_operations(rv.recs(spark, sf)).select(*KEYS, "rec_id", "operation"),
    f"""select {K}, rec_id, operation from ({rv.RECS_DUCK})
      where action_type in ('standardisation', 'data_correction') and status = 'approved' and operation = 'drop_table'""")


add("preview",
    lambda spark, sf: t.preview(schedule_records(spark, sf), schedule_columns(spark, sf), schedule_recs(spark, sf)),
    f"""select * exclude (k) replace (case when length("Occupancy") > 9 then split_part("Occupancy", ' ', 1) else "Occupancy" end as "Occupancy") from (
      select *, row_number() over (partition by {K} order by row_idx) as k from {CLEANED}) where k <= 15""")

# Sheets of which nothing is approved are shown too, with empty fields.
add("preview_nothing_approved",
    lambda spark, sf: t.preview(schedule_records(spark, sf), schedule_columns(spark, sf), schedule_recs(spark, sf).withColumn("status", F.lit("pending"))),
    f"""select {K}, row_idx, {", ".join(f'cast(null as varchar) as "{f}"' for f in TARGET_FIELDS)} from (
      select {K}, row_idx, row_number() over (partition by {K} order by row_idx) as k from ({RAW_DUCK})) where k <= 15""")

# --- validation ---------------------------------------------------------------------------
_n = {f: d.plain(f'"{f}"', "") for f in MONETARY_FIELDS + INTEGER_FIELDS}
_bad = {f: (f'"{f}" is not null and ({_n[f]} is null or {_n[f]} <> floor({_n[f]}))' if f in INTEGER_FIELDS else f'"{f}" is not null and {_n[f]} is null') for f in _n}


def _typed_sql(f: str) -> str:
    if TARGET_DTYPES[f] == "str":
        return f'"{f}"'
    if TARGET_DTYPES[f] == "float":
        return f'{_n[f]} as "{f}"'
    return f'case when {_n[f]} = floor({_n[f]}) then cast({_n[f]} as int) end as "{f}"'


add("enforced_columns",
    lambda spark, sf: v.enforce_columns(mapped(spark, sf).drop("City", "Other").withColumn("Extra", F.lit(1)), ["row_idx"]),
    "select row_idx, " + ", ".join(f'null as "{f}"' if f in ("City", "Other") else f'"{f}"' for f in TARGET_FIELDS) + f" from ({MAPPED_DUCK})")
add("typed_table", lambda spark, sf: v.typed_table(mapped(spark, sf)),
    f"select {K}, row_idx, " + ", ".join(_typed_sql(f) for f in TARGET_FIELDS) + f" from ({MAPPED_DUCK})")
_lost = " union all ".join(f'select {K}, row_idx, {d.quoted(f)} as field, "{f}" as value from m where {b}' for f, b in _bad.items())
add("nonconforming_cells", lambda spark, sf: v.nonconforming(mapped(spark, sf)), f"with m as materialized ({MAPPED_DUCK}) {_lost}")
ERRORS = f"""with m as materialized ({MAPPED_DUCK}), bad as ({_lost}),
  errors as (select {K}, field, case when field in {d.in_list(INTEGER_FIELDS)} then 'integer' else 'numeric' end as kind, count(*) as n_bad, arg_min(value, row_idx) as example from bad group by all),
  told as (select *, concat(field, ': ', n_bad, ' non-', kind, ' value(s), e.g. ''', example, '''') as message, list_position([{', '.join(d.quoted(f) for f in TARGET_FIELDS)}], field) as pos from errors)"""
# Column lists as if they were outputs: every user's events name fields in the order of first use.
SHEET_COLUMNS = f"select concat('sheet ', cast(user_id as string)) as sheet_name, {_pick('event_id', [*TARGET_FIELDS, 'Notes'])} as field, min(event_id) as pos from {{events}} group by 1, 2"


def schema_checks(spark, sf):
    """Schema messages per sheet."""
    lists = spark_sql(spark, sf, SHEET_COLUMNS).groupBy("sheet_name").agg(F.array_sort(F.collect_list(F.struct("pos", "field")))["field"].alias("columns"))
    return v.schema_check(lists).select("sheet_name", F.array_join("errors", "|").alias("errors"))


_fields = "[" + ", ".join(d.quoted(f) for f in TARGET_FIELDS) + "]"
_shown = lambda x: f"concat('[', array_to_string(list_transform({x}, lambda c: concat(chr(39), c, chr(39))), ', '), ']')"
add("schema_errors", schema_checks,
    f"""with l as (select sheet_name, list(field order by pos, field) as columns from ({duck_sql(SHEET_COLUMNS)}) group by 1),
      e as (select sheet_name, columns, list_filter({_fields}, lambda f: not list_contains(columns, f)) as missing, list_filter(columns, lambda c: not list_contains({_fields}, c)) as extra from l)
      select sheet_name, concat_ws('|', case when len(columns) <> 17 then concat('Expected 17 columns, got ', len(columns), ': ', {_shown('columns')}) end,
        case when len(missing) > 0 then concat('Missing columns: ', {_shown('missing')}) end, case when len(extra) > 0 then concat('Extra columns: ', {_shown('extra')}) end,
        case when len(missing) = 0 and len(extra) = 0 and columns <> {_fields} then concat('Columns in wrong order. Expected: ', {_shown(_fields)}) end) as errors from e""")
add("conformance_errors",
    lambda spark, sf: v.conformance_errors(mapped(spark, sf)).select(*KEYS, "field", "n_bad", "example", "message"),
    ERRORS + f" select {K}, field, n_bad, example, message from told")
add("validation_rollup",
    lambda spark, sf: v.validation_rollup(v.conformance_errors(mapped(spark, sf)), mapped(spark, sf).select(*KEYS).distinct()).withColumn(
        "errors", F.array_join("errors", "|")),
    ERRORS + """ select file_id, count(distinct sheet_name) as n_sheets, false as passed,
      string_agg(concat('[', sheet_name, '] ', message), '|' order by sheet_name, pos) as errors from told group by all""")
_report = " union all ".join(
    f"""select {K}, {i + 1} as position, {d.quoted(f)} as field, {d.quoted(TARGET_DTYPES[f])} as expected_type, case when count("{f}") = 0 then 'Empty' """
    + (f"""when count(case when "{f}" is not null and {_n[f]} is null then 1 end) > 0 then concat(count(case when "{f}" is not null and {_n[f]} is null then 1 end), ' non-numeric') """ if f in _n else "")
    + (f"""when count(case when {_n[f]} <> floor({_n[f]}) then 1 end) > 0 then concat(count(case when {_n[f]} <> floor({_n[f]}) then 1 end), ' non-integer') """ if f in INTEGER_FIELDS else "")
    + "else 'OK' end as values from m group by all" for i, f in enumerate(TARGET_FIELDS)).replace("as values", 'as "values"')
add("conformance_report", lambda spark, sf: v.conformance_report(mapped(spark, sf)), f"with m as materialized ({MAPPED_DUCK}) {_report}")
