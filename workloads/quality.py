"""Queries over the quality rules, completeness and scores (Q1-Q19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from schedulesmith.operators import quality as q
from schedulesmith.schema import INTEGER_FIELDS, KEYS, MONETARY_FIELDS, SPRINKLER_CODES, STATE_CODES, TARGET_FIELDS
from schedulesmith.session import settle

from . import duck as d
from .inputs import CURRENT_YEAR, MAPPED_DUCK, mapped, table

Q, SQL = {}, {}
K = "file_id, sheet_name"


def add(name, fn, sql=None):
    Q[name] = fn
    if sql:
        SQL[name] = sql


def _c(f):
    return f'"{f}"'


def _rules():
    """(order, type, severity, field, operation, confidence, lists rows, evidence, predicate)."""
    out = []
    for f in MONETARY_FIELDS:
        a = d.wrapped(_c(f))
        out += [("format", "medium", f, "strip_currency", 0.98, False, "rows contain currency symbols/commas.", f"regexp_matches({_c(f)}, '[$,]')"),
                ("logical_error", "high", f, "flag_for_review", 1.0, True, "rows have negative monetary values.", f"{a} < 0"),
                ("type_error", "medium", f, "flag_for_review", 1.0, True, "rows contain non-numeric values.", f"{_c(f)} is not null and {a} is null")]
    y = d.plain(_c("Year Built"), ",")
    out.append(("logical_error", "high", "Year Built", "to_year_int", 1.0, True, f"rows have invalid years (expected 1700–{CURRENT_YEAR}).",
                f"{_c('Year Built')} is not null and ({y} is null or trunc({y}) > {CURRENT_YEAR} or trunc({y}) < 1700)"))
    s, b = d.plain(_c("Storeys"), ","), d.plain(_c("Number of Buildings"), ",")
    out.append(("logical_error", "medium", "Storeys", "flag_for_review", 0.95, True, "rows have values < 1.", f'"Storeys" is not null and ({s} is null or {s} < 1)'))
    out.append(("logical_error", "medium", "Number of Buildings", "flag_for_review", 0.95, True, "rows have values < 1.", f"{b} < 1"))
    out.append(("format", "medium", "Fire Sprinklers (Y/N)", "normalize_sprinkler_code", 0.95, True, "rows have non-standard codes: ",
                f"upper(trim({_c('Fire Sprinklers (Y/N)')})) not in {d.in_list(SPRINKLER_CODES)}"))
    out.append(("format", "medium", "State", "state_to_abbrev", 0.90, True, "rows have non-standard values: ", f'upper(trim("State")) not in {d.in_list(STATE_CODES)}'))
    out.append(("duplicate", "high", "Reference", "flag_for_review", 1.0, True, "rows have duplicate IDs: ", "dup"))
    out.append(("format", "low", "Zip", "to_zip", 0.90, True, "rows have non-5-digit ZIP codes.",
                "length(regexp_replace(split_part(replace(trim(\"Zip\"), ',', ''), '.', 1), '\\D', '', 'g')) <> 5"))
    for f in INTEGER_FIELDS:
        i = d.plain(_c(f), ",")
        out.append(("type_error", "low", f, "to_int", 0.95, True, "rows have non-integer values.", f"{_c(f)} is not null and ({i} is null or {i} <> floor({i}))"))
    return [(len(TARGET_FIELDS) + n, *r) for n, r in enumerate(out)]


BASE = f"""with m as materialized (select *, "Reference" is not null and count("Reference") over (partition by {K}, "Reference") > 1 as dup from ({MAPPED_DUCK}))"""
_hits = " union all ".join(
    f"select {K}, row_idx, {o} as ord, {_c(f)} as value from m where {p}" for o, _, _, f, _, _, _, _, p in _rules())
_spec = d.values_table([(o, t, s, f, op, c, int(ls), e) for o, t, s, f, op, c, ls, e, _ in _rules()],
                       "ord, issue_type, severity, affected_field, suggested_operation, confidence, lists, words")
_missing = " union all ".join(
    f"""select {K}, {i} as ord, {d.quoted(f)} as affected_field, count(*) as n_rows,
      count(case when {_c(f)} is null or {_c(f)} = '' then 1 end) as missing from m group by all""" for i, f in enumerate(TARGET_FIELDS))
ISSUES = BASE + f""", hits as ({_hits}),
  ranked as (select *, row_number() over (partition by {K}, ord order by row_idx) as k from hits),
  counted as (select {K}, ord, count(*) as affected_row_count, max(case when k = 1 then value end) as before_example,
      string_agg(case when k <= 50 then cast(row_idx as varchar) end, ',' order by row_idx) as listed from ranked group by all),
  firsts as (select {K}, ord, trim(value) as value, min(row_idx) as first_at from hits group by all),
  named as (select {K}, ord, string_agg(value, ', ' order by first_at) as named from (
      select *, row_number() over (partition by {K}, ord order by first_at) as k from firsts) where k <= 5 group by all),
  missing as ({_missing}),
  issues as (
    select {K}, ord, 'completeness' as issue_type, case when missing / n_rows * 100 > 50 then 'high' when missing / n_rows * 100 > 20 then 'medium' else 'low' end as severity,
      affected_field, '' as affected_rows, missing as affected_row_count,
      concat(affected_field, ': ', missing, '/', n_rows, ' (', printf('%.1f', missing / n_rows * 100), '%) values are null/empty.') as evidence,
      '<null>' as before_example, 'flag_for_review' as suggested_operation, 1.0::double as confidence
    from missing where missing / n_rows * 100 > 5
    union all
    select {K}, ord, issue_type, severity, affected_field, case when lists = 1 then listed else '' end, affected_row_count,
      concat(affected_field, ': ', affected_row_count, ' ', words, case when words like '%: ' then concat(named, '.') else '' end),
      before_example, suggested_operation, confidence::double
    from counted join (select * from {_spec}) s using (ord) join named using ({K}, ord)),
  numbered as (select *, printf('QI-%04d', row_number() over (partition by {K} order by ord)) as issue_id from issues)"""


def issues(spark, sf):
    return q.detect_issues(mapped(spark, sf), CURRENT_YEAR)


def shown(df):
    return df.withColumn("affected_rows", F.array_join("affected_rows", ",")).drop("ord")


add("quality_issues", lambda spark, sf: shown(issues(spark, sf)),
    ISSUES + f" select {K}, issue_id, issue_type, severity, affected_field, affected_rows, affected_row_count, evidence, before_example, suggested_operation, confidence from numbered")
add("quality_rule_counts",
    lambda spark, sf: q.rule_counts(mapped(spark, sf), q.row_rules(CURRENT_YEAR)).drop(
        *[f"{p}_{i}" for i in range(17) for p in ("null", "blank")]),
    BASE + f" select {K}, count(*) as n_rows, " + ", ".join(
        f"count(case when {r[-1]} then 1 end) as rule_{i}" for i, r in enumerate(r for r in _rules() if r[1] != "duplicate"))
    + " from m group by all")
add("quality_duplicate_references", lambda spark, sf: q.duplicate_references(mapped(spark, sf)),
    BASE + f' select {K}, "Reference" as value, count(*) as n, min(row_idx) as first_row from m where dup group by all')
_complete = " union all ".join(
    f"select {K}, {i} as field_pos, {d.quoted(f)} as field, count({_c(f)}) / count(*) * 100 as completeness from m group by all"
    for i, f in enumerate(TARGET_FIELDS))
COMPLETE = f"complete as ({_complete})"
add("completeness", lambda spark, sf: q.completeness(mapped(spark, sf)),
    BASE + f", {COMPLETE} select {K}, field_pos, field, printf('%.2f', completeness)::double as completeness from complete")

# A mapping table per schedule: every field with a confidence, some fields without a source.
_one = """select file_id, sheet_name, {i} as col_idx, 'col {i}' as source_column,
  case when ({i} + length(sheet_name)) % 5 = 0 then null else {f} end as target,
  case when ({i} + length(sheet_name)) % 5 = 0 then cast(0.0 as double) else cast(0.5 as double) + {i} / cast(64.0 as double) end as confidence
  from (select distinct o_orderstatus as file_id, o_orderpriority as sheet_name from {{orders}})"""
MAPPING = " union all ".join(_one.format(i=i, f=d.quoted(f)) for i, f in enumerate(TARGET_FIELDS))
MAPPING_DUCK = MAPPING.replace("{", "").replace("}", "")


def mapping(spark, sf):
    pos, field = F.col("col_idx"), F.array(*[F.lit(f) for f in TARGET_FIELDS])
    none = (pos + F.length("sheet_name")) % 5 == 0
    return table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("file_id"), F.col("o_orderpriority").alias("sheet_name")).distinct().select(
        *KEYS, F.posexplode(field).alias("col_idx", "field")).select(
        *KEYS, "col_idx", F.concat(F.lit("col "), pos.cast("string")).alias("source_column"),
        F.when(~none, F.col("field")).alias("target"), F.when(none, 0.0).otherwise(0.5 + pos / 64.0).alias("confidence"))


def score(spark, sf):
    complete = q.completeness(mapped(spark, sf))
    found = mapping(spark, sf)
    return q.quality_score(found, found, complete, issues(spark, sf), digits=None)


SCORE = ISSUES + f""", {COMPLETE}, mapping as ({MAPPING_DUCK}),
  ms as (select {K}, count(target) / 17 * coalesce(avg(case when target is not null then confidence end), 0) as mapping_score from mapping group by all),
  cs as (select {K}, avg(printf('%.2f', completeness)::double) / 100 as completeness_score from complete group by all),
  pen as (select {K}, greatest(0, 1 - (0.20::double * count(case when severity = 'high' then 1 end) + 0.08::double * count(case when severity = 'medium' then 1 end)
      + 0.02::double * count(case when severity = 'low' then 1 end))) as anomaly_score from issues group by all),
  scored as (select *, 100 * (0.35::double * mapping_score + 0.30::double * completeness_score + 0.35::double * anomaly_score) as score
    from ms join cs using ({K}) join pen using ({K}))"""
add("quality_score",
    lambda spark, sf: score(spark, sf).select(*KEYS, F.round("score", 6).alias("score"), "grade", "label"),
    SCORE + f""" select {K}, round(score, 6) as score, case when score >= 80 then 'A' when score >= 65 then 'B' when score >= 50 then 'C' when score >= 35 then 'D' else 'F' end as grade,
      case when score >= 80 then 'Excellent' when score >= 65 then 'Good' when score >= 50 then 'Fair' when score >= 35 then 'Poor' else 'Critical' end as label from scored""")
add("quality_report_summary",
    lambda spark, sf: q.report_summary(issues(spark, sf), mapped(spark, sf).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_rows"))),
    ISSUES + f""" select {K}, total_rows, count(*) as n_issues, count(distinct affected_field) as n_fields, count(case when severity = 'high' then 1 end) as n_critical,
      concat(count(*), ' issues detected across ', count(distinct affected_field), ' fields.') as issue_summary
      from numbered join (select {K}, count(*) as total_rows from m group by all) using ({K}) group by all""")
add("completeness_status",
    lambda spark, sf: q.completeness_status(settle(q.completeness(mapped(spark, sf))), mapping(spark, sf)),
    BASE + f""", {COMPLETE}, mapping as ({MAPPING_DUCK}) select {K}, field, printf('%.2f', completeness)::double / 100 as completeness,
      case when t.target is not null then 'Mapped' else 'No source column' end as status
      from complete left join (select distinct {K}, target from mapping where target is not null) t on t.file_id = complete.file_id
        and t.sheet_name = complete.sheet_name and t.target = field""".replace(f"select {K}, field", "select complete.file_id, complete.sheet_name, field"))
add("issues_of_mapped_fields",
    lambda spark, sf: q.detect_issues(mapped(spark, sf), CURRENT_YEAR, mapping(spark, sf)).select(
        *KEYS, "issue_id", "issue_type", "affected_field", "affected_row_count"),
    ISSUES + f""" select {K}, printf('QI-%04d', row_number() over (partition by {K} order by ord)) as issue_id, issue_type, affected_field, affected_row_count
      from issues semi join (select {K}, target as affected_field from ({MAPPING_DUCK}) where target is not null) t using ({K}, affected_field)""")
