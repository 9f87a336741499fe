"""Queries over structure recovery (R1-R24, S5, S6) on whole sheets built from the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from schedulesmith.operators import structure as s
from schedulesmith.operators import transform as t
from schedulesmith.schema import KEYS, TARGET_FIELDS, TOTAL_WORDS
from schedulesmith.session import settle, store

from . import duck as d
from .inputs import MAPPED_DUCK, RAW_DUCK, ROWS_DUCK, duck_sql, mapped, raw, rows, spark_sql

Q, SQL = {}, {}


def add(name, fn, sql=None):
    Q[name] = fn
    if sql:
        SQL[name] = sql


def sheets(spark, sf):
    return s.nullify_blanks(rows(spark, sf))


def headers(spark, sf, settled=True):
    data = sheets(spark, sf)
    found = s.detect_headers(data, s.sheet_dims(data))
    return settle(found) if settled else found


def stored(spark, sf):
    """Sheets stored once with their header rows, for queries that read them repeatedly."""
    data = store(sheets(spark, sf))
    return data, settle(s.detect_headers(data, s.sheet_dims(data)))


K = "file_id, sheet_name"


def _base(scorer=s.SCORER) -> str:
    both = scorer["blank_rows_score"]
    known = d.in_list(s._known_headers(scorer["separators"], both))
    sep = scorer["separators"].replace("(?U)", "")
    hit = f"trim(regexp_replace(lower(value), '{sep}', ' ', 'g')) in {known}"
    if both:
        hit = f"({hit} or lower(value) in {known})"
    m, x, f, b = scorer["weights"]
    return f"""with sheet_rows as materialized ({ROWS_DUCK}),
      cells as materialized (select {K}, row_idx, col_idx, nullif(value, '') as value from (
        select {K}, row_idx, unnest(cells) as value, generate_subscripts(cells, 1) - 1 as col_idx from sheet_rows)),
      dims as (select {K}, max(row_idx) + 1 as n_rows, max(len(cells)) as n_cols from sheet_rows group by all),
      stats as (select {K}, row_idx, count(value) as n_cells,
        count(case when value is not null and not {d.looks_numeric('value')} then 1 end) as n_text,
        count(case when {hit} then 1 end) as field_matches,
        count(case when {d.looks_numeric('value')} then 1 end) as n_numeric
        from cells where row_idx <= 30 group by all),
      below as (select *, case when lead(row_idx) over w = row_idx + 1
          then lead(n_numeric / greatest(n_cells, 1)) over w else 0.0::double end as numeric_below
        from stats window w as (partition by {K} order by row_idx)),
      scores as (select {K}, row_idx, n_cells, n_text, field_matches, numeric_below,
          {m}::double * (field_matches / n_cells) + {x}::double * (n_text / n_cells) + {f}::double * (n_cells / n_cols)
          + {b}::double * numeric_below as score
        from below join dims using ({K}) where row_idx < 30 and n_cells > 0),
      headers as (select {K}, n_rows, n_cols, row_idx as header_row, score as header_score, field_matches
        from scores join dims using ({K})
        qualify row_number() over (partition by {K} order by score desc, row_idx) = 1)"""


BASE = _base()
_profile = f"""profile as (select {K}, max(n_rows)::bigint as row_count, max(n_cols)::int as col_count,
    round_even(count(value) / max(n_rows * n_cols), 4) as non_null_ratio,
    coalesce(round_even(count(case when trim(value) <> '' and not {d.looks_numeric('value')} then 1 end)
      / nullif(count(case when trim(value) <> '' then 1 end), 0), 4), 0) as text_density,
    coalesce(round_even(count(case when {d.looks_numeric('value')} then 1 end)
      / nullif(count(case when trim(value) <> '' then 1 end), 0), 4), 0) as numeric_density,
    max(n_rows) - count(distinct case when value is not null then row_idx end) as blank_row_count
  from cells join dims using ({K}) group by all)"""
_steady = f"""consistency as (select {K}, coalesce(sum(case when ratio > 0.8 or ratio < 0.2 then 1 else 0 end) / max(n_cols), 0.0) as type_consistency
    from headers left join (select {K}, col_idx, avg(case when {d.looks_numeric('value')} then 1 else 0 end) as ratio
      from cells join headers using ({K}) where value is not null and row_idx > header_row
      group by all) using ({K}) group by all)"""
_continuity = f"""continuity as (select {K}, coalesce(count(distinct case when value is not null then row_idx end)
      / nullif(max(n_rows - header_row - 1), 0), 0.0) as data_continuity
    from headers left join (select * from cells) c using ({K})
    where row_idx is null or row_idx > header_row group by all)"""
_scored = f"""{_profile}, {_steady}, {_continuity},
  composite as (select {K}, headers.*, non_null_ratio, type_consistency, data_continuity,
      least(1.0::double, field_matches / 17::double * 3) as header_match, n_rows - header_row - 1 as rows_below,
      0.35::double * least(1.0::double, field_matches / 17::double * 3) + 0.25::double * non_null_ratio
      + 0.20::double * type_consistency + 0.20::double * least(1.0::double, (n_rows - header_row - 1) / 100.0::double) as composite
    from headers join profile using ({K}) join consistency using ({K}) left join continuity using ({K})),
  classified as (select *, case when composite >= 0.45 and field_matches >= 3 then 'Primary'
      when composite >= 0.25 or field_matches >= 1 then 'Secondary' else 'Reject' end as classification from composite),
  ranked as (select *, row_number() over (partition by file_id order by
      case classification when 'Primary' then 0 when 'Secondary' then 1 else 2 end, printf('%.4f', composite)::double desc, sheet_name) as sheet_rank
    from classified)"""

add("sheet_dims", lambda spark, sf: s.sheet_dims(sheets(spark, sf)),
    BASE + f" select {K}, n_rows, n_cols::int as n_cols from dims")
add("header_scores",
    lambda spark, sf: s.header_scores(sheets(spark, sf), s.sheet_dims(sheets(spark, sf))),
    BASE + f" select {K}, row_idx, n_cells::int as n_cells, n_text::int as n_text, field_matches::int as field_matches, numeric_below, score from scores")
add("header_scores_alternative",
    lambda spark, sf: s.header_scores(sheets(spark, sf), s.sheet_dims(sheets(spark, sf)), scorer=s.ALTERNATIVE_SCORER),
    _base(s.ALTERNATIVE_SCORER) + f" select {K}, row_idx, n_cells::int as n_cells, n_text::int as n_text, field_matches::int as field_matches, numeric_below, score from scores")
add("header_rows", lambda spark, sf: headers(spark, sf, settled=False),
    BASE + f" select {K}, n_rows, n_cols::int as n_cols, header_row, header_score, field_matches::int as field_matches from headers")
add("sheet_profile", lambda spark, sf: s.sheet_profile(sheets(spark, sf)),
    BASE + ", " + _profile + " select * from profile")
add("type_consistency", lambda spark, sf: s.type_consistency(*stored(spark, sf)),
    BASE + ", " + _steady + " select * from consistency")
add("data_continuity", lambda spark, sf: s.data_continuity(*stored(spark, sf)),
    BASE + ", " + _continuity + " select * from continuity")


def scored(spark, sf):
    return s.score_sheets(*stored(spark, sf))


add("sheet_scores",
    lambda spark, sf: scored(spark, sf).select(*KEYS, F.round("composite", 9).alias("composite"), "classification"),
    BASE + ", " + _scored + f" select {K}, round(composite, 9) as composite, classification from classified")
add("sheet_reasoning",
    lambda spark, sf: scored(spark, sf).select(
        *KEYS, F.array_join("reasoning", "|").alias("reasoning"), F.array_join("issues", "|").alias("issues")),
    BASE + ", " + _scored + f""" select {K}, concat('Header row detected at row ', header_row, ' (0-indexed).|Synonym field matches: ', field_matches,
      ' out of 17 target fields.|', printf('Header match score: %.2f, Data density: %.2f.', header_match, non_null_ratio),
      printf('|Type consistency: %.2f, Data continuity: %.2f.|', type_consistency, data_continuity),
      'Data rows below header: ', rows_below, '.|', printf('Composite score: %.3f → ', composite), classification, '.') as reasoning,
      concat_ws('|', case when field_matches < 2 then concat('Very few SOV field matches (', field_matches, ') — may not be a SOV sheet.') end,
        case when rows_below < 5 then 'Fewer than 5 data rows below the detected header.' end) as issues from classified""")
add("sheet_ranking",
    lambda spark, sf: s.rank_sheets(scored(spark, sf)).select(*KEYS, "sheet_rank", "classification", "is_primary", "is_data"),
    BASE + ", " + _scored + f" select {K}, sheet_rank::int as sheet_rank, classification, sheet_rank = 1 as is_primary, sheet_rank = 1 or classification = 'Primary' as is_data from ranked")


def ranges(spark, sf):
    """Merged ranges: every 50th order starts a block of three schedule lines sharing a city."""
    return spark_sql(spark, sf, RANGES)


RANGES = """select o_orderstatus as file_id, o_orderpriority as sheet_name, cast(4 + 3 * o_orderkey as bigint) as min_row,
  cast(11 + 3 * o_orderkey as bigint) as max_row, 2 as min_col, case when o_orderkey % 100 = 0 then 2 else 30 end as max_col
  from {orders} where o_orderkey % 50 = 0"""
_ranges = RANGES.replace("{", "").replace("}", "")

add("sheet_manifest",
    lambda spark, sf: s.sheet_manifest(s.rank_sheets(s.score_sheets(*stored(spark, sf), ranges(spark, sf))))
    .drop("sheet_rank", "confidence").withColumn("non_null_ratio", F.round("non_null_ratio", 4)),
    BASE + ", " + _scored + f""" select {K}, classification, header_row, greatest(0, rows_below) as data_rows, field_matches::int as field_matches,
      round(non_null_ratio, 4) as non_null_ratio, coalesce(n, 0) as merged_cell_count
      from ranked left join (select {K}, count(*) as n from ({_ranges}) group by all) using ({K})""")
add("merged_range_names", lambda spark, sf: s.merged_range_names(ranges(spark, sf)),
    f"select {K}, concat('C', min_row + 1, ':', case max_col when 2 then 'C' else 'AE' end, max_row + 1) as range_name from ({_ranges})")
add("fill_down",
    lambda spark, sf: s.rows_to_cells(s.fill_down(sheets(spark, sf), ranges(spark, sf))).drop("cell_type"),
    f"""with sheet_rows as materialized ({ROWS_DUCK}), r as ({_ranges}),
      corner as materialized (select r.*, nullif(s.cells[3], '') as value from r join sheet_rows s on s.file_id = r.file_id and s.sheet_name = r.sheet_name and s.row_idx = r.min_row),
      fills as materialized (select file_id, sheet_name, unnest(range(min_row, max_row + 1)) as row_idx, value from corner),
      cells as (select {K}, row_idx, unnest(cells) as value, generate_subscripts(cells, 1) - 1 as col_idx from sheet_rows)
      select {K}, row_idx, col_idx::int as col_idx, value from (
        select {K}, row_idx, 2 as col_idx, value from fills
        union all select {K}, row_idx, col_idx, nullif(value, '') from cells where col_idx <> 2
        union all select {K}, row_idx, col_idx, nullif(value, '') from cells anti join fills using ({K}, row_idx) where col_idx = 2)
      where value is not null""")
add("header_names", lambda spark, sf: s.header_names(*stored(spark, sf)),
    BASE + f""", slots as (select {K}, header_row, unnest(range(n_cols)) as col_idx from headers),
      raw_names as (select slots.{K.split(', ')[0]}, slots.sheet_name, slots.col_idx, trim(regexp_replace(value, '[\\r\\n\\t]+', ' ', 'g')) as n
        from slots left join cells c on c.file_id = slots.file_id and c.sheet_name = slots.sheet_name and c.row_idx = header_row and c.col_idx = slots.col_idx),
      named as (select {K}, col_idx, case when n is null or n = '' or lower(n) = 'nan' or lower(n) like 'unnamed:%' then concat('_col_', col_idx) else n end as n from raw_names),
      numbered as (select *, row_number() over (partition by {K}, n order by col_idx) - 1 as k from named)
      select {K}, col_idx::int as col_idx, case when k > 0 then concat(n, ' (', k, ')') else n end as source_column from numbered""")
# The same sheets under a banner of forty rows: the header is found below row 30 when the search reaches it.
def deep_header_names(spark, sf):
    data = store(sheets(spark, sf).where("sheet_name <> 'Summary'").withColumn("row_idx", F.col("row_idx") + 40))
    return s.header_names(data, settle(s.detect_headers(data, s.sheet_dims(data), max_rows=60)))


add("deep_header_names", deep_header_names, "select * from (" + SQL["header_names"] + ") where sheet_name <> 'Summary'")
# One column that turns from numbers to text after the two hundredth order, and one that stays text.
LATE = """select o_orderstatus as file_id, o_orderpriority as sheet_name, cast(row_number() over (partition by o_orderstatus, o_orderpriority order by o_orderkey) as bigint) as row_idx,
  concat('clerk ', cast(o_custkey as string)) as clerk, case when row_number() over (partition by o_orderstatus, o_orderpriority order by o_orderkey) <= 200 then '100' else 'open' end as amount from {orders}"""


def late_change(spark, sf):
    data = store(spark_sql(spark, sf, LATE).select(*KEYS, "row_idx", F.array("clerk", "amount").alias("values"), F.lit(None).cast("array<string>").alias("types")))
    heads = s.sheet_dims(data).withColumns({"header_row": F.lit(0), "field_matches": F.lit(0)})
    first = s.type_consistency(data, heads, sample_rows=200).withColumnRenamed("type_consistency", "first_rows")
    return s.type_consistency(data, heads).join(first, KEYS)


add("late_type_change", late_change,
    f"""with r as ({duck_sql(LATE)}), n as (select {K}, avg(case when amount = '100' then 1 else 0 end) as share from r group by all)
      select {K}, case when share > 0.8 or share < 0.2 then 1.0::double else 0.5::double end as type_consistency, 1.0::double as first_rows from n""")
_kept = f"""kept as (select c.file_id, c.sheet_name, c.row_idx from cells c join headers using ({K}) where c.row_idx > header_row
    group by all
    having count(value) > 0 and count(case when lower(trim(value)) in {d.in_list(TOTAL_WORDS)} then 1 end) = 0
      and count(case when trim(value) <> '' then 1 end) > 0
      and not (count(case when trim(value) <> '' then 1 end) = 1 and count(case when trim(value) <> '' and {d.looks_numeric('value')} then 1 end) = 0))"""


def records(spark, sf):
    return s.extract_records(*stored(spark, sf))


add("record_rows",
    lambda spark, sf: records(spark, sf).select(*KEYS, "row_idx", F.array_join("values", "|", "~").alias("cells")),
    BASE + ", " + _kept + f""" select {K}, row_idx, array_to_string(list_transform(cells, lambda x: coalesce(nullif(x, ''), '~')), '|') as cells
      from sheet_rows join kept using ({K}, row_idx)""")
add("record_positions",
    lambda spark, sf: s.reindex_rows(records(spark, sf), band=4096).select(*KEYS, "row_idx", F.col("data_idx").cast("bigint").alias("data_idx")),
    BASE + ", " + _kept + f" select {K}, row_idx, row_number() over (partition by {K} order by row_idx) - 1 as data_idx from kept")
add("cells_long", lambda spark, sf: s.rows_to_cells(sheets(spark, sf)),
    BASE + f" select {K}, row_idx, col_idx::int as col_idx, value, 's' as cell_type from cells where value is not null")
add("cells_to_rows",
    lambda spark, sf: s.cells_to_rows(s.rows_to_cells(sheets(spark, sf))).select(
        *KEYS, "row_idx", F.array_join("values", "|", "~").alias("cells")),
    BASE + f""" select {K}, row_idx, string_agg(coalesce(value, '~'), '|' order by col_idx) as cells
      from (select *, max(case when value is not null then col_idx end) over (partition by {K}, row_idx) as last from cells)
      where col_idx <= last group by all""")
add("column_lineage",
    lambda spark, sf: s.column_lineage(s.header_names(*stored(spark, sf))).select(
        "file_id", "source_column", F.array_join("sheets", "|").alias("sheets")),
    "select file_id, source_column, string_agg(sheet_name, '|' order by sheet_name) as sheets from (" + SQL["header_names"] + ") group by all")
add("concat_sheets",
    lambda spark, sf: s.concat_sheets([
        raw(spark, sf).where("file_id = 'F'").select(*KEYS, "row_idx", "ref_raw", "building_raw"),
        raw(spark, sf).where("file_id <> 'F'").select(*KEYS, "row_idx", "building_raw", "zip_raw")]),
    f"""select {K}, row_idx, ref_raw, building_raw, null as zip_raw from ({RAW_DUCK}) where file_id = 'F'
      union all select {K}, row_idx, null, building_raw, zip_raw from ({RAW_DUCK}) where file_id <> 'F'""")
# Sheets of 500 families of columns, each with columns of its own.
FAMILIES = """select 'orders' as file_id, concat('family ', cast(o_orderkey % 500 as string)) as sheet_name, o_orderkey as row_idx, cast(o_orderkey % 500 as int) as family,
  o_orderstatus as common, case when o_orderkey % 7 = 0 then null else cast(o_custkey as string) end as own, concat(o_orderpriority, ' "quoted" ', cast(o_custkey as string)) as shared from {orders}"""


def families(spark, sf):
    data = spark_sql(spark, sf, FAMILIES)
    rows = data.select(*KEYS, "row_idx", F.array("common", "own", "shared").alias("values"))
    own = F.array(F.lit("Common"), F.concat(F.lit("a"), "family"), F.concat(F.lit("b"), (F.col("family") % 50).cast("string")))
    names = data.select(*KEYS, "family").distinct().select(*KEYS, F.posexplode(own).alias("col_idx", "source_column"))
    wide = s.concat_records(rows, names)
    columns = [F.col(f"`{c}`") for c in wide.columns[3:]]
    return wide.select("sheet_name", "row_idx", F.lit(len(columns)).alias("n_columns"), F.to_json(F.struct(*columns)).alias("record"))


add("concat_families", families,
    f"""with f as materialized ({duck_sql(FAMILIES)}), n as (select 1 + count(distinct family) + count(distinct family % 50) as n_columns from f)
      select sheet_name, row_idx, n_columns::int as n_columns, concat('{{"Common":"', common, '"', case when own is not null then concat(',"a', family, '":"', own, '"') end,
        ',"b', family % 50, '":', to_json(shared), '}}') as record from f, n""")
# Long cells to one column per field and back.
add("wide_by_field", lambda spark, sf: s.wide_by_field(s.long_by_field(mapped(spark, sf), TARGET_FIELDS), TARGET_FIELDS), MAPPED_DUCK)
add("long_by_field",
    lambda spark, sf: s.long_by_field(s.wide_by_field(s.long_by_field(mapped(spark, sf), TARGET_FIELDS), TARGET_FIELDS), TARGET_FIELDS),
    f"select file_id, sheet_name, row_idx, target, value from (unpivot ({MAPPED_DUCK}) on " + ", ".join(f'"{f}"' for f in TARGET_FIELDS) + " into name target value value)")
add("coalesce_sources",
    lambda spark, sf: t.coalesce_sources(
        raw(spark, sf).select("row_idx", "building_raw", "contents_raw", "bi_raw", "city_raw"),
        {"Building Value": ["building_raw", "contents_raw", "bi_raw"], "City": ["city_raw"]}),
    f"""select row_idx, coalesce(building_raw, contents_raw, bi_raw) as "Building Value", city_raw as "City" from ({RAW_DUCK})""")
