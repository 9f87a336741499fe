"""Queries over the value operations (G1-G15) and text helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from schedulesmith.functions import ops, text
from schedulesmith.functions.sql import register_operations
from schedulesmith.operators import validate as v
from schedulesmith.schema import SPRINKLER_ALIASES, SPRINKLER_CODES, STATE_CODES, STATE_NAMES
from schedulesmith.sources.files import gate_files

from . import duck as d
from .inputs import RAW_DUCK, raw, table

Q, SQL = {}, {}


def add(name, fn, sql=None):
    Q[name] = fn
    if sql:
        SQL[name] = sql


def _over_raw(fn, column):
    return lambda spark, sf: raw(spark, sf).select("row_idx", fn(F.col(column)).alias("v"))


def _raw(expr):
    return f"select row_idx, {expr} as v from ({RAW_DUCK})"


add("value_strip_currency", _over_raw(ops.strip_currency, "building_raw"), _raw(d.currency("building_raw")))
add("value_to_float", _over_raw(ops.to_float, "contents_raw"), _raw(d.plain("contents_raw")))
_i = d.plain("storeys_raw", ",")
add("value_to_int", _over_raw(ops.to_int, "storeys_raw"),
    _raw(f"case when {_i} = floor({_i}) then cast(cast(floor({_i}) as bigint) as varchar) when {_i} is not null then storeys_raw end"))
add("value_to_str", _over_raw(ops.to_str, "county_raw"), _raw("nullif(trim(county_raw), '')"))
add("value_trim_whitespace", _over_raw(ops.trim_whitespace, "city_raw"), _raw("trim(city_raw)"))
add("value_flag_for_review", _over_raw(ops.flag_for_review, "city_raw"), _raw("city_raw"))
add("value_normalize_spaces",
    lambda spark, sf: table(spark, sf, "documents").select("doc_id", ops.normalize_spaces(F.col("text")).alias("v")),
    r"select doc_id, regexp_replace(regexp_replace(text, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g'), '[\s\x{a0}]+', ' ', 'g') as v from documents")
_codes, _s = d.in_list(STATE_CODES), "trim(state_raw)"
_c = rf"upper(regexp_replace({_s}, '[\s.]', '', 'g'))"
_names = "case lower({s}) " + " ".join(f"when {d.quoted(k)} then {d.quoted(c)}" for k, c in STATE_NAMES.items()) + " end"
STATE_SQL = f"case when upper({_s}) in {_codes} then upper({_s}) when {_c} in {_codes} then {_c} else coalesce({_names.format(s=_s)}, {_s}) end"
add("value_state_to_abbrev", _over_raw(ops.state_to_abbrev, "state_raw"), _raw(STATE_SQL))
_p = "trim(sprinkler_raw)"
_alias = "case lower({s}) " + " ".join(f"when {d.quoted(k)} then {d.quoted(c)}" for k, c in SPRINKLER_ALIASES.items()) + " end"
SPRINKLER_SQL = f"case when upper({_p}) in {d.in_list(SPRINKLER_CODES)} then upper({_p}) else coalesce({_alias.format(s=_p)}, {_p}) end"
add("value_normalize_sprinkler_code", _over_raw(ops.normalize_sprinkler_code, "sprinkler_raw"), _raw(SPRINKLER_SQL))
add("value_normalize_date", _over_raw(ops.normalize_date, "date_raw"), _raw(
    "coalesce(strftime(coalesce("
    r"case when regexp_matches(date_raw, '^\d{4}-\d{1,2}-\d{1,2}$') then try_strptime(date_raw, '%Y-%m-%d') end, "
    "try_strptime(date_raw, '%m/%d/%Y'), try_strptime(date_raw, '%m-%d-%Y'), try_strptime(date_raw, '%d/%m/%Y'), "
    r"case when regexp_matches(date_raw, '^\d{8}$') then try_strptime(date_raw, '%Y%m%d') end), '%Y-%m-%d'), date_raw)"))
YEAR_SQL = r"cast(nullif(regexp_extract(trim(year_raw), '\b(1[7-9]\d{2}|20[0-2]\d)\b', 1), '') as int)"
add("value_to_year_int", _over_raw(ops.to_year_int, "year_raw"), _raw(YEAR_SQL))
_z = r"regexp_replace(split_part(split_part(trim(zip_raw), '-', 1), '.', 1), '\D', '', 'g')"
ZIP_SQL = f"case when length({_z}) >= 5 then cast(substr({_z}, 1, 5) as int) when length({_z}) >= 3 then cast({_z} as int) end"
add("value_to_zip", _over_raw(ops.to_zip, "zip_raw"), _raw(ZIP_SQL))
add("value_fold_operations",
    lambda spark, sf: raw(spark, sf).select(
        "row_idx", ops.apply_operations(["to_year_int", "to_int"], F.col("year_raw")).alias("year"),
        ops.apply_operations(["normalize_spaces", "state_to_abbrev"], F.col("city_raw")).alias("city")),
    f"select row_idx, cast({YEAR_SQL} as varchar) as year, case trim(city_raw) when 'New York' then 'NY' else regexp_replace(trim(city_raw), ' +', ' ', 'g') end as city from ({RAW_DUCK})")
# The twelve operations, called by name from SQL.
_CALLS = {
    "strip_currency": "building_raw", "to_float": "contents_raw", "to_int": "storeys_raw", "to_str": "county_raw", "trim_whitespace": "city_raw", "flag_for_review": "bi_raw",
    "normalize_spaces": "address_raw", "state_to_abbrev": "state_raw", "normalize_sprinkler_code": "sprinkler_raw", "normalize_date": "date_raw", "to_year_int": "year_raw", "to_zip": "zip_raw"}


def sql_operations(spark, sf):
    register_operations(spark)
    return spark.sql("select row_idx, " + ", ".join(f"{f}({c}) as {f}" for f, c in _CALLS.items()) + " from {raw}", raw=raw(spark, sf))


_same = {f: SQL[f"value_{f}"].partition("row_idx, ")[2].rpartition(" as v from (")[0] for f in _CALLS if f not in ("normalize_spaces", "flag_for_review")}
add("sql_operations", sql_operations, "select row_idx, bi_raw as flag_for_review, regexp_replace(trim(address_raw), ' +', ' ', 'g') as normalize_spaces, "
    + ", ".join(f"{x} as {f}" for f, x in _same.items()) + f" from ({RAW_DUCK})")
_m = r"regexp_replace(regexp_replace(regexp_replace(text, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g'), '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+', '<email>', 'g'), '\p{Nd}', '9', 'g')"
add("value_mask",
    lambda spark, sf: table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", ops.mask_value(F.col("text")).alias("v")),
    f"select conv_id, turn, role, case when length(m) > 32 then concat(substr(m, 1, 32), '…') else m end as v from (select *, {_m} as m from conversations)")
add("looks_numeric", _over_raw(text.looks_numeric, "bi_raw"), _raw(d.looks_numeric("bi_raw")))
add("zip_display", lambda spark, sf: raw(spark, sf).select("row_idx", v.zip_display(ops.to_zip(F.col("zip_raw"))).alias("v")),
    f"select row_idx, case when z is not null then lpad(cast(z as varchar), 5, '0') end as v from (select row_idx, {ZIP_SQL} as z from ({RAW_DUCK}))")
add("file_safe_sheet_name",
    lambda spark, sf: table(spark, sf, "orders").select(
        "o_orderkey", text.file_safe_name(F.concat(F.lit(" "), "o_orderpriority", F.lit(" / "), "o_orderstatus", F.lit("?"))).alias("v")),
    r"select o_orderkey, trim(regexp_replace(trim(concat(' ', o_orderpriority, ' / ', o_orderstatus, '?')), '[^\p{L}\p{N}_\-.]+', '_', 'g'), '_') as v from orders")
_ext = r"lower(regexp_extract(path, '\.([^./\\]+)$', 1))"
add("file_gate",
    lambda spark, sf: gate_files(table(spark, sf, "pages").select(
        "page_id", F.concat("url", F.element_at(F.array(*[F.lit(x) for x in (".csv", ".XLSX", ".pdf", "")]),
                                                 (F.col("page_id") % 4 + 1).cast("int"))).alias("path")))
    .select("page_id", "extension", "error"),
    f"""select page_id, {_ext} as extension,
      case when {_ext} not in ('xlsx', 'xls', 'csv') then concat('Unsupported file type ''.', {_ext}, '''. Please upload .xlsx or .csv files.') end as error
      from (select page_id, concat(url, list_value('.csv', '.XLSX', '.pdf', '')[cast(page_id % 4 + 1 as int)]) as path from pages)""")
add("header_forms",
    lambda spark, sf: table(spark, sf, "documents").select(
        "doc_id", text.normalize_header(F.col("source")).alias("matching_form"),
        text.normalize_memory_header(F.concat("source", F.lit(" #1/a&b."), "lang")).alias("memory_form")),
    f"select doc_id, {d.normalize('source')} as matching_form, {d.normalize_memory(chr(39).join(['concat(source, ', ' #1/a&b.', ', lang)']))} as memory_form from documents")
