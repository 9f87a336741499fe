"""Queries over column profiles and value fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from schedulesmith.operators import mapping as m
from schedulesmith.operators import profile as p
from schedulesmith.schema import (
    INTEGER_FIELDS, KEYS, MONETARY_FIELDS, PLACE_FIELDS, SPRINKLER_LOOKALIKES, STATE_CODES, STREET_WORDS, TARGET_FIELDS,
)

from . import duck as d
from .inputs import CURRENT_YEAR, RAW_COLUMNS, RAW_DUCK, raw, table

Q, SQL = {}, {}
COL = [*KEYS, "col_idx"]
K = "file_id, sheet_name, col_idx"


def add(name, fn, sql=None):
    Q[name] = fn
    if sql:
        SQL[name] = sql


def values(spark, sf):
    """All raw columns of all sheets plus two columns of the part table, one value per row."""
    wide = raw(spark, sf).select(*KEYS, "row_idx", F.posexplode(F.array(*RAW_COLUMNS)).alias("col_idx", "value"))
    parts = table(spark, sf, "part").select(
        F.lit("parts").alias("file_id"), F.col("p_brand").alias("sheet_name"), F.col("p_partkey").alias("row_idx"),
        F.posexplode(F.array("p_name", F.col("p_size").cast("string"), F.lit(None).cast("string"))).alias("col_idx", "value"))
    return wide.unionByName(parts)


def profiles(spark, sf):
    return p.column_profiles(values(spark, sf), COL, CURRENT_YEAR)


_long = " union all ".join(
    f"select file_id, sheet_name, row_idx, {i} as col_idx, {c} as value from r" for i, c in enumerate(RAW_COLUMNS))
_parts = " union all ".join(
    f"select 'parts', p_brand, p_partkey, {i}, {c} from part" for i, c in enumerate(["p_name", "cast(p_size as varchar)", "cast(null as varchar)"]))
VALUES = f"with r as materialized ({RAW_DUCK}), vals as ({_long} union all {_parts}), clean as (select *, nullif(trim(value), '') as v from vals)"
_p = d.num("trim(replace(translate(v, '$,)', ''), '(', '-'))")
_st, _am = d.plain("v", ","), d.plain("v", ",$")
TESTS = {
    "currency_ratio": "regexp_matches(v, '[$,]')",
    "year_ratio": rf"regexp_matches(v, '^\d{{4}}$') and try_cast(v as int) between 1700 and {CURRENT_YEAR + 1}",
    "zip_ratio": r"regexp_matches(v, '^\d{5}(-\d{4}|\.0)?$')",
    "short_zip_ratio": r"regexp_matches(v, '^\d{3,4}(\.0)?$')",
    "state_ratio": rf"upper(regexp_replace(v, '[\s.]', '', 'g')) in {d.in_list(STATE_CODES)}",
    "sprinkler_ratio": f"upper(v) in {d.in_list(SPRINKLER_LOOKALIKES)}",
    "yn_ratio": "upper(v) in ('Y', 'N', 'YES', 'NO')",
    "storey_ratio": f"{_st} between 1 and 200 and {_st} = floor({_st})",
    "monetary_ratio": f"abs({_am}) >= 100",
    "address_ratio": rf"regexp_matches(v, '\d+\s+\w+') or list_has_any(regexp_split_to_array(lower(v), '\s+|,|\.'), [{', '.join(d.quoted(w) for w in STREET_WORDS)}])",
}
_ratios = ", ".join(f"count(case when {t} then 1 end) / nullif(count(v), 0) as {n}" for n, t in TESTS.items())
PROFILE = VALUES + f""", profiles as (select {K}, count(v) as n, count(v) = 0 as empty, count({_p}) / nullif(count(v), 0) as numeric_ratio,
    min({_p}) as min, max({_p}) as max, sum({_p}) / nullif(count({_p}), 0) as mean,
    coalesce(bool_and({_p} = floor({_p})), false) as all_integers, coalesce(bool_or({_p} < 0), false) as any_negative,
    sum(length(v)) / nullif(count(v), 0) as mean_length, max(length(v))::int as max_length,
    count(distinct v) / nullif(count(v), 0) as unique_ratio, {_ratios}
  from clean group by all)"""
add("column_profiles", lambda spark, sf: profiles(spark, sf).withColumn("mean", F.round("mean", 4)),
    PROFILE + " select * replace (round(mean, 4) as mean) from profiles")


# The same from states of four parts of every column, merged; beside it the whole column's state and the exact count.
def merged_profiles(spark, sf):
    cells = values(spark, sf)
    parts = p.profile_parts(cells.withColumn("part", F.pmod("row_idx", F.lit(4))), [*COL, "part"], CURRENT_YEAR)
    merged = p.finished_profiles(p.merge_profiles(parts, COL), COL)
    whole = p.finished_profiles(p.profile_parts(cells, COL, CURRENT_YEAR), COL).select(*COL, F.col("n_distinct").alias("whole"))
    exact = p.column_profiles(cells, COL, CURRENT_YEAR).select(*COL, F.coalesce(F.round(F.col("unique_ratio") * F.col("n")), F.lit(0)).cast("long").alias("exact"))
    near = lambda a, b: F.abs(a - b) <= F.col("n_distinct_error")
    return merged.join(whole, COL).join(exact, COL).withColumns(
        {"mean": F.round("mean", 4), "within_bound": near(F.col("n_distinct"), F.col("exact")), "parts_agree": near(F.col("n_distinct"), F.col("whole"))}).drop(
        "unique_ratio", "n_distinct", "n_distinct_error", "whole")


add("column_profiles_merged", merged_profiles,
    PROFILE + " select * exclude (unique_ratio) replace (round(mean, 4) as mean), coalesce(round(unique_ratio * n), 0)::bigint as exact, true as within_bound, true as parts_agree from profiles")


def _fit_sql(t: str) -> str:
    if t in MONETARY_FIELDS:
        return ("(monetary_ratio * 0.6::double + numeric_ratio * 0.4::double) * case when any_negative then 0.5::double else 1 end"
                " * case when year_ratio >= 0.9 then 0.2::double else 1 end")
    if t == "Year Built":
        return f"case when numeric_ratio > 0.8 and min >= 1700 and max <= {CURRENT_YEAR + 1} then least(1, year_ratio + 0.3::double) else year_ratio end"
    if t == "Zip":
        z = "greatest(zip_ratio, short_zip_ratio * 0.6::double)"
        return f"case when {z} > 0.5 then {z} else {z} * (1 - least(0.5::double, monetary_ratio)) end"
    if t == "State":
        return "state_ratio"
    if t == "Fire Sprinklers (Y/N)":
        return "least(1, sprinkler_ratio + yn_ratio * 0.3::double)"
    if t in ("Storeys", "Number of Buildings"):
        return "least(1, storey_ratio + case when numeric_ratio > 0.8 then 0.2::double else 0 end)"
    if t == "Reference":
        return "case when numeric_ratio > 0.8 and not all_integers then 0.2::double else 0.5::double + unique_ratio * 0.5::double end"
    if t == "Address":
        return "case when numeric_ratio < 0.2 then greatest(address_ratio, 0.3::double) else address_ratio end"
    text = "(1 - numeric_ratio) * 0.7::double + (1 - monetary_ratio) * 0.3::double"
    return f"case when numeric_ratio > 0.8 then 0 else {text} end" if t in PLACE_FIELDS else text


_fits = " union all ".join(
    f"select {K}, {i} as target_pos, {d.quoted(t)} as target, empty, case when empty then 0 else {_fit_sql(t)} end as fit from profiles"
    for i, t in enumerate(TARGET_FIELDS))
FITS = PROFILE + f", fits as ({_fits})"
add("value_fits",
    lambda spark, sf: p.profile_fits(profiles(spark, sf), COL, CURRENT_YEAR, digits=None).select(
        *COL, "target", F.round("fit", 8).alias("fit"), F.round("map_fit", 8).alias("map_fit")),
    FITS + f" select {K}, target, round(fit, 8) as fit, round(case when empty then 0.5 else fit end, 8) as map_fit from fits")
add("value_vetoes",
    lambda spark, sf: p.profile_fits(profiles(spark, sf), COL, CURRENT_YEAR).where("contradicts").select(*COL, "target"),
    FITS + f" select {K}, target from fits where not empty and printf('%.4f', fit)::double < 0.25")
add("plausible_targets",
    lambda spark, sf: m.shortlist(p.profile_fits(profiles(spark, sf), COL, CURRENT_YEAR)).select(*COL, "rank", "target"),
    FITS + f""" select {K}, rank::int as rank, target from (select *, row_number() over (partition by {K} order by printf('%.4f', fit)::double desc, target_pos) as rank
      from fits where printf('%.4f', fit)::double > 0.35) where rank <= 5""")


def _op_sql(t: str) -> str:
    if t in MONETARY_FIELDS:
        return "case when coalesce(currency_ratio, 0) > 0 then 'strip_currency' else 'to_float' end"
    special = {"Year Built": "to_year_int", "Zip": "to_zip", "State": "state_to_abbrev", "Fire Sprinklers (Y/N)": "normalize_sprinkler_code"}
    return d.quoted(special.get(t, "to_int" if t in INTEGER_FIELDS else "trim_whitespace"))


add("suggested_operations", lambda spark, sf: p.suggested_operations(profiles(spark, sf), COL),
    PROFILE + " " + " union all ".join(f"select {K}, {d.quoted(t)} as target, {_op_sql(t)} as operation from profiles" for t in TARGET_FIELDS))
add("column_samples",
    lambda spark, sf: m.sample_values(values(spark, sf)).select(*COL, F.array_join("samples", "|").alias("samples")),
    VALUES + f""" select {K}, string_agg(value, '|' order by row_idx) as samples from (
      select *, row_number() over (partition by {K} order by row_idx) as k from vals where value is not null) where k <= 5 group by all""")
