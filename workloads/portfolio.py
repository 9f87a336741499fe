"""The whole plan, raw sheets in and typed schedule out, over all orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from schedulesmith.operators import transform as t
from schedulesmith.plans import portfolio as pf
from schedulesmith.schema import KEYS, TARGET_FIELDS
from schedulesmith.session import settle, store
from schedulesmith.sources import sinks

from . import duck as d
from . import values as vl
from .inputs import CURRENT_YEAR, HEADERS_A, HEADERS_B, RAW_DUCK, RAW_FIELDS, rows, spark_sql

Q, SQL = {}, {}


def add(name, fn, sql=None):
    Q[name] = fn
    if sql:
        SQL[name] = sql


def export(spark, sf):
    """Discover, map and assess all sheets, approve everything, clean and validate."""
    found = pf.discover(store(rows(spark, sf)))
    mapped = pf.map_columns(found, CURRENT_YEAR)
    checked = pf.assess(found, mapped.mapping, CURRENT_YEAR)
    return pf.transform(found, pf.approve_all(checked.recommendations), stamp="2024-01-01T00:00:00")


_storeys, _buildings = d.plain("storeys_raw", ","), d.plain("nbuildings_raw", ",")
EXPECTED = {
    "County": "nullif(county_raw, '')", "State": vl.STATE_SQL, "Zip": vl.ZIP_SQL, "Building Value": d.currency("building_raw"),
    "Contents": d.currency("contents_raw"), "BI": d.plain("bi_raw", ""), "Year Built": vl.YEAR_SQL, "Other": d.plain("other_raw", ""),
    "Storeys": f"case when {_storeys} = floor({_storeys}) then cast({_storeys} as int) end",
    "Number of Buildings": f"case when {_buildings} = floor({_buildings}) then cast({_buildings} as int) end",
    "Fire Sprinklers (Y/N)": vl.SPRINKLER_SQL,
}
_source = {f: c for c, f in RAW_FIELDS.items()}
add("portfolio_export", lambda spark, sf: export(spark, sf).typed,
    "select file_id, sheet_name, 4 + 3 * row_idx as row_idx, " + ", ".join(f'{EXPECTED.get(f, _source[f])} as "{f}"' for f in TARGET_FIELDS)
    + f" from ({RAW_DUCK})")


def mapped_json(spark, sf):
    found = pf.discover(store(rows(spark, sf)))
    return sinks.mapping_json(settle(pf.map_columns(found, CURRENT_YEAR).mapping))


# Every key of the JSON is there for every column, mapped or not.
_names_a, _names_b = ([n or f"_col_{i}" for i, n in enumerate(h)] for h in (HEADERS_A, HEADERS_B))
_own_name = "case when o_orderpriority in ('2-HIGH', '4-NOT SPECIFIED') then b else a end"
add("portfolio_mapping_json",
    lambda spark, sf: mapped_json(spark, sf).select(
        *KEYS, F.get_json_object("json", "$.source_column").alias("source_column"), F.get_json_object("json", "$.target").alias("target"),
        F.get_json_object("json", "$.method").isin("exact", "fuzzy", "unresolved").alias("method_known"),
        (F.get_json_object("json", "$.confidence").cast("double") > 0).alias("confident"),
        F.size(F.json_object_keys("json")).alias("n_keys"),
        F.get_json_object("json", "$.evidence[0]").isNotNull().alias("has_evidence")),
    f"select o_orderstatus as file_id, o_orderpriority as sheet_name, {_own_name} as source_column, t.target, "
    f"true as method_known, t.target is not null as confident, 11 as n_keys, not starts_with({_own_name}, '_col_') as has_evidence "
    "from (select distinct o_orderstatus, o_orderpriority from orders), (select * from "
    + d.values_table([(i, x, y) for i, (x, y) in enumerate(zip(_names_a, _names_b))], "i, a, b") + ") n left join (select * from "
    + d.values_table(list(enumerate(TARGET_FIELDS)), "j, target") + ") t on i = j")

# Lists of customers under headers that mean nothing here: data sheets without a mapped column.
PLAIN = """select c_mktsegment as file_id, 'List' as sheet_name, cast(row_number() over (partition by c_mktsegment order by c_custkey) as bigint) as row_idx,
  @array(c_name, cast(c_acctbal as string)) as cells from {customer}
union all select distinct c_mktsegment, 'List', cast(0 as bigint), @array('Alpha', 'Gamma') from {customer}"""


def plain(spark, sf):
    data = spark_sql(spark, sf, PLAIN).select(*KEYS, "row_idx", F.col("cells").alias("values"), F.lit(None).cast("array<string>").alias("types"))
    found = pf.discover(store(data))
    return found, pf.map_columns(found, CURRENT_YEAR).mapping


def plain_scores(spark, sf):
    found, mapping = plain(spark, sf)
    return pf.assess(found, mapping, CURRENT_YEAR).scores.select(*KEYS, "mapping_score", "completeness_score", "score", "grade")


def plain_preview(spark, sf):
    found, mapping = plain(spark, sf)
    recs = pf.approve_all(pf.assess(found, mapping, CURRENT_YEAR).recommendations)
    return t.preview(found.records, found.columns, recs)


add("portfolio_scores", plain_scores,
    "select distinct c_mktsegment as file_id, 'List' as sheet_name, 0.0::double as mapping_score, 0.0::double as completeness_score, 35.0::double as score, 'D' as grade from customer")
add("portfolio_preview", plain_preview,
    "select c_mktsegment as file_id, 'List' as sheet_name, n as row_idx, " + ", ".join(f'cast(null as varchar) as "{f}"' for f in TARGET_FIELDS)
    + " from (select c_mktsegment, row_number() over (partition by c_mktsegment order by c_custkey) as n from customer) where n <= 15")


add("portfolio_validation",
    lambda spark, sf: export(spark, sf).validation.withColumn("n_errors", F.size("errors")).select("file_id", "passed", "n_errors"),
    f"""with r as materialized ({RAW_DUCK}), bad as (
        select distinct file_id, sheet_name, 'BI' as field from r where bi_raw is not null and {d.plain('bi_raw', '')} is null
        union select distinct file_id, sheet_name, 'Storeys' from r where {_storeys} <> floor({_storeys}))
      select file_id, false as passed, count(*)::int as n_errors from bad group by all""")
