"""Inputs of the registered queries, derived from the given tables by Spark.

Every projection below is one SQL text that Spark and DuckDB both run, so the checking
SQL can start from exactly the same rows. ``@array`` is the list constructor of the engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CURRENT_YEAR = 2026
# Tables whose rows go through per-cell text work.
SPREAD = {"orders", "customer"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Tables in fewer files than there are cores are spread over the cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in SPREAD and len(df.inputFiles()) < min(cores, 64):
        return df.repartition(cores)
    return df


def spark_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run a projection; ``{name}`` stands for a given table."""
    import re

    tables = {n: table(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(text.replace("@array", "array"), **tables)


def duck_sql(text: str) -> str:
    import re

    return re.sub(r"\{(\w+)\}", r"\1", text.replace("@array", "list_value"))


# A dirty schedule: one row per order; file = order status, sheet = priority.
RAW = """
select o_orderstatus as file_id, o_orderpriority as sheet_name, o_orderkey as row_idx,
  case when o_orderkey % 23 = 0 then null else concat('L', cast(o_custkey as string)) end as ref_raw,
  concat(cast(o_orderkey % 900 + 1 as string), case when o_orderkey % 3 = 0 then '  Main St' else ' Oak Ave' end) as address_raw,
  case o_custkey % 4 when 0 then 'New York' when 1 then 'Los Angeles' when 2 then ' Austin  TX' else null end as city_raw,
  case when o_custkey % 6 = 0 then 'California' when o_custkey % 6 = 1 then 'tx' when o_custkey % 6 = 2 then 'N. Y.' when o_custkey % 6 = 3 then 'V.I.' when o_custkey % 6 = 4 then ' FL ' else 'Ontario' end as state_raw,
  case when o_orderkey % 5 = 0 then concat(cast(10000 + o_orderkey % 80000 as string), '-1234') when o_orderkey % 5 = 1 then cast(o_orderkey % 1000 as string) when o_orderkey % 5 = 2 then concat(cast(10000 + o_orderkey % 80000 as string), '.0') else cast(10000 + o_orderkey % 80000 as string) end as zip_raw,
  case o_custkey % 3 when 0 then 'Cook' when 1 then '' else 'Travis' end as county_raw,
  'USA' as country_raw,
  case when o_orderkey % 11 = 0 then null when o_orderkey % 7 = 0 then concat('$', cast(cast(floor(o_totalprice) as bigint) as string)) when o_orderkey % 13 = 0 then concat('($', cast(cast(floor(o_totalprice) as bigint) as string), ')') when o_orderkey % 17 = 0 then 'TBD' else cast(cast(floor(o_totalprice) as bigint) as string) end as building_raw,
  case o_orderkey % 6 when 0 then null when 1 then concat('$', cast(o_orderkey % 900 as string), ',000') else cast(cast(floor(o_totalprice / 4) as bigint) as string) end as contents_raw,
  case when o_orderkey % 10 = 0 then 'Included' when o_orderkey % 10 = 1 then '-250.75' else cast(cast(floor(o_totalprice / 8) as bigint) as string) end as bi_raw,
  case o_custkey % 3 when 0 then 'Office' when 1 then 'Retail' else 'Warehouse' end as occupancy_raw,
  case o_custkey % 4 when 0 then 'Frame' when 1 then 'Masonry ' when 2 then 'Steel' else 'Frame' end as construction_raw,
  case when o_orderkey % 9 = 0 then '1.5' when o_orderkey % 9 = 1 then '0' when o_orderkey % 9 = 2 then 'two' else concat(cast(o_orderkey % 20 + 1 as string), '.0') end as storeys_raw,
  case when o_orderkey % 12 = 0 then '0' when o_orderkey % 12 = 1 then 'several' else cast(o_orderkey % 4 + 1 as string) end as nbuildings_raw,
  case when o_orderkey % 5 = 0 then concat('Built in ', cast(1990 + o_orderkey % 30 as string)) when o_orderkey % 5 = 1 then concat(cast(1950 + o_orderkey % 50 as string), ' / 2012') else cast(1600 + o_orderkey % 500 as string) end as year_raw,
  case when o_orderkey % 8 = 0 then 'Yes' when o_orderkey % 8 = 1 then 'n' when o_orderkey % 8 = 2 then 'y13r' when o_orderkey % 8 = 3 then 'Y 13' when o_orderkey % 8 = 4 then 'Partial' when o_orderkey % 8 = 5 then '1' else 'Y' end as sprinkler_raw,
  case when o_orderkey % 3 = 0 then null else cast(o_orderkey % 5000 as string) end as other_raw,
  case when o_orderkey % 4 = 0 then '03/15/2024' when o_orderkey % 4 = 1 then '2024-02-30' when o_orderkey % 4 = 2 then '20240131' else '25/12/2023' end as date_raw
from {orders}
"""

# Raw column -> target field, in output order.
RAW_FIELDS = {
    "ref_raw": "Reference", "address_raw": "Address", "city_raw": "City", "state_raw": "State", "zip_raw": "Zip",
    "county_raw": "County", "country_raw": "Country", "building_raw": "Building Value", "contents_raw": "Contents",
    "bi_raw": "BI", "occupancy_raw": "Occupancy", "construction_raw": "Construction", "storeys_raw": "Storeys",
    "nbuildings_raw": "Number of Buildings", "year_raw": "Year Built", "sprinkler_raw": "Fire Sprinklers (Y/N)",
    "other_raw": "Other",
}

# The same rows under the target names.
MAPPED = "select file_id, sheet_name, row_idx, " + ", ".join(
    f'{r} as @q{t}@q' for r, t in RAW_FIELDS.items()) + f" from ({RAW})"


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_sql(spark, sf_dir, RAW)


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_sql(spark, sf_dir, MAPPED.replace("@q", "`"))


RAW_DUCK = duck_sql(RAW)
MAPPED_DUCK = duck_sql(MAPPED.replace("@q", '"'))

# Header spellings of the two sheet families, in column order.
HEADERS_A = ["Loc #", "Street Address", "City", "ST", "Zip Code", "County", "Country", "Bldg Repl Cost",
             "Contents Value", "Time Element", "Occ Code", "Const", "Num Stories", "# Bldgs", "Yr Blt", "Fire Prot",
             "Other Value", "Survey Date"]
HEADERS_B = ["Location ID", "Property Address", "City Name", "State", "Postal Code", "Parish", "Nation",
             "Building Value ($)", "Contents ($)", "BI Value", "Occupancy", "Construction", "Stories",
             "Number of Buildings", "Year Built", "Sprinklers", "Other", None]
RAW_COLUMNS = [*RAW_FIELDS, "date_raw"]
_FAMILY_B = "sheet_name in ('2-HIGH', '4-NOT SPECIFIED')"


def _list(values: list[str | None]) -> str:
    return "@array(" + ", ".join("cast(null as string)" if v is None else f"'{v}'" for v in values) + ")"


_RAW_LIST = "@array(" + ", ".join(RAW_COLUMNS) + ")"
_NULLS = ", ".join(["cast(null as string)"] * 6)

# Whole sheets: banner, header, data rows, and total and note rows scattered among them.
ROWS = f"""
select file_id, sheet_name, cast(4 + 3 * row_idx as bigint) as row_idx, {_RAW_LIST} as cells from ({RAW})
union all
select file_id, sheet_name, cast(5 + 3 * row_idx as bigint),
  @array('TOTAL', {_NULLS}, building_raw, contents_raw) from ({RAW}) where row_idx % 97 = 0
union all
select file_id, sheet_name, cast(6 + 3 * row_idx as bigint), @array('  ', '* values include fixtures') from ({RAW}) where row_idx % 89 = 0
union all
select file_id, sheet_name, cast(0 as bigint), @array('STATEMENT OF VALUES') from (select distinct o_orderstatus as file_id, o_orderpriority as sheet_name from {{orders}})
union all
select file_id, sheet_name, cast(2 as bigint), case when {_FAMILY_B} then {_list(HEADERS_B)} else {_list(HEADERS_A)} end
from (select distinct o_orderstatus as file_id, o_orderpriority as sheet_name from {{orders}})
union all
select o_orderstatus as file_id, 'Summary' as sheet_name, cast(row_number() over (partition by o_orderstatus order by o_orderpriority) - 1 as bigint),
  @array(o_orderpriority, cast(n as string)) from (select o_orderstatus, o_orderpriority, count(*) as n from {{orders}} group by o_orderstatus, o_orderpriority)
"""


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    return spark_sql(spark, sf_dir, ROWS).select(
        "file_id", "sheet_name", "row_idx", F.col("cells").alias("values"),
        F.lit(None).cast("array<string>").alias("types"))


ROWS_DUCK = duck_sql(ROWS)
