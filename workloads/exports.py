"""What the sinks leave behind: exports written to the shared folder in several steps and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from schedulesmith.operators import validate as v
from schedulesmith.schema import KEYS, TARGET_FIELDS
from schedulesmith.session import checkpoint_folder
from schedulesmith.sources import sinks

from . import transform as tr
from .inputs import MAPPED_DUCK, mapped

Q, SQL = {}, {}
K = ", ".join(KEYS)


def add(name, fn, sql=None):
    Q[name] = fn
    if sql:
        SQL[name] = sql


def folder(spark) -> str:
    return f"{checkpoint_folder(spark)}/export-{uuid.uuid4().hex}"


_typed = ", ".join(tr._typed_sql(f) for f in TARGET_FIELDS)
_MENDED = "file_id = 'O' and sheet_name = '3-MEDIUM'"


# All sheets, then one of them again with mended cities; the others stay.
def cleaned_sink(spark, sf):
    path, typed = folder(spark), v.typed_table(mapped(spark, sf))
    ranked = typed.select(*KEYS).distinct()
    sinks.write_cleaned(typed, path, ranked.withColumn("is_primary", F.col("sheet_name") == "1-URGENT"))
    mended = typed.where(_MENDED).withColumn("City", F.upper("City"))
    sinks.write_cleaned(mended, path, ranked.where(_MENDED).withColumn("is_primary", F.lit(True)))
    return path


_EXPORTED = f"(select * replace (case when {_MENDED} then upper(\"City\") else \"City\" end as \"City\") from (select {K}, row_idx, {_typed} from ({MAPPED_DUCK})))"
add("cleaned_sink", lambda spark, sf: sinks.read_cleaned(spark, cleaned_sink(spark, sf)), f"select * from {_EXPORTED}")
add("primary_sink", lambda spark, sf: sinks.read_cleaned(spark, cleaned_sink(spark, sf), "primary"),
    f"select * from {_EXPORTED} where case when file_id = 'O' then sheet_name = '3-MEDIUM' else sheet_name = '1-URGENT' end")


# Sheets whose names have one file-safe form keep apart; zip codes keep their zeros.
_CLASHING = "case row_idx % 3 when 0 then 'A B' when 1 then 'A_B' else 'A  B' end"


def cleaned_csv(spark, sf):
    path = folder(spark)
    typed = v.typed_table(mapped(spark, sf)).withColumn("sheet_name", F.expr(_CLASHING))
    sinks.write_cleaned_csv(typed, path)
    schema = ", ".join(f"`{f}` string" for f in TARGET_FIELDS) + ", file string, sheet string"
    rows = spark.read.schema(schema).options(**sinks.READ_CSV).csv(path)
    names = typed.select("sheet_name").distinct().withColumn("sheet", sinks.folder_name(F.col("sheet_name")))
    return rows.join(F.broadcast(names), "sheet").groupBy(F.col("file").alias("file_id"), "sheet_name", "Zip").agg(
        F.count("*").alias("n"), F.count("City").alias("n_cities"))


_zip = next(x for f, x in zip(TARGET_FIELDS, (tr._typed_sql(f) for f in TARGET_FIELDS)) if f == "Zip")
add("cleaned_csv", cleaned_csv,
    f"""select file_id, {_CLASHING} as sheet_name, lpad(cast("Zip" as varchar), 5, '0') as "Zip", count(*) as n, count("City") as n_cities
        from (select {K}, row_idx, {_zip}, "City" from ({MAPPED_DUCK})) group by all""")


# The audit of half of the files, then of all, then of all again: every entry is there once.
def audit_twice(spark, sf, write):
    audit = tr.cleaned(spark, sf)[1]()
    path = folder(spark)
    for part in (audit.where("file_id = 'F'"), audit, audit):
        write(part, path)
    return path


def audit_appended(spark, sf):
    path = audit_twice(spark, sf, lambda audit, path: sinks.write_audit(audit, path, tr.STAMP))
    schema = ", ".join(f"`{h}` string" for h in sinks.AUDIT_HEADINGS.values())
    rows = spark.read.schema(schema + ", file string").options(**sinks.READ_CSV).csv(path)
    headings = ["Source Column", "Target Column", "Transformation Applied", "Before Value", "After Value"]
    return rows.select(F.col("file").alias("file_id"), *[F.coalesce(h, F.lit("")).alias(h) for h in headings])


add("audit_appended", audit_appended,
    tr.AUDIT + """ select file_id, source_column as "Source Column", target_column as "Target Column", transformation_applied as "Transformation Applied",
      before_value as "Before Value", after_value as "After Value" from audit""")


def audit_json(spark, sf):
    entries = sinks.read_audit_json(spark, audit_twice(spark, sf, sinks.write_audit_json))
    kind = F.schema_of_variant("after_value")
    return entries.select(
        *KEYS, "source_column", "target_column", "transformation_applied", F.variant_get("before_value", "$", "string").alias("before_value"),
        F.when(kind.startswith("DECIMAL") | kind.isin("BIGINT", "DOUBLE"), "number").otherwise(F.lower(kind)).alias("after_kind"),
        F.when(kind == "STRING", F.variant_get("after_value", "$", "string")).alias("after_text"),
        F.when(kind != "STRING", F.try_variant_get("after_value", "$", "double")).alias("after_number"))


_number = r"transformation_applied in ('strip_currency', 'to_float', 'to_int', 'to_year_int', 'to_zip') and regexp_full_match(after_value, '-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?')"
add("audit_json", audit_json,
    tr.AUDIT + f""" select {K}, source_column, target_column, transformation_applied, before_value, case when {_number} then 'number' else 'string' end as after_kind,
      case when not ({_number}) then after_value end as after_text, case when {_number} then cast(after_value as double) end as after_number from audit""")
