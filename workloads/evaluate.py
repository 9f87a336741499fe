"""Queries over the evaluation metrics (E1-E6). A file is one customer's sheet."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from schedulesmith.operators import evaluate as e
from schedulesmith.schema import TARGET_FIELDS
from schedulesmith.session import checkpoint_folder, settle
from schedulesmith.sources import sinks

from . import duck as d
from . import mapping as mp
from . import quality as ql
from . import review as rv
from .inputs import duck_sql, spark_sql, table
from .mapping import _pick

Q, SQL = {}, {}


def add(name, fn, sql=None):
    Q[name] = fn
    if sql:
        SQL[name] = sql


# Expected targets of most header spellings; some differ in case, some headers have none.
LABELS = " union all ".join(
    f"select c_name as file_id, {_pick(f'c_custkey * 5 + {j} * 7', mp.HEADERS)} as source_column, {_pick(f'c_custkey + {j}', [*TARGET_FIELDS, 'city', 'ZIP'])} as target from {{customer}}"
    for j in range(6))
# The same header means the same target here, so predictions are a plain per-file lookup.
PREDICTED = " union all ".join(
    f"select c_name as file_id, {_pick(f'c_custkey * 5 + {j} * 7', mp.HEADERS)} as source_column, {_pick(f'c_custkey + {j} * ({j} % 3)', [*TARGET_FIELDS, None])} as target from {{customer}}"
    for j in range(12))
_l, _p = duck_sql(LABELS), duck_sql(PREDICTED)
FILES = "select c_name as file_id from {customer}"


def _labels(spark, sf, width, target):
    """Same rows as the SQL above, without a union per column."""
    j, k = F.col("col_idx"), F.col("k")
    return mp.columns(spark, sf).where(j < width).select(F.col("sheet_name").alias("file_id"), "source_column", target(j, k).alias("target"))


def labels(spark, sf):
    return _labels(spark, sf, 6, lambda j, k: mp._choice(k + j, [*TARGET_FIELDS, "city", "ZIP"]))


def predicted(spark, sf):
    return _labels(spark, sf, 12, lambda j, k: mp._choice(k + j * (j % 3), [*TARGET_FIELDS, None]))


def files(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_name").alias("file_id"))


ACC = f"""acc as (select file_id, coalesce(count(case when lower(coalesce(p.target, '')) = lower(l.target) then 1 end) / nullif(count(l.target), 0), 1.0) as mapping_accuracy
  from (select c_name as file_id from customer) f left join ({_l}) l using (file_id) left join ({_p}) p using (file_id, source_column) group by all)"""
CORRECT = f"""correct as (select f.file_id, coalesce(count(case when p.target = l.target then 1 end) / nullif(count(p.target), 0), 1.0) as transformation_correctness
  from (select c_name as file_id from customer) f left join ({_l}) l using (file_id) left join (select * from ({_p}) where target is not null) p using (file_id, source_column) group by all)"""
add("mapping_accuracy", lambda spark, sf: e.mapping_accuracy(files(spark, sf), labels(spark, sf), predicted(spark, sf)), f"with {ACC} select * from acc")
add("transformation_correctness", lambda spark, sf: e.transformation_correctness(files(spark, sf), labels(spark, sf), predicted(spark, sf)),
    f"with {CORRECT} select * from correct")

EXPECTED = """select distinct o_orderstatus as file_id, case when length(o_orderpriority) % 3 = 0 then 'invalid_year' when length(o_orderpriority) % 3 = 1 then 'flooded_site' else 'duplicate_reference' end as anomaly from {orders}"""
_types = " union all ".join(
    f"select file_id, {d.quoted(kind)} as anomaly from told where " + " or ".join(f"contains(text, {d.quoted(w)})" for w in words)
    for kind, words in e.ANOMALY_KEYWORDS.items())
DETECTED = ql.ISSUES + f", told as (select file_id, lower(concat_ws(' ', evidence, suggested_operation, issue_type)) as text from numbered), detected as (select distinct * from ({_types}))"
add("detected_anomalies", lambda spark, sf: e.detected_types(ql.issues(spark, sf)), DETECTED + " select * from detected")
add("anomaly_recall",
    lambda spark, sf: e.anomaly_recall(
        table(spark, sf, "orders").select(F.col("o_orderstatus").alias("file_id")).distinct(), spark_sql(spark, sf, EXPECTED), ql.issues(spark, sf)),
    DETECTED + f""" select file_id, count(x.anomaly) / count(e.anomaly) as anomaly_recall from ({duck_sql(EXPECTED)}) e
      left join (select file_id, anomaly from detected) x on x.file_id = e.file_id and x.anomaly = e.anomaly group by all""".replace("select file_id, count(x", "select e.file_id, count(x"))


def items(spark, sf):
    """Review items with the customer's sheet as file."""
    return rv.recs(spark, sf).withColumn("file_id", F.col("sheet_name"))


def item_files(spark, sf):
    return table(spark, sf, "customer").select(F.concat(F.lit("sheet "), F.col("c_custkey").cast("string")).alias("file_id"))


def entries(spark, sf):
    return table(spark, sf, "lineitem").select(F.concat(F.lit("sheet "), F.col("l_suppkey").cast("string")).alias("file_id"))


EXPLAIN = f"""explained as (select f.file_id, coalesce(count(case when length(coalesce(rationale, '')) > 5 then 1 end) / nullif(count(rec_id), 0), 1.0) as explainability_coverage
  from (select concat('sheet ', c_custkey) as file_id from customer) f left join ({rv.RECS_DUCK}) r on r.sheet_name = f.file_id group by all)"""
AUDITED = f"""audited as (select f.file_id, case when a.file_id is null or l.file_id is not null then 1.0::double else 0.0::double end as audit_completeness
  from (select concat('sheet ', c_custkey) as file_id from customer) f
    left join (select distinct sheet_name as file_id from ({rv.RECS_DUCK}) where status = 'approved') a on a.file_id = f.file_id
    left join (select distinct concat('sheet ', l_suppkey) as file_id from lineitem) l on l.file_id = f.file_id)"""
add("explainability", lambda spark, sf: e.explainability(item_files(spark, sf), items(spark, sf)), f"with {EXPLAIN} select * from explained")
add("audit_completeness", lambda spark, sf: e.audit_completeness(item_files(spark, sf), items(spark, sf), entries(spark, sf)),
    f"with {AUDITED} select * from audited")


def scores(spark, sf):
    """Metrics of every customer; the expected anomalies of a customer are those of the file of its items."""
    key = F.regexp_extract("file_id", r"(\d+)$", 1).cast("bigint")
    files_of_items = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), mp._choice(F.col("c_custkey"), ["F", "O", "P"]).alias("status"))
    found = e.anomaly_recall(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("file_id")).distinct(), spark_sql(spark, sf, EXPECTED), ql.issues(spark, sf))
    recall = files_of_items.join(found.withColumnRenamed("file_id", "status"), "status").drop("status")
    per_item = e.explainability(item_files(spark, sf), items(spark, sf)).join(
        e.audit_completeness(item_files(spark, sf), items(spark, sf), entries(spark, sf)), "file_id").withColumn("key", key).drop("file_id")
    return (
        files(spark, sf).withColumn("key", key).join(e.mapping_accuracy(files(spark, sf), labels(spark, sf), predicted(spark, sf)), "file_id")
        .join(e.transformation_correctness(files(spark, sf), labels(spark, sf), predicted(spark, sf)), "file_id")
        .join(per_item, "key").join(recall, "key").drop("key"))


RECALL = f"""recalled as (select c_custkey, anomaly_recall from customer join ({SQL['anomaly_recall']}) x on x.file_id = {_pick('c_custkey', ['F', 'O', 'P'])})"""
CARD = f"""with {ACC}, {CORRECT}, {EXPLAIN}, {AUDITED}, {RECALL}, m as (
      select 'mapping_accuracy' as metric, avg(mapping_accuracy) * 100 as achieved, 74.0::double as target from acc
      union all select 'anomaly_recall', avg(anomaly_recall) * 100, 90.0 from recalled
      union all select 'transformation_correctness', avg(transformation_correctness) * 100, 95.0 from correct
      union all select 'explainability_coverage', avg(explainability_coverage) * 100, 100.0 from explained
      union all select 'audit_completeness', avg(audit_completeness) * 100, 100.0 from audited),
    card as (select metric, round(achieved, 6) as achieved, target, case when achieved >= target then 'PASS' else 'FAIL' end as status from m)"""


def card(spark, sf):
    return e.scorecard(settle(scores(spark, sf))).withColumn("achieved", F.round("achieved", 6)).withColumn("target", F.col("target").cast("double"))


def score_report(spark, sf):
    """The score card written as a report and read back, one row per metric."""
    path = f"{checkpoint_folder(spark)}/report-{uuid.uuid4().hex}"
    sinks.write_scores(card(spark, sf), path)
    return spark.read.schema("metric string, achieved double, target double, status string").json(path)


add("scorecard", card, CARD + " select * from card")
add("score_report", score_report, CARD + " select * from card")
