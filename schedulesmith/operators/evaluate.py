"""Evaluation against labelled files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that show an anomaly type was reported.
ANOMALY_KEYWORDS = {
    "currency_symbols": ["currency", "strip_currency", "dollar", "$", ","],
    "negative_value": ["negative", "neg"],
    "duplicate_reference": ["duplicate", "reference"],
    "non_standard_sprinkler": ["sprinkler", "normalize_sprinkler"],
    "invalid_year": ["year", "future", "1700"],
    "invalid_state": ["state", "state_to_abbrev"],
}

# Metric -> required percentage.
TARGETS = {"mapping_accuracy": 74.0, "anomaly_recall": 90.0, "transformation_correctness": 95.0,
           "explainability_coverage": 100.0, "audit_completeness": 100.0}


def _share(hits: Column, total: Column) -> Column:
    return F.coalesce(hits / F.nullif(total, F.lit(0)), F.lit(1.0))


def mapping_accuracy(files: DataFrame, labels: DataFrame, predicted: DataFrame) -> DataFrame:
    """Labels predicted correctly, ignoring case; 1.0 without labels.

    ``labels(file_id, source_column, target)``, ``predicted(file_id, source_column, target)``.
    """
    p = predicted.select("file_id", "source_column", F.col("target").alias("_p"))
    hit = F.lower(F.coalesce("_p", F.lit(""))) == F.lower("target")
    per_file = labels.join(p, ["file_id", "source_column"], "left").groupBy("file_id").agg(
        F.count(F.when(hit, 1)).alias("_ok"), F.count(F.lit(1)).alias("_n"))
    return files.select("file_id").join(per_file, "file_id", "left").select(
        "file_id", _share(F.col("_ok"), F.col("_n")).alias("mapping_accuracy"))


def detected_types(issues: DataFrame) -> DataFrame:
    """Anomaly types reported per file, found by keyword in the finding's text."""
    text = F.lower(F.concat_ws(" ", "evidence", "suggested_operation", "issue_type"))
    found = F.array_compact(F.array(*[
        F.when(_contains_any(text, words), F.lit(kind))
        for kind, words in ANOMALY_KEYWORDS.items()]))
    return issues.select("file_id", F.explode(found).alias("anomaly")).distinct()


def _contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


def anomaly_recall(files: DataFrame, expected: DataFrame, issues: DataFrame) -> DataFrame:
    """Expected anomaly types that were reported; 1.0 when none is expected."""
    hits = detected_types(issues).withColumn("_hit", F.lit(1))
    per_file = expected.select("file_id", "anomaly").distinct().join(hits, ["file_id", "anomaly"], "left").groupBy(
        "file_id").agg(F.count("_hit").alias("_ok"), F.count(F.lit(1)).alias("_n"))
    return files.select("file_id").join(per_file, "file_id", "left").select(
        "file_id", _share(F.col("_ok"), F.col("_n")).alias("anomaly_recall"))


def transformation_correctness(files: DataFrame, labels: DataFrame, applied: DataFrame) -> DataFrame:
    """Correct among the labelled columns that were mapped; 1.0 when none was."""
    a = applied.where("target is not null").select("file_id", "source_column", F.col("target").alias("_p"))
    per_file = labels.join(a, ["file_id", "source_column"]).groupBy("file_id").agg(
        F.count(F.when(F.col("_p") == F.col("target"), 1)).alias("_ok"), F.count(F.lit(1)).alias("_n"))
    return files.select("file_id").join(per_file, "file_id", "left").select(
        "file_id", _share(F.col("_ok"), F.col("_n")).alias("transformation_correctness"))


def explainability(files: DataFrame, recs: DataFrame) -> DataFrame:
    """Share of recommendations with a real rationale; 1.0 without any."""
    said = F.length(F.coalesce("rationale", F.lit(""))) > 5
    per_file = recs.groupBy("file_id").agg(F.count(F.when(said, 1)).alias("_ok"), F.count(F.lit(1)).alias("_n"))
    return files.select("file_id").join(per_file, "file_id", "left").select(
        "file_id", _share(F.col("_ok"), F.col("_n")).alias("explainability_coverage"))


def audit_completeness(files: DataFrame, recs: DataFrame, audit: DataFrame) -> DataFrame:
    """1.0 when nothing was approved or something was audited (E5)."""
    approved = recs.where("status = 'approved'").groupBy("file_id").agg(F.count(F.lit(1)).alias("_a"))
    entries = audit.groupBy("file_id").agg(F.count(F.lit(1)).alias("_e"))
    joined = files.select("file_id").join(approved, "file_id", "left").join(entries, "file_id", "left")
    return joined.select(
        "file_id", F.when(F.col("_a").isNull() | (F.col("_e") > 0), 1.0).otherwise(0.0).alias("audit_completeness"))


def scorecard(per_file: DataFrame) -> DataFrame:
    """Mean of every metric over all files in percent, against its target."""
    means = per_file.agg(*[(F.avg(m) * 100).alias(m) for m in TARGETS])
    items = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("achieved"), F.lit(t).alias("target"),
                 F.when(F.col(m) >= t, "PASS").otherwise("FAIL").alias("status")) for m, t in TARGETS.items()])
    return means.select(F.inline(items))
