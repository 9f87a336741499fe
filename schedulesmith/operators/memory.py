"""Mapping memory: approved header -> target pairs, kept as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.similarity import similarity_topk
from ..functions.text import normalize_memory_header

MEMORY_COLUMNS = ["normalized_source", "source_column", "target_field", "confidence", "method", "approved_by", "ts"]
MIN_SIMILARITY = 0.5
TRUSTED_SIMILARITY = 0.85


def memory_entries(approved: DataFrame, method: str = "human_approved", approved_by: Column | None = None,
                   keep: list[str] = ()) -> DataFrame:
    """Memory rows for approved mappings ``(source_column, target_field, confidence, ts)``; ``keep`` names further columns."""
    return approved.select(
        normalize_memory_header(F.col("source_column")).alias("normalized_source"), "source_column", "target_field",
        "confidence", F.lit(method).alias("method"),
        (F.lit("human") if approved_by is None else approved_by).alias("approved_by"), "ts", *keep,
    )


def upsert_memory(memory: DataFrame, entries: DataFrame) -> DataFrame:
    """Latest row per (normalized header, target).

    The latest row is found by a max of ``(ts, new over old)``; only per-task maxima are
    shuffled, so a header approved millions of times costs no more than any other.
    """
    both = memory.select(*MEMORY_COLUMNS, F.lit(0).alias("_new")).unionByName(
        entries.select(*MEMORY_COLUMNS, F.lit(1).alias("_new")))
    payload = F.struct("ts", "_new", "source_column", "confidence", "method", "approved_by")
    latest = both.groupBy("normalized_source", "target_field").agg(F.max(payload).alias("_m"))
    return latest.select(
        "normalized_source", "_m.source_column", "target_field", "_m.confidence", "_m.method", "_m.approved_by", "_m.ts")


# --- memory as a table ---------------------------------------------------------------------

def create_memory(spark: SparkSession, table: str, path: str, buckets: int | None = None) -> None:
    """An empty memory table, bucketed by normalized header; ``path`` is a new folder that all executors share.

    Rows of one header lie in one bucket, so neither appends nor lookups shuffle the memory. ``buckets`` should
    be no less than the shuffle partitions of the sessions that read it (the default), else Spark may prefer
    to shuffle both sides of a join.
    """
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.sql(
        f"create table {table} (normalized_source string, source_column string, target_field string, confidence double, method string, approved_by string, "
        f"ts timestamp, batch bigint) using parquet clustered by (normalized_source) sorted by (normalized_source) into {buckets} buckets location '{path}'")


def _buckets(spark: SparkSession, table: str) -> int:
    return int(next(r["data_type"] for r in spark.sql(f"describe extended {table}").collect() if r["col_name"] == "Num Buckets"))


def append_memory(entries: DataFrame, table: str) -> None:
    """Adds entries as the next batch; what is there is not rewritten."""
    spark = entries.sparkSession
    batch = (spark.table(table).agg(F.max("batch")).first()[0] or 0) + 1
    buckets = _buckets(spark, table)
    rows = entries.select(*MEMORY_COLUMNS, F.lit(batch).cast("bigint").alias("batch"))
    rows.repartition(buckets, "normalized_source").write.insertInto(table)


def read_memory(spark: SparkSession, table: str) -> DataFrame:
    """The latest row per (normalized header, target), of equal times that of the later batch: what ``upsert_memory`` would hold.

    Rows of a header share a bucket, so the latest are found without an exchange.
    """
    payload = F.struct("ts", "batch", "source_column", "confidence", "method", "approved_by")
    latest = spark.table(table).groupBy("normalized_source", "target_field").agg(F.max(payload).alias("_m"))
    return latest.select("normalized_source", "_m.source_column", "target_field", "_m.confidence", "_m.method", "_m.approved_by", "_m.ts")


def compact_memory(spark: SparkSession, table: str, path: str) -> None:
    """Rewrites the table with its latest rows only, into the new folder ``path``; the table changes over when all is written."""
    create_memory(spark, f"{table}_compact", path, _buckets(spark, table))
    append_memory(read_memory(spark, table), f"{table}_compact")
    spark.sql(f"drop table {table}")
    spark.sql(f"alter table {table}_compact rename to {table}")


def search_memory(headers: DataFrame, memory_vectors: DataFrame, k: int = 3) -> DataFrame:
    """Top ``k`` remembered entries per header vector with similarity above 0.5.

    ``headers(header_id, vector)``, ``memory_vectors(memory_id, vector)``; unit vectors.
    """
    return similarity_topk(headers, memory_vectors, "header_id", "memory_id", k, MIN_SIMILARITY, metric="l2")


def memory_matches(headers: DataFrame, memory: DataFrame) -> DataFrame:
    """Remembered mapping per distinct header by normalized equality, similarity 1 (M3).

    ``headers(source_column)``. One row per header: the most recent, then most confident entry.
    """
    keyed = headers.select("source_column", normalize_memory_header(F.col("source_column")).alias("normalized_source"))
    latest = Window.partitionBy("normalized_source").orderBy(F.desc("ts"), F.desc("confidence"), "target_field")
    best = memory.withColumn("_r", F.row_number().over(latest)).where("_r = 1").select(
        "normalized_source", F.col("source_column").alias("memory_source"), F.col("target_field").alias("target"),
        F.col("confidence").alias("memory_confidence"))
    return keyed.join(best, "normalized_source").select(
        "source_column", "memory_source", "target", "memory_confidence", F.lit(1.0).alias("similarity"))


def nearest_matches(header_vectors: DataFrame, memory_vectors: DataFrame) -> DataFrame:
    """Nearest remembered mapping per header when its similarity exceeds 0.85 (M3).

    ``header_vectors(source_column, vector)``; ``memory_vectors(memory_id, memory_source, target,
    memory_confidence, vector)``. Same columns as ``memory_matches``.
    """
    hits = similarity_topk(header_vectors, memory_vectors, "source_column", "memory_id", 1, TRUSTED_SIMILARITY, metric="l2")
    return hits.join(memory_vectors.drop("vector"), "memory_id").select(
        "source_column", "memory_source", "target", "memory_confidence", "similarity")
