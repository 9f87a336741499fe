"""The corpus pipeline: quality rules, near duplicates, benchmark passages, source mix, shards.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns the
columns of ``docs``; the last adds the place of each row in the shuffled shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schedulesmith.llm import decontaminate, mix, neardup, quality, shards
from schedulesmith.llm.common import read, stored

# Random shuffling, weighted sampling and its banding are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the thresholds of their language and source."""
    return quality.quality_rules(docs).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the least doc_id of the text that heads it. Null texts stay."""
    classes = neardup.near_duplicates(docs.select("doc_id", "text")).where(F.col("key") == F.col("head")).select(F.col("key").alias("k"), "text_first")
    rows = docs.select(F.struct("*").alias("row"), F.md5("text").alias("key"), F.col("doc_id").alias("d"))
    heads = rows.join(classes.hint("merge"), (F.col("key") == F.col("k")) & F.col("d").eqNullSafe(F.col("text_first")))
    return heads.dropDuplicates(["key"]).select("row.*").unionByName(rows.where(F.col("key").isNull()).select("row.*"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in passages of the benchmark, without passages of a window's
    length or more that they have all the same; ``n_chars`` follows the text."""
    kept = decontaminate.find_contamination(docs, read(spark, sf_dir, "benchmark")).where("not contaminated")
    changed, cleaned = F.col("cleaned").isNotNull(), {"text": F.col("cleaned")}
    if "n_chars" in docs.columns:
        cleaned["n_chars"] = F.length("cleaned").cast(docs.schema["n_chars"].dataType)
    return kept.select(*[F.when(changed, cleaned[c]).otherwise(F.col("row")[c]).alias(c) if c in cleaned else F.col("row")[c].alias(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix draws it."""
    return mix.take_copies(mix.mix(docs))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in random order with shard and slot, under other names where ``docs`` has these."""
    names = []
    for name in ("shard", "slot"):
        while name.lower() in (c.lower() for c in docs.columns):
            name += "_"
        names.append(name)
    return shards.shuffle_into_shards(docs).select("row.*", F.col("shard").alias(names[0]), F.col("slot").alias(names[1]))


STAGES = [
    ("quality rules", quality_rules), ("near duplicates", near_duplicates), ("benchmark decontamination", benchmark_decontamination),
    ("source mix", source_mix), ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet to the shared folder and read again as the next one's input."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}", release=True, compression="zstd")
    return docs
