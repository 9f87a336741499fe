"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import attach, n_partitions, shared_folder, stored

SHARDS, SEED, BUCKET_BYTES = 16, 7, 16 << 20
# So many buckets at most, since the 24 bytes that place each are broadcast; beyond this many times BUCKET_BYTES (16 TB) buckets grow.
MAX_BUCKETS = 1_000_000
# Buckets per shuffle partition at least, so that hashing them to partitions comes out even.
SPREAD = 4


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text, none for null, plus one."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def shuffle_into_shards(docs: DataFrame, text: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows of ``docs`` as ``row`` in a seeded random order, cut into ``shards`` runs written as Parquet; returns what was written.

    Pass 1 scatters the rows into buckets of about ``bucket_bytes`` by a seeded hash of the
    whole row; the number of buckets follows the size of the input up to ``MAX_BUCKETS``, so a bucket fits in the
    memory of a task (100 MB at 100 TB) and the places of the buckets can be broadcast: texts are shuffled once. Copies of one whole row share a hash; a bucket that came out more than
    twice too large is therefore split further by row number, and identical rows may go anywhere.
    Pass 2 puts the rows of a bucket in hash order, whatever order they arrived in, and
    Fisher-Yates shuffles them with a generator seeded by the bucket. Buckets stand one after
    another; the position in this order decides shard and slot, so shards differ by one row at
    most. Lost tasks repeat the same result.

    Nulls, empty texts and repeated rows are rows like any other; an empty table gives none.
    Columns of the input travel in ``row``, so their names can't clash with ``shard`` and ``slot``.
    """
    spark = docs.sparkSession
    code = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.struct("*").alias("row"), code.alias("code"), text_size(F.col(text)).alias("size"), F.monotonically_increasing_id().alias("at"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    buckets = max(min(-(-total // bucket_bytes), MAX_BUCKETS), SPREAD * n_partitions(spark), shards)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "code"), F.lit(buckets)))

    large = 2 * max(total / buckets, 1 << 20)
    sizes = rows.groupBy("bucket").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    plan = stored(sizes.select("bucket", "n", F.when(F.col("bytes") > large, F.ceil(F.col("bytes") * 2 / large)).otherwise(1).cast("long").alias("parts")),
                  "shard-buckets")
    if plan.where("parts > 1").limit(1).count():
        rows = stored(rows, "shard-rows", compression="zstd")  # row numbers decide now, so they must not change between two readings
        rows = attach(rows, plan.select(F.col("bucket").alias("b"), "parts"), F.col("bucket") == F.col("b"))
        rows = rows.withColumn("part", F.pmod("at", "parts")).drop("b", "parts")
        plan = stored(rows.groupBy("bucket", "part").agg(F.count("*").alias("n")), "shard-parts")
    else:
        rows = rows.withColumn("part", F.lit(0).cast("long"))
        plan = plan.select("bucket", F.lit(0).cast("long").alias("part"), "n")
    earlier = Window.orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket, none per document
    offsets = stored(plan.select(F.col("bucket").alias("b"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")),
                     "shard-offsets")
    count = plan.agg(F.sum("n")).first()[0] or 0
    placed = attach(rows, offsets, (F.col("bucket") == F.col("b")) & (F.col("part") == F.col("p")), max_rows=2 * MAX_BUCKETS)

    def fisher_yates(key: tuple[pa.Scalar, ...], bucket: pa.Table) -> pa.Table:
        order = np.lexsort((bucket.column("at").to_numpy(), bucket.column("code").to_numpy()))
        np.random.Generator(np.random.PCG64([seed, key[0].as_py(), key[1].as_py()])).shuffle(order)
        position = bucket.column("before")[0].as_py() + np.arange(len(order), dtype=np.int64)
        shard = ((position + 1) * shards - 1) // max(count, 1)  # shard s holds positions from s * count / shards on
        start = shard * count // shards
        return pa.table({"row": bucket.column("row").take(order), "shard": pa.array(shard.astype(np.int32)), "slot": pa.array(position - start)})

    schema = StructType([rows.schema["row"], StructField("shard", IntegerType()), StructField("slot", LongType())])
    # Ranges of buckets: even tasks, each with a run of the order and so with few shards.
    ranged = placed.select("bucket", "part", "row", "code", "at", "before").repartitionByRange(n_partitions(spark), "bucket", "part")
    dealt = ranged.groupBy("bucket", "part").applyInArrow(fisher_yates, schema)
    path = shared_folder(spark, "shards")
    dealt.write.partitionBy("shard").parquet(path, compression="zstd")
    return spark.read.schema(schema).parquet(path)
