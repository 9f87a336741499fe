"""Session settings and the size-checked join used by every stage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest side that may be broadcast. Rows of the sides joined this way are narrow
# (one sheet or one mapping each, well under 1 KB), so this stays below 200 MB.
BROADCAST_ROWS = 200_000
# Splits of one hot sheet when the other side is too large to broadcast.
SALTS = 64


def local_session(cpus: str | int = "*", partitions: int = 8, app: str = "schedulesmith") -> SparkSession:
    """A local session for tests and the benchmark. On a cluster use the session it provides."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def compiled_methods(spark: SparkSession) -> None:
    """Let no stage run on a generated method that the JVM refuses to compile.

    HotSpot interprets methods of over 8,000 bytes for good, and Spark by default fuses stages up to 65,535; plans of
    17 fields with an operation each are beyond 8,000. Spark then runs such a stage operator by operator, in methods
    small enough to be compiled. A limit that the session sets itself stays.
    """
    limit = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(limit) == "65535":
        spark.conf.set(limit, "8000")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, shared by all executors.

    Only a local session without that setting gets a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            folder = tempfile.mkdtemp(prefix="schedulesmith-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Compute a stage result once and cut its lineage with a reliable checkpoint."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Write rows once as Parquet below the checkpoint folder; readers of the result prune its columns."""
    path = f"{checkpoint_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no more than one row past that."""
    return df.select(F.lit(1)).limit(max_rows + 1).count() <= max_rows


def attach(data: DataFrame, side: DataFrame, keys: list[str], how: str = "inner",
           spread: Column | None = None, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join per-sheet facts (one row per key) onto data rows.

    ``side`` is broadcast only after its row count was checked. A larger side is sort-merged.
    Only keys that a count shows to hold more than a 1/``SALTS`` share of the data are split by
    a salt, because one sheet may hold a large share of all rows; their few plan rows are
    repeated, all others are not. The salt also keeps a following ``groupBy(keys)`` from inheriting a
    skewed partitioning.
    """
    if is_small(side, max_rows):
        return data.join(F.broadcast(side), keys, how)
    counts = data.groupBy(*keys).count()
    total = data.count()
    hot = settle(counts.where(F.col("count") * SALTS > total).select(*keys, F.lit(SALTS).alias("_salts")))  # fewer than SALTS rows
    spread = F.struct(*data.columns) if spread is None and "row_idx" not in data.columns else F.col("row_idx") if spread is None else spread
    salt = F.pmod(F.xxhash64(spread), F.coalesce("_salts", F.lit(1))).cast("int")
    salted = side.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    spread_out = data.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_salts")
    return spread_out.join(salted.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def first_rows(flagged: DataFrame, group: list[str], n: int, order: str = "row_idx",
               rank: str = "_rank") -> DataFrame:
    """The ``n`` lowest rows of every group, ranked from 1.

    Two ranked steps, both cut to ``n`` rows per group on the map side before the shuffle:
    within bands of ``row_idx`` first, then over at most ``SALTS * n`` rows per group. A
    group with a third of all rows is therefore never sorted in one task.
    """
    from pyspark.sql import Window

    band = F.pmod(F.floor(F.col(order) / 65536), F.lit(SALTS)).cast("int")
    inner = Window.partitionBy(*group, "_band").orderBy(order)
    outer = Window.partitionBy(*group).orderBy(order)
    return (
        flagged.withColumn("_band", band)
        .withColumn(rank, F.row_number().over(inner)).where(F.col(rank) <= n)
        .drop("_band", rank)
        .withColumn(rank, F.row_number().over(outer)).where(F.col(rank) <= n)
    )
