"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space of the word definition (space, tab to carriage return).
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

# A side is broadcast only if a count shows no more rows than this; the sides joined this
# way hold a few short columns, so this stays far below 100 MB.
BROADCAST_ROWS = 100_000


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names for all executors.

    Only a local session without that setting gets a temporary folder. Files in it live as
    long as results that read them; the owner of the checkpoint folder removes them.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, release: bool = False, compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: computed once, lineage cut.

    With ``release`` Spark removes the shuffle files of the run as soon as it is written, and not some time later.
    Whole texts and long lists take about a third less room with ``compression="zstd"``, for some more CPU time.
    """
    path = shared_folder(df.sparkSession, name)
    conf, cleanup = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(cleanup, None)
    if release:
        conf.set(cleanup, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        if release:
            conf.unset(cleanup) if before is None else conf.set(cleanup, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attach(data: DataFrame, side: DataFrame, on: Column, how: str = "inner", max_rows: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """Join a side that is broadcast if a count shows it to be small, else sort-merged with skew handling.

    ``weight`` says how many rows of a few short columns a row of the side stands for, where it holds arrays.
    """
    size = side.limit(max_rows + 1).count() if weight is None else side.agg(F.sum(weight)).first()[0] or 0
    if size <= max_rows:
        return data.join(F.broadcast(side), on, how)
    return data.join(side.hint("merge"), on, how)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text, in order; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def as_list(column: pa.Array) -> list:
    """Python values of an Arrow column; lists of numbers become numpy views."""
    if pa.types.is_list(column.type):
        values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    return column.to_pylist()


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """(key, columns) of the runs of rows with equal first ``keys`` columns, for sorted input in batches of any size."""
    key, held = None, []
    for batch in batches:
        columns = [as_list(c) for c in batch.columns]
        rows = list(zip(*columns[:keys]))
        edges = [i for i in range(1, len(rows)) if rows[i] != rows[i - 1]]
        for low, high in zip([0, *edges], [*edges, len(rows)]):
            if low == high:
                continue
            if held and rows[low] != key:
                yield key, held
                held = []
            key, part = rows[low], [c[low:high] for c in columns]
            held = [a + b for a, b in zip(held, part)] if held else part
    if held:
        yield key, held
