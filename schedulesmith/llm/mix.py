"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, n_words, stored

WEIGHTS, SHARE, LIMIT, SEED = (3, 1, 2), 1.5, 2, 20240501
# Rows of one size and source that are ranked in one group.
GROUP_ROWS = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, target) from rows (source, total), one per source.

    Sources in code point order, null last, take the weights in turn. They share ``share``
    times all sizes by weight; a target stops at ``limit`` times its source and the excess goes
    to the others by weight until none is above. Ordered by limit per weight, the sources that
    stop come first, so running sums give the level at which the rest share; the number of
    sources, not of rows, decides the size of this step.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    every = Window.partitionBy()
    ordered = sizes.select(
        "source", F.col("total").alias("source_size"), (F.col("total") * limit).alias("cap"),
        F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("long").alias("weight"))
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    rest = ordered.select(
        "*", (F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weights"))
    # A source stops if its part of what the smaller ones leave is above its limit; the first that does not sets the level for all after it.
    part = F.col("left") / F.col("weights")
    stops = part * F.col("weight") >= F.col("cap")
    ranked = rest.select("*", F.row_number().over(level).alias("at"))
    fixed = ranked.select("*", F.min(F.when(~stops, F.struct("at", part.alias("part")))).over(every).alias("first"))
    return fixed.select(
        "source", "source_size",
        F.least(F.coalesce(F.col("first.part") * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double")).alias("target"))


def mix(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT,
        seed: int = SEED, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Every row of ``docs`` as ``row`` with size (words of the text by default), source_size, target and copies.

    Within a source the rows are ranked by (size, md5 of doc_id, doc_id), nulls first, and put in
    an order that rises over the even ranks and falls over the odd ones. Each expects target /
    source_size copies; the prefix sum of these plus one random offset (from ``seed``) crosses
    integer boundaries, and a row is taken once per boundary. Neighbours of like size and the two
    slopes cancel most of what rounding to whole copies adds or leaves out, so the words taken stay
    well within the largest document of the target. Reruns agree: only identical rows can trade places.

    The rank inside a source is the sum of three parts, so no source is ranked in one task:
    rows of smaller sizes, rows of the same size in lower hash ranges, and the place within the
    hash range, which holds about ``group_rows`` rows. Texts are not shuffled; rows that share
    doc_id, source and size are told apart by a running number within their range.

    Null text has size 0, a null source is a source, a source without words has target 0 and
    gives nothing. Other columns travel in ``row``, whatever their names.
    """
    offset = random.Random(seed).random()
    code = F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit(""))
    keyed = docs.select(F.struct("*").alias("row"), "doc_id", "source", (n_words(F.col("text")) if size is None else size).alias("size"), code.alias("code"))
    narrow = stored(keyed.select("doc_id", "source", "size", "code"), "mix-sizes")

    same = narrow.groupBy("source", "size").count()
    lower = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    totals = same.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).alias("total"), F.sum("count").alias("n"))
    targets = source_targets(totals, weights, share, limit)
    totals = totals.select(F.col("source").alias("t"), F.col("n").alias("source_rows"))
    totals = stored(targets.join(totals, F.col("source").eqNullSafe(F.col("t"))).drop("t"), "mix-targets")
    sizes = stored(same.select(
        F.col("source").alias("s"), F.col("size").alias("z"), F.coalesce(F.sum("count").over(lower), F.lit(0)).alias("below"),
        F.ceil(F.col("count") / group_rows).alias("ranges")), "mix-sizes-below")
    # One row per distinct (source, size, doc_id), with how many there are: copies of a row do not pile up.
    entries = narrow.groupBy("source", "size", "code", "doc_id").count()
    place = F.floor(F.conv(F.substring("code", 1, 8), 16, 10).cast("long") * F.col("ranges") / F.lit(4294967296))
    entries = attach(entries, sizes, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).withColumn(
        "range", F.when(F.col("code") == "", F.lit(0)).otherwise(place).cast("long")).drop("s", "z")
    entries = stored(entries, "mix-entries")
    ranges = entries.groupBy("source", "size", "range").agg(F.sum("count").alias("n"))
    earlier = Window.partitionBy("source", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("range").alias("r"),
                           F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("source", "size", "range").orderBy("code", "doc_id")
    ranked = entries.withColumn("place", F.sum("count").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("count"))
    ranked = attach(ranked, ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("range") == F.col("r"))).select(
        "source", "size", "doc_id", "count", (F.col("below") + F.col("earlier") + F.col("place")).alias("rank"))
    return _take(keyed, ranked, totals, offset, bool(entries.where("count > 1").limit(1).count()))


def _take(keyed: DataFrame, ranked: DataFrame, totals: DataFrame, offset: float, repeats: bool) -> DataFrame:
    target = totals.select(F.col("source").alias("s"), "source_size", "source_rows", "target")
    ranked = attach(ranked, target, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("rs"), F.col("size").alias("rz"), F.col("doc_id").alias("rd"), F.col("count").alias("same"), "rank", "source_size", "source_rows", "target")
    on = F.col("source").eqNullSafe(F.col("rs")) & (F.col("size") == F.col("rz")) & F.col("doc_id").eqNullSafe(F.col("rd"))
    rows = keyed.join(ranked, on)
    if repeats:  # rows that share doc_id, source and size take the ranks of their entry in turn
        again = Window.partitionBy("source", "size", "doc_id").orderBy("row")
        repeated = rows.where("same > 1").withColumn("rank", F.col("rank") + F.row_number().over(again) - 1)
        rows = rows.where("same = 1").unionByName(repeated)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))

    half = F.floor(F.col("rank") / 2)
    place = F.when(F.col("rank") % 2 == 0, half).otherwise(F.col("source_rows") - 1 - half)
    crossed = F.floor((F.col("place") + 1) * rate + offset) - F.floor(F.col("place") * rate + offset)
    return rows.withColumn("place", place).select("row", "doc_id", "size", "source_size", "target", crossed.cast("long").alias("copies"))


def take_copies(mixed: DataFrame) -> DataFrame:
    """The mix itself: each input row as often as it was drawn, with the input's columns."""
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
