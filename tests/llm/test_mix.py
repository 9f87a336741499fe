from collections import defaultdict

from pyspark.sql import functions as F
from schedulesmith.llm import mix

SCHEMA = "doc_id long, source string, size long"


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mix.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, stopped = {}, set()
    left = 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in stopped]
        rest = left - sum(2 * sizes[s] for s in stopped)
        total = sum(weight[s] for s in open_)
        target = {s: 2 * sizes[s] if s in stopped else rest * weight[s] / total for s in names}
        above = {s for s in open_ if target[s] > 2 * sizes[s]}
        if not above:
            return target
        stopped |= above


def test_targets_and_taken(spark):
    rows = [(i, ["b", "a", None, "é", "Z"][i % 5 if i < 400 else 0], (i * 37) % 900) for i in range(900)] + [(7, "q", 50)] * 300 + [(None, "q", 60)] * 40
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mix.mix(docs, size=F.col("size"), group_rows=16).select("doc_id", F.col("row.source").alias("source"), "size", "source_size", "target", "copies").collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
        assert 0 <= r.copies <= 2
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 900
    same = sorted(map(str, got))
    assert sorted(map(str, mix.mix(docs.repartition(5), size=F.col("size"), group_rows=64).select("doc_id", F.col("row.source").alias("source"), "size", "source_size", "target",
                                                                                                "copies").collect())) == same


def test_copies_keep_the_columns(spark):
    rows = [(1, "a b c", "s"), (2, None, None), (None, "", "s"), (3, "x y", "t"), (3, "x y", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "9 as copies", "8 as rank", "7 as size")
    mixed = mix.mix(docs)
    assert mixed.count() == 5
    out = mix.take_copies(mixed)
    assert out.columns == docs.columns and all(r.copies == 9 for r in out.collect())
    assert mix.take_copies(mix.mix(docs.limit(0))).count() == 0
