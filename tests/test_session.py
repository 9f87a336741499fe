import random

import pytest
from pyspark.sql import functions as F

import schedulesmith.session as session
from schedulesmith.functions import ops, similarity
from schedulesmith.operators import review, structure
from schedulesmith.schema import KEYS, OUTPUT_SCHEMA, TARGET_FIELDS, corpus


def hot(spark, n=4000):
    """A third of all rows sit on one sheet."""
    rng = random.Random(4)
    rows = [("f", "hot" if rng.random() < 0.33 else f"s{rng.randrange(40)}", i * 50) for i in range(n)]
    return rows, spark.createDataFrame(rows, "file_id string, sheet_name string, row_idx bigint").repartition(6)


def test_salted_join_equals_broadcast_join(spark):
    _, data = hot(spark)
    side = data.groupBy(*KEYS).agg(F.max("row_idx").alias("top"))
    for how in ("inner", "left"):
        small = session.attach(data, side, KEYS, how)
        salted = session.attach(data, side, KEYS, how, max_rows=1)
        assert sorted(map(tuple, small.collect())) == sorted(map(tuple, salted.collect()))
    assert not session.is_small(side, 1) and session.is_small(side, 1000)


def test_first_rows_against_sorting(spark):
    rows, data = hot(spark)
    got = {}
    for r in session.first_rows(data, KEYS, 7).collect():
        got.setdefault(r.sheet_name, []).append((r["_rank"], r.row_idx))
    want = {}
    for _, sheet, at in rows:
        want.setdefault(sheet, []).append(at)
    assert {s: sorted(v) for s, v in got.items()} == {s: list(enumerate(sorted(v)[:7], 1)) for s, v in want.items()}


def test_checkpoint_folder_comes_from_the_session(spark):
    assert session.settle(spark.range(5)).count() == 5
    context = spark.sparkContext
    assert context.getCheckpointDir() is not None

    class Context:
        master, used = "spark://cluster:7077", None

        def getCheckpointDir(self):
            return self.used

        def setCheckpointDir(self, folder):
            self.used = folder

    class Frame:
        def __init__(self, conf):
            self.sparkSession = type("Session", (), {"sparkContext": Context(), "conf": conf})

        def checkpoint(self, eager):
            return self.sparkSession.sparkContext.used

    class Conf(dict):
        pass

    assert session.settle(Frame(Conf({"spark.checkpoint.dir": "hdfs:///shared"}))) == "hdfs:///shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.settle(Frame(Conf()))


def test_fixed_values():
    assert len(TARGET_FIELDS) == 17 and [f.name for f in OUTPUT_SCHEMA] == TARGET_FIELDS
    assert len(corpus()) == 164 and all(f.nullable for f in OUTPUT_SCHEMA)
    assert len(ops.WHITELIST) == 12 and similarity.token_sort_ratio("", "") == 100.0
    assert similarity.token_sort_ratio("a b", "b a") == 100.0
    assert set(review.TEXTS) - {""} <= ops.WHITELIST and structure.MAX_HEADER_ROWS == 30


def test_figures_of_a_row_are_not_computed_for_each_of_its_cells(spark):
    """The first filled cell of a row is found below the generator of its cells."""
    rows = spark.createDataFrame([("f", "s", i, [str(i), None, "x"]) for i in range(9)], "file_id string, sheet_name string, row_idx bigint, values array<string>")
    headers = spark.createDataFrame([("f", "s", 9, 3, 0)], "file_id string, sheet_name string, n_rows bigint, n_cols int, header_row bigint")
    for figures in (structure.sheet_figures(rows, headers), structure.below_header(rows, headers)):
        plan = figures._jdf.queryExecution().optimizedPlan().toString()
        assert 0 <= plan.index("Generate") < plan.index("array_position")


def test_limit_of_generated_methods(spark):
    limit = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(limit)
    try:
        spark.conf.unset(limit)
        session.compiled_methods(spark)
        assert spark.conf.get(limit) == "8000"
        spark.conf.set(limit, "20000")
        session.compiled_methods(spark)
        assert spark.conf.get(limit) == "20000"
    finally:
        spark.conf.set(limit, before)
