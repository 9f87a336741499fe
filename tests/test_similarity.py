import numpy as np
import pytest

from schedulesmith.functions import similarity as sim


def vectors(spark, name, data):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], f"{name} bigint, vector array<double>")


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(12, 16))
    return heads[rng.integers(0, 12, n)] + rng.normal(size=(n, 16)) * 0.05


def want(q, c, k, limit, metric):
    if metric == "cosine":
        sims = (q @ c.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(c, axis=1)[None, :]
        keep = sims >= limit
    else:
        sims = np.maximum(0, 1 - ((q[:, None] - c[None]) ** 2).sum(-1) / 2)
        keep = sims > limit
    order = np.argsort(-np.round(sims, 9), axis=1, kind="stable")[:, :k]
    return {(i, r + 1): int(j) for i in range(len(q)) for r, j in enumerate(order[i]) if keep[i, j]}


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_exact_with_many_blocks(spark, metric):
    q, c = clustered(300, 1), clustered(400, 2)
    if metric == "l2":
        q, c = (x / np.linalg.norm(x, axis=1)[:, None] for x in (q, c))
    c[50:60] = c[40]  # ties
    hits = sim.similarity_topk(vectors(spark, "qid", q), vectors(spark, "cid", c), "qid", "cid", 4, 0.6, metric=metric, block=16, query_block=32)
    assert {(r.qid, r["rank"]): r.cid for r in hits.collect()} == want(q, c, 4, 0.6, metric)


def test_the_corpus_goes_only_where_it_is_needed(spark):
    q, c = vectors(spark, "qid", clustered(600, 3)), vectors(spark, "cid", clustered(500, 4))
    rows, old = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("4", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            left, right = sim.routed(q, c, "qid", "cid", 0.9, block=16, query_block=32)
            blocks = left.select("_q").distinct().count()
            rows.append((right.count(), blocks))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert rows[0] == rows[1]
    shuffled, blocks = rows[0]
    assert 12 <= blocks <= 600 // 32 + 2
    assert shuffled < 0.35 * blocks * 500


def test_unusable_vectors_match_nothing(spark):
    schema = "cid bigint, vector array<double>"
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [0.0, 0.0]), (6, [float("inf"), 0.0])], schema)
    q = c.withColumnRenamed("cid", "qid")
    got = sim.similarity_topk(q, c, "qid", "cid", 3, 0.5).collect()
    assert [(r.qid, r.cid) for r in got] == [(1, 1)]
    assert sim.similarity_topk(q, c.limit(0), "qid", "cid", 3, 0.5).count() == 0 == sim.similarity_topk(q.limit(0), c, "qid", "cid", 3, 0.5).count()


def test_units_of_pieces_are_exact_and_send_queries_less_often(spark):
    rng = np.random.default_rng(5)
    q, c = rng.normal(size=(150, 8)), rng.normal(size=(400, 8))
    c[50:60] = c[40]
    for limit in (-1.0, 0.5):
        hits = sim.similarity_topk(vectors(spark, "qid", q), vectors(spark, "cid", c), "qid", "cid", 4, limit, block=16, query_block=32, unit=100)
        assert {(r.qid, r["rank"]): r.cid for r in hits.collect()} == want(q, c, 4, limit, "cosine")
    sent = [sim.routed(vectors(spark, "qid", q), vectors(spark, "cid", c), "qid", "cid", -1.0, block=16, query_block=32, unit=u)[0].count() for u in (16, 100)]
    assert sent[1] <= 150 * 8 < sent[0]


def test_blocks_grow_with_the_rows_within_bounds():
    facts = [(np.zeros(64), 0.0, 0.0, 1, 1)]
    assert [sim._grown(n, 4096, facts) for n in (1, 65_536, 160_000, 10 ** 9)] == [4096, 4096, 10_000, 32_768]
    assert sim._grown(10 ** 9, 4096, [(np.zeros(4096), 0.0, 0.0, 1, 1)]) == 4096
