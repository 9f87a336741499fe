from collections import Counter

from schedulesmith.llm import shards


def deal(docs, **options):
    return [(r["row"], r["shard"], r["slot"]) for r in shards.shuffle_into_shards(docs, **options).collect()]


def check(got, n, count=16):
    assert len(got) == n
    sizes = Counter(s for _, s, _ in got)
    assert max(sizes.values()) - min([sizes.get(s, 0) for s in range(count)]) <= 1
    for s in sizes:
        assert sorted(slot for _, shard, slot in got if shard == s) == list(range(sizes[s]))


def test_rows_are_dealt_evenly_and_at_random(spark):
    rows = [(i, f"text {i}" * (i % 7), i % 5) for i in range(1003)] + [(None, None, 1), (None, "", 1), (7, "again", 2), (7, "again", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(3)
    got = deal(docs)
    check(got, 1007)
    assert Counter(tuple(r) for r, _, _ in got) == Counter(rows)
    place = {r[0]: s * 1000 + slot for r, s, slot in got if r[0] is not None}
    order = sorted(range(1003), key=place.get)
    assert 200 < sum(a < b for a, b in zip(order, order[1:])) < 800
    again = deal(docs.repartition(5, "doc_id"))
    assert {(tuple(r), s, slot) for r, s, slot in again} == {(tuple(r), s, slot) for r, s, slot in got}
    assert deal(docs, seed=8) != got


def test_copies_of_one_row_are_split(spark):
    docs = spark.range(40).selectExpr("cast(1 as long) as doc_id", f"repeat('x', 200000) as text")
    got = deal(docs, bucket_bytes=1 << 20)
    check(got, 40)


def test_few_or_no_rows(spark):
    docs = spark.createDataFrame([(i, "a") for i in range(5)], "doc_id long, text string")
    check(deal(docs), 5)
    assert deal(docs.limit(0)) == []
