import random
from base64 import b32encode
from collections import defaultdict
from hashlib import sha1

from schedulesmith.llm import warc

SCHEMA = "page_id long, url string, html string"


def test_round_trip(spark):
    rnd = random.Random(2)
    bodies = [None, "", "a\r\n\r\nWARC/1.1\r\n", "é" * 5000, "x", "\x00\n"] + [str(rnd.random()) for _ in range(10)]
    rows = [(i, rnd.choice(["http://www.B.org/x?a#f", "https://a.org", None, "http://a.org/\r\nX: 1", "bad url"]), rnd.choice(bodies)) for i in range(200)]
    pages = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as digest", "2 as bytes").repartition(4)
    folder = warc.write_warc(pages)
    got = {r.page_id: r for r in warc.merge_index(warc.read_warc(spark, folder, payloads=True), 5).collect()}
    latest = defaultdict(int)
    for i, _, h in rows:
        latest[h or ""] = max(latest[h or ""], i)
    assert len(got) == 200
    for i, _, h in rows:
        data, r = (h or "").encode(), got[i]
        first = latest[h or ""]
        assert (r.payload_bytes, r.payload_digest) == (len(data), b32encode(sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first == i else ("revisit", first))
        assert r.payload == ((h or "") if first == i else "")
    order = sorted(got.values(), key=lambda r: r.index_at)
    assert [r.index_at for r in order] == list(range(200))
    assert [(r.url_key, r.captured, r.page_id) for r in order] == sorted((r.url_key, r.captured, r.page_id) for r in order)


def test_small_payloads_nulls_and_repeats(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc"), (4, "u", "abc"), (None, "u", "abc"), (None, None, None)]
    folder = warc.write_warc(spark.createDataFrame(rows, SCHEMA), revisit_bytes=3)
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.read_warc(spark, folder).collect()), key=str)
    assert got == sorted([(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None), (4, "response", None), (None, "revisit", 4),
                          (None, "response", None)], key=str)
    empty = warc.write_warc(spark.createDataFrame([], SCHEMA))
    assert warc.merge_index(warc.read_warc(spark, empty)).count() == 0


def test_loser_tree():
    rnd = random.Random(3)
    for runs in ([], [[]], [[(1,)]], [[(1,), (2,)], [], [(1,)]], [sorted((rnd.randrange(50),) for _ in range(rnd.randrange(20))) for _ in range(13)]):
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)
