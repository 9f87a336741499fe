import random
from collections import defaultdict

import pytest
from schedulesmith.llm import suffixes


def brute(texts, length):
    where = defaultdict(int)
    data = [(t or "").encode() for t in texts]
    for d in data:
        for i in range(len(d) - length + 1):
            where[d[i:i + length]] += 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if where[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        runs = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), runs, kept))
    return out


def corpus():
    rnd = random.Random(11)
    noise = lambda n: "".join(rnd.choice("abcdé fgh\n") for _ in range(n))
    passage, base = noise(70), noise(300)
    texts = [None, "", "short", noise(39), noise(40), noise(500), "a" * 200, "ab" * 90, passage, noise(30) + passage + noise(50), noise(5) + passage]
    texts += [base, base, base + "x", noise(1) + base[3:]]
    for _ in range(25):  # near copies: some characters replaced
        copy = list(base)
        for p in rnd.sample(range(len(base)), rnd.randrange(1, 6)):
            copy[p] = rnd.choice("xyz")
        texts.append("".join(copy))
    texts += [noise(20) + passage[k:k + 41] + noise(20) for k in (0, 7, 29)] + [noise(60) + base[100:160] + noise(10) + base[100:160]]
    return texts


@pytest.mark.parametrize("group, piece", [(20_000, 1 << 20), (3, 1 << 20), (20_000, 64), (3, 100)])
def test_against_brute_force(spark, group, piece):
    texts = corpus()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 as key", "2 as spans").repartition(3)
    got = {r[0]: (r[1], r[2], r[3], bytes(r[4])) for r in suffixes.remove_repeated(docs, 40, 8, group, piece).collect()}
    assert got == dict(enumerate(brute(texts, 40)))


def test_repeated_rows_nulls_and_no_rows(spark):
    rows = [(None, "x" * 30 + "y" * 30), (1, "n" * 10), (1, "q1w2e3r4t5" * 5), (1, "q1w2e3r4t5" * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r[1:4] for r in suffixes.remove_repeated(docs, 40, 8).collect()), key=str)
    assert got == sorted([(60, 0, 0), (10, 0, 0), (50, 50, 1), (50, 50, 1)], key=str)
    assert suffixes.remove_repeated(docs.limit(0)).count() == 0


def test_deep_shallow_sort():
    rnd = random.Random(2)
    strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(0, 60))) for _ in range(200)]
    strings += [b"z" * 50 + bytes(rnd.choice(b"xyz") for _ in range(rnd.randrange(4))) for _ in range(100)]
    order, prefixes = suffixes.deep_shallow_sort(strings, shallow=16)
    assert [strings[i] for i in order] == sorted(strings) and sorted(order) == list(range(300))
    for k in range(1, 300):
        a, b = strings[order[k - 1]], strings[order[k]]
        shared = prefixes[k]
        assert a[:shared] == b[:shared] and a[shared:shared + 1] != b[shared:shared + 1] or a == b
