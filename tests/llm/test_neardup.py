import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from schedulesmith.llm import neardup

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def features(text):
    w = WORD.findall(text.encode())
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def classes(texts, limit=0.8):
    """Brute force: weighted Jaccard similarity of all pairs, connected components."""
    bags = [features(t) if t is not None else None for t in texts]
    df = Counter(s for b in bags if b for s in b)
    n = sum(b is not None for b in bags)
    weight = {s: min(1, max(neardup.FLOOR, math.log(n / c) / math.log(1 / neardup.COMMON))) for s, c in df.items()}
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] is None or texts[j] is None:
                continue
            low = sum(weight[s] * min(c, bags[j][s]) for s, c in bags[i].items() if s in bags[j])
            high = sum(weight[s] * c for b in (bags[i], bags[j]) for s, c in b.items()) - low
            if texts[i] == texts[j] or (high and low / high >= limit):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def corpus(seed=4):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(1, 9)))
    texts = [None, None, "", "", " ", "one", "one", "one two", "w " * 50, "w " * 51]
    for _ in range(12):
        base = [word() for _ in range(rnd.randint(60, 200))]
        texts.append(" ".join(base))
        for _ in range(rnd.randrange(8)):
            copy = list(base)
            for _ in range(rnd.randrange(1, 4)):
                copy[rnd.randrange(len(copy))] = word()
            texts.append("\n".join(copy))
    passage = [word() for _ in range(60)]
    texts += [" ".join([word() for _ in range(80)] + passage + [word() for _ in range(40)]) for _ in range(20)]
    return texts


def run(docs, **options):
    out = neardup.near_duplicates(docs, **options)
    return {(r["text_first"], r["class_first"], r["class_docs"]) for r in out.collect()}


def test_classes_against_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as key", "'x' as bands").repartition(4)
    want = classes(texts)
    sizes = Counter(want)
    expected = {(texts.index(t), want[i], sizes[want[i]]) for i, t in enumerate(texts) if t is not None}
    assert run(docs) == expected
    assert run(docs, block=2) == expected
    assert run(docs.limit(0)) == set()


def test_hot_groups_against_plain_similarity(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(8))

    def changed(base, places):
        return " ".join(word() if i in places else w for i, w in enumerate(base))

    base, other = [[word() for _ in range(100)] for _ in range(2)]
    variants = [changed(base, {5 + 6 * i}) for i in range(15)]  # any two: 86 of 106 shingles
    copies = [" ".join(other)] * 15 + [changed(other, {20, 60})]  # 86 of 106
    texts = variants + copies + [changed(base, set(range(100))) for _ in range(14)]
    bags = [features(t) for t in texts]
    plain = lambda a, b: (a & b).total() / (a | b).total()
    assert all(0.8 <= plain(a, b) < 0.84 for a in bags[:15] for b in bags[:15] if a is not b) and 0.8 <= plain(bags[15], bags[30]) < 0.8235
    want = [min(j for j, b in enumerate(bags) if plain(a, b) >= 0.8) for a in bags]
    sizes = Counter(want)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert run(docs) == {(texts.index(t), want[i], sizes[want[i]]) for i, t in enumerate(texts)}
    assert len(set(classes(texts))) > len(set(want))  # the weights alone would part them


def test_samples_agree_as_often_as_weighted_similarity():
    rnd = np.random.default_rng(1)
    codes = rnd.integers(0, 1 << 48, 400, dtype=np.uint64)
    a, b = rnd.gamma(2, 1, 400), rnd.gamma(2, 1, 400)
    b[:200] = a[:200]
    samples = neardup.consistent_samples(np.concatenate([codes, codes]), np.concatenate([a, b]), np.array([0, 400]), 3000)
    assert abs((samples[0] == samples[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_shingles_are_those_of_the_words():
    texts = ["a b c d e f", None, "x" * 100 + " y", "", "a  b\tc\nd e f ", "é é é é é é"]
    (low, data, offsets), = neardup.chunks(pa.array(texts))
    codes, text = neardup.shingles(data, offsets)
    per = [list(codes[text == i]) for i in range(len(texts))]
    assert [len(p) for p in per] == [2, 0, 1, 0, 2, 2] and per[0] == per[4] and per[5][0] == per[5][1] and len({per[0][0], per[0][1], per[2][0]}) == 3


def test_common_shingles_are_exact(spark):
    rnd = random.Random(9)
    common = "this line is on many of the pages here"
    texts = [(" ".join(str(rnd.random()) for _ in range(5)) + (f" {common}" if i % 3 == 0 else ""),) for i in range(1500)]
    docs = spark.createDataFrame(texts, "text string").repartition(4)
    codes, n, total = neardup.common_shingles(docs)
    assert total == 1500 and set(n) == {500.0} and len(codes) == 5


def test_components(spark):
    links = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(0, 60) if i != 30] + [("900", "901"), ("901", "900")], "a string, b string")
    got = dict(neardup.connected(links).collect())
    assert got == {f"{i:03}": "000" if i <= 30 else "031" for i in range(61)} | {"900": "900", "901": "900"}


def test_a_large_bucket_is_compared_block_by_block_only_where_needed(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(8))
    base = [word() for _ in range(120)]
    change = lambda text, places: [word() if i in places else w for i, w in enumerate(text)]
    # A family around one text, one that hangs on to it by a single link, and texts that share much with it but too little.
    texts = [" ".join(change(base, {i % 120})) for i in range(60)]
    bridge = change(base, {3, 9, 15})
    texts += [" ".join(bridge), " ".join(change(bridge, {60, 70, 80}))]
    texts += [" ".join(change(base, set(range(k, 120, 9)))) for k in range(9)]
    want = classes(texts)
    sizes = Counter(want)
    expected = {(texts.index(t), want[i], sizes[want[i]]) for i, t in enumerate(texts)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for block in (3, 8):
        assert run(docs, block=block) == expected


def test_every_shingle_weighs_by_its_document_frequency(spark):
    rnd = random.Random(3)
    words = lambda n: [" ".join("".join(rnd.choice("abcdefghij") for _ in range(8)) for _ in range(n))]
    base, one, two = words(128), words(16), words(16)
    # The two share 124 of 156 shingles, less than 0.8; those they do not share are mostly in 31 of the 200 texts.
    texts = [" ".join(base + one), " ".join(base + two)] + [" ".join(words(30) + (one, two)[i % 2]) for i in range(60)] + [words(10)[0] for _ in range(138)]
    bags = [features(t) for t in texts]
    df = Counter(s for b in bags for s in b)
    assert max(df.values()) == 31 < neardup.COMMON * len(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    for parts in (1, 7):
        signed = neardup.signatures(docs.selectExpr("md5(text) as key", "doc_id", "text"), len(texts), parts).collect()
        got = {r.doc_id: (r.alone, sorted(r.frequencies)) for r in signed}
        assert got == {i: (sum(df[s] == 1 for s in b), sorted(df[s] for s in b if df[s] > 1)) for i, b in enumerate(bags)}
    weight = lambda bag: sum(c * neardup.weight_of(df[s], len(texts)) for s, c in bag.items())
    a, b = bags[:2]
    assert (a & b).total() / (a | b).total() < 0.8 < 0.805 < weight(a & b) / weight(a | b)
    assert run(docs) == {(0, 0, 2), (1, 0, 2)} | {(i, i, 1) for i in range(2, len(texts))}
