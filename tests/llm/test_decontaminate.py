import hashlib
import random

from schedulesmith.llm import decontaminate as dc


def brute(tokens, items):
    hit, names = set(), set()
    for name, item in items:
        size = min(13, len(item))
        windows = {tuple(item[i:i + size]) for i in range(len(item) - size + 1)} if size else set()
        for i in range(len(tokens) - size + 1):
            if size and tuple(tokens[i:i + size]) in windows:
                hit.update(range(i, i + size))
                names.add(name)
    return len(tokens), len(hit), names


def corpus():
    rnd = random.Random(6)
    word = lambda: rnd.choice(["a", "B", "é", "x1", "of", "C"])
    items = [" ".join(word() for _ in range(n)) for n in (1, 2, 3, 12, 13, 14, 30, 30, 0)]
    items[0] = "Zebra"
    items += [items[6][4:], None, "!!"]
    docs = [None, "", "...", "zebra-Zebra"] + [" ".join(word() for _ in range(rnd.randrange(80))) for _ in range(30)]
    docs += [" ".join([word() for _ in range(rnd.randrange(200))] + items[k].upper().split() + [word()] * 3) for k in (3, 4, 5, 6, 7, 9)]
    return items, docs


def test_against_brute_force(spark):
    items, texts = corpus()
    benchmark = spark.createDataFrame([(100 - i, t) for i, t in enumerate(items)] + [(100, "Zebra")], "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as spans", "2 as n_words")
    known = [(str(100 - i), dc.normal_words(t)) for i, t in enumerate(items)]
    for limit in (400_000, 20):
        got = dc.find_contamination(docs, benchmark, automaton_words=limit).collect()
        assert len(got) == len(texts)
        for r in got:
            n, hit, names = brute(dc.normal_words(texts[r.row.doc_id]), known)
            assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(names)) and r.row.spans == 1
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
            assert r.contaminated == (hit > 0 and 20 * hit >= n)


def test_removal_and_empty_tables(spark):
    assert dc.remove_spans("One, two; three four.", [(1, 3)], 2) == "One,  four." and dc.remove_spans("a b", [(0, 1)], 2) == "a b" and dc.remove_spans(None, []) is None
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    r = dc.find_contamination(docs, none).first()
    assert (r.n_words, r.n_hit, r.contaminated) == (2, 0, False) and dc.find_contamination(docs.limit(0), none).count() == 0
