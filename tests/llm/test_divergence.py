import random
import re
import tracemalloc
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq

from schedulesmith.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, value int"


def brute(rows, min_docs, top):
    """The contract, document by document."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))) for _, text, lang, source, *_ in rows]
    seen = defaultdict(Counter)
    for lang, _, words in docs:
        seen[lang].update(set(words))
    kept = {lang: sorted(t for t, n in c.items() if n >= min_docs) for lang, c in seen.items()}
    counts = defaultdict(Counter)
    for lang, source, words in docs:
        counts[lang, source].update(w for w in words if w in set(kept[lang]))
    whole = defaultdict(Counter)
    for (lang, _), c in counts.items():
        whole[lang].update(c)

    def share(c, t, v):
        return 1 + 1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * v)

    out = set()
    for lang, source in counts:
        terms, v = kept[lang], len(kept[lang])
        mine = {t: share(counts[lang, source], t, v) for t in terms}
        pairs = [(o, sum(abs(mine[t] - share(counts[lang, o], t, v)) for t in terms)) for g, o in counts if g == lang and o != source]
        above = [(t, mine[t] - share(whole[lang], t, v)) for t in terms if counts[lang, source][t] and mine[t] > share(whole[lang], t, v)]
        for part, items, most in (("pair", pairs, None), ("term", above, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out |= {(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(items[:most])}
    return out


def corpus():
    rnd = random.Random(4)
    stems = ["".join(rnd.choice("abcdé中Z") for _ in range(rnd.randint(1, 40))) for _ in range(60)]
    rows = []
    for i in range(400):
        words = [rnd.choice(stems) + rnd.choice(["", "", "s", "ing", "A" * 30]) for _ in range(rnd.randint(0, 60))]
        rows.append((i, rnd.choice([" ", "-", "1", "\n"]).join(words), ["en", "fr", None, ""][min(3, i % 5)], ["hot", "hot", "b", None, "é"][i * i % 5]))
    rows += [(1000 + i, "same copy of it", "en", "hot") for i in range(200)]
    rows += [rows[3]] * 3 + [(None, None, None, None), (5, None, "xx", "q"), (6, "", "xx", "r"), (7, "rare words only", "yy", "only"), (8, "w" * 200_000 + " end", "en", "b")]
    rows += [(20 + i, "v" * 5000 + " " + "v" * 4999, "en", "b") for i in range(4)]
    return [(*r, "t", 1) for r in rows]


def test_audit_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for min_docs, options in ((3, {}), (30, {"held_bytes": 40_000, "block_rows": 16})):
        got = divergence.audit(docs, min_docs=min_docs, top=7, **options).collect()
        want = brute(rows, min_docs, 7)
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert divergence.audit(docs.limit(0)).collect() == []
    assert divergence.audit(docs.where("lang = 'xx'")).count() == 2


def test_prefixes_below_the_threshold_are_not_extended(spark):
    rows = [(f"commonest and unique{'abcdefghij'[i]}{'klmnopqrst'[j]}xyzxyz", "en") for i in range(10) for j in range(3)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    table = divergence.term_table(docs.selectExpr("text", "lang", "'s' as source"))
    assert {tuple(r) for r in divergence.kept_terms(table, 30).collect()} == {("en", "commonest"), ("en", "and")}
    counted = table.mapInArrow(
        divergence._prefix_counter(4, 12, divergence._filter(spark.createDataFrame([("en", bytearray(b"comm"))], "lang string, prefix binary")), 1 << 20),
        "lang string, prefix binary, docs long")
    assert {bytes(r.prefix) for r in counted.collect()} == {b"commonest\0"}


def test_shares_are_exact_beyond_doubles(spark):
    big = 4 * 10 ** 15 + 1
    row = spark.createDataFrame([(big, 2 * big + 7, 9)], "n long, total long, v long").select(divergence._share("n", "total", "v").alias("p")).first()
    assert row.p == 1 + 10 ** 9 * (big + 5) // (2 * big + 7 + 45)


def test_runs_reach_python_one_after_another(spark):
    key, before = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.createDataFrame([(f"w{'abcdefghijklmnop'[i]}x " * 250_000, "en", "s") for i in range(16)], "text string, lang string, source string").coalesce(1)
    table = divergence.term_table(docs)
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in table.inputFiles()]
    rows = sum(f.num_rows for f in files)
    assert rows > 2 and sum(f.num_row_groups for f in files) == rows
    with divergence._small_batches(spark):
        sizes = docs.select("text").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert len(sizes) > 2 and max(r.n for r in sizes) < 2 * divergence.BATCH_BYTES
    assert spark.conf.get(key) == before


def test_counts_are_held_as_arrays():
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=18)) for _ in range(400_000)]
    texts = [" ".join(words[i:i + 1000]).encode() for i in range(0, len(words), 1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(["s"] * len(texts)), pa.array(texts, pa.binary())], ["lang", "source", "text"])
    runs = list(divergence._tables(iter([batch])))
    tracemalloc.start()
    try:
        n = sum(b.num_rows for b in divergence._prefix_counter(0, 24, None, 4 << 20)(iter(runs)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 400_000 and peak < 50e6


def test_tasks_without_a_living_term(spark):
    rows = [(i, "commonest word", "en", "ab"[i % 2]) for i in range(6)] + [(6, "rarest of all", "en", "a"), (7, "another one", "fr", "a"), (8, "- 1", "en", "b")]
    docs = spark.createDataFrame([(*r, "t", 1) for r in rows], SCHEMA).repartition(9, "doc_id")
    assert {tuple(r) for r in divergence.audit(docs, min_docs=3, top=7).collect()} == brute([(*r, "t", 1) for r in rows], 3, 7)
    assert list(divergence._counted(iter([([("en",)], divergence.np.zeros(0, int), pa.array([], pa.binary()), divergence.np.zeros(0, int))]), 10,
                                    ["lang", "prefix", "docs"], [pa.string(), pa.binary(), pa.int64()])) == []
