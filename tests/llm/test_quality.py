import random
import re
from collections import Counter

from pyspark.sql import functions as F
from schedulesmith.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    w = WORD.findall(text or "")
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {p + k for p in range(len(w) - 2) if grams[tuple(w[p:p + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_counts_against_brute_force(spark):
    rnd = random.Random(3)
    texts = [None, "", " \t\n", "a", "a b", "a b c a b c", "x " * 500, "  é\x00 \x0b|", "l1\nl1\n \nl1\r\n"]
    texts += ["".join(rnd.choice(["a", "bb", "é", "#", " ", "\n", "\t"]) for _ in range(rnd.randrange(300))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "1 as kept", "2 as n_words")
    got = quality.quality_rules(docs).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "row.kept").collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[1:6]) == counts(texts[r[0]]) and r[7] == 1
        assert r[6] == (r[1] < 50 or 100 * r[5] > 50 * r[1])


def test_thresholds_adapt_and_keep_clean_documents(spark):
    rnd = random.Random(5)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    rows = [(i, prose(rnd.randint(60, 200)), "en", "hot") for i in range(300)] + [(1000 + i, prose(100), None, None) for i in range(4)]
    rows += [(2000 + i, " ".join(w + "###" for w in prose(100).split()), "en", "hot") for i in range(20)]
    rows += [(3000, prose(100).replace(" ", ""), "en", "hot"), (3001, "\n".join([prose(60)] + ["x"] * 0), "en", "small"), (4000, None, "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r[0] for r in quality.quality_rules(docs).where("kept").select("row.doc_id").collect()}
    assert kept == {*range(300), *range(1000, 1004), 3001}
    assert quality.quality_rules(docs.limit(0)).count() == 0


def test_sketches_merge_and_are_near_the_quantiles(spark):
    values = [random.Random(i).lognormvariate(0, 1) for i in range(2000)]
    names = [f.measure for f in quality.FENCES]
    scored = spark.createDataFrame([("en", f"s{i % 2}", False, *[v] * 4) for i, v in enumerate(values)],
                                   "lang_ string, source_ string, base_failed boolean, " + ", ".join(f"{n} double" for n in names))
    parts = quality.sketch(scored.where("source_ = 's0'")).union(quality.sketch(scored.where("source_ = 's1'")))
    merged = parts.withColumn("source_", F.lit("s")).groupBy("lang_", "source_", "measure", "bin").agg(F.sum("n").alias("n"))
    limits = quality.thresholds(merged).first()["limits"]
    values.sort()
    q1, q3, s50, s90 = values[499], values[1499], values[999], values[1799]
    assert abs(limits["word_length_max"] - (q3 + 3 * (q3 - q1))) < 0.1 * q3 and abs(limits["word_length_min"] - (q1 - 3 * (q3 - q1))) < 0.1 * q3
    for name in ("dup_line_share_max", "repeat_share_max", "symbols_per_word_max"):
        assert abs(limits[name] - (s90 + 2 * (s90 - s50))) < 0.1 * s90


def limits_of(spark, rows):
    names = [f.measure for f in quality.FENCES]
    scored = spark.createDataFrame(rows, "lang_ string, source_ string, base_failed boolean, " + ", ".join(f"{n} double" for n in names))
    return {r.source_: r.limits for r in quality.thresholds(quality.sketch(scored)).collect()}


def test_limits_follow_the_spread_of_the_source(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(200):
        # Even prose, prose and code with symbols and repeats, and a source of few documents.
        rows.append(("en", "even", False, 0.0, rnd.gauss(5, 0.1), 0.0 if i % 2 else 0.1, 0.0))
        rows.append(("en", "code", False, abs(rnd.gauss(0.8, 0.2)), rnd.gauss(6, 0.8), 0.0 if i % 2 else rnd.uniform(0.1, 0.4), 0.0))
    rows += [("en", "few", False, 0.0, 30.0, 0.0, 0.0)] * 3 + [("en", "spam", False, 0.0 if i % 20 else 2.0, 5.0, 0.0, 0.0) for i in range(400)]
    got = limits_of(spark, rows)
    assert got["code"].symbols_per_word_max > 1 > got["even"].symbols_per_word_max > 0
    assert got["even"].word_length_max < 6 < 8 < got["code"].word_length_max
    assert got["even"].dup_line_share_max < 0.11 < 0.4 < got["code"].dup_line_share_max
    assert got["few"].word_length_max < 20  # three documents take the limits of their language
    assert got["spam"].symbols_per_word_max < 0.2 and got["spam"].word_length_min < 5 < got["spam"].word_length_max
    assert all(x.repeat_share_max is None for x in got.values())  # nobody has any


def test_clean_labelled_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left")
    judged = quality.quality_rules(docs).where("not base_failed").groupBy("row.quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    shares = {r.quality: r.kept for r in judged}
    assert shares[1] >= 0.98 and shares[0] <= 0.1
