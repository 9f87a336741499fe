import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pyspark.sql import functions as F
from schedulesmith.llm import packing, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    """The vocabulary as it stands, used alone."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def check(pieces, docs, plain, tiers=packing.TIERS, slack=packing.SLACK, short=1):
    """Every id in one piece, no gap in a sequence, windows full; returns the padding."""
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
        assert len(p.ids) == 4 * p.length > 0
    assert set(by_doc) == {d for d, _ in docs}
    wanted = defaultdict(list)
    for d, text in docs:
        wanted[d].append(plain(text))
    for d, want in wanted.items():
        if len(want) == 1:
            parts = sorted(by_doc[d], key=lambda p: p.start)
            assert [p.start for p in parts] == [sum(q.length for q in parts[:i]) for i in range(len(parts))]
            assert np.concatenate([np.frombuffer(p.ids, "<u4") for p in parts]).tolist() == want[0]
            assert {p.doc_tokens for p in parts} == {len(want[0])}
        else:
            assert sum(p.length for p in by_doc[d]) == sum(map(len, want))
    padding, loose = 0, 0
    for parts in sequences.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == [sum(q.length for q in parts[:i]) for i in range(len(parts))]
        tier, n = parts[0].tier, sum(p.length for p in parts)
        assert {p.tier for p in parts} == {tier} and tier in tiers and n <= tier
        if tier != tiers[-1]:
            assert n == tier
        loose += n < tier - slack
        padding += tier - n
    assert loose <= short
    return padding


def test_all_documents(spark, plain):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = packing.pack(table).collect()
    docs = [(r.doc_id, r.text) for r in table.collect()]
    assert check(pieces, docs, plain) < 2048 + 8 * len({p.sequence_id for p in pieces})
    got = {tuple(r) for r in queries.Q["op11_hierarchical_packing"](spark, SF).select("doc_id", "start", "length", "ids_crc32", "sequence_id", "offset").collect()}
    assert got == {(p.doc_id, p.start, p.length, zlib.crc32(p.ids), p.sequence_id, p.offset) for p in pieces}


def test_odd_rows(spark, plain):
    rnd = random.Random(3)
    rows = [(1, None), (2, ""), (3, "a <|endoftext|> b"), (4, " " * 50_000), (5, "word " * 90_000), (6, "x" * 30_000), (None, "null key"),
            (7, "again"), (7, "again"), (8, "é中\U0001f600\n\n \t" * 300), (9, "tail \n"), (10, "don't  stop" * 4000)]
    rows += [(100 + i, "copy of one text " * 30) for i in range(300)]
    rows += [(1000 + i, " ".join(rnd.choice(["alpha", "Beta", "42", "%%", "güte"]) for _ in range(rnd.randint(0, 900)))) for i in range(200)]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, ids string, start int, open int").repartition(5)
    pieces = packing.pack(docs).collect()
    check(pieces, rows, plain)
    assert packing.pack(docs.limit(0)).collect() == []
    # Small pools, other tiers, no slack: still at most one short window for each pool of leftovers.
    small = packing.pack(docs, tiers=(8, 16, 32), slack=0, pool=16).collect()
    check(small, rows, plain, (8, 16, 32), 0, 5)


def test_text_that_one_library_refuses(plain):
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    for text in (" " * 1_000_000, "ab  cd\n" * 30_000, "\x1c \x1d" * 40_000):
        assert packing.token_ids(text, paths).tolist() == plain(text)


def test_step_groups_are_even(spark):
    rnd = random.Random(5)
    docs = spark.createDataFrame([(i, "some words go here " * rnd.randint(1, 400)) for i in range(1500)], "doc_id long, text string").coalesce(1)
    groups = packing.pack(docs, group_tokens=32 * 2048).groupBy("step_group").agg(
        F.sum("length").alias("n"), F.sum(F.col("length") * F.col("length")).alias("cost")).where("n > 40000").collect()
    assert len(groups) > 8
    assert max(g.n for g in groups) < 1.2 * min(g.n for g in groups)
    assert max(g.cost for g in groups) < 1.3 * min(g.cost for g in groups)
