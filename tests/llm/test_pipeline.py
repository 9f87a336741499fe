"""The pipeline stage by stage, and the registered queries, on small tables with every odd case."""

import os
import random
from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from schedulesmith.llm import decontaminate as dc
from schedulesmith.llm import queries

from .test_decontaminate import brute
from .test_neardup import classes
from .test_quality import counts

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept string, shard string, row int, copies int, size int, key string, bucket int"


def word(rnd):
    return "".join(rnd.choice("abcdefghijk") for _ in range(rnd.randint(2, 8)))


def documents():
    rnd = random.Random(8)
    item = [word(rnd) for _ in range(20)]
    texts = []
    for i in range(90):
        base = [word(rnd) for _ in range(rnd.randint(60, 220))]
        texts.append(" ".join(base))
        if i % 6 == 0:
            texts += [" ".join(base)] * 2
        if i % 7 == 0:
            texts.append(" ".join(base[:-1] + [word(rnd)]))
        if i % 9 == 0:
            texts.append(" ".join(base[:30] + item + base[30:]))
    texts += [" ".join(w + "###" for w in texts[k].split()) for k in (2, 3)] + ["again and again " * 40, "", None, "short", None, "w " * 30_000]
    rows = [(i, t, "en", ["hot", "hot", "b", None][i % 4]) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[7], None, None), (None, " ".join(word(rnd) for _ in range(80)), "en", "hot"), (None, None, None, None)]
    return [(*r, len(r[1] or ""), "x", "y", 1, 2, 3, "k", 4) for r in rows], [(1, " ".join(item)), (2, None), (None, "zz yy")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows, items = documents()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def run_stage(spark, folder, k, rows, columns=COLUMNS):
    out = corpus_pipeline.STAGES[k][1](spark, spark.createDataFrame(rows, columns), folder)
    return out.columns, [tuple(r) for r in out.collect()]


def names():
    return [c.split()[0] for c in COLUMNS.split(", ")]


def test_quality_stage(spark, folder):
    rows, _ = documents()
    columns, got = run_stage(spark, folder, 0, rows)
    assert columns == names() and not Counter(got) - Counter(rows)
    lost = Counter(rows) - Counter(got)
    for r in lost:
        n, _, symbols, _, repeat = counts(r[1])
        assert n < 50 or 2 * repeat > n or symbols > 0.2 * n
    assert all(counts(r[1])[0] >= 50 for r in got)


def test_near_duplicate_stage(spark, folder):
    rows, _ = documents()
    columns, got = run_stage(spark, folder, 1, rows)
    assert columns == names() and not Counter(got) - Counter(rows)
    group = classes([r[1] for r in rows])
    members = defaultdict(list)
    for r, g in zip(rows, group):
        members[g if r[1] is not None else object()].append(r)
    assert len(got) == len(members)
    left = Counter(got)
    for rs in members.values():
        assert sum(left[r] for r in set(rs)) >= 1
        ids = [r[0] for r in rs if r[0] is not None]
        assert not ids or any(r[0] == min(ids) and left[r] for r in rs)


def test_decontamination_stage(spark, folder):
    rows, items = documents()
    columns, got = run_stage(spark, folder, 2, rows)
    known = [(str(i), dc.normal_words(t)) for i, t in items]
    hits = {r: brute(dc.normal_words(r[1]), known) for r in set(rows)}
    assert columns == names()
    assert Counter(got) == Counter(r for r in rows if not (hits[r][1] and 20 * hits[r][1] >= hits[r][0]))
    assert len(got) < len(rows)


def test_short_passages_of_kept_documents_are_cut(spark, folder):
    _, items = documents()
    item, rest = items[0][1], " ".join(f"rest{i}" for i in range(600))
    tail = (None, None, None, "x", "y", 1, 2, 3, "k", 4)
    rows = [(1, f"{rest} {item.upper()}, {rest}", *tail), (2, rest, *tail), (3, f"{rest} {' '.join(item.split()[:12])} {rest}", *tail)]
    _, got = run_stage(spark, folder, 2, rows)
    assert {r[0]: r[1] for r in got} == {1: f"{rest} , {rest}", 2: rest, 3: rows[2][1]}
    assert {r[0]: r[4] for r in got} == {1: len(rest) * 2 + 3, 2: None, 3: None}


def test_mix_and_shard_stages(spark, folder):
    rows, _ = documents()
    columns, got = run_stage(spark, folder, 3, rows)
    assert columns == names() and set(got) <= set(rows)
    assert all(n <= 2 * rows.count(r) for r, n in Counter(got).items())
    columns, dealt = run_stage(spark, folder, 4, got)
    assert columns == [*names(), "shard_", "slot"] and Counter(r[:-2] for r in dealt) == Counter(got)
    for k in range(5):
        assert run_stage(spark, folder, k, [])[1] == []


def test_run_and_rerun(spark, folder):
    first = corpus_pipeline.run(spark, folder)
    assert first.count() > 50 and first.select("shard_").distinct().count() == 16
    assert first.exceptAll(corpus_pipeline.run(spark, folder)).count() == 0


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_agree_with_their_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"create view {file.split('.')[0]} as select * from '{SF}/{file}'")
    want = con.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.Q[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    plain = lambda rows: sorted([tuple(f"{x:.9g}" if isinstance(x, float) else x for x in r) for r in rows], key=str)
    assert plain(got.select(*columns).collect()) == plain(want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
def test_queries_without_sql_return_every_row(spark):
    from schedulesmith.llm.common import read

    from .test_suffixes import brute as removed

    docs = {r.doc_id: r.text for r in read(spark, SF, "documents").collect()}
    ids = sorted(docs)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in queries.Q["op4_suffix_dedup"](spark, SF).collect()}
    assert got == {i: x[:3] for i, x in zip(ids, removed([docs[i] for i in ids], 400))}
    got = {r.doc_id: r.class_id for r in queries.Q["op7_near_duplicates"](spark, SF).collect()}
    assert got == {i: ids[g] for i, g in zip(ids, classes([docs[i] for i in ids]))}
    dealt = queries.Q["op3_two_pass_shards"](spark, SF).collect()
    assert sorted(r.doc_id for r in dealt) == ids and {r.law for r in dealt} == {"rows"}
    import zlib
    assert all(r.size == len((docs[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((docs[r.doc_id] or "").encode()) for r in dealt)
    assert {r.page_id for r in queries.Q["op1_main_text"](spark, SF).collect()} == {r.page_id for r in read(spark, SF, "pages").collect()}


def test_stages_are_stored_compressed(spark, folder):
    from pathlib import Path

    import pyarrow.parquet as pq

    corpus_pipeline.run(spark, folder)
    root = Path(spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    for name, _ in corpus_pipeline.STAGES:
        held = sorted(root.glob(f"pipeline-{name.replace(' ', '-')}-*"), key=lambda x: x.stat().st_mtime)[-1]
        metas = [pq.ParquetFile(f).metadata for f in held.glob("*.parquet")]
        codecs = {m.row_group(g).column(c).compression for m in metas for g in range(m.num_row_groups) for c in range(m.num_columns)}
        assert codecs == {"ZSTD"}
