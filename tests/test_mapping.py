import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from schedulesmith.functions import similarity as sim
from schedulesmith.functions.text import normalize_header_text
from schedulesmith.operators import mapping as m
from schedulesmith.operators import memory as mem
from schedulesmith.schema import corpus

HEADERS = ["Year of Construction", "Reference No.", "Building Value ($)", "Account Name", "# Buildings", "Const Type",
           "Other Insured Value", "Latitude", "TOTAL", "Bldg Value", "ZZZZXXXXXQQQQ", "Loc #", "Yr Blt", "Bldg Repl Cost"]


def slow_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_subsequence_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choice("abcé ") for _ in range(rng.randrange(0, 14)))
        b = "".join(rng.choice("abcé ") for _ in range(rng.randrange(0, 14)))
        assert sim.common_subsequence(a, b) == slow_lcs(a, b)


def test_fuzzy_matches_against_brute_force(spark):
    got = {(r.source_column, r.target): (r.score, r.fuzzy_order) for r in
           m.fuzzy_matches(spark.createDataFrame([(h,) for h in HEADERS], "source_column string")).collect()}
    want = {}
    for h in HEADERS:
        a = sim.sorted_tokens(normalize_header_text(h))
        best = {}
        for idx, text, target, _ in corpus():
            b = sim.sorted_tokens(normalize_header_text(text))
            score = 200.0 * slow_lcs(a, b) / max(1, len(a) + len(b))
            if score >= 75 and (target not in best or (score, -idx) > best[target]):
                best[target] = (score, -idx)
        for order, (target, (score, _)) in enumerate(sorted(best.items(), key=lambda x: (-x[1][0], -x[1][1]))[:5], 1):
            want[h, target] = (score, order)
    assert got == {k: (pytest.approx(s), o) for k, (s, o) in want.items()}
    assert got["Reference No.", "Reference"][0] == pytest.approx(85.714, abs=0.01)
    assert got["# Buildings", "Number of Buildings"][0] == pytest.approx(85.714, abs=0.01)
    assert not [k for k in got if k[0] in ("Const Type", "Latitude", "TOTAL", "ZZZZXXXXXQQQQ")]


def test_exact_matches(spark):
    got = {r.source_column: r.target for r in
           m.exact_matches(spark.createDataFrame([(h,) for h in HEADERS], "source_column string")).collect()}
    assert got["Loc #"] == "Reference" and got["Yr Blt"] == "Year Built" and got["Bldg Repl Cost"] == "Building Value"
    assert "Latitude" not in got


def test_similarity_topk_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(sim, "BLOCK", 16)
    rng = np.random.default_rng(5)
    q, c = rng.normal(size=(40, 8)), rng.normal(size=(50, 8))
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid bigint, vector array<float>")
    cs = spark.createDataFrame([(i, f"t{i % 6}", v.tolist()) for i, v in enumerate(c)], "cid bigint, grp string, vector array<float>")
    q, c = q.astype("float32").astype("float64"), c.astype("float32").astype("float64")
    sims = (q @ c.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(c, axis=1)[None, :]
    got = {(r.qid, r["rank"]): r.cid for r in sim.similarity_topk(qs, cs, "qid", "cid", 3, 0.2).collect()}
    want = {(i, k + 1): int(j) for i in range(40) for k, j in enumerate(np.argsort(-sims[i])[:3]) if sims[i, j] >= 0.2}
    assert got == want
    got = {(r.qid, r["rank"]): r.cid for r in
           sim.similarity_topk(qs, cs, "qid", "cid", 2, 0.2, best_per="grp").collect()}
    want = {}
    for i in range(40):
        best = sorted((max((sims[i, j], j) for j in range(50) if j % 6 == g) for g in range(6)), reverse=True)[:2]
        want.update({(i, k + 1): int(j) for k, (s, j) in enumerate(best) if s >= 0.2})
    assert got == want


def test_combine_and_confidence(spark):
    f = spark.createDataFrame([("h", "A", 1, 0.8, ["f"]), ("h", "B", 2, 0.7, ["f"])],
                              "source_column string, target string, fuzzy_order int, name_similarity double, evidence array<string>")
    s = spark.createDataFrame([("h", "A", 2, 0.6, ["s"]), ("h", "C", 1, 0.65, ["s"])],
                              "source_column string, target string, semantic_order int, name_similarity double, evidence array<string>")
    got = {r.target: r for r in m.combine_matches(f, s).collect()}
    assert got["A"].name_similarity == pytest.approx(0.7) and got["A"].method_agreement == 1 and got["A"].evidence == ["f", "s"]
    assert got["B"].method == "fuzzy" and got["B"].method_agreement == 0.7
    assert got["C"].method == "semantic" and got["C"].cand_order > got["A"].cand_order
    row = spark.range(1).select(
        m.confidence(F.lit(0.95), F.lit(0.9), F.lit(1.0)).alias("c"),
        m.confidence(F.lit(0.99), F.lit(1.0), F.lit(1.0), True).alias("m")).first()
    assert 0.90 <= row.c <= 1.0 and row.m == 0.99


def greedy(columns):
    """The rule in its plainest form: rescan everything before every commit."""
    claimed, out, pending = set(), {}, dict(columns)
    current = {c: opts[0] if opts else None for c, opts in columns.items()}
    while pending:
        col = max(pending, key=lambda c: (current[c][1] if current[c] else 0.0, -c))
        cand = current[col]
        if cand and cand[0] in claimed:
            current[col] = next((o for o in columns[col] if o[0] not in claimed), None)
            continue
        pending.pop(col)
        if cand:
            claimed.add(cand[0])
            out[col] = cand[0]
    return out


def test_assignment_against_the_plain_rule(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for sheet in range(60):
        columns = {}
        for col in range(rng.randrange(1, 9)):
            targets = rng.sample("ABCDEFG", rng.randrange(1, 6))
            tiers = sorted(rng.choice([0, 1, 2, 2, 2]) for _ in targets)
            tiers = [t if t == 2 or tiers.index(t) == i else 2 for i, t in enumerate(tiers)]
            opts = [[t, round(rng.uniform(0.5, 1), 2), tier, i] for i, (t, tier) in enumerate(zip(targets, tiers))]
            opts.sort(key=lambda o: (o[2], -o[1] if o[2] == 2 else 0, o[3]))
            columns[col] = [(o[0], o[1]) for o in opts]
            for t, conf, tier, order in opts:
                rows.append(("f", f"s{sheet}", col, f"c{col}", tier, order, t, "fuzzy", 0.9, 0.9, 0.7, conf, conf, [], "", False, None))
        want.update({(f"s{sheet}", c): t for c, t in greedy(columns).items()})
    got = m.assign_targets(spark.createDataFrame(rows, m.CANDIDATE_SCHEMA)).collect()
    assert {(r.sheet_name, r.col_idx): r.target for r in got} == want


def test_demotion_keeps_the_strongest(spark):
    rows = [("f", "s", i, f"c{i}", t, c, "exact", "", [], False, 0.0, 0.0, 0.0)
            for i, (t, c) in enumerate([("City", 0.7), ("City", 0.9), (None, 0.0), ("State", 0.8)])]
    got = {r.source_column: r for r in m.demote_duplicates(spark.createDataFrame(rows, m.MAPPING_SCHEMA)).collect()}
    assert got["c0"].target is None and "'c1'" in got["c0"].rationale and got["c0"].review_required
    assert got["c1"].target == "City" and got["c3"].target == "State" and got["c0"].method == "unresolved"


def test_memory_upsert_and_search(spark):
    schema = "source_column string, target_field string, confidence double, ts timestamp"
    old = mem.memory_entries(spark.createDataFrame([], schema))
    import datetime as d
    new = mem.memory_entries(spark.createDataFrame(
        [("Bldg_Val", "Building Value", 0.8, d.datetime(2024, 1, 1)), ("bldg val", "Building Value", 1.0, d.datetime(2024, 2, 1)),
         ("bldg val", "Contents", 0.5, d.datetime(2023, 1, 1))], schema))
    table = mem.upsert_memory(old, new)
    got = {r.target_field: r.confidence for r in table.collect()}
    assert got == {"Building Value": 1.0, "Contents": 0.5}
    hit = mem.memory_matches(spark.createDataFrame([("BLDG VAL",), ("x",)], "source_column string"), table).collect()
    assert [(r.source_column, r.target) for r in hit] == [("BLDG VAL", "Building Value")]
    h = spark.createDataFrame([(1, [1.0, 0.0])], "header_id int, vector array<double>")
    v = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.8, 0.6]), (9, [0.0, 1.0])], "memory_id int, vector array<double>")
    found = mem.search_memory(h, v).orderBy("rank").collect()
    assert [(r.memory_id, round(r.similarity, 3)) for r in found] == [(7, 1.0), (8, 0.8)]


def _columns_and_fits(spark):
    from schedulesmith.schema import TARGET_FIELDS

    columns = spark.createDataFrame([("f", f"s{i}", j, f"h{j}") for i in range(3) for j in range(4)], "file_id string, sheet_name string, col_idx int, source_column string")
    fits = columns.select("file_id", "sheet_name", "col_idx", F.lit(False).alias("empty"), F.array(*[F.lit(0.1 if i % 2 else 0.9) for i in range(len(TARGET_FIELDS))]).alias("fits"))
    return columns, fits


def test_sides_that_grow_with_the_columns_are_not_broadcast(spark):
    columns, fits = _columns_and_fits(spark)
    proposals = columns.select("file_id", "sheet_name", "source_column", F.lit("Address").alias("target"), F.lit(0.9).alias("confidence"), F.lit("why").alias("rationale"))
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    refused = m.rejected_proposals(proposals, columns, fits)
    assert "BroadcastHashJoin" not in plan(refused) and refused.count() == 12
    taken = m.proposal_candidates(proposals.withColumn("target", F.lit("Reference")), columns, fits)
    assert "BroadcastHashJoin" not in plan(taken) and taken.count() == 12
    won = m.assign_targets(taken)
    assert "BroadcastHashJoin" not in plan(m.mapping_table(columns, won, plausible=m.plausible_targets(fits)))
    # The mapping is read once for its sheets and their targets.
    mapping = m.mapping_table(columns, won)
    missing = m.unmapped_targets(mapping)
    assert plan(missing).count("MapInArrow") == plan(mapping).count("MapInArrow") and missing.count() == 3 * 16


def test_sheets_that_run_on_into_the_next_batch(spark):
    columns, fits = _columns_and_fits(spark)
    proposals = columns.select("file_id", "sheet_name", "source_column", F.lit("Reference").alias("target"), F.lit(0.9).alias("confidence"), F.lit("why").alias("rationale"))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        won = m.assign_targets(m.proposal_candidates(proposals, columns, fits).coalesce(1)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert sorted((r.sheet_name, r.col_idx, r.evidence[0], r.blocked) for r in won) == [(f"s{i}", 0, "LLM reasoning: why", []) for i in range(3)]


def test_columns_of_sheets_without_a_name_stay_single(spark):
    rows = [("f", None, 0, "a"), ("f", None, 0, "b"), (None, "s", 0, "c"), ("f", "s", 0, "d")]
    columns = spark.createDataFrame(rows, "file_id string, sheet_name string, col_idx int, source_column string")
    none = spark.createDataFrame([], m.CANDIDATE_SCHEMA)
    got = m.mapping_table(columns, m.assign_targets(none)).collect()
    assert sorted(r.source_column for r in got) == ["a", "b", "c", "d"]
    assert sorted(r.source_column for r in m.unmapped_targets(m.mapping_table(columns, m.assign_targets(none))).groupBy(F.coalesce("file_id", F.lit("-")).alias("source_column")).count().collect()) == ["-", "f"]


def test_the_plan_of_every_sheet_is_not_broadcast(spark):
    from schedulesmith.operators import transform as t

    sheets = spark.range(3).select(F.lit("f").alias("file_id"), F.col("id").cast("string").alias("sheet_name"))
    plan = sheets.limit(1).withColumn("positions", F.array(*[F.lit(0)] * 17))
    got = t.every_sheet(sheets, plan)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().sparkPlan().toString() and got.count() == 3


def test_texts_of_candidates_are_shuffled_once_at_most(spark, monkeypatch):
    """Columns meet fits before their candidates; a salted join of many headers gives the same; vetoes are dealt by sheet once."""
    columns = spark.createDataFrame([("f", f"s{i % 3}", i // 3, h) for i, h in enumerate(HEADERS * 2)], "file_id string, sheet_name string, col_idx int, source_column string")
    fits = columns.select("file_id", "sheet_name", "col_idx", F.lit(False).alias("empty"),
                          F.transform(F.sequence(F.lit(1), F.lit(17)), lambda i: (F.col("col_idx") * 7 + i * 3) % 20 / 20.0).alias("fits"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    small = m.map_candidates(columns, fits)
    text = plan(small)
    assert text.index("BroadcastHashJoin") < text.index("SortMergeJoin")
    by_sheet = m.veto_reasons(small.localCheckpoint()).groupBy("file_id", "sheet_name").agg(F.count("*"))
    assert plan(by_sheet).count("Exchange") == 1
    monkeypatch.setattr(m, "is_small", lambda df: False)
    salted = m.map_candidates(columns, fits)
    assert salted.columns == small.columns and sorted(map(str, salted.collect())) == sorted(map(str, small.collect()))
