"""All literal schedules in one portfolio run, with the outcomes the schedules were made for."""

import pytest
from pyspark.sql import functions as F

import helpers as h
from schedulesmith.operators import evaluate as e
from schedulesmith.operators import mapping as m
from schedulesmith.operators import quality as q
from schedulesmith.operators import review as r
from schedulesmith.operators import structure as s
from schedulesmith.operators import transform as t
from schedulesmith.plans import portfolio as pf
from schedulesmith.schema import KEYS, TARGET_FIELDS, corpus
from schedulesmith.session import settle

def numbered(header, n, *cells):
    """A header and n rows whose cells are made from the row number."""
    return [header, *[[c(i) if callable(c) else c for c in cells] for i in range(1, n + 1)]]


def quay(i):
    return f"{i} Quay Walk"


BOOKS = {
    "standard": {"SOV": h.STANDARD},
    "messy": {"SOV Data": h.MESSY},
    "multi": h.MULTI_BOOK,
    "malformed": {"S": [["Colour", "Shape"], [12, 15]]},
    "dup_headers": {"S": [["Site ID", "Street", "Street", "Bldg RCV"], ["P7", "2 Pier Road", "Gate B", 730000]]},
    "footnote": {"S": [["Risk ID", "Street", "Post Code", "Bldg RCV"], [5, "8 Pier Road", 97103, 640000], ["Cladding was renewed lately"]]},
    "veto": {"Places": numbered(["Broker Name", "Site ID", "Bldg Nr", "Structure Value", "Longitude", "Nation"], 12,
                                "Kelp Partners", lambda i: 700 + i, lambda i: i, lambda i: 410000 + 2500 * i, lambda i: 8.3 + i / 7, "Norway")},
    "two_sheets": {
        "Open": numbered(["Risk ID", "Street", "Zipcode", "2021 Building RCV", "Built Year"], 7, lambda i: i, quay, 97103, lambda i: 310000 + i, 1977),
        "Closed": numbered(["Risk ID", "Street", "Zipcode", "Building RCV", "Built Year"], 6, lambda i: i + 30, quay, 95501, lambda i: 520000 + i, 1983)},
    "unclaimed": {
        "East": numbered(["Risk ID", "Street", "Zipcode", "Bldg RCV", "Built Year", "Surveyor Remark"], 5, lambda i: i, quay, 97103, lambda i: 88000 + i, 1969,
                         lambda i: f"east {i}"),
        "West": numbered(["Site ID", "Site Address", "Post Code", "Structure Value", "Build Year", "Surveyor Remark"], 5, lambda i: i + 40, quay, 95501,
                         lambda i: 99000 + i, 1971, lambda i: f"west {i}")},
    "reject": {"SOV": numbered(["Risk ID", "Street", "State Code", "Bldg RCV"], 5, lambda i: i, quay, "ME", lambda i: 7000 * i)},
    "short_zip": {"SOV": numbered(["Risk ID", "Street", "Zipcode", "Bldg RCV"], 5, lambda i: i, quay, 601, lambda i: 7000 * i)},
    "two_flags": {"SOV": [["Risk ID", "Street", "Bldg RCV"], ["K9", "1 Slipway", 4000], ["K9", "2 Slipway", 5000]]
                  + [[None, quay(i), 6000] for i in range(3, 9)]},
    "alternative": {"SOV": numbered(["Risk ID", "Street", "Structure Value"], 8, lambda i: i, quay, lambda i: 210000 * i)},
    "escalate": {"SOV": numbered(["Risk ID", "Street", "Build Year"], 8, lambda i: i, quay, lambda i: 1961 + i)},
}


def meaning(spark, headers):
    """Semantic evidence that places each header close to the name of one target."""
    targets = sorted(set(headers.values()))
    axis = {t: [1.0 if t == u else 0.0 for u in targets] + [0.1] for t in targets}
    names = spark.createDataFrame(
        [(i, text, target, axis[target]) for i, text, target, kind in corpus() if target in axis and kind == "field"],
        "idx int, text string, target string, vector array<double>")
    vectors = spark.createDataFrame(
        [(c, [x + 0.1 for x in axis[t]]) for c, t in headers.items()], "source_column string, vector array<double>")
    return m.semantic_matches(vectors, names)


@pytest.fixture(scope="module")
def run(spark):
    sheets = h.sheets_df(spark, {**BOOKS, "empty": {"Sheet": []}})
    found = pf.discover(h.rows_df(spark, BOOKS), sheets)
    mapped = pf.map_columns(found, h.YEAR, semantic=meaning(spark, {"Structure Value": "Contents"}))
    return found, mapped, pf.assess(found, mapped.mapping, h.YEAR)


@pytest.fixture(scope="module")
def exported(spark, run):
    """Everything approved except the State mapping of one file; notes assigned or rejected per sheet."""
    found, _, checked = run
    reject = (F.col("file_id") == "reject") & (F.col("action_type") == "column_mapping") & (F.col("source_column") == "State Code")
    recs = settle(checked.recommendations.withColumn("status", F.when(reject, "rejected").otherwise("approved")))
    decisions = spark.createDataFrame(
        [("unclaimed", " east ", "Surveyor Remark", "Occupancy", 1),
         ("unclaimed", "West", "Surveyor Remark", "__rejected__", 1)],
        "file_id string, sheet_name string, source_column string, decision string, seq int")
    out = pf.transform(found, recs, t.scope_decisions(decisions, found.columns), stamp="2024-01-01T00:00:00")
    typed = {}
    for row in out.typed.orderBy("row_idx").collect():
        typed.setdefault((row.file_id, row.sheet_name), []).append(row)
    return out, typed, out.audit.collect(), recs


def test_discovery(run):
    found = run[0]
    got = {(x.file_id, x.sheet_name): x for x in found.sheets.collect()}
    assert got["messy", "SOV Data"].header_row == 4 and got["standard", "SOV"].header_row == 0
    assert got["multi", "Places"].sheet_rank == 1 and got["multi", "Places"].classification == "Primary"
    assert not got["multi", "Remarks"].is_data and "Very few" in got["multi", "Remarks"].issues[0]
    assert got["malformed", "S"].classification == "Secondary" and got["malformed", "S"].confidence == 0.452
    assert got["empty", "Sheet"].classification == "Reject" and got["empty", "Sheet"].is_primary
    assert got["empty", "Sheet"].reasoning == ["Sheet is empty."]
    assert got["two_sheets", "Open"].is_data and got["two_sheets", "Closed"].is_data
    report = {(x.file_id, x.sheet_name): x for x in s.sheet_manifest(found.sheets).collect()}
    assert report["messy", "SOV Data"].data_rows == 8 and report["empty", "Sheet"].data_rows == 0


def test_records(run):
    found = run[0]
    names = {}
    for x in found.columns.orderBy("col_idx").collect():
        names.setdefault(x.file_id, []).append(x.source_column)
    assert names["dup_headers"] == ["Site ID", "Street", "Street (1)", "Bldg RCV"]
    n = {(x.file_id, x.sheet_name): x["count"] for x in found.records.groupBy(*KEYS).count().collect()}
    assert n["messy", "SOV Data"] == 6 and n["footnote", "S"] == 1 and n["multi", "Places"] == 5


def test_mapping_labels(spark, run):
    mapping = run[1].mapping
    got = {(x.file_id, x.source_column): x.target for x in mapping.collect()}
    wrong = {}
    for file_id, labels in (("standard", h.STANDARD_LABELS), ("messy", h.MESSY_LABELS), ("multi", h.MULTI_LABELS)):
        wrong.update({c: got[file_id, c] for c, want in labels.items() if got[file_id, c] != want})
    # Without header vectors two short headers have no name evidence above the threshold.
    assert wrong == {"Hull Material": None, "Sundry Sum": None}
    assert got["veto", "Site ID"] == "Reference" and got["veto", "Structure Value"] == "Building Value"
    assert got["veto", "Bldg Nr"] != "Building Value" and got["veto", "Nation"] == "Country"
    assert got["veto", "Longitude"] not in ("Country", "Reference")
    one = mapping.where("target is not null").groupBy(*KEYS, "target").count().where("count > 1")
    assert one.count() == 0
    low = mapping.where("confidence < 0.9 and not review_required and source_column not like '_col_%'")
    assert low.count() == 0


def test_semantic_evidence_joins_in(spark, run):
    """With vectors for the headers, a header without similar spelling is mapped by meaning."""
    found, mapped, _ = run
    semantic = meaning(spark, {"Hull Material": "Construction", "Sundry Sum": "Other"})
    one = pf.Discovery(found.sheets, found.columns.where("file_id = 'standard'"), found.records.where("file_id = 'standard'"))
    got = {x.source_column: x for x in pf.map_columns(one, h.YEAR, semantic=semantic).mapping.collect()}
    assert all(got[c].target == want for c, want in h.STANDARD_LABELS.items())
    assert got["Hull Material"].method == "semantic" and got["Hull Material"].review_required


def test_findings_and_scores(spark, run):
    _, _, checked = run
    found = checked.issues.where("file_id = 'messy'").collect()
    kinds = {(x.issue_type, x.affected_field) for x in found}
    assert ("duplicate", "Reference") in kinds and ("format", "Building Value") in kinds
    assert ("logical_error", "Contents") in kinds and ("format", "Fire Sprinklers (Y/N)") in kinds
    dup = next(x for x in found if x.issue_type == "duplicate")
    assert list(dup.affected_rows) == [0, 5] and "SM/1" in dup.evidence
    scores = {x.file_id: x for x in checked.scores.collect() if x.file_id in ("standard", "messy", "multi")}
    assert scores["standard"].score >= 70 and scores["messy"].score >= 40 and scores["multi"].score >= 65


def test_export(exported):
    out, typed, audit, _ = exported
    assert [f.name for f in out.typed.schema][3:] == TARGET_FIELDS
    assert len(typed["two_sheets", "Open"]) == 7 and len(typed["two_sheets", "Closed"]) == 6
    assert all(x["Building Value"] for x in typed["two_sheets", "Open"] + typed["two_sheets", "Closed"])
    assert all(x.State is None for x in typed["reject", "SOV"])
    assert [x.Zip for x in typed["short_zip", "SOV"]] == [601] * 5
    assert [x.Occupancy for x in typed["unclaimed", "East"]] == [f"east {i}" for i in range(1, 6)]
    assert all(x.Occupancy is None for x in typed["unclaimed", "West"])
    first = typed["messy", "SOV Data"][0]
    assert first["Building Value"] == 910000.0 and first.State == "OR" and first["Fire Sprinklers (Y/N)"] == "N"
    assert typed["messy", "SOV Data"][3].Contents == -95000.0
    lost = [(x.row_idx, x.field, x.value) for x in out.nonconforming.where("file_id = 'messy'").collect()]
    assert lost == [(10, "BI", "pending")]
    done = {(a.file_id, a.source_column): a.transformation_applied for a in audit}
    assert done["reject", "State Code"] == "column_rejected_dropped"
    assert ("unclaimed", "Surveyor Remark") in done
    texts = {(a.file_id, a.target_column, a.transformation_applied): a.before_value for a in audit}
    assert texts["messy", "Building Value", "strip_currency"] == "$910,000 (sample; 6 rows changed)"
    assert texts["messy", "State", "state_to_abbrev"] == "Oregon (sample; 1 rows changed)"
    kinds = {a.transformation_applied for a in audit if a.file_id == "unclaimed"}
    assert {"unclaimed_manual_assign", "unclaimed_reject", "column_rename"} <= kinds
    passed = {x.file_id: x.passed for x in out.validation.collect()}
    assert passed["standard"] and not passed["messy"]
    assert len({a.entry_id for a in audit}) == len(audit)


def test_evaluation(spark, run, exported):
    _, mapped, checked = run
    _, _, _, recs = exported
    files = spark.createDataFrame([("standard",), ("messy",), ("multi",)], "file_id string")
    labels = spark.createDataFrame(
        [(f, c, tg) for f, d in (("standard", h.STANDARD_LABELS), ("messy", h.MESSY_LABELS), ("multi", h.MULTI_LABELS))
         for c, tg in d.items()], "file_id string, source_column string, target string")
    expected = spark.createDataFrame(
        [("messy", a) for a in ("currency_symbols", "negative_value", "duplicate_reference", "non_standard_sprinkler")],
        "file_id string, anomaly string")
    audit = spark.createDataFrame([(f, "x") for f in ("standard", "messy", "multi")], "file_id string, entry_id string")
    predicted = mapped.mapping.where("target is not null")
    per_file = (
        e.mapping_accuracy(files, labels, predicted).join(e.anomaly_recall(files, expected, checked.issues), "file_id")
        .join(e.transformation_correctness(files, labels, predicted), "file_id")
        .join(e.explainability(files, recs), "file_id").join(e.audit_completeness(files, recs, audit), "file_id"))
    rows = {x.file_id: x for x in per_file.collect()}
    assert rows["messy"].mapping_accuracy == 1 and rows["multi"].mapping_accuracy == 1
    assert rows["standard"].mapping_accuracy == pytest.approx(15 / 17)
    assert rows["messy"].anomaly_recall == 1 and rows["standard"].anomaly_recall == 1
    card = {x.metric: x for x in e.scorecard(per_file).collect()}
    assert all(x.status == "PASS" for x in card.values()) and card["audit_completeness"].achieved == 100


def decide(spark, recs, picks, day=1):
    """Decision rows for (file, source, operation) -> (decision, note, new target)."""
    import datetime as d

    rows = []
    for x in recs.collect():
        pick = picks.get((x.file_id, x.source_column, x.operation, x.issue_type))
        if pick:
            rows.append((x.file_id, x.sheet_name, x.rec_id, *pick, d.datetime(2024, 1, day)))
    return spark.createDataFrame(
        rows, "file_id string, sheet_name string, rec_id string, decision string, note string, new_target string, ts timestamp")


def test_review_round(spark, run):
    found, mapped, checked = run
    recs = checked.recommendations
    gate = {x.file_id: x.route for x in r.export_gate(recs).collect()}
    assert gate["messy"] == "human_review"
    picks = {
        ("alternative", "Structure Value", "trim_whitespace", ""): ("reject", "goods, not walls", None),
        ("escalate", "Build Year", "trim_whitespace", ""): ("reject", "year of purchase", None),
        ("messy", "Building Value", "strip_currency", "format"): ("reject", "keep as written", None),
        ("two_flags", "Reference", "flag_for_review", "completeness"): ("approve", None, None),
        ("two_flags", "Reference", "flag_for_review", "duplicate"): ("reject", "", None),
        ("standard", "Site ID", "trim_whitespace", ""): ("edit", None, "Other"),
    }
    decisions = decide(spark, recs, picks)
    decided, edited_mapping, memory = pf.apply_review(recs, decisions, mapped.mapping)
    assert r.apply_decisions(decided, decisions).exceptAll(decided).count() == 0
    target = {(x.file_id, x.source_column): x for x in edited_mapping.collect()}["standard", "Site ID"]
    assert target.target == "Other" and target.confidence == 1.0 and "Manually assigned" in target.rationale
    assert [(x.source_column, x.target_field, x.method) for x in memory.collect()] == [("Site ID", "Other", "human_feedback")]
    routes = {x.file_id: x.route for x in r.export_gate(decided).collect()}
    assert routes["alternative"] == routes["escalate"] == "re_reason"
    after, mapping = pf.re_reason(decided, mapped, found, h.YEAR)
    after = settle(after)
    got = {(x.file_id, x.source_column, x.operation, x.issue_type): x for x in after.collect()}

    swapped = got["alternative", "Structure Value", "trim_whitespace", ""]
    assert swapped.status == "pending" and swapped.review_required and swapped.feedback_processed
    assert swapped.target_column not in ("Building Value", "Reference", "Address")
    assert "goods, not walls" in swapped.uncertainty
    new = {(x.file_id, x.source_column): x.target for x in mapping.collect()}
    assert new["alternative", "Structure Value"] == swapped.target_column

    stuck = got["escalate", "Build Year", "trim_whitespace", ""]
    assert stuck.status == "escalated" and "Escalated" in stuck.uncertainty and new["escalate", "Build Year"] is None
    fix = got["messy", "Building Value", "strip_currency", "format"]
    assert fix.status == "rejected" and fix.feedback_processed and "withdrawn" in fix.uncertainty
    assert "keep as written" in fix.uncertainty
    assert got["two_flags", "Reference", "flag_for_review", "completeness"].status == "approved"
    assert got["two_flags", "Reference", "flag_for_review", "duplicate"].status == "rejected"
    edited = got["standard", "Site ID", "trim_whitespace", ""]
    assert edited.status == "approved" and edited.target_column == "Other" and edited.confidence == 1.0

    # An escalated item that a reviewer then assigned survives another round.
    again = settle(r.apply_decisions(after, decide(spark, after, {
        ("escalate", "Build Year", "trim_whitespace", ""): ("edit", None, "Year Built")}, day=2)))
    kept = r.carry_over(pf.assess(found, mapping, h.YEAR).recommendations, again)
    row = [x for x in kept.where("file_id = 'escalate'").collect() if x.source_column == "Build Year"]
    assert len(row) == 1 and row[0].status == "approved" and row[0].target_column == "Year Built"


def test_bulk_approval_texts_and_suggestions(spark, run):
    recs = run[2].recommendations
    bulk = r.bulk_approve(recs)
    assert bulk.where("status = 'approved' and confidence < 0.9").count() == 0
    assert bulk.where("status = 'pending' and confidence >= 0.9").count() == 0
    counts = {(x.file_id, x.sheet_name): x for x in r.status_counts(bulk).collect()}
    assert counts[None, None].n_total == recs.count() and counts["messy", None].n_total == counts["messy", "SOV Data"].n_total
    told = r.describe(recs)
    assert told.where("title is null or summary is null or reason is null or impact is null").count() == 0
    one = recs.where("operation = 'strip_currency'").limit(1).collect()[0]
    ids = spark.createDataFrame([(one.rec_id, "drop_table", "because", None, 1.5)],
                                "rec_id string, s_operation string, s_rationale string, s_uncertainty string, s_confidence double")
    merged = r.merge_suggestions(recs, ids).where(F.col("rec_id") == one.rec_id).collect()[0]
    assert merged.operation == "strip_currency" and merged.rationale == "because" and merged.confidence == one.confidence


def test_proposals(spark, run):
    found, mapped, _ = run
    schema = "file_id string, sheet_name string, source_column string, target string, confidence double, rationale string"
    proposals = spark.createDataFrame([
        ("standard", "SOV", "Hull Material", "Construction", 0.9, "timber, brick"),
        ("standard", "SOV", "Sundry Sum", "Building Value", 0.9, "already used"),
        ("veto", "Places", "Longitude", "Nowhere", 0.9, "bad")], schema)
    got = {(x.file_id, x.source_column): x for x in pf.map_columns(found, h.YEAR, proposals=proposals).mapping.collect()}
    const = got["standard", "Hull Material"]
    assert const.target == "Construction" and const.method == "llm" and const.review_required
    assert const.name_similarity == pytest.approx(0.9 * 0.85) and const.method_agreement == 0.7
    assert got["standard", "Sundry Sum"].target is None
    refused = m.rejected_proposals(proposals, found.columns, mapped.fits).collect()
    assert [(x.source_column, x.reason) for x in refused] == [("Longitude", "invalid target: Nowhere")]


def test_summaries(run):
    found, mapped, checked = run
    rows = {x.file_id: x for x in m.mapping_summary(mapped.mapping).collect() if x.file_id in ("standard", "veto")}
    assert rows["standard"].n_mapped == 15 and rows["standard"].unmapped_columns == ["Hull Material", "Sundry Sum"]
    assert rows["standard"].unmapped_targets == ["Construction", "Other"]
    missing = m.unmapped_targets(mapped.mapping).where("file_id = 'standard'").collect()
    assert {x.target for x in missing} == {"Construction", "Other"}
    samples = m.sample_values(s.column_values(found.records))
    left = {x.source_column: x for x in r.unclaimed_columns(mapped.mapping, samples).where("file_id = 'standard'").collect()}
    assert left["Hull Material"].samples == ["Timber", "Brick", "Iron", "Granite"]
    assert left["Sundry Sum"].samples == ["15500", "46500"]
    assert q.report_summary(checked.issues, found.records.groupBy(*KEYS).count().withColumnRenamed("count", "n_rows")).where(
        "file_id = 'messy'").first().issue_summary.startswith("9 issues detected across")


def test_preview(run):
    found, _, checked = run
    recs = pf.approve_all(checked.recommendations)
    head = t.preview(found.records, found.columns, recs, n=3)
    n = {x.file_id: x["count"] for x in head.groupBy("file_id").count().collect()}
    assert n["standard"] == 3 and n["footnote"] == 1
    row = head.where("file_id = 'messy'").orderBy("row_idx").first()
    assert row["Building Value"] == "910000.0" and row.State == "OR"
