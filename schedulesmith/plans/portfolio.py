"""Whole-portfolio plan: discover -> map -> assess -> review -> clean and validate.

Every stage is a DataFrame function over all files and sheets at once. Small per-sheet
results (headers, mappings, findings) are settled between stages; data rows are not.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import mapping as m
from ..operators import memory as mem
from ..operators import profile as p
from ..operators import quality as q
from ..operators import review as r
from ..operators import structure as s
from ..operators import transform as t
from ..operators import validate as v
from ..schema import KEYS
from ..session import attach, compiled_methods, settle, store


@dataclass
class Discovery:
    """Ranked sheets, column names and data records of the sheets that carry data."""

    sheets: DataFrame
    columns: DataFrame
    records: DataFrame


def discover(rows: DataFrame, sheets: DataFrame | None = None, ranges: DataFrame | None = None,
             max_header_rows: int = s.MAX_HEADER_ROWS, sample_rows: int | None = None) -> Discovery:
    """Headers, sheet classes, column names and records.

    ``rows`` are read once for their extent, once for all figures of the cells and once for the
    records, their first rows for headers and names, so they should be stored (``session.store``). The records
    are stored as Parquet, in place and without a shuffle; later steps read the columns they need.
    ``max_header_rows`` bounds the search for the header, ``sample_rows`` the rows below it that
    are judged (all by default). Sets the session's limit of generated methods (``session.compiled_methods``).
    """
    compiled_methods(rows.sparkSession)
    rows = s.nullify_blanks(rows)
    if ranges is not None:
        rows = s.fill_down(rows, ranges)
    headers = settle(s.detect_headers(rows, s.sheet_dims(rows), max_header_rows))
    ranked = settle(s.rank_sheets(s.score_sheets(rows, headers, ranges, sample_rows), sheets))
    data = ranked.where("is_data and n_rows > 0").select(*KEYS)
    own = headers.join(data, KEYS, "left_semi")
    columns = settle(s.header_names(rows, own))
    return Discovery(ranked, columns, store(s.extract_records(rows, own)))


@dataclass
class Mapped:
    mapping: DataFrame
    candidates: DataFrame
    fits: DataFrame


def map_columns(found: Discovery, current_year: int, semantic: DataFrame | None = None,
                memory: DataFrame | None = None, proposals: DataFrame | None = None,
                nearest: DataFrame | None = None) -> Mapped:
    keys = [*KEYS, "col_idx"]
    profiles = p.column_profiles(s.column_values(found.records), keys, current_year)
    # A column with no cell at all in any record still gets an (empty) profile.
    profiles = settle(found.columns.select(*keys).join(profiles, keys, "left").fillna(True, ["empty"]))
    fits = settle(p.packed_fits(profiles, keys, current_year))
    candidates = settle(m.map_candidates(found.columns, fits, semantic, memory, nearest))
    viable = m.viable_candidates(candidates)
    if proposals is not None:
        viable = viable.unionByName(m.proposal_candidates(proposals, found.columns, fits))
    viable = settle(viable)
    assigned = settle(m.assign_targets(viable))
    table = m.mapping_table(found.columns, assigned, m.veto_reasons(candidates), m.plausible_targets(fits))
    return Mapped(settle(table), viable, p.unpack_fits(fits, keys))


@dataclass
class Assessment:
    issues: DataFrame
    completeness: DataFrame
    scores: DataFrame
    recommendations: DataFrame


def assess(found: Discovery, mapping: DataFrame, current_year: int) -> Assessment:
    """Findings, completeness, score and recommendations.

    The rules run on the records as they are, without a copy or a shuffle; only the listed rows,
    at most 50 per finding, are then numbered by their dense position within the records.
    """
    table = t.mapped_table(found.records, settle(t.positions_from_mapping(mapping)))
    banded = settle(q.banded_counts(table, q.row_rules(current_year)))
    counts = settle(q.summed_counts(banded))
    sparse = settle(q.detect_issues(table, current_year, mapping, banded))
    listed = sparse.select(*KEYS, F.explode("affected_rows").alias("row_idx")).distinct()
    issues = settle(_number_rows(sparse, s.positions_of(found.records, listed)))
    complete = settle(q.counted_completeness(counts, mapping))
    scores = q.quality_score(mapping, mapping, complete, issues)
    return Assessment(issues, complete, scores, settle(r.all_recommendations(mapping, issues)))


def _number_rows(issues: DataFrame, positions: DataFrame) -> DataFrame:
    """Findings with dense positions instead of sheet rows in their row lists."""
    rows = issues.select(*KEYS, "issue_id", F.explode("affected_rows").alias("row_idx")).join(positions, [*KEYS, "row_idx"])
    lists = rows.groupBy(*KEYS, "issue_id").agg(F.sort_array(F.collect_list("data_idx")).alias("_dense"))
    none = F.array().cast("array<bigint>")
    return issues.join(lists, [*KEYS, "issue_id"], "left").withColumn("affected_rows", F.coalesce("_dense", none)).drop("_dense")


class Output:
    """Results of the transformation; each is computed only when it is asked for."""

    def __init__(self, cleaned: DataFrame, audit: Callable[[], DataFrame], sheets: DataFrame):
        self.cleaned, self._audit, self._sheets = cleaned, audit, sheets

    @property
    def typed(self) -> DataFrame:
        return v.typed_table(self.cleaned)

    @property
    def nonconforming(self) -> DataFrame:
        return v.nonconforming(self.cleaned)

    @cached_property
    def audit(self) -> DataFrame:
        return self._audit()

    @cached_property
    def validation(self) -> DataFrame:
        return v.validation_rollup(v.conformance_errors(self.cleaned), self._sheets)


def transform(found: Discovery, recs: DataFrame, decisions: DataFrame | None = None, stamp: str = "",
              only_ready: bool = True) -> Output:
    """Apply what was approved and validate the result; sheets still in review are held back."""
    records, columns = found.records, found.columns
    if only_ready:
        gate = settle(r.export_gate(recs))
        held = gate.where("route <> 'transform_export'").select(*KEYS)
        columns = columns.join(held, KEYS, "left_anti")
    columns = settle(columns)
    records = attach(records, columns.select(*KEYS).distinct(), KEYS)
    cleaned, audit = t.apply_approved(records, columns, recs, decisions, stamp)
    return Output(cleaned, audit, columns.select(*KEYS).distinct())


def apply_review(recs: DataFrame, decisions: DataFrame, mapping: DataFrame,
                 memory: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Recommendations, mapping and memory after the reviewers' decisions.

    Only decisions newer than those an item has seen count, so the same table may be applied
    again. Edited targets reach the mapping, approved and edited mappings the memory.
    """
    decided = settle(r.apply_decisions(recs, decisions))
    entries = r.approved_entries(decided)
    return decided, settle(r.edited_mapping(mapping, decided)), entries if memory is None else mem.upsert_memory(memory, entries)


def re_reason(recs: DataFrame, mapped: Mapped, found: Discovery, current_year: int) -> tuple[DataFrame, DataFrame]:
    """One review round: withdrawn or replaced items and the mapping that follows from them."""
    rejected = settle(r.to_rereason(recs))
    alternatives = settle(r.next_best(rejected, mapped.candidates, mapped.mapping))
    mapping = settle(r.apply_alternatives(mapped.mapping, rejected, alternatives))
    fresh = assess(found, mapping, current_year).recommendations
    kept = r.carry_over(fresh, recs)
    # A mapping that lost its target is not proposed again: its old item stays in the queue.
    on = [*KEYS, "rec_id"]
    lost = rejected.where("action_type = 'column_mapping'").join(kept.select(*on), on, "left_anti")
    everything = settle(kept.unionByName(lost))
    return r.apply_rereason(everything, rejected, alternatives), mapping


def approve_all(recs: DataFrame) -> DataFrame:
    return recs.withColumn("status", F.lit("approved"))
