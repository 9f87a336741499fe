"""Schema mapping: source columns -> target fields.

Name evidence is computed once per distinct header text, joined back to the sheets, checked
against each column's value profile and settled 1:1 within every sheet.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.similarity import fuzzy_hits, similarity_topk
from ..functions.text import fixed, normalize_header, normalize_header_text, rounded
from ..schema import KEYS, TARGET_FIELDS, corpus
from ..session import attach, first_rows, is_small, settle
from .memory import memory_matches
from .profile import contradicts, map_fit

W_NAME, W_VALUE, W_METHOD = 0.45, 0.35, 0.20
EXACT_SIMILARITY = 0.97
FUZZY_THRESHOLD, FUZZY_DISCOUNT = 75.0, 0.92
SEMANTIC_THRESHOLD, SEMANTIC_DISCOUNT = 0.70, 0.90
EXTERNAL_DISCOUNT = 0.85
MEMORY_CAP = 0.99
MIN_CONFIDENCE = 0.50
HIGH_CONFIDENCE = 0.90
SHORTLIST_FIT = 0.35
TOP = 5
UNMAPPED_PREFIX = "_col_"

# Wording of evidence, vetoes, rationales and reasons; results are compared by it.
MESSAGES = {
    "exact": "Exact normalized match: '{norm}' → '{target}'",
    "fuzzy": "Fuzzy match: '{source_column}' ≈ '{text}' (score={score}%)",
    "semantic": "Semantic similarity: '{source_column}' ↔ '{text}' = {similarity}",
    "matched target": "Matched target: '{target}'",
    "memory": "Previously approved mapping: '{memory_source}' → '{target}'",
    "memory similarity": "Similarity: {similarity}",
    "memory confidence": "Original confidence: {memory_confidence}",
    "memory vetoed": "Memory suggested '{target}' but values contradict it (VPF={fit}).",
    "header vetoed": "Header matches '{target}' but values contradict it (VPF={fit}).",
    "other vetoed": "'{target}' ({method}) vetoed: values contradict it (VPF={fit}).",
    "from memory": "Retrieved from approved memory: {first}",
    "from header": "Exact normalized match. VPF={fit}.",
    "from other": "Matched via {method}. VPF={fit}.",
    "proposal": "LLM reasoning: {_why}",
    "proposal confidence": "LLM confidence: {confidence}",
    "from proposal": "LLM reasoning. VPF={fit}.",
    "invalid target": "invalid target: {target}",
    "unknown source": "unknown source column",
    "contradicted": "values contradict the target",
    "unnamed": "Unnamed/index column — skipped.",
    "not confident": "Could not confidently map this column to any target field.",
    "no candidates": "No candidate fields met minimum similarity threshold.",
    "all failed": "All mapping stages failed or returned no match.",
    "all insufficient": "All mapping stages returned insufficient confidence.",
    "demoted": "Demoted: '{target}' already claimed by '{_winner}' with higher confidence.",
}

CANDIDATE_SCHEMA = (
    "file_id string, sheet_name string, col_idx int, source_column string, tier int, cand_order int, target string, "
    "method string, name_similarity double, value_profile_fit double, method_agreement double, confidence double, "
    "bid double, evidence array<string>, rationale string, review_required boolean, plausible array<string>"
)
MAPPING_SCHEMA = (
    "file_id string, sheet_name string, col_idx int, source_column string, target string, confidence double, "
    "method string, rationale string, evidence array<string>, review_required boolean, value_profile_fit double, "
    "name_similarity double, method_agreement double"
)


def message(name: str, **values: Column) -> Column:
    """A message with the columns that it names, or ``values`` given for them, filled in."""
    parts = re.split(r"\{(\w+)\}", MESSAGES[name])
    columns = [values.get(x, F.col(x)) if i % 2 else F.lit(x) for i, x in enumerate(parts) if x]
    return F.concat(*columns) if len(columns) > 1 else columns[0]


def corpus_table(spark: SparkSession) -> DataFrame:
    """The fixed matching corpus: names, definitions and synonyms of all targets."""
    return spark.createDataFrame(corpus(), "idx int, text string, target string, kind string").withColumn(
        "norm_text", normalize_header(F.col("text")))


def confidence(name_similarity: Column, fit: Column, agreement: Column, memory_hit: Column | bool = False,
               digits: int | None = 4) -> Column:
    """Weighted confidence, boosted but capped for remembered mappings (M8)."""
    score = name_similarity * W_NAME + fit * W_VALUE + agreement * W_METHOD
    hit = F.lit(memory_hit) if isinstance(memory_hit, bool) else memory_hit
    score = F.when(hit, F.least(F.lit(MEMORY_CAP), score * 1.1)).otherwise(score)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))
    return rounded(score, digits)


# --- name evidence per distinct header --------------------------------------------------

def exact_matches(headers: DataFrame) -> DataFrame:
    """Targets whose name or synonym equals the header after normalization (M2)."""
    known = (
        corpus_table(headers.sparkSession).where("kind <> 'definition'")
        .groupBy(F.col("norm_text").alias("norm")).agg(F.max_by("target", "idx").alias("target"))
    )
    keyed = headers.withColumn("norm", normalize_header(F.col("source_column")))
    return keyed.join(F.broadcast(known), "norm").select(
        "source_column", "target", F.lit(EXACT_SIMILARITY).alias("name_similarity"),
        F.array(message("exact")).alias("evidence"))


def fuzzy_matches(headers: DataFrame, limit: int = TOP) -> DataFrame:
    """Up to ``limit`` targets per header by word-sorted similarity of at least 75 (M4)."""
    texts = [normalize_header_text(text) for _, text, _, _ in corpus()]
    dim = F.broadcast(corpus_table(headers.sparkSession).select("idx", "text", "target"))
    keyed = headers.withColumn("norm", normalize_header(F.col("source_column")))
    scored = keyed.select("norm").distinct().select("norm", F.inline(fuzzy_hits(F.col("norm"), texts, FUZZY_THRESHOLD)))
    per_target = (
        scored.join(dim, "idx").groupBy("norm", "target")
        .agg(F.max(F.struct("score", (-F.col("idx")).alias("neg"), "text")).alias("_b"))
        .select("norm", "target", "_b.score", (-F.col("_b.neg")).alias("idx"), "_b.text")
    )
    order = Window.partitionBy("norm").orderBy(F.desc("score"), "idx")
    top = per_target.withColumn("fuzzy_order", F.row_number().over(order)).where(F.col("fuzzy_order") <= limit)
    return keyed.join(top, "norm").select(
        "source_column", "target", "score", "fuzzy_order", "text",
        (F.col("score") / 100.0 * FUZZY_DISCOUNT).alias("name_similarity"),
        F.array(
            message("fuzzy", score=fixed("score", 1)),
            message("matched target"),
        ).alias("evidence"))


def semantic_matches(header_vectors: DataFrame, corpus_vectors: DataFrame, limit: int = TOP) -> DataFrame:
    """Up to ``limit`` targets per header by cosine similarity of at least 0.70 (M5).

    ``header_vectors(source_column, vector)``; ``corpus_vectors(idx, text, target, vector)``.
    A target counts with its best corpus text.
    """
    hits = similarity_topk(header_vectors, corpus_vectors, "source_column", "idx", limit,
                           SEMANTIC_THRESHOLD, best_per="target")
    top = hits.join(corpus_vectors.select("idx", "text"), "idx").withColumnRenamed("rank", "semantic_order")
    return top.select(
        "source_column", "target", "similarity", "semantic_order",
        (F.col("similarity") * SEMANTIC_DISCOUNT).alias("name_similarity"),
        F.array(
            message("semantic", similarity=fixed("similarity", 3)),
            message("matched target"),
        ).alias("evidence"))


def combine_matches(fuzzy: DataFrame, semantic: DataFrame | None) -> DataFrame:
    """Fuzzy and semantic evidence per (header, target): both agree, or one alone (M6)."""
    f = fuzzy.select("source_column", "target", "fuzzy_order", F.col("name_similarity").alias("_f"),
                     F.col("evidence").alias("_fe"))
    if semantic is None:
        return f.select(
            "source_column", "target", F.lit("fuzzy").alias("method"), F.col("_f").alias("name_similarity"),
            F.lit(0.7).alias("method_agreement"), F.col("fuzzy_order").alias("cand_order"), F.col("_fe").alias("evidence"))
    s = semantic.select("source_column", "target", "semantic_order", F.col("name_similarity").alias("_s"),
                        F.col("evidence").alias("_se"))
    both = f.join(s, ["source_column", "target"], "full_outer")
    has_f, has_s = F.col("_f").isNotNull(), F.col("_s").isNotNull()
    none = F.array().cast("array<string>")
    return both.select(
        "source_column", "target",
        F.when(has_f, "fuzzy").otherwise("semantic").alias("method"),
        F.when(has_f & has_s, (F.col("_f") + F.col("_s")) / 2).otherwise(F.coalesce("_f", "_s")).alias("name_similarity"),
        F.when(has_f & has_s, 1.0).otherwise(0.7).alias("method_agreement"),
        F.coalesce(F.col("fuzzy_order"), F.col("semantic_order") + 100).alias("cand_order"),
        F.concat(F.coalesce("_fe", none), F.coalesce("_se", none)).alias("evidence"),
    )


# --- candidates per sheet column --------------------------------------------------------

def map_candidates(columns: DataFrame, fits: DataFrame, semantic: DataFrame | None = None,
                   memory: DataFrame | None = None, nearest: DataFrame | None = None) -> DataFrame:
    """All name-based candidates of every named column with fit, veto and confidence (M2-M9).

    ``columns(keys, col_idx, source_column)``; ``fits`` from ``profile.packed_fits`` per (keys, col_idx);
    ``memory`` is the memory table, ``nearest`` adds vector hits for headers it does not hold.
    Memory and exact candidates outrank fuzzy and semantic ones by ``tier``.
    """
    named = columns.where(~F.col("source_column").startswith(UNMAPPED_PREFIX))
    headers = named.select("source_column").distinct()
    parts = []
    remembered = None if memory is None else memory_matches(headers, memory)
    if nearest is not None:
        remembered = nearest if remembered is None else remembered.unionByName(
            nearest.join(remembered, "source_column", "left_anti"))
    if remembered is not None:
        sim = F.least(F.col("memory_confidence"), F.lit(MEMORY_CAP))
        parts.append(remembered.select(
            "source_column", "target", F.lit(0).alias("tier"), F.lit(0).alias("cand_order"), F.lit("memory").alias("method"),
            sim.alias("name_similarity"), F.lit(1.0).alias("method_agreement"),
            F.array(
                message("memory"),
                message("memory similarity", similarity=fixed("similarity", 3)),
                message("memory confidence", memory_confidence=fixed("memory_confidence", 3)),
            ).alias("evidence")))
    parts.append(exact_matches(headers).select(
        "source_column", "target", F.lit(1).alias("tier"), F.lit(0).alias("cand_order"), F.lit("exact").alias("method"),
        "name_similarity", F.lit(1.0).alias("method_agreement"), "evidence"))
    parts.append(combine_matches(fuzzy_matches(headers), semantic).select(
        "source_column", "target", F.lit(2).alias("tier"), "cand_order", "method", "name_similarity",
        "method_agreement", "evidence"))
    names = parts[0]
    for part in parts[1:]:
        names = names.unionByName(part)
    names, fitted, on = settle(names), fits.select(*KEYS, "col_idx", "empty", "fits"), [*KEYS, "col_idx"]
    if is_small(names):
        # Columns meet their fits before their candidates, so no text of a candidate is shuffled.
        joined = _merged(named, fitted, on).join(F.broadcast(names), "source_column")
    else:
        # One header text may sit on a large share of all sheets, so it is salted.
        joined = _merged(attach(named, names, ["source_column"], spread=F.struct(*on)), fitted, on)
    joined = joined.select(*on, *names.columns, "empty", "fits")
    own = joined.withColumn("_fit", _fit_of("target")).drop("fits")
    return own.withColumns({
        "value_profile_fit": map_fit(F.col("empty"), F.col("_fit")), "contradicts": contradicts(F.col("empty"), F.col("_fit"))}).withColumn(
        "confidence", confidence(F.col("name_similarity"), F.col("value_profile_fit"), F.col("method_agreement"),
                                 F.col("tier") == 0)).drop("_fit", "empty")


def _merged(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Sort-merge join of two sides that grow with the columns, whatever their estimated sizes; a hash leads the sort,
    since names of files and sheets have long beginnings in common."""
    keyed = [side.withColumn("_h", F.xxhash64(*on)) for side in (left, right)]
    return keyed[0].join(keyed[1].hint("merge"), ["_h", *on], how).drop("_h")


def _fit_of(target: str) -> Column:
    """The fit of packed ``fits`` to the target that a column names; null for one that is none."""
    place = F.array_position(F.array(*[F.lit(t) for t in TARGET_FIELDS]), F.col(target)) - 1
    return F.get("fits", place.cast("int"))


def veto_reasons(candidates: DataFrame) -> DataFrame:
    """Candidates ruled out by the column's values, with the text kept as evidence (M7).

    Which of them a column met depends on the targets claimed by then; see ``mapping_table``.
    """
    fit = fixed("value_profile_fit", 2)
    text = F.when(F.col("tier") == 0, message("memory vetoed", fit=fit)).when(F.col("tier") == 1, message("header vetoed", fit=fit)).otherwise(
        message("other vetoed", fit=fit))
    # Dealt by sheet as they are, with the texts made afterwards: ``mapping_table`` takes them by sheet too, without another exchange.
    ruled_out = candidates.where("contradicts").select(*KEYS, "col_idx", "tier", "cand_order", "target", "method", "value_profile_fit").repartition(*KEYS)
    packed = ruled_out.groupBy(*KEYS, "col_idx").agg(
        F.array_sort(F.collect_list(F.struct("tier", "cand_order", "target", text.alias("text")))).alias("_v"))
    return packed.select(*KEYS, "col_idx", F.col("_v").alias("vetoed"))


def viable_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates that may be assigned, in the order a column tries them (M7, M9)."""
    ok = ~F.col("contradicts") & ((F.col("tier") < 2) | (F.col("confidence") >= MIN_CONFIDENCE))
    fit = fixed("value_profile_fit", 2)
    rationale = F.when(F.col("tier") == 0, message("from memory", first=F.get("evidence", F.lit(0)))).when(
        F.col("tier") == 1, message("from header", fit=fit)).otherwise(message("from other", fit=fit))
    return candidates.where(ok).select(
        *KEYS, "col_idx", "source_column", "tier", "cand_order", "target", "method", "name_similarity",
        "value_profile_fit", "method_agreement", "confidence", F.col("confidence").alias("bid"), "evidence",
        rationale.alias("rationale"), (F.col("confidence") < HIGH_CONFIDENCE).alias("review_required"),
        F.lit(None).cast("array<string>").alias("plausible"))


def best_candidate(viable: DataFrame) -> DataFrame:
    """The candidate a column would take with every target free (M9)."""
    order = Window.partitionBy(*KEYS, "col_idx").orderBy(
        "tier", F.when(F.col("tier") < 2, 0.0).otherwise(-F.col("confidence")), "cand_order")
    return viable.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def shortlist(fits: DataFrame, n: int = TOP, blocked: DataFrame | None = None) -> DataFrame:
    """Targets whose values alone look plausible for a column, best first.

    ``blocked(keys, col_idx, blocked)`` takes out the targets other columns had claimed.
    """
    plausible = fits.where(F.col("fit") > SHORTLIST_FIT)
    if blocked is not None:
        plausible = plausible.join(blocked, [*KEYS, "col_idx"], "left").where(
            ~F.coalesce(F.array_contains("blocked", F.col("target")), F.lit(False)))
    order = Window.partitionBy(*KEYS, "col_idx").orderBy(F.desc("fit"), "target_pos")
    return plausible.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select(
        *KEYS, "col_idx", "rank", "target", "fit")


def plausible_targets(fits: DataFrame) -> DataFrame:
    """Per column the targets above the shortlist limit: (keys, col_idx, plausible); ``fits`` are packed."""
    names = [F.when(F.get("fits", F.lit(i)) > SHORTLIST_FIT, t) for t, i in sorted((t, i) for i, t in enumerate(TARGET_FIELDS))]
    return fits.select(*KEYS, "col_idx", F.array_compact(F.array(*names)).alias("plausible")).where(F.size("plausible") > 0)


def proposal_candidates(proposals: DataFrame, columns: DataFrame, fits: DataFrame) -> DataFrame:
    """Externally proposed targets that pass the acceptance rules, as last-resort candidates.

    ``proposals(keys, source_column, target, confidence, rationale)``, ``fits`` packed. Unknown targets and
    targets the values contradict are left out; see ``rejected_proposals`` for the reasons.
    ``plausible`` are the targets of which one must still be free when the column's turn comes.
    """
    sim = F.col("confidence") * EXTERNAL_DISCOUNT
    valid = proposals.where(F.col("target").isin(TARGET_FIELDS)).select(
        *KEYS, "source_column", "target", F.col("confidence"), F.col("rationale").alias("_why"))
    named = _merged(valid, columns, [*KEYS, "source_column"])
    fitted = _merged(named, fits.select(*KEYS, "col_idx", "empty", "fits"), [*KEYS, "col_idx"]).withColumn("_fit", _fit_of("target"))
    judged = fitted.withColumns({"map_fit": map_fit(F.col("empty"), F.col("_fit")), "contradicts": contradicts(F.col("empty"), F.col("_fit"))})
    return _merged(judged.where("not contradicts").drop("empty", "fits"), plausible_targets(fits), [*KEYS, "col_idx"]).select(
        *KEYS, "col_idx", "source_column", F.lit(9).alias("tier"), F.lit(0).alias("cand_order"), "target",
        F.lit("llm").alias("method"), sim.alias("name_similarity"), F.col("map_fit").alias("value_profile_fit"),
        F.lit(0.7).alias("method_agreement"),
        confidence(sim, F.col("map_fit"), F.lit(0.7)).alias("confidence"), F.lit(0.0).alias("bid"),
        F.array(message("proposal"), message("proposal confidence", confidence=fixed("confidence", 3))).alias("evidence"),
        message("from proposal", fit=fixed("map_fit", 2)).alias("rationale"),
        F.lit(True).alias("review_required"), "plausible")


def rejected_proposals(proposals: DataFrame, columns: DataFrame, fits: DataFrame) -> DataFrame:
    """Proposals refused before assignment, with the reason (M20); ``fits`` packed, or unpacked with 17 rows per column."""
    known = F.col("target").isin(TARGET_FIELDS)
    named = _merged(proposals, columns, [*KEYS, "source_column"], "left")
    if "fits" in fits.columns:
        # An unknown target meets no fit.
        own = _merged(named.withColumn("_at", F.when(known, F.col("col_idx"))),
                      fits.select(*KEYS, F.col("col_idx").alias("_at"), "empty", "fits"), [*KEYS, "_at"], "left")
        joined = own.withColumn("contradicts", contradicts(F.col("empty"), _fit_of("target")))
    else:
        joined = _merged(named, fits.select(*KEYS, "col_idx", "target", "contradicts"), [*KEYS, "col_idx", "target"], "left")
    reason = F.when(~known, message("invalid target")).when(F.col("col_idx").isNull(), message("unknown source")).when(
        F.col("contradicts"), message("contradicted"))
    return joined.withColumn("reason", reason).where("reason is not null").select(
        *KEYS, "source_column", "target", "reason")


# --- assignment -------------------------------------------------------------------------

def _claim_targets(col_idx, tier, cand_order, target, confidence, bid, plausible) -> list[dict]:
    """Candidates that win when the strongest pending column commits first, with the targets blocked at their turn.

    Every column bids its first candidate whose target is still free. A claimed target is
    never given back, and a column that lost its target looks again with all targets claimed
    by then blocked. A proposal only counts while some plausible target of its column is free.
    """
    import heapq

    def turn(i):
        return tier[i], -confidence[i] if tier[i] == 2 else 0.0, cand_order[i]

    options: dict[int, list[int]] = {}
    for i in sorted(range(len(col_idx)), key=turn):
        options.setdefault(int(col_idx[i]), []).append(i)
    queue = [(-bid[mine[0]], col, 0, ()) for col, mine in options.items()]
    heapq.heapify(queue)
    claimed: set[str] = set()
    won = []
    while queue:
        _, col, at, blocked = heapq.heappop(queue)
        mine = options[col]
        i = mine[at]
        shut = plausible[i] is not None and claimed.issuperset(plausible[i])
        if target[i] not in claimed and not shut:
            won.append({"at": i, "blocked": list(blocked)})
            claimed.add(target[i])
            continue
        while at < len(mine) and (target[mine[at]] in claimed or shut):
            at += 1
        if at < len(mine):
            heapq.heappush(queue, (-bid[mine[at]], col, at, tuple(sorted(claimed))))
    return won


def assign_targets(viable: DataFrame) -> DataFrame:
    """1:1 assignment within every sheet (M11), with the targets blocked at each column's turn.

    The candidates of a sheet, at most a dozen per column and never data rows, lie beside each other
    in sorted rows; a task holds one batch of them and the sheet that runs on into the next.
    """
    given = [f.name for f in viable.schema if f.name not in KEYS]
    judged = [given.index(x) + len(KEYS) for x in ("col_idx", "tier", "cand_order", "target", "confidence", "bid", "plausible")]
    kept = [i for i, x in enumerate([*KEYS, *given]) if x != "plausible"]

    def settled(rows: pa.RecordBatch, firsts: list[int]) -> pa.RecordBatch:
        """The winning rows of the sheets that begin at ``firsts``."""
        fields = [rows.column(i).to_pylist() for i in judged]
        fields[-1] = [None if x is None else json.loads(x) for x in fields[-1]]
        at, blocked = [], []
        for low, high in zip(firsts, [*firsts[1:], len(rows)]):
            for won in _claim_targets(*[f[low:high] for f in fields]):
                at.append(low + won["at"])
                blocked.append(won["blocked"])
        taken = rows.select(kept).take(pa.array(at, pa.int64()))
        return pa.RecordBatch.from_arrays([*taken.columns, pa.array(blocked, pa.list_(pa.string()))], [*taken.schema.names, "blocked"])

    def by_sheet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if held is None else pa.concat_batches([held, batch])
            sheets = list(zip(*[rows.column(i).to_pylist() for i in range(len(KEYS))]))
            firsts = [i for i, x in enumerate(sheets) if not i or x != sheets[i - 1]]
            if firsts[1:]:
                yield settled(rows.slice(0, firsts[-1]), firsts[:-1])
            held = rows.slice(firsts[-1])
        if held is not None:
            yield settled(held, [0])

    # Lists travel as JSON: Spark measures a batch anew after every row, and lists are what that takes long for.
    fields = {f.name: f.dataType.simpleString() for f in viable.schema} | {"evidence": "string", "blocked": "array<string>"}
    flat = [F.to_json(x).alias(x) if x in ("evidence", "plausible") else x for x in given]
    schema = ", ".join(f"{x} {fields[x]}" for x in [*KEYS, *[g for g in given if g != "plausible"], "blocked"])
    # Sorted by a hash first: names of files and sheets have long beginnings in common, which sorts badly.
    won = viable.select(*KEYS, *flat).repartition(*KEYS).sortWithinPartitions(F.xxhash64(*KEYS), *KEYS).mapInArrow(by_sheet, schema)
    return won.withColumn("evidence", F.from_json("evidence", "array<string>"))


def blocked_targets(columns: DataFrame, assigned: DataFrame) -> DataFrame:
    """(keys, col_idx, blocked): the targets a column could not take any more when it was settled.

    A column that found its target blocked what was claimed when it last had to look again.
    One that found none is settled after all others, in column order: all claims of its sheet
    are blocked but proposals accepted for later columns.
    """
    sheets = _by_sheet(columns, ["col_idx"], "_columns").join(_by_sheet(assigned, ["col_idx", "target", "tier", "blocked"], "_won").hint("merge"), KEYS, "left")
    return _blocked(sheets).select(*KEYS, F.inline("_blocked"))


def _by_sheet(rows: DataFrame, fields: list[str], name: str) -> DataFrame:
    """One row per sheet with the array ``name`` of its rows; a few dozen, one per column."""
    return rows.groupBy(*KEYS).agg(F.collect_list(F.struct(*fields)).alias(name))


def _own(array: str, col_idx: Column) -> Column:
    """The entries of a sheet's array that are about one column; one null if there is none, as of an outer join."""
    found = F.filter(array, lambda x: x["col_idx"] == col_idx)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(None)))


def _blocked(sheets: DataFrame) -> DataFrame:
    """``sheets(keys, _columns, _won)`` with ``_blocked``, the array of (col_idx, blocked)."""
    none = F.array().cast("array<string>")

    def shut(c):
        rest = F.transform(F.filter("_won", lambda w: (w["tier"] < 9) | (w["col_idx"] < c["col_idx"])), lambda w: w["target"])
        return F.transform(_own("_won", c["col_idx"]), lambda w: F.struct(
            c["col_idx"].alias("col_idx"), F.coalesce(w["blocked"], F.array_sort(rest), none).alias("blocked")))

    return sheets.withColumn("_blocked", F.flatten(F.transform("_columns", shut)))


def mapping_table(columns: DataFrame, assigned: DataFrame, vetoes: DataFrame | None = None,
                  plausible: DataFrame | None = None) -> DataFrame:
    """One mapping row per source column, unmapped ones included.

    ``vetoes`` from ``veto_reasons``, ``plausible`` from ``plausible_targets``; of both, targets
    that were blocked when the column was settled do not count.
    """
    won = [c for c in assigned.columns if c not in (*KEYS, "source_column", "bid")]
    none = F.array().cast("array<string>")
    # Columns, winners, vetoes and plausible targets meet by sheet: one exchange each, whatever is joined.
    sheets = _by_sheet(columns, ["col_idx", "source_column"], "_columns").join(_by_sheet(assigned, won, "_won").hint("merge"), KEYS, "left")
    for side, field in ((vetoes, "vetoed"), (plausible, "plausible")):
        if side is not None:
            sheets = sheets.join(_by_sheet(side, ["col_idx", field], f"_{field}").hint("merge"), KEYS, "left")
    sides = {"_won": "_w", "_blocked": "_b"} | ({} if vetoes is None else {"_vetoed": "_v"}) | ({} if plausible is None else {"_plausible": "_p"})
    own = lambda c: F.struct(c.alias("_c"), *[_own(array, c["col_idx"]).alias(short) for array, short in sides.items()])
    # A sheet without a name is like no other, so nothing meets its columns.
    named = F.col(KEYS[0]).isNotNull() & F.col(KEYS[1]).isNotNull()
    out = _blocked(sheets).withColumn("_blocked", F.when(named, F.col("_blocked"))).select(*KEYS, F.inline(F.transform("_columns", own)))
    for short in sides.values():
        out = out.withColumn(short, F.explode(short))
    out = out.select(
        *KEYS, "_c.*", *[F.col(f"_w.{c}").alias(c) for c in won if c not in ("col_idx", "tier", "blocked")], F.col("_b.blocked").alias("blocked"),
        *([] if vetoes is None else ["_v.vetoed"]), *([] if plausible is None else ["_p.plausible"]))
    free = lambda target: ~F.array_contains("blocked", target)
    if vetoes is None:
        out = out.withColumn("vetoed", none)
    else:
        # A mapped column lists only the vetoes it met before its own target.
        met = F.filter("vetoed", lambda x: free(x["target"]) & (
            F.col("cand_order").isNull() | (x["tier"] < 2) | (x["cand_order"] < F.col("cand_order"))))
        out = out.withColumn("vetoed", F.coalesce(met.getField("text"), none))
    if plausible is None:
        out = out.withColumn("_plausible", F.lit(True))
    else:
        out = out.withColumn("_plausible", F.coalesce(F.exists("plausible", free), F.lit(False)))
    unnamed = F.col("source_column").startswith(UNMAPPED_PREFIX)
    mapped = F.col("target").isNotNull()
    zero = F.lit(0.0)
    return out.select(
        *KEYS, "col_idx", "source_column", "target",
        F.coalesce("confidence", zero).alias("confidence"),
        F.coalesce("method", F.lit("unresolved")).alias("method"),
        F.when(mapped, F.col("rationale")).when(unnamed, message("unnamed"))
        .when(F.col("_plausible"), message("not confident")).otherwise(message("no candidates")).alias("rationale"),
        F.when(mapped & F.col("method").isin("fuzzy", "semantic"), F.concat("evidence", "vetoed"))
        .when(mapped, F.col("evidence")).when(unnamed, none)
        .when(F.col("_plausible"), F.concat(F.array(message("all failed")), "vetoed"))
        .otherwise(F.concat(F.array(message("all insufficient")), "vetoed"))
        .alias("evidence"),
        F.when(mapped, F.col("review_required")).otherwise(~unnamed).alias("review_required"),
        F.coalesce("value_profile_fit", zero).alias("value_profile_fit"),
        F.coalesce("name_similarity", zero).alias("name_similarity"),
        F.coalesce("method_agreement", zero).alias("method_agreement"),
    )


def demote_duplicates(mapping: DataFrame) -> DataFrame:
    """Keep the most confident source per (sheet, target), unmap the others with a reason."""
    rank = Window.partitionBy(*KEYS, "target").orderBy(F.desc("confidence"), "col_idx")
    whole = rank.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lost = F.col("target").isNotNull() & (F.col("_r") > 1)
    reason = message("demoted")
    return (
        mapping.withColumn("_r", F.row_number().over(rank))
        .withColumn("_winner", F.first("source_column").over(whole))
        .withColumn("rationale", F.when(lost, reason).otherwise(F.col("rationale")))
        .withColumn("confidence", F.when(lost, 0.0).otherwise(F.col("confidence")))
        .withColumn("method", F.when(lost, "unresolved").otherwise(F.col("method")))
        .withColumn("review_required", F.when(lost, True).otherwise(F.col("review_required")))
        .withColumn("target", F.when(~lost, F.col("target")))
        .drop("_r", "_winner")
    )


# --- summaries --------------------------------------------------------------------------

def mapping_summary(mapping: DataFrame, digits: int | None = 4) -> DataFrame:
    """Per sheet: mapped and unmapped columns, unmapped targets, mean confidence."""
    mapped = F.col("target").isNotNull()
    mean = F.coalesce(F.avg(F.when(mapped, F.col("confidence"))), F.lit(0.0))
    targets = F.array(*[F.lit(t) for t in TARGET_FIELDS])
    by_position = F.array_sort(F.collect_list(F.when(~mapped, F.struct("col_idx", "source_column"))))
    return mapping.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_columns"),
        F.count("target").alias("n_mapped"),
        F.count(F.when(F.col("confidence") >= HIGH_CONFIDENCE, 1)).alias("n_high_confidence"),
        rounded(mean, digits).alias("mean_confidence"),
        by_position.getField("source_column").alias("unmapped_columns"),
        F.array_except(targets, F.collect_set("target")).alias("unmapped_targets"),
    )


def unmapped_targets(mapping: DataFrame) -> DataFrame:
    """Targets without a source column, one row per (sheet, target)."""
    targets, none = F.array(*[F.lit(t) for t in TARGET_FIELDS]), F.array().cast("array<string>")
    # A sheet without a name is like no other, so it holds none of the targets.
    nameless = F.col(KEYS[0]).isNull() | F.col(KEYS[1]).isNull()
    held = mapping.groupBy(*KEYS).agg(F.collect_set("target").alias("_held"))
    return held.select(*KEYS, F.explode(F.array_except(targets, F.when(nameless, none).otherwise(F.col("_held")))).alias("target"))


def mapping_report(mapping: DataFrame) -> DataFrame:
    """Display table of a mapping."""
    return mapping.select(
        *KEYS, "source_column", F.coalesce("target", F.lit("Unmapped")).alias("target_field"), "confidence", "method",
        F.when(F.col("review_required"), "Yes").otherwise("No").alias("review_required"), "rationale")


def sample_values(values: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` non-null values of every column in row order."""
    group = [*KEYS, "col_idx"]
    first = first_rows(values.where("value is not null").select(*group, "row_idx", "value"), group, n)
    packed = first.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_rank", "value"))).alias("_s"))
    return packed.select(*group, F.col("_s.value").alias("samples"))
