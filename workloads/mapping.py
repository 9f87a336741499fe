"""Queries over schema mapping and mapping memory.

The sheets are the customers: each has twelve columns whose headers come from a list of
spellings, and value fits computed from its keys.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from schedulesmith.functions.text import normalize_header
from schedulesmith.operators import mapping as m
from schedulesmith.operators import memory as mem
from schedulesmith.operators import profile as p
from schedulesmith.schema import KEYS, TARGET_FIELDS
from schedulesmith.session import checkpoint_folder, settle, store

from . import duck as d
from .inputs import duck_sql, spark_sql, table

Q, SQL = {}, {}
K = "file_id, sheet_name"
COL = [*KEYS, "col_idx"]


def add(name, fn, sql=None):
    Q[name] = fn
    if sql:
        SQL[name] = sql


HEADERS = ["Loc #", "Location ID", "Reference No.", "Ref", "Street Address", "Property Addres", "Address", "City",
           "Town Name", "State", "ST", "State/Province", "Zip Code", "Postal Cde", "County", "Parish Name", "Country",
           "Nation", "Building Value ($)", "Bldg Value", "Bldg Repl Cost", "Contents", "Contents Val", "BI Value",
           "Business Interuption", "Time Element", "Occupancy", "Occupancy Type", "Construction", "Const Type",
           "Construction Typ", "Num Stories", "No. of Floors", "# Buildings", "Number of Bldgs",
           "Year of Construction", "Yr Built", "Sprinklers Y/N", "Fire Sprinkler Sys", "Other Value", "Latitude",
           "Internal Notes", "_col_3", "Account Name", "Bldg. Value", "TIV Contents"]
WIDTH = 12


def _pick(expr: str, options: list[str | None]) -> str:
    whens = " ".join(f"when {i} then {'null' if o is None else d.quoted(o)}" for i, o in enumerate(options))
    return f"case cast(({expr}) % {len(options)} as int) {whens} end"


COLUMNS = " union all ".join(
    f"select c_mktsegment as file_id, c_name as sheet_name, {j} as col_idx, c_custkey as k, "
    f"{_pick(f'c_custkey * 5 + {j} * 7', HEADERS)} as source_column from {{customer}}" for j in range(WIDTH))
COLUMNS_DUCK = duck_sql(COLUMNS)


def _choice(index, options):
    """Option at a computed position."""
    return F.get(F.array(*[F.lit(o) for o in options]), (index % len(options)).cast("int"))


def columns(spark, sf):
    j, k = F.col("col_idx"), F.col("k")
    return table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("file_id"), F.col("c_name").alias("sheet_name"), F.col("c_custkey").alias("k"),
        F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))).alias("col_idx"),
    ).select("file_id", "sheet_name", "col_idx", "k", _choice(k * 5 + j * 7, HEADERS).alias("source_column"))


def packed(spark, sf):
    """One row per column with its 17 fits, computed from its keys."""
    k, j = F.col("k"), F.col("col_idx")
    empty = (k + j) % 29 == 0
    values = F.array(*[F.when(empty, 0.0).otherwise(((k * 13 + j * 5 + F.lit(i * 7)) % 101) / 100.0) for i in range(len(TARGET_FIELDS))])
    return columns(spark, sf).select(*COL, empty.alias("empty"), values.alias("fits"))


def fits(spark, sf):
    return p.unpack_fits(packed(spark, sf), COL)


_targets = d.values_table(list(enumerate(TARGET_FIELDS)), "target_pos, target")
_fits = f"""fits as materialized (select {K}, col_idx, target_pos, target, empty, case when empty then 0.0 else f end as fit,
    case when empty then 0.5::double else f end as map_fit, not empty and f < 0.25 as contradicts
  from (select *, ((k * 13 + col_idx * 5 + target_pos * 7) % 101) / 100.0::double as f, (k + col_idx) % 29 = 0 as empty
    from cols, (select * from {_targets}) x))"""
# Longest common subsequence by one big-integer step per character of the known text.
_fuzzy = f"""known as (select *, {d.normalize('text')} as norm_text from {d.CORPUS} c),
  named as (select * from cols where not starts_with(source_column, '_col_')),
  heads as (select distinct source_column, {d.normalize('source_column')} as norm from named),
  toks as (select norm, array_to_string(list_sort(string_split(norm, ' ')), ' ') as a from (select distinct norm from heads)),
  ktoks as (select idx, target, text, array_to_string(list_sort(list_filter(regexp_split_to_array(norm_text, ' +'), lambda x: x <> '')), ' ') as b from known),
  pairs as materialized (select norm, idx, target, text, a, b, length(a) as la, length(b) as lb from toks, ktoks
     where 200.0 * least(length(a), length(b)) / (length(a) + length(b)) >= 75),
  lcs as (
    select norm, idx, a, b, la, lb, 0 as pos, (1::hugeint << la) - 1 as v from pairs
    union all
    select norm, idx, a, b, la, lb, pos + 1, ((v + (v & mask)) | (v - (v & mask))) & ((1::hugeint << la) - 1) from (
      select *, coalesce(list_sum(list_transform(range(la), lambda i: case when a[i + 1] = b[pos + 1] then 1::hugeint << i else 0::hugeint end)), 0)::hugeint as mask
      from lcs where pos < lb)),
  scored as (select norm, idx, target, text, 200.0::double * (la - bit_count(v)) / (la + lb) as score from lcs join pairs using (norm, idx, a, b, la, lb) where pos = lb),
  per_target as (select norm, target, max(score) as score, arg_max(idx, score * 1000000 - idx) as idx from scored where score >= 75 group by all),
  fuzzy as (select source_column, target, score, fuzzy_order from (
      select *, row_number() over (partition by norm order by score desc, idx) as fuzzy_order from per_target) join heads using (norm) where fuzzy_order <= 5),
  exact as (select source_column, any_value(target) as target from heads join known on norm = norm_text and kind <> 'definition' group by all)"""
BASE = f"with recursive cols as materialized ({COLUMNS_DUCK}), {_fits}, {_fuzzy}"


def headers(spark, sf):
    return columns(spark, sf).where(~F.col("source_column").startswith("_col_")).select("source_column").distinct()


add("header_normalization",
    lambda spark, sf: columns(spark, sf).select(*COL, normalize_header(F.col("source_column")).alias("norm")),
    f"select {K}, col_idx, {d.normalize('source_column')} as norm from ({COLUMNS_DUCK})")
add("exact_matches",
    lambda spark, sf: m.exact_matches(headers(spark, sf)).select("source_column", "target", "name_similarity")
    .join(columns(spark, sf), "source_column").drop("k"),
    BASE + f" select {K}, col_idx, source_column, target, 0.97::double as name_similarity from exact join cols using (source_column)")
add("fuzzy_matches",
    lambda spark, sf: m.fuzzy_matches(headers(spark, sf)).select(
        "source_column", "target", F.round("score", 6).alias("score"), "fuzzy_order"),
    BASE + " select source_column, target, round(score, 6) as score, fuzzy_order::int as fuzzy_order from fuzzy")

_candidates = f"""cands as (
    select {K}, col_idx, source_column, target, 1 as tier, 0 as cand_order, 'exact' as method, 0.97::double as sim, 1.0::double as agree from named join exact using (source_column)
    union all select {K}, col_idx, source_column, target, 2, fuzzy_order, 'fuzzy', score / 100::double * 0.92::double, 0.7::double from named join fuzzy using (source_column)),
  rated as (select c.*, f.map_fit, f.contradicts, printf('%.4f', least(1, greatest(0, c.sim * 0.45::double + f.map_fit * 0.35::double + c.agree * 0.20::double)))::double as confidence
    from cands c join fits f on c.file_id = f.file_id and c.sheet_name = f.sheet_name and c.col_idx = f.col_idx and c.target = f.target),
  viable as (select *, row_number() over (partition by {K}, col_idx order by tier, case when tier < 2 then 0 else -confidence end, cand_order) as seq
    from rated where not contradicts and (tier < 2 or confidence >= 0.5))"""
CANDS = BASE + ", " + _candidates


def candidates(spark, sf):
    return m.map_candidates(columns(spark, sf).drop("k"), packed(spark, sf))


add("mapping_candidates",
    lambda spark, sf: candidates(spark, sf).select(*COL, "source_column", "target", "tier", "method", "confidence", "contradicts"),
    CANDS + f" select {K}, col_idx, source_column, target, tier, method, confidence, contradicts from rated")
add("best_candidates",
    lambda spark, sf: m.best_candidate(m.viable_candidates(candidates(spark, sf))).select(
        *COL, "source_column", "target", "method", "confidence", "review_required", "rationale"),
    CANDS + f""" select {K}, col_idx, source_column, target, method, confidence, confidence < 0.9 as review_required,
      case when tier = 1 then concat('Exact normalized match. VPF=', printf('%.2f', map_fit), '.') else concat('Matched via fuzzy. VPF=', printf('%.2f', map_fit), '.') end as rationale
      from viable where seq = 1""")
# One claim per step and sheet: the strongest current bid commits, or moves on if its target is taken.
_assigned = f"""lists as materialized (select {K}, col_idx, list(target order by seq) as targets, list(confidence order by seq) as bids from viable group by all),
  state as (
    select {K}, 0 as step, []::varchar[] as claimed, list_transform(range({WIDTH}), lambda i: 1) as heads, -1 as won_col, 0 as won_seq from (select distinct {K} from lists)
    union all
    select {K}, step + 1,
      case when list_contains(claimed, targets[head]) then claimed else list_append(claimed, targets[head]) end,
      list_transform(heads, lambda h, i: case when i <> col_idx + 1 then h
        when list_contains(claimed, targets[head]) then coalesce(list_filter(range(head + 1, len(targets) + 1), lambda n: not list_contains(claimed, targets[n]))[1], 0)
        else 0 end)::int[],
      case when list_contains(claimed, targets[head]) then -1 else col_idx end, head
    from (select s.*, l.col_idx, l.targets, s.heads[l.col_idx + 1] as head,
        row_number() over (partition by {K} order by l.bids[s.heads[l.col_idx + 1]] desc, l.col_idx) as rn
      from state s join lists l using ({K}) where s.heads[l.col_idx + 1] > 0) where rn = 1),
  assigned as (select v.* from state s join viable v on s.file_id = v.file_id and s.sheet_name = v.sheet_name and s.won_col = v.col_idx and s.won_seq = v.seq)"""
ASSIGNED = CANDS + ", " + _assigned
add("assigned_targets",
    lambda spark, sf: m.assign_targets(m.viable_candidates(candidates(spark, sf))).select(*COL, "source_column", "target", "method", "confidence"),
    ASSIGNED + f" select {K}, col_idx, source_column, target, method, confidence from assigned")


def mapping(spark, sf, cands=None):
    """The mapping table, from settled candidates if they are there."""
    cands = store(candidates(spark, sf)) if cands is None else cands
    won = store(m.assign_targets(m.viable_candidates(cands)))
    return m.mapping_table(columns(spark, sf).drop("k"), won, m.veto_reasons(cands), m.plausible_targets(packed(spark, sf)))


_mapping = f"""free as materialized (select f.* from fits f anti join assigned x on x.file_id = f.file_id and x.sheet_name = f.sheet_name and x.target = f.target where f.fit > 0.35),
  mapping as (select c.file_id, c.sheet_name, c.col_idx, c.source_column, a.target, coalesce(a.confidence, 0) as confidence,
    coalesce(a.method, 'unresolved') as method, case when a.target is not null then a.confidence < 0.9 else not starts_with(c.source_column, '_col_') end as review_required,
    case when a.tier = 1 then concat('Exact normalized match. VPF=', printf('%.2f', a.map_fit), '.') when a.tier = 2 then concat('Matched via fuzzy. VPF=', printf('%.2f', a.map_fit), '.')
      when starts_with(c.source_column, '_col_') then 'Unnamed/index column — skipped.'
      when p.col_idx is not null then 'Could not confidently map this column to any target field.'
      else 'No candidate fields met minimum similarity threshold.' end as rationale
  from cols c left join assigned a on c.file_id = a.file_id and c.sheet_name = a.sheet_name and c.col_idx = a.col_idx
    left join (select distinct {K}, col_idx from free) p on c.file_id = p.file_id and c.sheet_name = p.sheet_name and c.col_idx = p.col_idx)"""
MAPPED = ASSIGNED + ", " + _mapping
# Evidence of the columns that found no target: vetoes of targets that other columns hold do not count.
add("mapping_veto_reasons",
    lambda spark, sf: mapping(spark, sf).where("target is null and size(evidence) > 1").select(
        *COL, F.array_join(F.slice("evidence", 2, 1000), "|").alias("reasons")),
    MAPPED + f""" select r.file_id, r.sheet_name, r.col_idx, string_agg(case r.tier when 1 then concat('Header matches ''', r.target, ''' but values contradict it (VPF=', printf('%.2f', r.map_fit), ').')
      else concat('''', r.target, ''' (', r.method, ') vetoed: values contradict it (VPF=', printf('%.2f', r.map_fit), ').') end, '|' order by r.tier, r.cand_order) as reasons
      from rated r anti join assigned a on a.file_id = r.file_id and a.sheet_name = r.sheet_name and a.col_idx = r.col_idx
      anti join assigned x on x.file_id = r.file_id and x.sheet_name = r.sheet_name and x.target = r.target where r.contradicts group by all""")


def free_targets(spark, sf):
    """Shortlists of the columns without a target, over the targets no other column holds."""
    own = columns(spark, sf).drop("k")
    won = store(m.assign_targets(m.viable_candidates(store(candidates(spark, sf)))))
    open_ = m.blocked_targets(own, won).join(won.select(*COL), COL, "left_anti")
    return m.shortlist(fits(spark, sf).join(open_.select(*COL), COL, "left_semi"), blocked=open_)


add("free_targets", lambda spark, sf: free_targets(spark, sf).select(*COL, "rank", "target"),
    MAPPED + f""" select {K}, col_idx, rank::int as rank, target from (select f.*, row_number() over (partition by {K}, col_idx order by fit desc, target_pos) as rank
      from free f anti join assigned a on a.file_id = f.file_id and a.sheet_name = f.sheet_name and a.col_idx = f.col_idx) where rank <= 5""")
add("mapping_table",
    lambda spark, sf: mapping(spark, sf).select(*COL, "source_column", "target", "confidence", "method", "review_required", "rationale"),
    MAPPED + " select * from mapping")
add("mapping_report", lambda spark, sf: m.mapping_report(mapping(spark, sf)).drop("rationale"),
    MAPPED + f" select {K}, source_column, coalesce(target, 'Unmapped') as target_field, confidence, method, case when review_required then 'Yes' else 'No' end as review_required from mapping")
add("mapping_summary",
    lambda spark, sf: m.mapping_summary(mapping(spark, sf), digits=None).select(
        *KEYS, "n_columns", "n_mapped", "n_high_confidence", F.round("mean_confidence", 9).alias("mean_confidence"),
        F.array_join("unmapped_columns", "|").alias("unmapped_columns"), F.size("unmapped_targets").alias("n_unmapped_targets")),
    MAPPED + f""" select {K}, count(*) as n_columns, count(target) as n_mapped, count(case when confidence >= 0.9 then 1 end) as n_high_confidence,
      round(coalesce(avg(case when target is not null then confidence end), 0), 9) as mean_confidence,
      coalesce(string_agg(case when target is null then source_column end, '|' order by col_idx), '') as unmapped_columns,
      (17 - count(distinct target))::int as n_unmapped_targets from mapping group by all""")
add("unmapped_targets", lambda spark, sf: m.unmapped_targets(mapping(spark, sf)),
    MAPPED + f""" select s.file_id, s.sheet_name, t.target from (select distinct {K} from mapping) s, (select * from {_targets}) t
      where not exists (select 1 from mapping x where x.file_id = s.file_id and x.sheet_name = s.sheet_name and x.target = t.target)""")

# An externally edited mapping table in which several columns of a sheet claim one target.
CLAIMS = " union all ".join(
    f"select c_mktsegment as file_id, c_name as sheet_name, {j} as col_idx, {_pick(f'c_custkey * 5 + {j} * 7', HEADERS)} as source_column, "
    f"{_pick(f'c_custkey * 3 + {j} * {j}', [*TARGET_FIELDS[:7], None])} as target, "
    f"cast((c_custkey * 7 + {j} * 13) % 50 + 50 as double) / 100 as confidence, 'exact' as method, 'kept' as rationale, false as review_required from {{customer}}"
    for j in range(WIDTH))
def claims(spark, sf):
    j, k = F.col("col_idx"), F.col("k")
    return columns(spark, sf).select(
        *COL, "source_column", _choice(k * 3 + j * j, [*TARGET_FIELDS[:7], None]).alias("target"),
        (((k * 7 + j * 13) % 50 + 50) / 100).alias("confidence"), F.lit("exact").alias("method"),
        F.lit("kept").alias("rationale"), F.lit(False).alias("review_required"))


add("demoted_duplicates", lambda spark, sf: m.demote_duplicates(claims(spark, sf)),
    f"""with c as (select *, row_number() over w as r, first_value(source_column) over w as winner from ({duck_sql(CLAIMS)})
        window w as (partition by {K}, target order by confidence desc, col_idx))
      select {K}, col_idx, source_column, case when target is null or r = 1 then target end as target,
        case when target is not null and r > 1 then 0 else confidence end as confidence,
        case when target is not null and r > 1 then 'unresolved' else method end as method,
        case when target is not null and r > 1 then concat('Demoted: ''', target, ''' already claimed by ''', winner, ''' with higher confidence.') else rationale end as rationale,
        (target is not null and r > 1) as review_required from c""")

# Two evidence tables over the parts, overlapping in half of their pairs.
FUZZY = f"select p_name as source_column, {_pick('p_size', TARGET_FIELDS)} as target, max(p_size) as fuzzy_order, max(p_retailprice) / 2500 as name_similarity from {{part}} group by 1, 2"
SEMANTIC = f"select p_name as source_column, {_pick('p_size * 3', TARGET_FIELDS)} as target, min(p_size) as semantic_order, min(p_retailprice) / 2000 as name_similarity from {{part}} where p_size <= 25 group by 1, 2"


def _evidence(spark, sf, sql, word):
    return spark_sql(spark, sf, sql).withColumn("evidence", F.array(F.lit(word)))


add("combined_matches",
    lambda spark, sf: m.combine_matches(_evidence(spark, sf, FUZZY, "f"), _evidence(spark, sf, SEMANTIC, "s")).withColumn(
        "evidence", F.array_join("evidence", "|")).withColumn("cand_order", F.col("cand_order").cast("int")),
    f"""select source_column, target, case when f.name_similarity is not null then 'fuzzy' else 'semantic' end as method,
        case when f.name_similarity is not null and s.name_similarity is not null then (f.name_similarity + s.name_similarity) / 2 else coalesce(f.name_similarity, s.name_similarity) end as name_similarity,
        case when f.name_similarity is not null and s.name_similarity is not null then 1.0::double else 0.7::double end as method_agreement,
        coalesce(fuzzy_order, semantic_order + 100)::int as cand_order,
        concat_ws('|', case when f.name_similarity is not null then 'f' end, case when s.name_similarity is not null then 's' end) as evidence
      from ({duck_sql(FUZZY)}) f full join ({duck_sql(SEMANTIC)}) s using (source_column, target)""")
add("mapping_confidence",
    lambda spark, sf: table(spark, sf, "part").select(
        "p_partkey", m.confidence(F.col("p_retailprice") / 2000, F.col("p_size") / 50, F.lit(0.7), digits=None).alias("plain"),
        m.confidence(F.col("p_retailprice") / 2000, F.col("p_size") / 50, F.lit(1.0), F.col("p_type") == "ECONOMY").alias("boosted")),
    """with s as (select p_partkey, p_type, p_retailprice / 2000 * 0.45::double + p_size / 50 * 0.35::double as base from part)
      select p_partkey, least(1, greatest(0, base + 0.7::double * 0.20::double)) as plain,
        printf('%.4f', least(1, greatest(0, case when p_type = 'ECONOMY' then least(0.99::double, (base + 1.0::double * 0.20::double) * 1.1::double) else base + 1.0::double * 0.20::double end)))::double as boosted from s""")

PROPOSALS = (f"select c_mktsegment as file_id, c_name as sheet_name, {_pick('c_custkey * 5 + 28', HEADERS)} as source_column, "
             f"{_pick('c_custkey', [*TARGET_FIELDS, 'Elevation', 'Notes'])} as target, cast(c_custkey % 60 + 40 as double) / 100 as confidence, "
             "'looks right' as rationale from {customer}")
_proposed = f"""props as ({duck_sql(PROPOSALS)}),
  judged as materialized (select p.*, c.col_idx, f.map_fit, f.contradicts from props p
    left join cols c on p.file_id = c.file_id and p.sheet_name = c.sheet_name and p.source_column = c.source_column
    left join fits f on c.file_id = f.file_id and c.sheet_name = f.sheet_name and c.col_idx = f.col_idx and f.target = p.target)"""
# Headers that match exactly claim their targets first; one proposal per sheet then takes what is still free.
_EXACT = f"""with cols as materialized ({COLUMNS_DUCK}), {_fits}, known as (select *, {d.normalize('text')} as norm_text from {d.CORPUS} c),
  heads as materialized (select distinct source_column, {d.normalize('source_column')} as norm from cols where not starts_with(source_column, '_col_')),
  exact as materialized (select source_column, any_value(target) as target from heads join known on norm = norm_text and kind <> 'definition' group by all),
  rated as materialized (select c.file_id, c.sheet_name, c.col_idx, x.target, f.map_fit,
      printf('%.4f', least(1, greatest(0, 0.97::double * 0.45::double + f.map_fit * 0.35::double + 0.20::double)))::double as confidence
    from cols c join exact x using (source_column) join fits f on c.file_id = f.file_id and c.sheet_name = f.sheet_name and c.col_idx = f.col_idx and f.target = x.target
    where not f.contradicts),
  assigned as materialized (select * from rated qualify row_number() over (partition by {K}, target order by confidence desc, col_idx) = 1),
  free as materialized (select distinct f.file_id, f.sheet_name, f.col_idx from fits f anti join assigned x on x.file_id = f.file_id and x.sheet_name = f.sheet_name and x.target = f.target
    where f.fit > 0.35)"""


def accepted(spark, sf):
    own, fit = columns(spark, sf).drop("k"), settle(packed(spark, sf))
    viable = m.viable_candidates(m.map_candidates(own, fit).where("tier = 1"))
    return m.assign_targets(viable.unionByName(m.proposal_candidates(spark_sql(spark, sf, PROPOSALS), own, fit))).where("method = 'llm'")


add("accepted_proposals",
    lambda spark, sf: accepted(spark, sf).select(
        *COL, "source_column", "target", F.round("name_similarity", 9).alias("name_similarity"), "confidence", "review_required"),
    f"""{_EXACT}, {_proposed} select j.file_id, j.sheet_name, j.col_idx, j.source_column, j.target, round(j.confidence * 0.85::double, 9) as name_similarity,
      printf('%.4f', j.confidence * 0.85::double * 0.45::double + j.map_fit * 0.35::double + 0.7::double * 0.20::double)::double as confidence, true as review_required
      from judged j semi join free x on x.file_id = j.file_id and x.sheet_name = j.sheet_name and x.col_idx = j.col_idx
      anti join assigned a on a.file_id = j.file_id and a.sheet_name = j.sheet_name and a.col_idx = j.col_idx
      anti join assigned t on t.file_id = j.file_id and t.sheet_name = j.sheet_name and t.target = j.target where not j.contradicts""")
add("rejected_proposals",
    lambda spark, sf: m.rejected_proposals(spark_sql(spark, sf, PROPOSALS), columns(spark, sf).drop("k"), packed(spark, sf)),
    f"""{_EXACT}, {_proposed} select {K}, source_column, target, case when target in ('Elevation', 'Notes') then concat('invalid target: ', target)
      when col_idx is null then 'unknown source column' else 'values contradict the target' end as reason
      from judged where target in ('Elevation', 'Notes') or col_idx is null or contradicts""")

# --- memory: approvals are events, remembered headers are (type, user) spellings ------------
MEMORY = (f"select concat(event_type, '_', cast(user_id as string)) as source_column, {_pick('event_id', TARGET_FIELDS)} as target_field, "
          "value / 100 as confidence, ts, event_type from {events}")


def memory_parts(spark, sf):
    events = spark_sql(spark, sf, MEMORY)
    old = mem.memory_entries(events.where("event_type <> 'click'"))
    new = mem.memory_entries(events.where("event_type = 'click'").withColumn("source_column", F.initcap("source_column")))
    return old, new


_memory = f"""entries as (select {d.normalize_memory('source_column')} as normalized_source, *, 0 as is_new from ({duck_sql(MEMORY)}) where event_type <> 'click'
    union all select {d.normalize_memory('source_column')}, concat('Click', substr(source_column, 6)), target_field, confidence, ts, event_type, 1 from ({duck_sql(MEMORY)}) where event_type = 'click'),
  memory as (select * from entries qualify row_number() over (partition by normalized_source, target_field order by ts desc, is_new desc, source_column desc, confidence desc) = 1)"""
add("memory_upsert",
    lambda spark, sf: mem.upsert_memory(*memory_parts(spark, sf)).select(
        "normalized_source", "source_column", "target_field", "confidence", "method", "approved_by",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts")),
    f"with {_memory} select normalized_source, source_column, target_field, confidence, 'human_approved' as method, 'human' as approved_by, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts from memory")
add("memory_matches",
    lambda spark, sf: mem.memory_matches(
        table(spark, sf, "events").select(F.upper(F.concat("event_type", F.lit(" - "), "user_id")).alias("source_column")).distinct(),
        mem.upsert_memory(*memory_parts(spark, sf))),
    f"""with {_memory} select upper(concat(h.event_type, ' - ', h.user_id)) as source_column, m.source_column as memory_source, target_field as target, confidence as memory_confidence, 1.0::double as similarity
      from (select distinct event_type, user_id from events) h join (select * from memory qualify row_number() over (partition by normalized_source order by ts desc, confidence desc, target_field) = 1) m
      on m.normalized_source = concat(h.event_type, ' ', h.user_id)""")
# The memory as a bucketed table: old approvals, compacted, then new ones beside them.
def memory_table(spark, sf):
    name = f"memory_{uuid.uuid4().hex}"
    folder = f"{checkpoint_folder(spark)}/{name}"
    old, new = memory_parts(spark, sf)
    mem.create_memory(spark, name, f"{folder}/0")
    mem.append_memory(old.where("target_field < 'D'"), name)
    mem.append_memory(old.where("target_field >= 'D'"), name)
    mem.compact_memory(spark, name, f"{folder}/1")
    mem.append_memory(new, name)
    return name


add("memory_table",
    lambda spark, sf: mem.read_memory(spark, memory_table(spark, sf)).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")),
    f"with {_memory} select normalized_source, source_column, target_field, confidence, 'human_approved' as method, 'human' as approved_by, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts from memory")
add("memory_table_matches",
    lambda spark, sf: mem.memory_matches(
        table(spark, sf, "events").select(F.upper(F.concat("event_type", F.lit(" - "), "user_id")).alias("source_column")).distinct(),
        mem.read_memory(spark, memory_table(spark, sf))),
    SQL["memory_matches"])


def unit(v):
    return F.transform(v, lambda x: x / F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, y: acc + y * y)))


def centroids(spark, sf):
    """Unit mean vector per label: a corpus whose size is the number of labels."""
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = e.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v")).select(
        F.col("label").alias("idx"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("text"),
        F.concat(F.lit("group "), F.floor(F.col("label") / 2).cast("string")).alias("target"),
        unit(F.col("v.x")).alias("vector"))


def leaning(spark, sf, pull=1.0):
    """Every embedding pulled towards its label's centroid, as header vectors."""
    c = settle(centroids(spark, sf)).select(F.col("idx").alias("label"), F.col("vector").alias("c"))
    mixed = F.zip_with(F.col("embedding"), F.col("c"), lambda x, y: x.cast("double") + y * pull)
    return table(spark, sf, "embeddings").join(F.broadcast(c), "label").select("vec_id", unit(mixed).alias("vector"))


def _vectors_sql(pull=1.0):
    return f"""e as (select vec_id, label, embedding::double[] as v from embeddings),
  means as (select label, pos, avg(x) as x from (select label, unnest(v) as x, generate_subscripts(v, 1) as pos from e) group by all),
  raw_c as (select label, list(x order by pos) as v from means group by all),
  c as (select label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as v from raw_c),
  mixed as (select vec_id, list_transform(range(1, len(e.v) + 1), lambda i: e.v[i] + c.v[i] * {pull}::double) as v from e join c using (label)),
  h as (select vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as v from mixed)"""


_vectors = _vectors_sql()
add("memory_search",
    lambda spark, sf: mem.search_memory(
        leaning(spark, sf).select(F.col("vec_id").alias("header_id"), "vector"),
        centroids(spark, sf).select(F.col("idx").alias("memory_id"), "vector"))
    .withColumn("similarity", F.round("similarity", 5)),
    f"""with {_vectors}, s as (select vec_id, label, greatest(0, 1 - pow(list_distance(h.v, c.v), 2) / 2) as similarity from h, c)
      select vec_id as header_id, label as memory_id, round(similarity, 5) as similarity, rank::int as rank from (
        select *, row_number() over (partition by vec_id order by similarity desc, label) as rank from s where similarity > 0.5) where rank <= 3""")
# The whole table on both sides: the nearest remembered entries of every vector, itself among them.
def memory_all(spark, sf):
    every = table(spark, sf, "embeddings").where("vec_id is not null").select("vec_id", unit(F.transform("embedding", lambda x: x.cast("double"))).alias("vector"))
    hits = mem.search_memory(every.withColumnRenamed("vec_id", "header_id"), every.withColumnRenamed("vec_id", "memory_id"))
    return hits.withColumn("similarity", F.round("similarity", 5))


add("memory_search_all", memory_all,
    """with u as (select vec_id, list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as v from embeddings),
      s as (select q.vec_id as header_id, c.vec_id as memory_id, greatest(0, 1 - pow(list_distance(q.v, c.v), 2) / 2) as similarity from u q, u c)
      select header_id, memory_id, round(similarity, 5) as similarity, rank::int as rank from (
        select *, row_number() over (partition by header_id order by round(similarity, 9) desc, memory_id) as rank from s where similarity > 0.5) where rank <= 3""")
add("semantic_matches",
    lambda spark, sf: m.semantic_matches(
        leaning(spark, sf).select(F.col("vec_id").cast("string").alias("source_column"), "vector"), centroids(spark, sf)).select(
        "source_column", "target", F.round("similarity", 5).alias("similarity"), F.round("name_similarity", 5).alias("name_similarity"),
        F.col("semantic_order").cast("int").alias("semantic_order")),
    f"""with {_vectors}, s as (select vec_id, concat('group ', label // 2) as target, list_cosine_similarity(h.v, c.v) as similarity from h, c),
      best as (select vec_id, target, max(similarity) as similarity from s group by all),
      top as (select *, row_number() over (partition by vec_id order by similarity desc) as semantic_order from best where similarity >= 0.70)
      select vec_id::varchar as source_column, target, round(similarity, 5) as similarity, round(similarity * 0.90::double, 5) as name_similarity, semantic_order::int as semantic_order from top where semantic_order <= 5""")


def remembered_vectors(spark, sf):
    return centroids(spark, sf).select(
        F.col("idx").alias("memory_id"), F.col("text").alias("memory_source"), "target",
        ((F.col("idx") % 10 + 1) / 10).alias("memory_confidence"), "vector")


add("memory_nearest",
    lambda spark, sf: mem.nearest_matches(
        leaning(spark, sf, 3.0).select(F.col("vec_id").cast("string").alias("source_column"), "vector"),
        remembered_vectors(spark, sf)).withColumn("similarity", F.round("similarity", 5)),
    f"""with {_vectors_sql(3.0)}, s as (select vec_id, label, greatest(0, 1 - pow(list_distance(h.v, c.v), 2) / 2) as similarity from h, c)
      select vec_id::varchar as source_column, concat('label ', label) as memory_source, concat('group ', label // 2) as target,
        (label % 10 + 1) / 10 as memory_confidence, round(similarity, 5) as similarity
      from (select * from s qualify row_number() over (partition by vec_id order by similarity desc, label) = 1) where similarity > 0.85""")
# Approved headers of the memory come from the same spellings, two targets per header.
REMEMBERED = f"""select {_pick('c_custkey', HEADERS)} as source_column, {_pick('c_custkey * 3', TARGET_FIELDS)} as target_field,
  cast(c_custkey % 60 + 41 as double) / 100 as confidence, cast(concat('2024-01-01 00:00:', lpad(cast(c_nationkey as string), 2, '0')) as timestamp) as ts from {{customer}}"""
add("memory_candidates",
    lambda spark, sf: m.map_candidates(
        columns(spark, sf).drop("k"), packed(spark, sf),
        memory=mem.upsert_memory(mem.memory_entries(spark_sql(spark, sf, REMEMBERED).where("false")), mem.memory_entries(spark_sql(spark, sf, REMEMBERED))))
    .where("tier = 0").select(*COL, "source_column", "target", "confidence", "contradicts"),
    BASE + f""", e as (select {d.normalize_memory('source_column')} as norm, * from ({duck_sql(REMEMBERED)})),
      latest as (select * from e qualify row_number() over (partition by norm, target_field order by ts desc, source_column desc, confidence desc) = 1),
      hit as (select * from latest qualify row_number() over (partition by norm order by ts desc, confidence desc, target_field) = 1)
      select n.file_id, n.sheet_name, n.col_idx, n.source_column, f.target,
        printf('%.4f', least(0.99::double, (least(hit.confidence, 0.99::double) * 0.45::double + f.map_fit * 0.35::double + 0.2::double) * 1.1::double))::double as confidence, f.contradicts
      from named n join hit on hit.norm = {d.normalize_memory('n.source_column')}
        join fits f on f.file_id = n.file_id and f.sheet_name = n.sheet_name and f.col_idx = n.col_idx and f.target = hit.target_field""")
