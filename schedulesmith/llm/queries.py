"""One registered query per corpus operator, over its whole table, with checking SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import boilerplate, centroids, chat, decontaminate, divergence, extract, mix, neardup, packing, quality, shards, suffixes, warc
from .common import n_words, read, stored, text_or_empty

Q, SQL = {}, {}


def add(name, fn, sql=None):
    Q[name] = fn
    if sql:
        SQL[name] = sql


# 1: main text of pages
add("op1_main_text", lambda spark, sf: extract.extract_main_text(read(spark, sf, "pages")))


# 2: quality rules
def op2(spark, sf):
    scored = quality.quality_rules(read(spark, sf, "documents").select("doc_id", "text", "lang", "source"), keep=F.struct("doc_id"))
    return scored.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_VALUE = {"symbols_per_word": "n_symbols / greatest(n_words, 1)", "word_length": "word_chars / greatest(n_words, 1)",
          "dup_line_share": "n_dup_lines / greatest(n_lines, 1)", "repeat_share": "n_repeat_words / greatest(n_words, 1)"}
_INSIDE = " and ".join(f"(coalesce({f.measure} <= {f.measure}_max, {f.measure} = 0)" + (f" and {f.measure} >= {f.measure}_min" if f.lower else "") + ")" for f in quality.FENCES)


def _fence(f):
    """Upper and lower limit of a measure from the percentiles of its sketch."""
    d = lambda x: f"cast({x} as double)"
    high = {"quartiles": f"q75 + {d(f.spread)} * (q75 - q25)", "tail": f"s90 + {d(f.spread)} * (s90 - s50)",
            "rare": f"case when q90 > 0 then q90 + {d(f.spread)} * (q90 - q50) else {d(f.share)} * s50 end"}[f.kind]
    return f"({high}) * {d(quality.GAMMA)}", f"(q25 - {d(f.spread)} * (q75 - q25)) / {d(quality.GAMMA)}"


QUALITY_CTES = rf"""words as materialized (
    select doc_id, lang, source, {_WORDS} as w, coalesce(text, '') as text,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from documents),
grams as (select rowid_, g.i as i, count(*) over (partition by rowid_, g.g) as c from (
    select rowid_, unnest(list_transform(range(1, len(w) - 1), lambda i: {{'i': i, 'g': hash(w[i], w[i + 1], w[i + 2])}})) as g
    from (select row_number() over () as rowid_, w from words))),
covered as (select rowid_, count(distinct p) as n from (select rowid_, unnest([i, i + 1, i + 2]) as p from grams where c > 1) group by 1),
scored as materialized (
    select doc_id, lang, source, cast(len(w) as bigint) as n_words,
           cast(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
           cast(length(text) - length(translate(text, '#*$%&|<>', '')) as bigint) as n_symbols,
           cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(len(lines) as bigint) as n_lines,
           cast(coalesce(n, 0) as bigint) as n_repeat_words
    from (select *, row_number() over () as rowid_ from words) left join covered using (rowid_)),
measured as materialized (
    select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, {', '.join(f'{v} as {k}' for k, v in _VALUE.items())} from scored),
bins as materialized ({' union all '.join(
    f"select lang, source, '{m}' as measure, case when {m} > 0 then ceil(ln({m}) / ln({quality.GAMMA})) end as bin, count(*) as n from measured where not base_failed group by all"
    for m in _VALUE)}),
levels as (select 0 as level, lang, source, measure, bin, n from bins
    union all select 1, lang, null, measure, bin, sum(n) from bins group by all
    union all select 2, null, null, measure, bin, sum(n) from bins group by all),
ranked as (select *, sum(n) over (partition by level, lang, source, measure order by bin nulls first rows unbounded preceding) as upto,
    sum(n) over (partition by level, lang, source, measure) as total,
    sum(n) filter (bin is not null) over (partition by level, lang, source, measure order by bin nulls first rows unbounded preceding) as some_upto,
    coalesce(sum(n) filter (bin is not null) over (partition by level, lang, source, measure), 0) as some_,
    case when bin is null then 0 else 2 * power({quality.GAMMA}, bin) / ({quality.GAMMA} + 1) end as value from levels),
found as (select level, lang, source, measure, max(total) as total, max(some_) as some_,
    {', '.join(f'min(value) filter (upto * 100 >= total * {p}) as q{p}' for p in (25, 50, 75, 90))},
    {', '.join(f'min(value) filter (some_upto * 100 >= some_ * {p}) as s{p}' for p in (50, 90))} from ranked group by all),
leveled as (select o.lang, o.source, o.measure, {', '.join(
    f"case when o.{n} >= {quality.MIN_DOCS} then o.{c} when l.{n} >= {quality.MIN_DOCS} then l.{c} else a.{c} end as {c}"
    for c, n in [(f'q{p}', 'total') for p in (25, 50, 75, 90)] + [(f's{p}', 'some_') for p in (50, 90)])}
    from (select * from found where level = 0) o join (select * from found where level = 1) l on o.lang is not distinct from l.lang and o.measure = l.measure
    join (select * from found where level = 2) a on o.measure = a.measure),
chosen as (select lang, source, {', '.join(
    f"max({limit}) filter (measure = '{f.measure}') as {f.measure}_{side}" for f in quality.FENCES for side, limit in zip(('max', 'min'), _fence(f)) if side == 'max' or f.lower)}
    from leveled group by all),
judged as (select m.*, not base_failed and coalesce({_INSIDE}, false) as kept from measured m
    left join chosen c on m.lang is not distinct from c.lang and m.source is not distinct from c.source)"""
add("op2_quality_rules", op2, f"with {QUALITY_CTES} select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept from judged")


# 3: sharding
def op3(spark, sf):
    dealt = shards.shuffle_into_shards(read(spark, sf, "documents"))
    text = text_or_empty("row.text")
    return dealt.select("row.doc_id", shards.text_size(text).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
                        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


add("op3_two_pass_shards", op3)


# 4: repeated byte strings
def op4(spark, sf):
    cut = suffixes.remove_repeated(read(spark, sf, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
                      F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


add("op4_suffix_dedup", op4)


# 5: boilerplate lines of sites
def op5(spark, sf):
    pages = read(spark, sf, "pages").select("page_id", boilerplate.host_of(F.col("url")).alias("host"), boilerplate.visible_lines(F.col("html")).alias("lines"))
    cut = boilerplate.drop_site_boilerplate(pages)
    return cut.select("page_id", "host", "host_pages", F.size("kept").cast("long").alias("n_kept"), F.size("removed").cast("long").alias("n_removed"),
                      F.array_join("kept", "\n").alias("text"))


_LINES = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
    '(?is)<!--.*?-->|<(?:script\b.*?</script|style\b.*?</style|head\b.*?</head)\s*>', ' ', 'g'), '[\x00-\x20]+', ' ', 'g'),
    '(?i)</?(?:p|div|li|ul|ol|nav|article|section|header|footer|aside|main|h[1-6]|br|tr|td|th|table|form|body|html|blockquote|pre)\b[^>]*>', chr(10), 'g'),
    '<[^>]*>', '', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')"""
add("op5_site_lines", op5, rf"""with p as materialized (select page_id, row_number() over () as r, {_LINES} as lines,
    lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) as host from pages),
totals as (select host, count(*) as host_pages from p group by 1),
common as (select host, line from (select host, line, count(distinct r) as n from (select host, r, unnest(lines) as line from p) group by 1, 2) join totals using (host)
    where host_pages >= {boilerplate.MIN_PAGES} and n > host_pages * cast({boilerplate.RATIO} as double)),
lists as (select host, host_pages, coalesce(list(line) filter (line is not null), []) as bad from totals left join common using (host) group by all)
select page_id, host, host_pages, cast(len(kept) as bigint) as n_kept, cast(len(lines) - len(kept) as bigint) as n_removed, array_to_string(kept, chr(10)) as text
from (select page_id, host, host_pages, lines, list_filter(lines, lambda x: not list_contains(bad, x)) as kept from p join lists using (host))""")


# 6: chat formatting
PROBE = "<|im_end|><|im_start|>assistant ok"


def op6(spark, sf):
    turns = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return chat.chat_digest(chat.format_conversations(turns.unionByName(probe)))


_ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"
_ROLES = "array_to_string(list(coalesce(role, '') order by turn nulls first, role nulls first, text nulls first), ' ')"
add("op6_chat_format", op6, rf"""with t as (select conv_id, turn, role, text from conversations
    union all select -1, 0, 'user', '{PROBE}' union all select -1, 1, 'assistant', '{PROBE}'),
c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
    cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    cast(sum(length('<|im_start|><|im_sep|><|im_end|>') + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')})) as bigint) as formatted_chars,
    regexp_full_match({_ROLES}, '(system )?user assistant( user assistant)*') as valid
from c group by conv_id""")


# 7: near duplicates
def op7(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    classes = neardup.near_duplicates(docs).withColumnRenamed("key", "k")
    keyed = docs.select("doc_id", F.md5("text").alias("key"))
    joined = keyed.join(classes.hint("merge"), F.col("key") == F.col("k"), "left")
    return joined.select("doc_id", F.coalesce("class_first", "doc_id").alias("class_id"), F.coalesce("class_docs", F.lit(1)).cast("long").alias("class_docs"),
                         F.coalesce("class_texts", F.lit(1)).cast("long").alias("class_texts"))


add("op7_near_duplicates", op7)


# 8: mixing
def op8(spark, sf):
    sizes = stored(read(spark, sf, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size")), "document-sizes")
    mixed = mix.mix(sizes, size=F.col("size"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


MIX_CTES = f"""
sized as materialized (select doc_id, source, cast(len({_WORDS}) as bigint) as size from DOCUMENTS),
totals as (select source, cast(sum(size) as bigint) as source_size from sized group by 1),
weighted as (select source, source_size, source_size * {mix.LIMIT} as cap,
    cast([{', '.join(map(str, mix.WEIGHTS))}][(row_number() over (order by source nulls last) - 1) % {len(mix.WEIGHTS)} + 1] as bigint) as weight from totals),
leveled as (select *, sum(source_size) over () * cast({mix.SHARE} as double) - coalesce(sum(cap) over before, 0) as rest,
    sum(weight) over () - coalesce(sum(weight) over before, 0) as weights, row_number() over (order by cap / weight, source nulls last) as level_order from weighted
    window before as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
level as (select arg_min(rest / weights, level_order) filter (rest / weights * weight < cap) as part from leveled),
targets as (select source, source_size, least(coalesce(part * weight, cap), cap) as target from leveled, level),
ranked_rows as (select s.*, source_size, target, case when source_size > 0 then target / source_size else 0.0 end as rate,
    row_number() over (partition by s.source order by size, coalesce(md5(cast(doc_id as varchar)), ''), doc_id) - 1 as rank, count(*) over (partition by s.source) as n
    from sized s join targets t on s.source is not distinct from t.source),
placed as (select *, case when rank % 2 = 0 then rank // 2 else n - 1 - rank // 2 end as place from ranked_rows)"""
_OFFSET = repr(__import__("random").Random(mix.SEED).random())
add("op8_mix_sources", op8, f"""with {MIX_CTES.replace('DOCUMENTS', 'documents')}
select doc_id, size, source_size, cast(target as double) as target,
    cast(size * (floor((place + 1) * rate + cast({_OFFSET} as double)) - floor(place * rate + cast({_OFFSET} as double))) as bigint) as taken from placed""")


# 9: WARC
def op9(spark, sf):
    folder = warc.write_warc(read(spark, sf, "pages").select("page_id", "url", "html"))
    return warc.merge_index(warc.read_warc(spark, folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "index_at")


_REST = r"regexp_replace(lower(coalesce(url, '')), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(?:www\d*\.)?|#.*$', '', 'g')"
_URL_KEY = rf"""array_to_string(list_reverse(string_split(regexp_extract({_REST}, '^([^/?:]*)', 1), '.')), ',') || ')'
    || coalesce(nullif(regexp_replace({_REST}, '^[^/?]*', ''), ''), '/')"""
_CAPTURED = f"strftime(make_timestamp(({warc.FIRST_CAPTURE} + coalesce(page_id % 1000000000, 0)) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"
_QUARTERS = " || ".join(f"to_base(cast('0x' || substr(h, {10 * k + 1}, 10) as bigint), 32, 8)" for k in range(4))
add("op9_warc_index", op9, f"""with h as (select page_id, {_URL_KEY} as url_key, {_CAPTURED} as captured, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
d as (select page_id, url_key, captured, payload_bytes, translate({_QUARTERS}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') as payload_digest from h),
m as (select *, max(page_id) over (partition by payload_digest) as latest from d)
select page_id, payload_bytes, payload_digest, case when page_id is not distinct from latest then 'response' else 'revisit' end as record_type,
    case when page_id is distinct from latest then latest end as refers_to, url_key, captured,
    row_number() over (order by url_key, captured, page_id nulls first) - 1 as index_at from m""")


# 10: benchmark decontamination
def op10(spark, sf):
    found = decontaminate.find_contamination(read(spark, sf, "documents").select("doc_id", "text"), read(spark, sf, "benchmark"))
    return found.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_NORMAL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
CONTAMINATION_CTES = f"""
items as (select item_id, {_NORMAL} as w from benchmark),
windows as materialized (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as g from (
    select item_id, w, least(len(w), {decontaminate.WINDOW}) as n, unnest(range(1, len(w) - least(len(w), {decontaminate.WINDOW}) + 2)) as i from items where len(w) > 0)),
texts as materialized (select doc_id, row_number() over () as r, {_NORMAL} as w from documents),
places as (select r, n, i, array_to_string(w[i:i + n - 1], ' ') as g from (
    select r, w, n, unnest(range(1, cast(len(w) - n + 2 as bigint))) as i from texts, (select distinct n from windows) where len(w) >= n)),
found as materialized (select p.r, p.n, p.i, x.item_id from places p join windows x on p.g = x.g and p.n = x.n),
hits as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from (select distinct r, n, i from found)) group by 1),
named as (select r, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as names from (select distinct r, item_id from found) group by 1)"""
add("op10_decontaminate", op10, f"""with {CONTAMINATION_CTES}
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256,
    coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated from texts left join hits using (r) left join named using (r)""")


# 11: packing
def op11(spark, sf):
    pieces = packing.pack(read(spark, sf, "documents").select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


add("op11_hierarchical_packing", op11)


# 12: how sources differ
def op12(spark, sf):
    return divergence.audit(read(spark, sf, "documents").select("text", "lang", "source"))


_SHARE = f"1 + (cast({{}} as hugeint) + {divergence.PRIOR}) * {divergence.SCALE} // ({{}} + {divergence.PRIOR} * v)"
add("op12_source_divergence", op12, f"""with d as materialized (
    select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, {_NORMAL.replace('2F', '40').replace('x3A-', 'x5B-')} as w from documents),
t as (select r, lang, source, unnest(w) as term from d),
kept as materialized (select lang, term from t group by all having count(distinct r) >= {divergence.MIN_DOCS}),
counts as materialized (select lang, source, term, count(*) as n from t join kept using (lang, term) group by all),
groups as (select lang, source, cast(coalesce(total, 0) as bigint) as total, coalesce(v, 0) as v from (select distinct lang, source from d)
    left join (select lang, source, sum(n) as total from counts group by all) using (lang, source) left join (select lang, count(*) as v from kept group by all) using (lang)),
shares as materialized (select g.lang, g.source, k.term, coalesce(n, 0) as n, {_SHARE.format('coalesce(n, 0)', 'total')} as p
    from groups g join kept k using (lang) left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
whole as (select lang, term, {_SHARE.format('lang_n', 'lang_total')} as q from (select lang, term, sum(n) as lang_n from counts group by all)
    join (select lang, sum(total) as lang_total, max(v) as v from groups group by all) using (lang)),
sums as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from shares a join shares b using (lang, term) where a.source <> b.source group by all),
found as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source
        left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
    union all select lang, source, 'term', term, p - q from shares join whole using (lang, term) where n > 0 and p > q)
select lang, source, part, item, cast(value as bigint) as value, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank
from found qualify part = 'pair' or rank <= {divergence.TOP}""")


# 13: clusters of vectors
def op13(spark, sf):
    return centroids.cluster(read(spark, sf, "embeddings").select("vec_id", "embedding")).drop("centroid")


_D = centroids.DIMS
_ROUNDS = "".join(f"""
near{i} as materialized (select r, v, c, d from (select r, v, c, cast(list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint) as d
    from vectors, means{i}) qualify row_number() over (partition by r order by d, c) = 1),""" + (f"""
means{i + 1} as materialized (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as m from (
        select c, i, sum(x) as s, count(*) as n from (select c, unnest(v) as x, unnest(range({_D})) as i from near{i}) group by all) group by c
    union all select c, m from means{i} where c not in (select c from near{i})),""" if i < centroids.ROUNDS else "") for i in range(centroids.ROUNDS + 1))
add("op13_ptolemaic_clusters", op13, f"""with vectors as materialized (
    select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * {centroids.SCALE}) as bigint)) as v from embeddings
    where len(embedding) = {_D} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {_D}),
starts as (select row_number() over (order by sha256('{centroids.SEED}:' || coalesce(cast(vec_id as varchar), '')), v) - 1 as c, v as m from vectors),
means0 as materialized (select c, m from starts where c < {centroids.CLUSTERS}),{_ROUNDS}
ids as (select r, vec_id from vectors)
select vec_id, cast(c as integer) as cluster, d as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
    sha256(array_to_string(m, ',')) as centroid_sha256 from near{centroids.ROUNDS} join means{centroids.ROUNDS} using (c) join ids using (r)""")
