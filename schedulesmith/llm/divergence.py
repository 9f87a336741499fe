"""Audit of how the sources of a language differ in their terms."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attach, grouped, shared_folder, stored

# Documents of its language that a kept term needs; listed terms of a group.
MIN_DOCS, TOP = 30, 50
# Probabilities are whole parts of SCALE, each count raised by PRIOR.
SCALE, PRIOR = 1_000_000_000, 5
# Bytes of the first prefixes, and by what the length of prefixes grows from level to level.
FIRST, GROWTH = 4, 6
# Bits of the filter that tells tasks which prefixes are alive (2 MB); what passes by mistake is counted and falls out.
BITS = 24
# Bytes of counted prefixes that a task holds, as arrays, before it sums them up and hands them on.
HELD_BYTES = 16 << 20
# Rows (terms times sources) of a language that are compared in one group.
BLOCK_ROWS = 200_000

# Bytes of text whose words are numbered together; a longer text is read word by word.
CHUNK_BYTES = 3 << 20
# Bytes of an Arrow batch of texts or runs: each is held by the JVM, outside its heap, and by Python. A longer row is a batch of its own.
BATCH_BYTES = 4 << 20

# Ends a term; no term contains it.
END = b"\0"
# Letters in lower case, 0 for bytes that no term has (below A, between Z and a, between z and 0x80).
LETTERS = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 0 for c in range(256)], np.uint8)
TERM = re.compile(rb"[A-Za-z\x80-\xFF]+")


def _bit(lang: Column, prefix: Column) -> Column:
    """Place of a prefix in the filter, as ``_alive`` finds it."""
    return F.crc32(prefix).bitwiseXOR(F.crc32(lang.cast("binary"))).bitwiseAND((1 << BITS) - 1)


def _filter(prefixes: DataFrame) -> bytes:
    """The filter of (lang, prefix) rows, built in pieces of 4 KB; 2 MB whatever the number of rows."""
    bits = prefixes.select(_bit(F.col("lang"), F.col("prefix")).alias("bit"))
    pieces = bits.groupBy(F.shiftright("bit", 15).alias("piece")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(32767)).alias("bits"))
    whole = bytearray(1 << BITS - 3)
    for row in pieces.collect():
        whole[row["piece"] * 4096:(row["piece"] + 1) * 4096] = row["bits"]
    return bytes(whole)


def _alive(bits: bytes, prefixes: Iterable[bytes], langs: list[str]) -> list[np.ndarray]:
    """For each language, which of the prefixes may be alive."""
    codes = np.fromiter(map(zlib.crc32, prefixes), np.int64)
    table = np.frombuffer(bits, np.uint8)
    places = [(codes ^ zlib.crc32(lang.encode())) & (1 << BITS) - 1 for lang in langs]
    return [(table[at >> 3] >> (at & 7) & 1).astype(bool) for at in places]


class Words(NamedTuple):
    """The words of a few texts: the text of each, and its place among the distinct words."""

    text: np.ndarray
    code: np.ndarray
    distinct: pa.BinaryArray


def _words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of texts that lie one after another in ``data``."""
    letters = LETTERS.take(data)
    inside = letters != 0
    # Where a word starts or ends: at a change between letters and others, or between two texts.
    change = np.ones(len(data) + 1, bool)
    np.not_equal(inside[1:], inside[:-1], out=change[1:-1])
    change[offsets] = True
    at = np.flatnonzero(change)
    word = inside[at[:-1]]
    starts, sizes = at[:-1][word], np.diff(at)[word]
    packed = letters[inside]
    bounds = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=bounds[1:])
    words = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(packed)]).dictionary_encode()
    return Words(np.searchsorted(offsets, starts, "right") - 1, words.indices.to_numpy().astype(np.int64), words.dictionary)


def _chunks(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """(first row, last row, words) of runs of texts of about ``CHUNK_BYTES`` together; a long text is one run."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK_BYTES, "right")) - 1)
        if offsets[high] - offsets[low] > CHUNK_BYTES:
            counts = Counter(m.group().lower() for m in TERM.finditer(column[low].as_py()))
            code = np.repeat(np.arange(len(counts)), list(counts.values()))
            yield low, high, Words(np.zeros(len(code), np.int64), code, pa.array(list(counts), pa.binary()))
        else:
            yield low, high, _words(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
        low = high


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values, sorted, and how often each occurs."""
    ordered = np.sort(values)
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[first], np.diff(np.append(first, len(ordered)))


TABLE = "langs array<string>, sources array<string>, group_of binary, words binary, text binary, code binary, times binary"


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per run of texts: its (lang, source) groups, the group of each text, the distinct words, each with its end, and which text has which word how often."""
    kinds = (pa.list_(pa.string()), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    for batch in batches:
        groups = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for low, high, words in _chunks(batch.column(2)):
            index: dict[tuple, int] = {}
            group_of = np.array([index.setdefault(g, len(index)) for g in groups[low:high]], np.int32)
            n = max(1, len(words.distinct))
            pairs, times = _distinct(words.text * n + words.code)
            ended = b"".join(word + END for word in words.distinct.to_pylist())
            row = ([g[0] for g in index], [g[1] for g in index], group_of.tobytes(), ended,
                   (pairs // n).astype(np.int32).tobytes(), (pairs % n).astype(np.int32).tobytes(), times.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], ["langs", "sources", "group_of", "words", "text", "code", "times"])
    pa.default_memory_pool().release_unused()


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Runs started meanwhile send Python batches of about ``BATCH_BYTES``."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def term_table(docs: DataFrame) -> DataFrame:
    """The words of all texts as (text, word, times), dictionary by dictionary, in the shared folder: all that later passes read.

    Each run is a row group of its own, so a reader holds one at a time.
    """
    path = shared_folder(docs.sparkSession, "term-table")
    rows = docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(_tables, TABLE)
    with _small_batches(docs.sparkSession):
        rows.write.option("compression", "zstd").option("parquet.block.row.count.limit", 1).parquet(path)
    return docs.sparkSession.read.schema(TABLE).parquet(path)


class Run(NamedTuple):
    """A row of the table: its groups, the group of each text, the words, each with its end, and text, word and times of each pair."""

    groups: list[tuple]
    group_of: np.ndarray
    words: pa.BinaryArray
    text: np.ndarray
    code: np.ndarray
    times: np.ndarray


def _read_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[Run]:
    for batch in batches:
        for i in range(batch.num_rows):
            groups = list(zip(batch.column(0)[i].as_py(), batch.column(1)[i].as_py()))
            group_of, ended, text, code, times = (batch.column(k)[i].as_buffer() for k in range(2, 7))
            ends = np.flatnonzero(np.frombuffer(ended, np.uint8) == END[0]) + 1
            words = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), ended])
            of, *pairs = (np.frombuffer(x, np.int32).astype(np.int64) for x in (group_of, text, code, times))
            yield Run(groups, of, words, *pairs)


def _summed(held: list[tuple[np.ndarray, pa.Array, np.ndarray]]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Each (group, item) once, with the sum of its counts; there is one at least."""
    items = pa.chunked_array([x[1] for x in held]).dictionary_encode()
    distinct = items.chunk(0).dictionary
    n = len(distinct)
    pair = np.concatenate([x[0] for x in held]).astype(np.int64)
    pair *= n
    pair += np.concatenate([chunk.indices.to_numpy() for chunk in items.chunks])
    del items
    order = np.argsort(pair)
    pair = pair[order]
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    counts = np.add.reduceat(np.concatenate([x[2] for x in held])[order], first)
    pair = pair[first]
    return (pair // n).astype(np.int32), distinct.take(pa.array((pair % n).astype(np.int32))), counts


def _bytes(held: tuple[np.ndarray, pa.Array, np.ndarray]) -> int:
    return sum(x.nbytes for x in held)


def _counted(runs: Iterator[tuple[list[tuple], np.ndarray, pa.Array, np.ndarray]], limit: int, names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Sums the counts of items by group in the task; hands them on whenever the sums take more than half of ``limit`` bytes.

    A run gives its groups, and the group, item and count of each of its counts.
    """
    known: dict[tuple, int] = {}
    held: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
    size = 0

    def out(group, items, counts):
        columns = [pa.array(x, pa.string()) for x in zip(*known)]
        for a in range(0, len(group), 50_000):
            part = slice(a, a + 50_000)
            at = pa.array(group[part])
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in columns), items[part].cast(types[-2]), pa.array(counts[part], types[-1])], names)

    for groups, group, items, counts in runs:
        if not len(items):
            continue
        place = np.array([known.setdefault(g, len(known)) for g in groups], np.int32)
        held.append((place[group], items, counts))
        size += _bytes(held[-1])
        if size > limit:
            held = [_summed(held)]
            size = _bytes(held[0])
            if size > limit // 2:
                yield from out(*held.pop())
                known, size = {}, 0
    if held:
        yield from out(*_summed(held))
    del held
    pa.default_memory_pool().release_unused()  # a worker is kept for later tasks, also of stages without Python


def _prefix_counter(short: int, width: int, alive_bits: bytes | None, held_bytes: int) -> Callable:
    """Documents by prefix of ``width`` bytes, of the terms of ``short`` bytes or more whose shorter prefix may be alive.

    A term counts with its end byte, so a prefix that holds the end is a complete term.
    """
    def prefixes(batches):
        for run in _read_tables(batches):
            long = np.flatnonzero(np.diff(np.frombuffer(run.words.buffers()[1], np.int32)) > short)  # with its end
            if not len(long):
                continue
            prefix = pc.binary_slice(run.words.take(pa.array(long)), 0, width).dictionary_encode()
            keys, n = prefix.dictionary, len(prefix.dictionary)
            of_word = np.full(len(run.words), -1)
            of_word[long] = prefix.indices.to_numpy()
            langs = list(dict.fromkeys(g[0] for g in run.groups))
            lang_of = np.array([langs.index(g[0]) for g in run.groups])[run.group_of]
            lang, key = lang_of[run.text], of_word[run.code]
            counted = key >= 0
            if alive_bits is not None:
                heads = pc.binary_slice(keys, 0, short).dictionary_encode()
                living = np.stack(_alive(alive_bits, heads.dictionary.to_pylist(), langs))[:, heads.indices.to_numpy()]
                counted &= living[lang, key]
            once, _ = _distinct(run.text[counted] * n + key[counted])  # a prefix counts once in a text
            pairs, docs = _distinct(lang_of[once // n] * n + once % n)
            yield [(x,) for x in langs], pairs // n, keys.take(pa.array(pairs % n)), docs

    def run(batches):
        yield from _counted(prefixes(batches), held_bytes, ["lang", "prefix", "docs"], [pa.string(), pa.binary(), pa.int64()])

    return run


def kept_terms(table: DataFrame, min_docs: int = MIN_DOCS, first: int = FIRST, growth: int = GROWTH, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(lang, term) of the terms in at least ``min_docs`` texts of a ``term_table``, found by iceberg prefixes.

    Each level reads the table and counts, by language, the distinct documents of byte prefixes; a prefix below
    ``min_docs`` is dropped, as no longer prefix can reach it. The next level counts only terms whose prefix is
    still alive, with ``growth`` times as many bytes, until all that live are complete terms. Tasks know the
    living prefixes by a filter of fixed size that never misses one. They add up counts in bounded tables, so the
    shuffle holds a row per task and prefix. Levels grow with the logarithm of the longest frequent term.
    """
    complete, bits, short, width = None, None, 0, first
    while True:
        # Tasks have summed up what they could, so rows go to their range as they are.
        counted = table.mapInArrow(_prefix_counter(short, width, bits, held_bytes), "lang string, prefix binary, docs long").repartition("lang", "prefix")
        level = counted.groupBy("lang", "prefix").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
        with _small_batches(table.sparkSession):
            level = stored(level.select("lang", "prefix", (F.substring("prefix", -1, 1) == F.lit(bytearray(END))).alias("complete")), "prefixes")
        terms = level.where("complete").select("lang", F.expr("cast(substring(prefix, 1, length(prefix) - 1) as string)").alias("term"))
        complete = terms if complete is None else complete.unionByName(terms)
        alive = level.where("not complete").select("lang", "prefix")
        if alive.isEmpty():
            return stored(complete, "kept-terms")
        bits, short, width = _filter(alive), width, width * growth


def term_counts(table: DataFrame, kept: DataFrame, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(lang, source, term, n) occurrences of the kept terms of a language in each of its sources, where there are any."""
    bits = _filter(kept.select("lang", F.col("term").cast("binary").alias("prefix")))

    def counts(batches):
        for run in _read_tables(batches):
            n = len(run.words)
            if not n:
                continue
            terms = pc.binary_slice(run.words, 0, -1)
            langs = list(dict.fromkeys(g[0] for g in run.groups))
            living = np.stack(_alive(bits, terms.to_pylist(), langs))
            group = run.group_of[run.text]
            counted = living[np.array([langs.index(g[0]) for g in run.groups])[group], run.code]
            pair = group[counted] * n + run.code[counted]
            order = np.argsort(pair)
            found, sizes = _distinct(pair)
            sums = np.add.reduceat(run.times[counted][order], np.append(0, np.cumsum(sizes)[:-1])) if len(found) else sizes
            yield run.groups, found // n, terms.take(pa.array(found % n)), sums

    def run(batches):
        yield from _counted(counts(batches), held_bytes, ["lang", "source", "term", "n"], [pa.string(), pa.string(), pa.binary(), pa.int64()])

    # Dealt by term and language, rows are where both the sums and the kept terms need them.
    counted = table.mapInArrow(run, "lang string, source string, term binary, n long").withColumn("term", F.col("term").cast("string")).repartition("lang", "term")
    known = kept.select(F.col("lang").alias("kept_lang"), F.col("term").alias("kept_term"))
    found = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    return attach(found, known, (F.col("lang") == F.col("kept_lang")) & (F.col("term") == F.col("kept_term")), "left_semi")


def _share(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)) as a long, exact for any counts."""
    part = f"(cast({n} as decimal(19, 0)) + {PRIOR}) * cast({SCALE} as decimal(10, 0))"
    exact = f"({part}) div (cast({total} as decimal(19, 0)) + cast({terms} as decimal(19, 0)) * {PRIOR})"
    # Longs are enough, and faster, as long as the product fits.
    return F.expr(f"1 + case when {n} < {2 ** 62 // SCALE} then ({n} + {PRIOR}) * {SCALE}L div ({total} + {terms} * {PRIOR}L) else {exact} end")


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the absolute differences of all pairs of sources, for each block of terms of a language."""
    for (lang, _), (_, _, sources, shares) in grouped(batches, 2):
        names = sorted(set(sources), key=sources.index)
        table = np.array(shares, np.int64).reshape(-1, len(names))
        for k, source in enumerate(names):
            total = np.abs(table - table[:, k:k + 1]).sum(axis=0)
            columns = [pa.array([lang] * len(names)), pa.array([source] * len(names)), pa.array(names), pa.array(total, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "item", "value"])


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, held_bytes: int = HELD_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the sources of a language lie apart, and by which terms.

    Part ``pair`` gives each other source of the language with the summed difference of the shares of all kept
    terms, in full. Part ``term`` gives the ``top`` kept terms whose share in the source exceeds that in the
    language most. Ranks fall with the value and rise with the item.

    Texts are read once, into a table of numbered words that each level and the count of the kept terms read; neither is shuffled. Then only kept terms times sources
    are: each language's terms are dealt by hash to groups of about ``block_rows``, where sources are compared as
    columns. The number of pairs of sources is the size of the result; no pair is emitted per term.

    A null lang, source or text is the empty text. Every row is a document of its own, repeated rows too. A group
    without terms has its pairs; a language without kept terms has pairs of value 0. An empty table gives no
    rows. Other columns are not read.
    """
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    table = term_table(docs)
    kept = kept_terms(table, min_docs, held_bytes=held_bytes)
    with _small_batches(docs.sparkSession):
        counts = stored(term_counts(table, kept, held_bytes), "term-counts")
    n_terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(n_terms, "lang", "left").select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"))
    groups = stored(groups, "groups")

    # Every kept term with every group of its language.
    per_term = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.first("terms").alias("terms"))
    largest = per_term.agg(F.max(F.col("sources") * F.col("terms"))).first()[0] or 0
    sides = groups.select(F.col("lang").alias("of"), "source", "total", "terms")
    dense = attach(kept.select("lang", "term"), sides, F.col("lang") == F.col("of")).join(counts, ["lang", "source", "term"], "left")
    shares = dense.select("lang", F.pmod(F.xxhash64("term"), F.lit(-(-largest // block_rows) or 1)).alias("block"), "source",
                          _share("coalesce(n, 0)", "total", "terms").alias("share"), "term")
    sums = shares.repartition("lang", "block").sortWithinPartitions("lang", "block", "term", "source").drop("term").mapInArrow(
        _distances, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    facts = groups.join(langs, "lang").select(F.col("lang").alias("of"), F.col("source").alias("at"), "total", "terms", "lang_total")
    placed = attach(counts.join(whole, ["lang", "term"]), facts, (F.col("lang") == F.col("of")) & (F.col("source") == F.col("at")))
    above = placed.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                          (_share("n", "total", "terms") - _share("lang_n", "lang_total", "terms")).alias("value")).where("value > 0")

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = [part.select("*", F.row_number().over(order).alias("rank")) for part in (pairs, above)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))
