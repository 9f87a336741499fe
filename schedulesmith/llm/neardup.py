"""Near duplicates by consistent weighted sampling of TF-IDF shingles, banded and verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import grouped, stored

SHINGLE, SIMILARITY = 5, 0.8
# A pair at the limit of 0.8 without weights has 0.75 with them at least (all it shares at the floor, all else at 1). It shares
# a band of 3 samples with probability 0.42 and one of 14 bands with 0.9995; a pair at 0.8 with weights one with 0.9999.
ROWS, BANDS = 3, 14
# Weight of a shingle that every document has; one that a single document has weighs 1.
FLOOR = 0.75
# Share of the documents from which ``common_shingles`` lists a shingle.
COMMON = 0.2
# Bytes of text whose shingles one task counts at once.
PART_BYTES = 16 << 20
# Texts of one bucket compared at once; larger buckets are compared block by block.
BLOCK = 768
CHUNK_BYTES = 4 << 20
SHINGLE_BITS = 48

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mixer of 64-bit integers (murmur3's constants)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, offsets) of consecutive texts, at most ``size`` bytes and 65,000 texts or one text at a time; null is empty."""
    texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    low = 0
    while low < len(texts):
        high = min(max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1), low + 65_000)
        yield low, data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
        low = high


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, its text) for all windows of ``width`` words, in text order; a shorter text with words is one shingle.

    Words are runs without white space. A word's code is a polynomial of its bytes modulo 2**64,
    a shingle's code one of its words' codes, mixed and cut to 48 bits.
    """
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not len(data):
        return none
    white = _SPACE[data]
    edge = np.zeros(len(data), bool)
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, white[:-1]
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, white[1:] | edge[1:]
    starts, ends = np.flatnonzero(~white & (before | edge)), np.flatnonzero(~white & after) + 1
    if not len(starts):
        return none
    lengths = ends - starts
    codes = np.zeros(len(starts), np.uint64)
    if (longest := int(lengths.max())) <= 64:
        at = np.arange(len(starts))
        for k in range(longest):  # Horner's rule, one byte of all words at a time
            at = at[lengths[at] > k]
            codes[at] = codes[at] * _BASE + data[starts[at] + k] + np.uint64(1)
    else:
        for i in np.flatnonzero(lengths > 64):
            word = data[starts[i]:ends[i]].astype(np.uint64) + np.uint64(1)
            codes[i] = np.dot(word, powers(_BASE, len(word))[::-1])
        at = np.flatnonzero(lengths <= 64)
        for k in range(64):
            at = at[lengths[at] > k]
            codes[at] = codes[at] * _BASE + data[starts[at] + k] + np.uint64(1)
    codes = mix64(codes)
    text = np.searchsorted(offsets, starts, "right") - 1
    n = np.bincount(text, minlength=len(offsets) - 1)
    first = np.cumsum(n) - n
    out = np.zeros(len(codes), np.uint64)
    reach = np.minimum(first[text] + n[text], np.arange(len(codes)) + width)
    for k in range(width):
        inside = np.arange(len(codes)) + k < reach
        shifted = np.zeros(len(codes), np.uint64)
        shifted[:len(codes) - k] = codes[k:]
        out = np.where(inside, out * _BASE + shifted, out)
    place = np.arange(len(codes)) - first[text]
    whole = (place + width <= n[text]) | (place == 0)
    return mix64(out[whole]) >> np.uint64(64 - SHINGLE_BITS), text[whole]


def counted(codes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with its frequency, ordered by text and shingle. A chunk holds fewer than 2**16 texts."""
    key = np.sort((text.astype(np.uint64) << np.uint64(SHINGLE_BITS)) | codes)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return key[at] & np.uint64((1 << SHINGLE_BITS) - 1), (key[at] >> np.uint64(SHINGLE_BITS)).astype(np.int64), np.diff(np.append(at, len(key)))


def weight_of(frequency: np.ndarray, total: int) -> np.ndarray:
    """Weights of shingles found in ``frequency`` of ``total`` documents: the inverse document frequency, scaled to FLOOR..1.

    idf = log(N / df) / log(N) is 1 for a shingle of one document and 0 for one of all; the weight is
    FLOOR + (1 - FLOOR) idf. Unscaled, a shingle found once would weigh many times one that a
    group of near copies shares, and the copies of a large group would seem the less alike the
    more there are. Scaled, a part of that remains, so pairs are also verified without weights.
    """
    return 1 - (1 - FLOOR) * np.log(np.maximum(frequency, 1)) / np.log(max(total, 2))


def _gamma_table(bits: int = 16) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at the middles of 2**bits equal steps, by Newton's rule on its distribution function."""
    p = (np.arange(1 << bits) + 0.5) / (1 << bits)
    x = np.where(p < 0.5, np.sqrt(2 * p), 1 - np.log1p(-p))
    for _ in range(60):
        x = np.maximum(x - (-np.expm1(-x) - x * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-300), 1e-9)
    return x


_GAMMA = _gamma_table().astype(np.float32)
_LOG_GAMMA = np.log(_gamma_table()).astype(np.float32)


def consistent_samples(codes: np.ndarray, weights: np.ndarray, starts: np.ndarray, samples: int, seed: int = 1) -> np.ndarray:
    """Improved consistent weighted samples: (texts, samples) codes of (shingle, level).

    For shingle k of weight S and sample i, with r and c from Gamma(2, 1) and b uniform, all
    decided by (k, i): t = floor(ln S / r + b), ln y = r (t - b), and the shingle with the least
    ln c - ln y - r is the sample, together with its t. ``starts`` are the first places of the texts.
    """
    out = np.empty((len(starts), samples), np.uint64)
    log_weight = np.log(weights).astype(np.float32)
    flat = not log_weight.any()
    low = np.uint64(0xFFFF)
    place = np.arange(len(codes), dtype=np.uint64)
    for i in range(samples):
        h = mix64(codes + np.uint64((seed * 1000 + i + 1) * 0x9E3779B97F4A7C15 & (2 ** 64 - 1)))
        r, log_c = _GAMMA[(h & low).astype(np.int32)], _LOG_GAMMA[((h >> np.uint64(16)) & low).astype(np.int32)]
        b = ((h >> np.uint64(32)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0 ** -32)
        t = np.zeros(len(codes), np.float32) if flat else np.floor(log_weight / r + b)
        a = log_c - r * (t - b) - r
        # Floats in the order of unsigned integers, with the place below: one minimum gives the least and where it is.
        bits = a.view(np.uint32)
        bits = np.where(bits >> 31, ~bits, bits | np.uint32(0x80000000))
        best = (np.minimum.reduceat((bits.astype(np.uint64) << np.uint64(32)) | place, starts) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        out[:, i] = mix64(codes[best] ^ mix64(t[best].astype(np.int64).astype(np.uint64) + np.uint64(i)))
    return out


def _per_text(batch: pa.RecordBatch, column: int, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, texts, shingles, text of each, frequency) of the chunks of a batch."""
    for low, data, offsets in chunks(batch.column(column)):
        codes, text = shingles(data, offsets, width)
        yield (low, len(offsets) - 1, *counted(codes, text))


def common_shingles(texts: DataFrame, width: int = SHINGLE, common: float = COMMON) -> tuple[np.ndarray, np.ndarray, int]:
    """(shingles, document frequencies, number of documents) of the shingles in at least ``common`` of all texts, exactly.

    All shingles are counted; those listed are at most (shingles per text / ``common``), whatever
    the size of the corpus. ``texts`` have a column ``text``.
    """
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, codes, _, _ in _per_text(batch, 0, width):
                code, n = np.unique(codes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n)], ["code", "n"])

    total = texts.count()
    rows = texts.select("text").mapInArrow(each, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).where(
        F.col("n") >= common * total).collect()
    return np.array([r[0] for r in rows], np.int64).astype(np.uint64), np.array([r[1] for r in rows], np.float64), total


def planes(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of whole numbers: all first bytes, all second bytes and so on, so that zeros lie together."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(held: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(held) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(held, np.uint8).reshape(width, -1).T
    return out.view("<u8").reshape(-1)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows with equal first column, for sorted input in batches of any size."""
    key, held = None, []
    for batch in batches:
        first = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(first[1:] != first[:-1]) + 1), len(first)] if len(first) else []
        for low, high in zip(edges[:-1], edges[1:]):
            if held and first[low] != key:
                yield held
                held = []
            key = first[low]
            held.append(batch.slice(low, high - low))
    if held:
        yield held


def with_frequencies(texts: DataFrame, parts: int, width: int = SHINGLE) -> DataFrame:
    """(chunk, codes, places, counts, frequencies, keys, docs): every shingle of texts (key, doc_id, text) with its document frequency.

    A row has those shingles of a chunk of texts that fall into one of ``parts`` ranges of the
    codes, in the order of the texts, as planes of bytes: code, step from the place of the text before, repeats in the
    text, documents of the whole corpus. A range is counted in one task, so no count leaves out a
    shingle. One row of a chunk also lists its keys and doc_ids.
    """
    doc_id = texts.schema["doc_id"].dataType.simpleString()
    whose = f"keys array<string>, docs array<{doc_id}>"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for low, n, codes, text, counts in _per_text(batch, 2, width):
                part = ((codes >> np.uint64(SHINGLE_BITS - 32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                edges = np.searchsorted(part[order], np.arange(parts + 1))
                used = [i for i in range(parts) if edges[i] < edges[i + 1]] or [0]
                pieces = [order[edges[i]:edges[i + 1]] for i in used]
                first = pa.array(np.minimum(np.arange(len(used) + 1), 1).astype(np.int32) * np.int32(n))
                yield pa.RecordBatch.from_arrays([
                    pa.array(used, pa.int32()), pa.array(np.full(len(used), chunk)), pa.array([planes(codes[x], 6) for x in pieces], pa.binary()),
                    pa.array([planes(np.diff(text[x], prepend=0), 2) for x in pieces], pa.binary()), pa.array([planes(counts[x], 4) for x in pieces], pa.binary()),
                    *[pa.ListArray.from_arrays(first, pa.concat_arrays([batch.column(c).slice(low, n)])) for c in (0, 1)],
                ], ["part", "chunk", "codes", "places", "counts", "keys", "docs"])
                chunk += 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches):
            codes = [[from_planes(c, 6) for c in b.column(2).to_pylist()] for b in rows]
            _, at, n = np.unique(np.concatenate([c for b in codes for c in b]), return_inverse=True, return_counts=True)
            low = 0
            for b, held in zip(rows, codes):
                found = []
                for c in held:
                    found.append(planes(n[at[low:low + len(c)]], 5))
                    low += len(c)
                yield pa.RecordBatch.from_arrays([*b.columns[1:5], pa.array(found, pa.binary()), *b.columns[5:]],
                                                 ["chunk", "codes", "places", "counts", "frequencies", "keys", "docs"])

    dealt = texts.select("key", "doc_id", "text").mapInArrow(deal, f"part int, chunk long, codes binary, places binary, counts binary, {whose}")
    return dealt.repartition("part").sortWithinPartitions("part").mapInArrow(
        count, f"chunk long, codes binary, places binary, counts binary, frequencies binary, {whose}")


def signatures(texts: DataFrame, total: int, parts: int, width: int = SHINGLE, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(key, doc_id, bands, alone, codes, counts, frequencies) for texts (key, doc_id, text).

    ``bands`` has one hash per band of ``rows`` samples, null for a text without words. The lists have
    the shingles that other documents have too; ``alone`` is the number of the others, which weigh 1.
    """
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in runs(batches):
            column = lambda c, width: [from_planes(x, width) for b in held for x in b.column(c).to_pylist()]
            codes, counts, documents = (np.concatenate(column(*c)) for c in ((1, 6), (3, 4), (4, 5)))
            text = np.concatenate([np.cumsum(x) for x in column(2, 2)])
            order = np.argsort((text << np.uint64(SHINGLE_BITS)) | codes)
            codes, counts, documents, text = codes[order], counts[order].astype(np.int64), documents[order].astype(np.int64), text[order].astype(np.int64)
            keys, docs = (pa.concat_arrays([b.column(c).flatten() for b in held]) for c in (5, 6))
            n = len(keys)
            has = np.unique(text)
            band = np.zeros((len(has), bands), np.uint64)
            if len(has):
                sampled = consistent_samples(codes, counts * weight_of(documents, total), np.searchsorted(text, has), rows * bands)
                for k in range(rows):
                    band = mix64(band * _BASE + sampled[:, k::rows])
            signed = pa.ListArray.from_arrays(pa.array(np.arange(0, band.size + 1, bands, dtype=np.int32)), pa.array(band.reshape(-1).astype(np.int64)))
            place = np.full(n, -1)
            place[has] = np.arange(len(has))
            shared = documents > 1
            edges = pa.array(np.searchsorted(text[shared], np.arange(n + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(x[shared].astype(t))) for x, t in ((codes, np.int64), (counts, np.int32), (documents, np.int64))]
            alone = np.bincount(text[~shared], counts[~shared], n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([keys, docs, signed.take(pa.array(place, mask=place < 0)), pa.array(alone), *lists],
                                             ["key", "doc_id", "bands", "alone", "codes", "counts", "frequencies"])

    doc_id = texts.schema["doc_id"].dataType.simpleString()
    return with_frequencies(texts, parts, width).repartition("chunk").sortWithinPartitions("chunk").mapInArrow(
        sign, f"key string, doc_id {doc_id}, bands array<long>, alone long, codes array<long>, counts array<int>, frequencies array<long>")


def similar_groups(keys: list, alone: list[int], codes: list[np.ndarray], counts: list[np.ndarray], weights: list[np.ndarray], left: np.ndarray,
                   right: np.ndarray, similarity: float = SIMILARITY) -> list[tuple]:
    """Links (key, key) that connect all pairs of a left and a right text with enough Jaccard similarity, with the weights or without.

    Shingles that only one text has can't add to any intersection, so they count in the totals
    only, those of one document (``alone``) by their number; the others are compared as matrix products. The n-th repeat of a shingle is a feature of
    its own, which makes the sum of products the sum of minima.
    """
    n = len(keys)
    owner = np.repeat(np.arange(n), [len(c) for c in codes])
    code, count, weight = np.concatenate(codes), np.concatenate(counts), np.concatenate(weights)
    if (count > 1).any():
        owner, feature_code, weight = np.repeat(owner, count), np.repeat(code, count), np.repeat(weight, count)
        again = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        feature = mix64(feature_code + again.astype(np.uint64) * _BASE)
    else:
        feature = code
    total, size = np.bincount(owner, weight, n) + alone, np.bincount(owner, minlength=n) + alone
    weighted = bool((weight != 1).any())
    order = np.argsort(feature, kind="stable")
    feature, owner, weight = feature[order], owner[order], weight[order]
    new = np.ones(len(feature), bool)
    new[1:] = feature[1:] != feature[:-1]
    group = np.cumsum(new) - 1
    shared = np.bincount(group)[group] > 1
    group, owner, weight = group[shared], owner[shared], weight[shared]
    both = np.zeros((len(left), len(right)), np.float32)
    plain = np.zeros_like(both) if weighted else both
    row, column = np.full(n, -1), np.full(n, -1)
    row[left], column[right] = np.arange(len(left)), np.arange(len(right))
    _, group = np.unique(group, return_inverse=True)
    at = 0
    while at < len(group):
        end = int(np.searchsorted(group, group[at] + 2048, "left"))
        g, o, w = group[at:end] - group[at], owner[at:end], weight[at:end]
        a, b = np.zeros((len(left), 2048), np.float32), np.zeros((len(right), 2048), np.float32)
        a[row[o][row[o] >= 0], g[row[o] >= 0]] = w[row[o] >= 0]
        b[column[o][column[o] >= 0], g[column[o] >= 0]] = 1
        both += a @ b.T
        if weighted:
            plain += (a > 0).astype(np.float32) @ b.T
        at = end
    enough = lambda shared, whole: shared >= similarity * (whole[left][:, None] + whole[right][None, :] - shared) - 1e-4
    alike = enough(plain, size) | enough(both, total) if weighted else enough(plain, size)
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for i, j in zip(*np.nonzero(alike)):
        a, b = root(left[i]), root(right[j])
        if a != b:
            parent[max(a, b)] = min(a, b)
            links.append((keys[left[i]], keys[right[j]]))
    return links


def verified_links(features: DataFrame, signed: DataFrame, total: int, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct texts that share a band and have the Jaccard similarity, weighted or not.

    ``features`` are those of ``signatures``, ``signed`` (key, first, bands) names the document to read
    each text from. Only buckets of two texts or more go on, and of buckets with the same members
    one. A bucket of up to ``block`` texts is compared in one task; a larger one is dealt into
    blocks, and pairs of blocks are compared on their own, so no task holds more than two blocks
    at a time. What comes back are links that connect the similar texts of a comparison, at most one less than its texts.

    A large bucket is mostly one family, so its blocks are first compared with themselves and with block 0, which
    grows with the bucket and not with its square. The links found join texts into components, and two texts of one
    component need no verdict. What is left are the texts outside the largest component of their bucket: these
    are compared with all others of the bucket, so no pair of different components is left out. Only a bucket of
    many texts that are not alike stays quadratic in these.
    """
    banded = signed.select("key", F.posexplode("bands").alias("band", "value"))
    buckets = banded.groupBy("band", "value").agg(F.count("*").alias("n"), F.sum(F.xxhash64("key").cast("decimal(20,0)")).alias("members")).where("n > 1")
    buckets = buckets.groupBy("n", "members").agg(F.min(F.struct("band", "value")).alias("b")).select("n", F.col("b.band").alias("at"), F.col("b.value").alias("v"))
    members = stored(banded.join(buckets.hint("merge"), (F.col("band") == F.col("at")) & (F.col("value") == F.col("v"))).select("key", "band", "value", "n"), "near-members")
    bucket = ["band", "value"]
    parts = F.ceil(F.col("n") / block).cast("int")
    dealt = lambda n: F.pmod(F.xxhash64("key", F.lit(11)), n).cast("int")
    placed = members.withColumn("parts", parts).withColumn("own", dealt(F.col("parts")))
    near = F.when(F.col("own") == 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own", F.lit(0)))
    needed = signed.join(members.select(F.col("key").alias("k")).distinct().hint("merge"), F.col("key") == F.col("k")).select("k", "first")

    same = (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("first"))
    contents = features.join(needed.hint("merge"), same).select("key", "alone", "codes", "counts", "frequencies").dropDuplicates(["key"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, i, j), (_, _, _, _, own, keys, alone, codes, counts, frequencies) in grouped(batches, 4):
            own = np.array(own)
            links = similar_groups(keys, alone, [c.astype(np.uint64) for c in codes], [c.astype(np.int64) for c in counts],
                                   [weight_of(c, total) for c in frequencies], np.flatnonzero(own == i), np.flatnonzero(own == j), similarity)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*links)], ["a", "b"])

    contents = stored(contents, "near-contents", release=True, compression="zstd")

    def compared(placed: DataFrame, others: Column) -> DataFrame:
        """Links between the blocks ``own`` and each of ``others`` of a bucket."""
        pairs = placed.select(F.col("key").alias("k"), *bucket, "own", F.explode(others).alias("other")).select(
            "k", *bucket, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
        cell = [*bucket, "i", "j"]
        together = contents.join(pairs.hint("merge"), F.col("key") == F.col("k")).select(*cell, "own", "key", "alone", "codes", "counts", "frequencies")
        return together.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(compare, "a string, b string").distinct()

    links = stored(compared(placed, near), "near-links")
    wide = members.where(F.col("n") > 2 * block)  # of one or two blocks every pair is done
    if not wide.limit(1).count():
        return links
    roots = connected(links).withColumnRenamed("key", "k")
    rooted = stored(wide.join(roots.hint("merge"), F.col("key") == F.col("k"), "left").select("key", *bucket, F.coalesce("root", "key").alias("root")), "near-rooted")
    sizes = rooted.groupBy(*bucket, "root").agg(F.count("*").alias("n")).groupBy(F.col("band").alias("at"), F.col("value").alias("v")).agg(
        F.max_by("root", F.struct("n", "root")).alias("family"), F.max("n").alias("in_family"), (F.sum("n") - F.max("n")).alias("rest")).where("rest > 0")
    sided = rooted.join(sizes.hint("merge"), (F.col("band") == F.col("at")) & (F.col("value") == F.col("v")))
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    sided = sided.withColumns({"outside": F.col("root") != F.col("family"), "rest": blocks("rest"), "in_family": blocks("in_family")})
    # Blocks of the texts outside come first, those of the family after them.
    sided = sided.withColumn("own", F.when(F.col("outside"), dealt(F.col("rest"))).otherwise(F.col("rest") + dealt(F.col("in_family"))))
    last = F.when(F.col("outside"), F.col("rest") + F.col("in_family")).otherwise(F.col("rest")) - 1
    return links.unionByName(compared(sided, F.sequence(F.lit(0), last))).distinct()


def connected(links: DataFrame) -> DataFrame:
    """(key, root) of the connected components of links (a, b); root is the least key of the component.

    Every round each key takes the least root among its neighbours and then the root of that
    root, so the distance to go is at least halved; rounds end when nothing changes. Results are
    stored between rounds, nothing but a count reaches the driver.
    """
    both = stored(links.union(links.select("b", "a")).distinct(), "component-links").toDF("key", "other")
    roots = stored(both.groupBy("key").agg(F.least(F.col("key"), F.min("other")).alias("root")), "component-roots")
    while True:
        reached = both.join(roots.withColumnsRenamed({"key": "k", "root": "r"}).hint("merge"), F.col("other") == F.col("k")).groupBy("key").agg(F.min("r").alias("r"))
        nearer = roots.join(reached.withColumnRenamed("key", "k").hint("merge"), F.col("key") == F.col("k"), "left").select(
            "key", F.col("root").alias("old"), F.least("root", "r").alias("step"))
        ahead = roots.select(F.col("key").alias("k"), F.col("root").alias("jump"))
        new = stored(nearer.join(ahead.hint("merge"), F.col("step") == F.col("k"), "left").select(
            "key", "old", F.least("step", F.coalesce("jump", "step")).alias("root")), "component-roots")
        if not new.where("root <> old").limit(1).count():
            return new.select("key", "root")
        roots = new.select("key", "root")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY, rows: int = ROWS, bands: int = BANDS, block: int = BLOCK) -> DataFrame:
    """Near-duplicate classes of the distinct texts of ``docs`` (doc_id, text), one row per text.

    ``key`` is the MD5 of a text, ``text_docs`` the number of documents with it, ``text_first``
    their least doc_id; ``class_first`` is the least doc_id of the class, ``head`` the key of that
    text, ``class_texts`` and ``class_docs`` count the class. Equal texts are one text from the start, so a text on a third of all rows costs
    one entry; different texts are linked when they share a band and their Jaccard similarity,
    with the weights or with all weights 1, is at least ``similarity``, and classes are the
    connected components.

    Null texts have no class (they are left out here). Texts without words are alike only if
    equal. Null doc_ids are the least only if a class has no other. Shorter texts than ``width``
    words are one shingle.
    """
    texts = docs.where(F.col("text").isNotNull()).select(F.md5("text").alias("key"), "doc_id", "text")
    total, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    signed = stored(signatures(texts, total, max(64, size // PART_BYTES), width, rows, bands), "near-signatures", release=True, compression="zstd")
    summary = stored(signed.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("text_docs"), F.any_value("bands").alias("bands")), "near-texts")
    links = verified_links(signed, summary.where("bands is not null").select("key", "first", "bands"), total, similarity, block)
    classes = connected(stored(links, "near-links"))
    joined = summary.drop("bands").join(classes.withColumnRenamed("key", "k").hint("merge"), F.col("key") == F.col("k"), "left").withColumn("root", F.coalesce("root", "key"))
    heads = joined.groupBy("root").agg(F.min("first").alias("class_first"), F.min_by("key", F.struct(F.col("first").isNull(), "first", "key")).alias("head"),
                                       F.count("*").alias("class_texts"), F.sum("text_docs").alias("class_docs"))
    return joined.drop("k").join(heads.withColumnRenamed("root", "r").hint("merge"), F.col("root") == F.col("r")).select(
        "key", "text_docs", F.col("first").alias("text_first"), "class_first", "head", "class_texts", "class_docs")
