"""Removal of byte strings that occur more than once, by deep-shallow sorting of suffixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped, stored
from .neardup import chunks, mix64, powers

LENGTH, GRAM = 400, 64
# Bytes compared by multikey quicksort before blind tries take over.
SHALLOW = 48
# Bytes of a text that are searched for anchors at a time; arrays of about 100 times as many bytes are held.
PIECE = 1 << 20
# Different contexts of one anchor that are sorted in one task; anchors with more are settled window by window.
GROUP = 20_000

_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 2 ** 64))
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64))


class Rolling:
    """Polynomial codes modulo 2**64 of any substring of a byte array."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * powers(_BASE, len(data)) if len(data) else data, out=self.sums[1:], dtype=np.uint64)
        self.back = powers(_INVERSE, len(data) + 1)

    def codes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, first window, last window, gram code, block code) for texts in one byte array.

    The anchor of a window of ``length`` bytes is the first of its ``gram``-byte strings with the
    least code, so equal windows have their anchor at the same place wherever they occur. The
    windows with one anchor follow each other; the bytes they cover are the block of the anchor.
    """
    span = length - gram + 1
    roll = Rolling(data)
    n = len(data) - gram + 1
    valid = np.zeros(max(n, 1), bool)
    ends = np.repeat(offsets[1:], np.diff(offsets))  # the end of the text of each byte
    if n > 0:
        valid[:n] = np.arange(n) + length <= ends[:n]
    if not valid.any():
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    places = np.arange(n)
    bits = np.uint64(max(1, int(n).bit_length()))
    # Code above, place below: the least value is the least code, and its first place.
    ranked = (roll.codes(places, places + gram) >> bits << bits) | places.astype(np.uint64)
    padded = np.full(-(-n // span) * span + span, np.uint64(2 ** 64 - 1), np.uint64)
    padded[:n] = ranked
    rows = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    window = np.flatnonzero(valid)
    least = np.minimum(behind[window], ahead[window + span - 1])
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
    at = np.flatnonzero(new)
    first, last, anchor = window[at], window[np.append(at[1:], len(window)) - 1], anchor[at]
    text = np.searchsorted(offsets, anchor, "right") - 1
    block = roll.codes(first, last + length) + mix64((anchor - first).astype(np.uint64))
    return text, anchor, first, last, roll.codes(anchor, anchor + gram), block


def long_text_parts(data: np.ndarray, offsets: np.ndarray, length: int, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place in the text, bytes, offsets) to look for anchors in: a run of texts as it is, a long text in pieces.

    Pieces overlap, so each window lies in one of them and none twice. A block that spans two
    pieces becomes two blocks of one anchor; where its copies are cut elsewhere, the anchor is contested and its
    windows are compared, so cuts cost time and lose nothing.
    """
    if len(offsets) != 2 or len(data) <= size + length:
        yield 0, data, offsets
        return
    for start in range(0, len(data) - length + 1, size):
        part = data[start:start + size + length - 1]
        yield start, part, np.array([0, len(part)], offsets.dtype)


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high - 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class BlindTrie:
    """Order of strings with a long common prefix: nodes hold the place of a branch and the byte of each child only.

    A string descends by branch bytes alone; one comparison with the leaf it meets tells where it
    leaves the trie.
    """

    def __init__(self, strings: list[bytes]):
        self.strings = strings

    def _byte(self, i: int, depth: int) -> int:
        s = self.strings[i]
        return s[depth] if depth < len(s) else -1  # the end sorts before any byte

    def order(self, members: list[int]) -> list[int]:
        root: list | int = members[0]  # a leaf is an index, a node [depth, {byte: child}, equal strings by leaf]
        equal: dict[int, list[int]] = {}
        for i in members[1:]:
            node = root
            while isinstance(node, list):
                child = node[1].get(self._byte(i, node[0]))
                node = child if child is not None else next(iter(node[1].values()))
            shared = common_prefix(self.strings[i], self.strings[node])
            if shared == len(self.strings[i]) == len(self.strings[node]):
                equal.setdefault(node, []).append(i)
                continue
            parent, node_at, leaf = None, root, node
            while isinstance(node_at, list) and node_at[0] < shared:
                parent, node_at = node_at, node_at[1][self._byte(i, node_at[0])]
            if isinstance(node_at, list) and node_at[0] == shared:
                node_at[1][self._byte(i, shared)] = i
                continue
            branch = [shared, {self._byte(leaf, shared): node_at, self._byte(i, shared): i}]
            if parent is None:
                root = branch
            else:
                parent[1][self._byte(i, parent[0])] = branch
        out, stack = [], [root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack.extend(child for _, child in sorted(node[1].items(), key=lambda x: -x[0]))
            else:
                out.append(node)
                out.extend(equal.get(node, ()))
        return out


def deep_shallow_sort(strings: list[bytes], shallow: int = SHALLOW, step: int = 8) -> tuple[list[int], np.ndarray]:
    """Order of the strings and the common prefix of each with the one before it in that order.

    Multikey quicksort partitions by ``step`` bytes at a time down to depth ``shallow``; groups
    that still agree are ordered by a blind trie.
    """
    order: list[int] = []
    trie = BlindTrie(strings)
    stack = [(list(range(len(strings))), 0)]
    while stack:
        members, depth = stack.pop()
        if len(members) < 2:
            order.extend(members)
        elif depth >= shallow:
            order.extend(trie.order(members))
        else:
            keys = [strings[i][depth:depth + step] for i in members]
            pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
            less = [i for i, k in zip(members, keys) if k < pivot]
            more = [i for i, k in zip(members, keys) if k > pivot]
            same = [i for i, k in zip(members, keys) if k == pivot]
            stack.append((more, depth))
            stack.append((same, depth + step) if len(pivot) == step else (same, shallow))
            stack.append((less, depth))
    prefixes = np.array([0] + [common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:])], np.int64)
    return order, prefixes


def shared_windows(left: list[bytes], right: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each context of one anchor, the ranges [low, high] of window starts, in bytes before the anchor, that another context shares.

    ``right`` are the suffixes from the anchor on, ``left`` the bytes before it, reversed. Both are
    sorted; a window that starts d bytes before the anchor is shared by contexts that agree on d
    bytes to the left and length - d to the right, which are neighbours in both orders.
    """
    n = len(left)
    if n == 2:
        low, high = length - common_prefix(*right), common_prefix(*left)
        return [[(low, high)] if low <= high else [] for _ in range(2)]
    (by_left, left_common), (by_right, right_common) = deep_shallow_sort(left), deep_shallow_sort(right)
    left_size, right_size = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    top = int(left_size.max())
    # Groups only change where d passes one of these.
    edges = np.unique(np.concatenate([[0], left_common + 1, left_size + 1, length - right_common, length - right_size]))
    edges = edges[(edges >= max(0, length - int(right_size.max()))) & (edges <= top)]
    if not len(edges) or edges[0] > max(0, length - int(right_size.max())):
        edges = np.insert(edges, 0, max(0, length - int(right_size.max())))
    found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    in_left, in_right = np.empty(n, np.int64), np.empty(n, np.int64)
    for low, high in zip(edges, np.append(edges[1:] - 1, top)):
        in_left[by_left] = np.cumsum(left_common < low)
        in_right[by_right] = np.cumsum(right_common < length - low)
        usable = np.flatnonzero((left_size >= low) & (right_size >= length - low))
        _, group, size = np.unique(in_left[usable] * (n + 1) + in_right[usable], return_inverse=True, return_counts=True)
        for i in usable[size[group] > 1]:
            ranges = found[i]
            if ranges and ranges[-1][1] == low - 1:
                ranges[-1] = (ranges[-1][0], int(high))
            else:
                ranges.append((int(low), int(high)))
    return found


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, piece: int = PIECE) -> DataFrame:
    """(key, spans): for each distinct text, its byte ranges covered by a ``length``-byte string that also starts elsewhere.

    ``docs`` are (key, doc_id, text), key a hash of the text; texts without such strings are left
    out. Steps, none of which gathers more than ``group`` contexts:

    1. Each text is cut into blocks of windows with a common anchor (one pass, about one anchor in
       170 bytes). Only codes are counted: a block that occurs twice is covered whole, however
       often it occurs, and an anchor that occurs once ends here.
    2. Anchors that occur in different blocks are contested. One block of each kind is fetched
       as bytes, the suffixes from the anchor on and the reversed bytes before it are sorted
       deep-shallow per anchor, and common prefixes decide which windows are shared.
    3. An anchor with more than ``group`` different blocks is settled by counting the codes of its
       single windows, with partial sums, in no one place.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "doc_id", "anchor", "first", "last", "code", "block"]
        for batch in batches:
            for low, data, offsets in chunks(batch.column(2), piece):
                for start, part, edges in long_text_parts(data, offsets, length, piece):
                    text, *columns = anchors(part, edges, length, gram)
                    base = edges[text] - start if len(text) else np.zeros(0, np.int64)
                    at = pa.array(low + text)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(at), batch.column(1).take(at), *[pa.array((c - base).astype(np.int32)) for c in columns[:3]],
                         *[pa.array(c.astype(np.int64)) for c in columns[3:]]], names)

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    found = stored(docs.select("key", "doc_id", "text").where(F.octet_length("text") >= length).mapInArrow(
        cut, f"key binary, doc_id {doc_id}, anchor int, first int, last int, code long, block long"), "suffix-anchors")
    blocks = found.groupBy("code", "block").agg(F.count("*").alias("n"))
    codes = blocks.groupBy("code").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where("total > 1")
    repeated = stored(blocks.join(codes.withColumnRenamed("code", "c").hint("merge"), F.col("code") == F.col("c")).select(
        F.col("code").alias("c"), F.col("block").alias("b"), "n", "kinds"), "suffix-repeated")
    located = stored(found.join(repeated.hint("merge"), (F.col("code") == F.col("c")) & (F.col("block") == F.col("b"))).drop("c", "b"), "suffix-located")
    whole = located.where("n > 1").select("key", F.col("first").alias("start"), (F.col("last") + length).alias("end"))

    contested = located.where("kinds > 1").groupBy("code", "block").agg(
        F.min(F.struct("key", "doc_id", "anchor", "first", "last")).alias("at"), F.any_value("n").alias("n"), F.any_value("kinds").alias("kinds"))
    wanted = contested.select("at.key", F.col("at.doc_id").alias("d"), F.struct("code", "block", "n", "kinds", "at.anchor", "at.first", "at.last").alias("w")).groupBy(
        "key", "d").agg(F.collect_list("w").alias("wanted")).withColumnRenamed("key", "k")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, blocks_of in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = text.encode()
                rows.extend((w["code"], w["block"], key, w["anchor"], w["n"], w["kinds"], data[w["first"]:w["anchor"]][::-1],
                             data[w["anchor"]:w["last"] + length]) for w in blocks_of)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                    pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                    ["code", "block", "key", "anchor", "n", "kinds", "left", "right"])

    here = (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))
    contexts = stored(docs.where(F.octet_length("text") >= length).join(wanted.hint("merge"), here).select("key", "text", "wanted").mapInArrow(
        fetch, "code long, block long, key binary, anchor int, n long, kinds long, left binary, right binary"), "suffix-contexts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _rows_of(batches, length):
            yield batch

    small = contexts.where(F.col("kinds") <= group).repartition("code").sortWithinPartitions("code", "block").mapInArrow(
        compare, "key binary, start int, end int")
    spans = whole.unionByName(small)
    if contexts.where(F.col("kinds") > group).limit(1).count():
        spans = spans.unionByName(windows_of(contexts.where(F.col("kinds") > group), length))
    return spans.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def _rows_of(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[bytes, int, int]] = []
    kinds = (pa.binary(), pa.int32(), pa.int32())
    for _, (_, blocks, keys, places, counts, _, lefts, rights) in grouped(batches, 1):
        one = [i for i in range(len(blocks)) if not i or blocks[i] != blocks[i - 1]]  # a repeated row brings its blocks twice
        if len(one) > 1:
            for i, ranges in zip(one, shared_windows([lefts[i] for i in one], [rights[i] for i in one], length)):
                if counts[i] == 1:
                    held.extend((keys[i], places[i] - high, places[i] - low + length) for low, high in ranges)
        if len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], ["key", "start", "end"])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], ["key", "start", "end"])


def windows_of(contexts: DataFrame, length: int) -> DataFrame:
    """Spans of contexts whose single windows are counted: exact up to a 128-bit code of anchor and window."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for code, block, key, anchor, n, _, left, right in zip(*[c.to_pylist() for c in batch.columns]):
                data = np.frombuffer(left[::-1] + right, np.uint8)
                start = np.arange(len(data) - length + 1)
                window = Rolling(data).codes(start, start + length).astype(np.int64)
                size = len(start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size, code)), pa.array((len(left) - start).astype(np.int32)), pa.array(window), pa.array([key] * size, pa.binary()),
                     pa.array(np.full(size, anchor, np.int32)), pa.array(np.full(size, n))], ["code", "before", "window", "key", "anchor", "n"])

    each = stored(contexts.dropDuplicates(["code", "block"]).select(*contexts.columns).mapInArrow(
        split, "code long, before int, window long, key binary, anchor int, n long"), "suffix-windows")
    twice = each.groupBy("code", "before", "window").agg(F.count("*").alias("times")).where("times > 1").withColumnsRenamed(
        {"code": "c", "before": "d", "window": "w"})
    shared = each.where("n = 1").join(twice.hint("merge"), (F.col("code") == F.col("c")) & (F.col("before") == F.col("d")) & (F.col("window") == F.col("w")))
    return shared.select("key", (F.col("anchor") - F.col("before")).alias("start"), (F.col("anchor") - F.col("before") + length).alias("end"))


def remove_repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, piece: int = PIECE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row of ``docs`` (doc_id, text).

    Every byte of a text (UTF-8) covered by a ``length``-byte string that also starts anywhere
    else is removed, the same document included and all copies alike; ``kept`` is what is left, as
    bytes. Matches end at document borders. Null is empty; shorter texts than ``length`` stay as
    they are; repeated rows are copies of each other; an empty table gives none. A very long text is
    searched in pieces; it must fit in a row and in the memory of a task as bytes.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5("text")))
    spans = repeated_spans(texts.select("key", "doc_id", "text"), length, gram, group, piece)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data, pieces, at, runs = text.encode(), [], 0, 0
                end = -1
                for s in sorted((s["start"], s["end"]) for s in found or ()):
                    if s[0] > end:
                        pieces.append(data[at:s[0]])
                        runs += 1
                    end = at = max(end, s[1])
                kept = b"".join(pieces) + data[at:] if runs else data
                rows.append((len(data), len(data) - len(kept), runs, kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, kinds)]],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    joined = texts.join(spans.withColumnRenamed("key", "k").hint("merge"), F.col("key") == F.col("k"), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(remove, f"doc_id {doc_id}, n_bytes long, n_removed long, n_spans long, kept binary")
