"""Packing tokenised documents into windows of several lengths."""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_folder

# Context sizes; a document goes to the smallest that holds it.
TIERS = (256, 512, 1024, 2048)
# Token that ends a document.
END_ID = 1
# Tokens that may stay empty in a window of the longest tier before a shorter document is cut to fill it.
SLACK = 8
# Documents, or windows, that one task holds before it packs them (at most 32 MB of ids each way).
POOL = 4096
# Tokens of a step group.
GROUP_TOKENS = 64 * 2048
# Characters that are tokenised at a time.
PART = 1 << 16
# Sequences of the second pass are numbered from here.
SECOND = 1 << 62

# No token of the vocabulary spans the edge between a character and a space after it, so a text may be cut there.
EDGE = re.compile(r"(?<=\S) ")


class Piece(NamedTuple):
    doc: object
    start: int
    doc_tokens: int
    ids: np.ndarray


@lru_cache(maxsize=2)
def _encoder(json_path: str, ranks_path: str):
    """The vocabulary in both libraries. tiktoken is several times faster, but refuses some texts (very long
    white space); these go through tokenizers, which gives the same ids."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(json_path)
    slow.encode_special_tokens = True

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, disallowed_special=())
        except ValueError:
            return slow.encode(text, add_special_tokens=False).ids

    return encode


def token_ids(text: str | None, paths: tuple[str, str], end_id: int = END_ID) -> np.ndarray:
    """Ids of a whole text and the end token. Control strings in a text are ordinary text; null has no ids but the end."""
    encode, parts, at = _encoder(*paths), [], 0
    text = text or ""
    while at < len(text):
        edge = EDGE.search(text, at + PART)
        end = edge.start() if edge else len(text)
        parts.append(np.array(encode(text[at:end]), "<u4"))
        at = end
    return np.concatenate([*parts, np.array([end_id], "<u4")])


class Pool:
    """Pieces that wait for a window, by length."""

    def __init__(self):
        self.by_length: dict[int, list[Piece]] = {}
        self.lengths: list[int] = []
        self.size = 0

    def put(self, piece: Piece) -> None:
        held = self.by_length.setdefault(len(piece.ids), [])
        if not held:
            insort(self.lengths, len(piece.ids))
        held.append(piece)
        self.size += 1

    def longest(self, above: int, upto: int) -> int:
        """The largest length in (above, upto], 0 if there is none."""
        i = bisect_right(self.lengths, upto)
        return self.lengths[i - 1] if i and self.lengths[i - 1] > above else 0

    def take(self, length: int) -> Piece:
        held = self.by_length[length]
        if len(held) == 1:
            del self.lengths[bisect_left(self.lengths, length)]
        self.size -= 1
        return held.pop()


def _fill(pool: Pool, tiers: tuple[int, ...], k: int, slack: int) -> tuple[list[Piece], bool]:
    """One window of tier ``k``, opened by its longest document, and whether it is full.

    The gap takes the longest documents that fit, which are of shorter tiers since the first fills more than
    half. When none fits, the gap is cut off the longest document of the shorter tiers, else off any.
    """
    tier, lower = tiers[k], tiers[k - 1] if k else 0
    window = [pool.take(pool.longest(lower, tier))]
    gap = tier - len(window[0].ids)
    while gap > slack:
        fit = pool.longest(0, gap)
        if fit:
            window.append(pool.take(fit))
            gap -= fit
            continue
        donor = pool.longest(0, lower) or pool.longest(0, tiers[-1])
        if not donor:
            return window, False
        piece = pool.take(donor)
        window.append(piece._replace(ids=piece.ids[:gap]))
        pool.put(piece._replace(start=piece.start + gap, ids=piece.ids[gap:]))
        gap = 0
    return window, True


def _pack_pool(pool: Pool, tiers: tuple[int, ...], slack: int) -> list[tuple[int, list[Piece]]]:
    """(tier, window) for all that fills windows, long tiers first; what is left, less than one window, stays in the pool."""
    full = []
    for k in reversed(range(len(tiers))):
        while pool.longest(tiers[k - 1] if k else 0, tiers[k]):
            window, done = _fill(pool, tiers, k, slack if k == len(tiers) - 1 else 0)
            if not done:
                for piece in window:
                    pool.put(piece)
                return full
            full.append((tiers[k], window))
    return full


def _step_groups(windows: list[tuple[int, list[Piece]]], group_tokens: int) -> list[int]:
    """A group for each window, so that all groups have about as many tokens of each tier and as much attention.

    The cost of attention is the sum of the squared lengths in a window. Per tier, windows in the order of cost
    are dealt forth and back over the groups; each tier starts where the one before ended.
    """
    n = max(1, round(sum(tier for tier, _ in windows) / group_tokens))
    order = sorted(range(len(windows)), key=lambda i: (-windows[i][0], -sum(len(p.ids) ** 2 for p in windows[i][1])))
    groups = [0] * len(windows)
    for rank, i in enumerate(order):
        turn, place = divmod(rank, n)
        groups[i] = n - 1 - place if turn % 2 else place
    return groups


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)


def _packed(pieces: Iterable[Piece], schema: pa.Schema, first: int, last: bool, options: tuple) -> Iterator[pa.RecordBatch]:
    """Rows of the windows of a stream of pieces; sequences and groups are numbered from ``first``.

    What fills no window comes last, as one short sequence if ``last``, else without a sequence.
    """
    tiers, slack, pool_size, group_tokens = options
    top = tiers[-1]
    pool, whole = Pool(), []
    sequence = group = first

    def rows(windows, groups):
        nonlocal sequence
        for (tier, window), g in zip(windows, groups):
            offset = 0
            for p in window:
                yield (p.doc, p.start, len(p.ids), p.ids.tobytes(), p.doc_tokens, sequence, offset, tier, g)
                offset += len(p.ids)
            sequence += 1

    def flush():
        nonlocal group, whole
        windows = whole + _pack_pool(pool, tiers, slack)
        groups = _step_groups(windows, group_tokens)
        whole = []
        if windows:
            out = list(rows(windows, [group + g for g in groups]))
            group += max(groups) + 1
            for a in range(0, len(out), 2048):
                yield _batch(out[a:a + 2048], schema.types, schema.names)

    for piece in pieces:
        n = len(piece.ids)
        for a in range(0, n, top):
            part = piece if n <= top else piece._replace(start=piece.start + a, ids=piece.ids[a:a + top])
            if len(part.ids) == top:
                whole.append((top, [part]))
            else:
                pool.put(part)
            if pool.size >= pool_size or len(whole) >= pool_size:
                yield from flush()
    yield from flush()
    rest = [pool.take(pool.lengths[-1]) for _ in range(pool.size)]
    if last and rest:
        yield _batch(list(rows([(top, rest)], [group])), schema.types, schema.names)
    elif rest:
        yield _batch([(p.doc, p.start, len(p.ids), p.ids.tobytes(), p.doc_tokens, None, None, None, None) for p in rest], schema.types, schema.names)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", paths: tuple[str, str] | None = None, tiers: tuple[int, ...] = TIERS,
         end_id: int = END_ID, slack: int = SLACK, pool: int = POOL, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Pieces of all documents in packed sequences: ``key``, start, length, ids (binary, little-endian unsigned
    32 bit), doc_tokens, sequence_id, offset, tier (length of the window) and step_group.

    Hierarchical packing. The ids of a document are cut at the longest tier; what is left goes to the smallest
    tier that holds it. A task packs a pool of documents from the long tier to the short: each window is
    opened by a document of its tier, its gap filled by the longest documents of shorter tiers that fit, and
    closed by cutting one more where none fits. So windows of shorter tiers are exactly full, and those of the
    longest lack at most ``slack`` tokens. Windows are then dealt to step groups of like tokens and attention.
    The few documents that fill no window of a task meet in a second pass; one short sequence per ``pool`` of these is left.

    Each task reads its part of ``docs`` once and holds one pool; ids are shuffled only in the second pass.
    The packed pieces are written to the shared folder, so all that read them see one packing. A very long
    text is tokenised in parts that end before a space.

    A null text is empty and has the end token only, as an empty one. Null, tied or repeated keys are documents
    of their own. Other columns of ``docs`` are not carried. An empty table gives no pieces. ``tiers`` ascend
    and each is at most twice the one before. ``paths`` are the vocabulary for tokenizers and the same as ranks
    for tiktoken; both must exist on all nodes.
    """
    spark = docs.sparkSession
    if paths is None:
        import public_tokenizers

        paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    long = T.LongType()
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType)] + [T.StructField(n, t) for n, t in [
        ("start", long), ("length", long), ("ids", T.BinaryType()), ("doc_tokens", long), ("sequence_id", long), ("offset", long),
        ("tier", T.IntegerType()), ("step_group", long)]])
    options = (tiers, slack, pool, group_tokens)

    def arrow_schema(batch: pa.RecordBatch) -> pa.Schema:
        types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        return pa.schema(list(zip(schema.names, types)))

    def run(batches, read, first, last):
        batches = iter(batches)
        head = next(batches, None)
        if head is None:
            return
        number = first + (TaskContext.get().partitionId() << 32)
        yield from _packed((p for b in _chain(head, batches) for p in read(b)), arrow_schema(head), number, last, options)

    def documents(batch):
        for doc, value in zip(batch.column(0), batch.column(1)):
            ids = token_ids(value.as_py(), paths, end_id)
            yield Piece(doc.as_py(), 0, len(ids), ids)

    def pieces(batch):
        for doc, start, ids, n in zip(*(c.to_pylist() for c in batch.columns)):
            yield Piece(doc, start, n, np.frombuffer(ids, "<u4"))

    path = shared_folder(spark, "packed")
    packed = docs.select(key, text).mapInArrow(lambda batches: run(batches, documents, 0, False), schema)
    packed.withColumn("open", F.col("sequence_id").isNull()).write.partitionBy("open").parquet(path)
    written = spark.read.schema(T.StructType([*schema.fields, T.StructField("open", T.BooleanType())])).parquet(path)
    closed, rest = written.where("not open").drop("open"), written.where("open")
    groups = -(-rest.count() // pool)
    if not groups:
        return closed
    rest = rest.select(key, "start", "ids", "doc_tokens").repartition(groups, F.xxhash64(key, "start")).sortWithinPartitions(key, "start")
    return closed.unionByName(rest.mapInArrow(lambda batches: run(batches, pieces, SECOND, True), schema))


def _chain(head, tail):
    yield head
    yield from tail
