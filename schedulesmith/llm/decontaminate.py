"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

# Words of a window; the share of hit words, as a fraction, from which a document counts as contaminated.
WINDOW, COVERAGE = 13, (1, 20)
# Items are put into one automaton up to so many words (about 1 KB of memory each); more items take several passes.
AUTOMATON_WORDS = 400_000

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NORMAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normal_words(text: str | None) -> list[str]:
    """Words after lower-casing A-Z; none for null."""
    return NORMAL_WORD.findall(text.translate(LOWER)) if text else []


class Automaton:
    """Suffix automaton over the words of all items.

    ``next``, ``link`` and ``length`` are the usual arrays. ``windows[state]`` lists (length,
    items) of the windows that strings of the state end with; a window is ``width`` words, or a
    whole shorter item.
    """

    def __init__(self, items: list[tuple[str, list[str]]], width: int = WINDOW):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: dict[tuple[int, int], set[str]] = {}
        for item, tokens in items:
            state = 0
            for token in tokens:
                state = self._extend(state, token)
        for item, tokens in items:
            size = min(width, len(tokens))
            state = matched = 0
            for token in tokens:
                state, matched = self.step(state, matched, token)
                if matched >= size:
                    at = state
                    while self.length[self.link[at]] >= size:
                        at = self.link[at]
                    ends.setdefault((at, size), set()).add(item)
        self.windows: list[list[tuple[int, frozenset[str]]]] = [[] for _ in self.next]
        for (state, size), found in ends.items():
            self.windows[state].append((size, frozenset(found)))
        # Windows of a state hold for every state whose strings end with it.
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            above = self.windows[self.link[state]]
            if above:
                self.windows[state] = self.windows[state] + above

    def _extend(self, last: int, token: str) -> int:
        known = self.next[last].get(token)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, known, token)
        new = self._state(self.length[last] + 1, {})
        at = last
        while at >= 0 and token not in self.next[at]:
            self.next[at][token] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            known = self.next[at][token]
            self.link[new] = known if self.length[known] == self.length[at] + 1 else self._split(at, known, token)
        return new

    def _state(self, length: int, moves: dict[str, int]) -> int:
        self.next.append(moves)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, at: int, known: int, token: str) -> int:
        twin = self._state(self.length[at] + 1, dict(self.next[known]))
        self.link[twin], self.link[known] = self.link[known], twin
        while at >= 0 and self.next[at].get(token) == known:
            self.next[at][token] = twin
            at = self.link[at]
        return twin

    def step(self, state: int, matched: int, token: str) -> tuple[int, int]:
        """State and length of the longest item substring that ends with the next word."""
        while state and token not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        found = self.next[state].get(token)
        return (found, matched + 1) if found is not None else (0, 0)

    def scan(self, tokens: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal hit runs [start, end) of a text, in words, and the items with a window in it."""
        runs: list[tuple[int, int]] = []
        items: set[str] = set()
        moves, windows, state, matched = self.next, self.windows, 0, 0
        first = moves[0]
        for i, token in enumerate(tokens):
            if not state:
                state = first.get(token, 0)
                matched = 1 if state else 0
            elif (found := moves[state].get(token)) is not None:
                state, matched = found, matched + 1
            else:
                state, matched = self.step(state, matched, token)
            if state and windows[state]:
                longest = 0
                for size, found_in in windows[state]:
                    if size <= matched:
                        items |= found_in
                        longest = max(longest, size)
                if longest:
                    start = i + 1 - longest
                    while runs and runs[-1][1] >= start:
                        start = min(start, runs.pop()[0])
                    runs.append((start, i + 1))
        return runs, items


def item_parts(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, list[str]]]]:
    """The distinct items as parts of at most ``limit`` words (or one item), fetched one partition at a time."""
    part: list[tuple[str, list[str]]] = []
    held = 0
    names = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    for name, text in benchmark.select(names, "text").where("text is not null").distinct().toLocalIterator():
        tokens = normal_words(text)
        if part and held + len(tokens) > limit:
            yield part
            part, held = [], 0
        if tokens:
            part.append((name, tokens))
            held += len(tokens)
    yield part


# The automaton that this worker process built last, under the name of its part.
_LAST: dict[str, Automaton] = {}


def built(name: str, part: Broadcast, width: int) -> Automaton:
    """The automaton of a part, built once per worker process and kept for its next tasks."""
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = Automaton(part.value, width)
    return _LAST[name]


def scan_documents(shaped: DataFrame, part: list[tuple[str, list[str]]], width: int) -> DataFrame:
    """Adds what one automaton finds to rows of (row, text, n_words, spans, items, cleaned)."""
    sent, name = shaped.sparkSession.sparkContext.broadcast(part), uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = built(name, sent, width)
        for batch in batches:
            sizes, spans, names, cleaned = [], [], [], []
            for text, before, known in zip(*[batch.column(k).to_pylist() for k in (1, 3, 4)]):
                tokens = normal_words(text)
                runs, found = automaton.scan(tokens)
                sizes.append(len(tokens))
                runs = merge_runs(runs + [(x["first"], x["end"]) for x in before])
                spans.append([{"first": a, "end": b} for a, b in runs])
                names.append(sorted(found.union(known)))
                cleaned.append(remove_spans(text, runs, width) if any(b - a >= width for a, b in runs) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(
                spans, batch.schema.field(3).type), pa.array(names, batch.schema.field(4).type), pa.array(cleaned, pa.string())], batch.schema.names)

    return shaped.mapInArrow(scan, shaped.schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, coverage: tuple[int, int] = COVERAGE,
                       automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """All columns of ``docs`` as ``row`` with text, n_words, n_hit, n_items, items_sha256, contaminated, the hit spans and cleaned.

    A window is ``width`` consecutive words of an item, or a whole shorter item; a document word
    inside any occurrence of a window is hit. ``spans`` are the hit runs as (first word, end
    word). A document is contaminated if the share of its words that are hit reaches ``coverage``;
    ``cleaned`` is its text without the spans of ``width`` words or more, null where it has none.

    A worker holds one automaton of at most ``automaton_words`` words. A larger benchmark is cut
    into parts that are matched in passes one after another, with the rows stored in between, so
    memory is bounded and no item is left out. Documents stream through without a shuffle. Null
    and empty texts have no words; items without words match nothing; a null item_id is an empty
    name; repeated rows of either table change nothing else.
    """
    none = F.array().cast("array<struct<first:bigint,end:bigint>>")
    found = docs.select(F.struct("*").alias("row"), "text", F.lit(0).cast("long").alias("n_words"), none.alias("spans"),
                        F.array().cast("array<string>").alias("items"), F.lit(None).cast("string").alias("cleaned"))
    for k, part in enumerate(item_parts(benchmark, automaton_words)):
        found = scan_documents(stored(found, "contamination") if k else found, part, width)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return found.withColumn("n_hit", hit).select(
        "row", "text", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (coverage[1] * F.col("n_hit") >= coverage[0] * F.col("n_words"))).alias("contaminated"), "spans", "cleaned")


def merge_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if merged and merged[-1][1] >= a:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def remove_spans(text: str | None, spans: list[tuple[int, int]], min_words: int = WINDOW) -> str | None:
    """The text without hit runs of ``min_words`` words or more, with the characters between their words."""
    if not text or not spans:
        return text
    places = [m.span() for m in NORMAL_WORD.finditer(text.translate(LOWER))]
    out, at = [], 0
    for a, b in spans:
        if b - a >= min_words:
            out.append(text[at:places[a][0]])
            at = places[b - 1][1]
    return "".join(out) + text[at:]
