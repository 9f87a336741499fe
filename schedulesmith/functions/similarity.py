"""Name and vector similarity on distinct headers.

Both functions work on the distinct header texts of a portfolio, never on data rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import attach, settle, store

# Corpus entries of one piece, and queries of one block.
BLOCK, QUERY_BLOCK = 4096, 8192
# Of large inputs pieces meet queries by units, and blocks grow: to a share of the rows, but to so many components of vectors at most.
SHARE, HELD_COMPONENTS = 16, 1 << 21
# Pivots around which a large corpus is cut into cells.
PIVOTS = 1024
# Similarities that a task holds at a time; two that agree to so many digits are a tie.
HELD, DIGITS = 1 << 22, 9


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one big-integer step per character of ``b``."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    ones = (1 << len(a)) - 1
    row = ones
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & ones
    return len(a) - row.bit_count()


def sorted_tokens(text: str) -> str:
    return " ".join(sorted(text.split()))


def token_sort_ratio(a: str, b: str) -> float:
    """Similarity 0..100 of two texts after sorting their words (insert/delete distance)."""
    a, b = sorted_tokens(a), sorted_tokens(b)
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * common_subsequence(a, b) / total


def fuzzy_hits(header: Column, texts: list[str], threshold: float) -> Column:
    """Array of (idx, score) of the corpus texts scoring at least ``threshold``.

    The corpus is the fixed list of known names, so the work per header is constant. A pair
    whose lengths alone rule the threshold out is not compared.
    """
    known = [sorted_tokens(t) for t in texts]

    @F.pandas_udf("array<struct<idx:int,score:double>>")
    def score(batch: pd.Series) -> pd.Series:
        out = []
        for header_text in batch:
            mine = sorted_tokens(header_text or "")
            hits = []
            for idx, text in enumerate(known):
                total = len(mine) + len(text)
                if total and 200.0 * min(len(mine), len(text)) / total >= threshold:
                    ratio = 200.0 * common_subsequence(mine, text) / total
                    if ratio >= threshold:
                        hits.append({"idx": idx, "score": ratio})
            out.append(hits)
        return pd.Series(out)

    return score(header)


def _angles(vectors, pivots):
    """Angles between rows of two matrices; a zero vector is at a right angle to all."""
    import numpy as np

    a, b = np.linalg.norm(vectors, axis=1)[:, None], np.linalg.norm(pivots, axis=1)[None, :]
    return np.arccos(np.clip(vectors @ pivots.T / np.where(a * b == 0, 1.0, a * b), -1.0, 1.0))


def _usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is there and has only finite components."""
    return vectors.where(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def _nearest_cell(pivots):
    """Cell (nearest pivot by angle), the angle to it and the squared norm of each vector."""
    import numpy as np

    @F.pandas_udf("struct<cell:int,angle:double,norm:double>")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        rows = np.stack(vectors.to_numpy()).astype("float64")
        angles = _angles(rows, pivots)
        cell = angles.argmin(axis=1)
        return pd.DataFrame({"cell": cell, "angle": angles[np.arange(len(cell)), cell], "norm": (rows ** 2).sum(axis=1)})

    return nearest("vector")


def _cells(corpus: DataFrame, corpus_id: str, block: int) -> tuple[DataFrame, list]:
    """The corpus with its cell and chunk, and per cell (pivot, radius, least squared norm, chunks, entries).

    Cells are the surroundings of at most ``PIVOTS`` pivots, a sample that only shapes the cells:
    every entry is in one. A cell of more than ``block`` entries is cut into chunks. Cells are
    found once and stored with the corpus.
    """
    import numpy as np

    n = max(1, -(-corpus.count() // block))
    picked = corpus.select(corpus_id, "vector").orderBy(F.xxhash64(corpus_id), corpus_id).limit(min(n, PIVOTS)).collect() if n > 1 else []
    if not picked:
        return corpus.select("*", F.lit(0).alias("_cell"), F.lit(0).alias("_chunk")), [(None, 0.0, 0.0, 1, 0)]
    pivots = np.array([r["vector"] for r in picked], "float64")
    placed = store(corpus.withColumn("_p", _nearest_cell(pivots)))
    sizes = {r["cell"]: r for r in placed.groupBy("_p.cell").agg(
        F.max("_p.angle").alias("radius"), F.min("_p.norm").alias("norm"), F.count("*").alias("n")).collect()}
    facts = [(pivots[i], sizes[i]["radius"], sizes[i]["norm"], -(-sizes[i]["n"] // block), sizes[i]["n"]) if i in sizes else (pivots[i], 0.0, 0.0, 0, 0)
             for i in range(len(pivots))]
    chunks = F.get(F.array(*[F.lit(f[3]) for f in facts]), F.col("_p.cell"))
    out = placed.withColumn("_chunk", F.pmod(F.xxhash64(corpus_id), chunks).cast("int")).withColumn("_cell", F.col("_p.cell"))
    return out.drop("_p"), facts


def _chain(pivots) -> list[int]:
    """Pivots in an order in which each is followed by the nearest that is left."""
    import numpy as np

    angles = _angles(pivots, pivots)
    order, left = [0], np.ones(len(pivots), bool)
    left[0] = False
    while left.any():
        order.append(int(np.where(left, angles[order[-1]], np.inf).argmin()))
        left[order[-1]] = False
    return order


def _query_blocks(queries: DataFrame, query_id: str, facts: list, query_block: int | None = None) -> DataFrame:
    """Queries with their block ``_q`` of about ``query_block``; queries of one block are near each other, so they need the same cells."""
    import numpy as np

    n = queries.count()
    query_block = query_block or _grown(n, QUERY_BLOCK, facts)
    if n <= query_block:
        return queries.withColumn("_q", F.lit(0))
    if facts[0][0] is None:
        return queries.withColumn("_q", F.pmod(F.xxhash64(query_id), F.lit(-(-n // query_block))).cast("int"))
    pivots = np.stack([f[0] for f in facts])
    placed = queries.withColumn("_p", _nearest_cell(pivots)["cell"])
    counts = {r["_p"]: r["count"] for r in placed.groupBy("_p").count().collect()}
    first, parts, upto = [0] * len(facts), [1] * len(facts), 0
    for cell in _chain(pivots):
        held = counts.get(cell, 0)
        first[cell], upto = upto // query_block, upto + held
        parts[cell] = max(0, upto - 1) // query_block - first[cell] + 1 if held else 1
    at = lambda values: F.get(F.array(*[F.lit(x) for x in values]), F.col("_p"))
    return placed.withColumn("_q", (at(first) + F.pmod(F.xxhash64(query_id), at(parts))).cast("int")).drop("_p")


def _grown(rows: int, block: int, facts: list) -> int:
    """Rows of a large block: a ``SHARE`` of all, since a row is sent to every block of the other side, within the memory of a task."""
    if facts[0][0] is None:
        return block
    return max(block, min(-(-rows // SHARE), HELD_COMPONENTS // max(1, len(facts[0][0]))))


def _units(facts: list, block: int, unit: int) -> tuple[list[int], list[int]]:
    """(first piece of each cell, unit of each piece): pieces are the chunks of all cells, a unit holds pieces that are near each other."""
    import numpy as np

    first = [0] * len(facts)
    of = [0] * sum(max(1, f[3]) for f in facts)
    held = at = upto = 0
    for cell in _chain(np.stack([f[0] for f in facts])) if facts[0][0] is not None else range(len(facts)):
        first[cell] = at
        for _ in range(max(1, facts[cell][3])):
            size = facts[cell][4] / max(1, facts[cell][3])
            if held and held + size > unit:
                upto, held = upto + 1, 0
            of[at], held, at = upto, held + size, at + 1
    return first, of


def _reachable(facts: list, first: list[int], unit_of: list[int], min_similarity: float, metric: str):
    """The units, each with its pieces, that can hold an entry similar enough to a query vector.

    The angle to an entry is at least the angle to its pivot less the radius of the cell; cells
    whose best possible similarity is below the limit are left out, and only those.
    """
    import numpy as np

    if facts[0][0] is None:
        return F.array(F.struct(F.lit(0).alias("_unit"), F.array(F.lit(0)).alias("_pieces")))
    pivots = np.stack([f[0] for f in facts])
    radius, norm = np.array([f[1] for f in facts]), np.array([f[2] for f in facts])

    def by_unit(cells) -> list[dict]:
        units: dict[int, list[int]] = {}
        for c in cells:
            for piece in range(first[c], first[c] + facts[c][3]):
                units.setdefault(unit_of[piece], []).append(piece)
        return [{"_unit": u, "_pieces": pieces} for u, pieces in units.items()]

    @F.pandas_udf("array<struct<_unit:int,_pieces:array<int>>>")
    def units(vectors: pd.Series) -> pd.Series:
        rows = np.stack(vectors.to_numpy()).astype("float64")
        best = np.cos(np.maximum(0.0, _angles(rows, pivots) - radius))
        if metric != "cosine":
            best = 1 - ((rows ** 2).sum(axis=1)[:, None] + norm) / 2 * (1 - best)
        return pd.Series([by_unit(np.flatnonzero(row >= min_similarity - 1e-6).tolist()) for row in best])

    return units("vector")


def routed(queries: DataFrame, corpus: DataFrame, query_id: str, corpus_id: str, min_similarity: float, metric: str = "cosine",
           block: int | None = None, query_block: int | None = None, unit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Queries and corpus entries by (_q, _unit): block of queries, unit of near pieces (chunks of cells) of the corpus.

    A query is listed once with each unit, and with the ``_pieces`` of it that can hold an entry above the limit, by the
    triangle inequality of angles. The distinct (block, piece) pairs of all queries are the routes; a piece of the corpus goes once along
    each of its routes and nowhere else, so the rows shuffled depend on the data and not on the number of partitions.
    Units and blocks of queries that are not given grow with the rows, so a row is sent about ``SHARE`` times
    until they hold ``HELD_COMPONENTS``.
    """
    celled, facts = _cells(corpus, corpus_id, block or BLOCK)
    size = sum(f[4] for f in facts)
    first, unit_of = _units(facts, block or BLOCK, unit or (block if block else _grown(size, BLOCK, facts)))
    blocked = _query_blocks(queries, query_id, facts, query_block)
    left = blocked.select(F.col(query_id), F.col("vector"), "_q", F.inline(_reachable(facts, first, unit_of, min_similarity, metric)))
    routes = settle(left.select("_q", F.explode("_pieces").alias("_piece")).distinct())
    at = lambda values, i: F.get(F.array(*[F.lit(x) for x in values]), i)
    pieces = celled.withColumn("_piece", (at(first, F.col("_cell")) + F.col("_chunk")).cast("int")).withColumn("_unit", at(unit_of, F.col("_piece")))
    return left, attach(pieces.drop("_cell", "_chunk"), routes, ["_piece"])


def similarity_topk(queries: DataFrame, corpus: DataFrame, query_id: str, corpus_id: str, k: int, min_similarity: float,
                    metric: str = "cosine", best_per: str | None = None, block: int | None = None, query_block: int | None = None,
                    unit: int | None = None) -> DataFrame:
    """Exact top ``k`` corpus entries per query by vector similarity.

    Both inputs carry ``vector``; rows whose vector is null or has a null or non-finite component match nothing.
    The corpus is cut into cells around pivots and the queries into blocks of near ones; ``routed`` brings
    together what can match. Pieces are compared by matrix products that return at most ``k`` entries
    per query, so no task holds more than a block of queries and a unit of pieces at a time and candidate pairs are never
    written out. ``metric="cosine"`` keeps similarities of at least ``min_similarity``;
    ``metric="l2"`` uses ``max(0, 1 - d/2)`` of the squared distance and keeps those above it.
    ``best_per`` names a corpus column of which only the best entry per value counts. Similarities that
    agree to ``DIGITS`` digits are ties; the smaller id comes first.
    """
    group = best_per or "_own"
    if best_per is None:
        corpus = corpus.withColumn("_own", F.col(corpus_id))

    def field(df: DataFrame, name: str) -> str:
        return f"{name} {df.schema[name].dataType.simpleString()}"

    schema = ", ".join([field(queries, query_id), field(corpus, corpus_id), "similarity double"])
    if best_per:
        schema += ", " + field(corpus, best_per)
    left, right = routed(_usable(queries), _usable(corpus), query_id, corpus_id, min_similarity, metric, block, query_block, unit)
    # Aliases, since both sides may come from one table.
    right = right.select(*[F.col(c).alias(c) for c in dict.fromkeys((corpus_id, group, "vector", "_piece", "_unit", "_q"))])

    def compare(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        if qs.empty or cs.empty:
            none = {query_id: qs[query_id].to_numpy()[:0], corpus_id: cs[corpus_id].to_numpy()[:0],
                    "similarity": np.zeros(0)}
            return pd.DataFrame(none | ({best_per: cs[best_per].to_numpy()[:0]} if best_per else {}))
        cs = cs.sort_values([corpus_id], kind="stable")
        every_q, every_c = (np.stack(x["vector"].to_numpy()).astype("float64") for x in (qs, cs))
        query_ids, ids, groups, piece_of = qs[query_id].to_numpy(), cs[corpus_id].to_numpy(), cs[group].to_numpy(), cs["_piece"].to_numpy()
        listed = np.concatenate([np.asarray(x) for x in qs["_pieces"]])
        whose = np.repeat(np.arange(len(qs)), qs["_pieces"].map(len).to_numpy())
        found = []
        for piece in np.unique(piece_of):
            found += hits_of(every_q, whose[listed == piece], every_c, np.flatnonzero(piece_of == piece), groups)
        row, col, sims = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        if not best_per:  # the best of all pieces; entries are in the order of their ids
            order = np.lexsort((col, -np.round(sims, DIGITS), row))
            row, col, sims = row[order], col[order], sims[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, col, sims = row[kept], col[kept], sims[kept]
        out = {query_id: query_ids[row], corpus_id: ids[col], "similarity": sims}
        return pd.DataFrame(out | ({best_per: groups[col]} if best_per else {}))

    def hits_of(every_q, rows, every_c, own, every_group) -> list[tuple]:
        """(query, entry, similarity) of the best entries among ``own`` for the queries ``rows``."""
        import numpy as np

        c, groups = every_c[own], every_group[own]
        members = [np.flatnonzero(groups == g) for g in pd.unique(groups)] if best_per else None
        parts = []
        step = max(1, HELD // len(own))
        for start in range(0, len(rows), step):
            part = rows[start:start + step]
            q = every_q[part]
            dots = q @ c.T
            if metric == "cosine":
                norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None, :]
                sims = dots / np.where(norms == 0, 1.0, norms)
            else:
                sims = np.maximum(0.0, 1.0 - ((q ** 2).sum(1)[:, None] + (c ** 2).sum(1)[None, :] - 2 * dots) / 2.0)
            at = np.tile(np.arange(len(own)), (len(part), 1))
            if members:
                at = np.stack([m[np.argmax(np.round(sims[:, m], DIGITS), axis=1)] for m in members], axis=1)
                sims = np.take_along_axis(sims, at, axis=1)
            top = np.argsort(-np.round(sims, DIGITS), axis=1, kind="stable")[:, :k]
            sims, at = np.take_along_axis(sims, top, axis=1), np.take_along_axis(at, top, axis=1)
            keep = sims >= min_similarity if metric == "cosine" else sims > min_similarity
            row, col = np.nonzero(keep)
            parts.append((part[row], own[at[row, col]], sims[row, col]))
        return parts

    hits = left.groupBy("_q", "_unit").cogroup(right.groupBy("_q", "_unit")).applyInPandas(compare, schema)
    order = [F.desc(F.round("similarity", DIGITS)), F.col(corpus_id)]
    if best_per:
        hits = hits.withColumn("_r", F.row_number().over(Window.partitionBy(query_id, best_per).orderBy(*order))).where("_r = 1").drop("_r")
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(*order))).where(F.col("rank") <= k)
