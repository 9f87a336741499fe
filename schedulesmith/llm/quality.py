"""Quality rules with adaptive thresholds from mergeable quantile sketches, DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, attach, stored, words

# Logarithmic bins: a quantile is off by half this share of its value at most.
GAMMA = 1.02
# A language and source with fewer usable documents takes the merged sketch of its language, that the one of all.
MIN_DOCS = 50


@dataclass(frozen=True)
class Fence:
    """How the sketch of a measure sets its limits.

    ``quartiles``: the quartiles and ``spread`` times their distance beyond, both ways.
    ``tail``: of the documents that have any, the 90th percentile and ``spread`` times its distance from the median.
    ``rare``: the same over all documents; where nine tenths have none, ``share`` of the median of those that have any.
    """

    measure: str
    kind: str
    spread: float
    share: float = 0.1

    @property
    def lower(self) -> bool:
        return self.kind == "quartiles"


FENCES = (Fence("symbols_per_word", "rare", 2.0), Fence("word_length", "quartiles", 3.0), Fence("dup_line_share", "tail", 2.0), Fence("repeat_share", "tail", 2.0))


def measures(text: Column) -> dict[str, Column]:
    """Counts of a whole text that need no other column."""
    safe = F.coalesce(text, F.lit(""))
    return {
        "words_": words(text),
        "word_chars": F.length(F.regexp_replace(safe, f"{SPACE}+", "")).cast("long"),
        "n_symbols": (F.length(safe) - F.length(F.translate(safe, "#*$%&|<>", ""))).cast("long"),
        "lines_": F.filter(F.split(safe, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    }


def repeated_words(tokens: str, width: int = 3) -> tuple[dict[str, Column], dict[str, Column], Column]:
    """Words covered by ``width``-word windows that occur at least twice, as columns for three selects.

    Windows are compared by a 64-bit hash: within a text of 20,000 words two differ in hash
    but for a chance of 1e-11. Most texts repeat no window and skip the sort.
    """
    size = F.size(tokens)
    windows = F.transform(
        F.slice(F.col(tokens), 1, F.greatest(size - (width - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *[F.get(F.col(tokens), i + k) for k in range(1, width)]))
    first = {"windows_": windows}
    ordered = F.when(F.size(F.array_distinct("windows_")) < F.size("windows_"),
                     F.sort_array(F.transform("windows_", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    s = F.col("sorted_")
    same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
    places = F.sort_array(F.transform(F.filter(F.transform(
        s, lambda x, j: F.struct(x["i"].alias("i"), (same(x, j - 1) | same(x, j + 1)).alias("again"))), lambda x: x["again"]), lambda x: x["i"]))
    covered = F.aggregate(
        F.transform("places_", lambda p, k: F.least(F.lit(width), F.coalesce(F.get(F.col("places_"), k + 1) - p, F.lit(width)))),
        F.lit(0).cast("long"), lambda total, x: total + x)
    return first, {"sorted_": ordered}, {"places_": places}, F.coalesce(covered, F.lit(0).cast("long"))


def score(docs: DataFrame, text: str = "text", keep: Column | None = None) -> DataFrame:
    """``docs`` as ``row`` (or ``keep``) with lang, source and the counts of every text, one narrow pass.

    A null text has no words; lines and windows are compared exactly and by hash.
    """
    base = docs.select((F.struct("*") if keep is None else keep).alias("row"), F.col("lang").alias("lang_"), F.col("source").alias("source_"),
                       *[c.alias(n) for n, c in measures(F.col(text)).items()])
    first, second, third, covered = repeated_words("words_")
    counted = base.withColumns(first).withColumns(second).withColumns(third).select(
        "row", "lang_", "source_", F.size("words_").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"),
        F.size("lines_").cast("long").alias("n_lines"), covered.alias("n_repeat_words"))
    n = F.greatest("n_words", F.lit(1))
    return counted.select(
        "*", ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") / n).alias("symbols_per_word"), (F.col("word_chars") / n).alias("word_length"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_line_share"), (F.col("n_repeat_words") / n).alias("repeat_share"))


def sketch(scored: DataFrame, fences: tuple[Fence, ...] = FENCES) -> DataFrame:
    """Quantile sketches: counts per (lang, source, measure, logarithmic bin) of the documents that pass the base rules.

    Sketches of parts of the corpus merge by adding counts, so Spark adds them up on the map
    side and a hot source costs no more than its bins. Zero has a bin of its own (null).
    """
    bins = F.explode(F.array(*[F.struct(
        F.lit(f.measure).alias("measure"), F.when(F.col(f.measure) > 0, F.ceil(F.log(F.col(f.measure)) / F.log(F.lit(GAMMA)))).alias("bin"))
        for f in fences]))
    return scored.where("not base_failed").select("lang_", "source_", bins.alias("b")).groupBy(
        "lang_", "source_", F.col("b.measure").alias("measure"), F.col("b.bin").alias("bin")).agg(F.count("*").alias("n"))


def quantiles(sketches: DataFrame) -> DataFrame:
    """Percentiles of every sketch, of those merged by language (level 1) and of all (level 2): q over all documents, s over those with any."""
    levels = sketches.select("lang_", "source_", "measure", "bin", "n")
    none = F.lit(None).cast("string")
    per_language = levels.groupBy("lang_", "measure", "bin").agg(F.sum("n").alias("n"))
    overall = per_language.groupBy("measure", "bin").agg(F.sum("n").alias("n"))
    every = levels.withColumn("level", F.lit(0)).unionByName(
        per_language.select("lang_", none.alias("source_"), "measure", "bin", "n", F.lit(1).alias("level"))).unionByName(
        overall.select(none.alias("lang_"), none.alias("source_"), "measure", "bin", "n", F.lit(2).alias("level")))
    group = Window.partitionBy("level", "lang_", "source_", "measure")
    upto = group.orderBy(F.col("bin").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    value = F.when(F.col("bin").isNull(), 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bin")) / (GAMMA + 1))
    some = F.when(F.col("bin").isNotNull(), F.col("n"))
    ranked = every.select("*", F.sum("n").over(upto).alias("upto"), F.sum("n").over(group).alias("total"), value.alias("value"),
                          F.sum(some).over(upto).alias("some_upto"), F.coalesce(F.sum(some).over(group), F.lit(0)).alias("some"))
    at = lambda upto, total, percent: F.min(F.when(F.col(upto) * 100 >= F.col(total) * percent, F.col("value")))
    return ranked.groupBy("level", "lang_", "source_", "measure").agg(
        F.max("total").alias("total"), F.max("some").alias("some"), *[at("upto", "total", p).alias(f"q{p}") for p in (25, 50, 75, 90)],
        *[at("some_upto", "some", p).alias(f"s{p}") for p in (50, 90)])


def thresholds(sketches: DataFrame, fences: tuple[Fence, ...] = FENCES, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per (lang_, source_) with the limits of each measure, widened by the resolution of the sketch.

    Percentiles come from the sketch of the stratum if it has ``min_docs`` documents (for s: that have any), else
    from its language's, else from that of all. A measure that no document has any of has no limit.
    """
    found = quantiles(sketches)
    facts = [c for c in found.columns if c not in ("level", "lang_", "source_", "measure")]
    side = lambda level, prefix, keys: found.where(F.col("level") == level).select(*[F.col(k).alias(prefix + k) for k in keys + facts])
    joined = side(0, "", ["lang_", "source_", "measure"]).join(
        side(1, "l_", ["lang_", "measure"]), F.col("lang_").eqNullSafe(F.col("l_lang_")) & (F.col("measure") == F.col("l_measure"))).join(
        F.broadcast(side(2, "a_", ["measure"])), F.col("measure") == F.col("a_measure"))
    level = lambda c, n: F.when(F.col(n) >= min_docs, F.col(c)).when(F.col(f"l_{n}") >= min_docs, F.col(f"l_{c}")).otherwise(F.col(f"a_{c}"))
    of = {c: level(c, "total" if c.startswith("q") else "some") for c in facts if c not in ("total", "some")}
    highest, lowest = F.lit(None).cast("double"), F.lit(None).cast("double")
    for f in fences:
        if f.kind == "quartiles":
            high, low = of["q75"] + f.spread * (of["q75"] - of["q25"]), of["q25"] - f.spread * (of["q75"] - of["q25"])
            lowest = F.when(F.col("measure") == f.measure, low / GAMMA).otherwise(lowest)
        elif f.kind == "tail":
            high = of["s90"] + f.spread * (of["s90"] - of["s50"])
        else:
            high = F.when(of["q90"] > 0, of["q90"] + f.spread * (of["q90"] - of["q50"])).otherwise(f.share * of["s50"])
        highest = F.when(F.col("measure") == f.measure, high * GAMMA).otherwise(highest)
    limits = joined.select("lang_", "source_", "measure", highest.alias("high"), lowest.alias("low"))
    pick = lambda f, c: F.max(F.when(F.col("measure") == f.measure, F.col(c)))
    return limits.groupBy("lang_", "source_").agg(F.struct(
        *[pick(f, "high").alias(f"{f.measure}_max") for f in fences], *[pick(f, "low").alias(f"{f.measure}_min") for f in fences if f.lower]).alias("limits"))


def judge(scored: DataFrame, fences: tuple[Fence, ...] = FENCES, min_docs: int = MIN_DOCS) -> DataFrame:
    """``scored`` with ``kept``: passes the base rules and lies within the limits of its language and source.

    ``scored`` is read twice (sketches, filter), so it should be stored. Documents without a
    language or source form strata of their own. A stratum without usable documents has no
    limits and none of its documents passes the base rules.
    """
    limits = thresholds(sketch(scored, fences), fences, min_docs).withColumnsRenamed({"lang_": "l", "source_": "s"})
    inside = F.lit(True)
    for f in fences:
        inside = inside & F.coalesce(F.col(f.measure) <= F.col(f"limits.{f.measure}_max"), F.col(f.measure) == 0)
        if f.lower:
            inside = inside & (F.col(f.measure) >= F.col(f"limits.{f.measure}_min"))
    joined = attach(scored, stored(limits, "quality-limits"), F.col("lang_").eqNullSafe(F.col("l")) & F.col("source_").eqNullSafe(F.col("s")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))).drop("l", "s", "limits")


def quality_rules(docs: DataFrame, fences: tuple[Fence, ...] = FENCES, keep: Column | None = None) -> DataFrame:
    """Score all documents, store the counts once, judge them by the thresholds of their language and source.

    Null texts, texts without words and repeated rows are judged like any other; an empty table
    gives an empty result. Input columns travel in ``row`` and may have any name.
    """
    return judge(stored(score(docs, keep=keep), "quality-scores", compression="zstd"), fences)
