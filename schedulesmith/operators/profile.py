"""Column value profiles (P1-P16) and how well a profile fits each target.

Input is the long table ``values(file_id, sheet_name, col_idx, value[, row_idx])``. Values
are first counted per distinct text, so every pattern test runs once per distinct value
and weights by its count; a value that fills a third of a column collapses on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ops import suggest_operation
from ..functions.text import in_list, number, rounded, shows, strip, strip_cell
from ..schema import (
    CODE_FIELDS, MONETARY_FIELDS, PLACE_FIELDS, SPRINKLER_LOOKALIKES, STATE_CODES, STREET_WORDS, TARGET_FIELDS,
)

# A non-empty column fitting a target less than this contradicts it.
VETO_FIT = 0.25
EMPTY_FIT = 0.5


def _predicates(v: Column, current_year: int) -> dict[str, Column]:
    numeric = number(v, "$,", parens="minus")
    storeys = number(v, ",")
    amount = number(v, ",$")
    tokens = F.split(F.lower(v), r"(?U)\s+|,|\.")
    return {
        "numeric_ratio": numeric.isNotNull(),
        "currency_ratio": v.rlike(r"[$,]"),
        "year_ratio": v.rlike(r"^\d{4}$") & v.try_cast("int").between(1700, current_year + 1),
        "zip_ratio": v.rlike(r"^\d{5}(-\d{4}|\.0)?$"),
        "short_zip_ratio": v.rlike(r"^\d{3,4}(\.0)?$"),
        "state_ratio": in_list(F.upper(F.regexp_replace(v, r"(?U)[\s.]", "")), STATE_CODES),
        "sprinkler_ratio": in_list(F.upper(v), SPRINKLER_LOOKALIKES),
        "yn_ratio": F.upper(v).isin("Y", "N", "YES", "NO"),
        "storey_ratio": F.coalesce(storeys.between(1, 200) & (storeys == F.floor(storeys)), F.lit(False)),
        "monetary_ratio": F.coalesce(F.abs(amount) >= 100, F.lit(False)),
        "address_ratio": v.rlike(r"(?U)\d+\s+\w+")
        | F.arrays_overlap(tokens, F.split(F.lit(" ".join(STREET_WORDS)), " ")),
    }


RATIOS = ["numeric_ratio", "currency_ratio", "year_ratio", "zip_ratio", "short_zip_ratio", "state_ratio",
          "sprinkler_ratio", "yn_ratio", "storey_ratio", "monetary_ratio", "address_ratio"]


def column_profiles(values: DataFrame, keys: list[str], current_year: int) -> DataFrame:
    """One profile row per ``keys``; keys without any non-blank value have ``n = 0`` and ``empty``."""
    v = F.col("_v")
    distinct = (
        values.select(*keys, F.when(shows(F.col("value")), strip_cell(F.col("value"))).alias("_v"))
        .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_w"))
    )
    num = number(v, "$,", parens="minus")
    tested = distinct.select(
        *keys, "_w", v.isNotNull().alias("_some"), num.alias("_num"), F.length(v).alias("_len"),
        *[F.coalesce(p, F.lit(False)).alias(f"_{name}") for name, p in _predicates(v, current_year).items()],
    )
    w = F.when(F.col("_some"), F.col("_w")).otherwise(F.lit(0))
    numeric_w = F.when(F.col("_num").isNotNull(), F.col("_w")).otherwise(F.lit(0))
    sums = tested.groupBy(*keys).agg(
        F.sum(w).alias("n"),
        F.sum(F.col("_some").cast("bigint")).alias("n_distinct"),
        F.sum(numeric_w).alias("n_numeric"),
        F.min("_num").alias("min"),
        F.max("_num").alias("max"),
        F.sum(F.col("_num") * F.col("_w")).alias("_total"),
        F.min((F.col("_num") == F.floor("_num"))).alias("_all_integers"),
        F.max(F.col("_num") < 0).alias("_any_negative"),
        F.sum(F.col("_len") * w).alias("_chars"),
        F.max("_len").alias("max_length"),
        *[F.sum(F.when(F.col(f"_{r}"), w).otherwise(F.lit(0))).alias(f"n_{r}") for r in RATIOS if r != "numeric_ratio"],
    )
    n = F.col("n")
    some = n > 0
    return sums.select(
        *keys, "n", (~some).alias("empty"),
        F.when(some, F.col("n_numeric") / n).alias("numeric_ratio"),
        "min", "max", (F.col("_total") / F.nullif(F.col("n_numeric"), F.lit(0))).alias("mean"),
        F.coalesce("_all_integers", F.lit(False)).alias("all_integers"),
        F.coalesce("_any_negative", F.lit(False)).alias("any_negative"),
        F.when(some, F.col("_chars") / n).alias("mean_length"), "max_length",
        *[F.when(some, F.col(f"n_{r}") / n).alias(r) for r in RATIOS if r != "numeric_ratio"],
        F.when(some, F.col("n_distinct") / n).alias("unique_ratio"),
    )


# --- profiles that merge ------------------------------------------------------------------

# Size of the sketches of distinct values (2^LG_K registers of a byte at most) and the error of their estimates:
# one standard deviation of a union is 1.04 / sqrt(2^LG_K); ERROR_SIGMAS of them are taken as the bound.
LG_K, ERROR_SIGMAS = 12, 4


def profile_parts(values: DataFrame, keys: list[str], current_year: int, lg_k: int = LG_K) -> DataFrame:
    """Mergeable profile state per ``keys``: counts, sums, extremes and a sketch of the distinct values.

    Every cell is tested where it is read and added up in the task, so one row per task and key is shuffled
    and no cell. Keep these rows per file; ``merge_profiles`` adds them up for any coarser key, and a new file
    only needs its own pass.
    """
    v = F.col("_v")
    num = number(v, "$,", parens="minus")
    tested = values.select(*keys, F.nullif(strip(F.col("value")), F.lit("")).alias("_v")).select(
        *keys, v.alias("_v"), num.alias("_num"), F.length(v).alias("_len"),
        *[F.coalesce(p, F.lit(False)).alias(f"_{name}") for name, p in _predicates(v, current_year).items() if name != "numeric_ratio"])
    return tested.groupBy(*keys).agg(
        F.count(v).alias("n"), F.count("_num").alias("n_numeric"), F.min("_num").alias("min"), F.max("_num").alias("max"),
        F.coalesce(F.sum("_num"), F.lit(0.0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("_num") != F.floor("_num"), 1).otherwise(0)), F.lit(0)).alias("n_fractions"),
        F.coalesce(F.sum(F.when(F.col("_num") < 0, 1).otherwise(0)), F.lit(0)).alias("n_negative"),
        F.coalesce(F.sum("_len"), F.lit(0)).alias("chars"), F.max("_len").alias("max_length"),
        *[F.sum(F.col(f"_{r}").cast("bigint")).alias(f"n_{r}") for r in RATIOS if r != "numeric_ratio"],
        F.hll_sketch_agg(v, lg_k).alias("distinct"))


def merge_profiles(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Profile state per ``keys`` from states of finer keys, or of parts of the same."""
    added = ["n", "n_numeric", "total", "n_fractions", "n_negative", "chars", *[f"n_{r}" for r in RATIOS if r != "numeric_ratio"]]
    return parts.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in added], F.min("min").alias("min"), F.max("max").alias("max"), F.max("max_length").alias("max_length"),
        F.hll_union_agg("distinct").alias("distinct"))


def finished_profiles(parts: DataFrame, keys: list[str], lg_k: int = LG_K) -> DataFrame:
    """The columns of ``column_profiles`` from mergeable states, with estimated distinct values.

    All but ``unique_ratio`` are exact. ``n_distinct`` is the estimate of the sketch and ``n_distinct_error`` the
    bound of its error, ``ERROR_SIGMAS`` standard deviations; small counts are exact in the sketch.
    """
    n = F.col("n")
    some = n > 0
    distinct = F.hll_sketch_estimate("distinct")
    return parts.select(
        *keys, "n", (~some).alias("empty"), F.when(some, F.col("n_numeric") / n).alias("numeric_ratio"), "min", "max",
        (F.col("total") / F.nullif(F.col("n_numeric"), F.lit(0))).alias("mean"),
        ((F.col("n_numeric") > 0) & (F.col("n_fractions") == 0)).alias("all_integers"), (F.col("n_negative") > 0).alias("any_negative"),
        F.when(some, F.col("chars") / n).alias("mean_length"), "max_length",
        *[F.when(some, F.col(f"n_{r}") / n).alias(r) for r in RATIOS if r != "numeric_ratio"],
        F.when(some, F.least(distinct, n) / n).alias("unique_ratio"), distinct.alias("n_distinct"),
        F.ceil(ERROR_SIGMAS * 1.04 / 2 ** (lg_k / 2) * distinct).alias("n_distinct_error"))


def fit(target: str, current_year: int, digits: int | None = 4) -> Column:
    """Fit of a profile row to one target, 0..1; an empty column fits nothing."""
    c = F.col
    numeric, monetary = c("numeric_ratio"), c("monetary_ratio")
    if target in MONETARY_FIELDS:
        score = monetary * 0.6 + numeric * 0.4
        score = F.when(c("any_negative"), score * 0.5).otherwise(score)
        score = F.when(c("year_ratio") >= 0.9, score * 0.2).otherwise(score)
    elif target == "Year Built":
        # A zero minimum or maximum carries no range evidence.
        in_range = (numeric > 0.8) & (c("min") >= 1700) & (c("max") <= current_year + 1) & (c("max") != 0)
        score = F.when(in_range, F.least(F.lit(1.0), c("year_ratio") + 0.3)).otherwise(c("year_ratio"))
    elif target == "Zip":
        z = F.greatest(c("zip_ratio"), c("short_zip_ratio") * 0.6)
        score = F.when(z > 0.5, z).otherwise(z * (1 - F.least(F.lit(0.5), monetary)))
    elif target == "State":
        score = c("state_ratio")
    elif target == "Fire Sprinklers (Y/N)":
        score = F.least(F.lit(1.0), c("sprinkler_ratio") + c("yn_ratio") * 0.3)
    elif target in ("Storeys", "Number of Buildings"):
        score = F.least(F.lit(1.0), c("storey_ratio") + F.when(numeric > 0.8, 0.2).otherwise(0.0))
    elif target == "Reference":
        fraction = (numeric > 0.8) & ~c("all_integers")
        score = F.when(fraction, F.lit(0.2)).otherwise(0.5 + c("unique_ratio") * 0.5)
    elif target == "Address":
        score = F.when(numeric < 0.2, F.greatest(c("address_ratio"), F.lit(0.3))).otherwise(c("address_ratio"))
    elif target in PLACE_FIELDS + CODE_FIELDS:
        score = (1 - numeric) * 0.7 + (1 - monetary) * 0.3
        if target in PLACE_FIELDS:
            score = F.when(numeric > 0.8, F.lit(0.0)).otherwise(score)
    else:
        raise ValueError(f"unknown target field {target!r}")
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))
    return F.when(c("empty"), F.lit(0.0)).otherwise(rounded(score, digits))


def packed_fits(profiles: DataFrame, keys: list[str], current_year: int, digits: int | None = 4) -> DataFrame:
    """One row per profile: (keys, empty, fits) with the 17 fits in the order of the target fields."""
    return profiles.select(*keys, "empty", F.array(*[fit(t, current_year, digits) for t in TARGET_FIELDS]).alias("fits"))


def unpack_fits(packed: DataFrame, keys: list[str]) -> DataFrame:
    """Long table (keys, empty, target_pos, target, fit, map_fit, contradicts) of packed fits.

    ``map_fit`` is the fit the mapper uses, neutral for an empty column (F11).
    """
    targets = F.array(*[F.lit(t) for t in TARGET_FIELDS])
    long = packed.select(*keys, "empty", F.posexplode("fits").alias("target_pos", "fit"))
    return long.select(*keys, "empty", "target_pos", F.get(targets, F.col("target_pos")).alias("target"), "fit",
                       map_fit(F.col("empty"), F.col("fit")).alias("map_fit"), contradicts(F.col("empty"), F.col("fit")).alias("contradicts"))


def map_fit(empty: Column, value: Column) -> Column:
    return F.when(empty, F.lit(EMPTY_FIT)).otherwise(value)


def contradicts(empty: Column, value: Column) -> Column:
    return ~empty & (value < VETO_FIT)


def profile_fits(profiles: DataFrame, keys: list[str], current_year: int,
                 digits: int | None = 4) -> DataFrame:
    """Long table of fits: 17 rows per profile, no join."""
    return unpack_fits(packed_fits(profiles, keys, current_year, digits), keys)


def suggested_operations(profiles: DataFrame, keys: list[str]) -> DataFrame:
    """Usual operation per profile and target, judged by currency marks among the values."""
    has_currency = F.coalesce(F.col("currency_ratio") > 0, F.lit(False))
    pairs = F.array(*[
        F.struct(F.lit(t).alias("target"), suggest_operation(t, has_currency).alias("operation"))
        for t in TARGET_FIELDS
    ])
    return profiles.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.target", "_p.operation")
