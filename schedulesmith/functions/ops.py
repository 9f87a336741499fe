"""The whitelist of column operations.

Each typed function below returns the value the operation defines. An operation that uses a
parsed form of the cell several times takes it as a second argument, so that a plan can compute
it in a projection before (``PREPARED``); without it the function parses for itself.
``apply_operation`` runs an operation by name inside the lossless cleaned table, where every
field is text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import (
    INTEGER_FIELDS, MONETARY_FIELDS, SPRINKLER_ALIASES, SPRINKLER_CODES, STATE_CODES, STATE_NAMES,
)
from .text import double_text, in_list, lookup, number, strip


def strip_currency(v: Column) -> Column:
    """Amount without "$" and ","; "(" reads as minus; anything else non-numeric is null (G1)."""
    return number(v, "$,", parens="minus")


def to_float(v: Column) -> Column:
    """Number without "," and "$"; parentheses are not a sign here."""
    return number(v, ",$")


def to_int(v: Column, parsed: Column | None = None) -> Column:
    """Whole numbers as integer text, fractions unchanged, anything else null."""
    d = number(v, ",") if parsed is None else parsed
    return F.when(d == F.floor(d), F.floor(d).cast("decimal(38,0)").cast("string")).when(d.isNotNull(), v)


def to_str(v: Column) -> Column:
    return F.nullif(strip(v), F.lit(""))


def trim_whitespace(v: Column) -> Column:
    return strip(v)


def normalize_spaces(v: Column) -> Column:
    return F.regexp_replace(strip(v), r"(?U)\s+", " ")


def _compact_state(v: Column) -> Column:
    return F.upper(F.regexp_replace(v, r"(?U)[\s.]", ""))


def state_to_abbrev(v: Column, parsed: Column | None = None) -> Column:
    """State code for codes, dotted codes and full names; otherwise the stripped value."""
    compact = _compact_state(v) if parsed is None else parsed
    return F.coalesce(F.when(in_list(compact, STATE_CODES), compact), lookup(STATE_NAMES, F.lower(strip(v))), strip(v))


def normalize_sprinkler_code(v: Column, parsed: Column | None = None) -> Column:
    s = strip(v) if parsed is None else parsed
    return F.when(F.upper(s).isin(SPRINKLER_CODES), F.upper(s)).otherwise(F.coalesce(lookup(SPRINKLER_ALIASES, F.lower(s)), s))


# Date spellings in the order they are tried, as (shape, pattern).
DATE_FORMATS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
]
PACKED_DATE = r"^(\d{4})(1[0-2]|0[1-9]|[1-9])(3[01]|[12]\d|0[1-9]|[1-9])$"


def normalize_date(v: Column, parsed: Column | None = None) -> Column:
    """ISO date for the first spelling that gives a real date, else the value unchanged."""
    s = strip(v) if parsed is None else parsed
    packed = F.regexp_replace(s, PACKED_DATE, "$1-$2-$3")
    tries = [F.when(s.rlike(shape), F.try_to_date(s, pattern)) for shape, pattern in DATE_FORMATS]
    tries.append(F.when(s.rlike(PACKED_DATE), F.try_to_date(packed, "yyyy-M-d")))
    return F.coalesce(F.date_format(F.coalesce(*tries), "yyyy-MM-dd"), v)


def to_year_int(v: Column) -> Column:
    """First four-digit year between 1700 and 2029 standing as its own word."""
    return F.get(F.regexp_extract_all(strip(v), F.lit(r"\b(1[7-9]\d{2}|20[0-2]\d)\b"), F.lit(1)), F.lit(0)).cast("int")


def _zip_digits(v: Column) -> Column:
    return F.regexp_replace(F.substring_index(F.substring_index(strip(v), "-", 1), ".", 1), r"\D", "")


def to_zip(v: Column, parsed: Column | None = None) -> Column:
    """Five-digit postal code; three or four digits are codes that lost leading zeros."""
    digits = _zip_digits(v) if parsed is None else parsed
    return F.when(F.length(digits) >= 5, F.substring(digits, 1, 5).cast("int")).when(F.length(digits) >= 3, digits.cast("int"))


def flag_for_review(v: Column) -> Column:
    return v


def _as_text(fn: Callable[..., Column]) -> Callable[..., Column]:
    return lambda v, *parsed: fn(v, *parsed).cast("string")


def _strip_currency_text(v: Column) -> Column:
    return double_text(strip_currency(v))


def _to_float_text(v: Column) -> Column:
    return double_text(to_float(v))


# Operation name -> text-to-text form used inside the lossless table.
REGISTRY: dict[str, Callable[[Column], Column]] = {
    "strip_currency": _strip_currency_text,
    "to_float": _to_float_text,
    "to_int": to_int,
    "to_str": to_str,
    "to_year_int": _as_text(to_year_int),
    "to_zip": _as_text(to_zip),
    "state_to_abbrev": state_to_abbrev,
    "normalize_sprinkler_code": normalize_sprinkler_code,
    "trim_whitespace": trim_whitespace,
    "normalize_spaces": normalize_spaces,
    "normalize_date": normalize_date,
    "flag_for_review": flag_for_review,
}
WHITELIST = frozenset(REGISTRY)

# What an operation reads several times; a plan computes it in a projection of its own.
PREPARED: dict[str, Callable[[Column], Column]] = {
    "to_int": lambda v: number(v, ","),
    "to_zip": _zip_digits,
    "state_to_abbrev": _compact_state,
    "normalize_sprinkler_code": strip,
    "normalize_date": strip,
}
# Operations whose result is a number; to_int leaves fractions as they were.
NUMERIC = frozenset({"strip_currency", "to_float", "to_int", "to_year_int", "to_zip"})


def apply_operation(operation: str, v: Column, parsed: Column | None = None) -> Column:
    """Run one whitelisted operation by name (G13); an unknown name is an error."""
    if operation not in REGISTRY:
        raise ValueError(f"operation '{operation}' is not in the whitelist: {sorted(WHITELIST)}")
    return REGISTRY[operation](v) if parsed is None else REGISTRY[operation](v, parsed)


def apply_operations(operations: list[str], v: Column) -> Column:
    """Fold operations over one column in the given order."""
    for operation in operations:
        v = apply_operation(operation, v)
    return v


def apply_named(operation: Column, v: Column) -> Column:
    """Run the operation named by another column; the value is unchanged for other names."""
    out = v
    for name, fn in REGISTRY.items():
        if name != "flag_for_review":
            out = F.when(operation == name, fn(v)).otherwise(out)
    return out


def mask_value(v: Column) -> Column:
    """Shape-preserving mask: e-mail -> "<email>", digits -> 9, at most 32 characters."""
    s = F.regexp_replace(strip(v), r"(?U)[\w.+-]+@[\w-]+\.[\w.-]+", "<email>")
    s = F.regexp_replace(s, r"\p{Nd}", "9")
    return F.when(F.length(s) > 32, F.concat(F.substring(s, 1, 32), F.lit("…"))).otherwise(s)


def suggest_operation(field: str, has_currency: Column) -> Column:
    """Usual operation for a target field."""
    fixed = {
        "Year Built": "to_year_int", "Zip": "to_zip", "State": "state_to_abbrev",
        "Fire Sprinklers (Y/N)": "normalize_sprinkler_code",
    }
    if field in MONETARY_FIELDS:
        return F.when(has_currency, F.lit("strip_currency")).otherwise(F.lit("to_float"))
    if field in fixed:
        return F.lit(fixed[field])
    return F.lit("to_int" if field in INTEGER_FIELDS else "trim_whitespace")
