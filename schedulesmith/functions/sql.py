"""The twelve operations as SQL functions, for people who write queries.

``register_operations`` makes them known to a session; after that ``SELECT to_zip(zip) FROM …`` works, is inlined by
the optimizer and runs as built-in expressions do. A name outside the whitelist fails when the query is analysed.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..schema import SPRINKLER_ALIASES, SPRINKLER_CODES, STATE_CODES, STATE_NAMES
from .ops import DATE_FORMATS, PACKED_DATE, WHITELIST
from .text import NUMBER, WHITESPACE

# The patterns of the column functions.
BLANK_OR_DOT, BLANKS, NO_DIGIT = r"(?U)[\s.]", r"(?U)\s+", r"\D"
YEAR = r"\b(1[7-9]\d{2}|20[0-2]\d)\b"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _list(values) -> str:
    return ", ".join(map(_text, values))


def _lookup(mapping: dict[str, str], key: str) -> str:
    return f"try_element_at(map({_list(x for pair in mapping.items() for x in pair)}), {key})"


_STRIPPED = f"btrim(v, {_text(WHITESPACE)})"


def _number(text: str) -> str:
    return f"try_cast(nullif(regexp_extract({text}, {_text(NUMBER)}, 0), '') as double)"


def _plain_number(drop: str) -> str:
    return _number(f"btrim(translate(v, {_text(drop)}, ''), {_text(WHITESPACE)})")


_COMPACT = f"upper(regexp_replace(v, {_text(BLANK_OR_DOT)}, ''))"
_DIGITS = f"regexp_replace(substring_index(substring_index({_STRIPPED}, '-', 1), '.', 1), {_text(NO_DIGIT)}, '')"
_DATES = ", ".join(
    [f"case when {_STRIPPED} rlike {_text(shape)} then try_to_date({_STRIPPED}, {_text(pattern)}) end" for shape, pattern in DATE_FORMATS]
    + [f"case when {_STRIPPED} rlike {_text(PACKED_DATE)} then try_to_date(regexp_replace({_STRIPPED}, {_text(PACKED_DATE)}, '$1-$2-$3'), 'yyyy-M-d') end"])
_INT = _plain_number(",")

# Name -> (result type, body over the text v).
FUNCTIONS = {
    "strip_currency": ("double", _number(f"btrim(translate(v, '($,)', '-'), {_text(WHITESPACE)})")),
    "to_float": ("double", _plain_number(",$")),
    "to_int": ("string", f"case when {_INT} = floor({_INT}) then cast(cast(floor({_INT}) as decimal(38, 0)) as string) when {_INT} is not null then v end"),
    "to_str": ("string", f"nullif({_STRIPPED}, '')"),
    "trim_whitespace": ("string", _STRIPPED),
    "normalize_spaces": ("string", f"regexp_replace({_STRIPPED}, {_text(BLANKS)}, ' ')"),
    "state_to_abbrev": ("string", f"coalesce(case when {_COMPACT} in ({_list(STATE_CODES)}) then {_COMPACT} end, {_lookup(STATE_NAMES, f'lower({_STRIPPED})')}, {_STRIPPED})"),
    "normalize_sprinkler_code": (
        "string", f"case when upper({_STRIPPED}) in ({_list(SPRINKLER_CODES)}) then upper({_STRIPPED}) else coalesce({_lookup(SPRINKLER_ALIASES, f'lower({_STRIPPED})')}, {_STRIPPED}) end"),
    "normalize_date": ("string", f"coalesce(date_format(coalesce({_DATES}), 'yyyy-MM-dd'), v)"),
    "to_year_int": ("int", f"cast(nullif(regexp_extract({_STRIPPED}, {_text(YEAR)}, 1), '') as int)"),
    "to_zip": ("int", f"case when length({_DIGITS}) >= 5 then cast(substring({_DIGITS}, 1, 5) as int) when length({_DIGITS}) >= 3 then cast({_DIGITS} as int) end"),
    "flag_for_review": ("string", "v"),
}
assert FUNCTIONS.keys() == WHITELIST


def register_operations(spark: SparkSession) -> None:
    """Temporary functions of this session, one per whitelisted operation; they may be registered again."""
    for name, (kind, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}(v string) returns {kind} return {body}")
