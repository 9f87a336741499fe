"""Text and number helpers shared by all operators (pure Column expressions)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: every character a plain strip removes (Unicode whitespace).
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# A finite decimal literal. "nan", "inf", "1d" and "1_000" are text here.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def strip(v: Column) -> Column:
    return F.btrim(v, F.lit(WHITESPACE))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def to_double(text: Column) -> Column:
    """Guarded cast: null unless the whole text is a finite decimal literal. The text is matched once."""
    return F.get(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), F.lit(0)).try_cast("double")


def number_text(v: Column, drop: str = "", parens: str | None = None) -> Column:
    """Text left after removing symbols; every step uses its input once.

    ``parens="minus"`` turns "(" into "-" and removes ")" anywhere; ``parens="wrapped"``
    negates only values fully wrapped in parentheses; ``None`` leaves them in place.
    """
    if parens == "minus":
        return strip(F.translate(v, "(" + drop + ")", "-"))
    text = strip(F.translate(v, drop, "") if drop else v)
    return F.regexp_replace(text, r"(?Us)^\((.*?)\s*\)$", "-$1") if parens == "wrapped" else text


def starts_as_text(v: Column) -> Column:
    """The first character is an ASCII letter or a mark after ":": no number starts so, and nothing is stripped."""
    return (v >= ":") & (v < "\x7f")


# Literals of digits that need no cleaning, as most cells with numbers are.
PLAIN_NUMBER = r"^[0-9]+(?:\.[0-9]+)?\z"


def number(v: Column, drop: str = "", parens: str | None = None) -> Column:
    """The number of a cell; words and plain literals, which symbols and blanks do not change, skip the cleaning."""
    return F.when(starts_as_text(v), F.lit(None).cast("double")).when(v.rlike(PLAIN_NUMBER), v.try_cast("double")).otherwise(
        to_double(number_text(v, drop, parens)))


# The same literal with ",", "$" and "%" anywhere and blanks around it, as one pattern.
LOOSE_NUMBER = (
    r"(?U)^[\s,$%]*[+-]?[,$%]*(?:(?:[0-9][,$%]*+)++(?:\.[,$%]*(?:[0-9][,$%]*+)*+)?|\.[,$%]*(?:[0-9][,$%]*+)++)"
    r"(?:[eE][,$%]*[+-]?[,$%]*(?:[0-9][,$%]*+)++)?[\s,$%]*$"
)


def looks_numeric(v: Column) -> Column:
    """True when the value is a number after dropping thousands commas, "$" and "%" (R3)."""
    return ~starts_as_text(v) & v.rlike(LOOSE_NUMBER)


def shows(v: Column) -> Column:
    """True when the value is more than blanks: ``strip(v) != ""``, decided by its first character where that is printable ASCII."""
    return ((v >= "!") & (v < "\x7f")) | (strip(v) != "")


def strip_cell(v: Column) -> Column:
    """``strip`` of a plain column, which names it several times: a text between printable ASCII characters stays as it is."""
    return F.when((v >= "!") & (v < "\x7f") & F.substring(v, -1, 1).between("!", "~"), v).otherwise(strip(v))


def double_text(d: Column) -> Column:
    """Text of a parsed number without exponent: "5.0" for whole values."""
    return F.call_function("format_number", d, F.lit("0.0###############"))


def normalize_header(v: Column) -> Column:
    """Header form used for exact and fuzzy matching (M1)."""
    spaced = F.regexp_replace(strip(F.lower(v)), r"(?U)[\s_\-.#()/&]+", " ")
    return strip(F.regexp_replace(spaced, r"(?U)[^\w\s]", ""))


def normalize_header_text(text: str) -> str:
    """``normalize_header`` for a constant known on the driver."""
    spaced = re.sub(r"[\s_\-.#()/&]+", " ", text.lower().strip())
    return re.sub(r"[^\w\s]", "", spaced).strip()


def normalize_memory_header(v: Column) -> Column:
    """Header form used as mapping-memory key (M18): only blanks, "_", "-" and "." separate."""
    spaced = F.regexp_replace(strip(F.lower(v)), r"(?U)[\s_\-.]+", " ")
    return strip(F.regexp_replace(spaced, r"(?U)[^\w\s]", ""))


def file_safe_name(v: Column) -> Column:
    """Sheet name usable in a file name."""
    return F.btrim(F.regexp_replace(strip(v), r"(?U)[^\w\-.]+", "_"), F.lit("_"))


def folder_name(name: Column) -> Column:
    """Folder of a file or sheet: the name where it is file-safe, else its safe form and a hash of the exact name.

    Names with one safe form thus get folders of their own, whatever is exported together or later. A name
    that ends like such a hash gets one too.
    """
    safe = F.substring(file_safe_name(name), 1, 80)
    plain = (safe == name) & (name != "") & ~name.rlike("-[0-9a-f]{12}$")
    return F.when(plain, safe).otherwise(F.concat(F.coalesce(safe, F.lit("")), F.lit("-"), F.substring(F.md5(F.coalesce(name, F.lit("\0"))), 1, 12)))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Value of a small fixed mapping, null when absent."""
    pairs = ", ".join(_quoted(x) for kv in mapping.items() for x in kv)
    return F.try_element_at(F.expr(f"map({pairs})"), key)


def in_list(v: Column, names: list[str]) -> Column:
    """Is the value one of a fixed list of names; no name holds a comma."""
    return F.find_in_set(v, F.lit(",".join(names))) > 0


def fixed(x: Column | str, digits: int) -> Column:
    """Text with a fixed number of decimals, rounded from the exact binary value, ties to even."""
    x = F.col(x) if isinstance(x, str) else x
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", x.cast("double"), F.lit(pattern))


def rounded(x: Column, digits: int | None) -> Column:
    """Number rounded like ``fixed``; unchanged when ``digits`` is None. For per-sheet figures."""
    return x if digits is None else fixed(x, digits).cast("double")
