"""Small pieces of checking SQL."""

from __future__ import annotations

from schedulesmith.schema import corpus

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def num(x: str) -> str:
    return f"(case when regexp_matches({x}, '{NUMBER}') then try_cast({x} as double) end)"


def currency(x: str) -> str:
    return num(f"trim(replace(translate(trim({x}), '$,)', ''), '(', '-'))")


def plain(x: str, drop: str = ",$") -> str:
    return num(f"trim(translate({x}, '{drop}', ''))" if drop else f"trim({x})")


def wrapped(x: str) -> str:
    t = f"trim(translate({x}, '$,', ''))"
    return num(f"(case when {t} like '(%)' then concat('-', trim(substr({t}, 2, length({t}) - 2))) else {t} end)")


def looks_numeric(x: str) -> str:
    return f"regexp_matches(trim(translate({x}, ',$%', '')), '{NUMBER}')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def values_table(rows, columns: str) -> str:
    body = ", ".join("(" + ", ".join(quoted(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"(values {body}) as t({columns})"


def normalize(x: str) -> str:
    spaced = rf"regexp_replace(trim(lower({x})), '[\s_\-.#()/&]+', ' ', 'g')"
    return rf"trim(regexp_replace({spaced}, '[^\p{{L}}\p{{N}}_\s]', '', 'g'))"


def normalize_memory(x: str) -> str:
    spaced = rf"regexp_replace(trim(lower({x})), '[\s_\-.]+', ' ', 'g')"
    return rf"trim(regexp_replace({spaced}, '[^\p{{L}}\p{{N}}_\s]', '', 'g'))"


CORPUS = f"(select * from {values_table(corpus(), 'idx, text, target, kind')})"
