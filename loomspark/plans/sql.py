"""Pieces of DuckDB SQL that mirror the library's expressions."""

from __future__ import annotations

from ..functions.text import ELONGATION, MARKS, MARKS_WIDE, WS


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return trim(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def light(x: str) -> str:
    return trim(f"regexp_replace(replace({x}, '{ELONGATION}', ''), ' {{2,}}', ' ', 'g')")


def hard(x: str) -> str:
    flat = f"regexp_replace(regexp_replace({x}, '[\\t\\n\\r]+', ' ', 'g'), '{WS}+', ' ', 'g')"
    return f"replace({trim(flat)}, '{ELONGATION}', '')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def signature(x: str) -> str:
    return f"array_to_string(list_sort({words(f'lower({x})')}), ' ')"


def bucket(x: str, n: int = 6) -> str:
    return f"substring(md5({signature(x)}), 1, {n})"


def unmarked(x: str, wide: bool = False) -> str:
    return f"regexp_replace({x}, '{MARKS_WIDE if wide else MARKS}', '', 'g')"


def lines(x: str) -> str:
    return f"string_split({x}, chr(10))"


def full_lines(x: str) -> str:
    return f"list_filter({lines(x)}, lambda l: length({trim('l')}) > 0)"


def draw(key: str, seed=42, *more: str) -> str:
    return f"md5('{seed}:' || CAST({key} AS VARCHAR)" + "".join(f" || ':' || {m}" for m in more) + ")"


def uniform(key: str, seed=42, *more: str) -> str:
    return f"(CAST('0x' || substring({draw(key, seed, *more)}, 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def pick(n: str, key: str, seed=42, *more: str) -> str:
    return f"CAST(floor({uniform(key, seed, *more)} * {n}) AS INTEGER)"


def missing(x: str) -> str:
    t = trim(f"CAST({x} AS VARCHAR)")
    return f"({x} IS NULL OR lower({t}) IN ('', 'empty', 'nan', 'none', '<na>') OR {t} IN ('[]', '[ ]', '{{}}'))"
