"""Pieces of DuckDB SQL that several queries share, as functions of a column's SQL."""

from __future__ import annotations

from valora.functions import text as T

WHITE = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"


def identifier(x: str) -> str:
    return f"strip_accents(lower({strip(x)}))"


def ascii_form(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(strip_accents(lower({x})), '[^\\x00-\\x7F]', '', 'g'), '\\s+', ' ', 'g'))"


def trailing(x: str) -> str:
    a = strip(f"regexp_replace({x}, '(?i){T._PAGE_WORD}\\s*$', '')")
    return strip(f"regexp_replace({a}, '[\\s\\-–—]*\\d{{1,4}}\\s*$', '')")


def leading(x: str) -> str:
    a = strip(f"regexp_replace({x}, '(?i)^\\s*{T._PAGE_WORD}[\\s\\-–—]*', '')")
    return strip(f"regexp_replace({a}, '^\\s*\\d{{1,4}}[\\s\\-–—]*', '')")


def edge_form(x: str) -> str:
    return ascii_form(trailing(leading(x)))


def weighted(value: str, weight: str) -> str:
    ok = f"{value} IS NOT NULL AND {weight} > 0"
    return f"coalesce(sum(CASE WHEN {ok} THEN {value} * {weight} END) / nullif(sum(CASE WHEN {ok} THEN {weight} END), 0), avg({value}))"


def clamp(x: str, lo: str, hi: str) -> str:
    return f"least(greatest({x}, {lo}), {hi})"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def nearest(x: str, levels: tuple[float, ...]) -> str:
    vals = ", ".join(f"({v}::DOUBLE)" for v in levels)
    return f"(SELECT l FROM (VALUES {vals}) t(l) ORDER BY abs(l - {x}), l LIMIT 1)"


def mock_score(prompt: str, levels: tuple[float, ...]) -> str:
    vals = ", ".join(f"{v}::DOUBLE" for v in levels)
    return f"CASE WHEN length(trim({prompt})) = 0 THEN 0.0::DOUBLE ELSE list_extract([{vals}], (('0x' || substr(sha256({prompt}), 1, 8))::BIGINT % {len(levels)} + 1)::INT) END"
