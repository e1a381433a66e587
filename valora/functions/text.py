"""Text scalars as Column expressions; all run inside the JVM unless noted.

Null stays null throughout. Patterns carry (?U) or (?iU) where letters or white space beyond ASCII
must count, since Java's classes are ASCII by default.
"""

from __future__ import annotations

import html
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WHITE = " \t\n\r\x0b\x0c"
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff"


def accent_table() -> tuple[str, str]:
    """Precomposed Latin letters and their base letters, by Unicode's own decompositions."""
    src, dst = [], []
    for c in range(0xC0, 0x2C00):
        d = unicodedata.normalize("NFD", chr(c))
        if len(d) > 1 and d[0].isascii():
            src.append(chr(c))
            dst.append(d[0])
    return "".join(src), "".join(dst)


def strip(c: Column) -> Column:
    """Outer white space dropped (trim() alone drops spaces only)."""
    return F.trim(c, F.lit(WHITE))


def strip_accents(c: Column) -> Column:
    """Letters without accents: precomposed Latin letters mapped, combining marks dropped."""
    return F.regexp_replace(F.translate(c, *accent_table()), r"[\u0300-\u036f]", "")


def identifier(c: Column) -> Column:
    """The form in which labels are compared: trimmed, lower case, without accents."""
    return strip_accents(F.lower(strip(c)))


def clean_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def fuzzy_form(c: Column) -> Column:
    """Lower case ASCII words: accents dropped, all else than letters and digits a space."""
    return F.trim(F.regexp_replace(F.regexp_replace(strip_accents(F.lower(c)), r"[^a-z0-9\s]", " "), r"\s+", " "))


def ascii_form(c: Column) -> Column:
    """Lower case with accents and all other characters outside ASCII dropped, spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(strip_accents(F.lower(c)), r"[^\x00-\x7F]", ""), r"\s+", " "))


def search_form(c: Column, punctuation: str = ".,;:!?¡¿\"'()[]{}«»“”‘’-–—_/\\") -> Column:
    """Lower case without accents; listed punctuation is deleted, not replaced."""
    return F.trim(F.regexp_replace(F.translate(strip_accents(F.lower(c)), punctuation, ""), r"\s+", " "))


def line_whitespace(c: Column) -> Column:
    """Spaces and tabs collapsed and dropped around line feeds, which stay; bullets dropped."""
    c = F.translate(c, "•", "")
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t ]+", " "), r" ?\n ?", "\n"))


def strip_tags(c: Column) -> Column:
    """Markup tags as spaces, white space collapsed (entities must be resolved before)."""
    return clean_spaces(F.regexp_replace(c, r"<[^>]+>", " "))


def unescape_html(c: Column | str) -> Column:
    """HTML entities resolved (Arrow: the JVM has no table of them)."""
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else html.unescape(x)), StringType())(c)


def compatibility_form(c: Column | str) -> Column:
    """Unicode compatibility composition (Arrow: Spark SQL has no normaliser)."""
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x)), StringType())(c)


def drop_page_marks(c: Column) -> Column:
    """Form feeds and `=== PAGE n ===` lines dropped, white space collapsed."""
    return clean_spaces(F.regexp_replace(F.regexp_replace(c, "\x0c", " "), r"(?im)^=+\s*page\s*\d+\s*=+$", " "))


def collapse_repeats(c: Column, most: int = 2) -> Column:
    """Runs of more than `most` equal characters shortened: punctuation to one, others to `most`."""
    if most < 1:
        raise ValueError("a run must keep one character at least")
    one = F.regexp_replace(c, r"([.,;:!?¡¿])\1{%d,}" % most, "$1")
    return F.regexp_replace(one, r"(?s)([^.,;:!?¡¿])\1{%d,}" % most, "$1" * most)


# A page number's word, and the forms of numbers at a line's ends below.
_PAGE_WORD = r"p[aá]g(?:ina)?\s*\d+\s*(?:de\s*\d+)?"


def drop_trailing_page_number(c: Column) -> Column:
    """`text - 2`, `text Página 2 de 9` without the number at the end."""
    c = strip(F.regexp_replace(c, rf"(?i){_PAGE_WORD}\s*$", ""))
    return strip(F.regexp_replace(c, r"[\s\-–—]*\d{1,4}\s*$", ""))


def drop_leading_page_number(c: Column) -> Column:
    """`2 - text`, `Página 2 text` without the number at the start."""
    c = strip(F.regexp_replace(c, rf"(?i)^\s*{_PAGE_WORD}[\s\-–—]*", ""))
    return strip(F.regexp_replace(c, r"^\s*\d{1,4}[\s\-–—]*", ""))


def edge_form(c: Column) -> Column:
    """The form in which edge lines are compared: no page numbers, lower case ASCII."""
    return ascii_form(drop_trailing_page_number(drop_leading_page_number(c)))


def prompt_safe(c: Column) -> Column:
    """Non-breaking spaces and curly quotes made plain, zero-width marks dropped, stripped."""
    return strip(F.translate(F.translate(c, "\u00a0“”‘’«»", " \"\"''\"\""), ZERO_WIDTH, ""))


def first_filled(*cols: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*(F.when(F.length(strip(c)) > 0, c) for c in cols))


def within_budget(c: Column, budget: int = 12000, marker: str = "[texto truncado]", head: float = 0.85) -> Column:
    """The text, or its head and tail around a marker where it exceeds the budget."""
    sep = f"\n{marker}\n"
    room = max(2, budget - len(sep))
    n_head = int(room * head)
    cut = F.concat(F.rtrim(F.substring(c, 1, n_head)), F.lit(sep), F.ltrim(F.right(c, F.lit(room - n_head))))
    return F.when(F.length(c) > budget, cut).otherwise(c)


def compact_lines(c: Column) -> Column:
    """Inner spaces collapsed, line ends trimmed, at most one blank line in a row."""
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(c, r" +(\n|$)", "$1"), r"\n{3,}", "\n\n")


def word_count(c: Column) -> Column:
    """Words between white space; 0 for blank texts."""
    return F.when(F.length(strip(c)) == 0, 0).otherwise(F.size(F.split(strip(c), r"\s+")))


def ordered_distinct(c: Column) -> Column:
    """The distinct items of an array in the order of their first occurrence, without nulls."""
    return F.array_distinct(F.array_compact(c))


def slug(c: Column, most: int = 31) -> Column:
    """A file or sheet name: letters, digits and underscores."""
    return F.substring(F.regexp_replace(F.regexp_replace(identifier(c), r"[^a-z0-9]+", "_"), r"^_+|_+$", ""), 1, most)


def preview(c: Column, most: int = 300) -> Column:
    """The first `most` characters, with an ellipsis where more follow."""
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.left(c, F.lit(most))), F.lit("…"))).otherwise(c)


def filled_list(c: Column) -> Column:
    """An array's stripped items without null and blank ones; an empty array for null."""
    return F.coalesce(F.filter(F.transform(c, strip), lambda x: F.length(x) > 0), F.array().cast("array<string>"))


def coerced_text(c: Column) -> Column:
    """A text as it is, "" for null."""
    return F.coalesce(c.cast("string"), F.lit(""))


def coerced_map(c: Column) -> Column:
    """A map of texts without its null and blank values, empty for null."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.coalesce(F.map_filter(c, lambda _, v: v.isNotNull() & (F.length(strip(v)) > 0)), none)


def iso_stamp(at: Column) -> Column:
    """A time as an ISO text in seconds."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")


def file_stamp(at: Column) -> Column:
    """A time as it stands in file names."""
    return F.date_format(at, "yyyyMMdd_HHmmss")


def parsed_stamp(c: Column) -> Column:
    """The time of an ISO text with or without fractions; null for anything else."""
    return F.try_to_timestamp(F.regexp_replace(strip(c), "Z$", ""))


def canonical_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of named values, whatever their order: `name=value` by name, nulls left out."""
    return F.sha2(F.concat_ws("\u001f", *(F.concat(F.lit(k + "="), fields[k].cast("string")) for k in sorted(fields))), 256)
