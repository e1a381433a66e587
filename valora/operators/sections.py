"""Sections of a text: headings found by pattern, keywords or likeness; spans between them; status."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valora.functions import text as T
from valora.operators.pages import indel_ratio
from valora.runtime import keep

# Fixed value: an optional number or label before a title.
PREFIX = r"^\s*(?:cap(?:itulo|\.?)\s*(?:\d+|[ivxlcdm]+)\s*[:\-]\s*|secci[oó]n\s*\d+\s*[:\-]\s*|\d+(?:\.\d+)*\s*[:\-.]\s*)?"
RESIDUE = " \t:-–—.•·"
MAX_HEADING, FUZZY_LEAST = 160, 86.0


def title_pattern(titles: list[str]) -> str:
    """A pattern for any of the titles at the start of a line."""
    alts = "|".join(re.escape(t).replace(r"\ ", " ") for t in titles)
    return rf"(?iu){PREFIX}(?:{alts})(?=\W|$)"


def heading_hits(df: DataFrame, id_col: str, text_col: str, schema: dict[str, list[str]]) -> DataFrame:
    """(id, line_no, start, section_id, begin, rest): lines that open a section, by the schema's first match.

    The schema is small and fixed, so it becomes one expression rather than a join. Lines are tested
    in the text's own array; only those that open a section become rows, and only they are given
    their offset.
    """

    def section(line: Column) -> Column:
        out = F.lit(None).cast("string")
        for sid, titles in reversed(list(schema.items())):
            out = F.when(line.rlike(title_pattern(titles)), F.lit(sid)).otherwise(out)
        return out

    ls = F.split(F.col(text_col), "\n")
    heads = F.filter(F.transform(ls, lambda x, i: F.struct(i.alias("i"), x.alias("line"), section(x).alias("s"))), lambda h: h["s"].isNotNull() & (F.length(h["line"]) > 0))
    before = lambda h: F.when(h["i"] > 0, F.length(F.array_join(F.slice(ls, 1, h["i"]), "\n")) + 1).otherwise(0)
    rows = df.select(id_col, F.explode(F.transform(heads, lambda h: F.struct((h["i"] + 1).alias("line_no"), h["line"].alias("line"), h["s"].alias("section_id"), before(h).alias("start")))).alias("h")).select(id_col, "h.*")
    rest = F.lit(None).cast("string")
    for sid, titles in reversed(list(schema.items())):
        rest = F.when(F.col("section_id") == sid, F.regexp_replace("line", title_pattern(titles), "")).otherwise(rest)
    tail = F.ltrim(rest, F.lit(RESIDUE))
    return rows.withColumn("tail", tail).select(id_col, "line_no", "start", "section_id", (F.col("start") + F.length("line") - F.length("tail")).alias("begin"), F.trim("tail", F.lit(RESIDUE)).alias("rest"))


def chosen_headings(hits: DataFrame, id_col: str) -> DataFrame:
    """One heading per document and section: the last without text after its title, else the first."""
    pure = F.length("rest") == 0
    by = Window.partitionBy(id_col, "section_id").orderBy(pure.desc(), F.when(pure, -F.col("start")).otherwise(F.col("start")))
    return hits.withColumn("rn", F.row_number().over(by)).where("rn = 1").drop("rn")


def section_spans(df: DataFrame, id_col: str, text_col: str, schema: dict[str, list[str]]) -> DataFrame:
    """(id, section_id, ord, text) of every document and every section of the schema.

    A section reaches from its heading's end (or the text after its title) to the next chosen
    heading; sections not found are empty. A document without any has the section sin_clasificar
    with its whole text.
    """
    heads = chosen_headings(keep(heading_hits(df, id_col, text_col, schema), "headings"), id_col)
    by = Window.partitionBy(id_col).orderBy("start")
    spans = heads.withColumn("next", F.lead("start").over(by))
    per_doc = spans.groupBy(id_col).agg(F.collect_list(F.struct("section_id", "begin", "next")).alias("_spans"))  # at most one per section
    order = F.array(*(F.struct(F.lit(s).alias("section_id"), F.lit(i).alias("ord")) for i, s in enumerate(schema, 1)))
    j = df.select(id_col, F.col(text_col).alias("_t")).join(per_doc, id_col, "left")
    whole = F.array(F.struct(F.lit("sin_clasificar").alias("section_id"), F.lit(0).alias("ord")))
    rows = j.select(id_col, "_t", "_spans", F.explode(F.when(F.col("_spans").isNull(), whole).otherwise(order)).alias("x"))
    span = F.get(F.filter("_spans", lambda s: s["section_id"] == F.col("x.section_id")), F.lit(0))
    part = F.substring(F.col("_t"), span["begin"] + 1, F.greatest(F.coalesce(span["next"], F.length("_t")) - span["begin"], F.lit(0)))
    text = F.when(F.col("x.ord") == 0, F.coalesce("_t", F.lit(""))).otherwise(F.coalesce(part, F.lit("")))
    return rows.select(id_col, "x.section_id", "x.ord", T.strip(text).alias("text"))


def keyword_section(line: Column, schema: dict[str, list[str]], least: float | None = None, own_least: dict[str, float] | None = None) -> Column:
    """The first section whose keywords a line holds to a sufficient share (all of one or two, half of
    more; least: for all sections, own_least: for one)."""
    out = F.lit(None).cast("string")
    low = F.lower(line)
    for sid, words in reversed(list(schema.items())):
        if words:
            share = sum((F.when(F.contains(low, F.lit(w.lower())), 1).otherwise(0) for w in words), F.lit(0)) / len(words)
            need = own_least[sid] if own_least and sid in own_least else least if least is not None else (1.0 if len(words) <= 2 else 0.5)
            out = F.when((share > 0) & (share >= need), F.lit(sid)).otherwise(out)
    return out


def token_set_ratio(a: str, b: str) -> float:
    """Likeness in per cent of two texts by their common words and what each has besides."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    only_a, only_b = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_a or not only_b):
        return 100.0
    l, r = f"{both} {only_a}".strip(), f"{both} {only_b}".strip()
    return max(indel_ratio(l, r), indel_ratio(both, l) if both else 0.0, indel_ratio(both, r) if both else 0.0)


def fuzzy_sections(lines: DataFrame, line_col: str, schema: dict[str, list[str]], least: float = FUZZY_LEAST, own_least: dict[str, float] | None = None) -> DataFrame:
    """Distinct lines with the section whose title or alias is likest, where it is like enough
    (own_least: a section's own bound).

    Lines are made distinct first; the schema is fixed, so scoring is a row-wise Arrow function.
    """
    choices = [(plain_title(t), sid) for sid, titles in schema.items() for t in titles]

    bounds = own_least or {}

    def best(lines_: pd.Series) -> pd.DataFrame:
        rows = []
        for x in lines_:
            sc, sid = max(((token_set_ratio(x, c), s) for c, s in choices), key=lambda z: z[0]) if x else (0.0, None)
            rows.append((sid, sc) if sid and sc >= bounds.get(sid, least) else (None, sc))
        return pd.DataFrame(rows, columns=["section_id", "score"])

    udf = F.pandas_udf(best, "section_id string, score double")
    return lines.select(T.ascii_form(F.col(line_col)).alias("line")).where(F.length("line").between(1, MAX_HEADING)).distinct().withColumn("m", udf("line")).select("line", "m.section_id", "m.score").where("section_id IS NOT NULL")


def plain_title(s: str) -> str:
    import unicodedata

    return re.sub(r"\s+", " ", unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower()).strip()


def section_status(has_sections: Column, n_sections: Column, flag: Column, has_chunks: Column, has_label: Column, matched: Column, text: Column) -> Column:
    """found, empty or missing of a rubric's section in a document."""
    blank = F.length(T.strip(F.coalesce(text, F.lit("")))) == 0
    return (
        F.when(~has_sections, F.when(flag | ~has_chunks, "missing").otherwise("found"))
        .when(n_sections == 0, F.when(flag | ~has_chunks, "missing").otherwise("found"))
        .when(~has_label, "found")
        .when(matched & ~blank, "found")
        .when(matched, F.when(flag, "missing").otherwise("empty"))
        .otherwise("missing")
    )
