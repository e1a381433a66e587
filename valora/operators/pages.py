"""Pages and lines: splitting, edges, repeated heads, noise and the cleaning report.

Every per-document loop is a key: lines carry doc_id and page_no, so that any number of documents
is cleaned at once. Counting repeated lines is a hash aggregation with partial sums; templates are
joined back, never collected.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valora.functions import text as T
from valora.runtime import keep, small_side

# Patterns of lines that are dropped (matched on the stripped lower-case line).
SOURCE_LINE = r"^(fuente[:\s]|elaboraci[oó]n(\s+propia|:)|elaborado\s+por|nota[:\s]|https?://|www\.)"
SIGNATURE_LINE = (
    r"firmad[oa]\s+digitalmente|firma\s+electr[oó]nica|digital\s+signature|\bhash\b|\bx\.?509\b|\breniec\b|\bdni[\s-]?e\b"
    r"|documento\s+generado\s+autom[aá]ticamente|certificado\s+digital"
)
PAGE_NUMBER_LINE = r"^(p[aá]g(ina)?\s*\d+\s*(de\s*\d+)?|-\s*\d+\s*-|\d{1,4})$"
SYMBOL_BOX = "[█▓▒■□◆◇►◄▪•●○◘◙◆★☆✦✧]"
CUSTOM_HEADERS = (
    r"gobierno del per[uú]|oficina de planeamiento|www\.gob\.pe|ministerio de |rep[uú]blica del per[uú]|informe de evaluaci[oó]n"
)
CUSTOM_FOOTERS = r"p[aá]gina \d+ de \d+|elaborado por |elaboraci[oó]n: |fuente: |revisado por |documento generado electr[oó]nicamente"
EDGE, CUSTOM_EDGE, MIN_REPEATS, REPEAT_SHARE, SIMILARITY, UNTAGGED_PAGE = 3, 5, 3, 0.6, 70, 5000


def fixed_pages(c: Column, size: int) -> Column:
    """A text in pages of `size` characters; no page for an empty text."""
    return F.regexp_extract_all(c, F.lit("(?s).{1,%d}" % size), 0)


def split_pages(df: DataFrame, id_col: str, text_col: str, untagged: int = UNTAGGED_PAGE) -> DataFrame:
    """(id, page_no, text): pages at form feeds and `=== PAGE n ===` lines, else of fixed size."""
    parts = F.filter(F.split(F.col(text_col), r"\x0c|(?:^|\n)=== PAGE \d+ ===\n?"), lambda p: F.length(T.strip(p)) > 0)
    pages = F.when(F.size(parts) > 1, parts).otherwise(fixed_pages(F.col(text_col), untagged))
    return df.select(F.col(id_col), F.posexplode(pages).alias("page_pos", "text")).select(id_col, (F.col("page_pos") + 1).alias("page_no"), "text")


def lines_of(pages: DataFrame, id_col: str) -> DataFrame:
    """(id, page_no, line_no, n_lines, line): line_no counts from 1."""
    ls = F.split("text", "\n")
    return pages.select(id_col, "page_no", F.size(ls).alias("n_lines"), F.posexplode(ls).alias("pos", "line")).select(id_col, "page_no", (F.col("pos") + 1).alias("line_no"), "n_lines", "line")


def at_edge(size: int = EDGE) -> Column:
    return (F.col("line_no") <= size) | (F.col("line_no") > F.col("n_lines") - size)


def edge_lines(pages: DataFrame, id_col: str, size: int = EDGE) -> DataFrame:
    """(id, page_no, line_no, line, zone): the first and last non-blank lines of every page.

    They are sliced from the page's own array of lines, so nothing is shuffled.
    """
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("line_no"), T.strip(x).alias("line")))
    full = F.filter(numbered, lambda x: F.length(x["line"]) > 0)
    marked = lambda part, zone: F.transform(part, lambda x: F.struct(x["line_no"].alias("line_no"), x["line"].alias("line"), F.lit(zone).alias("zone")))
    n = F.size("_full")
    both = F.concat(marked(F.slice("_full", 1, size), "header"), marked(F.slice("_full", F.greatest(n - size + 1, F.lit(1)), F.lit(size)), "footer"))
    rows = pages.select(id_col, "page_no", full.alias("_full")).where(n > 0).select(id_col, "page_no", F.explode(both).alias("x"))
    return rows.select(id_col, "page_no", "x.line_no", "x.line", "x.zone")


def candidates(pages: DataFrame, id_col: str) -> DataFrame:
    """Edge lines, and lines of known heads and foots near the edges, which count again."""
    a = edge_lines(pages, id_col).select(id_col, "zone", "page_no", "line_no", "line")
    lines = lines_of(pages, id_col)
    known = lambda zone, cond, rx: lines.where(cond & F.col("line").rlike("(?iu)" + rx)).select(id_col, F.lit(zone).alias("zone"), "page_no", "line_no", T.strip(F.col("line")).alias("line"))
    b = known("header", F.col("line_no") <= CUSTOM_EDGE, CUSTOM_HEADERS)
    c = known("footer", F.col("line_no") > F.col("n_lines") - CUSTOM_EDGE, CUSTOM_FOOTERS)
    return a.unionByName(b).unionByName(c)


def repeated_lines(cands: DataFrame, pages: DataFrame, id_col: str) -> DataFrame:
    """(id, zone, form, n): forms of edge lines on most pages of a document, at least three."""
    n_pages = pages.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_pages"))
    line = F.when(F.col("zone") == "header", T.drop_leading_page_number(F.col("line"))).otherwise(T.drop_trailing_page_number(F.col("line")))
    counted = cands.select(id_col, "zone", T.edge_form(line).alias("form")).groupBy(id_col, "zone", "form").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(n_pages, id_col).where(F.col("n") >= F.greatest(F.lit(MIN_REPEATS), F.floor(F.col("n_pages") * REPEAT_SHARE))).drop("n_pages")


def indel_ratio(a: str, b: str) -> float:
    """Similarity in per cent by insertions and deletions only: 200 * common subsequence / both lengths.

    The longest common subsequence is counted in one integer's bits, a step per character of b.
    """
    if not a and not b:
        return 100.0
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        u = row & at.get(y, 0)
        row = (row + u) | (row - u)
    return 200.0 * (len(a) - (row & full).bit_count()) / (len(a) + len(b))


def fuzzy_repeated_lines(cands: DataFrame, pages: DataFrame, id_col: str, similarity: int = SIMILARITY) -> DataFrame:
    """Like repeated_lines() for scanned pages: greedy clusters of similar lines; form is the
    commonest line of a cluster (first of equals). A group is a document's distinct edge lines,
    which are counted before, so that its size is bounded by the pages' variety."""
    n_pages = pages.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_pages"))
    counted = cands.groupBy(id_col, "zone", T.edge_form(F.col("line")).alias("form"), "line").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page_no", "line_no")).alias("at"))
    src = counted.join(n_pages, id_col).select(id_col, "zone", "form", "line", "n", F.col("at.page_no").alias("p"), F.col("at.line_no").alias("l"), "n_pages")
    kind = dict(src.dtypes)[id_col]

    def cluster(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rest = pdf.sort_values(["p", "l"], kind="stable")[["form", "line", "n"]].to_records(index=False).tolist()
        least = max(MIN_REPEATS, int(REPEAT_SHARE * int(pdf["n_pages"].iloc[0])))
        out = []
        while rest:
            seed = rest[0][0]
            like = {f: f == seed or indel_ratio(seed, f) >= similarity for f in {r[0] for r in rest}}
            near, rest = [r for r in rest if like[r[0]]], [r for r in rest if not like[r[0]]]
            if sum(r[2] for r in near) >= least:
                best = max(near, key=lambda r: r[2])
                out.append((key[0], key[1], best[1], sum(r[2] for r in near)))
        return pd.DataFrame(out, columns=[id_col, "zone", "form", "n"])

    return src.groupBy(id_col, "zone").applyInPandas(cluster, f"{id_col} {kind}, zone string, form string, n long")


def line_kind(template: Column) -> Column:
    """What a line is dropped as, by the first rule that holds; null for a line that stays.

    template: "header" or "footer" where the line's form is one of its document's repeated ones.
    """
    low = F.lower(T.strip(F.col("line")))
    return (
        F.when((template == "header") & (F.col("line_no") <= EDGE), "header")
        .when((template == "footer") & (F.col("line_no") > F.col("n_lines") - EDGE), "footer")
        .when(at_edge() & low.rlike(PAGE_NUMBER_LINE), "page_number")
        .when(low.rlike(SOURCE_LINE) & (F.length(low) < 140), "source")
        .when(low.rlike(SIGNATURE_LINE) & (F.length(low) < 200), "signature")
        .when(low.rlike(SYMBOL_BOX) | ((F.length(low) <= 2) & ~low.rlike("^[a-zA-Z0-9]")), "noise")
    )


def like_templates(edge: DataFrame, templates: DataFrame, id_col: str, similarity: int = SIMILARITY) -> DataFrame:
    """(id, form, zone): forms of edge lines that are like a template of their document.

    templates: (id, zone, form), a few per document. Forms are made distinct before they are compared.
    """
    forms = edge.select(id_col, T.edge_form(F.col("line")).alias("form")).where("form <> ''").distinct()
    t = templates.groupBy(id_col).agg(F.collect_set(F.struct("zone", T.edge_form(F.col("form")).alias("f"))).alias("ts"))

    def near(form: pd.Series, ts: pd.Series) -> pd.Series:
        return pd.Series([sorted({x["zone"] for x in xs if indel_ratio(x["f"], f) >= similarity}) for f, xs in zip(form, ts, strict=True)], dtype=object)

    zones = F.pandas_udf(near, "array<string>").asNondeterministic()
    return forms.join(t, id_col).select(id_col, "form", F.explode(zones("form", "ts")).alias("zone"))


def classified_lines(lines: DataFrame, pages: DataFrame, id_col: str, fuzzy: bool = False) -> DataFrame:
    """lines with `kind`, the rule that drops a line or null; fuzzy: heads and feet of scanned
    documents, by likeness to their templates."""
    cands = candidates(pages, id_col)
    rep = repeated_lines(cands, pages, id_col)
    if fuzzy:
        scanned = keep(ocr_like(pages, id_col).where("ocr_like").select(id_col), "ocr-like")
        inside = lambda df: df.join(small_side(scanned), id_col, "left_semi")
        near = like_templates(inside(lines.where(at_edge())), keep(fuzzy_repeated_lines(inside(cands), inside(pages), id_col), "templates"), id_col)
        rep = rep.select(id_col, "form", "zone").unionByName(near)
    zone = rep.groupBy(id_col, "form").agg(F.max(F.when(F.col("zone") == "header", True)).alias("as_header"), F.max(F.when(F.col("zone") == "footer", True)).alias("as_footer"))
    # only edge lines are compared and joined; the others stay where they are
    edge = lines.where(at_edge()).withColumn("form", T.edge_form(F.col("line"))).join(zone, [id_col, "form"], "left").drop("form")
    rest = lines.where(~at_edge()).withColumns({c: F.lit(None).cast("boolean") for c in ("as_header", "as_footer")})
    lined = edge.select(*rest.columns).unionByName(rest)
    head = F.col("as_header") & (F.col("line_no") <= EDGE)
    template = F.when(head, "header").when(F.col("as_footer"), "footer")
    return lined.withColumn("kind", line_kind(template)).drop("as_header", "as_footer")


def cleaned(classified: DataFrame, id_col: str) -> DataFrame:
    """(id, page_no, text): pages of the lines that stay, blanks compacted."""
    kept = classified.where("kind IS NULL").groupBy(id_col, "page_no").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    return kept.select(id_col, "page_no", T.compact_lines(F.array_join(F.col("ls.line"), "\n")).alias("text"))


REPORT = {"header": "headers_removed", "footer": "footers_removed", "page_number": "page_numbers_removed", "source": "source_lines_removed", "signature": "signatures_removed", "noise": "other_noise_removed"}


def cleaning_report(classified: DataFrame, id_col: str) -> DataFrame:
    """Counts of dropped lines by document and rule."""
    return classified.groupBy(id_col).agg(*(F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(v) for k, v in REPORT.items()))


def ocr_like(pages: DataFrame, id_col: str) -> DataFrame:
    """(id, odd_chars, short_lines, ocr_like) by the first three pages of a document."""
    first = pages.where("page_no <= 3")
    odd = F.regexp_count(F.lower("text"), F.lit(r"[^\w\sáéíóúñüÁÉÍÓÚÑÜ:/(),.\-]"))
    short = F.size(F.filter(F.split("text", "\n"), lambda x: F.length(T.strip(x)).between(1, 4)))
    return first.groupBy(id_col).agg(F.sum(odd).alias("odd_chars"), F.sum(short).alias("short_lines")).withColumn("ocr_like", (F.col("odd_chars") > 10) | (F.col("short_lines") > 10))
