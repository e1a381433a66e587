"""Chunks of texts: stride windows, greedy line merging, and the fallback from sections to pages to text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valora.functions import text as T

SIZE, OVERLAP = 1500, 150


def check_size(size: int, overlap: int) -> None:
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("the size must be positive and the overlap less than it")


def stride_windows(c: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Windows of `size` characters, each starting size - overlap after the one before; none for an empty text.

    The text is cut once into blocks of a stride, and a window is its block and the next one's
    start, so the work is linear in the text (substring() counts code points from the start).
    """
    check_size(size, overlap)
    step = size - overlap
    if overlap > step:
        starts = F.sequence(F.lit(0), F.floor((F.length(c) - 1) / step).cast("int"))
        return F.when(F.length(c) > 0, F.transform(starts, lambda i: F.substring(c, i * step + 1, F.lit(size)))).when(c.isNotNull(), F.array().cast("array<string>"))
    blocks = F.regexp_extract_all(c, F.lit("(?s).{1,%d}" % step), 0)
    ahead = F.concat(F.slice(blocks, 2, 1 << 30), F.array(F.lit("")))
    windows = F.zip_with(blocks, ahead, lambda b, n: F.concat(b, F.left(F.coalesce(n, F.lit("")), F.lit(overlap))))
    return F.filter(windows, lambda w: w.isNotNull()) if overlap else blocks


def stride_chunks(df: DataFrame, id_col: str, text_col: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(id, chunk_index, chunks_in_source, chunk): chunk_index counts from 1."""
    w = stride_windows(F.col(text_col), size, overlap)
    return df.select(id_col, F.size(w).alias("chunks_in_source"), F.posexplode(w).alias("pos", "chunk")).select(id_col, (F.col("pos") + 1).alias("chunk_index"), "chunks_in_source", "chunk")


def merge_lines(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Lines merged greedily up to `size`; the next chunk repeats the last lines within `overlap`.

    A line longer than `size` stays whole. Blank chunks are dropped.
    """
    parts = [p for p in (x + "\n" for x in text.split("\n"))]
    if parts:
        parts[-1] = parts[-1][:-1]
    out: list[str] = []
    held: list[str] = []
    total = 0
    for p in parts:
        if held and total + len(p) > size:
            out.append("".join(held))
            while held and (total > overlap or total + len(p) > size):
                total -= len(held.pop(0))
        held.append(p)
        total += len(p)
    if held:
        out.append("".join(held))
    return [c for c in (x.strip() for x in out) if c]


def line_chunks(c: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """merge_lines() as a column of arrays (Arrow: greedy merging is sequential).

    Told to be nondeterministic, or an explode's filter would merge every text a second time.
    """
    check_size(size, overlap)
    return F.pandas_udf(lambda s: pd.Series([[] if x is None else merge_lines(x, size, overlap) for x in s], dtype=object), "array<string>").asNondeterministic()(c)


CHUNK_FIELDS = ["id", "source_id", "source_type", "strategy", "chunk_index", "chunks_in_source", "length", "chunk_overlap"]


def content_chunks(sources: DataFrame, id_col: str, source_type: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of rows (id, source_id, ord, text) with their metadata; blank sources give none."""
    t = F.regexp_replace("text", r"\r\n?", "\n")
    src = sources.where(F.length(T.strip(F.coalesce(F.col("text"), F.lit("")))) > 0).withColumn("cs", line_chunks(t, size, overlap))
    strategy = {"section": "section", "page": "page_fallback", "content": "content_fallback"}[source_type]
    rows = src.select(id_col, "source_id", "ord", F.size("cs").alias("chunks_in_source"), F.posexplode("cs").alias("pos", "chunk"))
    return rows.select(
        id_col,
        F.concat_ws("_", "source_id", (F.col("pos") + 1).cast("string")).alias("chunk_id"),
        "source_id",
        F.lit(source_type).alias("source_type"),
        F.lit(strategy).alias("strategy"),
        "ord",
        (F.col("pos") + 1).alias("chunk_index"),
        "chunks_in_source",
        F.length("chunk").alias("length"),
        F.lit(overlap).alias("chunk_overlap"),
        "chunk",
    )


def document_chunks(docs: DataFrame, id_col: str, sections: DataFrame, pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of every document's sections, else its pages, else its text.

    docs: (id, text, segmenter_missing); sections: (id, section_id, ord, text); pages: (id,
    page_no, text). Pages are not used where the segmenter found no section in a text that has some
    by its flag. Which source counts is decided on counts, before any text is cut.
    """
    filled = lambda df: df.where(F.length(T.strip(F.coalesce(F.col("text"), F.lit("")))) > 0)
    has_s = filled(sections).select(id_col).distinct().withColumn("has_s", F.lit(True))
    has_p = filled(pages).select(id_col).distinct().withColumn("has_p", F.lit(True))
    plan = docs.select(id_col, "segmenter_missing").join(has_s, id_col, "left").join(has_p, id_col, "left")
    use = F.when(F.col("has_s"), "section").when(F.col("has_p") & ~F.coalesce("segmenter_missing", F.lit(False)), "page").otherwise("content")
    plan = plan.select(id_col, use.alias("use"))
    pick = lambda df, what: df.join(plan.where(F.col("use") == what).select(id_col), id_col, "left_semi")
    s = content_chunks(pick(sections.select(id_col, F.col("section_id").alias("source_id"), "ord", "text"), "section"), id_col, "section", size, overlap)
    p = content_chunks(pick(pages.select(id_col, F.concat(F.lit("page_"), "page_no").alias("source_id"), F.col("page_no").alias("ord"), "text"), "page"), id_col, "page", size, overlap)
    c = content_chunks(pick(docs.select(id_col, F.lit("content").alias("source_id"), F.lit(1).alias("ord"), "text"), "content"), id_col, "content", size, overlap)
    return s.unionByName(p).unionByName(c)


def with_pseudo_chunk(docs: DataFrame, id_col: str, text_col: str, chunks: DataFrame) -> DataFrame:
    """chunks, and chunk 0 with the whole text for documents that have none."""
    none = docs.join(chunks.select(id_col).distinct(), id_col, "left_anti")
    zero = none.select(id_col, F.lit(0).alias("chunk_index"), F.lit(1).alias("chunks_in_source"), F.coalesce(F.col(text_col), F.lit("")).alias("chunk"))
    return chunks.select(id_col, "chunk_index", "chunks_in_source", "chunk").unionByName(zero)
