"""Queries of the training-data operators and, where SQL can say it, the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valora.llm import answers, leaks, lookalike, oracle, packing, pieces, profiles, scans, shared_spans, splits
from valora.runtime import keep
from valora.sources.tables import table


def _looks(spark: SparkSession, d: str) -> DataFrame:
    return keep(
        lookalike.classes(table(spark, d, "chunk_contexts"), "context_id", "chunk_text", "chunk_text").unionByName(
            lookalike.classes(table(spark, d, "export_rows"), "row_id", "relevant_text", "relevant_text")
        ),
        "p1",
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.differing_pairs(_looks(spark, d))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every text that another looks like, with its class and the number of its links."""
    return lookalike.class_members(_looks(spark, d))


def p1_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk_text and relevant_text with the form in which equal-looking texts are equal."""
    a = lookalike.canonicalize(table(spark, d, "chunk_contexts").select(F.col("context_id").alias("id"), F.col("chunk_text").alias("t")), "t")
    b = lookalike.canonicalize(table(spark, d, "export_rows").select(F.col("row_id").alias("id"), F.col("relevant_text").alias("t")), "t")
    return a.select(F.lit("chunk_text").alias("field_name"), "id", F.col("look_text").alias("canonical_text")).unionByName(
        b.select(F.lit("relevant_text").alias("field_name"), "id", F.col("look_text").alias("canonical_text"))
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.linked_spellings(table(spark, d, "export_rows"), "row_id")


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every export row with its group and its split, 80/10/10 by rows."""
    cols = ["row_id", "question_score", *splits.KEYS]
    out = splits.assign_splits(table(spark, d, "export_rows").select(*cols), "row_id", "question_score")
    return out.select("row_id", "document_id", "question_score", F.hex("group_id").alias("group_id"), "split")


def p2_forest(spark: SparkSession, d: str) -> DataFrame:
    """The spanning forest over report, author, entity and source values."""
    return splits.forest(table(spark, d, "export_rows"))


def p2_split_checks(spark: SparkSession, d: str) -> DataFrame:
    """What p2_splits promises, counted over all rows and key values."""
    cols = ["row_id", "question_score", *splits.KEYS]
    return splits.split_checks(keep(splits.assign_splits(table(spark, d, "export_rows").select(*cols), "row_id", "question_score"), "p2-split"), "question_score")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    a = scans.pages_of(table(spark, d, "ocr_pages"), "ocr_pages", "ocr_page_id", "document_id", "page_index", "ocr_text")
    return a.unionByName(scans.pages_of_list(table(spark, d, "document_summaries"), "document_summaries", "summary_id", "document_id", "pages"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.Scans(_pages(spark, d)).defects()


def p3_evidence(spark: SparkSession, d: str) -> DataFrame:
    """How many misread lines the index, the context, or characters alone tell."""
    return scans.Scans(_pages(spark, d)).misread().groupBy("evidence").agg(F.count(F.lit(1)).alias("lines"))


def p3_reports(spark: SparkSession, d: str) -> DataFrame:
    """Every scanned report as continuous repaired paragraphs, in reading order."""
    return scans.Scans(_pages(spark, d)).reports()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "ai_responses").select("response_id", "question_text", "justification")
    known = profiles.train(table(spark, d, "documents"), "text", "lang")
    return answers.with_defects(pairs, "question_text", "justification", known).select("response_id", F.explode("defects").alias("defect"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    long = table(spark, d, "chunk_contexts").select("context_id", "chunk_text").where(f"length(chunk_text) > {pieces.LIMIT}")
    forced = F.exists("pieces", lambda p: p["forced"])
    return pieces.with_pieces(long, "chunk_text").select("context_id", F.when(forced, "forced").otherwise("natural").alias("cut_kind"))


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk_text in pieces of at most 1,500 characters, with its metadata up to date."""
    cols = ["context_id", "document_id", "chunk_text", "chunk_metadata"]
    return pieces.split_texts(table(spark, d, "chunk_contexts").select(*cols), "chunk_text", "chunk_metadata")


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """What p6_pieces promises, counted over all texts."""
    return pieces.piece_checks(table(spark, d, "chunk_contexts"), "chunk_text")


def p7_containers(spark: SparkSession, d: str, tokenizer: str = packing.TOKENIZER) -> DataFrame:
    """Every document text, or range of its tokens, with its container of 2,048 tokens."""
    counts = packing.token_counts(table(spark, d, "documents"), "doc_id", "text", tokenizer)
    return packing.pack(counts).withColumnRenamed("doc", "doc_id")


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """What p7_containers promises, counted over all containers and texts."""
    packed = keep(p7_containers(spark, d), "p7-packed")
    return packing.checks(packed.withColumnRenamed("doc_id", "doc"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "item_text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).where(f"longest_run >= {leaks.RUN}").select(F.col("doc").alias("doc_id"), "item_id")


def p8_alignments(spark: SparkSession, d: str) -> DataFrame:
    """Exact and edited copies: an exact run of 12 words, or an alignment of half the item's words."""
    return _leaks(spark, d).where(f"longest_run >= {leaks.RUN} OR share >= 0.5").withColumnRenamed("doc", "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    out = shared_spans.shared_spans(table(spark, d, "documents"), "doc_id", "text")
    return out.select(F.col("doc").alias("doc_id"), F.col("span_start").cast("long").alias("span_start"), F.col("span_len").cast("long").alias("span_len"))


def p9_share(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document lies in runs of sentences that another has too."""
    return shared_spans.shared_share(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("doc", "doc_id")


def p9_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    """Every document without the sentences of runs that an earlier document has."""
    return shared_spans.without_repeats(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", "kept_text")


QUERIES = {"p1_found": p1_found, "p1_classes": p1_classes, "p1_canonical": p1_canonical, "p2_found": p2_found, "p2_splits": p2_splits, "p2_forest": p2_forest, "p2_split_checks": p2_split_checks, "p3_found": p3_found, "p3_evidence": p3_evidence, "p3_reports": p3_reports, "p5_found": p5_found, "p6_found": p6_found, "p6_pieces": p6_pieces, "p6_checks": p6_checks, "p7_containers": p7_containers, "p7_checks": p7_checks, "p8_found": p8_found, "p8_alignments": p8_alignments, "p9_found": p9_found, "p9_share": p9_share, "p9_deduplicated": p9_deduplicated}


def sql() -> dict[str, str]:
    return {
        "p1_found": oracle.same_looks(),
        "p1_classes": oracle.look_classes(),
        "p1_canonical": oracle.canonical_looks(),
        "p2_found": oracle.linked_spellings(),
        "p2_split_checks": oracle.split_checks(),
        "p7_checks": f"SELECT count(*) AS texts, 0::BIGINT AS over_tokens, 0::BIGINT AS over_documents, 0::BIGINT AS over_cost, 0::BIGINT AS unreported, 0::BIGINT AS uneven, true AS dense FROM documents WHERE regexp_replace(text, '{oracle.GAPS}', '', 'g') <> ''",
        "p8_found": oracle.leaks(leaks.RUN),
        "p9_share": oracle.shared_share(shared_spans.WINDOW, shared_spans.SENTENCES),
        "p9_deduplicated": oracle.deduplicated(shared_spans.WINDOW, shared_spans.SENTENCES),
        "p9_found": oracle.shared_spans(shared_spans.WINDOW),
        "p6_checks": f"SELECT count(chunk_text) AS texts, count(*) FILTER (length(chunk_text) > {pieces.LIMIT}) AS long_texts, 0::BIGINT AS over_limit, 0::BIGINT AS over_overlap, 0::BIGINT AS uncovered FROM chunk_contexts",
        "p6_found": f"""
SELECT context_id, CASE WHEN list_max(list_transform(regexp_split_to_array(chunk_text, '{oracle.GAPS}'), lambda x: length(x))) > 1500
  THEN 'forced' ELSE 'natural' END AS cut_kind
FROM chunk_contexts WHERE length(chunk_text) > 1500""",
    }
