"""Lookups of labels: prioritised, last-wins and semi-join forms, and rules over section status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from valora.functions import text as T
from valora.operators import export, lookups, prompts, scoring
from valora.queries import fragments as Q
from valora.sources.tables import table


def section_lookup(s: SparkSession, d: str) -> DataFrame:
    """The rubric section of every export row by id, else by title, in compared form."""
    rub = table(s, d, "rubric_questions").select("tipo_informe", "section_id", "section_title").distinct()
    e = table(s, d, "export_rows").select("row_id", "tipo_informe", F.col("section_id").alias("a"), F.col("section_title").alias("b"))
    return lookups.first_match(e, "row_id", ["a", "b"], rub.select("section_id", "section_title").distinct(), ["section_id", "section_title"], "section_id")


def criteria_fill(s: SparkSession, d: str) -> DataFrame:
    """Export rows with bounds and weights filled from the rubric where they are absent; of several
    entries of a question the last counts."""
    rub = table(s, d, "rubric_questions").select("question_id", "question_weight", "scale_min", "scale_max", F.concat_ws("/", "tipo_informe", "section_id", "dimension_name").alias("ord"))
    return lookups.fill_from(table(s, d, "export_rows").select("row_id", "question_id", "question_weight", "scale_min", "scale_max"), rub, "question_id", ["question_weight", "scale_min", "scale_max"], "ord")


def scored_sections(s: SparkSession, d: str) -> DataFrame:
    """Rubric sections that any export row has, the first title of each."""
    rub = table(s, d, "rubric_questions").select("section_id", "section_title").distinct()
    e = table(s, d, "export_rows").select(T.identifier(F.col("section_id")).alias("k")).distinct()
    hit = rub.join(e, T.identifier(F.col("section_id")) == F.col("k"), "left_semi")
    by = Window.partitionBy(T.identifier(F.col("section_id"))).orderBy("section_title")
    return hit.withColumn("rn", F.row_number().over(by)).where("rn = 1").select("section_id", "section_title")


def label_alias(s: SparkSession, d: str) -> DataFrame:
    """Report types in their canonical spelling by an alias table."""
    e = table(s, d, "export_rows").select("tipo_informe").distinct()
    return e.select("tipo_informe", lookups.canonical(F.col("tipo_informe"), {"institucional": ["institucional", "inst"], "pn": ["politica_nacional", "politica nacional", "pn"]}).alias("kind"))


def structure_scores(s: SparkSession, d: str) -> DataFrame:
    """Scores of structure questions from the section's status alone, without a scorer."""
    e = table(s, d, "export_rows").where(T.identifier(F.col("dimension_name")).startswith("estructura"))
    return e.select("row_id", scoring.auto_structure_score(T.identifier(F.coalesce("metadata_segmenter_status", F.lit("missing")))).alias("score"))


def builder_lookup(s: SparkSession, d: str) -> DataFrame:
    """The prompt builder of each report type: exact name, else by start, end or part."""
    e = table(s, d, "chunk_contexts").select("tipo_informe").distinct().where("tipo_informe IS NOT NULL")
    return e.select("tipo_informe", lookups.prioritised(F.col("tipo_informe"), {"institucional": "inst", "politica": "pol", "nacional": "nac", "politica_nacional": "pn"}, "general").alias("builder"))


def skipped_scores(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "export_rows")
    return e.select("row_id", scoring.skipped_score(T.identifier(F.col("metadata_segmenter_status")), F.col("question_score")).alias("score"))


def payload_faults(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "ai_responses")
    return a.select("response_id", F.array_join(scoring.payload_faults(F.col("score"), F.col("justification"), F.col("metadata")), ",").alias("faults"))


def previews(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", T.preview(F.col("text"), 300).alias("t"), prompts.spanish_smoke(F.col("text")).alias("language_ok"))


def enriched_scores(s: SparkSession, d: str) -> DataFrame:
    e = export.enriched(table(s, d, "export_rows").select("row_id", "section_score", "scale_min", "scale_max"), "section_score", "scale_min", "scale_max", 0.0, 4.0)
    return e.select("row_id", F.round("raw_score", 6).alias("raw_score"), F.round("normalized_score", 6).alias("normalized_score"))


QUERIES = {f.__name__: f for f in (section_lookup, criteria_fill, scored_sections, label_alias, structure_scores, builder_lookup, skipped_scores, payload_faults, previews, enriched_scores)}


def sql() -> dict[str, str]:
    i = Q.identifier
    return {
        "section_lookup": f"""WITH r AS (SELECT DISTINCT section_id, section_title FROM rubric_questions)
SELECT e.row_id, coalesce((SELECT min(r.section_id) FROM r WHERE {i('r.section_id')} = {i('e.section_id')}), (SELECT min(r.section_id) FROM r WHERE {i('r.section_title')} = {i('e.section_id')}),
 (SELECT min(r.section_id) FROM r WHERE {i('r.section_id')} = {i('e.section_title')}), (SELECT min(r.section_id) FROM r WHERE {i('r.section_title')} = {i('e.section_title')})) AS section_id FROM export_rows e""",
        "criteria_fill": f"""WITH r AS (SELECT {i('question_id')} AS k, arg_max(question_weight, concat_ws('/', tipo_informe, section_id, dimension_name)) AS w, arg_max(scale_min, concat_ws('/', tipo_informe, section_id, dimension_name)) AS lo,
 arg_max(scale_max, concat_ws('/', tipo_informe, section_id, dimension_name)) AS hi FROM rubric_questions GROUP BY 1)
SELECT row_id, question_id, coalesce(question_weight, w) AS question_weight, coalesce(scale_min, lo) AS scale_min, coalesce(scale_max, hi) AS scale_max FROM export_rows LEFT JOIN r ON k = {i('question_id')}""",
        "scored_sections": f"SELECT section_id, section_title FROM (SELECT *, row_number() OVER (PARTITION BY {i('section_id')} ORDER BY section_title) AS rn FROM (SELECT DISTINCT section_id, section_title FROM rubric_questions) WHERE {i('section_id')} IN (SELECT {i('section_id')} FROM export_rows WHERE section_id IS NOT NULL)) WHERE rn = 1",
        "label_alias": f"SELECT DISTINCT tipo_informe, CASE WHEN {i('tipo_informe')} IN ('institucional', 'inst') THEN 'institucional' WHEN {i('tipo_informe')} IN ('politica_nacional', 'politica nacional', 'pn') THEN 'pn' ELSE {i('tipo_informe')} END AS kind FROM export_rows",
        "builder_lookup": f"SELECT DISTINCT tipo_informe, CASE {i('tipo_informe')} WHEN 'institucional' THEN 'inst' WHEN 'politica_nacional' THEN 'pn' WHEN 'politica' THEN 'pol' ELSE 'general' END AS builder FROM chunk_contexts WHERE tipo_informe IS NOT NULL",
        "skipped_scores": f"SELECT row_id, CASE WHEN {i('metadata_segmenter_status')} IN ('empty', 'missing') THEN 0.0::DOUBLE ELSE question_score END AS score FROM export_rows",
        "payload_faults": "SELECT response_id, concat_ws(',', CASE WHEN score IS NULL OR isnan(score) THEN 'score' END, CASE WHEN justification IS NULL THEN 'justification' END, CASE WHEN metadata IS NULL OR NOT map_contains(metadata, 'model') THEN 'model' END, CASE WHEN metadata IS NULL OR NOT map_contains(metadata, 'provider') THEN 'provider' END, CASE WHEN metadata IS NULL OR NOT map_contains(metadata, 'duration_ms') THEN 'duration_ms' END) AS faults FROM ai_responses",
        "previews": "SELECT doc_id, CASE WHEN length(text) > 300 THEN rtrim(left(text, 300)) || '…' ELSE text END AS t, length(text) < 40 OR " + " OR ".join(f"contains(' ' || lower(text) || ' ', '{m}')" for m in prompts.MARKERS[:10]) + " AS language_ok FROM documents",
        "enriched_scores": f"SELECT row_id, {Q.r6('section_score')} AS raw_score, CASE WHEN section_score IS NOT NULL AND hi > lo THEN {Q.r6('least(greatest((section_score - lo) / (hi - lo), 0.0), 1.0)')} END AS normalized_score FROM (SELECT *, coalesce(scale_min, 0.0) AS lo, coalesce(scale_max, 4.0) AS hi FROM export_rows)",
        "structure_scores": f"SELECT row_id, CASE WHEN {i('''coalesce(metadata_segmenter_status, 'missing')''')} = 'found' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM export_rows WHERE {i('dimension_name')} LIKE 'estructura%'",
    }
