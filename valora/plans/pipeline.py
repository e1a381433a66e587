"""The whole evaluation as declarative plans: documents or chunks to one normalised score each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valora.functions import scales as S
from valora.functions import text as T
from valora.operators import chunks, prompts, rollup, scoring
from valora.runtime import small_side


def _array(xs: tuple[float, ...]) -> Column:
    return F.array(*(F.lit(x) for x in xs))


def levels_of(report_type: Column, dimension: Column) -> Column:
    """The levels that a scorer chooses from, by report type and dimension."""
    return F.when(report_type.isin(*S.POLICY_TYPES), _array(S.POLICY_LEVELS)).when(T.identifier(dimension) == "estructura", _array(S.STRUCTURE_LEVELS)).otherwise(_array(S.INSTITUTIONAL_LEVELS))


def _top(report_type: Column, inside: bool) -> Column:
    return F.when(report_type.isin(*S.POLICY_TYPES), 2.0 if inside else 20.0).otherwise(4.0 if inside else 100.0)


def evaluate(documents: DataFrame, rubric: DataFrame) -> DataFrame:
    """(doc_id, tipo_informe, document_score, index, questions) by the deterministic scorer.

    documents: (doc_id, tipo_informe, section_id, text); rubric: flat questions. Chunks meet the
    questions of their report type and section (or all of the type, where either states none);
    chunk scores give question scores, these roll up by weights. Texts are cut and hashed where they
    are read; only digests meet the questions and only scores are shuffled.
    """
    cut = chunks.stride_chunks(documents.withColumn("key", F.struct("doc_id", "tipo_informe", "section_id")), "key", "text")
    cut = cut.select("key.doc_id", "key.tipo_informe", F.col("key.section_id").alias("c_section"), F.sha2("chunk", 256).alias("digest"))
    pairs = scoring.question_chunk_pairs(rubric, cut, "section_id", "c_section", ["tipo_informe"])
    raw = S.mock_score(F.concat_ws("|", "question_id", "digest"), levels_of(F.col("tipo_informe"), F.lit("")))
    keys = ["doc_id", "tipo_informe", "section_id", "section_weight", "dimension_name", "dimension_weight", "question_id", "question_weight"]
    questions = pairs.select(*keys, raw.alias("score")).groupBy(*keys).agg(F.avg("score").alias("question_score"))
    key = ["doc_id", "tipo_informe"]
    docs = rollup.rollup(questions, key)["documents"]
    n = questions.groupBy(*key).agg(F.count(F.lit(1)).alias("questions"))
    kind = F.col("tipo_informe")
    return docs.join(n, key).select(*key, "document_score", S.normalised(F.col("document_score"), F.lit(0.0), _top(kind, True), F.lit(0.0), _top(kind, False)).alias("index"), "questions")


def question_results(chunk_rows: DataFrame, rubric: DataFrame) -> DataFrame:
    """One row per report and question of its type's rubric, with status, score and how it came about.

    chunk_rows: (document_id, tipo_informe, section_id, chunk_text, weight, was_truncated, failed).
    A section is `found` if the report has a chunk with text in it, `empty` if all are blank, else
    `missing`. Chunks meet the questions of their section, or of all if they state none; a pair's
    prompt must pass the quality gate to be scored, a failed pair counts as imputed; a score is
    moved onto its type's scale for the pair and again for the question. Structure questions take
    their score from the section's presence, questions of empty or missing sections are 0. Reports
    in block form have no dimensions.
    """
    c = chunk_rows.where("document_id IS NOT NULL AND tipo_informe IS NOT NULL").withColumn("filled", F.length(T.strip(F.coalesce(F.col("chunk_text"), F.lit("")))) > 0)
    form = F.coalesce(T.identifier(F.col("section_id")), F.lit(""))
    rep = ["document_id", "tipo_informe"]
    status = c.where(form != "").groupBy(*rep, form.alias("section_form")).agg(F.max("filled").alias("some"))
    q = rubric.withColumn("section_form", form)
    asked = q.select("tipo_informe", "question_id", F.col("section_id").alias("q_section"), "section_title", "dimension_name", "question_text", "scale_min", "scale_max")
    p = scoring.question_chunk_pairs(asked, c.where("filled").withColumnRenamed("section_id", "c_section"), "q_section", "c_section", ["tipo_informe"])
    prompt = prompts.build(F.col("question_text"), F.col("section_title"), F.col("dimension_name"), F.col("scale_min"), F.col("scale_max"), F.col("chunk_text"), F.col("tipo_informe"))
    p = p.withColumn("prompt", prompt)
    quality = prompts.native_quality(F.col("prompt"), F.lit("Escala de valoración"), F.array("scale_min", "scale_max"), F.col("was_truncated"))
    passes = (quality >= prompts.threshold(F.col("prompt"))) & (quality >= prompts.GATE)
    kind, dim = F.col("tipo_informe"), F.col("dimension_name")
    raw = S.mock_score(F.concat_ws("|", "question_id", F.sha2("chunk_text", 256)), levels_of(kind, dim))
    score = F.when(passes, scoring.imputed(S.constrained(raw, kind, dim), F.col("failed"), F.when(F.col("failed"), F.lit("failed"))))
    one = p.select(*rep, "question_id", "dimension_name", score.alias("score"), "weight", (~passes).alias("rejected"))
    per = one.groupBy(*rep, "question_id").agg(
        S.weighted_mean(F.col("score"), F.col("weight")).alias("mean"), F.count(F.lit(1)).alias("pairs"), F.count_if("rejected").alias("rejected")
    )
    parts = F.pmod(F.xxhash64("document_id"), F.lit(scoring.PARTS)).cast("int")
    reports = c.select(*rep).distinct().withColumn("_p", parts)
    every = reports.join(small_side(q.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(scoring.PARTS - 1))))), ["tipo_informe", "_p"]).drop("_p")
    j = every.join(per, [*rep, "question_id"], "left").join(status, [*rep, "section_form"], "left")
    state = F.when((F.col("section_form") == "") | F.col("some"), "found").when(~F.col("some"), "empty").otherwise("missing")
    auto = scoring.auto_scored(kind, dim, F.col("section_id"), F.col("section_title"))
    final = F.when(auto, scoring.auto_structure_score(state)).when(state != "found", 0.0).otherwise(S.constrained(F.col("mean"), kind, dim))
    how = F.when(auto, "presence").when(state != "found", "skipped").when(F.col("mean").isNotNull(), "scored").otherwise("without score")
    blocks = kind.isin(*S.POLICY_TYPES)
    return j.select(
        *rep, "section_id", "section_title", "section_weight", F.when(~blocks, dim).alias("dimension_name"), F.when(blocks, 1.0).otherwise(F.col("dimension_weight")).alias("dimension_weight"),
        "question_id", "question_weight", state.alias("status"), final.alias("question_score"), how.alias("how"), F.coalesce("pairs", F.lit(0)).alias("pairs"), F.coalesce("rejected", F.lit(0)).alias("rejected"),
    )


def evaluate_reports(results: DataFrame) -> DataFrame:
    """(document_id, report_type, raw_index, index, sections, sections_scored, questions, scored, presence,
    skipped, pairs, rejected) of question_results()."""
    key = ["document_id", "tipo_informe"]
    m = rollup.metrics(results, key, "tipo_informe")
    n = lambda how: F.count_if(F.col("how") == how)
    counts = results.groupBy(*key).agg(F.count(F.lit(1)).alias("questions"), n("scored").alias("scored"), n("presence").alias("presence"), n("skipped").alias("skipped"), F.sum("pairs").alias("pairs"), F.sum("rejected").alias("rejected"))
    return m.join(counts, key).drop("tipo_informe")
