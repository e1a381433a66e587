"""Pairs, scores, rollups, indices and prompt rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valora.functions import scales as S
from valora.functions import text as T
from valora.operators import prompts, rollup, scoring
from valora.plans import pipeline
from valora.queries import fragments as Q
from valora.runtime import spread
from valora.sources.tables import table

IMPUTED = [("i1", 0.5, True, "timeout"), ("i2", 0.5, True, None), ("i3", 0.5, None, "timeout"), ("i4", None, True, "quota"), ("i5", 2.0, False, None)]
PAYLOADS = [("a", '{"score": 2, "justification": "bien"}'), ("b", "texto libre"), ("c", '{"score": "1,5", "relevant_text": "cita"}'), ("d", '{"justification": "sin puntaje"}')]
LEVELS = [("x", ["0", "1", "2"]), ("y", ["0", "0,5", "1"]), ("z", ["1", "3", "4"]), ("w", ["no", "2"])]


def _rubric(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "rubric_questions")


def _r(c: str):
    return F.round(c, 6).alias(c)


def doc_score_flagship(s: SparkSession, d: str) -> DataFrame:
    """Every document that has a text, scored by the rubric of its report type (institutional where none is stated)."""
    docs = table(s, d, "documents").where("length(text) > 0").select("doc_id", F.coalesce("tipo_informe", F.lit("institucional")).alias("tipo_informe"), "section_id", "text")
    return pipeline.evaluate(spread(docs), _rubric(s, d)).select("doc_id", "tipo_informe", _r("document_score"), _r("index"), "questions")


def _results(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "chunk_contexts")
    meta = F.col("chunk_metadata")
    rows = c.select("document_id", "tipo_informe", "section_id", "chunk_text", meta["relevance"].alias("weight"), meta["was_truncated"].alias("was_truncated"), meta.isNull().alias("failed"))
    return pipeline.question_results(spread(rows), _rubric(s, d))


def evaluation_full(s: SparkSession, d: str) -> DataFrame:
    """Every report through status, gate, scoring, imputation, skips and roll-up to its type's index."""
    out = pipeline.evaluate_reports(_results(s, d))
    return out.select("document_id", "report_type", _r("raw_index"), _r("index"), "sections", "sections_scored", "questions", "scored", "presence", "skipped", "pairs", "rejected")


def evaluation_questions(s: SparkSession, d: str) -> DataFrame:
    """The questions of every report with status, score and how it came about."""
    return _results(s, d).select("document_id", "tipo_informe", "section_id", "question_id", "status", _r("question_score"), "how", "pairs", "rejected")


def metrics_dispatch(s: SparkSession, d: str) -> DataFrame:
    """Indices of all reports by their type, with the fallbacks."""
    out = rollup.metrics(table(s, d, "export_rows"), ["document_id"], "tipo_informe")
    return out.select("document_id", "report_type", _r("raw_index"), _r("index"), "sections", "sections_scored")


def theta_pairs(s: SparkSession, d: str) -> DataFrame:
    q = _rubric(s, d).select("question_id", F.col("section_id").alias("q_section"))
    c = table(s, d, "chunk_contexts").select("context_id", F.col("section_id").alias("c_section"))
    return scoring.question_chunk_pairs(q, c, "q_section", "c_section").groupBy("context_id").agg(F.count(F.lit(1)).alias("pairs"), F.min("question_id").alias("first_question"), F.max("question_id").alias("last_question"))


def cross_flagged(s: SparkSession, d: str) -> DataFrame:
    q = _rubric(s, d).select("question_id", F.col("section_id").alias("q_section"))
    c = table(s, d, "chunk_contexts").select("context_id", F.col("section_id").alias("c_section"))
    p = scoring.flagged_pairs(q, c, "q_section", "c_section")
    return p.groupBy("context_id", "global_context").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("section_mismatch").cast("int")).alias("mismatches"))


def score_constraint(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "export_rows").where("question_score IS NOT NULL")
    c = S.constrained_flag(F.col("question_score") * 1.25 - 0.25, F.col("tipo_informe"), F.col("dimension_name"))
    return e.select("row_id", c["score"].alias("score"), c["adjusted"].alias("adjusted"))


def scale_shapes(s: SparkSession, d: str) -> DataFrame:
    """Bounds and step of the levels that every rubric question's scale spans, and of the literal lists."""
    text = lambda c: c.cast("string")
    lo, hi = F.col("scale_min"), F.col("scale_max")
    t = _rubric(s, d).select(F.col("question_id").alias("id"), F.array(text(lo), text((lo + hi) / 2), text(hi)).alias("levels"))
    t = t.unionByName(s.createDataFrame(LEVELS, "id string, levels array<string>"))
    nums = F.array_compact(F.transform("levels", lambda x: S.number(x)))
    return t.select("id", S.scale_bounds(F.col("levels"))["lo"].alias("lo"), S.scale_bounds(F.col("levels"))["hi"].alias("hi"), S.constant_step(nums).alias("step"))


def _scored(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "chunk_contexts").where("question_id IS NOT NULL AND chunk_text IS NOT NULL")
    score = S.mock_score(F.col("chunk_text"), F.array(*(F.lit(x) for x in S.INSTITUTIONAL_LEVELS)))
    return c.select("context_id", "question_id", score.alias("score"), F.col("chunk_metadata.relevance").alias("weight"))


def mock_scores(s: SparkSession, d: str) -> DataFrame:
    return _scored(s, d).select("context_id", "score")


def chunk_question_scores(s: SparkSession, d: str) -> DataFrame:
    return scoring.question_scores(_scored(s, d), ["question_id"]).select("question_id", _r("score"), "scored", "chunks")


def best_chunk(s: SparkSession, d: str) -> DataFrame:
    return scoring.best_by(_scored(s, d), ["question_id"], "score", "context_id").select("question_id", "context_id", "score")


def imputed_scores(s: SparkSession, d: str) -> DataFrame:
    """Scores of all answers, 1 where they were retried and did not end well, and of the literals."""
    m = F.col("metadata")
    a = table(s, d, "ai_responses").select(F.col("response_id").cast("string").alias("id"), "score", (m["retries"].try_cast("int") > 0).alias("flag"), F.nullif(m["finish_reason"], F.lit("stop")).alias("error"))
    t = a.unionByName(s.createDataFrame(IMPUTED, "id string, score double, flag boolean, error string"))
    return t.select("id", scoring.imputed(F.col("score"), F.col("flag"), F.col("error")).alias("score"))


def response_fields(s: SparkSession, d: str) -> DataFrame:
    """The fields of all answers read back from payloads, text alone where they state no score, and of the literals."""
    a = table(s, d, "ai_responses")
    js = F.to_json(F.struct(F.when(~F.isnan("score"), F.col("score")).alias("score"), "justification", "relevant_text"))
    a = a.select(F.col("response_id").cast("string").alias("id"), F.when(F.col("score").isNull(), F.coalesce("justification", F.lit("{}"))).otherwise(js).alias("p"))
    t = a.where(~F.col("p").rlike(r"^\s*\{") | F.col("p").startswith("{")).unionByName(s.createDataFrame(PAYLOADS, "id string, p string"))
    return t.select("id", scoring.response_fields(F.col("p")).alias("r")).select("id", "r.*")


def _rolled(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return rollup.rollup(table(s, d, "export_rows"), ["document_id"])


def rollup_dimensions(s: SparkSession, d: str) -> DataFrame:
    return _rolled(s, d)["dimensions"].select("document_id", "section_id", "dimension_name", _r("dimension_score"))


def rollup_sections(s: SparkSession, d: str) -> DataFrame:
    return _rolled(s, d)["sections"].select("document_id", "section_id", _r("section_score"))


def rollup_documents(s: SparkSession, d: str) -> DataFrame:
    return _rolled(s, d)["documents"].select("document_id", _r("document_score"), "sections_scored", "sections")


def _inst(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "export_rows").where("tipo_informe = 'institucional'")


def criterion_breakdown(s: SparkSession, d: str) -> DataFrame:
    return rollup.criterion_breakdown(_inst(s, d), ["document_id"]).select("document_id", "criterion", "questions", "scored", _r("score_sum"), _r("max_sum"), _r("ratio"))


def index_institutional(s: SparkSession, d: str) -> DataFrame:
    return rollup.institutional_index(rollup.criterion_breakdown(_inst(s, d), ["document_id"]), ["document_id"]).select("document_id", _r("raw_index"), _r("index"))


def index_policy(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "export_rows").where("tipo_informe = 'politica_nacional'")
    return rollup.policy_index(rollup.rollup(e, ["document_id"])["documents"]).select("document_id", _r("document_score"), _r("index"))


def section_totals(s: SparkSession, d: str) -> DataFrame:
    return rollup.section_totals(_rolled(s, d)["sections"], ["document_id"])


def section_bounds(s: SparkSession, d: str) -> DataFrame:
    return rollup.section_bounds(table(s, d, "export_rows"), ["document_id", "section_id"])


def section_metrics(s: SparkSession, d: str) -> DataFrame:
    """Every report's section scores with their scale and their share of it."""
    key = ["document_id", "section_id"]
    out = rollup.section_metrics(_rolled(s, d)["sections"], rollup.section_bounds(table(s, d, "export_rows"), key), key)
    return out.select(*key, _r("section_score"), "scale_min", "scale_max", _r("share"))


def best_justification(s: SparkSession, d: str) -> DataFrame:
    return rollup.best_justification(table(s, d, "export_rows"), ["document_id", "section_id"], "row_id")


def quality_summary(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "ai_responses").select(F.split("question_id", "_")[0].alias("section"), (F.col("score") / 4).alias("q"), F.col("metadata").getItem("duration_ms").try_cast("double").alias("l"))
    out = rollup.quality_summary(a, "section", "q", "l", F.coalesce(F.col("q") >= 0.25, F.lit(False)))
    return out.select("section", "prompts", "rejected", _r("mean_quality"), _r("mean_latency"), _r("deviation_latency"))


# ---- prompts ----------------------------------------------------------------------------------


def _prompts(s: SparkSession, d: str) -> DataFrame:
    c = spread(table(s, d, "chunk_contexts").select("context_id", "question_id", "chunk_text", "chunk_metadata.was_truncated"))
    q = _rubric(s, d).drop("section_id")
    j = c.join(q, "question_id", "left")
    p = prompts.build(F.col("question_text"), F.col("section_title"), F.col("dimension_name"), F.col("scale_min"), F.col("scale_max"), F.coalesce("chunk_text", F.lit("")), F.col("tipo_informe"))
    return j.select("context_id", p.alias("prompt"), "was_truncated", F.array(F.coalesce("scale_min", F.lit(0.0)), F.coalesce("scale_max", F.lit(4.0))).alias("levels"), "chunk_text", "question_text", "dimension_name")


def prompt_build(s: SparkSession, d: str) -> DataFrame:
    return _prompts(s, d).select("context_id", F.md5("prompt").alias("digest"), F.length("prompt").alias("chars"))


def prompt_rules(s: SparkSession, d: str) -> DataFrame:
    p = F.col("prompt")
    return _prompts(s, d).select(
        "context_id",
        prompts.length_ok(p).alias("length_ok"),
        prompts.delimiters_ok(p).alias("delimiters_ok"),
        prompts.scale_ok(p, F.lit("Escala de valoración"), F.col("levels")).alias("scale_ok"),
        F.round(prompts.spanish_evidence(p), 6).alias("evidence"),
        prompts.language_ok(p).alias("language_ok"),
        prompts.truncation_faults(p, F.col("was_truncated")).alias("truncation_faults"),
        F.round(prompts.methodology_coverage(p), 6).alias("coverage"),
    )


def _quality(s: SparkSession, d: str) -> DataFrame:
    return _prompts(s, d).withColumn("quality", prompts.native_quality(F.col("prompt"), F.lit("Escala de valoración"), F.col("levels"), F.col("was_truncated")))


def prompt_quality(s: SparkSession, d: str) -> DataFrame:
    return _quality(s, d).select("context_id", "quality", prompts.band(F.col("quality")).alias("band"), prompts.threshold(F.col("prompt")).alias("threshold"))


def prompt_gate(s: SparkSession, d: str) -> DataFrame:
    return prompts.gated(_quality(s, d), "quality", "prompt").select("context_id")


def prompt_json_block(s: SparkSession, d: str) -> DataFrame:
    return _prompts(s, d).select("context_id", prompts.json_block_ok("prompt").alias("json_ok"))


def prompt_metadata(s: SparkSession, d: str) -> DataFrame:
    """What is known of every prompt when it is built."""
    m = prompts.quality_metadata(F.col("prompt"), F.coalesce("chunk_text", F.lit("")), F.col("was_truncated"))
    return _prompts(s, d).select("context_id", m.alias("m")).select("context_id", "m.*")


def prompt_context(s: SparkSession, d: str) -> DataFrame:
    p = _prompts(s, d)
    flags = prompts.context_flags(F.col("chunk_text"), F.col("question_text"), F.col("dimension_name"), F.lit("2024.1"), F.lit("x"))
    return p.select("context_id", F.array_join(flags, ",").alias("flags"))


QUERIES = {
    f.__name__: f
    for f in (
        doc_score_flagship, evaluation_full, evaluation_questions, metrics_dispatch, theta_pairs, cross_flagged, score_constraint, scale_shapes, mock_scores, chunk_question_scores, best_chunk, imputed_scores, response_fields,
        rollup_dimensions, rollup_sections, rollup_documents, criterion_breakdown, index_institutional, index_policy, section_totals, section_bounds, section_metrics, best_justification, quality_summary,
        prompt_build, prompt_rules, prompt_quality, prompt_gate, prompt_json_block, prompt_metadata, prompt_context,
    )
}


def sql() -> dict[str, str]:
    key = lambda x: f"coalesce({Q.identifier(x)}, '')"
    inst, struct = S.INSTITUTIONAL_LEVELS, S.STRUCTURE_LEVELS
    theta = f"FROM rubric_questions q JOIN chunk_contexts c ON {key('q.section_id')} = '' OR {key('c.section_id')} = '' OR {key('q.section_id')} = {key('c.section_id')}"
    roll = f"""dim AS (SELECT document_id, section_id, dimension_name, {Q.weighted('question_score', 'coalesce(question_weight, 1.0)')} AS dimension_score, max(dimension_weight) AS dimension_weight, max(section_weight) AS section_weight
  FROM e GROUP BY ALL),
sec AS (SELECT document_id, section_id, {Q.weighted('dimension_score', 'coalesce(dimension_weight, 1.0)')} AS section_score, max(section_weight) AS section_weight FROM dim GROUP BY ALL),
doc AS (SELECT document_id, {Q.weighted('section_score', 'coalesce(section_weight, 1.0)')} AS document_score, count(section_score) AS sections_scored, count(*) AS sections FROM sec GROUP BY ALL)"""
    roll = roll.replace("FROM e GROUP BY ALL", "FROM e GROUP BY document_id, section_id, dimension_name").replace("FROM dim GROUP BY ALL", "FROM dim GROUP BY document_id, section_id").replace("FROM sec GROUP BY ALL", "FROM sec GROUP BY document_id")
    every = "e AS (SELECT * FROM export_rows)"
    n = Q.identifier("dimension_name")
    crit = f"""b0 AS (SELECT document_id, question_score, CASE WHEN {n} LIKE 'estructura%' THEN 'estructura' WHEN {n} LIKE '%claridad%' AND {n} LIKE '%coherencia%' THEN 'claridad y coherencia' WHEN {n} LIKE 'pertinencia%' THEN 'pertinencia' ELSE {n} END AS criterion
  FROM export_rows WHERE tipo_informe = 'institucional' AND coalesce(section_weight, 1.0) > 0 AND coalesce(dimension_weight, 1.0) > 0 AND dimension_name IS NOT NULL),
b1 AS (SELECT *, CASE WHEN criterion = 'estructura' THEN 1.0::DOUBLE ELSE 4.0::DOUBLE END AS top FROM b0),
b2 AS (SELECT document_id, criterion, count(*) AS questions, count(question_score) AS scored, sum(CASE WHEN question_score IS NOT NULL THEN {Q.clamp('question_score', '0.0::DOUBLE', 'top')} END) AS score_sum,
  sum(CASE WHEN question_score IS NOT NULL THEN top END) AS max_sum FROM b1 GROUP BY document_id, criterion),
br AS (SELECT *, score_sum / nullif(max_sum, 0) AS ratio FROM b2)"""
    w = "CASE criterion " + " ".join(f"WHEN '{k}' THEN {v[0]}::DOUBLE" for k, v in rollup.CRITERIA.items()) + " END"
    scored = f"sc AS (SELECT context_id, question_id, {Q.mock_score('chunk_text', inst)} AS score, chunk_metadata.relevance AS weight FROM chunk_contexts WHERE question_id IS NOT NULL AND chunk_text IS NOT NULL)"
    sep = "chr(10) || '[texto truncado]' || chr(10)"
    room = 12000 - 18
    safe = Q.strip(f"translate(translate(coalesce(chunk_text, ''), chr(160) || '“”‘’«»', ' \"\"' || chr(39) || chr(39) || '\"\"'), '{T.ZERO_WIDTH}', '')")
    frag = f"CASE WHEN length(f) > 12000 THEN rtrim(substr(f, 1, {int(room * 0.85)})) || {sep} || ltrim(right(f, {room - int(room * 0.85)})) ELSE f END"
    prompt = f"""j AS (SELECT c.context_id, c.chunk_text, c.chunk_metadata.was_truncated AS was_truncated, q.question_text, q.section_title, q.dimension_name, q.scale_min, q.scale_max, q.tipo_informe, {safe} AS f
  FROM chunk_contexts c LEFT JOIN rubric_questions q ON q.question_id = c.question_id),
pr AS (SELECT *, concat_ws(chr(10), 'Rol asignado: evaluador de informes de tipo ' || coalesce(tipo_informe, 'general') || '.', 'Objetivo: valorar la sección «' || coalesce(section_title, '-') || '», dimensión «' || coalesce(dimension_name, '-') || '».',
  'Pregunta: ' || coalesce(question_text, ''), 'Escala de valoración: de ' || printf('%.1f', coalesce(scale_min, 0.0)) || ' a ' || printf('%.1f', coalesce(scale_max, 4.0)) || '.', 'Instrucciones de respuesta: responde solo con lo que el fragmento sustenta.',
  'Formato de salida: {{"score": <número>, "justification": "<texto>", "relevant_text": "<cita>"}}', '{prompts.START}', {frag}, '{prompts.END}') AS prompt FROM j)"""
    markers = " + ".join(f"(contains(pad, '{m}'))::INT" for m in prompts.MARKERS)
    common = ", ".join(f"'{x}'" for x in prompts.COMMON)
    cover = " + ".join("(" + " OR ".join(f"contains(low, '{a}')" for a in names) + ")::INT" for names in prompts.METHODOLOGY.values())
    rules = f"""{prompt},
l0 AS (SELECT *, lower(prompt) AS low, ' ' || lower(prompt) || ' ' AS pad, regexp_extract_all(lower(prompt), '[a-záéíóúüñ]+') AS ws, length(regexp_replace(prompt, '[^\\p{{L}}]', '', 'g')) AS letters,
  (length(lower(prompt)) - length(replace(lower(prompt), '{prompts.TRUNCATED}', ''))) // {len(prompts.TRUNCATED)} AS tn,
  substr(prompt, strpos(lower(prompt), 'escala de valoración'), 500) AS part FROM pr),
l1 AS (SELECT *, greatest(({markers}) / 12.0::DOUBLE, len(list_filter(ws, lambda x: x IN ({common}))) / greatest(len(ws), 1)::DOUBLE) * 0.7 + (CASE WHEN letters > 0 THEN len(regexp_extract_all(low, '[áéíóúüñ]')) / letters::DOUBLE ELSE 0 END) * 0.3 AS evidence,
  ({cover}) / 5.0::DOUBLE AS coverage, length(regexp_replace(split_part(regexp_replace(low, '(?s)^.*?\\[texto truncado\\]', ''), lower('{prompts.END}'), 1), '[^\\p{{L}}]', '', 'g')) AS after,
  list_transform(regexp_extract_all(part, '-?\\d+(?:[.,]\\d+)?'), lambda x: replace(x, ',', '.')::DOUBLE) AS nums FROM l0),
ru AS (SELECT context_id, prompt, length(prompt) BETWEEN 400 AND 14000 AS length_ok, contains(low, lower('{prompts.START}')) AND contains(low, lower('{prompts.END}')) AS delimiters_ok,
  contains(low, 'escala de valoración') AND list_contains(nums, coalesce(scale_min, 0.0)) AND list_contains(nums, coalesce(scale_max, 4.0)) AS scale_ok, evidence, length({Q.strip('prompt')}) < 80 OR evidence >= CASE WHEN length({Q.strip('prompt')}) < 250 THEN 0.22 ELSE 0.28 END AS language_ok,
  CASE WHEN coalesce(was_truncated, false) AND tn = 0 THEN 1 WHEN NOT coalesce(was_truncated, false) AND tn > 0 THEN 1 WHEN tn > 0 THEN (tn > 1)::INT + (after > 40)::INT ELSE 0 END AS truncation_faults, coverage FROM l1),
qu AS (SELECT *, round(greatest(1 - ((CASE WHEN NOT length_ok THEN 0.2::DOUBLE ELSE 0 END) + (CASE WHEN NOT delimiters_ok THEN 0.15::DOUBLE ELSE 0 END) + (CASE WHEN NOT scale_ok THEN 0.15::DOUBLE ELSE 0 END) + (CASE WHEN NOT language_ok THEN 0.2::DOUBLE ELSE 0 END)
  + truncation_faults * 0.05::DOUBLE + (CASE WHEN coverage < 0.6 THEN 0.05::DOUBLE ELSE 0 END)), 0), 4) AS quality, CASE WHEN length(prompt) < 1000 THEN 0.7::DOUBLE WHEN length(prompt) > 6000 THEN 0.55::DOUBLE ELSE 0.6::DOUBLE END AS threshold FROM ru)"""
    bl = lambda x: f"coalesce({Q.strip(x)}, '') = ''"
    # indices by type, of rows e whose document_id ends in a line feed and the type
    kind = "split_part(document_id, chr(10), 2)"
    weights = "CASE criterion " + " ".join(f"WHEN '{k}' THEN {v[0]}::DOUBLE" for k, v in rollup.CRITERIA.items()) + " END"
    measured = f"""{roll},
b0 AS (SELECT document_id, question_score, CASE WHEN {n} LIKE 'estructura%' THEN 'estructura' WHEN {n} LIKE '%claridad%' AND {n} LIKE '%coherencia%' THEN 'claridad y coherencia' WHEN {n} LIKE 'pertinencia%' THEN 'pertinencia' END AS criterion
  FROM e WHERE {kind} = 'institucional' AND coalesce(section_weight, 1.0) > 0 AND coalesce(dimension_weight, 1.0) > 0),
b1 AS (SELECT *, CASE WHEN criterion = 'estructura' THEN 1.0::DOUBLE ELSE 4.0::DOUBLE END AS top FROM b0 WHERE criterion IS NOT NULL AND question_score IS NOT NULL),
b2 AS (SELECT document_id, criterion, sum(least(greatest(question_score, 0), top)) / sum(top) * {weights} AS part FROM b1 GROUP BY document_id, criterion),
b3 AS (SELECT document_id, sum(part) AS std FROM b2 GROUP BY document_id),
ms AS (SELECT document_id, {kind} AS report_type, sections, sections_scored,
  CASE WHEN {kind} = 'institucional' THEN coalesce(std, document_score, CASE WHEN sections_scored > 0 THEN 0 END) ELSE document_score END AS raw_index,
  CASE WHEN {kind} = 'institucional' THEN coalesce(CASE WHEN std IS NOT NULL THEN least(greatest(std, 0), 1) * 100 END, CASE WHEN document_score IS NOT NULL THEN least(greatest(document_score / 4.0, 0), 1) * 100 END, CASE WHEN sections_scored > 0 THEN 0 END)
    WHEN {kind} IN {rollup.POLICY} THEN CASE WHEN document_score IS NOT NULL THEN least(greatest(document_score / 2.0, 0), 1) * 20 END END AS index FROM doc LEFT JOIN b3 USING (document_id))"""
    pairs = f"""c AS (SELECT context_id, document_id, tipo_informe, {key('section_id')} AS sec, chunk_text, chunk_metadata, {Q.strip("coalesce(chunk_text, '')")} <> '' AS filled FROM chunk_contexts WHERE document_id IS NOT NULL AND tipo_informe IS NOT NULL), """
    pairs += rules.replace("FROM chunk_contexts c LEFT JOIN rubric_questions q ON q.question_id = c.question_id", f"FROM c JOIN rubric_questions q ON c.filled AND q.tipo_informe = c.tipo_informe AND ({key('q.section_id')} = '' OR c.sec = '' OR {key('q.section_id')} = c.sec)")
    pairs = pairs.replace("SELECT c.context_id,", "SELECT c.context_id, q.question_id,").replace("ru AS (SELECT context_id, prompt,", "ru AS (SELECT context_id, question_id, prompt,")
    of = lambda xs: Q.mock_score("(q.question_id || '|' || sha256(c.chunk_text))", xs)
    policy = f"{Q.identifier('q.tipo_informe')} IN {S.POLICY_TYPES}"
    evaluation = f"""WITH {pairs},
sc AS (SELECT c.document_id, c.tipo_informe, q.question_id, c.chunk_metadata.relevance AS weight, qu.quality >= qu.threshold AND qu.quality >= 0.7 AS passes,
  CASE WHEN qu.quality >= qu.threshold AND qu.quality >= 0.7 THEN CASE WHEN c.chunk_metadata IS NULL THEN 1.0::DOUBLE WHEN {policy} THEN {of(S.POLICY_LEVELS)} WHEN {Q.identifier('q.dimension_name')} = 'estructura' THEN {of(struct)} ELSE {of(inst)} END END AS score
  FROM qu JOIN c USING (context_id) JOIN rubric_questions q ON q.question_id = qu.question_id),
qs AS (SELECT document_id, tipo_informe, question_id, {Q.weighted('score', 'weight')} AS mean, count(*) AS pairs, count(*) FILTER (NOT passes) AS rejected FROM sc GROUP BY document_id, tipo_informe, question_id),
st AS (SELECT document_id, tipo_informe, sec, max(filled::INT) AS some FROM c WHERE sec <> '' GROUP BY document_id, tipo_informe, sec),
f0 AS (SELECT r.document_id, q.*, qs.mean, coalesce(qs.pairs, 0) AS pairs, coalesce(qs.rejected, 0) AS rejected, CASE WHEN {key('q.section_id')} = '' OR st.some = 1 THEN 'found' WHEN st.some = 0 THEN 'empty' ELSE 'missing' END AS status,
  {policy} AS block, {Q.identifier('q.tipo_informe')} = 'institucional' AND {Q.identifier('q.dimension_name')} = 'estructura' AND {key('q.section_id')} NOT IN {scoring.NOT_AUTO} AND {key('q.section_title')} NOT IN {scoring.NOT_AUTO} AS auto
  FROM (SELECT DISTINCT document_id, tipo_informe FROM c) r JOIN rubric_questions q ON q.tipo_informe = r.tipo_informe LEFT JOIN qs ON qs.document_id = r.document_id AND qs.tipo_informe = r.tipo_informe AND qs.question_id = q.question_id
  LEFT JOIN st ON st.document_id = r.document_id AND st.tipo_informe = r.tipo_informe AND st.sec = {key('q.section_id')}),
f1 AS (SELECT *, CASE WHEN mean IS NULL THEN NULL WHEN block THEN round_even(least(greatest(mean, 0.0::DOUBLE), 2.0::DOUBLE) * 2, 0) / 2 WHEN {n} = 'estructura' THEN {Q.nearest('mean', struct)} ELSE {Q.nearest('mean', inst)} END AS level FROM f0),
fin AS (SELECT * EXCLUDE (dimension_name, dimension_weight), CASE WHEN NOT block THEN dimension_name END AS dimension_name, CASE WHEN block THEN 1.0::DOUBLE ELSE dimension_weight END AS dimension_weight,
  CASE WHEN auto THEN CASE WHEN status = 'found' THEN 1.0::DOUBLE ELSE 0.0 END WHEN status <> 'found' THEN 0.0 ELSE level END AS question_score,
  CASE WHEN auto THEN 'presence' WHEN status <> 'found' THEN 'skipped' WHEN mean IS NOT NULL THEN 'scored' ELSE 'without score' END AS how FROM f1)"""
    return {
        "doc_score_flagship": f"""WITH d AS (SELECT doc_id, coalesce(tipo_informe, 'institucional') AS tipo_informe, section_id, unnest(range(0, (length(text) + 1349) // 1350)) AS i, text FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, tipo_informe, section_id AS c_section, sha256(substr(text, i * 1350 + 1, 1500)) AS digest FROM d),
s AS (SELECT c.doc_id || '|' || c.tipo_informe AS document_id, q.section_id, q.section_weight, q.dimension_name, q.dimension_weight, q.question_id, q.question_weight,
  CASE WHEN c.tipo_informe = 'politica_nacional' THEN {Q.mock_score("(q.question_id || '|' || c.digest)", S.POLICY_LEVELS)} ELSE {Q.mock_score("(q.question_id || '|' || c.digest)", inst)} END AS score
  FROM c JOIN rubric_questions q ON q.tipo_informe = c.tipo_informe AND ({key('q.section_id')} = '' OR {key('c.c_section')} = '' OR {key('q.section_id')} = {key('c.c_section')})),
e AS (SELECT document_id, section_id, section_weight, dimension_name, dimension_weight, question_id, question_weight, avg(score) AS question_score FROM s GROUP BY ALL),
{roll}
SELECT split_part(document_id, '|', 1)::BIGINT AS doc_id, split_part(document_id, '|', 2) AS tipo_informe, {Q.r6('document_score')} AS document_score,
 CASE WHEN split_part(document_id, '|', 2) = 'politica_nacional' THEN {Q.r6("least(greatest(document_score / 2.0::DOUBLE, 0), 1) * 20")} ELSE {Q.r6("least(greatest(document_score / 4.0::DOUBLE, 0), 1) * 100")} END AS index, n AS questions
FROM doc JOIN (SELECT document_id AS k, count(*) AS n FROM e GROUP BY document_id) ON k = document_id""",
        "evaluation_full": f"""{evaluation}, e AS (SELECT document_id || chr(10) || tipo_informe AS document_id, * EXCLUDE (document_id) FROM fin), {measured},
n AS (SELECT document_id, count(*) AS questions, count(*) FILTER (how = 'scored') AS scored, count(*) FILTER (how = 'presence') AS presence, count(*) FILTER (how = 'skipped') AS skipped, sum(pairs)::BIGINT AS pairs, sum(rejected)::BIGINT AS rejected FROM e GROUP BY document_id)
SELECT split_part(ms.document_id, chr(10), 1) AS document_id, report_type, {Q.r6('raw_index')} AS raw_index, {Q.r6('index')} AS index, sections, sections_scored, questions, scored, presence, skipped, pairs, rejected FROM ms JOIN n ON n.document_id = ms.document_id""",
        "evaluation_questions": f"{evaluation} SELECT document_id, tipo_informe, section_id, question_id, status, {Q.r6('question_score')} AS question_score, how, pairs, rejected FROM fin",
        "metrics_dispatch": f"""WITH e AS (SELECT coalesce(document_id, '<null>') || chr(10) || coalesce({Q.identifier('tipo_informe')}, '') AS document_id, * EXCLUDE (document_id) FROM export_rows), {measured}
SELECT nullif(split_part(document_id, chr(10), 1), '<null>') AS document_id, nullif(report_type, '') AS report_type, {Q.r6('raw_index')} AS raw_index, {Q.r6('index')} AS index, sections, sections_scored FROM ms""",
        "theta_pairs": f"SELECT c.context_id, count(*) AS pairs, min(q.question_id) AS first_question, max(q.question_id) AS last_question {theta} GROUP BY c.context_id",
        "cross_flagged": f"SELECT c.context_id, {key('c.section_id')} = '' AS global_context, count(*) AS pairs, sum(({key('q.section_id')} <> '' AND {key('c.section_id')} <> '' AND {key('q.section_id')} <> {key('c.section_id')})::INT)::BIGINT AS mismatches FROM chunk_contexts c CROSS JOIN rubric_questions q GROUP BY 1, 2",
        "score_constraint": f"""SELECT row_id, score, abs(score - x) > 1e-9 AS adjusted FROM (SELECT row_id, x, CASE WHEN {Q.identifier('tipo_informe')} = 'institucional' THEN CASE WHEN coalesce({n}, '') LIKE 'estructura%' THEN {Q.nearest('x', struct)} ELSE {Q.nearest('x', inst)} END
 WHEN {Q.identifier('tipo_informe')} IN {S.POLICY_TYPES} THEN round_even(least(greatest(x, 0.0::DOUBLE), 2.0::DOUBLE) * 2, 0) / 2 ELSE x END AS score FROM (SELECT *, question_score * 1.25::DOUBLE - 0.25::DOUBLE AS x FROM export_rows WHERE question_score IS NOT NULL))""",
        "scale_shapes": "SELECT question_id AS id, scale_min AS lo, scale_max AS hi, CASE WHEN scale_max >= scale_min THEN round((scale_max - scale_min) / 2, 9) END AS step FROM rubric_questions UNION ALL SELECT * FROM (VALUES ('x', 0.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE), ('y', 0.0, 1.0, 0.5), ('z', 1.0, 4.0, NULL), ('w', 2.0, 2.0, NULL)) t(id, lo, hi, step)",
        "mock_scores": f"WITH {scored} SELECT context_id, score FROM sc",
        "chunk_question_scores": f"WITH {scored} SELECT question_id, {Q.r6(Q.weighted('score', 'weight'))} AS score, count(score) AS scored, count(*) AS chunks FROM sc GROUP BY question_id",
        "best_chunk": f"WITH {scored} SELECT question_id, context_id, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC NULLS LAST, context_id) AS rn FROM sc) WHERE rn = 1",
        "imputed_scores": "SELECT response_id::VARCHAR AS id, CASE WHEN try_cast(metadata['retries'] AS INT) > 0 AND metadata['finish_reason'] <> 'stop' THEN 1.0::DOUBLE ELSE score END AS score FROM ai_responses UNION ALL SELECT * FROM (VALUES ('i1', 1.0::DOUBLE), ('i2', 0.5), ('i3', 0.5), ('i4', 1.0), ('i5', 2.0)) t(id, score)",
        "response_fields": """SELECT response_id::VARCHAR AS id, CASE WHEN NOT isnan(score) THEN score END AS score, justification, CASE WHEN score IS NOT NULL THEN relevant_text END AS relevant_text
FROM ai_responses WHERE score IS NOT NULL OR NOT regexp_matches(coalesce(justification, '{}'), '^\\s*\\{') UNION ALL SELECT response_id::VARCHAR, NULL, NULL, NULL FROM ai_responses WHERE score IS NULL AND justification IS NULL
UNION ALL SELECT * FROM (VALUES ('a', 2.0::DOUBLE, 'bien', NULL), ('b', NULL, 'texto libre', NULL), ('c', 1.5, NULL, 'cita'), ('d', NULL, 'sin puntaje', NULL)) t(id, score, justification, relevant_text)""",
        "rollup_dimensions": f"WITH {every}, {roll} SELECT document_id, section_id, dimension_name, {Q.r6('dimension_score')} AS dimension_score FROM dim",
        "rollup_sections": f"WITH {every}, {roll} SELECT document_id, section_id, {Q.r6('section_score')} AS section_score FROM sec",
        "rollup_documents": f"WITH {every}, {roll} SELECT document_id, {Q.r6('document_score')} AS document_score, sections_scored, sections FROM doc",
        "criterion_breakdown": f"WITH {crit} SELECT document_id, criterion, questions, scored, {Q.r6('score_sum')} AS score_sum, {Q.r6('max_sum')} AS max_sum, {Q.r6('ratio')} AS ratio FROM br",
        "index_institutional": f"WITH {crit}, ix AS (SELECT document_id, sum(CASE WHEN scored > 0 THEN ratio * {w} END) AS raw_index FROM br GROUP BY document_id) SELECT document_id, {Q.r6('raw_index')} AS raw_index, CASE WHEN raw_index IS NOT NULL THEN {Q.r6('least(greatest(raw_index, 0.0), 1.0) * 100')} END AS index FROM ix",
        "index_policy": f"WITH e AS (SELECT * FROM export_rows WHERE tipo_informe = 'politica_nacional'), {roll} SELECT document_id, {Q.r6('document_score')} AS document_score, CASE WHEN document_score IS NOT NULL THEN {Q.r6('least(greatest(document_score / 2, 0.0), 1.0) * 20')} END AS index FROM doc",
        "section_totals": f"WITH {every}, {roll} SELECT document_id, count(*) AS sections, count(section_score) AS with_score, count(*) - count(section_score) AS without_score FROM sec GROUP BY document_id",
        "section_metrics": f"""WITH {every}, {roll}, bd AS (SELECT document_id, section_id, min(scale_min) AS lo, max(scale_max) AS hi FROM export_rows GROUP BY ALL)
SELECT sec.document_id, sec.section_id, {Q.r6('section_score')} AS section_score, lo AS scale_min, hi AS scale_max, CASE WHEN section_score IS NOT NULL AND hi > lo THEN {Q.r6('least(greatest((section_score - lo) / (hi - lo), 0), 1)')} END AS share
FROM sec LEFT JOIN bd ON sec.document_id IS NOT DISTINCT FROM bd.document_id AND sec.section_id IS NOT DISTINCT FROM bd.section_id""",
        "section_bounds": "SELECT document_id, section_id, min(scale_min) AS scale_min, max(scale_max) AS scale_max FROM export_rows GROUP BY ALL",
        "best_justification": f"""SELECT document_id, section_id, coalesce(CASE WHEN {Q.strip('justification')} <> '' THEN justification END, CASE WHEN {Q.strip('relevant_text')} <> '' THEN relevant_text END, 'Sin justificación disponible.') AS best_justification
FROM (SELECT *, row_number() OVER (PARTITION BY document_id, section_id ORDER BY question_score DESC NULLS LAST, row_id) AS rn FROM export_rows) WHERE rn = 1""",
        "quality_summary": f"""WITH a AS (SELECT split_part(question_id, '_', 1) AS section, score / 4 AS q, try_cast(metadata['duration_ms'] AS DOUBLE) AS l FROM ai_responses WHERE question_id IS NOT NULL)
SELECT coalesce(section, '*') AS section, count(*) AS prompts, count(*) FILTER (NOT coalesce(q >= 0.25, false)) AS rejected, {Q.r6('avg(q)')} AS mean_quality, {Q.r6('avg(l)')} AS mean_latency, {Q.r6('stddev_pop(l)')} AS deviation_latency
FROM a GROUP BY GROUPING SETS ((), (section))""",
        "prompt_build": f"WITH {prompt} SELECT context_id, md5(prompt) AS digest, length(prompt) AS chars FROM pr",
        "prompt_rules": f"WITH {rules} SELECT context_id, length_ok, delimiters_ok, scale_ok, {Q.r6('evidence')} AS evidence, language_ok, truncation_faults, {Q.r6('coverage')} AS coverage FROM ru",
        "prompt_quality": f"WITH {rules} SELECT context_id, quality, CASE WHEN quality >= 0.9 THEN 'alta' WHEN quality >= 0.75 THEN 'aceptable' WHEN quality >= 0.6 THEN 'regular' ELSE 'rechazada' END AS band, threshold FROM qu",
        "prompt_gate": f"WITH {rules} SELECT context_id FROM qu WHERE quality >= threshold AND quality >= 0.7",
        "prompt_json_block": f"""WITH {prompt} SELECT context_id, regexp_matches(prompt, '\\{{[^{{}}]*"score"[^{{}}]*"justification"[^{{}}]*\\}}') AS json_ok FROM pr""",
        "prompt_metadata": f"WITH {prompt} SELECT context_id, length(prompt) AS chars, length(coalesce(chunk_text, '')) AS chunk_chars, coalesce(was_truncated, false) AS was_truncated, length(coalesce(chunk_text, '')) < 40 OR " + " OR ".join(f"contains(' ' || lower(coalesce(chunk_text, '')) || ' ', '{m}')" for m in prompts.MARKERS[:10]) + " AS language_ok, length(coalesce(chunk_text, '')) < 60 AS short_chunk FROM pr",
        "prompt_context": f"WITH {prompt} SELECT context_id, concat_ws(',', CASE WHEN {bl('chunk_text')} THEN 'empty_chunk' END, CASE WHEN NOT {bl('question_text')} AND {bl('dimension_name')} THEN 'question_without_dimension' END, CASE WHEN NOT {bl('chunk_text')} AND length(chunk_text) < 60 THEN 'short_chunk' END) AS flags FROM pr",
    }
