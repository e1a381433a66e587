"""Rubric checks, runs and merges, exports, measures, model and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valora.functions import text as T
from valora.operators import export, history, learning, rollup, rubric
from valora.queries import fragments as Q
from valora.runtime import keep, shared_dir, small_side
from valora.sources.tables import table
from valora.streaming import ingest

LEVELS = [("x", ["0", "1", "2"]), ("dup", ["1", "1,0", "2"]), ("odd", ["3", "no"])]
TARGETS = ["sintesis_general", "Lecciones del ciclo", "seccion_inexistente", "OTRA"]
BROKEN = [  # tipo_informe, section_id, section_weight, dimension_name, dimension_weight, question_id, question_text, question_weight, scale_min, scale_max
    ("a", "s1", 0.6, "d1", 1.0, "q1", "texto", 1.0, 0.0, 4.0), ("a", "s1", 0.6, "d1", 1.0, "q1", " ", -0.5, 0.0, 4.0), ("a", "s2", 0.4, "d2", 1.0, None, "x", 0.5, 2.0, 2.0),
    ("b", "s1", 0.5, "d1", 1.0, "q2", "texto", 1.0, 0.0, 2.0), ("b", "s2", 0.4, "d1", 0.5, "q3", "texto", 1.0, 0.0, 2.0),
]


def _export(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "export_rows")


def _r(c: str):
    return F.round(c, 6).alias(c)


def filtered_rubric(s: SparkSession, d: str) -> DataFrame:
    return rubric.filtered_rubric(table(s, d, "rubric_questions"), sections=["Sintesis General", "LECCIONES"]).select("tipo_informe", "section_id", "question_id")


def missing_targets(s: SparkSession, d: str) -> DataFrame:
    return rubric.missing_targets(table(s, d, "rubric_questions"), s.createDataFrame([(t,) for t in TARGETS], "target string"))


def weight_sums(s: SparkSession, d: str) -> DataFrame:
    return rubric.weight_sums(table(s, d, "rubric_questions"), 1e-3).select("level", "key", _r("total"), "ok")


def rubric_violations(s: SparkSession, d: str) -> DataFrame:
    """What is wrong with the rubric and with literal rubrics that have faults."""
    cols = "tipo_informe string, section_id string, section_weight double, dimension_name string, dimension_weight double, question_id string, question_text string, question_weight double, scale_min double, scale_max double"
    own = table(s, d, "rubric_questions").select(*(c.split()[0] for c in cols.split(", ")))
    return rubric.violations(own.unionByName(s.createDataFrame(BROKEN, cols)))


def duplicate_questions(s: SparkSession, d: str) -> DataFrame:
    """Questions that a report's section holds more than once."""
    return _export(s, d).groupBy("document_id", "section_id", "question_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def duplicate_levels(s: SparkSession, d: str) -> DataFrame:
    """Level values that a question's scale holds more than once: ends and middle of all rubric scales, and literal lists."""
    lo, hi = F.col("scale_min"), F.col("scale_max")
    t = table(s, d, "rubric_questions").select(F.col("question_id").alias("id"), F.array(lo, (lo + hi) / 2, hi).cast("array<string>").alias("levels"))
    return rubric.repeated_levels(t.unionByName(s.createDataFrame(LEVELS, "id string, levels array<string>")), "id", "levels")


def dedup_first(s: SparkSession, d: str) -> DataFrame:
    return history.first_rows(_export(s, d), ["document_id", "section_id", "dimension_name", "question_id"], ["row_id"]).select("row_id")


def merge_upsert(s: SparkSession, d: str) -> DataFrame:
    """The newest run of each report, merged into the first rows of all report-question keys."""
    keys = ["document_id", "question_id"]
    e = _export(s, d).select(*keys, "question_score", "justification", "run_ts", "row_id")
    newest = e.groupBy(T.identifier(F.col("document_id")).alias("_d")).agg(F.max("run_ts").alias("_newest"))
    update = e.join(small_side(keep(newest, "newest")), T.identifier(F.col("document_id")).eqNullSafe(F.col("_d"))).where("run_ts = _newest").drop("_newest", "_d")
    return history.merge_results(history.first_rows(e, keys, ["row_id"]), history.first_rows(update, keys, ["row_id"]), keys, ["question_score"], ["justification"])


def rerun_targets(s: SparkSession, d: str) -> DataFrame:
    explicit = table(s, d, "rubric_questions").where("section_id = 'lecciones'").select("question_id")
    return history.rerun_targets(_export(s, d), "question_id", "question_score", explicit)


def history_append(s: SparkSession, d: str) -> DataFrame:
    out = history.history(_export(s, d), ["document_id"], "run_ts", "criteria_version")
    return out.select("document_id", F.array_join("history", ",").alias("history"))


def reused_runs(s: SparkSession, d: str) -> DataFrame:
    """Run ids that come again after the load that brought them first."""
    e = _export(s, d).where("run_id IS NOT NULL").select("run_id", "loaded_at")
    first = e.groupBy("run_id").agg(F.min("loaded_at").alias("_first"))
    return history.reused_runs(e, e.join(first, "run_id").where("loaded_at > _first"))


def subset_export(s: SparkSession, d: str) -> DataFrame:
    """Export rows of some sections only, deduplicated, with scores of sections made anew."""
    targets = s.createDataFrame([("Marco_Problema",), ("lecciones",)], "section_id string")
    rows = history.first_rows(history.subset(_export(s, d), "section_id", targets), ["document_id", "section_id", "dimension_name", "question_id"], ["row_id"])
    return rollup.rollup(rows, ["document_id"])["sections"].select("document_id", "section_id", _r("section_score"))


def export_flat(s: SparkSession, d: str) -> DataFrame:
    e = _export(s, d)
    out = export.export_rows(e, rollup.rollup(e, ["document_id"]), ["document_id"])
    return out.select("run_id", "document_id", "section_id", "question_id", _r("dimension_score"), _r("section_score"))


def export_rescaled(s: SparkSession, d: str) -> DataFrame:
    return _export(s, d).select("row_id", F.round(export.rescaled(F.col("section_score"), F.col("scale_min"), F.col("scale_max")), 6).alias("score20"))


def export_payload(s: SparkSession, d: str) -> DataFrame:
    """All export rows as JSON documents of their reports with their indices, read back to rows."""
    e = _export(s, d).select("document_id", "section_id", "question_id", "question_score", "row_id")
    m = rollup.rollup(_export(s, d), ["document_id"])["documents"]
    docs = export.payload(e, ["document_id"], m, {"format": "1"})
    return export.payload_rows(docs, ["document_id"], "question_id:string,question_score:double,row_id:bigint")


def export_parts(s: SparkSession, d: str) -> DataFrame:
    """The JSON documents of every report, with the number of rows in each."""
    docs = export.payload(_export(s, d).select("document_id", "section_id", "question_id", "question_score", "row_id"), ["document_id"], most=100)
    n = F.size(F.flatten(F.from_json("payload", "sections array<struct<questions:array<struct<row_id:bigint>>>>")["sections"]["questions"]))
    return docs.groupBy("document_id").agg(F.max("parts").alias("parts"), F.sum(n).alias("rows"), F.count_if(n > 400).alias("crowded"))


def metadata_fields(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "evaluation_records")
    return r.select("record_id", *export.flat_metadata(F.regexp_replace("raw_json", "^\\ufeff", ""), ["evaluation.document_id", "evaluation.document_type", "document_id"]))


def metadata_leaves(s: SparkSession, d: str) -> DataFrame:
    return export.flat_leaves(table(s, d, "evaluation_records"), "record_id", "raw_json")


def training_rows(s: SparkSession, d: str) -> DataFrame:
    t = learning.training_rows(_export(s, d))
    return t.select("row_id", "seccion", "criterio", "label", F.col("words").cast("long").alias("words"))


def training_checks(s: SparkSession, d: str) -> DataFrame:
    """Violations of the training set's contract: scores out of their type's range, missing texts and labels."""
    e = _export(s, d)
    top = F.when(F.col("tipo_informe").isin("politica", "politica_nacional"), 2.0).otherwise(4.0)
    n = lambda c, name: F.sum(c.cast("long")).alias(name)
    z = lambda c: F.coalesce(c, F.lit(False))
    return e.groupBy("tipo_informe").agg(
        F.count(F.lit(1)).alias("rows"), n(F.col("question_score").isNull(), "without_score"), n(z(~F.col("question_score").between(F.lit(0.0), top)), "out_of_range"), n(T.first_filled(F.col("relevant_text"), F.col("justification")).isNull(), "without_text")
    )


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return _export(s, d).select("row_id", "tipo_informe", "question_score", "dimension_score")


def error_metrics(s: SparkSession, d: str) -> DataFrame:
    m = learning.error_metrics(_pairs(s, d).where("tipo_informe IS NOT NULL"), "question_score", "dimension_score", ["tipo_informe"])
    return m.select("tipo_informe", "n", *(_r(c) for c in ("mae", "rmse", "mean_true", "min_true", "max_true", "mean_pred", "r2")))


def human_correlation(s: SparkSession, d: str) -> DataFrame:
    return learning.correlation(_pairs(s, d), "question_score", "dimension_score").select("n", _r("pearson"))


def expected_correlation(s: SparkSession, d: str) -> DataFrame:
    """How the mean scores of answers go with the mean scores of the export, by question."""
    a = table(s, d, "ai_responses").where("score IS NOT NULL AND NOT isnan(score)").groupBy("question_id").agg(F.avg("score").alias("score"))
    e = _export(s, d).groupBy("question_id").agg(F.avg("question_score").alias("expected"))
    return learning.expected_correlation(a, e, "question_id", "score", "expected").select("n", _r("pearson"))


def run_stamps(s: SparkSession, d: str) -> DataFrame:
    """Every run's first time as an ISO text, as in file names, and read back."""
    e = _export(s, d).groupBy("run_id").agg(F.min("run_ts").alias("at"))
    iso = T.iso_stamp(F.col("at"))
    return e.select("run_id", iso.alias("iso"), T.file_stamp(F.col("at")).alias("stamp"), (T.parsed_stamp(iso).cast("timestamp_ntz") == F.date_trunc("second", "at").cast("timestamp_ntz")).alias("same"))


def run_order(s: SparkSession, d: str) -> DataFrame:
    """All runs of each report, those loaded first before later ones."""
    e = _export(s, d).where("run_id IS NOT NULL")
    first = e.groupBy("run_id").agg(F.min("loaded_at").alias("_first"))
    j = e.join(first, "run_id")
    return history.all_runs(j.where("loaded_at = _first"), j.where("loaded_at > _first"), ["document_id"], "run_ts").select("document_id", "run_id", "run_no")


def rubric_hashes(s: SparkSession, d: str) -> DataFrame:
    """A hash of every rubric question that only its labels and weights decide."""
    r = table(s, d, "rubric_questions")
    cols = ["section_id", "dimension_name", "question_text"]
    w = F.format_string("%.6f", F.coalesce("question_weight", F.lit(0.0)))
    return r.select("tipo_informe", "question_id", T.canonical_hash({**{c: F.col(c) for c in cols}, "weight": w}).alias("hash"))


def ridge_train(s: SparkSession, d: str) -> DataFrame:
    """Errors of the text model on its held-out fifth."""
    _, scored = learning.train(learning.training_rows(_export(s, d)))
    return learning.error_metrics(scored, "label", "prediction", [])


def stream_quality(s: SparkSession, d: str) -> DataFrame:
    """Daily counts and mean values of events by type, as a stream over the event file run to its end."""
    name = f"valora_stream_{uuid.uuid4().hex}"
    src = s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    q = ingest.windowed_quality(src, "ts", "event_type", "value").writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", f"{shared_dir(s)}/valora/{name}").start()
    q.awaitTermination()
    return s.table(name).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "rows", _r("mean"))


def stream_merge(s: SparkSession, d: str) -> DataFrame:
    """The newest answer of each report and question, as a stream of files merged to its end."""
    at = f"{shared_dir(s)}/valora/merge-{uuid.uuid4().hex}"
    src = s.readStream.schema(table(s, d, "ai_responses").schema).parquet(f"{d}/ai_responses.parquet*")
    src = src.select("response_id", "document_id", "question_id", "score", "answered_at")
    q = ingest.merge_stream(src, f"{at}/table", ["document_id", "question_id"], ["answered_at", "response_id"], f"{at}/state")
    q.awaitTermination()
    return ingest.merged_table(s, f"{at}/table", src.schema).select("response_id", "document_id", "question_id", "score")


QUERIES = {
    f.__name__: f
    for f in (
        filtered_rubric, missing_targets, weight_sums, rubric_violations, duplicate_questions, duplicate_levels, dedup_first, merge_upsert, rerun_targets, history_append, reused_runs, subset_export,
        export_flat, export_rescaled, export_payload, export_parts, metadata_fields, metadata_leaves, training_rows, training_checks, error_metrics, human_correlation, expected_correlation, run_stamps, run_order, rubric_hashes, ridge_train, stream_quality, stream_merge,
    )
}


def sql() -> dict[str, str]:
    ident = Q.identifier
    key = lambda *cs: ", ".join(ident(c) for c in cs)
    first = lambda where, keys: f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key(*keys)} ORDER BY row_id) AS rn FROM export_rows WHERE {where}) WHERE rn = 1)"
    halves = f"""nw AS (SELECT {ident('document_id')} AS d, max(run_ts) AS newest FROM export_rows GROUP BY 1),
x AS (SELECT *, coalesce({ident('document_id')}, '<null>') AS k1, coalesce({ident('question_id')}, '<null>') AS k2 FROM export_rows),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k1, k2 ORDER BY row_id) AS rn FROM x) WHERE rn = 1),
u AS (SELECT * FROM (SELECT x.*, row_number() OVER (PARTITION BY k1, k2 ORDER BY row_id) AS rn FROM x JOIN nw ON {ident('x.document_id')} IS NOT DISTINCT FROM nw.d AND run_ts = newest) WHERE rn = 1)"""
    filled = lambda c: f"CASE WHEN {Q.strip(c)} <> '' THEN {c} END"
    roll_e = f"""dim AS (SELECT document_id, section_id, dimension_name, {Q.weighted('question_score', 'coalesce(question_weight, 1.0)')} AS dimension_score, max(dimension_weight) AS dimension_weight FROM e GROUP BY document_id, section_id, dimension_name),
sec AS (SELECT document_id, section_id, {Q.weighted('dimension_score', 'coalesce(dimension_weight, 1.0)')} AS section_score FROM dim GROUP BY document_id, section_id)"""
    vals = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" for x in r) + ")" for r in BROKEN)
    path = "concat_ws('/', tipo_informe, section_id, dimension_name, question_id)"
    sums = lambda src, tol: f"""SELECT 'section' AS level, tipo_informe AS key, sum(section_weight) AS total FROM (SELECT DISTINCT tipo_informe, section_id, section_weight FROM {src}) GROUP BY tipo_informe
 UNION ALL SELECT 'dimension', concat_ws('/', tipo_informe, section_id), sum(dimension_weight) FROM (SELECT DISTINCT tipo_informe, section_id, dimension_name, dimension_weight FROM {src}) GROUP BY tipo_informe, section_id
 UNION ALL SELECT 'question', concat_ws('/', tipo_informe, section_id, dimension_name), sum(question_weight) FROM {src} GROUP BY tipo_informe, section_id, dimension_name"""  # noqa: E731
    ok = lambda tol: f"coalesce(abs(total - 1) <= {tol} * greatest(abs(total), 1.0), false)"
    text = f"coalesce({filled('relevant_text')}, {filled('justification')})"
    white = Q.WHITE
    return {
        "filtered_rubric": f"SELECT tipo_informe, section_id, question_id FROM rubric_questions WHERE {ident('section_id')} IN ('sintesis general', 'lecciones') OR {ident('section_title')} IN ('sintesis general', 'lecciones')",
        "missing_targets": f"SELECT target FROM (VALUES {', '.join(f'({chr(39)}{t}{chr(39)})' for t in TARGETS)}) v(target) WHERE {ident('target')} NOT IN (SELECT {ident('l')} FROM (SELECT section_id AS l FROM rubric_questions UNION SELECT section_title FROM rubric_questions UNION SELECT question_id FROM rubric_questions))",
        "weight_sums": f"SELECT level, key, {Q.r6('total')} AS total, {ok(1e-3)} AS ok FROM ({sums('rubric_questions', 1e-3)})",
        "rubric_violations": f"""WITH f AS (SELECT tipo_informe, section_id, section_weight, dimension_name, dimension_weight, question_id, question_text, question_weight, scale_min, scale_max FROM rubric_questions UNION ALL SELECT * FROM (VALUES {vals}) t(tipo_informe, section_id, section_weight, dimension_name, dimension_weight, question_id, question_text, question_weight, scale_min, scale_max)),
e AS (SELECT 'error' AS severity, 'question_without_id' AS code, {path} AS path, tipo_informe FROM f WHERE coalesce(trim(question_id), '') = '' UNION ALL SELECT 'error', 'question_without_text', {path}, tipo_informe FROM f WHERE coalesce(trim(question_text), '') = ''
 UNION ALL SELECT 'error', 'negative_weight', {path}, tipo_informe FROM f WHERE question_weight < 0 OR section_weight < 0 OR dimension_weight < 0 UNION ALL SELECT 'error', 'empty_scale', {path}, tipo_informe FROM f WHERE scale_min >= scale_max
 UNION ALL SELECT 'error', 'duplicate_question', concat_ws('/', tipo_informe, question_id), tipo_informe FROM f WHERE question_id IS NOT NULL GROUP BY tipo_informe, question_id HAVING count(*) > 1)
SELECT severity, code, path FROM e UNION ALL SELECT 'warning', 'short_question', {path} FROM f WHERE {Q.strip("coalesce(question_text, '')")} <> '' AND (length({Q.strip('question_text')}) < 15 OR len(string_split_regex({Q.strip('question_text')}, '\\s+')) < 3) AND tipo_informe NOT IN (SELECT tipo_informe FROM e)
UNION ALL SELECT 'warning', 'weights_of_' || level, key FROM ({sums('f', 1e-3)}) WHERE NOT {ok(1e-3)} AND split_part(key, '/', 1) NOT IN (SELECT tipo_informe FROM e)""",
        "duplicate_levels": "SELECT id, l AS value, count(*) AS n FROM (SELECT question_id AS id, unnest([scale_min, (scale_min + scale_max) / 2, scale_max]) AS l FROM rubric_questions UNION ALL SELECT * FROM (VALUES ('x', 0.0::DOUBLE), ('x', 1.0), ('x', 2.0), ('dup', 1.0), ('dup', 1.0), ('dup', 2.0), ('odd', 3.0)) t(id, l)) GROUP BY id, l HAVING count(*) > 1",
        "duplicate_questions": "SELECT document_id, section_id, question_id, count(*) AS n FROM export_rows GROUP BY ALL HAVING count(*) > 1",
        "dedup_first": f"SELECT row_id FROM {first('true', ['document_id', 'section_id', 'dimension_name', 'question_id'])}",
        "merge_upsert": f"""WITH {halves} SELECT coalesce(p.document_id, u.document_id) AS document_id, coalesce(p.question_id, u.question_id) AS question_id, coalesce(u.question_score, p.question_score) AS question_score,
 coalesce({filled('u.justification')}, p.justification) AS justification FROM p FULL OUTER JOIN u ON p.k1 = u.k1 AND p.k2 = u.k2""",
        "rerun_targets": f"SELECT DISTINCT {ident('q')} AS target FROM (SELECT question_id AS q FROM export_rows WHERE question_score IS NULL UNION SELECT question_id FROM rubric_questions WHERE section_id = 'lecciones') WHERE q IS NOT NULL",
        "history_append": "SELECT document_id, string_agg(criteria_version, ',' ORDER BY first_at, criteria_version) AS history FROM (SELECT document_id, criteria_version, min(run_ts) AS first_at FROM export_rows WHERE criteria_version IS NOT NULL GROUP BY document_id, criteria_version) GROUP BY document_id",
        "reused_runs": "SELECT run_id FROM export_rows WHERE run_id IS NOT NULL GROUP BY run_id HAVING max(loaded_at) > min(loaded_at)",
        "metadata_fields": """SELECT record_id, CASE WHEN json_valid(j) THEN json_extract_string(j, '$.evaluation.document_id') END AS metadata_evaluation_document_id, CASE WHEN json_valid(j) THEN json_extract_string(j, '$.evaluation.document_type') END AS metadata_evaluation_document_type,
CASE WHEN json_valid(j) THEN json_extract_string(j, '$.document_id') END AS metadata_document_id FROM (SELECT record_id, ltrim(raw_json, chr(65279)) AS j FROM evaluation_records)""",
        "export_payload": "SELECT document_id, section_id, question_id, question_score, row_id FROM export_rows",
        "export_parts": "SELECT document_id, ceil(count(*) / 100.0)::INT AS parts, count(*) AS rows, 0::BIGINT AS crowded FROM export_rows GROUP BY document_id",
        "subset_export": f"WITH e AS {first(f'''{ident('section_id')} IN ('marco_problema', 'lecciones')''', ['document_id', 'section_id', 'dimension_name', 'question_id'])}, {roll_e} SELECT document_id, section_id, {Q.r6('section_score')} AS section_score FROM sec",
        "export_flat": f"""WITH e AS (SELECT * FROM export_rows), {roll_e} SELECT e.run_id, e.document_id, e.section_id, e.question_id, {Q.r6('dim.dimension_score')} AS dimension_score, {Q.r6('sec.section_score')} AS section_score
FROM e LEFT JOIN dim ON e.document_id IS NOT DISTINCT FROM dim.document_id AND e.section_id IS NOT DISTINCT FROM dim.section_id AND e.dimension_name IS NOT DISTINCT FROM dim.dimension_name
LEFT JOIN sec ON e.document_id IS NOT DISTINCT FROM sec.document_id AND e.section_id IS NOT DISTINCT FROM sec.section_id""",
        "export_rescaled": f"SELECT row_id, CASE WHEN section_score IS NOT NULL AND scale_max > scale_min THEN {Q.r6('least(greatest((section_score - scale_min) / (scale_max - scale_min), 0.0), 1.0) * 20')} END AS score20 FROM export_rows",
        "training_rows": f"""SELECT row_id, coalesce({filled('section_id')}, 'desconocido') AS seccion, coalesce({filled('dimension_name')}, 'desconocido') AS criterio, question_score AS label,
 CASE WHEN {Q.strip('t')} = '' THEN 0 ELSE len(string_split_regex({Q.strip('t')}, '\\s+')) END AS words FROM (SELECT *, trim(regexp_replace({text}, '{white}+', ' ', 'g')) AS t FROM export_rows WHERE {ident('tipo_informe')} = 'institucional') WHERE t IS NOT NULL AND question_score IS NOT NULL""",
        "training_checks": f"SELECT tipo_informe, count(*) AS rows, count(*) FILTER (question_score IS NULL) AS without_score, count(*) FILTER (NOT question_score BETWEEN 0 AND CASE WHEN tipo_informe IN ('politica', 'politica_nacional') THEN 2 ELSE 4 END) AS out_of_range, count(*) FILTER ({text} IS NULL) AS without_text FROM export_rows GROUP BY tipo_informe",
        "error_metrics": f"""SELECT tipo_informe, count(*) AS n, {Q.r6('avg(abs(p - t))')} AS mae, {Q.r6('sqrt(avg((p - t) * (p - t)))')} AS rmse, {Q.r6('avg(t)')} AS mean_true, {Q.r6('min(t)')} AS min_true, {Q.r6('max(t)')} AS max_true, {Q.r6('avg(p)')} AS mean_pred,
 {Q.r6('1 - sum((p - t) * (p - t)) / (sum(t * t) - count(*) * avg(t) * avg(t))')} AS r2 FROM (SELECT tipo_informe, question_score AS t, dimension_score AS p FROM export_rows WHERE tipo_informe IS NOT NULL AND question_score IS NOT NULL AND dimension_score IS NOT NULL) GROUP BY tipo_informe""",
        "expected_correlation": f"""SELECT count(*) AS n, {Q.r6('corr(score, expected)')} AS pearson FROM (SELECT question_id, avg(score) AS score FROM ai_responses WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY 1)
JOIN (SELECT question_id, avg(question_score) AS expected FROM export_rows GROUP BY 1 HAVING avg(question_score) IS NOT NULL) USING (question_id)""",
        "run_stamps": "SELECT run_id, strftime(t0, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(t0, '%Y%m%d_%H%M%S') AS stamp, CASE WHEN t0 IS NOT NULL THEN true END AS same FROM (SELECT run_id, min(run_ts) AS t0 FROM export_rows GROUP BY run_id)",
        "run_order": """WITH f AS (SELECT run_id, min(loaded_at) AS first FROM export_rows WHERE run_id IS NOT NULL GROUP BY run_id), s AS (SELECT document_id, run_id, min((CASE WHEN loaded_at = first THEN 0 ELSE 1 END, run_ts)) AS x FROM export_rows JOIN f USING (run_id) GROUP BY document_id, run_id)
SELECT document_id, run_id, row_number() OVER (PARTITION BY document_id ORDER BY x, run_id) AS run_no FROM s""",
        "rubric_hashes": "SELECT tipo_informe, question_id, sha256(concat_ws(chr(31), 'dimension_name=' || dimension_name, 'question_text=' || question_text, 'section_id=' || section_id, 'weight=' || printf('%.6f', coalesce(question_weight, 0.0)))) AS hash FROM rubric_questions",
        "human_correlation": f"SELECT count(*) AS n, {Q.r6('corr(question_score, dimension_score)')} AS pearson FROM export_rows WHERE question_score IS NOT NULL AND dimension_score IS NOT NULL",
        "stream_quality": f"SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS rows, {Q.r6('avg(value)')} AS mean FROM events GROUP BY 1, 2",
        "stream_merge": "SELECT response_id, document_id, question_id, score FROM (SELECT *, row_number() OVER (PARTITION BY document_id, question_id ORDER BY answered_at DESC, response_id DESC) AS rn FROM ai_responses) WHERE rn = 1",
    }
