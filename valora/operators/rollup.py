"""From question scores to dimensions, sections, documents and indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valora.functions import scales as S
from valora.functions import text as T
from valora.operators.scoring import best_by

# The criteria of institutional reports, their weights and their questions' maxima.
CRITERIA = {"estructura": (0.05, 1.0), "claridad y coherencia": (0.35, 4.0), "pertinencia": (0.60, 4.0)}
# Ranges of the indices, in and out.
RANGES = {"institucional": (0.0, 4.0, 0.0, 100.0), "politica_nacional": (0.0, 2.0, 0.0, 20.0)}


def _w(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(1.0))


def rollup(rows: DataFrame, doc: list[str], score: str = "question_score") -> dict[str, DataFrame]:
    """Weighted means of dimensions, sections and documents; a null weight counts as 1.

    rows: one per question with its own, its dimension's and its section's weight. A weighted mean
    of means is no sum over all rows, so each level is one aggregation on the keys of the last, with
    the hash partitioning of the first reused as long as its keys lead.
    """
    d_key, s_key = [*doc, "section_id", "dimension_name"], [*doc, "section_id"]
    dim = rows.groupBy(*d_key).agg(S.weighted_mean(F.col(score), _w("question_weight")).alias("dimension_score"), F.max("dimension_weight").alias("dimension_weight"), F.max("section_weight").alias("section_weight"))
    sec = dim.groupBy(*s_key).agg(S.weighted_mean(F.col("dimension_score"), _w("dimension_weight")).alias("section_score"), F.max("section_weight").alias("section_weight"))
    document = sec.groupBy(*doc).agg(S.weighted_mean(F.col("section_score"), _w("section_weight")).alias("document_score"), F.count("section_score").alias("sections_scored"), F.count(F.lit(1)).alias("sections"))
    return {"dimensions": dim, "sections": sec, "documents": document}


def criterion(name: Column) -> Column:
    """The criterion a dimension belongs to; other labels stand for themselves."""
    n = T.identifier(name)
    return F.when(n.startswith("estructura"), "estructura").when(F.contains(n, F.lit("claridad")) & F.contains(n, F.lit("coherencia")), "claridad y coherencia").when(n.startswith("pertinencia"), "pertinencia").otherwise(n)


def criterion_breakdown(rows: DataFrame, doc: list[str], score: str = "question_score") -> DataFrame:
    """Of each document and criterion: questions, scored ones, sum of scores, of maxima, and their ratio.

    Sections and dimensions of weight zero or less are left out; a score is kept within its range.
    """
    crit = criterion(F.col("dimension_name"))
    top = F.when(crit == "estructura", 1.0).otherwise(4.0)
    ok = (_w("section_weight") > 0) & (_w("dimension_weight") > 0)
    kept = F.least(F.greatest(F.col(score), F.lit(0.0)), top)
    r = rows.where(ok & F.col("dimension_name").isNotNull()).select(*doc, crit.alias("criterion"), F.when(F.col(score).isNotNull(), kept).alias("s"), top.alias("top"))
    return r.groupBy(*doc, "criterion").agg(F.count(F.lit(1)).alias("questions"), F.count("s").alias("scored"), F.sum("s").alias("score_sum"), F.sum(F.when(F.col("s").isNotNull(), F.col("top"))).alias("max_sum")).withColumn("ratio", F.try_divide("score_sum", "max_sum"))


def institutional_index(breakdown: DataFrame, doc: list[str]) -> DataFrame:
    """The weighted sum of the criteria's ratios, not divided by the weights of those without scores."""
    w = F.lit(None).cast("double")
    for name, (weight, _) in CRITERIA.items():
        w = F.when(F.col("criterion") == name, F.lit(weight)).otherwise(w)
    return breakdown.groupBy(*doc).agg(F.sum(F.when(F.col("scored") > 0, F.col("ratio") * w)).alias("raw_index")).withColumn("index", S.normalised(F.col("raw_index"), F.lit(0.0), F.lit(1.0), 0.0, 100.0))


def policy_index(documents: DataFrame) -> DataFrame:
    lo, hi, a, b = RANGES["politica_nacional"]
    return documents.withColumn("index", S.normalised(F.col("document_score"), F.lit(lo), F.lit(hi), a, b))


def section_totals(sections: DataFrame, doc: list[str]) -> DataFrame:
    return sections.groupBy(*doc).agg(F.count(F.lit(1)).alias("sections"), F.count("section_score").alias("with_score"), (F.count(F.lit(1)) - F.count("section_score")).alias("without_score"))


def section_bounds(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The scale of a section: least and largest bound of its questions."""
    return rows.groupBy(*keys).agg(F.min("scale_min").alias("scale_min"), F.max("scale_max").alias("scale_max"))


def section_metrics(sections: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """sections with the scale of their section and their score as a share of it; sections without
    bounds keep null ones."""
    b = bounds.select(*(F.col(k).alias(f"_{k}") for k in keys), "scale_min", "scale_max")
    j = sections.join(b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*(f"_{k}" for k in keys))
    return j.withColumn("share", S.normalised(F.col("section_score"), F.col("scale_min"), F.col("scale_max")))


def best_justification(rows: DataFrame, keys: list[str], order: str, literal: str = "Sin justificación disponible.") -> DataFrame:
    """Of each section the justification of its best question, else its text, else a literal."""
    best = best_by(rows, keys, "question_score", order)
    return best.select(*keys, F.coalesce(T.first_filled(F.col("justification"), F.col("relevant_text")), F.lit(literal)).alias("best_justification"))


def quality_summary(rows: DataFrame, section: str, quality: str, latency: str, valid: Column) -> DataFrame:
    """Prompt quality over all and by section: counts, rejected, mean quality, mean and deviation of latency."""
    base = rows.select(F.col(section).alias("section"), F.col(quality).alias("q"), F.col(latency).alias("l"), valid.alias("v"))
    return rows.sparkSession.sql(
        """SELECT coalesce(section, '*') AS section, count(*) AS prompts, count_if(NOT v) AS rejected, avg(q) AS mean_quality,
                  avg(l) AS mean_latency, stddev_pop(l) AS deviation_latency
           FROM {base} WHERE section IS NOT NULL GROUP BY GROUPING SETS ((), (section))""",
        base=base,
    )


# Names of the policy type.
POLICY = ("politica", "politica_nacional")


def metrics(rows: DataFrame, doc: list[str], report_type: str, strict: bool = False) -> DataFrame:
    """(doc, report_type, raw_index, index, sections, sections_scored): the index of every report by its type.

    Institutional reports: the criteria's weighted sum on 0 to 100; where no standard criterion was
    scored, 0 in strict mode, else the report's own score on the type's scale, or 0 if it has none
    but any section has a score. Policy reports: the own score on 0 to 20. Others: the own score
    as it is, without an index.
    """
    key = [*doc, "_type"]
    r = rows.withColumn("_type", F.coalesce(T.identifier(F.col(report_type)), F.lit("")))
    own = rollup(r, key)["documents"]
    std = criterion_breakdown(r.where("_type = 'institucional'"), key).where(F.col("criterion").isin(*CRITERIA))
    std = institutional_index(std, key).where("raw_index IS NOT NULL").select(*(F.col(k).alias(f"k_{k}") for k in key), F.col("raw_index").alias("s_raw"), F.col("index").alias("s_index"))
    j = own.join(std, [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in key], "left")
    kind, score, some = F.col("_type"), F.col("document_score"), F.col("sections_scored") > 0
    lo, hi, a, b = RANGES["institucional"]
    plo, phi, pa, pb = RANGES["politica_nacional"]
    fall_raw = F.lit(0.0) if strict else F.coalesce(score, F.when(some, 0.0))
    fall_index = F.lit(a) if strict else F.coalesce(S.normalised(score, F.lit(lo), F.lit(hi), a, b), F.when(some, a))
    raw = F.when(kind == "institucional", F.coalesce("s_raw", fall_raw)).otherwise(score)
    index = F.when(kind == "institucional", F.coalesce("s_index", fall_index)).when(kind.isin(*POLICY), S.normalised(score, F.lit(plo), F.lit(phi), pa, pb))
    return j.select(*doc, F.nullif(kind, F.lit("")).alias("report_type"), raw.alias("raw_index"), index.alias("index"), "sections", "sections_scored")
