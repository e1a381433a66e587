"""Rubrics: from nested JSON to one flat table; filters, checks and a stable hash."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valora.functions import text as T
from valora.functions.scales import number

_LEVEL = "struct<valor:string,descripcion:string>"
_QUESTION = f"struct<id:string,texto:string,text:string,tipo:string,descripcion:string,ponderacion:string,peso:string,tipo_escala:string,niveles:array<{_LEVEL}>>"
_DIMENSION = f"struct<id:string,nombre:string,titulo:string,tipo_escala:string,descripcion:string,metodo_agregacion:string,ponderacion:string,peso:string,niveles:array<{_LEVEL}>,preguntas:array<{_QUESTION}>>"
_SECTION = f"struct<id:string,id_segmenter:string,titulo:string,nombre:string,ponderacion:string,peso:string,tipo:string,tipo_escala:string,dimensiones:array<{_DIMENSION}>,preguntas:array<{_QUESTION}>>"
SCHEMA = f"tipo_informe string, version string, metodologia string, escala struct<min:string,max:string,tipo:string,niveles:array<{_LEVEL}>>, secciones array<{_SECTION}>, bloques array<{_SECTION}>"


# Characters and words that a question's text has at least.
SHORT_TEXT = (15, 3)


def _filled(*cols: str) -> Column:
    return T.first_filled(*(F.col(c) for c in cols))


def _weight(prefix: str) -> Column:
    """ponderacion, or peso where that is missing or zero."""
    return F.coalesce(F.nullif(number(F.col(f"{prefix}.ponderacion")), F.lit(0.0)), number(F.col(f"{prefix}.peso")), number(F.col(f"{prefix}.ponderacion")))


def read_rubrics(spark: SparkSession, path: str) -> DataFrame:
    """Rubric files (one JSON document each) with a fixed schema that holds every alias.

    file names each row's file; a file that isn't a JSON object has its text in `corrupt` and no
    fields, so that it doesn't end the run.
    """
    text = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    bad = F.try_parse_json("value").isNull()
    return text.select(F.from_json("value", SCHEMA).alias("j"), F.when(bad, F.col("value")).alias("corrupt"), "file").select("j.*", "corrupt", "file")


def flat_rubric(rubrics: DataFrame) -> DataFrame:
    """One row per question: labels and weights of section, dimension and question, in their order.

    Sections may come as `secciones` with dimensions or as `bloques` without; a block's dimension
    is null with weight 1.
    """
    head = ["tipo_informe", "version", "metodologia"]
    secs = rubrics.select(*head, F.posexplode(F.concat(F.coalesce("secciones", F.array().cast(f"array<{_SECTION}>")), F.coalesce("bloques", F.array().cast(f"array<{_SECTION}>")))).alias("s_pos", "s"))
    own = F.array(F.struct(F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("nombre"), F.lit(None).cast("string").alias("titulo"), F.lit("1").alias("ponderacion"), F.lit(None).cast("string").alias("peso"), F.col("s.preguntas").alias("preguntas")))
    slim = F.transform("s.dimensiones", lambda d: F.struct(d["id"].alias("id"), d["nombre"].alias("nombre"), d["titulo"].alias("titulo"), d["ponderacion"].alias("ponderacion"), d["peso"].alias("peso"), d["preguntas"].alias("preguntas")))
    dims = secs.select("*", F.posexplode(F.when(F.size("s.dimensiones") > 0, slim).otherwise(own)).alias("d_pos", "d"))
    qs = dims.select("*", F.posexplode("d.preguntas").alias("q_pos", "q"))
    return qs.select(
        *head,
        _filled("s.id", "s.id_segmenter", "s.titulo", "s.nombre").alias("section_id"),
        _filled("s.titulo", "s.nombre", "s.id").alias("section_title"),
        _weight("s").alias("section_weight"),
        _filled("d.nombre", "d.titulo", "d.id").alias("dimension_name"),
        _weight("d").alias("dimension_weight"),
        F.col("q.id").alias("question_id"),
        _filled("q.texto", "q.text").alias("question_text"),
        _weight("q").alias("question_weight"),
        F.array_sort(F.array_distinct(F.array_compact(F.transform("q.niveles", lambda x: number(x["valor"]))))).alias("levels"),
        "s_pos", "d_pos", "q_pos",
    )


def labels_in(labels: list[Column], targets: list[str]) -> Column:
    """Whether any label, in compared form, is among the targets."""
    want = sorted({_plain(t) for t in targets})
    return F.coalesce(F.arrays_overlap(F.array_compact(F.array(*(T.identifier(x) for x in labels))), F.array(*(F.lit(w) for w in want)) if want else F.array().cast("array<string>")), F.lit(False))


def _plain(s: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", s.strip().lower()) if not unicodedata.combining(c))


def filtered_rubric(flat: DataFrame, sections: list[str] | None = None, questions: list[str] | None = None) -> DataFrame:
    """The rubric's rows of the sections and questions asked for; an empty list filters nothing.

    Dimensions and sections left without a question vanish by themselves, since rows are questions.
    """
    out = flat
    if sections:
        out = out.where(labels_in([F.col("section_id"), F.col("section_title")], sections))
    if questions:
        out = out.where(labels_in([F.col("question_id")], questions))
    return out


def missing_targets(flat: DataFrame, targets: DataFrame, target_col: str = "target") -> DataFrame:
    """The targets (a table) that no section or question label of the rubric matches, sorted."""
    labels = flat.select(F.explode(F.array("section_id", "section_title", "question_id")).alias("l")).select(T.identifier(F.col("l")).alias("form")).where("form IS NOT NULL").distinct()
    return targets.withColumn("form", T.identifier(F.col(target_col))).join(labels, "form", "left_anti").select(target_col).orderBy(target_col)


def close_to_one(total: Column, tolerance: float) -> Column:
    return F.abs(total - 1) <= tolerance * F.greatest(F.abs(total), F.lit(1.0))


def weight_sums(flat: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(level, key, total, ok): sums of weights of sections in a type, dimensions in a section, questions in a dimension."""
    s = flat.select("tipo_informe", "section_id", "section_weight").distinct().groupBy("tipo_informe").agg(F.sum("section_weight").alias("total")).select(F.lit("section").alias("level"), F.col("tipo_informe").alias("key"), "total")
    d = flat.select("tipo_informe", "section_id", "dimension_name", "dimension_weight").distinct().groupBy("tipo_informe", "section_id").agg(F.sum("dimension_weight").alias("total")).select(F.lit("dimension").alias("level"), F.concat_ws("/", "tipo_informe", "section_id").alias("key"), "total")
    q = flat.groupBy("tipo_informe", "section_id", "dimension_name").agg(F.sum("question_weight").alias("total")).select(F.lit("question").alias("level"), F.concat_ws("/", "tipo_informe", "section_id", "dimension_name").alias("key"), "total")
    return s.unionByName(d).unionByName(q).withColumn("ok", F.coalesce(close_to_one(F.col("total"), tolerance), F.lit(False)))


def violations(flat: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """(severity, code, path): what is wrong with flat rubrics, in three levels: structure, sums of weights,
    wording. Structure errors hide the further levels of their type."""
    path = F.concat_ws("/", "tipo_informe", "section_id", "dimension_name", "question_id")
    blank = lambda c: F.length(T.strip(F.coalesce(F.col(c), F.lit("")))) == 0
    rows = [
        flat.where(blank("question_id")).select(F.lit("error").alias("severity"), F.lit("question_without_id").alias("code"), path.alias("path"), "tipo_informe"),
        flat.where(blank("question_text")).select(F.lit("error").alias("severity"), F.lit("question_without_text").alias("code"), path.alias("path"), "tipo_informe"),
        flat.where("question_weight < 0 OR section_weight < 0 OR dimension_weight < 0").select(F.lit("error").alias("severity"), F.lit("negative_weight").alias("code"), path.alias("path"), "tipo_informe"),
        flat.where("scale_min >= scale_max").select(F.lit("error").alias("severity"), F.lit("empty_scale").alias("code"), path.alias("path"), "tipo_informe"),
        flat.groupBy("tipo_informe", "question_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND question_id IS NOT NULL").select(F.lit("error").alias("severity"), F.lit("duplicate_question").alias("code"), F.concat_ws("/", "tipo_informe", "question_id").alias("path"), "tipo_informe"),
    ]
    first = rows[0]
    for r in rows[1:]:
        first = first.unionByName(r)
    bad = first.select("tipo_informe").distinct()
    sums = weight_sums(flat, tolerance).where("NOT ok").withColumn("tipo_informe", F.split("key", "/")[0]).join(bad, "tipo_informe", "left_anti")
    text = T.strip(F.coalesce(F.col("question_text"), F.lit("")))
    brief = flat.where((F.length(text) > 0) & ((F.length(text) < SHORT_TEXT[0]) | (T.word_count(text) < SHORT_TEXT[1]))).join(bad, "tipo_informe", "left_anti")
    wording = brief.select(F.lit("warning").alias("severity"), F.lit("short_question").alias("code"), path.alias("path"))
    return first.drop("tipo_informe").unionByName(sums.select(F.lit("warning").alias("severity"), F.concat(F.lit("weights_of_"), "level").alias("code"), F.col("key").alias("path"))).unionByName(wording)


def repeated_levels(df: DataFrame, id_col: str, levels_col: str) -> DataFrame:
    """(id, value, n): numbers that a list of level texts holds more than once."""
    one = df.select(id_col, F.explode(F.transform(levels_col, lambda x: number(x))).alias("value")).where("value IS NOT NULL")
    return one.groupBy(id_col, "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def policy_violations(rubrics: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """(severity, code, path) of policy rubrics as read (SCHEMA): the scale's keys and range, blocks and
    their questions, sums of weights, levels within the scale and once each, manual blocks."""
    lo, hi = number(F.col("escala.min")), number(F.col("escala.max"))
    row = lambda cond, severity, code, path: F.when(cond, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), path.alias("path")))
    top = F.coalesce("tipo_informe", F.lit(""))
    no_scale = F.col("escala").isNull()
    blocks = F.coalesce("bloques", F.array().cast(f"array<{_SECTION}>"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, b: a + F.coalesce(number(b["ponderacion"]), F.lit(0.0)))
    head = F.array(
        row(no_scale, "error", "scale_missing", top),
        *(row(~no_scale & F.col(f"escala.{k}").isNull(), "error", "scale_key_missing", F.concat(top, F.lit(f"/{k}"))) for k in ("tipo", "min", "max")),
        row(lo >= hi, "error", "empty_scale", top),
        row(F.size(blocks) == 0, "error", "no_blocks", top),
        row((F.size(blocks) > 0) & ~close_to_one(total(blocks), tolerance), "error", "weights_of_blocks", top),
    )

    def of_block(b: Column) -> Column:
        at = F.concat_ws("/", top, F.coalesce(b["titulo"], b["id_segmenter"], b["id"]))
        qs = F.coalesce(b["preguntas"], F.array().cast(f"array<{_QUESTION}>"))

        def of_question(q: Column) -> Column:
            path = F.concat_ws("/", at, F.coalesce(q["id"], F.lit("?")))
            values = F.transform(q["niveles"], lambda x: number(x["valor"]))
            manual = F.coalesce(q["tipo_escala"], b["tipo_escala"], F.lit("")) == "manual"
            whole = F.forall(q["niveles"], lambda x: x["valor"].isNotNull() & x["descripcion"].isNotNull())
            return F.array(
                row(q["niveles"].isNull() & ~manual, "error", "no_levels", path),
                row(q["niveles"].isNotNull() & (F.coalesce(b["tipo"], F.lit("")) == "manual") & ~manual, "error", "not_manual", path),
                row(F.size(q["niveles"]) == 0, "error", "no_levels", path),
                row(~whole, "error", "level_incomplete", path),
                row(F.exists(values, lambda v: v < lo), "error", "level_below_scale", path),
                row(F.exists(values, lambda v: v > hi), "error", "level_above_scale", path),
                row(F.size(F.array_distinct(values)) < F.size(values), "warning", "duplicate_level", path),
            )

        own = F.array(row(F.size(qs) == 0, "error", "block_without_questions", at), row((F.size(qs) > 0) & ~close_to_one(total(qs), tolerance), "error", "weights_of_questions", at))
        return F.concat(own, F.flatten(F.transform(qs, of_question)))

    every = F.array_compact(F.concat(head, F.flatten(F.transform(blocks, of_block))))
    return rubrics.select(F.explode(every).alias("v")).select("v.*")


#: Validators of rubrics as read, by report type.
VALIDATORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_validator(report_type: str, check: Callable[[DataFrame], DataFrame]) -> None:
    """Add or replace the validator of a report type (compared form)."""
    VALIDATORS[_plain(report_type)] = check


register_validator("institucional", lambda r: violations(with_scale(flat_rubric(r))))
register_validator("politica_nacional", policy_violations)


def validate(spark: SparkSession, path: str) -> DataFrame:
    """(severity, code, path) of the rubric files under a path, each by its report type's validator.

    A file that isn't JSON is an error, a type without a validator a warning.
    """
    r = read_rubrics(spark, path)
    kind = F.coalesce(T.identifier(F.col("tipo_informe")), F.lit(""))
    broken = r.where("corrupt IS NOT NULL").select(F.lit("error").alias("severity"), F.lit("not_json").alias("code"), F.col("file").alias("path"))
    unknown = r.where(F.col("corrupt").isNull() & ~kind.isin(*VALIDATORS)).select(F.lit("warning").alias("severity"), F.lit("unknown_type").alias("code"), F.col("file").alias("path"))
    out = broken.unionByName(unknown)
    for name, check in VALIDATORS.items():
        out = out.unionByName(check(r.where(F.col("corrupt").isNull() & (kind == name))))
    return out


def with_scale(flat: DataFrame) -> DataFrame:
    """A flat rubric with scale_min and scale_max, the ends of each question's levels."""
    return flat.withColumns({"scale_min": F.array_min("levels"), "scale_max": F.array_max("levels")})


def found_file(spark: SparkSession, folder: str, name: str) -> str:
    """The file of a folder with a name, or else with the same name but for case and accents."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(hadoop(folder))]
    for same in (lambda n: n == name, lambda n: _plain(n) == _plain(name)):
        hit = sorted(n for n in names if same(n))
        if hit:
            return f"{folder}/{hit[0]}"
    raise FileNotFoundError(f"{folder} has no file {name}")


def bounded_levels(flat: DataFrame) -> DataFrame:
    """(tipo_informe, question_id, lo, hi, levels): the distinct levels that a scorer may choose from."""
    return flat.select("tipo_informe", "question_id", F.array_min("levels").alias("lo"), F.array_max("levels").alias("hi"), F.array_sort(F.array_distinct("levels")).alias("levels"))


def stable_hash(mapping: dict) -> str:
    """SHA-256 of a mapping's canonical JSON: sorted keys, no spaces."""
    return hashlib.sha256(json.dumps(mapping, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
