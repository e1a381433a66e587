"""Prompts: their text, and the rules that score their quality from 1.0 down."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from valora.functions import text as T

# rules' weights, thresholds, bands and markers.
WEIGHTS = {"length": 0.20, "structure": 0.15, "json": 0.20, "scale": 0.15, "language": 0.20, "truncation": 0.05, "methodology": 0.05}
BANDS = {"alta": 0.90, "aceptable": 0.75, "regular": 0.60}
START, END, TRUNCATED = "<<<INICIO_FRAGMENTO>>>", "<<<FIN_FRAGMENTO>>>", "[texto truncado]"
MIN_LENGTH, MAX_LENGTH, GATE = 400, 14000, 0.7
# Spanish markers and words.
MARKERS = (" el ", " la ", " los ", " las ", " que ", " de ", " del ", " en ", " para ", " con ", " según ", " evaluación ")
COMMON = ("el", "la", "los", "las", "que", "de", "del", "en", "para", "con", "una", "sobre", "según", "informe", "evaluación")
# What a methodical prompt names, by category.
METHODOLOGY = {
    "rol": ("rol asignado", "rol del evaluador", "rol encargado"),
    "objetivo": ("objetivo", "propósito", "meta del análisis"),
    "escala": ("escala de valoración", "escala de calificación", "escala de evaluación"),
    "instrucciones": ("instrucciones de respuesta", "instrucciones de salida", "indicaciones para responder"),
    "formato": ("formato de salida", "formato de respuesta", "estructura de salida"),
}


def build(question: Column, section: Column, dimension: Column, lo: Column, hi: Column, chunk: Column, report_type: Column) -> Column:
    """The prompt of a question and a chunk; parts of the question are the same for all its chunks."""
    show = lambda c: F.format_string("%.1f", c)
    frag = T.within_budget(T.prompt_safe(chunk))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Rol asignado: evaluador de informes de tipo "), F.coalesce(report_type, F.lit("general")), F.lit(".")),
        F.concat(F.lit("Objetivo: valorar la sección «"), F.coalesce(section, F.lit("-")), F.lit("», dimensión «"), F.coalesce(dimension, F.lit("-")), F.lit("».")),
        F.concat(F.lit("Pregunta: "), F.coalesce(question, F.lit(""))),
        F.concat(F.lit("Escala de valoración: de "), show(F.coalesce(lo, F.lit(0.0))), F.lit(" a "), show(F.coalesce(hi, F.lit(4.0))), F.lit(".")),
        F.lit("Instrucciones de respuesta: responde solo con lo que el fragmento sustenta."),
        F.lit('Formato de salida: {"score": <número>, "justification": "<texto>", "relevant_text": "<cita>"}'),
        F.lit(START),
        frag,
        F.lit(END),
    )


def verbose(title: Column, report_type: Column, section: Column, dimension: Column, question: Column, question_id: Column, chunk: Column, meta_json: Column | None = None, extra: Column | None = None) -> Column:
    """The plain prompt that lists a pair's facts, for scorers without a builder of their own."""
    # The prompt's labels and sentences.
    facts = F.concat_ws(
        "\n",
        F.concat(F.lit("Documento: "), F.coalesce(title, F.lit("Documento evaluado"))),
        F.concat(F.lit("Tipo de informe: "), report_type),
        F.concat(F.lit("Sección: "), F.coalesce(section, F.lit("Sección"))),
        F.concat(F.lit("Dimensión: "), F.coalesce(dimension, F.lit("Dimensión"))),
        F.concat(F.lit("Pregunta: "), F.coalesce(question, question_id, F.lit(""))),
    )
    meta = F.concat(F.lit("Metadatos del fragmento: "), F.nullif(meta_json, F.lit("{}"))) if meta_json is not None else F.lit(None).cast("string")
    part = F.concat_ws("\n", F.lit("Analiza el siguiente fragmento y asigna un puntaje objetivo."), meta, F.lit("Fragmento:"), F.coalesce(F.nullif(chunk, F.lit("")), F.lit("<sin contenido>")))
    return F.concat_ws("\n\n", facts, part, F.nullif(extra, F.lit("")) if extra is not None else F.lit(None).cast("string"))


# Builders by report type: the scale's label and levels, and what the objective adds.
BUILDERS = {
    "institucional": ("0 a 4 (valores enteros)", (0.0, 1.0, 2.0, 3.0, 4.0), "Evalúa estructura, claridad y pertinencia de la sección."),
    "politica_nacional": ("0 a 2 (pasos de 0.5)", (0.0, 0.5, 1.0, 1.5, 2.0), "Examina la coherencia con la política y la consistencia del argumento."),
}


def build_for_type(report_type: str, question: Column, section: Column, dimension: Column, chunk: Column, levels: tuple[float, ...] | None = None) -> Column:
    """The prompt of a report type's builder; levels of the rubric replace its own scale."""
    if report_type not in BUILDERS:
        raise ValueError(f"no builder for {report_type!r}; known: {sorted(BUILDERS)}")
    label, own, aim = BUILDERS[report_type]
    scale = levels or own
    shown = label if levels is None else f"{min(scale):g} a {max(scale):g}"
    base = build(question, section, dimension, F.lit(float(min(scale))), F.lit(float(max(scale))), chunk, F.lit(report_type))
    more = f"{aim}\nNiveles: {shown}: " + "; ".join(f"{x:g}" for x in scale) + "."
    return F.replace(base, F.lit("Instrucciones de respuesta:"), F.lit(more + "\nInstrucciones de respuesta:"))


def template(report_type: str) -> dict[str, object]:
    """A builder's prompt as a template with named fields, for other prompt libraries."""
    label, scale, aim = BUILDERS[report_type]
    return {"template": f"Rol asignado: evaluador de informes de tipo {report_type}.\nObjetivo: {aim}\nPregunta: {{question}}\nEscala de valoración: {label}.\n{START}\n{{chunk}}\n{END}", "input_variables": ["question", "chunk"], "levels": list(scale)}


def scale_error(levels: Column, allowed: Column) -> Column:
    """Whether a context's levels hold one that the rubric doesn't allow; such a pair must not be scored."""
    return F.coalesce(F.size(F.array_except(levels, allowed)) > 0, F.lit(False))


def context_flags(chunk: Column, question: Column, dimension: Column, version: Column, methodology: Column, least: int = 60) -> Column:
    """What is wrong with a pair before a prompt is built; such rows go to a dead-letter table."""
    blank = lambda c: F.length(T.strip(F.coalesce(c, F.lit("")))) == 0
    return F.array_compact(
        F.array(
            F.when(blank(chunk), "empty_chunk"),
            F.when(~blank(question) & blank(dimension), "question_without_dimension"),
            F.when(~blank(version) & blank(methodology), "version_without_methodology"),
            F.when(~blank(chunk) & (F.length(chunk) < least), "short_chunk"),
        )
    )


def length_ok(p: Column) -> Column:
    return F.length(p).between(MIN_LENGTH, MAX_LENGTH)


def delimiters_ok(p: Column) -> Column:
    low = F.lower(p)
    return F.contains(low, F.lit(START.lower())) & F.contains(low, F.lit(END.lower()))


def numbers_in(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"(-?\d+(?:[.,]\d+)?)"), 1), lambda x: F.regexp_replace(x, ",", ".").cast("double"))


def scale_ok(p: Column, label: Column, values: Column) -> Column:
    """The label occurs, and all expected levels within 500 characters after it (or anywhere without it)."""
    at = F.call_function("locate", F.lower(label), F.lower(p))
    part = F.when(label.isNotNull() & (at > 0), F.substring(p, at, F.lit(500))).otherwise(p)
    return (label.isNull() | (at > 0)) & (values.isNull() | (F.size(F.array_except(values, numbers_in(part))) == 0))


def spanish_evidence(p: Column) -> Column:
    low = F.lower(p)
    padded = F.concat(F.lit(" "), low, F.lit(" "))
    markers = sum((F.when(F.contains(padded, F.lit(m)), 1).otherwise(0) for m in MARKERS), F.lit(0)) / F.lit(float(len(MARKERS)))
    words = F.regexp_extract_all(low, F.lit("([a-záéíóúüñ]+)"), 1)
    hits = F.size(F.filter(words, lambda w: w.isin(*COMMON))) / F.greatest(F.size(words), F.lit(1)).cast("double")
    letters = F.regexp_count(p, F.lit(r"\p{L}"))
    accents = F.when(letters > 0, F.regexp_count(low, F.lit("[áéíóúüñ]")) / letters.cast("double")).otherwise(0.0)
    return F.greatest(markers, hits) * 0.7 + accents * 0.3


def language_ok(p: Column) -> Column:
    n = F.length(T.strip(p))
    return (n < 80) | (spanish_evidence(p) >= F.when(n < 250, 0.22).otherwise(0.28))


def occurrences(c: Column, part: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("int")


def truncation_faults(p: Column, was_truncated: Column) -> Column:
    """How many truncation rules fail: marker missing, needless, repeated, or with much text after it."""
    low = F.lower(p)
    n = occurrences(low, TRUNCATED)
    after = F.substring_index(F.regexp_replace(low, r"(?s)^.*?\[texto truncado\]", ""), END.lower(), 1)
    letters = F.regexp_count(after, F.lit(r"\p{L}"))
    truncated = F.coalesce(was_truncated, F.lit(False))
    shown = F.when(n > 1, 1).otherwise(0) + F.when(letters > 40, 1).otherwise(0)
    return F.when(truncated & (n == 0), 1).when(~truncated & (n > 0), 1).when(n > 0, shown).otherwise(0)


def methodology_coverage(p: Column, aliases: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The share of the categories that a prompt names; aliases replace those of a category."""
    low = F.lower(p)
    found = F.lit(0)
    for names in {**METHODOLOGY, **(aliases or {})}.values():
        hit = F.lit(False)
        for a in names:
            hit = hit | F.contains(low, F.lit(a))
        found = found + F.when(hit, 1).otherwise(0)
    return found / F.lit(float(len({**METHODOLOGY, **(aliases or {})})))


def shows_json(text: str | None) -> bool | None:
    """Whether a text holds a balanced JSON object with the required keys, <fields> counting as texts."""
    if text is None:
        return None
    depth, start = 0, -1
    for m in re.finditer(r"[{}]", text):
        if m.group() == "{":
            start = m.start() if depth == 0 else start
            depth += 1
        elif depth:
            depth -= 1
            block = text[start : m.end()]
            if depth == 0 and '"score"' in block and '"justification"' in block:
                try:
                    json.loads(re.sub(r"\s+", " ", re.sub(r'"?<[^>]+>"?', '"x"', block)))
                    return True
                except ValueError:
                    return False
    return False


def json_block_ok(p: Column | str) -> Column:
    """shows_json() of a prompt (Arrow: brackets must balance)."""
    return F.pandas_udf(lambda c: c.map(shows_json), BooleanType())(p)


def native_quality(p: Column, label: Column, values: Column, was_truncated: Column) -> Column:
    """1 less the weights of the failed rules that SQL can check (all but the JSON block), 0 at least."""
    lost = (
        F.when(~length_ok(p), WEIGHTS["length"]).otherwise(0.0)
        + F.when(~delimiters_ok(p), WEIGHTS["structure"]).otherwise(0.0)
        + F.when(~scale_ok(p, label, values), WEIGHTS["scale"]).otherwise(0.0)
        + F.when(~language_ok(p), WEIGHTS["language"]).otherwise(0.0)
        + truncation_faults(p, was_truncated) * WEIGHTS["truncation"]
        + F.when(methodology_coverage(p) < 0.6, WEIGHTS["methodology"]).otherwise(0.0)
    )
    return F.round(F.greatest(1 - lost, F.lit(0.0)), 4)


def full_quality(p: Column, label: Column, values: Column, was_truncated: Column) -> Column:
    """native_quality() less the weight of the JSON block's rule; a prompt that can't be judged is 0."""
    js = F.when(~F.coalesce(json_block_ok(p), F.lit(False)), WEIGHTS["json"]).otherwise(0.0)
    q = F.round(F.greatest(native_quality(p, label, values, was_truncated) - js, F.lit(0.0)), 4)
    return F.when(p.isNotNull(), F.coalesce(q, F.lit(0.0))).otherwise(0.0)


def threshold(p: Column) -> Column:
    n = F.length(p)
    return F.when(n < 1000, 0.70).when(n > 6000, 0.55).otherwise(0.60)


def band(q: Column) -> Column:
    return F.when(q >= BANDS["alta"], "alta").when(q >= BANDS["aceptable"], "aceptable").when(q >= BANDS["regular"], "regular").otherwise("rechazada")


def gated(df: DataFrame, quality: str, prompt: str) -> DataFrame:
    """Rows whose prompt is good enough to be scored; filter before any scorer is called."""
    return df.where((F.col(quality) >= threshold(F.col(prompt))) & (F.col(quality) >= GATE))


def spanish_smoke(c: Column, least: int = 40) -> Column:
    """Whether a text of some length has any of the Spanish markers; short texts pass."""
    padded = F.concat(F.lit(" "), F.lower(c), F.lit(" "))
    hit = F.lit(False)
    for m in MARKERS[:10]:
        hit = hit | F.contains(padded, F.lit(m))
    return (F.length(c) < least) | hit


def quality_metadata(p: Column, chunk: Column, was_truncated: Column) -> Column:
    """struct of what is known of a prompt when it is built."""
    return F.struct(
        F.length(p).alias("chars"),
        F.length(chunk).alias("chunk_chars"),
        F.coalesce(was_truncated, F.lit(False)).alias("was_truncated"),
        spanish_smoke(chunk).alias("language_ok"),
        (F.length(chunk) < 60).alias("short_chunk"),
    )
