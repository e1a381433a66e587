"""Pairs of questions and chunks, their scores, and scores of questions from those of chunks."""

from __future__ import annotations

import json
import math
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valora.functions import scales as S
from valora.functions import text as T
from valora.runtime import small_side


def _key(c: Column) -> Column:
    return F.coalesce(T.identifier(c), F.lit(""))


def question_chunk_pairs(questions: DataFrame, chunks: DataFrame, q_section: str, c_section: str, also: list[str] | None = None) -> DataFrame:
    """Pairs of which both sections are stated and equal, or either isn't stated.

    One equi-join: a question is filed under its section (or none) and under "all"; a chunk that
    states a section looks there and under "none", one that doesn't under "all". The questions'
    side is broadcast only if its measured size allows it. also: columns that must be equal too.
    """
    every, none = F.lit("\0all"), F.lit("\0none")
    filed = questions.withColumn("_q", _key(F.col(q_section))).withColumn("_k", F.explode(F.array(F.when(F.col("_q") == "", none).otherwise(F.col("_q")), every))).drop("_q")
    c = chunks.withColumn("_c", _key(F.col(c_section)))
    asked = c.withColumn("_k", F.explode(F.when(F.col("_c") == "", F.array(every)).otherwise(F.array(F.col("_c"), none)))).drop("_c")
    return asked.join(small_side(filed), ["_k", *(also or [])]).drop("_k")


#: Parts that each question is repeated in for pairs with all chunks.
PARTS = 64


def flagged_pairs(questions: DataFrame, chunks: DataFrame, q_section: str, c_section: str) -> DataFrame:
    """All pairs of a rubric with all chunks, with section_mismatch and global_context.

    Every question stands in each of PARTS parts and a chunk meets those of its own, drawn by a
    hash, so the pairs come from an equi-join whose keys are even.
    """
    q = questions.withColumn("_q", _key(F.col(q_section))).withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    c = chunks.withColumn("_c", _key(F.col(c_section))).withColumn("_p", F.pmod(F.xxhash64(*(c for c, t in chunks.dtypes if not t.startswith("map"))), F.lit(PARTS)).cast("int"))
    differ = (F.col("_q") != "") & (F.col("_c") != "") & (F.col("_q") != F.col("_c"))
    return c.join(small_side(q), "_p").withColumn("section_mismatch", differ).withColumn("global_context", F.col("_c") == "").drop("_q", "_c", "_p")


# Names that a chunk's weight may have, in the order in which they count.
WEIGHTS = ("weight", "ponderacion", "relevance", "peso")


def chunk_weight(*cols: Column) -> Column:
    """The first weight that is a number."""
    return F.coalesce(*(c.try_cast("double") for c in cols))


def metadata_weight(meta_json: Column) -> Column:
    """The weight in a chunk's metadata (JSON text): of its own members, else of its chunk_metadata."""
    return F.coalesce(*(S.number(F.get_json_object(meta_json, f"{at}{w}")) for at in ("$.", "$.chunk_metadata.") for w in WEIGHTS))


def question_scores(scored: DataFrame, keys: list[str], score: str = "score", weight: str = "weight") -> DataFrame:
    """Scores of questions: if any chunk has a positive weight, unweighted ones are left out; else the mean."""
    return scored.groupBy(*keys).agg(S.weighted_mean(F.col(score), F.col(weight)).alias("score"), F.count(score).alias("scored"), F.count(F.lit(1)).alias("chunks"))


def best_by(df: DataFrame, keys: list[str], score: str, order: str) -> DataFrame:
    """The row with the highest score of each group, the first in order of equals, null scores last."""
    by = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), F.col(order).asc())
    return df.withColumn("_rn", F.row_number().over(by)).where("_rn = 1").drop("_rn")


def imputed(score: Column, flag: Column, error: Column) -> Column:
    """The score a chunk counts with: 1.0 where its scorer failed for good."""
    return F.when(F.coalesce(flag, F.lit(False)) & error.isNotNull(), F.lit(1.0)).otherwise(score)


# Sections of which structure questions are judged by a scorer all the same.
NOT_AUTO = ("prioridades de la politica institucional", "prioridades_politica_institucional")


def auto_scored(report_type: Column, dimension: Column, *section_labels: Column) -> Column:
    """Whether a question gets its score from its section's presence alone: structure questions of
    institutional reports, but for the sections that need a judgement."""
    judged = F.lit(False)
    for label in section_labels:
        judged = judged | F.coalesce(T.identifier(label).isin(*NOT_AUTO), F.lit(False))
    return F.coalesce((T.identifier(report_type) == "institucional") & (T.identifier(dimension) == "estructura"), F.lit(False)) & ~judged


def auto_structure_score(status: Column) -> Column:
    """1 where a section of the structure dimension is there, else 0."""
    return F.when(status == "found", 1.0).otherwise(0.0)


def response_fields(payload: Column) -> Column:
    """struct(score, justification, relevant_text) of a scorer's answer: JSON, or text as justification."""
    js = F.get_json_object
    is_obj = payload.rlike(r"^\s*\{")
    return F.struct(
        F.when(is_obj, S.number(js(payload, "$.score"))).alias("score"),
        F.when(is_obj, js(payload, "$.justification")).otherwise(payload).alias("justification"),
        F.when(is_obj, js(payload, "$.relevant_text")).alias("relevant_text"),
    )


Scorer = Callable[[list[str]], list[str]]


class TransientError(Exception):
    """A scorer's failure that trying again may mend."""


# Waits of the inner layer of retries, in seconds, by attempt.
INNER_WAITS = (1.0, 10.0)
#: What is added to a prompt whose answer was no object with a score.
CORRECTION = "\nLa respuesta anterior no era un objeto JSON con un puntaje numérico. Responde solo con ese objeto."


def _score_of(answer: str | None) -> tuple[float | None, dict | None]:
    """(score, object) of an answer; (None, None) unless it is a JSON object with a number as its score."""
    try:
        o = json.loads(re.sub(r"^\s*```(?:json)?|```\s*$", "", answer or ""))
        x = o.get("score") if isinstance(o, dict) else None
        x = float(x.replace(",", ".")) if isinstance(x, str) else float(x) if isinstance(x, int | float) and not isinstance(x, bool) else None
        return (x, o) if x is not None and math.isfinite(x) else (None, None)
    except ValueError:
        return None, None


def remote_scores(
    pairs: DataFrame, key: str, prompt: str, make_scorer: Callable[[], Scorer], retries: int = 2, delay: float = 1.0, backoff: float = 2.0, batch: int = 64,
    timeout: float | None = None, levels: tuple[float, ...] | None = None, make_fallback: Callable[[], Scorer] | None = None, attempts: int = 3, waits: tuple[float, float] = INNER_WAITS,
) -> DataFrame:
    """(key, payload, attempts, error, adjusted_from): answers of a scorer that is made once per partition.

    Two layers of retries: TransientError is tried again up to `attempts` times with waits that
    double within `waits`; any failure of that, or none within `timeout` seconds, is tried again
    `retries` times with growing delays. A batch that fails for good gives payload null and its
    error, so that no row is lost and imputation can follow. A PermissionError ends the scorer: the
    rest of the partition goes to the fallback, if there is one, and says so in its error.

    With `levels` answers must be JSON objects with a numeric score: others are asked for once more
    with a correction, and a score between levels is moved to the nearest, the lower of two as near,
    adjusted_from telling what it was.
    """
    kind = dict(pairs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = ThreadPoolExecutor(1)
        state = {"scorer": make_scorer(), "note": None}

        def inner(ps: list[str]) -> list[str]:
            for n in range(attempts):
                try:
                    return state["scorer"](ps)
                except TransientError:
                    if n + 1 == attempts:
                        raise
                    time.sleep(min(waits[1], waits[0] * 2**n))
            return []

        def outer(ps: list[str]) -> tuple[list[str | None], int, str | None]:
            nonlocal pool
            tried, error = 0, None
            while tried <= retries:
                tried += 1
                try:
                    got = inner(ps) if timeout is None else pool.submit(inner, ps).result(timeout)
                    if len(got) != len(ps):
                        raise ValueError(f"{len(got)} answers to {len(ps)} prompts")
                    return list(got), tried, state["note"]
                except PermissionError as e:
                    if make_fallback is None or state["note"]:
                        return [None] * len(ps), tried, f"not authorised: {e}"[:500]
                    state.update(scorer=make_fallback(), note=f"fallback scorer, not authorised: {e}"[:500])
                    tried -= 1
                except Exception as e:  # any failure of a remote scorer counts as one
                    error = (str(e) or type(e).__name__)[:500]
                    if isinstance(e, TimeoutError):
                        pool = ThreadPoolExecutor(1)  # the one that hangs is left to itself
                    if tried <= retries:
                        time.sleep(delay * backoff ** (tried - 1))
            return [None] * len(ps), tried, error

        for pdf in batches:
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo : lo + batch]
                prompts = part[prompt].tolist()
                answers, tried, error = outer(prompts)
                before: list[float | None] = [None] * len(part)
                errors = [error] * len(part)
                if levels is not None and any(a is not None for a in answers):
                    wrong = [i for i, a in enumerate(answers) if _score_of(a)[1] is None]
                    if wrong:
                        again, more, _ = outer([prompts[i] + CORRECTION for i in wrong])
                        tried += more
                        for i, a in zip(wrong, again, strict=True):
                            answers[i] = a if _score_of(a)[1] is not None else None
                            errors[i] = error if answers[i] is not None else "no numeric score, nor after a correction"
                    for i, a in enumerate(answers):
                        x, o = _score_of(a)
                        near = None if o is None else min(levels, key=lambda v, x=x: (abs(v - x), v))
                        if o is not None and near != x:
                            before[i], answers[i] = x, json.dumps({**o, "score": near}, ensure_ascii=False)
                yield pd.DataFrame({key: part[key].to_numpy(), "payload": answers, "attempts": tried, "error": errors, "adjusted_from": pd.array(before, "Float64")})
        pool.shutdown(wait=False)

    return pairs.select(key, prompt).mapInPandas(run, f"{key} {kind}, payload string, attempts int, error string, adjusted_from double")


def skipped_score(status: Column, score: Column) -> Column:
    """0 for questions of sections that are empty or missing, whatever their scorer said."""
    return F.when(status.isin("empty", "missing"), F.lit(0.0)).otherwise(score)


def payload_faults(score: Column, justification: Column, meta: Column) -> Column:
    """What a scorer's answer lacks: a number, a text, its model, its provider, its duration."""
    has = lambda k: F.coalesce(F.map_contains_key(meta, k), F.lit(False))
    return F.array_compact(
        F.array(
            F.when(score.isNull() | F.isnan(score), "score"),
            F.when(justification.isNull(), "justification"),
            F.when(~has("model"), "model"),
            F.when(~has("provider"), "provider"),
            F.when(~has("duration_ms"), "duration_ms"),
        )
    )


#: Scorers by name: functions that make a scorer for a partition.
SCORERS: dict[str, Callable[[], Scorer]] = {}


def register_scorer(name: str, make: Callable[[], Scorer]) -> None:
    """Add or replace a scorer for remote_scores()."""
    if not name.strip():
        raise ValueError("the name is empty")
    SCORERS[name.strip().lower()] = make


def scorer(name: str) -> Callable[[], Scorer]:
    """The registered scorer of a name."""
    try:
        return SCORERS[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown scorer {name!r}; known: {sorted(SCORERS)}") from None
