"""Language profiles: character trigrams, trained on labelled texts (used by problem 5).

A profile holds the log-probabilities of a language's trigrams of letters and word edges, smoothed
by an even share for those not met, and what its own texts get on average. Profiles are compared by
the likelihood they give a text; one that gets far less from a language's profile than that
language's own texts do is written in another, known or not.

The profiles are fitted on a bounded sample: about TRAIN_TEXTS texts of each label, drawn by a hash
of the text, of each its first TRAIN_CHARS characters; their trigrams are counted in Spark, the
TRIGRAMS most frequent of each language come to the driver.

Defined results: rows without a text or with a label that isn't in LABELS are not learnt from; a
table without any such row gives no profiles; a text of less than LEAST trigrams is not judged.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of the training sample: texts of each language, characters of a text, trigrams of a profile.
TRAIN_TEXTS = 2000
TRAIN_CHARS = 2000
TRIGRAMS = 20_000
#: Trigrams that a judged text has at least, and the nats per trigram by which a text that is
#: written in another language stays below a language's own.
LEAST = 15
FAR = 2.0
#: The probability that a language's text holds a trigram that its profile doesn't list.
UNMET = 0.02
# Language tags in use, and the language that each means.
LABELS = {"es": "es", "spa": "es", "pt": "pt", "por": "pt", "en": "en", "eng": "en", "fr": "fr", "fra": "fr", "fre": "fr", "it": "it", "ita": "it", "de": "de", "deu": "de", "ger": "de"}

_LETTERS = re.compile(r"[^\W\d_]+")


def trigrams(text: str) -> list[str]:
    """Trigrams of a text's words, each with its edges."""
    return [p[i : i + 3] for w in _LETTERS.findall(text.lower()) for p in (f" {w} ",) for i in range(len(p) - 2)]


@dataclass
class Profile:
    """log-probability of each trigram, of one that isn't listed, and the mean of the language's own texts."""

    logs: dict[str, float]
    other: float
    mean: float = 0.0

    def score(self, grams: list[str]) -> float:
        get, other = self.logs.get, self.other
        return sum(get(g, other) for g in grams) / len(grams)


def tagged(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, text) of the sample that the profiles are fitted on."""
    of = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    rows = df.select(F.try_element_at(of, F.lower(F.trim(F.col(lang_col)))).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most as many as languages
    if not n:
        return rows.select("lang", F.substring("text", 1, TRAIN_CHARS).alias("text"))
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(int(min(1.0, TRAIN_TEXTS / v) * 1_000_000))) for k, v in n.items()))
    return rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share).select("lang", F.substring("text", 1, TRAIN_CHARS).alias("text"))


def train(df: DataFrame, text_col: str, lang_col: str) -> dict[str, Profile]:
    """A profile of every labelled language of df."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                seen.setdefault(lang, Counter()).update(trigrams(text))
            yield pd.DataFrame([(k, g, n) for k, c in seen.items() for g, n in c.items()], columns=["lang", "g", "n"])

    sample = tagged(df, text_col, lang_col)
    counts = sample.mapInPandas(count, "lang string, g string, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    top = counts.withColumn("all", F.sum("n").over(Window.partitionBy("lang"))).withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "g"))).where(f"k <= {TRIGRAMS}")
    out: dict[str, Profile] = {}
    for lang, part in top.select("lang", "g", "n", "all").toPandas().groupby("lang"):
        total = float(part["all"].iloc[0])
        out[lang] = Profile({g: math.log((1 - UNMET) * n / total) for g, n in zip(part["g"], part["n"], strict=True)}, math.log(UNMET / TRIGRAMS))
    if out:
        held = dict(out)

        def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                got = []
                for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                    g = trigrams(text)
                    if len(g) >= LEAST and lang in held:
                        got.append((lang, held[lang].score(g)))
                yield pd.DataFrame(got, columns=["lang", "x"])

        for r in sample.mapInPandas(own, "lang string, x double").groupBy("lang").agg(F.avg("x").alias("m")).collect():
            out[r["lang"]].mean = r["m"]
    return out


def lead(grams: list[str], profiles: dict[str, Profile]) -> tuple[str, float] | None:
    """(language, how much likelier it makes a text than the next one does, in nats), if two profiles can be compared."""
    if len(grams) < LEAST or len(profiles) < 2:
        return None
    first, second, *_ = sorted(((p.score(grams), k) for k, p in profiles.items()), reverse=True)
    return first[1], (first[0] - second[0]) * len(grams)


def foreign(grams: list[str], lang: str, profiles: dict[str, Profile], far: float = FAR) -> bool:
    """Whether a text gets so little from a language's profile that it is written in another, known or not."""
    p = profiles.get(lang)
    return p is not None and len(grams) >= 2 * LEAST and p.score(grams) < p.mean - far
