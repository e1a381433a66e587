"""Scores, scales and weighted means as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from valora.functions.text import identifier

# The levels of the report types' scales.
INSTITUTIONAL_LEVELS = (0.0, 1.0, 2.0, 3.0, 4.0)
STRUCTURE_LEVELS = (0.0, 1.0)
POLICY_LEVELS = (0.0, 0.5, 1.0, 1.5, 2.0)
POLICY_TYPES = ("pn", "politica_nacional", "politica nacional", "politicanacional")


def number(c: Column) -> Column:
    """A text as double, with a decimal comma or point; null if it is none."""
    return F.regexp_replace(F.trim(c), ",", ".").try_cast("double")


def number_text(c: Column) -> Column:
    """A number as the scale shows it: whole numbers without decimals."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """An aggregate: mean by positive weights; the plain mean if no weight is positive; nulls are left out."""
    ok = value.isNotNull() & (weight > 0)
    return F.coalesce(F.try_divide(F.sum(F.when(ok, value * weight)), F.sum(F.when(ok, weight))), F.avg(value))


def nearest_level(c: Column, levels: Column) -> Column:
    """The level nearest to a score, the lower of two as near."""
    return F.array_min(F.transform(levels, lambda x: F.struct(F.abs(x - c).alias("d"), x.alias("v"))))["v"]


def half_step(c: Column, lo: float = 0.0, hi: float = 2.0) -> Column:
    """The score within its bounds, rounded half to even to half points."""
    return F.when(c.isNotNull(), F.bround(F.least(F.greatest(c, F.lit(lo)), F.lit(hi)) * 2, 0) / 2)


def constrained(score: Column, report_type: Column, dimension: Column) -> Column:
    """A score on its report type's scale; types without a scale keep it."""
    kind, dim = identifier(report_type), identifier(F.coalesce(dimension, F.lit("")))
    levels = lambda xs: F.array(*(F.lit(x) for x in xs))
    inst = F.when(dim.startswith("estructura"), nearest_level(score, levels(STRUCTURE_LEVELS))).otherwise(nearest_level(score, levels(INSTITUTIONAL_LEVELS)))
    return F.when(score.isNotNull(), F.when(kind == "institucional", inst).when(kind.isin(*POLICY_TYPES), half_step(score)).otherwise(score))


def constrained_flag(score: Column, report_type: Column, dimension: Column) -> Column:
    """struct(score, adjusted) of a raw score, number or text, on its type's scale: adjusted if it moved
    by more than 1e-9 or is no number."""
    x = score.try_cast("double")
    out = constrained(x, report_type, dimension)
    return F.struct(out.alias("score"), (F.coalesce(F.abs(out - x) > 1e-9, F.lit(False)) | (score.isNotNull() & x.isNull())).alias("adjusted"))


def normalised(score: Column, lo: Column, hi: Column, to_lo: Column | float = 0.0, to_hi: Column | float = 1.0) -> Column:
    """A score moved from one range to another and kept within it; null on a null score or an empty range."""
    a, b = (x if isinstance(x, Column) else F.lit(float(x)) for x in (to_lo, to_hi))
    share = F.least(F.greatest((score - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))
    return F.when(score.isNotNull() & (hi > lo), a + share * (b - a))


def constant_step(levels: Column) -> Column:
    """The step of a list of levels if it is the same throughout, else null."""
    diff = F.zip_with(F.slice(levels, 2, 1 << 30), levels, lambda a, b: F.round(a - b, 9))
    diff = F.filter(diff, lambda x: x.isNotNull())
    return F.when((F.size(diff) > 0) & F.forall(diff, lambda x: x == diff[0]), diff[0])


def scale_bounds(levels: Column) -> Column:
    """(lo, hi) of a list of level texts or numbers."""
    nums = F.array_compact(F.transform(levels, lambda x: number(x.cast("string"))))
    return F.struct(F.array_min(nums).alias("lo"), F.array_max(nums).alias("hi"))


def mock_score(prompt: Column, levels: Column) -> Column:
    """A deterministic score: the first 32 bits of the prompt's SHA-256 choose a level; blank prompts give 0."""
    h = F.conv(F.substring(F.sha2(prompt, 256), 1, 8), 16, 10).cast("long")
    return F.when(F.length(F.trim(prompt)) == 0, F.lit(0.0)).otherwise(F.element_at(levels, (h % F.size(levels) + 1).cast("int")))
