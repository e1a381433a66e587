"""Runs: merging new results into earlier ones, what to run again, first-wins dedup and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valora.functions import text as T


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each compared key, by the given order; nulls of a key are one value."""
    forms = [T.identifier(F.col(k).cast("string")) for k in keys]
    by = Window.partitionBy(*forms).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(by)).where("_rn = 1").drop("_rn")


def _unless_blank(new: Column, old: Column) -> Column:
    return F.coalesce(F.when(F.length(T.strip(new)) > 0, new), old)


def merge_results(previous: DataFrame, update: DataFrame, keys: list[str], numbers: list[str], texts: list[str]) -> DataFrame:
    """Upsert by compared keys: numbers take the update where it isn't null, texts where it isn't
    blank; rows of either side alone stay. Both sides must have one row per compared key."""
    form = lambda c: F.coalesce(T.identifier(c.cast("string")), F.lit("\0"))
    p = previous.select(*(form(F.col(k)).alias(f"_k{i}") for i, k in enumerate(keys)), *(F.col(c).alias(f"p_{c}") for c in [*keys, *numbers, *texts]))
    u = update.select(*(form(F.col(k)).alias(f"_k{i}") for i, k in enumerate(keys)), *(F.col(c).alias(f"u_{c}") for c in [*keys, *numbers, *texts]))
    j = p.join(u, [f"_k{i}" for i in range(len(keys))], "full_outer")
    return j.select(
        *(F.coalesce(f"p_{k}", f"u_{k}").alias(k) for k in keys),
        *(F.coalesce(f"u_{c}", f"p_{c}").alias(c) for c in numbers),
        *(_unless_blank(F.col(f"u_{c}"), F.col(f"p_{c}")).alias(c) for c in texts),
    )


def rerun_targets(previous: DataFrame, key: str, score: str, explicit: DataFrame) -> DataFrame:
    """Questions to run again: those without a score, and those asked for."""
    return previous.where(F.col(score).isNull()).select(T.identifier(F.col(key)).alias("target")).unionByName(explicit.select(T.identifier(F.col(key)).alias("target"))).where("target IS NOT NULL").distinct()


def reused_runs(runs: DataFrame, new: DataFrame, key: str = "run_id") -> DataFrame:
    """Run ids that are asked for and already used; must be empty."""
    return new.select(key).distinct().join(runs.select(key), key, "left_semi")


def history(runs: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """The distinct values of each key in the order of their runs.

    A value's first run decides, so a key's list is as long as its distinct values, not its runs.
    """
    first = runs.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(at).alias("_at"))
    return first.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", value))), lambda x: x[value]).alias("history"))


def subset(rows: DataFrame, key: str, targets: DataFrame) -> DataFrame:
    """The rows of the targets (compared); all rows if no target is given."""
    form = targets.select(T.identifier(F.col(key)).alias("_f")).where("_f IS NOT NULL").distinct()
    if form.isEmpty():
        return rows
    return rows.join(form, T.identifier(F.col(key)) == F.col("_f"), "left_semi")


def all_runs(previous: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Distinct runs of each key from both sides with `run_no`: earlier results' first, then by time."""
    side = lambda df, n: df.select(*keys, "run_id", at).groupBy(*keys, "run_id").agg(F.min(at).alias(at)).withColumn("_side", F.lit(n))
    runs = side(previous, 0).unionByName(side(new, 1)).groupBy(*keys, "run_id").agg(F.min(F.struct("_side", at)).alias("x"))
    by = Window.partitionBy(*keys).orderBy("x._side", f"x.{at}", "run_id")
    return runs.withColumn("run_no", F.row_number().over(by)).select(*keys, "run_id", F.col(f"x.{at}").alias(at), "run_no")
