"""Lookups by compared labels: first of several keys, last of several entries, aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valora.functions import text as T
from valora.runtime import keep, small_side


def first_match(rows: DataFrame, id_col: str, row_labels: list[str], entries: DataFrame, entry_labels: list[str], value: str) -> DataFrame:
    """(id, value): the value of the entry that the first matching pair of labels names, null without one.

    Pairs are tried row label by row label and, within one, entry label by entry label; the smallest
    value decides among entries of one label. The entries are exploded to one row per label, so the
    lookup is one equi-join.
    """
    keys = entries.select(F.col(value).alias("_v"), F.posexplode(F.array(*(T.identifier(F.col(c)) for c in entry_labels))).alias("_e", "_k")).where("_k IS NOT NULL")
    keys = keys.groupBy("_k", "_e").agg(F.min("_v").alias("_v"))
    want = rows.select(F.col(id_col), F.posexplode(F.array(*(T.identifier(F.col(c)) for c in row_labels))).alias("_r", "_k"))
    hit = want.join(keys, "_k", "left").groupBy(id_col).agg(F.min(F.when(F.col("_v").isNotNull(), F.struct("_r", "_e", "_v"))).alias("m"))
    return hit.select(id_col, F.col("m._v").alias(value))


def fill_from(rows: DataFrame, entries: DataFrame, key: str, fields: list[str], order: str) -> DataFrame:
    """rows with null fields filled from the entry of their key, the last by order counting."""
    last = entries.groupBy(T.identifier(F.col(key)).alias("_k")).agg(*(F.max_by(f, order).alias(f"_{f}") for f in fields))
    j = rows.withColumn("_k", T.identifier(F.col(key))).join(small_side(keep(last, "entries")), "_k", "left")
    return j.select(*(F.coalesce(c, f"_{c}").alias(c) if c in fields else F.col(c) for c in rows.columns))


def canonical(c: Column, aliases: dict[str, list[str]]) -> Column:
    """The canonical name of a label by its aliases; others keep their compared form."""
    form = T.identifier(c)
    out = form
    for name, forms in aliases.items():
        out = F.when(form.isin(*forms), F.lit(name)).otherwise(out)
    return out


def prioritised(c: Column, entries: dict[str, str], default: str | None = None) -> Column:
    """The value of the entry that a label equals, else starts, ends or contains; longest key first."""
    form = T.identifier(c)
    keys = sorted(entries, key=lambda k: (-len(k), k))
    out = F.lit(default).cast("string")
    for test in (lambda k: F.contains(form, F.lit(k)), lambda k: form.endswith(k), lambda k: form.startswith(k), lambda k: form == k):
        for k in reversed(keys):
            out = F.when(test(k), F.lit(entries[k])).otherwise(out)
    return out
