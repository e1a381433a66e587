"""Export rows, their flattened metadata, and sinks."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valora.functions import text as T
from valora.runtime import keep, small_side
from valora.sources.workbook import write_workbook

# The columns of an export row in their order.
COLUMNS = (
    "document_id section_id section_title section_score section_weight dimension_name dimension_score dimension_weight question_id question_text"
    " question_score question_weight justification relevant_text chunk_results criteria_version scale_min scale_max tipo_informe model_name"
    " pipeline_version run_id run_ts"
).split()


def export_rows(rows: DataFrame, scores: dict[str, DataFrame], doc: list[str]) -> DataFrame:
    """Question rows with the recomputed scores of their dimension and section, then their metadata
    columns and the dimension's id (its name where it has none)."""
    base = rows.drop("dimension_score", "section_score")
    dim = scores["dimensions"].select(*doc, "section_id", "dimension_name", "dimension_score")
    sec = scores["sections"].select(*doc, "section_id", "section_score")
    null_safe = lambda a, b, keys: [a[k].eqNullSafe(b[k]) for k in keys]
    k1, k2 = [*doc, "section_id", "dimension_name"], [*doc, "section_id"]
    out = base.join(dim, null_safe(base, dim, k1), "left").select(*(base[c] for c in base.columns), dim["dimension_score"])
    sec = sec.select(*(F.col(c).alias(f"s_{c}") for c in k2), "section_score")
    for_sec = out.join(sec, [out[c].eqNullSafe(sec[f"s_{c}"]) for c in k2], "left").drop(*(f"s_{c}" for c in k2))
    meta = [c for c in for_sec.columns if c.startswith("metadata")]
    if "dimension_id" in for_sec.columns:
        for_sec = for_sec.withColumn("dimension_id", T.first_filled(F.col("dimension_id"), F.col("dimension_name")))
    return for_sec.select(*(c for c in COLUMNS if c in for_sec.columns), *meta, *(["dimension_id"] if "dimension_id" in for_sec.columns else []))


def flat_metadata(meta: Column, fields: list[str]) -> list[Column]:
    """Columns `metadata.a.b` of JSON text by dotted paths; lists stay JSON text."""
    return [F.get_json_object(meta, "$." + f).alias("metadata_" + f.replace(".", "_")) for f in fields]


#: Levels of nesting that are flattened by the engine itself; deeper ones by an Arrow function.
NATIVE_LEVELS = 4


def leaves_of(text: str | None) -> list[tuple[str, str | None]]:
    """(path, value) of every leaf of a JSON object of any depth; lists as JSON text."""
    out: list[tuple[str, str | None]] = []
    top = json.loads(text) if text else {}
    work = [("", top)] if isinstance(top, dict) else []
    while work:
        at, o = work.pop()
        for k, v in o.items():
            path = f"{at}.{k}" if at else k
            if isinstance(v, dict) and v:
                work.append((path, v))
            elif isinstance(v, str) or v is None:
                out.append((path, v))
            else:
                out.append((path, json.dumps(v, ensure_ascii=False, separators=(",", ":"))))
    return out


def flat_leaves(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, path, value): every leaf of JSON objects of any depth; lists as JSON text."""
    spark = df.sparkSession
    v = df.select(id_col, F.try_parse_json(F.col(json_col)).alias("v")).where("v IS NOT NULL")
    out, level = None, v.select(id_col, F.lit("").alias("path"), "v")
    for _ in range(NATIVE_LEVELS):
        nxt = spark.sql(
            f"SELECT `{id_col}`, concat_ws('.', nullif(path, ''), e.key) AS path, e.value AS v, schema_of_variant(e.value) LIKE 'OBJECT<_%' AS is_obj"
            " FROM {level}, LATERAL variant_explode(v) AS e WHERE e.key IS NOT NULL",
            level=level,
        )
        leaf = nxt.where("NOT coalesce(is_obj, false)").select(id_col, "path", F.col("v").cast("string").alias("value"))
        out = leaf if out is None else out.unionByName(leaf)
        level = nxt.where("is_obj").drop("is_obj")
    deeper = F.pandas_udf(lambda c: pd.Series([leaves_of(t) for t in c], dtype=object), "array<struct<path:string,value:string>>").asNondeterministic()
    rest = level.select(id_col, "path", F.explode(deeper(F.to_json("v"))).alias("x"))
    return out.unionByName(rest.select(id_col, F.concat_ws(".", "path", "x.path").alias("path"), F.col("x.value").alias("value")))


def rescaled(score: Column, lo: Column, hi: Column, top: float = 20.0) -> Column:
    """A section's score on the summary's scale from 0 to `top`."""
    return F.when(score.isNotNull() & (hi > lo), F.least(F.greatest((score - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0)) * top)


def safe_names(names: DataFrame, col: str, most: int = 31) -> DataFrame:
    """names with `sheet`: at most `most` characters, without forbidden ones, unique by a suffix _n."""
    base = F.substring(F.regexp_replace(F.col(col), r"[\[\]:*?/\\]", "_"), 1, most)
    n = F.row_number().over(Window.partitionBy(F.lower("sheet")).orderBy(col))
    suffixed = F.concat(F.substring("sheet", 1, most - 3), F.lit("_"), F.col("n").cast("string"))
    return names.withColumn("sheet", base).withColumn("n", n).withColumn("sheet", F.when(F.col("n") == 1, F.col("sheet")).otherwise(suffixed)).drop("n")


def write(rows: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Rows as parquet, csv (with header), json lines or orc: a folder of part files; or as one xlsx workbook."""
    if fmt == "xlsx":
        return write_workbook({"preguntas": rows}, path)
    if fmt not in ("parquet", "csv", "json", "orc"):
        raise ValueError(f"unknown format {fmt!r}")
    w = rows.write.mode("overwrite")
    (w.option("header", True).option("escape", '"') if fmt == "csv" else w).format(fmt).save(path)
    return path


def write_report(rows: DataFrame, metrics: DataFrame, base: str, doc: list[str], extra: dict[str, str] | None = None) -> dict[str, str]:
    """A report's export in all three forms under one base name: a workbook (sheets preguntas and
    indice_global), a CSV with a byte order mark, and JSON documents."""
    payload(rows, doc, metrics, extra).write.mode("overwrite").json(f"{base}.json")
    return {"xlsx": write_workbook({"preguntas": rows, "indice_global": metrics}, f"{base}.xlsx"), "csv": write_single_csv(rows, f"{base}.csv"), "json": f"{base}.json"}


def write_single_csv(rows: DataFrame, path: str, bom: bool = True) -> str:
    """One CSV file for spreadsheet users, with a byte order mark; for reports, not for bulk data.

    Its single part is copied by the file system that holds the path, never through a local disk.
    """
    spark = rows.sparkSession
    tmp = path + ".parts"
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(tmp)
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    source = hadoop.fs.Path(tmp)
    fs = source.getFileSystem(conf)
    part = next(f.getPath() for f in fs.listStatus(source) if f.getPath().getName().endswith(".csv"))
    sink, read = fs.create(hadoop.fs.Path(path), True), fs.open(part)
    try:
        if bom:
            sink.write(bytearray(b"\xef\xbb\xbf"))
        hadoop.io.IOUtils.copyBytes(read, sink, conf, False)
    finally:
        read.close()
        sink.close()
    fs.delete(source, True)
    return path


#: Rows of a report that one JSON document holds; a report with more gives several, numbered ones.
PAYLOAD_ROWS = 10_000


def payload(rows: DataFrame, doc: list[str], metrics: DataFrame | None = None, extra: dict[str, str] | None = None, most: int = PAYLOAD_ROWS) -> DataFrame:
    """(doc, part, parts, payload): every report as JSON documents {sections: [{section_id, questions}],
    metrics, extra} with its rows nested by section.

    A report of more than `most` rows is dealt over several documents by a hash of its rows, so no
    group grows with a report. metrics: one row per report, whose columns go into each document.
    """
    fields = [c for c in rows.columns if c not in doc and c != "section_id"]
    sizes = rows.groupBy(*doc).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts"))
    sizes = sizes.select(*(F.col(d).alias(f"_{d}") for d in doc), "parts")
    same = [F.col(d).eqNullSafe(F.col(f"_{d}")) for d in doc]
    parted = rows.join(small_side(keep(sizes, "payload-sizes")), same).drop(*(f"_{d}" for d in doc)).withColumn("part", F.pmod(F.xxhash64(*fields), F.col("parts")).cast("int") + 1)
    sec = parted.groupBy(*doc, "part", "parts", "section_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("questions"))
    whole = sec.groupBy(*doc, "part", "parts").agg(F.sort_array(F.collect_list(F.struct("section_id", "questions"))).alias("sections"))
    members = [F.col("sections")]
    if metrics is not None:
        own = [c for c in metrics.columns if c not in doc]
        m = metrics.select(*(F.col(d).alias(f"_{d}") for d in doc), F.struct(*own).alias("metrics"))
        whole = whole.join(m, same, "left").drop(*(f"_{d}" for d in doc))
        members.append(F.col("metrics"))
    if extra:
        members.append(F.create_map(*(F.lit(x) for kv in extra.items() for x in kv)).alias("extra"))
    return whole.select(*doc, "part", "parts", F.to_json(F.struct(*members), {"ignoreNullFields": "false"}).alias("payload"))


def payload_rows(payloads: DataFrame, doc: list[str], fields: str) -> DataFrame:
    """The rows that payload() nested: doc, section_id and the fields (a schema) of each question."""
    o = F.from_json("payload", f"sections array<struct<section_id:string,questions:array<struct<{fields}>>>>")
    s = payloads.select(*doc, F.explode(o["sections"]).alias("s"))
    return s.select(*doc, F.col("s.section_id").alias("section_id"), F.explode("s.questions").alias("q")).select(*doc, "section_id", "q.*")


def enriched(rows: DataFrame, score: str, lo: str, hi: str, default_lo: float = 0.0, default_hi: float = 20.0) -> DataFrame:
    """rows with `raw_score` and `normalized_score`: the score, and its share of the scale (defaults where none is stated)."""
    a, b = F.coalesce(F.col(lo), F.lit(default_lo)), F.coalesce(F.col(hi), F.lit(default_hi))
    share = F.when(F.col(score).isNotNull() & (b > a), F.least(F.greatest((F.col(score) - a) / (b - a), F.lit(0.0)), F.lit(1.0)))
    return rows.withColumns({"raw_score": F.col(score), "normalized_score": share})


def field_dictionary(df: DataFrame, sheet: str | None = None) -> DataFrame:
    """(position, field, type, nullable) of a table's columns; with `sheet` named, a first column for it."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields, 1)]
    out = df.sparkSession.createDataFrame(rows, "position int, field string, type string, nullable boolean")
    return out.select(F.lit(sheet).alias("sheet"), "*") if sheet else out


def write_dictionary(tables: dict[str, DataFrame], path: str) -> str:
    """A workbook with the field dictionary of every table, a sheet each."""
    return write_workbook({k: field_dictionary(v) for k, v in tables.items()}, path)


def write_tables(docs: DataFrame, path: str) -> str:
    """The tables of loaded documents as CSV rows (path, table, row, cells joined by tabs), a folder of part files."""
    t = docs.select("path", F.posexplode("tables").alias("table", "rows")).select("path", "table", F.posexplode("rows").alias("row", "cells"))
    t.select("path", "table", "row", F.array_join("cells", "\t").alias("cells")).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path
