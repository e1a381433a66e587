"""Spreadsheet workbooks (xlsx) by the standard library: sheets read as rows, rows written as sheets."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from datetime import date, datetime
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Rows that a sheet of the format can hold, and characters of a cell.
SHEET_ROWS, CELL_CHARS = 1_048_576, 32_767
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def read_sheets(data: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number from 1, cells as texts) of a workbook; cells that are absent are None."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())
    shared: list[str] = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = (rels[s.get(f"{_REL}id")] or "").lstrip("/")
        part = target if target.startswith("xl/") else f"xl/{target}"
        for _, row in ElementTree.iterparse(io.BytesIO(z.read(part))):
            if row.tag != f"{_MAIN}row":
                continue
            cells: list[str | None] = []
            for i, c in enumerate(row.iter(f"{_MAIN}c")):
                at = _column(c.get("r", "")) if c.get("r") else i
                cells += [None] * (at + 1 - len(cells))
                v, kind = c.find(f"{_MAIN}v"), c.get("t")
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif v is not None and v.text is not None:
                    cells[at] = shared[int(v.text)] if kind == "s" else {"1": "true", "0": "false"}.get(v.text, v.text) if kind == "b" else v.text
            yield s.get("name", ""), int(row.get("r") or 0), cells
            row.clear()


def read_workbooks(spark: SparkSession, path: str, sheets: list[str] | None = None) -> DataFrame:
    """(path, sheet, row_no, cells): rows of all workbooks under a path as maps from the sheet's header
    (its first row) to texts. A file that isn't a workbook is a row with its reason as `issue`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, data in zip(pdf["path"], pdf["content"], strict=True):
                rows, header, now = [], [], None
                try:
                    for sheet, n, cells in read_sheets(bytes(data)):
                        if sheets and sheet not in sheets:
                            continue
                        if sheet != now:
                            header, now = [c or f"_{i}" for i, c in enumerate(cells)], sheet
                            continue
                        rows.append((at, sheet, n, {h: c for h, c in zip(header, cells, strict=False) if c is not None}, None))
                except Exception as e:  # a broken file must not end the job
                    rows.append((at, None, None, None, f"{type(e).__name__}: {e}"[:500]))
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "sheet", "row_no", "cells", "issue"]).astype({"row_no": "Int32"})

    return files.mapInPandas(run, "path string, sheet string, row_no int, cells map<string,string>, issue string")


def training_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Export workbooks in the training schema: rows of the sheet `preguntas` with the header values of
    `indice_global`. A workbook without that sheet's row is an error."""
    rows = read_workbooks(spark, path, ["preguntas", "indice_global"])
    head = rows.where("sheet = 'indice_global'").groupBy("path").agg(F.min_by("cells", "row_no").alias("head"))
    q = rows.where("sheet = 'preguntas'").join(head, "path", "left")
    c = lambda k: F.try_element_at("cells", F.lit(k))
    h = lambda k: F.when(F.col("head").isNull(), F.raise_error(F.lit("the sheet indice_global is empty")).cast("string")).otherwise(F.try_element_at("head", F.lit(k)))
    return q.select(
        "path", F.coalesce(h("tipo_informe"), c("tipo_informe")).alias("tipo_informe"), c("section_title").alias("seccion"), c("dimension_name").alias("criterio"), c("question_text").alias("pregunta"), c("relevant_text").alias("texto"),
        c("question_score").try_cast("double").alias("score"), c("justification").alias("justificacion"), h("model_name").alias("model_name"), h("pipeline_version").alias("pipeline_version"),
        c("criteria_version").alias("criteria_version"), F.coalesce(h("timestamp"), h("run_ts")).alias("timestamp"),
    )


def _cell(ref: str, v: object) -> str:
    if v is None or v != v:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, int | float):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    text = v.isoformat() if isinstance(v, date | datetime) else str(v)
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(_BAD.sub("", text))}</t></is></c>'


def _sheet(columns: list[str], rows: Iterable[tuple]) -> Iterator[bytes]:
    yield b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
    yield ('<row r="1">' + "".join(_cell(f"{_letters(i)}1", v) for i, v in enumerate(columns)) + "</row>").encode()
    for n, row in enumerate(rows, 2):
        yield (f'<row r="{n}">' + "".join(_cell(f"{_letters(i)}{n}", v) for i, v in enumerate(row)) + "</row>").encode()
    yield b"</sheetData></worksheet>"


class _Sink:
    """A file of any Hadoop file system that is written from start to end, in large pieces."""

    def __init__(self, spark: SparkSession, path: str):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
        self.held = bytearray()

    def write(self, data: bytes) -> int:
        self.held += data
        if len(self.held) >= 1 << 20:
            self.flush()
        return len(data)

    def flush(self) -> None:
        if self.held:
            self.stream.write(bytearray(self.held))
            self.held = bytearray()

    def close(self) -> None:
        self.flush()
        self.stream.close()


def write_workbook(sheets: dict[str, DataFrame], path: str) -> str:
    """Tables as the sheets of one workbook, for reports, not for bulk data.

    Rows are streamed partition by partition. A table with more rows than a sheet holds goes on in
    sheets numbered _2, _3 and so on; a text longer than a cell holds is an error. Arrays, maps and
    structs are JSON text. The file is streamed to the file system that holds the path.
    """
    spark = next(iter(sheets.values())).sparkSession
    sink = _Sink(spark, path)
    z = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED)
    names: list[str] = []

    def flat(df: DataFrame) -> DataFrame:
        return df.select(*(F.to_json(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f"`{f.name}`") for f in df.schema.fields))

    def put(name: str, columns: list[str], rows: Iterator[tuple]) -> bool:
        """One sheet; whether rows are left."""
        names.append(name[:31])
        more = False

        def some() -> Iterator[tuple]:
            nonlocal more
            for k, r in enumerate(rows, 1):
                if any(isinstance(v, str) and len(v) > CELL_CHARS for v in r):
                    raise ValueError(f"a cell of sheet {name} has more than {CELL_CHARS} characters")
                yield r
                if k == SHEET_ROWS - 1:
                    more = True
                    return

        with z.open(f"xl/worksheets/sheet{len(names)}.xml", "w") as f:
            for chunk in _sheet(columns, some()):
                f.write(chunk)
        return more

    for name, df in sheets.items():
        rows, k = (tuple(r) for r in flat(df).toLocalIterator()), 1
        while put(name if k == 1 else f"{name[:27]}_{k}", df.columns, rows):
            k += 1
    ids = range(1, len(names) + 1)
    kinds = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in ids) + "</Types>")
    z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{kinds}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
    z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{kinds}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in ids) + "</Relationships>")
    z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{kinds}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(ids, names, strict=True)) + "</sheets></workbook>")
    z.close()
    sink.close()
    return path
