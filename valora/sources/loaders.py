"""Report files as documents: dispatch by extension, page splitting, metadata, dead letters."""

from __future__ import annotations

import io
import re
import time
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = (
    "path string, extension string, pages array<string>, tables array<array<array<string>>>, images array<struct<page:int,width:int,height:int,data:binary>>,"
    " was_ocr boolean, issues array<string>, size long, modified timestamp, started timestamp, seconds double"
)
PAGE_CHARS = 4000


@dataclass
class Loaded:
    """What a loader gets out of a file."""

    pages: list[str]
    tables: list[list[list[str]]] = field(default_factory=list)
    images: list[tuple[int, int, int, bytes]] = field(default_factory=list)
    was_ocr: bool = False
    issues: list[str] = field(default_factory=list)


#: A loader gives a Loaded, or (pages, tables).
Loader = Callable[[bytes], "Loaded | tuple[list[str], list[list[list[str]]]]"]


def fixed_pages(text: str, size: int = PAGE_CHARS) -> list[str]:
    return [text[i : i + size] for i in range(0, len(text), size)]


def load_txt(data: bytes) -> tuple[list[str], list]:
    """UTF-8 text without its invalid bytes; pages at form feeds or page marks, else of fixed size."""
    text = data.decode("utf-8", errors="ignore")
    parts = [p for p in re.split(r"\x0c|(?:^|\n)=== PAGE \d+ ===\n?", text) if p.strip()]
    return (parts if len(parts) > 1 else fixed_pages(text)), []


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def load_docx(data: bytes) -> tuple[list[str], list]:
    """Paragraphs with page breaks, else pages of fixed size; tables as rows that hold any text."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    pages: list[list[str]] = [[]]
    tables = []
    body = root.find(f"{_W}body")
    for el in body if body is not None else []:
        if el.tag == f"{_W}p":
            line = ""
            for x in el.iter():
                if x.tag == f"{_W}t":
                    line += x.text or ""
                elif x.tag == f"{_W}br" and x.get(f"{_W}type") == "page":
                    pages[-1].append(line)
                    pages.append([])
                    line = ""
            pages[-1].append(line)
        elif el.tag == f"{_W}tbl":
            rows = [["".join(t.text or "" for t in c.iter(f"{_W}t")).strip() for c in r.iter(f"{_W}tc")] for r in el.iter(f"{_W}tr")]
            tables.append([r for r in rows if any(r)])
    texts = ["\n".join(p).strip() for p in pages]
    texts = [t for t in texts if t]
    return (texts if len(texts) > 1 else fixed_pages("\n".join(texts))), [t for t in tables if t]


def load_pdf(data: bytes) -> Loaded:
    """A PDF by the cascade of pdf.read() with the readers that are installed."""
    from valora.sources import pdf

    return pdf.read(data, pdf.installed())


LOADERS: dict[str, Loader] = {".txt": load_txt, ".docx": load_docx, ".pdf": load_pdf}


def register_loader(extension: str, loader: Loader) -> None:
    """Add or replace the loader of an extension (lower-cased, with a leading dot)."""
    ext = extension.strip().lower()
    if not ext:
        raise ValueError("the extension is empty")
    LOADERS[ext if ext.startswith(".") else "." + ext] = loader


def supported_extensions() -> list[str]:
    return sorted(LOADERS)


def load_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, failures) of all files under a path (DOCUMENT): a file that can't be read is a
    row of failures with its reason, not the end of the run. Files of unknown type are failures."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    loaders = dict(LOADERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, data, n, at in zip(pdf["path"], pdf["content"], pdf["length"], pdf["modificationTime"], strict=True):
                m = re.search(r"(\.[^./\\]+)$", p)
                ext = m.group(1).lower() if m else ""
                began = time.time()
                try:
                    if ext not in loaders:
                        raise ValueError(f"unknown extension {ext!r}")
                    got = loaders[ext](bytes(data))
                    got = got if isinstance(got, Loaded) else Loaded(*got)
                    images = [{"page": i[0], "width": i[1], "height": i[2], "data": i[3]} for i in got.images]
                    out = (p, ext, got.pages, got.tables, images, got.was_ocr, got.issues)
                except Exception as e:  # a broken file must not end the job
                    out = (p, ext, None, [], [], False, [f"{type(e).__name__}: {e}"])
                rows.append((*out, n, at, pd.Timestamp(began, unit="s").floor("us"), time.time() - began))
            yield pd.DataFrame(rows, columns=["path", "extension", "pages", "tables", "images", "was_ocr", "issues", "size", "modified", "started", "seconds"])

    docs = files.mapInPandas(run, DOCUMENT)
    return docs.where("pages IS NOT NULL"), docs.where("pages IS NULL").select("path", "extension", F.col("issues")[0].alias("reason"), "started", "seconds")


def load_events(docs: DataFrame, failures: DataFrame) -> DataFrame:
    """(path, event, at, detail): a start and a success or failure of every file of load_documents()."""
    end = F.timestamp_seconds(F.unix_micros("started") / 1e6 + F.coalesce("seconds", F.lit(0.0)))
    start = docs.select("path", "started").unionByName(failures.select("path", "started"))
    ok = docs.select("path", F.lit("succeeded").alias("event"), end.alias("at"), F.concat(F.size("pages").cast("string"), F.lit(" pages")).alias("detail"))
    bad = failures.select("path", F.lit("failed").alias("event"), end.alias("at"), F.col("reason").alias("detail"))
    return start.select("path", F.lit("started").alias("event"), F.col("started").alias("at"), F.lit(None).cast("string").alias("detail")).unionByName(ok).unionByName(bad)


def load_summary(docs: DataFrame) -> DataFrame:
    """(path, pages, tables, images, issues): counts of what was loaded."""
    return docs.select("path", F.size("pages").alias("pages"), F.size("tables").alias("tables"), F.size("images").alias("images"), F.size(F.array_distinct("issues")).alias("issues"))


#: The key of raw metadata that describes the loader, which becomes a column of its own.
CONTEXT = "loader_context"


def with_metadata(docs: DataFrame, extra: dict[str, str], raw: Column | None = None) -> DataFrame:
    """docs with `metadata` and `loader_context`: base keys, overridden by the extra ones; keys of a raw
    map (a column) only where there are none yet, but for its loader_context."""
    base = F.create_map(
        F.lit("path"), F.col("path"), F.lit("extension"), F.col("extension"), F.lit("pages"), F.size("pages").cast("string"), F.lit("was_ocr"), F.col("was_ocr").cast("string"), F.lit("issues"), F.array_join(F.array_distinct("issues"), "; ")
    )
    more = [x for k, v in extra.items() for x in (F.lit(k), F.lit(v))]
    kept = F.map_filter(base, lambda k, _: ~k.isin(*extra)) if extra else base
    out = F.map_concat(kept, F.create_map(*more)) if more else kept
    if raw is None:
        return docs.withColumns({"metadata": out, CONTEXT: F.lit(None).cast("string")})
    new = F.map_filter(F.coalesce(raw, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, _: (k != CONTEXT) & ~F.array_contains(F.map_keys(out), k))
    return docs.withColumns({"metadata": F.map_concat(out, new), CONTEXT: F.try_element_at(raw, F.lit(CONTEXT))})


def latest_file(spark: SparkSession, folder: str, pattern: str) -> str:
    """The newest file of a folder by its modification time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime")
    row = files.orderBy(F.desc("modificationTime"), F.desc("path")).limit(1).collect()
    if not row:
        raise FileNotFoundError(f"{folder} has no file like {pattern}")
    return row[0]["path"]
