"""PDF files: text by the first reader that finds any, tables, images, and scanned pages by OCR.

Readers are optional. Each is a small adapter, so that the cascade itself needs none of them and can
be tested with stand-ins: it asks the quick reader whether the file has text at all, then takes the
layout reader's pages, else the quick reader's, else those of OCR.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import groupby

from valora.sources.loaders import Loaded

# What a page with text has.
MEANINGFUL = re.compile(r"[A-Za-zÁÉÍÓÚÜÑáéíóúüñ0-9]")
# Pixels below which an image is decoration.
LEAST_PIXELS = 30_000


@dataclass
class Readers:
    """Functions from a file's bytes; None where no library offers one."""

    quick: Callable[[bytes], list[str]] | None = None
    layout: Callable[[bytes], list[str]] | None = None
    tables: tuple[Callable[[bytes], list[list[list[str]]]], ...] = ()
    images: Callable[[bytes], list[tuple[int, int, int, bytes]]] | None = None
    ocr: Callable[[bytes], list[str]] | None = None


def has_text(page: str | None) -> bool:
    """Whether a page's text has a letter or digit."""
    return bool(page and MEANINGFUL.search(page))


def first_meaningful(*tries: Callable[[], str | None]) -> str:
    """The first text with a letter or digit that a try gives; a try that fails gives none."""
    for get in tries:
        try:
            text = (get() or "").strip()
        except Exception:
            continue
        if has_text(text):
            return text
    return ""


def lines_of_chars(chars: list[dict]) -> str:
    """Characters with their places as lines: those of one height, to a tenth of a point, from left to right."""
    at = lambda c: round(c.get("top", 0.0), 1)
    rows = groupby(sorted(chars, key=lambda c: (at(c), c.get("x0", 0.0))), key=at)
    return "\n".join(t for t in ("".join(c.get("text", "") for c in row) for _, row in rows) if t.strip())


def layout_text(page) -> str:
    """A page's text, else its words, else its single characters."""
    text = page.extract_text() or ""
    if text.strip():
        return text
    try:
        words = page.extract_words() or []
    except Exception:
        words = []
    return " ".join(w.get("text", "") for w in words).strip() if words else lines_of_chars(getattr(page, "chars", None) or [])


def real_table(rows: list[list]) -> list[list[str]] | None:
    """A table of at least two rows and columns as texts, else None."""
    return [["" if c is None else str(c).strip() for c in r] for r in rows] if len(rows) >= 2 and len(rows[0]) >= 2 else None


def read(data: bytes, readers: Readers) -> Loaded:
    """The file by the cascade; what a reader can't do is an issue of the file. A scanned file without
    an OCR reader is an error."""
    out = Loaded([])
    quick: list[str] | None = None
    try:
        quick = readers.quick(data) if readers.quick else None
    except Exception as e:
        out.issues.append(f"quick reader: {e}")
    scanned = quick is not None and not any(map(has_text, quick))
    pages: list[str] = []
    if not scanned and readers.layout:
        try:
            pages = readers.layout(data)
        except Exception as e:
            out.issues.append(f"layout reader: {e}")
    if any(p.strip() for p in pages):
        out.pages = pages
    elif quick is not None and not scanned:
        out.pages = quick
    elif readers.ocr:
        out.pages, out.was_ocr = readers.ocr(data), True
    else:
        raise RuntimeError("no PDF reader is installed" if quick is None and not readers.layout else "the file is scanned and no OCR reader is installed")
    if not out.was_ocr:
        for extract in readers.tables:  # the next way only if this one finds none
            try:
                out.tables = [t for t in map(real_table, extract(data)) if t]
            except Exception as e:
                out.issues.append(f"tables: {e}")
            if out.tables:
                break
    if readers.images:
        try:
            out.images = [i for i in readers.images(data) if i[1] * i[2] >= LEAST_PIXELS]
        except Exception as e:
            out.issues.append(f"images: {e}")
    return out


def installed() -> Readers:
    """Adapters of the readers that can be imported: PyMuPDF, pdfplumber, pytesseract."""
    r = Readers()
    try:
        import fitz  # type: ignore

        def quick(data: bytes) -> list[str]:
            with fitz.open(stream=data, filetype="pdf") as doc:
                return [first_meaningful(lambda p=p: p.get_text("text", sort=True), lambda p=p: "\n".join(b[4].strip() for b in p.get_text("blocks") if len(b) > 4), lambda p=p: p.get_text("text")) for p in doc]

        def images(data: bytes) -> list[tuple[int, int, int, bytes]]:
            with fitz.open(stream=data, filetype="pdf") as doc:
                found = [(n, doc.extract_image(x[0])) for n, p in enumerate(doc, 1) for x in p.get_images(full=True)]
            return [(n, i["width"], i["height"], i["image"]) for n, i in found]

        r.quick, r.images = quick, images
    except ImportError:
        pass
    try:
        import pdfplumber  # type: ignore

        def layout(data: bytes) -> list[str]:
            with pdfplumber.open(io.BytesIO(data)) as doc:
                return [layout_text(p) for p in doc.pages]

        def tables_by(strategy: str) -> Callable[[bytes], list[list[list[str]]]]:
            def extract(data: bytes) -> list[list[list[str]]]:
                with pdfplumber.open(io.BytesIO(data)) as doc:
                    return [t for p in doc.pages for t in p.extract_tables({"vertical_strategy": strategy, "horizontal_strategy": strategy})]

            return extract

        r.layout, r.tables = layout, (tables_by("lines"), tables_by("text"))  # by rules, else by the gaps between words
    except ImportError:
        pass
    if r.quick:
        try:
            from valora.sources.ocr import tesseract

            read_image = tesseract()

            def ocr(data: bytes) -> list[str]:
                import fitz  # type: ignore

                with fitz.open(stream=data, filetype="pdf") as doc:
                    return [read_image(p.get_pixmap(dpi=300).tobytes("png")) for p in doc]

            r.ocr = ocr
        except RuntimeError:
            pass
    return r
