"""Scanned pages as text, one row per page, with errors kept by page."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

OCR = "document_id string, page_index int, ocr_text string, error_text string"
#: Pixels beyond which a page is not read.
MAX_PIXELS = 35_000_000


def tesseract(languages: str = "spa+eng", config: str = "--psm 6") -> Callable[[bytes], str]:
    """A reader by pytesseract and Pillow, if both are installed."""
    try:
        import io

        import pytesseract  # type: ignore
        from PIL import Image  # type: ignore
    except ImportError as e:
        raise RuntimeError("pytesseract and Pillow are not installed") from e

    def read(image: bytes) -> str:
        img = Image.open(io.BytesIO(image))
        if img.width * img.height > MAX_PIXELS:
            raise ValueError("imagen demasiado grande")
        return pytesseract.image_to_string(img, lang=languages, config=config)

    return read


def read_pages(images: DataFrame, make_reader: Callable[[], Callable[[bytes], str]] = tesseract, per_core: int = 4) -> DataFrame:
    """(document_id, page_index, ocr_text, error_text) of rows (document_id, page_index, image).

    Pages are spread evenly first, since reading one takes seconds; a page that fails is a row with
    its error and null text.
    """
    n = images.sparkSession.sparkContext.defaultParallelism * per_core

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, broken = None, None
        try:
            reader = make_reader()
        except Exception as e:  # without a reader every page is an error
            broken = str(e)
        for pdf in batches:
            rows = []
            for d, p, img in zip(pdf["document_id"], pdf["page_index"], pdf["image"], strict=True):
                try:
                    if reader is None:
                        raise RuntimeError(broken)
                    rows.append((d, p, reader(bytes(img)), None))
                except Exception as e:
                    rows.append((d, p, None, str(e)[:500]))
            yield pd.DataFrame(rows, columns=["document_id", "page_index", "ocr_text", "error_text"])

    return images.select("document_id", "page_index", "image").repartition(n).mapInPandas(run, OCR)
