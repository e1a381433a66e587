"""Section schemas: JSON files that name the sections of a report type, with titles, aliases and bounds."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass
class SectionSchema:
    """What is looked for: titles with aliases, keywords, and each section's own bounds."""

    titles: dict[str, list[str]] = field(default_factory=dict)
    keywords: dict[str, list[str]] = field(default_factory=dict)
    fuzzy: float = 86.0
    own_fuzzy: dict[str, float] = field(default_factory=dict)
    keyword_share: float | None = None
    own_keyword_share: dict[str, float] = field(default_factory=dict)


def _number(x: object) -> float | None:
    return float(x) if isinstance(x, int | float) and not isinstance(x, bool) else None


def parse_schema(text: str, name: str = "schema") -> SectionSchema:
    """A schema from its JSON text; members whose names begin with __ configure it.

    Anything that isn't an object of sections with a title, and lists of aliases and keywords, is a
    ValueError that names the section.
    """
    try:
        raw = json.loads(text)
    except ValueError as e:
        raise ValueError(f"{name} is not JSON: {e}") from e
    if not isinstance(raw, dict):
        raise ValueError(f"{name} must be an object with a member per section")
    out = SectionSchema()
    for key, v in raw.items():
        if key.startswith("__"):
            if isinstance(v, dict):
                out.fuzzy = _number(v.get("default_fuzzy_threshold")) or out.fuzzy
                out.keyword_share = _number(v.get("default_keyword_min_ratio")) or out.keyword_share
            continue
        if not isinstance(v, dict) or "title" not in v:
            raise ValueError(f"section {key} of {name} has no title")
        aliases, words = v.get("aliases", []), v.get("keywords", [])
        if not isinstance(aliases, list) or not isinstance(words, list):
            raise ValueError(f"aliases and keywords of section {key} of {name} must be lists")
        out.titles[key] = [v["title"], *(a for a in aliases if isinstance(a, str))]
        out.keywords[key] = [w for w in words if isinstance(w, str)]
        for own, member in ((out.own_fuzzy, "fuzzy_threshold"), (out.own_keyword_share, "keyword_min_ratio")):
            x = _number(v.get(member))
            if x is not None:
                own[key] = x
    return out


_SEEN: dict[tuple[str, int, int], SectionSchema] = {}


def read_schema(spark: SparkSession, path: str) -> SectionSchema:
    """The schema of a file on any file system, remembered until the file changes."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop)
    key = (path, status.getModificationTime(), status.getLen())
    if key not in _SEEN:
        _SEEN[key] = parse_schema(spark.read.text(path, wholetext=True).first()[0], path)
    return _SEEN[key]
