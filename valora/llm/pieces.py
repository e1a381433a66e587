"""Oversized texts cut at natural boundaries (problem 6).

Method: lexical-cohesion segmentation. Two blocks of BLOCK words slide along the text, one before
and one after every gap of STEP words; the cosine of their hashed word counts is the cohesion there.
A boundary takes the cohesion of the nearest gap, and its depth is how far cohesion rises to either
side of it until it falls again; valleys mark changes of topic. Each size window (from LEAST of the
limit to the limit) is cut at the deepest valley among its paragraph and sentence ends, paragraph
ends counting PARAGRAPH deeper; without any, at the deepest valley among its word ends. Only where a
window has no white space at all is the cut forced. Then the next piece starts up to `overlap`
characters before the cut, at a word start.

Nothing is shuffled: a text is cut where it is read, and pieces are offsets until they are needed.

Defined results: a null text has null pieces; a text within the limit is one piece as it stands;
a blank text over the limit is one empty piece; white space before, between and after pieces belongs to none;
repeated rows are cut alike; an empty table gives an empty table; further columns pass through, and
those named like an added one (`pieces`, `piece_index`, `piece_start`, `cut_kind`) are replaced. Texts are processed whole, of any length.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valora.runtime import spread

LIMIT = 1500
OVERLAP = 150
#: Words in each of the two blocks that are compared, words between gaps, and the hashed words' dimensions.
BLOCK = 60
STEP = 10
DIMENSIONS = 128
#: Share of the limit that a piece has at least, and how much deeper a paragraph's end counts.
LEAST = 0.25
PARAGRAPH = 0.1

_WORD = re.compile(r"[^\W\d_]{4,}")
_GAP = re.compile(r"\s+")
# after these a sentence is over if a capital, a digit of a list or an opening mark follows
_ENDERS = ".!?…»”\"')]"


def _boundaries(text: str) -> tuple[list[int], list[int], list[int], list[int]]:
    """(word ends, starts of the next words, sentence ends, paragraph ends)."""
    ends, starts, sentence, paragraph = [], [], [], []
    n = len(text)
    for m in _GAP.finditer(text):
        a, b = m.span()
        if a == 0 or b == n:
            continue
        ends.append(a)
        starts.append(b)
        if "\n" in m.group():
            paragraph.append(a)
            sentence.append(a)
        elif text[a - 1] in _ENDERS and any(c in ".!?…" for c in text[max(0, a - 2) : a]) and (text[b].isupper() or text[b] in "¿¡«“\"(-•"):
            sentence.append(a)
    return ends, starts, sentence, paragraph


class Cohesion:
    """The depth of the valley of lexical cohesion at any position of a text."""

    def __init__(self, text: str):
        seen: dict[str, int] = {}
        at, code = [], []
        for m in _WORD.finditer(text):
            w = m.group().lower()
            c = seen.get(w)
            if c is None:
                c = seen[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % DIMENSIONS
            at.append(m.start())
            code.append(c)
        n = len(code)
        gaps = np.arange(STEP, n, STEP)
        self.gap_at = np.array(at, np.int64)[gaps] if len(gaps) else np.zeros(0, np.int64)
        codes, sim = np.array(code, np.int64), np.ones(len(gaps))
        for lo in range(0, len(gaps), 512):  # stretches of gaps, so that long texts take little memory
            g = gaps[lo : lo + 512]
            a, b = max(0, int(g[0]) - BLOCK), min(n, int(g[-1]) + BLOCK)
            sums = np.zeros((b - a + 1, DIMENSIONS), np.float32)
            sums[np.arange(1, b - a + 1), codes[a:b]] = 1
            np.cumsum(sums, axis=0, out=sums)
            left = sums[g - a] - sums[np.maximum(g - BLOCK, a) - a]
            right = sums[np.minimum(g + BLOCK, b) - a] - sums[g - a]
            norm = np.sqrt((left**2).sum(1) * (right**2).sum(1))
            sim[lo : lo + 512] = (left * right).sum(1) / np.maximum(norm, 1e-9)
        self.depth = _climb(sim) + _climb(sim[::-1])[::-1] - 2 * sim

    def at(self, places: np.ndarray) -> np.ndarray:
        """The depth at the gap nearest to each place; a place without gaps around it has none."""
        if not len(self.gap_at):
            return np.zeros(len(places))
        k = np.searchsorted(self.gap_at, places)
        lo, hi = np.maximum(k - 1, 0), np.minimum(k, len(self.gap_at) - 1)
        near = np.where(np.abs(self.gap_at[lo] - places) <= np.abs(self.gap_at[hi] - places), lo, hi)
        return self.depth[near]


def _climb(sim: np.ndarray) -> np.ndarray:
    """The height that is reached by going left from each value until values fall."""
    top = sim.tolist()
    for i in range(1, len(top)):
        if sim[i - 1] >= sim[i]:
            top[i] = top[i - 1]
    return np.array(top)


def _deepest(ends: list[int], paragraph: set[int], cohesion: Cohesion) -> int:
    """The boundary with the deepest valley, the last of equals."""
    if len(ends) == 1:
        return ends[0]
    depth = cohesion.at(np.array(ends)) + np.array([PARAGRAPH if e in paragraph else 0.0 for e in ends])
    return ends[len(ends) - 1 - int(depth[::-1].argmax())]


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, bool]]:
    """(start, end, overlap with the piece before, forced) of every piece; offsets in code points from 0."""
    n = len(text)
    if n <= limit:
        return [(0, n, 0, False)]
    ends, starts, sentence, paragraph = _boundaries(text)
    last_end = len(text.rstrip())
    first = n - len(text.lstrip())
    if last_end == 0:
        return [(0, 0, 0, False)]
    cohesion, paragraph_ends = None, set(paragraph)
    out = []
    s, done = first, 0  # start of the piece, and up to where text is covered
    while True:
        over = max(0, done - s) if out else 0
        if last_end - s <= limit:
            out.append((s, last_end, over, False))
            return out
        hi = s + limit
        lo = max(done + 1, s + int(limit * LEAST))
        e, forced = None, False
        for marks in (sentence, ends):
            c = marks[bisect_left(marks, lo) : bisect_right(marks, hi)]
            if c:
                cohesion = cohesion or Cohesion(text)
                e = _deepest(c, paragraph_ends, cohesion)
                break
        if e is None:  # the last word end that goes beyond what is covered
            i = bisect_right(ends, hi) - 1
            if i >= 0 and ends[i] > max(done, s):
                e = ends[i]
            else:
                e, forced = hi, True
        out.append((s, e, over, forced))
        done = e
        if forced:
            # inside a stretch without white space any place is as good as another
            nxt = max(e - overlap, out[-1][0] + 1)
            s = nxt if _fits(ends, nxt, e, limit, last_end) or not _fits(ends, e, e, limit, last_end) else e
            continue
        fresh = starts[bisect_left(ends, e)]
        i = bisect_left(starts, e - overlap)
        s = fresh
        while i < len(starts) and starts[i] < fresh:  # the earliest word start whose piece still ends naturally
            if starts[i] > out[-1][0] and _fits(ends, starts[i], fresh, limit, last_end):
                s = starts[i]
                break
            i += 1


def _fits(ends: list[int], start: int, beyond: int, limit: int, last_end: int) -> bool:
    """Whether a piece from start can end at a word end past `beyond`."""
    if last_end - start <= limit:
        return True
    i = bisect_right(ends, start + limit) - 1
    return i >= 0 and ends[i] > beyond


PIECES = "array<struct<start:int,end:int,overlap:int,forced:boolean>>"


def with_pieces(df: DataFrame, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """df with `pieces`: the offsets of every text's pieces."""
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("the limit must be positive and the overlap less than it")

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else cut(t, limit, overlap) for t in texts], dtype=object)

    # told to be nondeterministic, or an explode's filter would cut every text a second time
    cut_ = F.pandas_udf(run, PIECES).asNondeterministic()
    return spread(df).withColumn("pieces", cut_(F.col(text_col)))


def _meta(meta: Column, p: Column, i: Column, count: Column) -> Column:
    """chunk_metadata of a piece: its own id, index, count, length and overlap; the rest as it was."""
    fresh = {
        "id": F.concat_ws("-", meta["id"], (i + 1).cast("string")),
        "chunk_index": i + 1,
        "chunks_in_source": count,
        "length": p["end"] - p["start"],
        "chunk_overlap": p["overlap"],
        "was_truncated": F.lit(False),
    }
    names = ["id", "source_type", "strategy", "chunk_index", "chunks_in_source", "length", "chunk_overlap", "page", "relevance", "was_truncated"]
    return F.struct(*(fresh.get(x, meta[x]).alias(x) for x in names))


def split_texts(df: DataFrame, text_col: str, meta_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece of every text: df's columns with the piece's text and metadata in place of
    the whole's, then piece_index (from 1), piece_start (from 1) and cut_kind of the piece's end."""
    df = df.drop("pieces", "piece_pos", "piece", "piece_index", "piece_start", "cut_kind")
    cut_ = with_pieces(df, text_col, limit, overlap)
    rows = cut_.select("*", F.posexplode("pieces").alias("piece_pos", "piece"))
    p, i = F.col("piece"), F.col("piece_pos")
    made = {
        text_col: F.substring(F.col(text_col), p["start"] + 1, p["end"] - p["start"]).alias(text_col),
        meta_col: F.when(F.size("pieces") == 1, F.col(meta_col)).otherwise(_meta(F.col(meta_col), p, i, F.size("pieces"))).alias(meta_col),
    }
    return rows.select(
        *(made.get(c, F.col(c)) for c in df.columns),
        (i + 1).alias("piece_index"),
        (p["start"] + 1).alias("piece_start"),
        F.when(p["forced"], "forced").otherwise("natural").alias("cut_kind"),
    )


def piece_checks(df: DataFrame, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row: texts, those over the limit (long_texts), and those with a piece over the limit, an
    overlap over its bound, or characters other than white space in no piece."""
    c, t = with_pieces(df.select(F.col(text_col).alias("t")), "t", limit, overlap), F.col("t")
    p, n = F.col("pieces"), F.size("pieces")
    filled = lambda a, b: F.substring(t, a + 1, b - a).rlike(r"(?U)\S")
    between = F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (i < n) & (F.get(p, i)["start"] > F.get(p, i - 1)["end"]) & filled(F.get(p, i - 1)["end"], F.get(p, i)["start"]))
    ends = filled(F.lit(0), F.get(p, F.lit(0))["start"]) | filled(F.get(p, n - 1)["end"], F.length(t))
    one = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    return c.agg(
        F.count("t").alias("texts"), one(F.length(t) > limit).alias("long_texts"), one((F.length(t) > limit) & F.exists(p, lambda x: x["end"] - x["start"] > limit)).alias("over_limit"),
        one(F.exists(p, lambda x: x["overlap"] > overlap)).alias("over_overlap"), one(between | ends).alias("uncovered"),
    )
