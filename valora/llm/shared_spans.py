"""Long exact spans shared between records (problem 9).

Two operators:

*Sentence runs* (`sentence_runs`, for `shared_share` and `without_repeats`), by the method named:
from every sentence of a text the shortest run of at least SENTENCES consecutive sentences with at
least WINDOW characters is hashed; the hashes are joined globally; runs that two records have tell
how much of a record is shared, and sentences that a run covers are removed from all records but the
first that has it.

*Exact spans* (`shared_spans`): sentences can't give spans that are exact to the character, since a
shared stretch may begin and end inside sentences, and may hold no whole one. So among the
positions of each stretch of WINDOW - RUN + 1 characters one anchor is chosen by the content alone:
a sentence boundary before a word boundary before any other, the least hash among equals, the
leftmost among those; the run of RUN characters there is hashed. Two texts that share WINDOW
characters choose the same anchor in them, so its run, which lies within, is hashed in both.

Widening works without pairs. An anchor's *reach* is the stretch of all windows that chose it.
Anchors of one run hash are grouped by the hash of their reach: reaches that two records have are
shared as a whole; only where a run hash has several reaches, one record of each reach has its
windows (at most WINDOW - RUN + 1) hashed one by one, and windows that two records have are shared.
The steps that find what is shared are hash aggregations with partial sums; where they are joined
back, a passage that a third of all records hold is dealt over several tasks.

Hashes have 64 bits over mixed code points, and a match needs two of them to agree: that of the run,
and that of the reach or window around it, or two of a run of sentences.

Defined results: null texts, empty texts and texts shorter than WINDOW have no spans and no runs; a
text of less than SENTENCES sentences has no runs; a passage
repeated only within one record is not shared; repeated rows (equal text under another id) are
shared as a whole; rows with a null id are left out; an empty table gives an empty table; further
columns are not read. Texts are processed whole, of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from valora.runtime import BROADCAST_ROWS, keep, small_side, spread, spread_join

WINDOW = 300
RUN = 150
#: Consecutive sentences that a run of sentences has at least.
SENTENCES = 2

_POS_BITS = 24
_POS = np.uint64((1 << _POS_BITS) - 1)
#: An odd multiplier, and its inverse modulo 2**64.
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
#: Characters that are hashed at once. Longer texts are hashed in segments that overlap by a window
#: less one character, so that every window lies in one; a reach that a segment's end cuts is but a
#: reach of its own.
_BATCH = 2_000_000


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    np.multiply.accumulate(out, out=out)
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any stretch of a buffer of code points, from prefix sums modulo 2**64."""

    def __init__(self, points: np.ndarray, kind: int = 0, like: Rolling | None = None):
        self.pow, self.inv = (like.pow, like.inv) if like else (_powers(_P, len(points)), _powers(_P_INV, len(points)))
        table = _mix(np.arange(int(points.max(initial=0)) + 1, dtype=np.uint64) + np.uint64(kind << 32))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(table[points] * self.pow[: len(points)])))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inv[start])


def _slide_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every stretch of w values, from running minima of blocks of w."""
    n = len(x)
    pad = -n % w
    b = np.concatenate((x, np.full(pad, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, w)
    left = np.minimum.accumulate(b, axis=1).ravel()
    right = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


_SPACE = np.zeros(0x3001, bool)
for _c in range(0x3001):
    _SPACE[_c] = chr(_c).isspace()
_STOP = np.zeros(0x3001, bool)
for _c in ".!?:;…":
    _STOP[ord(_c)] = True


def _in(table: np.ndarray, points: np.ndarray) -> np.ndarray:
    return table[np.minimum(points, len(table) - 1)] & (points < len(table))


def _lay(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts end to end, and each one's start and end."""
    ends = np.cumsum(np.fromiter((len(t) for t in texts), np.int64, len(texts)))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate(([0], ends[:-1])).astype(np.int64), ends


def anchors_of(texts: list[str], window: int = WINDOW, run: int = RUN) -> pd.DataFrame:
    """(t, a, lo, hi, h, r): anchors of each text t that has at least window characters.

    a: position of the anchor; lo..hi: starts of the windows that chose it (all within the text,
    from 0); h: hash of the run at a; r: hash of the reach, text[lo : hi + window], and of where the
    anchor lies in it.
    """
    points, start, end = _lay(texts)
    n = len(points)
    if n < window:
        return pd.DataFrame({k: np.zeros(0, np.int64) for k in ("t", "a", "lo", "hi", "h", "r")})
    roll = Rolling(points)
    at = np.arange(n - run + 1)
    h = roll.of(at, at + run)
    gap = _in(_SPACE, points)
    # told by characters of the run alone, never by what stands before it
    word, sentence = np.zeros(n, bool), np.zeros(n, bool)
    word[:-1] = gap[:-1] & ~gap[1:]
    sentence[:-1] = (_in(_STOP, points[:-1]) & gap[1:]) | (points[:-1] == 10)
    rank = (np.where(sentence, 0, np.where(word, 1, 2)).astype(np.uint64) << np.uint64(62))[: len(h)]
    key = rank | ((h >> np.uint64(2 + _POS_BITS)) << np.uint64(_POS_BITS)) | at.astype(np.uint64)
    chosen = (_slide_min(key, window - run + 1) & _POS).astype(np.int64)
    p = np.arange(len(chosen))
    t = np.searchsorted(end, p, "right")
    ok = p + window <= end[t]
    p, t, a = p[ok], t[ok], chosen[ok]
    if not len(p):
        return pd.DataFrame({k: np.zeros(0, np.int64) for k in ("t", "a", "lo", "hi", "h", "r")})
    new = np.concatenate(([True], (np.diff(a) != 0) | (np.diff(t) != 0)))
    lo, first = p[new], np.flatnonzero(new)
    hi = p[np.concatenate((first[1:], [len(p)])) - 1]
    a, t = a[new], t[new]
    r = _mix(roll.of(lo, hi + window) ^ _mix((a - lo).astype(np.uint64)))
    s = start[t]
    return pd.DataFrame({"t": t, "a": a - s, "lo": lo - s, "hi": hi - s, "h": h[a].view(np.int64), "r": r.view(np.int64)})


def segments(texts: list[str], window: int, most: int = _BATCH) -> Iterator[tuple[list[str], list[int], list[int]]]:
    """The texts in groups of at most `most` characters: (pieces, text numbers, offsets)."""
    held: tuple[list[str], list[int], list[int]] = ([], [], [])
    size = 0
    for k, t in enumerate(texts):
        for o in range(0, max(1, len(t) - window + 1), most - window + 1):
            piece = t if len(t) <= most else t[o : o + most]
            if held[0] and size + len(piece) > most:
                yield held
                held, size = ([], [], []), 0
            for x, y in zip(held, (piece, k, o), strict=True):
                x.append(y)
            size += len(piece)
            if len(t) <= most:
                break
    if held[0]:
        yield held


ANCHOR_SCHEMA = "doc long, h long, r long, a int, lo int, hi int"


def anchors(df: DataFrame, id_col: str, text_col: str, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """anchors_of() for every row of df, as ANCHOR_SCHEMA."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            doc = pdf["doc"].to_numpy()
            for pieces, owner, offset in segments(pdf["text"].tolist(), window):
                out = anchors_of(pieces, window, run)
                t = out["t"].to_numpy()
                at = np.array(offset, np.int64)[t]
                out = out.assign(doc=doc[np.array(owner)[t]], a=out["a"] + at, lo=out["lo"] + at, hi=out["hi"] + at)
                yield out[["doc", "h", "r", "a", "lo", "hi"]].astype({"a": np.int32, "lo": np.int32, "hi": np.int32})

    src = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where(f"doc IS NOT NULL AND length(text) >= {window}")
    return spread(src).mapInPandas(scan, ANCHOR_SCHEMA)


def window_hashes(docs: DataFrame, window: int) -> DataFrame:
    """Rows (doc, text, reaches of (h, r, a, lo, hi)) -> one row per window: (w, h, r, off)."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            reach = [(t[x["lo"] : x["hi"] + window], x) for t, xs in zip(pdf["text"], pdf["reaches"], strict=True) for x in xs]
            for lo in range(0, len(reach), 4000):
                part = reach[lo : lo + 4000]
                points, start, _ = _lay([t for t, _ in part])
                roll = Rolling(points)
                n = np.array([len(t) - window + 1 for t, _ in part])
                k = np.repeat(np.arange(len(part)), n)
                off = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
                p = start[k] + off
                of = lambda f: np.array([x[f] for _, x in part], np.int64)
                yield pd.DataFrame({"w": roll.of(p, p + window).view(np.int64), "h": of("h")[k], "r": of("r")[k], "off": (off + (of("lo") - of("a"))[k]).astype(np.int32)})

    return docs.select("doc", "text", "reaches").mapInPandas(scan, "w long, h long, r long, off int")


def shared_windows(df: DataFrame, id_col: str, text_col: str, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """(doc, p0, p1, first_doc): starts p0..p1 (from 0) of windows that another record has too.

    first_doc is the smallest id that has the window at p0.
    """
    found = keep(anchors(df, id_col, text_col, window, run), "p9-anchors")
    two = keep(found.groupBy("h").agg(F.min("doc").alias("d0"), F.max("doc").alias("d1"), F.count(F.lit(1)).alias("n")).where("d0 <> d1").select("h", "n"), "p9-runs")
    n = two.count()
    runs = two.select("h")
    hit = keep(found.join(small_side(runs, n), "h") if n <= BROADCAST_ROWS else spread_join(found, runs, ["h"], ["doc", "a"], two), "p9-hits")
    reach = hit.groupBy("h", "r").agg(F.min("doc").alias("d0"), F.max("doc").alias("d1"), F.min(F.struct("doc", "a", "lo", "hi")).alias("one"), F.count(F.lit(1)).alias("n"))
    several = reach.groupBy("h").agg(F.count(F.lit(1)).alias("reaches"))
    reach = keep(reach.join(several, "h"), "p9-reaches")
    # run hashes with one reach: two records have it as a whole
    whole = reach.where("reaches = 1 AND d0 <> d1").select("h", "r", F.col("d0").alias("first_doc"))
    parted = reach.where("reaches > 1")
    per_doc = keep(
        parted.select("h", "r", "one.*").groupBy("doc").agg(F.collect_list(F.struct("h", "r", "a", "lo", "hi")).alias("reaches")),
        "p9-parted",
    )
    src = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where(f"length(text) >= {window}")
    texts = src.join(small_side(per_doc.select("doc")), "doc", "left_semi").join(per_doc, "doc")
    hashed = keep(window_hashes(texts, window), "p9-windows")
    owner = parted.select("h", "r", "d0", "d1")
    full = hashed.join(small_side(owner, parted.count()), ["h", "r"])
    same = ["h", "off", "w"]  # equal windows have equal anchors, so the run's hash adds its bits to the window's
    good = full.groupBy(*same).agg(F.min("d0").alias("first_doc"), F.max("d1").alias("d1")).where("first_doc <> d1").select(*same, "first_doc")
    part = (
        hashed.join(good, same)
        .groupBy("h", "r")
        .agg(F.sort_array(F.collect_set(F.struct("off", "first_doc"))).alias("offs"))  # at most window - run + 1
    )
    size = reach.select("h", "r", "n")
    by_whole = spread_join(hit, whole, ["h", "r"], ["doc", "a"], size).select("doc", F.col("lo").alias("p0"), F.col("hi").alias("p1"), "first_doc")
    by_part = (
        spread_join(hit, part, ["h", "r"], ["doc", "a"], size)
        .select("doc", "a", F.explode("offs").alias("o"))
        .select("doc", (F.col("a") + F.col("o.off")).alias("p0"), (F.col("a") + F.col("o.off")).alias("p1"), F.col("o.first_doc").alias("first_doc"))
    )
    return by_whole.unionByName(by_part)


def shared_spans(df: DataFrame, id_col: str, text_col: str, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """(doc, span_start, span_len): the longest unbroken shared stretches of each record, from 1.

    Windows are merged within one record, whose number of windows its own length bounds.
    """
    w = shared_windows(df, id_col, text_col, window, run).groupBy("doc", "p0").agg(F.max("p1").alias("p1"))
    by = Window.partitionBy("doc").orderBy("p0")
    reach = F.max(F.col("p1") + window).over(by.rowsBetween(Window.unboundedPreceding, -1))
    piece = w.withColumn("new", F.when(reach.isNull() | (F.col("p0") > reach), 1).otherwise(0)).withColumn("k", F.sum("new").over(by))
    return piece.groupBy("doc", "k").agg(F.min("p0").alias("s"), F.max(F.col("p1") + window).alias("e")).select("doc", (F.col("s") + 1).alias("span_start"), (F.col("e") - F.col("s")).alias("span_len"))


# ---- runs of sentences --------------------------------------------------------------------------


def sentence_starts(points: np.ndarray) -> np.ndarray:
    """Where sentences begin: at the first character that isn't white space, after white space that
    follows a stop or holds a line feed. 0 always begins one."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    gap = _in(_SPACE, points)
    first = np.flatnonzero(~gap[1:] & gap[:-1]) + 1  # after white space
    filled = np.flatnonzero(~gap)
    if not len(first):
        return np.zeros(1, np.int64)
    before = np.searchsorted(filled, first)  # how many characters that are none stand before it
    ok = before > 0
    end = np.where(ok, filled[np.maximum(before - 1, 0)], -1)  # the last of them
    feeds = np.concatenate(([0], np.cumsum(points == 10)))
    stop = ok & _in(_STOP, points[np.maximum(end, 0)])
    return np.concatenate(([0], first[stop | (feeds[first] > feeds[end + 1])]))


RUN_SCHEMA = "doc long, h long, h2 long, s long, e long"


def runs_of(text: str, window: int, sentences: int) -> tuple[np.ndarray, ...]:
    """(hash, second hash, start, end) of the runs of sentences of one text, from 0."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    start = sentence_starts(points)
    gap = _in(_SPACE, points)
    filled = np.flatnonzero(~gap)
    bound = np.append(start[1:], len(points))
    end = np.zeros(len(start), np.int64)  # of each sentence, without the white space after it
    if len(filled):
        at = np.searchsorted(filled, bound) - 1
        end = np.where(at >= 0, filled[np.maximum(at, 0)] + 1, 0)
    ok = end > start  # a blank start of the text is no sentence
    start, end = start[ok], end[ok]
    if not len(start):
        return (np.zeros(0, np.int64),) * 4
    k = np.maximum(np.searchsorted(end, start + window), np.arange(len(start)) + sentences - 1)
    s, e = start[k < len(end)], end[k[k < len(end)]]
    roll = Rolling(points)
    h = roll.of(s, e).view(np.int64)
    return h, Rolling(points, 1, roll).of(s, e).view(np.int64), s, e


def sentence_runs(df: DataFrame, id_col: str, text_col: str, window: int = WINDOW, sentences: int = SENTENCES) -> DataFrame:
    """RUN_SCHEMA: from every sentence the shortest run of at least `sentences` and `window` characters."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, text in zip(pdf["doc"], pdf["text"], strict=True):
                h, h2, s, e = runs_of(text, window, sentences)
                if len(h):
                    yield pd.DataFrame({"doc": doc, "h": h, "h2": h2, "s": s, "e": e})

    src = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where(f"doc IS NOT NULL AND length(text) >= {window}")
    return spread(src).mapInPandas(scan, RUN_SCHEMA)


def shared_runs(df: DataFrame, id_col: str, text_col: str, window: int = WINDOW, sentences: int = SENTENCES) -> DataFrame:
    """(doc, s, e, is_first): runs of sentences that two records have; is_first marks those of the
    record with the smallest id."""
    runs = keep(sentence_runs(df, id_col, text_col, window, sentences), "p9-sentence-runs")
    key = ["h", "h2"]
    met = runs.groupBy(*key).agg(F.min("doc").alias("first_doc"), F.max("doc").alias("d1"), F.count(F.lit(1)).alias("n")).where("first_doc <> d1")
    met = keep(met.select(*key, "first_doc", "n"), "p9-shared-runs")
    m = met.count()
    one = met.select(*key, "first_doc")
    both = runs.join(small_side(one, m), key) if m <= BROADCAST_ROWS else spread_join(runs, one, key, ["doc", "s"], met)
    return both.select("doc", "s", "e", (F.col("doc") == F.col("first_doc")).alias("is_first"))


def merged(spans: DataFrame) -> DataFrame:
    """(doc, s, e): overlapping or touching spans of a record as one."""
    by = Window.partitionBy("doc").orderBy("s")
    reach = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    piece = spans.groupBy("doc", "s").agg(F.max("e").alias("e")).withColumn("new", F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0)).withColumn("k", F.sum("new").over(by))
    return piece.groupBy("doc", "k").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("k")


def shared_share(df: DataFrame, id_col: str, text_col: str, window: int = WINDOW, sentences: int = SENTENCES) -> DataFrame:
    """(doc, chars, shared_chars, share) of every record: how much of it lies in shared runs of
    sentences, 0 where nothing does."""
    spans = merged(shared_runs(df, id_col, text_col, window, sentences)).groupBy("doc").agg(F.sum(F.col("e") - F.col("s")).alias("shared_chars"))
    base = df.select(F.col(id_col).alias("doc"), F.coalesce(F.length(text_col), F.lit(0)).alias("chars"))
    n = F.coalesce("shared_chars", F.lit(0))
    return base.join(spans, "doc", "left").select("doc", "chars", n.alias("shared_chars"), F.round(F.coalesce(F.try_divide(n, F.col("chars")), F.lit(0.0)), 6).alias("share"))


def without_repeats(df: DataFrame, id_col: str, text_col: str, window: int = WINDOW, sentences: int = SENTENCES) -> DataFrame:
    """df with `kept_text`: without the sentences that a repeated run covers, but for the first record's.

    Of the records that share a run the one with the smallest id keeps it; a removed sentence takes
    the white space after it along.
    """
    df = df.drop("spans", "kept_text")
    later = merged(shared_runs(df, id_col, text_col, window, sentences).where("NOT is_first").select("doc", "s", "e"))
    later = later.groupBy("doc").agg(F.collect_list(F.struct("s", "e")).alias("spans")).withColumnRenamed("doc", "_span_doc")

    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, sp in zip(text, spans, strict=True):
            if t is None or sp is None or not len(sp):
                out.append(t)
                continue
            hidden = np.zeros(len(t) + 1, np.int32)
            for x in sp:
                hidden[x["s"]] += 1
                hidden[x["e"]] -= 1
            hidden = np.cumsum(hidden) > 0
            at = sentence_starts(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32))
            # a run covers whole sentences, so a sentence's first character tells of all
            out.append("".join(t[a:b] for a, b in zip(at, np.append(at[1:], len(t)), strict=True) if not hidden[a]))
        return pd.Series(out, dtype=object)

    cut_udf = F.pandas_udf(cut, "string")
    return df.join(later, df[id_col] == later["_span_doc"], "left").withColumn("kept_text", cut_udf(F.col(text_col), F.col("spans"))).select(*(df[c] for c in df.columns), "kept_text")
