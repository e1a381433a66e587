"""Evaluation texts inside training text (problem 8).

Method: n-gram seeds join training passages to test items, Smith-Waterman alignment scores what
they join.

1. Every n-gram of an item is a seed. None is left out as frequent: an edit destroys the n-grams
   over it, and which of an item's a copy keeps is not known before.
2. One pass over the corpus, whatever the number of items: a document's n-grams are looked up in a
   Bloom filter of the seeds (at most FILTER_BITS, the only thing that is broadcast by its making),
   and the stretches of words around those it may hold are written out.
3. Their n-grams are joined with the table of seeds, which tells the items and where in the stretch
   each would begin; a stretch and an item are aligned, locally, word by word. Copies that were
   edited or paraphrased in part keep a high score; the longest exact run is counted in the same
   alignment table. A copy without `seed` consecutive words of its item is not found.

What is joined is in proportion to what leaks, not to the corpus; a seed or an item that a third of
all documents hold is dealt over several tasks. Nothing of the items is collected.

Defined results: null and empty texts leak nothing; rows with a null id are left out; items of
fewer words than a seed are matched by their whole text; an item that occurs several times in a
document, or under several texts, gives one row, its best alignment; repeated rows are reported
each; empty tables give an empty table; further columns are not read; texts are processed whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valora.runtime import BROADCAST_ROWS, keep, small_side, spread, spread_join

#: Words of a seed, and of the exact run that counts as a leak.
SEED = 6
RUN = 12
#: Bits of the broadcast filter: FILTER_SHARE for each n-gram of the items, FILTER_BITS at most.
FILTER_SHARE = 64
FILTER_BITS = 1 << 28
#: Characters of texts that are numbered at once.
BATCH = 4_000_000
#: Alignment scores.
MATCH, MISMATCH, GAP = 2, -2, -1

_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[\u0300-\u036f]+")
_RARE = re.compile("[^\0-\u036f\u2010-\u2027\u20ac]")


def folded(text: str) -> str:
    """The text in lower case without combining marks."""
    t = text.lower()
    if not t.isascii():
        t = _MARKS.sub("", unicodedata.normalize("NFD", t))
        if _RARE.search(t):  # scripts with marks of their own
            t = "".join(c for c in t if not unicodedata.combining(c))
    return t


def words_of(text: str) -> list[str]:
    """Runs of letters or digits, without case, accents and marks."""
    return _WORD.findall(folded(text))


class Codes(dict):
    """64-bit digests of words; those met are remembered, a bounded number of them."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        out = self[word] = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return out

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all n-grams of word digests."""
    k = max(len(codes) - n + 1, 0)
    h = np.full(k, n, np.uint64)
    for i in range(n):
        h = (h ^ codes[i : i + k]) * _M1
        h ^= h >> np.uint64(29)
    return h * _M2


def _places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The four places of a hash in a filter of `bits` bits, a power of two."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) ^ (h >> np.uint64(40))) & np.uint64(bits - 1) for i in range(4)]


def in_filter(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which of the hashes a filter (its 64-bit words) may hold."""
    ok = np.ones(len(h), bool)
    for p in _places(h, len(words) * 64):
        ok &= (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return ok


def align(item: np.ndarray, doc: np.ndarray) -> tuple[int, int, int, int]:
    """(score, matched words, longest exact run, end in doc) of the best local alignment.

    Smith-Waterman with linear gaps; a row of the table is one array step, gaps along the row by a
    running maximum. The longest run is over the whole table, aligned or not.
    """
    m = len(doc)
    score, matches, run = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
    ramp = np.arange(m + 1) * -GAP
    best, best_run = (0, 0, 0), 0
    for w in item:
        eq = doc == w
        diag = score[:-1] + np.where(eq, MATCH, MISMATCH)
        diag_m = matches[:-1] + eq
        up, up_m = score[1:] + GAP, matches[1:]
        take = diag >= up
        s = np.concatenate(([0], np.maximum(np.where(take, diag, up), 0)))
        mm = np.concatenate(([0], np.where(take, diag_m, up_m)))
        mm[s == 0] = 0
        # gaps in the item: the best earlier cell of the row, less one GAP per step
        lifted = s + ramp
        top = np.maximum.accumulate(lifted)
        src = np.maximum.accumulate(np.where(lifted == top, np.arange(m + 1), 0))
        s2 = top - ramp
        mm = np.where(s2 > s, mm[src], mm)
        score, matches = s2, mm
        run = np.concatenate(([0], np.where(eq, run[:-1] + 1, 0)))
        best_run = max(best_run, int(run.max()))
        j = int(score.argmax())
        if score[j] > best[0]:
            best = (int(score[j]), int(matches[j]), j)
    return best[0], best[1], best_run, best[2]


def item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, item, codes): the word digests of every text of an item; item is a number of its own."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = Codes()
        for pdf in batches:
            got = [codes.of(words_of(t)).view(np.int64) for t in pdf["text"]]
            yield pd.DataFrame({"item_id": pdf["item_id"], "item": pdf["item"], "codes": got})

    src = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    return src.withColumn("item", F.xxhash64("item_id", "text")).mapInPandas(scan, "item_id long, item long, codes array<long>").where("size(codes) > 0")


def item_grams(words: DataFrame, seed: int) -> DataFrame:
    """(g, item, place, n, size): every n-gram of every item, size being its words and n the item's."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for item, codes in zip(pdf["item"], pdf["codes"], strict=True):
                size = min(seed, len(codes))
                h = gram_hashes(np.asarray(codes, np.int64).view(np.uint64), size)
                parts.append(pd.DataFrame({"g": h.view(np.int64), "item": item, "place": np.arange(len(h), dtype=np.int32), "n": len(codes), "size": size}))
            if parts:
                yield pd.concat(parts).astype({"n": np.int32, "size": np.int32})

    return words.select("item", "codes").mapInPandas(scan, "g long, item long, place int, n int, size int")


def gram_filter(grams: DataFrame, n: int) -> np.ndarray:
    """The Bloom filter of n n-grams, as 64-bit words; of it, at most FILTER_BITS come to the driver."""
    bits = 1 << 12
    while bits < min(FILTER_SHARE * n, FILTER_BITS):
        bits *= 2

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words: dict[int, int] = {}
            for p in _places(pdf["g"].to_numpy().view(np.uint64), bits):
                for w, b in zip((p >> np.uint64(6)).tolist(), (np.uint64(1) << (p & np.uint64(63))).tolist(), strict=True):
                    words[w] = words.get(w, 0) | b
            yield pd.DataFrame({"w": np.fromiter(words, np.int64, len(words)), "b": np.fromiter(words.values(), np.uint64, len(words)).view(np.int64)})

    set_ = grams.select("g").mapInPandas(mark, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[set_["w"].to_numpy()] = set_["b"].to_numpy()
    return out.view(np.uint64)


STRETCHES = "doc long, stretch int, first long, codes array<long>, hits array<struct<g:long,pos:long>>"


def stretches(docs: DataFrame, words: np.ndarray, sizes: list[int], longest: int) -> DataFrame:
    """(STRETCHES): the words around the n-grams of each document that the filter holds.

    docs: (doc, text). Hits that stand within four times the longest item of each other share a
    stretch, which reaches twice that length beyond them; so stretches don't overlap. first: the
    number of its first word in the document, from 0, as pos.
    """
    held = docs.sparkSession.sparkContext.broadcast(words)
    slack = 2 * longest

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds, known = held.value, Codes()
        for pdf in batches:
            for _, part in pdf.groupby(pdf["text"].str.len().cumsum() // BATCH, sort=False):
                ws = [words_of(t) for t in part["text"]]
                end = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)))
                start = end - np.fromiter(map(len, ws), np.int64, len(ws))
                codes = known.of([w for x in ws for w in x])
                at, val = [], []
                for n in sizes:
                    h = gram_hashes(codes, n)
                    ok = np.flatnonzero(in_filter(h, seeds))
                    at.append(ok)
                    val.append(h[ok])
                    text = np.searchsorted(end, at[-1], "right")
                    inside = at[-1] + n <= end[text]  # no n-gram reaches into the next text
                    at[-1], val[-1] = at[-1][inside], val[-1][inside]
                at, val = np.concatenate(at), np.concatenate(val)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, val = at[order], val[order]
                text = np.searchsorted(end, at, "right")
                new = np.flatnonzero(np.concatenate(([True], (np.diff(text) != 0) | (np.diff(at) > 2 * slack))))
                ids, rows = part["doc"].tolist(), []
                for k, (i, j) in enumerate(zip(new, [*new[1:], len(at)], strict=True)):
                    t = text[i]
                    lo, hi = max(start[t], at[i] - slack), min(end[t], at[j - 1] + slack + SEED)
                    hits = [{"g": int(g), "pos": int(p)} for g, p in zip(val[i:j].view(np.int64), at[i:j] - start[t], strict=True)]
                    rows.append((ids[t], k, int(lo - start[t]), codes[lo:hi].view(np.int64), hits))
                yield pd.DataFrame(rows, columns=["doc", "stretch", "first", "codes", "hits"])

    return spread(docs).mapInPandas(find, STRETCHES)


def best_in(item: np.ndarray, codes: np.ndarray, first: int, starts: list[int]) -> tuple[int, int, int, int, int]:
    """(score, matched words, longest run, from, to) of an item in a stretch, near the places where it would begin."""
    slack, best, run = len(item), None, 0
    groups = [[starts[0], starts[0]]]
    for s in starts[1:]:  # seeds near each other share a window
        if s - groups[-1][1] <= slack:
            groups[-1][1] = s
        else:
            groups.append([s, s])
    for a, b in groups:
        lo, hi = max(0, a - slack - first), min(len(codes), b + 2 * slack - first)
        score, matched, exact, to = align(item, codes[lo:hi])
        run = max(run, exact)
        best = max(best or (0, 0, 0, 0), (score, matched, first + lo, first + lo + to))
    return best[0], best[1], run, best[2], best[3]


LEAK_SCHEMA = "doc long, item_id long, score int, share double, matched_words int, longest_run int, from_word long, to_word long"


def leaks(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id: str, item_text: str, seed: int = SEED, run: int = RUN) -> DataFrame:
    """Every document and item that a seed joins, with the alignment's score (LEAK_SCHEMA)."""
    spark = docs.sparkSession
    seed = min(seed, run)  # so that every exact run holds a seed
    words = keep(item_words(items, item_id, item_text), "p8-items")
    grams = keep(item_grams(words, seed), "p8-grams")
    stat = grams.agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("longest"), F.collect_set("size").alias("sizes")).first()  # at most `seed` sizes
    if not stat["rows"]:
        return spark.createDataFrame([], LEAK_SCHEMA)
    src = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    found = keep(stretches(src, gram_filter(grams, stat["rows"]), sorted(stat["sizes"]), stat["longest"]), "p8-stretches")
    hits = found.select("doc", "stretch", F.explode("hits").alias("h")).select("doc", "stretch", F.col("h.g").alias("g"), F.col("h.pos").alias("pos"))
    table = small_side(grams.drop("size"), stat["rows"])
    joined = hits.join(table, "g") if stat["rows"] <= BROADCAST_ROWS else spread_join(hits, grams.drop("size"), ["g"], ["doc", "pos"])
    pairs = joined.groupBy("doc", "stretch", "item").agg(F.sort_array(F.collect_set(F.col("pos") - F.col("place"))).alias("starts"))
    pairs = pairs.join(found.select("doc", "stretch", "first", "codes"), ["doc", "stretch"])
    text = words.withColumnRenamed("codes", "item_codes")
    n = words.count()
    pairs = pairs.join(small_side(text, n), "item") if n <= BROADCAST_ROWS else spread_join(keep(pairs, "p8-pairs"), text, ["item"], ["doc", "stretch"])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, item, own, codes, first, starts in zip(*(pdf[c] for c in ("doc", "item_id", "item_codes", "codes", "first", "starts")), strict=True):
                own = np.asarray(own)
                sc, matched, longest, lo, hi = best_in(own, np.asarray(codes), first, starts.tolist())
                rows.append((doc, item, sc, sc / (MATCH * len(own)), matched, longest, lo, hi))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LEAK_SCHEMA.split(", ")])

    scored = pairs.select("doc", "item_id", "item_codes", "codes", "first", "starts").mapInPandas(score, LEAK_SCHEMA)
    best = scored.groupBy("doc", "item_id").agg(F.max(F.struct("score", "share", "matched_words", (-F.col("from_word")).alias("f"), "to_word")).alias("b"), F.max("longest_run").alias("longest_run"))
    return best.select("doc", "item_id", "b.score", "b.share", "b.matched_words", "longest_run", (-F.col("b.f")).alias("from_word"), "b.to_word")
