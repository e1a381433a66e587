"""Text of scanned pages as continuous paragraphs (problem 3).

Method: a symmetric-delete index over the corpus's own frequency lexicon generates correction
candidates for all words and for tokens with impossible characters, a weighted edit distance with
confusion pairs ranks them, and the context of the word before picks among several; words of less
than SHORT letters, which are near many others, are corrected only where that context speaks for it.
Around it, edge lines that repeat through a report (compared in a form
in which confusable characters are equal) are its running heads, edge lines that hold nothing but
a number in step with the page are page numbers, and words broken over lines are joined where the
lexicon knows the joined word rather than the compound.

Steps, each over all pages:
1. edges: the lines at the top and bottom of every page, inwards up to the first one that can be
   neither head nor number, their folded form and number;
2. running heads and page numbers by counting over a report; they are peeled from outside inwards;
3. facts of the remaining body lines: word counts, broken words, lines with impossible characters;
4. the lexicon from the counts, candidates by joining deletions, corrections by weighted distance;
5. marks: body lines that hold a corrected word, short words with a candidate, and how often the
   candidates follow the words before them.

A token with impossible characters that the index has no candidate for is misread all the same;
misread() names the evidence of every line.

Page-level tables are joined by report and page number, never gathered by report; the corrections
go to the executors only up to BROADCAST_WORDS words and are joined to the pages' words beyond.

Defined results: null and blank pages have no lines; a page without report is a report of its own;
repeated pages are judged each, but count once as evidence for a running head; a word that occurs
as often as its candidate is no misreading; empty tables give empty tables; further columns are
not read; pages of any length are read whole.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valora.runtime import keep, small_side, spread

#: Letters below which a word is corrected by context only.
SHORT = 3
#: A candidate must be this many times as frequent as the word it replaces, and this frequent at all.
RATIO = 6.0
LEAST = 6
#: Largest weighted distance of a correction.
MAX_COST = 1.0
BROADCAST_WORDS = 200_000

# Characters that scanning confuses, as (read, meant); the first of several is likeliest.
CONFUSIONS = [
    ("1", "i"), ("1", "l"), ("0", "o"), ("0", "ó"), ("5", "s"), ("6", "b"), ("6", "ó"), ("6", "o"), ("8", "b"), ("9", "g"), ("4", "a"), ("3", "e"), ("7", "t"), ("2", "z"),
    ("|", "r"), ("|", "l"), ("|", "i"), ("@", "a"), ("†", "t"), ("‡", "t"), ("$", "s"), ("€", "e"), ("!", "i"), ("¡", "i"), ("\\/", "v"), ("vv", "w"),
    ("v", "u"), ("u", "v"), ("c", "e"), ("e", "c"), ("l", "i"), ("i", "l"), ("l", "t"), ("f", "t"), ("h", "b"), ("b", "h"), ("q", "g"), ("g", "q"), ("j", "i"),
    ("rn", "m"), ("m", "rn"), ("ri", "n"), ("n", "ri"), ("cl", "d"), ("d", "cl"), ("li", "h"), ("ii", "n"), ("ii", "u"), ("nn", "m"), ("in", "m"), ("ï", "í"),
]

_MARKS = re.compile("[\u0300-\u036f]+")
_SYMBOL = "@|†‡\\\\´`¦"
_HYPHENS = "-‐¬\u00ad"
_STRIP = ".,;:()¿?¡!\"«»“”‘’'…[]{}%·•*—–-‐¬\u00ad"
_LETTERS = re.compile(r"[^\W\d_]+")
_COMPOUND = re.compile(r"[^\W\d_]+(?:[-‐][^\W\d_]+)+")
_ODD = re.compile(rf"[{_SYMBOL}]|[^\W\d_]\d|\d[^\W\d_]")
_NUMERIC = re.compile(r"[\dlOI]+(?:[.,/][\dlOI]+)*")


def bare(text: str) -> str:
    """Lower case, no accents, dots of ï and spacing accents dropped."""
    t = text.lower().replace("´", "").replace("`", "")
    return t if t.isascii() else _MARKS.sub("", unicodedata.normalize("NFD", t))


# classes of characters that are read for each other, then of pairs, in terms of the classes; no pair
# begins as one ends, so that their order doesn't matter once they are repeated to the end
_SINGLE = str.maketrans(
    {"1": "i", "l": "i", "!": "i", "0": "o", "6": "o", "b": "o", "8": "o", "5": "s", "$": "s", "9": "g", "q": "g", "@": "a", "4": "a", "†": "t", "‡": "t", "7": "t", "|": "r", "v": "u", "c": "e", "3": "e", "€": "e", "¡": "i", "2": "z"}
)
_MULTI = (("rn", "m"), ("ri", "n"), ("ei", "d"))


def fold(text: str) -> str:
    """A form in which a text and its misreadings are equal."""
    t = bare(text).replace("\\/", "u").translate(_SINGLE)
    before = None
    while t != before:
        before = t
        for a, b in _MULTI:
            t = t.replace(a, b)
    return t


_EDGE_NUMBER = re.compile(r"^[\s\W]*(?:[\dlOI]{1,4})(?=\s{2,}|\s*[|·/—–-]\s|\s*$)|(?:(?<=\s\s)|(?<=[|·/—–-] ))[\dlOI|]{1,4}[\s\W]*$")
_SPACES = re.compile(r"\s+")


def head_form(line: str) -> str:
    """The folded line without a page number set off at its start or end."""
    return _SPACES.sub(" ", fold(_EDGE_NUMBER.sub(" ", _EDGE_NUMBER.sub(" ", line)))).strip()


def head_like(line: str) -> bool:
    """Whether a line may be a running head: no sentence's end, no broken word, no small first letter."""
    t = line.strip()
    return bool(t) and not t[0].islower() and t[-1] not in ".,;:" + _HYPHENS and not t.endswith(")") and sum(c.isalpha() for c in t) >= 4


_DIGITS = str.maketrans({"l": "1", "I": "1", "i": "1", "|": "1", "O": "0", "o": "0", "S": "5", "s": "5", "B": "8", "Z": "2", "z": "2", "g": "9", "q": "9", "b": "6"})
_NUM = r"[\dlIiOoSsBZzgqb]{1,4}"
_PAGE = re.compile(rf"^[^\w|]*(?:(?P<label>p[^\W\d_@†]?[@†\w.]{{0,7}}?\.?|folio|hoja|page)[\s.:]+)?[^\w|]*(?P<n>{_NUM}|\|)(?:\s*(?P<sep>de|of|/|\||-|\\/)\s*(?P<m>{_NUM}))?[^\w|]*$", re.I)
_RUNS = re.compile(r"([^\w|])\1+")
_ROMAN = re.compile(r"^[^\w]*([ivxlc]{1,7})[^\w]*$", re.I)
_PAGE_LABELS = {fold(x) for x in ("p", "pag", "pág", "página", "pagina", "pags", "pg", "folio", "hoja", "page")}


def _roman(s: str) -> int:
    val = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    x = [val[c] for c in s.lower()]
    return sum(-a if a < b else a for a, b in zip(x, [*x[1:], 0], strict=True))


def page_number(line: str) -> tuple[int, bool] | None:
    """(number, whether its form is that of a page number) if the line holds a number only."""
    # runs of one mark as one, so that a frame of any length around the number weighs nothing
    t = _RUNS.sub(r"\1", line.strip())
    if not t or sum(c.isalnum() for c in t) > 40:  # a label, a separator and two numbers have fewer
        return None
    m = _PAGE.match(t)
    if m:
        label, n = m.group("label"), m.group("n").translate(_DIGITS)
        if label and fold(label.rstrip(".")) not in _PAGE_LABELS:
            return None
        if n.isdigit() and any(c.isdigit() or c in "lIO|" for c in m.group("n")):
            plain = t.strip() == m.group("n")
            return int(n), not plain
        return None
    r = _ROMAN.match(t)
    return (_roman(r.group(1)), False) if r else None


def _lines(text: str | None) -> list[str]:
    return text.split("\n") if text else []


PAGES = "source_table string, record_id long, doc string, page_no int, text string"


def pages_of(df: DataFrame, source_table: str, id_col: str, doc_col: str, page_col: str, text_col: str) -> DataFrame:
    """Rows of PAGES from a table with a page per row."""
    own = F.concat(F.lit("\0"), F.col(id_col).cast("string"))
    return df.select(
        F.lit(source_table).alias("source_table"), F.col(id_col).cast("long").alias("record_id"), F.coalesce(F.col(doc_col), own).alias("doc"), F.col(page_col).cast("int").alias("page_no"), F.col(text_col).alias("text")
    ).where("text IS NOT NULL")


def pages_of_list(df: DataFrame, source_table: str, id_col: str, doc_col: str, pages_col: str) -> DataFrame:
    """Rows of PAGES from a table with a list of pages per row; page_no is the position from 0."""
    one = df.select(id_col, doc_col, F.posexplode(pages_col).alias("page_no", "text"))
    return pages_of(one, source_table, id_col, doc_col, "page_no", "text")


EDGES = "source_table string, doc string, record_id long, page_no int, zone string, depth int, line_no int, form long, head boolean, num int, marked boolean"


def _hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def edges(pages: DataFrame) -> DataFrame:
    """The lines at the top and bottom of every page (EDGES), depth counting from the edge."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for s, r, d, p, t in zip(pdf["source_table"], pdf["record_id"], pdf["doc"], pdf["page_no"], pdf["text"], strict=True):
                lines = _lines(t)
                full = [i for i, x in enumerate(lines) if x.strip()]
                for zone, at in (("top", full), ("bottom", reversed(full))):
                    for k, i in enumerate(at):
                        line = lines[i]
                        num = page_number(line)
                        if num is None and not head_like(line):
                            rows.append((s, d, r, p, zone, k, i + 1, None, False, None, False))
                            break  # no line within can be a head any more
                        form = head_form(line)
                        rows.append((s, d, r, p, zone, k, i + 1, _hash(form) if sum(c.isalpha() for c in form) >= 4 else None, head_like(line), num[0] if num else None, bool(num and num[1])))
            out = pd.DataFrame(rows, columns=["source_table", "doc", "record_id", "page_no", "zone", "depth", "line_no", "form", "head", "num", "marked"])
            yield out.astype({"form": "Int64", "num": "Int32"})

    return spread(pages).mapInPandas(scan, EDGES)


def edge_kinds(edge: DataFrame) -> DataFrame:
    """(source_table, record_id, page_no, flags): of every page its running and page_number lines.

    A form is a running head if at least two pages of the report have it in the same zone, and a
    fifth of its pages at least; a number is a page number if it runs in step with the pages, or
    has the form of one and no other of the report contradicts it.
    """
    rep = ["source_table", "doc"]
    size = edge.groupBy(*rep).agg(F.countDistinct("page_no").alias("pages"))
    heads = (
        edge.where("form IS NOT NULL AND num IS NULL")
        .groupBy(*rep, "zone", "form")
        .agg(F.countDistinct("page_no").alias("on"), F.avg(F.col("head").cast("double")).alias("looks"))
        .where("on >= 2 AND looks >= 0.5")
        .join(size, rep)
        .where("on >= pages / 5")
        .select(*rep, "zone", "form", F.lit(True).alias("is_head"))
    )
    step = F.col("num") - F.col("page_no")
    steps = edge.where("num IS NOT NULL").withColumn("step", step).groupBy(*rep, "step").agg(F.countDistinct("page_no").alias("on"), F.max("marked").alias("some_marked"))
    best = steps.groupBy(*rep).agg(F.max("on").alias("best"))
    nums = steps.join(best, rep).where("on = best AND (on >= 2 OR some_marked)").select(*rep, F.col("step").alias("num_step"), "on")
    e = (
        edge.join(heads, [*rep, "zone", "form"], "left")
        .withColumn("num_step", step)
        .join(nums, [*rep, "num_step"], "left")
        .withColumn("kind", F.when(F.col("num").isNotNull() & F.col("on").isNotNull() & (F.col("marked") | (F.col("on") >= 2)), "page_number").when(F.coalesce("is_head", F.lit(False)), "running"))
    )
    # from outside inwards: a line counts if all lines outside it count
    per_zone = e.groupBy("source_table", "doc", "record_id", "page_no", "zone").agg(F.sort_array(F.collect_list(F.struct("depth", "line_no", "kind"))).alias("ls"))
    body = F.array_position(F.transform("ls", lambda x: x["kind"].isNull()), True).cast("int")
    peeled = per_zone.withColumn("peeled", F.when(body == 0, F.col("ls")).otherwise(F.slice("ls", 1, body - 1)))
    return peeled.groupBy("source_table", "doc", "record_id", "page_no").agg(
        F.array_distinct(F.flatten(F.collect_list(F.transform("peeled", lambda x: F.struct(x["line_no"].alias("line_no"), x["kind"].alias("kind")))))).alias("flags")
    )


# ---- body lines -------------------------------------------------------------------------------


def odd_token(tok: str) -> bool:
    """Whether a token holds characters that no word has: symbols or digits among letters."""
    t = tok.strip(_STRIP)
    if not t:
        return False
    letters = sum(c.isalpha() and c not in "ºª" for c in t)
    if not letters:
        return False
    if any(c in "@|†‡\\´`¦" for c in t):
        return True
    if any(c.isdigit() and c not in "²³¹" for c in t):
        if _NUMERIC.fullmatch(t) and any(c in "lOI" for c in t):
            return True
        for part in re.split(r"[-/.,_:]", t):
            n = sum(c.isalpha() for c in part)
            k = sum(c.isdecimal() for c in part)
            if n >= 3 and 0 < k < n and any(c.islower() for c in part) or (n == 2 and k == 1 and len(part) == 3 and not part[-1].isdigit() and part.islower()):
                return True
    return False


def broken(line: str) -> str | None:
    """The fragment before a hyphen at the line's end."""
    t = line.rstrip()
    if len(t) < 2 or t[-1] not in _HYPHENS or not (t[-2].isalpha() or t[-2] in "@|†´" or t[-2].isdigit()):
        return None
    frag = re.split(r"[\s(«\"“¿¡/]", t[:-1])[-1]
    return frag if any(c.isalpha() for c in frag) else None


def body_of(lines: list[str], flags: dict[int, str]) -> list[int]:
    """Indices of the lines that hold text and are neither running nor page numbers."""
    return [i for i, x in enumerate(lines) if x.strip() and i + 1 not in flags]


def _first_token(line: str) -> str:
    t = line.split()
    return t[0].strip(_STRIP) if t else ""


def _flags(x) -> dict[int, str]:
    return {} if x is None else {f["line_no"]: f["kind"] for f in x}


FACTS = "kind string, source_table string, doc string, record_id long, page_no int, line_no int, word string, nxt string, next_line int, mark string, n long"


def facts(flagged: DataFrame) -> DataFrame:
    """FACTS of pages with flags. kind w: a word and its count in a batch; c: a compound and its
    count; o: a token with impossible characters and its count; h: a line that ends in a broken word;
    p: a page's first body token and line; m: a line and its token with impossible characters."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in FACTS.split(", ")]
        for pdf in batches:
            words, compounds, odd, rows = Counter(), Counter(), Counter(), []
            for s, r, d, p, t, fl in zip(pdf["source_table"], pdf["record_id"], pdf["doc"], pdf["page_no"], pdf["text"], pdf["flags"], strict=True):
                lines = _lines(t)
                body = body_of(lines, _flags(fl))
                skip_first = False
                for k, i in enumerate(body):
                    line = lines[i]
                    if _ODD.search(line):
                        bad = [x.strip(_STRIP).lower() for x in line.split() if odd_token(x)]
                        odd.update(bad)
                        rows += [("m", s, d, r, p, i + 1, w, None, None, None, None) for w in set(bad)]
                    frag = broken(line)
                    text = line.rstrip()[: -1 - len(frag)] if frag else line
                    first = _first_token(line) if k == 0 or skip_first else None
                    if k == 0:
                        rows.append(("p", s, d, r, p, i + 1, first, None, None, None, None))
                    ws = _LETTERS.findall(text.lower())
                    if skip_first and ws:
                        ws = ws[1:]
                    words.update(ws)
                    if "-" in text or "‐" in text:
                        compounds.update(x.replace("‐", "-") for x in _COMPOUND.findall(text.lower()))
                    skip_first = False
                    if frag:
                        nxt = _first_token(lines[body[k + 1]]) if k + 1 < len(body) else None
                        rows.append(("h", s, d, r, p, i + 1, frag.lower(), nxt, body[k + 1] + 1 if k + 1 < len(body) else None, line.rstrip()[-1], None))
                        if nxt and not nxt[:1].isupper():
                            skip_first = True
                            words[(frag + nxt).lower().rpartition("-")[2]] += 1
            rows += [("w", None, None, None, None, None, w, None, None, None, n) for w, n in words.items()]
            rows += [("o", None, None, None, None, None, w, None, None, None, n) for w, n in odd.items()]
            rows += [("c", None, None, None, None, None, w, None, None, None, n) for w, n in compounds.items()]
            yield pd.DataFrame(rows, columns=cols).astype({"record_id": "Int64", "page_no": "Int32", "line_no": "Int32", "next_line": "Int32", "n": "Int64"})

    return flagged.mapInPandas(scan, FACTS)


# ---- lexicon and corrections ------------------------------------------------------------------

_COST: dict[tuple[str, str], float] = {}
for _a, _b in CONFUSIONS:
    _COST.setdefault((_a, _b), 0.19)


def distance(read: str, meant: str, limit: float = MAX_COST) -> float:
    """Weighted edit distance: confusion pairs cost 0.19, a wrong or lost accent 0.2, other edits 1."""
    n, m = len(read), len(meant)
    inf = 9.0
    d = [[inf] * (m + 1) for _ in range(n + 1)]
    d[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            x = d[i][j]
            if x > limit:
                continue
            if i < n and j < m:
                a, b = read[i], meant[j]
                c = 0.0 if a == b else _COST.get((a, b)) or (0.2 if bare(a) == bare(b) and bare(a) else 1.0)
                d[i + 1][j + 1] = min(d[i + 1][j + 1], x + c)
                for la, lb in ((2, 1), (1, 2)):
                    c2 = _COST.get((read[i : i + la], meant[j : j + lb])) if i + la <= n and j + lb <= m else None
                    if c2:
                        d[i + la][j + lb] = min(d[i + la][j + lb], x + c2)
            if i < n:
                d[i + 1][j] = min(d[i + 1][j], x + (0.1 if read[i] in "´`" else 1.0))
            if j < m:
                d[i][j + 1] = min(d[i][j + 1], x + 1.0)
    return d[n][m]


def deletions(form: str) -> list[str]:
    """A folded form and what is left of it without any one character."""
    return list({form, *(form[:i] + form[i + 1 :] for i in range(len(form)))}) if len(form) > 4 else [form]


_UNFOLDED = [(a, b) for a, b in CONFUSIONS if fold(a) != fold(b)]


def keys_of(word: str) -> list[str]:
    """Deletions of a word's folded form; of longer words also the folded forms that one confusion
    makes which the fold doesn't make equal, so that every confusion leads to a shared key."""
    form, t = fold(word), bare(word)
    if len(form) <= 4:
        return deletions(form)
    more = {fold(t[:i] + b + t[i + len(a) :]) for a, b in _UNFOLDED for i in range(len(t)) if t.startswith(a, i)}
    return list({*deletions(form), *more})


def lexicon(fact: DataFrame) -> DataFrame:
    """(word, n, odd) over all body lines; words broken over lines count as joined; odd ones have
    characters that no word has and are never candidates."""
    odd = F.col("kind") == "o"
    return fact.where("kind IN ('w', 'o') AND word <> ''").groupBy("word", odd.alias("odd")).agg(F.sum("n").alias("n"))


def corrections(lex: DataFrame, ratio: float = RATIO, least: int = LEAST, max_cost: float = MAX_COST) -> DataFrame:
    """(word, fix, cost, n_word, n_fix, odd, rank): candidates of every word that is likely misread.

    Deletions of folded words are joined (symmetric delete, keys_of); a candidate is at least `ratio` times
    as frequent and within `max_cost`. rank 1 is the cheapest, then the most frequent, of those that
    aren't likely misread themselves; others come last.
    """
    # told to be nondeterministic, so that filters and explodes don't compute them twice
    keys = F.pandas_udf(lambda w: pd.Series([keys_of(x) for x in w], dtype=object), "array<string>").asNondeterministic()
    read = lex.withColumn("del", F.explode(keys("word")))
    meant = read.where(f"n >= {least} AND NOT odd").select(F.col("word").alias("fix"), F.col("n").alias("n_fix"), "del")
    top = lex.agg(F.max("n")).first()[0] or 0
    pairs = (
        read.where(f"n * {ratio} <= {top}")
        .join(meant, "del")
        .where(f"word <> fix AND n_fix >= {ratio} * n AND abs(length(word) - length(fix)) <= 3")
        .select("word", "fix", F.col("n").alias("n_word"), "n_fix", "odd")
        .distinct()
    )
    cost = F.pandas_udf(lambda a, b: pd.Series([distance(x, y, max_cost) for x, y in zip(a, b, strict=True)], dtype="float64"), "double").asNondeterministic()
    good = pairs.withColumn("cost", cost("word", "fix")).where(f"cost < {max_cost}")
    good = keep(good, "p3-pairs")
    doubtful = good.select(F.col("word").alias("fix"), F.lit(True).alias("doubtful")).distinct()
    good = good.join(small_side(keep(doubtful, "p3-doubtful")), "fix", "left")
    order = F.row_number().over(Window.partitionBy("word").orderBy(F.coalesce("doubtful", F.lit(False)), "cost", F.desc("n_fix"), "fix"))
    return good.withColumn("rank", order).drop("doubtful")


def broken_words(fact: DataFrame, lex: DataFrame) -> DataFrame:
    """Broken words: (source_table, doc, record_id, page_no, line_no, frag, nxt, next_line, same_page, hyphenated).

    The next body line is on the page or opens the report's next one. A word is broken by its
    hyphen unless the corpus writes the compound more often than the joined word.
    """
    first = fact.where("kind = 'p'").groupBy("source_table", "doc", F.col("page_no").alias("np")).agg(F.min(F.struct("record_id", "word", "line_no")).alias("f"))
    h = fact.where("kind = 'h'").withColumn("np", F.col("page_no") + 1)
    h = h.join(first, ["source_table", "doc", "np"], "left").select(
        "source_table", "doc", "record_id", "page_no", "line_no", F.col("word").alias("frag"), "mark", F.coalesce("nxt", "f.word").alias("nxt"), F.coalesce("next_line", "f.line_no").alias("next_line"), F.col("nxt").isNotNull().alias("same_page")
    )
    nxt = F.regexp_extract(F.lower("nxt"), r"^[^\s]*", 0)
    bare_next = F.regexp_extract(nxt, r"^[\p{L}]+", 0)
    tail, last = F.regexp_extract("frag", r"[^-‐]*$", 0), F.col("frag")
    h = h.withColumn("joined", F.concat(tail, bare_next)).withColumn("compound", F.concat_ws("-", last, bare_next)).withColumn("bare_next", bare_next).withColumn("tail", tail)
    lw = lambda c, name: lex.where("NOT odd").select(F.col("word").alias(c), F.col("n").alias(name))
    comp = fact.where("kind = 'c'").groupBy(F.col("word").alias("compound")).agg(F.sum("n").alias("n_comp"))
    h = h.join(lw("joined", "n_join"), "joined", "left").join(comp, "compound", "left").join(lw("tail", "n_tail"), "tail", "left").join(lw("bare_next", "n_next"), "bare_next", "left")
    opens = comp.select(F.regexp_extract("compound", r"^(.*)-[^-]*$", 1).alias("frag"), "n_comp").groupBy("frag").agg(F.sum("n_comp").alias("n_first"))
    h = h.join(opens, "frag", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    upper = F.col("nxt").rlike(r"^\p{Lu}")
    is_word = (z("n_tail") >= LEAST) & (z("n_next") >= LEAST) & (z("n_join") <= 1)
    # a fragment that nothing continues is broken unless compounds of the corpus begin with it
    lone = F.col("nxt").isNull() | upper
    alone = lone & ((F.col("mark") != "-") | (z("n_first") == 0))
    whole = F.col("nxt").isNotNull() & ~upper & ~(z("n_comp") > z("n_join")) & ((F.col("mark") != "-") | ~is_word)
    return h.select("source_table", "doc", "record_id", "page_no", "line_no", "frag", "tail", "nxt", "bare_next", "next_line", "same_page", "joined", F.coalesce(alone | whole, F.lit(False)).alias("hyphenated"))


def page_tokens(text: str | None) -> set[str]:
    """A page's words, and its tokens without outer marks, in lower case."""
    low = (text or "").lower()
    return {*_LETTERS.findall(low), *(t.strip(_STRIP) for t in low.split())}


def _page_lookups(flagged: DataFrame, table: DataFrame, fields: list[str], name: str) -> DataFrame:
    """(source_table, record_id, page_no, name): of every page the rows of table for its words, joined."""
    tokens = F.pandas_udf(lambda c: pd.Series([sorted(page_tokens(t)) for t in c], dtype=object), "array<string>").asNondeterministic()
    w = flagged.select("source_table", "record_id", "page_no", F.explode(tokens("text")).alias("word"))
    return w.join(table, "word").groupBy("source_table", "record_id", "page_no").agg(F.collect_list(F.struct(*fields)).alias(name))


#: What a worker looks words up in: words that are corrected, short ones that context may correct,
#: and words whose contexts are counted.
SURE, WEAK, SEEN = 1, 2, 4


def with_words(flagged: DataFrame, words: DataFrame, picks: DataFrame | None = None, bound: int = BROADCAST_WORDS):
    """(pages, loader): pages with the columns `known` and `picks`, and a function that gives a worker
    the broadcast tables.

    words: (word, fix, role); picks: (prev, word, fix). Up to `bound` rows in all they are broadcast
    and the columns are null; beyond, every page gets its own by joins.
    """
    key = ["source_table", "record_id", "page_no"]
    n = words.count() + (picks.count() if picks is not None else 0)
    if n <= bound:
        by_word = {r["word"]: (r["fix"], r["role"]) for r in words.toLocalIterator()}
        by_context = {(r["prev"], r["word"]): r["fix"] for r in picks.toLocalIterator()} if picks is not None else {}
        held = flagged.sparkSession.sparkContext.broadcast(cloudpickle.dumps((by_word, by_context)))
        none = lambda fields: F.lit(None).cast(f"array<struct<{fields}>>")
        return flagged.withColumns({"known": none("word:string,fix:string,role:int"), "picks": none("prev:string,word:string,fix:string")}), lambda: pickle.loads(held.value)
    out = flagged.join(_page_lookups(flagged, words, ["word", "fix", "role"], "known"), key, "left")
    empty = F.array().cast("array<struct<prev:string,word:string,fix:string>>")
    out = out.join(_page_lookups(flagged, picks, ["prev", "word", "fix"], "picks"), key, "left") if picks is not None else out.withColumn("picks", empty)
    return out.withColumns({"known": F.coalesce("known", F.array().cast("array<struct<word:string,fix:string,role:int>>")), "picks": F.coalesce("picks", empty)}), lambda: ({}, {})


def body_words(lines: list[str], flags: dict[int, str]) -> Iterator[tuple[int, list[str]]]:
    """(index, words) of a page's body lines, without the two parts of a word broken over lines."""
    after = False
    for i in body_of(lines, flags):
        frag = broken(lines[i])
        ws = _LETTERS.findall((lines[i].rstrip()[: -1 - len(frag)] if frag else lines[i]).lower())
        yield i, ws[1:] if after and ws else ws
        after = bool(frag)


MARKS = "kind string, source_table string, record_id long, page_no int, line_no int, prev string, word string, n long"


def marks(flagged: DataFrame, words: DataFrame, bound: int = BROADCAST_WORDS) -> DataFrame:
    """MARKS of body lines. kind x: a line with a word that has a correction; a: a short word with a
    candidate, after another word; b: a word and one after it whose contexts count, with their
    number in a batch."""
    src, load = with_words(flagged.select("source_table", "record_id", "page_no", "text", "flags"), words, bound=bound)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every, _ = load()
        cols = [c.split()[0] for c in MARKS.split(", ")]
        for pdf in batches:
            rows, pairs = [], Counter()
            for s, r, p, t, fl, kn in zip(*(pdf[c] for c in ("source_table", "record_id", "page_no", "text", "flags", "known")), strict=True):
                known = every if kn is None else {x["word"]: (x["fix"], x["role"]) for x in kn}
                prev = ""
                for i, ws in body_words(_lines(t), _flags(fl)):
                    found = False
                    for w in ws:
                        if w in known:
                            role = known[w][1]
                            found |= bool(role & SURE)
                            if prev:
                                if role & SEEN:
                                    pairs[(prev, w)] += 1
                                if role & WEAK:
                                    rows.append(("a", s, r, p, i + 1, prev, w, None))
                        prev = w
                    if found:
                        rows.append(("x", s, r, p, i + 1, None, None, None))
            rows += [("b", None, None, None, None, a, b, n) for (a, b), n in pairs.items()]
            yield pd.DataFrame(rows, columns=cols).astype({"record_id": "Int64", "page_no": "Int32", "line_no": "Int32", "n": "Int64"})

    return src.mapInPandas(scan, MARKS)


def looked_up(candidates: DataFrame) -> DataFrame:
    """(word, fix, role) of the words that marks() looks for: SURE and WEAK by length, SEEN those with
    several candidates or weak ones, and their candidates."""
    per = candidates.groupBy("word").agg(F.max_by("fix", -F.col("rank")).alias("fix"), F.count(F.lit(1)).alias("k"), F.max("odd").alias("odd"))
    short = (F.length("word") < SHORT) & ~F.col("odd")
    per = per.select("word", "fix", (F.when(short, WEAK).otherwise(SURE) + F.when(short | (F.col("k") > 1), SEEN).otherwise(0)).alias("role"))
    seen = candidates.join(per.where(F.col("role") >= SEEN).select("word"), "word", "left_semi").select(F.col("fix").alias("word"), F.lit(None).cast("string").alias("fix"), F.lit(SEEN).alias("role"))
    return per.unionByName(seen).groupBy("word").agg(F.max("fix").alias("fix"), F.bit_or("role").cast("int").alias("role"))


def context_picks(candidates: DataFrame, mark: DataFrame, words: DataFrame) -> DataFrame:
    """(prev, word, fix): of the candidates of a word that context decides, the one that most often
    follows the word before; of a short word only one that does so LEAST times, and RATIO times as
    often as the word itself."""
    pair = mark.where("kind = 'b'").groupBy("prev", "word").agg(F.sum("n").alias("seen"))
    asked = pair.join(words.where(F.col("role").bitwiseAND(SURE | WEAK) > 0).where(F.col("role") >= SEEN).select("word", "role"), "word")
    fits = asked.select("prev", "word", "role", F.col("seen").alias("own")).join(candidates.select("word", "fix", "cost", "n_fix"), "word").join(pair.select("prev", F.col("word").alias("fix"), "seen"), ["prev", "fix"])
    best = fits.groupBy("prev", "word", "role", "own").agg(F.max(F.struct("seen", (-F.col("cost")).alias("c"), "n_fix", "fix")).alias("b"))
    weak = F.col("role").bitwiseAND(WEAK) > 0
    return best.where(~weak | ((F.col("b.seen") >= LEAST) & (F.col("b.seen") >= RATIO * F.col("own")))).select("prev", "word", F.col("b.fix").alias("fix"))


REPAIRED = "source_table string, doc string, record_id long, page_no int, paragraph_no int, text string, opens_mid boolean, ends_mid boolean, ends_broken boolean"
_SENTENCE_END = re.compile(r"[.!?:…][\"'»”)\]]*$")
_HEADING = re.compile(r"^\s*\d+(?:\.\d+)+\s+\S")


_AS_DIGITS = str.maketrans("lOI", "101")


def repair_token(tok: str, fixes: dict[str, tuple[str, int]], context: dict[tuple[str, str], str], prev: str) -> str:
    """A token with its misreading repaired, in the case it had."""
    core = tok.strip(_STRIP)
    if not core:
        return tok
    at = tok.index(core)
    low = core.lower()
    fix = context.get((prev, low)) or fixes.get(low, (None, 0))[0]
    if fix is None and _NUMERIC.fullmatch(core) and odd_token(core):
        fix = core.translate(_AS_DIGITS)
    if fix is None:
        return tok
    fix = fix.upper() if core.isupper() and len(core) > 1 else fix.capitalize() if core[:1].isupper() else fix
    return tok[:at] + fix + tok[at + len(core) :]


def paragraphs_of(lines: list[str], flags: dict[int, str], joins: set[int], fix) -> list[tuple[str, bool, bool, bool]]:
    """(text, whether it goes on from the page before, to the next page, and in mid-word) of a page.

    joins: numbers of the lines whose last word is broken. A blank line, an indent, a list mark or a
    numbered heading opens a paragraph.
    """
    paras: list[list[str]] = []
    glue = new = heading = False
    first_indent = False
    for i, line in enumerate(lines):
        if i + 1 in flags:
            continue
        if not line.strip():
            new = bool(paras)
            continue
        t = line.strip()
        opens = (new or line[:2].isspace() or heading or bool(_HEADING.match(line)) or t[:2] in ("- ", "• ")) and not glue
        if not paras:
            first_indent = line[:2].isspace() or bool(_HEADING.match(line)) or (t[0].isupper() and new)
            paras.append([])
        elif opens:
            paras.append([])
        cut = i + 1 in joins
        t = t.rstrip()[:-1] if cut else t
        if glue and paras[-1]:
            paras[-1][-1] += t
        else:
            paras[-1].append(t)
        # a compound's own hyphen at the line's end takes no space either
        glue = cut or t[-1:] in "-‐"
        heading, new = bool(_HEADING.match(line)), False
    out = []
    for k, p in enumerate(paras):
        text = " ".join(p)
        last = k == len(paras) - 1
        out.append((fix(text), k == 0 and not first_indent and text[:1].islower(), last and (glue or not (_SENTENCE_END.search(text) or heading)), last and glue))
    return out


class Scans:
    """All tables of a set of pages; each is kept in the shared folder once it is made."""

    def __init__(self, pages: DataFrame):
        self.edge = keep(edges(pages), "p3-edges")
        self.kinds = keep(edge_kinds(self.edge), "p3-kinds")
        key = ["source_table", "record_id", "page_no"]
        self.flagged = pages.join(small_side(self.kinds.select(*key, "flags")), key, "left")
        self.fact = keep(facts(self.flagged), "p3-facts")
        self.lex = keep(lexicon(self.fact), "p3-lexicon")
        self.candidates = keep(corrections(self.lex), "p3-candidates")
        self.words = keep(looked_up(self.candidates), "p3-words")
        self.fixes = self.words.where(F.col("role").bitwiseAND(SURE) > 0).select("word", "fix")
        self.breaks = keep(broken_words(self.fact, self.lex), "p3-breaks")
        self.marks = keep(marks(self.flagged, self.words), "p3-marks")
        self.picks = keep(context_picks(self.candidates, self.marks, self.words), "p3-picks")

    def misread(self) -> DataFrame:
        """(source_table, record_id, page_no, line_no, evidence): body lines with a wrongly recognised
        character, in whole or broken words.

        evidence: `index`, a word or odd token with a candidate; `context`, a short word whose candidate
        the word before speaks for; `characters`, impossible ones without a candidate.
        """
        key = ["source_table", "record_id", "page_no", "line_no"]
        b = self.breaks.where("nxt IS NOT NULL").join(self.fixes.withColumnRenamed("word", "joined"), "joined")
        wrong_first = ~F.expr("startswith(fix, tail)")
        wrong_next = ~F.expr("endswith(fix, bare_next)")
        head = b.where(wrong_first).select(*key)
        here = b.where(wrong_next & F.col("same_page")).select("source_table", "record_id", "page_no", F.col("next_line").alias("line_no"))
        # the next page may exist in several copies: each of them has the line
        over = b.where(wrong_next & ~F.col("same_page")).select("source_table", "doc", (F.col("page_no") + 1).alias("page_no")).distinct()
        firsts = self.fact.where("kind = 'p'").select("source_table", "doc", "record_id", "page_no", "line_no")
        there = firsts.join(over, ["source_table", "doc", "page_no"], "left_semi").select(*key)
        known = self.fixes.select("word", F.lit("index").alias("evidence"))
        odd = self.fact.where("kind = 'm'").select(*key, "word").join(small_side(keep(known, "p3-known")), "word", "left").select(*key, F.coalesce("evidence", F.lit("characters")).alias("evidence"))
        whole = self.marks.where("kind = 'x'").select(*key)
        short = self.marks.where("kind = 'a'").join(small_side(self.picks.select("prev", "word")), ["prev", "word"], "left_semi").select(*key, F.lit("context").alias("evidence"))
        index = reduce(DataFrame.unionByName, [whole, head, here, there]).withColumn("evidence", F.lit("index"))
        every = reduce(DataFrame.unionByName, [index, odd, short])
        rank = F.array_position(F.array(F.lit("index"), F.lit("context"), F.lit("characters")), F.col("evidence"))
        return every.groupBy(*key).agg(F.min_by("evidence", rank).alias("evidence"))

    def defects(self) -> DataFrame:
        """(source_table, record_id, page_no, line_no, defect) of every line."""
        edge = self.kinds.select("source_table", "record_id", "page_no", F.explode("flags").alias("f")).select("source_table", "record_id", "page_no", F.col("f.line_no").alias("line_no"), F.col("f.kind").alias("defect"))
        hyph = self.breaks.where("hyphenated").select("source_table", "record_id", "page_no", "line_no", F.lit("hyphenated").alias("defect"))
        return edge.unionByName(hyph).unionByName(self.misread().drop("evidence").withColumn("defect", F.lit("misread")))

    def paragraphs(self, bound: int = BROADCAST_WORDS) -> DataFrame:
        """REPAIRED: the repaired paragraphs of every page in reading order.

        Running heads and page numbers are gone, broken words joined, misreadings repaired.
        opens_mid and ends_mid tell that a paragraph goes on over the page's start or end.
        """
        key = ["source_table", "record_id", "page_no"]
        joins = self.breaks.where("hyphenated").groupBy(*key).agg(F.collect_set("line_no").alias("joins"))
        src, load = with_words(self.flagged.select("source_table", "doc", "record_id", "page_no", "text", "flags"), self.fixes.withColumn("role", F.lit(SURE)), self.picks, bound)
        src = src.join(small_side(keep(joins, "p3-joins")), key, "left")

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            every, everywhere = load()
            for pdf in batches:
                rows = []
                for s, d, r, p, t, fl, fx, pk, jn in zip(*(pdf[c] for c in ("source_table", "doc", "record_id", "page_no", "text", "flags", "known", "picks", "joins")), strict=True):
                    fixes = every if fx is None else {x["word"]: (x["fix"], x["role"]) for x in fx}
                    context = everywhere if pk is None else {(x["prev"], x["word"]): x["fix"] for x in pk}

                    def fix(text: str, fixes=fixes, context=context) -> str:
                        out, prev = [], ""
                        for tok in text.split(" "):
                            out.append(repair_token(tok, fixes, context, prev))
                            prev = out[-1].strip(_STRIP).lower()
                        return " ".join(out)

                    for k, (text, *ends) in enumerate(paragraphs_of(_lines(t), _flags(fl), set() if jn is None else set(jn), fix)):
                        rows.append((s, d, r, p, k + 1, text, *ends))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in REPAIRED.split(", ")]).astype({"record_id": "int64", "page_no": "int32", "paragraph_no": "int32"})

        return src.mapInPandas(scan, REPAIRED)

    def reports(self) -> DataFrame:
        """(source_table, doc, page_no, paragraph_no, pages, text): every report's continuous paragraphs.

        Of several copies of a page the one with the smallest id is taken. A paragraph that runs
        over pages is found from page to page: a page's first paragraph belongs to the last one of
        the page before; only pages that a single paragraph fills are passed on, by pointer jumping.
        page_no and paragraph_no tell where a paragraph begins.
        """
        rep = ["source_table", "doc"]
        p = keep(self.paragraphs(), "p3-paragraphs")
        first = p.groupBy(*rep, "page_no").agg(F.min("record_id").alias("record_id"))
        p = p.join(first, [*rep, "page_no", "record_id"], "left_semi")
        s = p.groupBy(*rep, "page_no").agg(F.max("paragraph_no").alias("n"), F.max_by("ends_mid", "paragraph_no").alias("ends"), F.min_by("opens_mid", "paragraph_no").alias("opens"))
        before = s.select(*rep, (F.col("page_no") + 1).alias("page_no"), F.col("ends").alias("prev_ends"))
        on = F.coalesce("prev_ends", F.lit(False)) | (F.col("opens") & F.col("prev_ends").isNotNull())
        link = s.join(before, [*rep, "page_no"], "left").withColumn("on", F.coalesce(on, F.lit(False)))
        link = keep(link.select(*rep, "page_no", "n", "on", F.when(F.col("on"), F.col("page_no") - 1).otherwise(F.col("page_no")).alias("head")), "p3-links")
        for _ in range(40):
            up = link.where("on AND n = 1").select(*rep, F.col("page_no").alias("head"), F.col("head").alias("further"))
            nxt = keep(link.join(up, [*rep, "head"], "left").select(*rep, "page_no", "n", "on", F.when(F.col("on"), F.coalesce("further", "head")).otherwise(F.col("head")).alias("head"), (F.col("on") & F.col("further").isNotNull()).alias("moved")), "p3-links")
            link = nxt
            if nxt.where("moved").isEmpty():
                break
        size = link.select(*rep, F.col("page_no").alias("head"), F.col("n").alias("head_n"))
        at = link.join(size, [*rep, "head"]).where("on").select(*rep, "page_no", F.lit(1).alias("paragraph_no"), "head", "head_n")
        rows = p.join(at, [*rep, "page_no", "paragraph_no"], "left")
        part = F.struct("page_no", "paragraph_no", "text", "ends_broken")
        parts = rows.groupBy(*rep, F.coalesce("head", "page_no").alias("begin"), F.coalesce("head_n", "paragraph_no").alias("nth")).agg(F.sort_array(F.collect_list(part)).alias("ps"))
        text = F.aggregate("ps", F.lit(""), lambda a, x: F.concat(a, x["text"], F.when(x["ends_broken"], "").otherwise(" ")))
        return parts.select(*rep, F.col("begin").alias("page_no"), F.col("nth").alias("paragraph_no"), F.size("ps").alias("pages"), F.trim(text).alias("text"))
