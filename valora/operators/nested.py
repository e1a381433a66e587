"""Deeply nested JSON records as related flat tables (problem 4, a core operator).

Method: vectorised structural indexing. The texts of a batch are laid end to end in one byte
buffer. Bitmaps of quotes (without escaped ones), of the bytes inside strings, and of brackets and
delimiters outside them come from whole-buffer operations; nesting depth is a prefix sum over the
brackets. From the index follow every object's span, its parent, its key and its position in its
list, without parsing a record by itself. Text that holds JSON is unescaped and indexed again.

Defined results
- A record that is null, empty, not complete JSON or without known lists has no nodes. Invisible
  marks and white space before the JSON are skipped. Completeness is read off the index and then
  confirmed by a full parse of the record, by a pushdown automaton where it is nested too deep for
  the parser. Text that holds JSON is unwrapped however often it is wrapped.
- Nulls in a list take a position and are no nodes; so do other scalars; an object in place of a
  list is its only entry; an empty text in place of a list is an empty list.
- Of two members of one name the last counts, as in a parse.
- Ties and repeated rows are kept, each row by itself; an empty table gives an empty table; further
  columns are not read. Records of any length are handled whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valora.runtime import spread

# Member names that hold the lists of each level (names vary between exports).
WRAPPERS = ("evaluation", "evaluacion", "evaluación")
SECTIONS = ("sections", "secciones", "bloques")
DIMENSIONS = ("dimensions", "dimensiones")
QUESTIONS = ("questions", "preguntas")
CHUNKS = ("chunks", "chunk_results", "fragmentos")
#: The level a list's entries have, by member name.
LEVEL = {**dict.fromkeys(SECTIONS, 1), **dict.fromkeys(DIMENSIONS, 2), **dict.fromkeys(QUESTIONS, 3), **dict.fromkeys(CHUNKS, 4)}
KINDS = ("", "section", "dimension", "question", "chunk")
#: Levels under which a list may stand: a block's questions have no dimension above them.
UNDER = {1: (0,), 2: (1,), 3: (1, 2), 4: (3,)}

# Marks without a look that may stand before the JSON.
LEAD = " \t\r\n\ufeff\u200b\u200c\u200d\u2060\u00ad\u200e\u200f "

NODE_SCHEMA = (
    "source_table string, record_id long, node_kind string, section_pos int, dimension_pos int, question_pos int,"
    " chunk_pos int, parent_kind string, node_json string"
)

_OPEN, _CLOSE, _COMMA, _COLON = 1, 2, 3, 4
_CLASS = np.zeros(256, np.uint8)
for _c, _k in (("{", _OPEN), ("[", _OPEN), ("}", _CLOSE), ("]", _CLOSE), (",", _COMMA), (":", _COLON)):
    _CLASS[ord(_c)] = _k


class Index:
    """The structural index of a list of JSON texts (bytes)."""

    def __init__(self, texts: list[bytes]):
        # a NUL between texts: outside JSON, and it ends a run of backslashes
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.start = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        self.end = self.start + sizes
        self.buf = buf = b"\0".join(texts) + b"\0"
        a = np.frombuffer(buf, np.uint8)
        quote = np.flatnonzero(a == 34)
        slash = np.flatnonzero(a == 92)
        if len(slash):
            # a quote is escaped if the run of backslashes before it is odd
            first = np.concatenate(([True], np.diff(slash) != 1))
            run_at = np.maximum.accumulate(np.where(first, np.arange(len(slash)), 0))
            odd_end = (np.arange(len(slash)) - run_at) % 2 == 0  # the run up to here has odd length
            last = np.concatenate((np.diff(slash) != 1, [True]))
            quote = quote[~np.isin(quote, slash[last & odd_end] + 1, assume_unique=True)]
        self.quote = quote
        base = np.searchsorted(quote, self.start)  # quotes before a text: parity starts anew with it
        self.quotes_in = np.searchsorted(quote, self.end) - base
        kind = _CLASS[a]
        pos = np.flatnonzero(kind)
        owner = np.searchsorted(self.start, pos, "right") - 1
        outside = (np.searchsorted(quote, pos) - base[owner]) % 2 == 0
        self.pos, self.owner = pos[outside], owner[outside]
        self.kind = kind[self.pos]
        step = (self.kind == _OPEN).astype(np.int64) - (self.kind == _CLOSE)
        total = np.cumsum(step)
        first_tok = np.searchsorted(self.owner, np.arange(len(texts)))
        before = np.concatenate(([0], total))[first_tok]
        depth = total - before[self.owner] if len(self.pos) else total
        self.depth = np.where(self.kind == _OPEN, depth - 1, depth)  # of the container a token stands in
        self.tok0, self.tok1 = first_tok, np.concatenate((first_tok[1:], [len(self.pos)]))

    def balanced(self, i: int) -> bool:
        """Whether text i is one closed value by its index: strings closed, brackets back to depth 0 at its end."""
        if self.quotes_in[i] % 2:
            return False
        t0, t1 = self.tok0[i], self.tok1[i]
        if t0 == t1:
            return True
        return bool(self.depth[t1 - 1] == 0 and self.kind[t1 - 1] == _CLOSE and self.depth[t0:t1].min() >= 0)

    def link(self) -> None:
        """Parent, closing token and list position of every opening token; the colon before a value."""
        n = len(self.pos)
        self.parent = np.full(n, -1, np.int64)
        self.close = np.full(n, -1, np.int64)
        self.nth = np.zeros(n, np.int64)
        is_comma = self.kind == _COMMA
        by_depth = np.argsort(self.depth, kind="stable")
        opens = by_depth[self.kind[by_depth] == _OPEN]
        # in balanced texts the k-th opening of a depth is closed by its k-th closing
        self.close[opens] = by_depth[self.kind[by_depth] == _CLOSE]
        kids = by_depth[(self.kind[by_depth] != _CLOSE) & (self.depth[by_depth] > 0)]
        if len(kids):
            # a token's parent is the last opening one depth above that stands before it
            up = opens[np.searchsorted(self.depth[opens] * n + opens, (self.depth[kids] - 1) * n + kids) - 1]
            self.parent[kids] = up
            commas = np.cumsum(is_comma[kids])
            at_first = np.concatenate(([True], np.diff(up) != 0))
            start = np.where(at_first, commas - is_comma[kids], 0)
            self.nth[kids] = commas - is_comma[kids] - np.maximum.accumulate(start)

    def key_before(self, colon: int) -> str:
        """The member name before a colon token."""
        q = np.searchsorted(self.quote, self.pos[colon])
        raw = self.buf[self.quote[q - 2] + 1 : self.quote[q - 1]]
        return json.loads(b'"' + raw + b'"') if b"\\" in raw else raw.decode("utf-8", "replace")


_SCALAR = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity')
_BLANK = re.compile(r"[ \t\n\r]*")


def complete(text: str) -> bool:
    """Whether a text is one JSON value, by a pushdown automaton, so that its nesting may have any depth."""
    stack: list[str] = []
    i, want = 0, "value"  # what must come: value, first (of a list), key, first key, colon, more or end
    while True:
        i = _BLANK.match(text, i).end()
        if i == len(text):
            return want == "more" and not stack
        c = text[i]
        if want in ("value", "first"):
            if c == "]" and want == "first":
                stack.pop()
                i, want = i + 1, "more"
            elif c in "{[":
                stack.append(c)
                i, want = i + 1, "first key" if c == "{" else "first"
            else:
                m = _SCALAR.match(text, i)
                if not m:
                    return False
                i, want = m.end(), "more"
        elif want in ("key", "first key"):
            if c == "}" and want == "first key":
                stack.pop()
                i, want = i + 1, "more"
            else:
                m = _SCALAR.match(text, i)
                if c != '"' or not m:
                    return False
                i, want = m.end(), "colon"
        elif want == "colon":
            if c != ":":
                return False
            i, want = i + 1, "value"
        else:
            if not stack or c not in ("," + ("}" if stack[-1] == "{" else "]")):
                return False
            if c == ",":
                want = "key" if stack[-1] == "{" else "value"
            else:
                stack.pop()
            i += 1


def _texts_index(texts: list[bytes]) -> tuple[Index, list[int]]:
    """An index of only the complete texts, and which these are."""
    rough = Index(texts)
    good = []
    for i, t in enumerate(texts):
        if rough.balanced(i):
            try:
                json.loads(t)  # confirms what the index found
                good.append(i)
            except RecursionError:
                if complete(t.decode("utf-8", "surrogatepass")):
                    good.append(i)
            except ValueError:
                pass
    ix = rough if len(good) == len(texts) else Index([texts[i] for i in good])
    ix.link()
    return ix, good


def _unquote(text: bytes) -> bytes | None:
    """The content of a JSON text if it is a string that itself holds JSON text."""
    if text[:1] != b'"':
        return None
    try:
        inner = json.loads(text)
    except ValueError:
        return None
    return inner.strip(LEAD).encode("utf-8", "surrogatepass") if isinstance(inner, str) else None


def nodes_of(records: list[tuple[object, str | None, int]], with_json: bool = True) -> list[tuple]:
    """(key, level, positions, parent level, JSON) of every node.

    records: (key, text, level of the objects at the top: 0 for a whole evaluation, 4 for a list of
    chunks).
    """
    out: list[tuple] = []
    # (key, positions so far, text, member level, level above): level 0 = a record's root
    work = [(k, (0, 0, 0, 0), t.lstrip(LEAD).encode("utf-8", "surrogatepass"), lv, 0) for k, t, lv in records if t and t.strip()]
    while work:  # ends, since unwrapped text is shorter than what wrapped it
        ix, good = _texts_index([w[2] for w in work])
        jobs = [work[g] for g in good]
        work = []
        n = len(ix.pos)
        # state of an opening token: what it is, with which positions
        level = np.full(n, -1, np.int16)  # the level of the object that opens here; -2: a list of entries
        entry = {}
        kind, pos, parent, nth, buf = ix.kind, ix.pos, ix.parent, ix.nth, ix.buf
        hidden: list[tuple] = []

        def value_text(colon: int, stop: int) -> bytes:
            return buf[pos[colon] + 1 : stop].strip()

        # roots
        for j, (key, at, text, lv, above) in enumerate(jobs):
            t0, t1 = ix.tok0[j], ix.tok1[j]
            inner = _unquote(text)
            if inner is not None:
                if inner:
                    hidden.append((key, at, inner, lv, above))
            elif t0 < t1 and kind[t0] == _OPEN:
                brace = buf[pos[t0]] == 123
                if lv == 0:
                    if brace:
                        level[t0], entry[t0] = 0, (key, at, 0)
                elif brace:  # an object in place of a list
                    here = at[: lv - 1] + (1,) + at[lv:]
                    level[t0], entry[t0] = lv, (key, here, above)
                else:
                    level[t0], entry[t0] = -2, (key, at, above, lv)
        # tokens in order: a container is always met before what it holds
        last: dict[tuple, tuple] = {}  # (object, member level) -> its last value
        cand = np.flatnonzero((kind == _COLON) | (kind == _OPEN))
        cand_l, kind_l, par_l = cand.tolist(), kind[cand].tolist(), parent[cand].tolist()
        for t, k, p in zip(cand_l, kind_l, par_l, strict=True):
            if k == _OPEN:
                if p >= 0 and level[p] == -2 and buf[pos[t]] == 123:
                    key, at, above, lv = entry[p]
                    level[t], entry[t] = lv, (key, at[: lv - 1] + (int(nth[t]) + 1,) + at[lv:], above)
                continue
            if p < 0 or level[p] < 0 or entry.get(p) is None:
                continue
            lv_p = int(level[p])
            name = ix.key_before(t)
            if lv_p == 0 and name in WRAPPERS and not entry[p][2]:
                lv = 0
            else:
                lv = LEVEL.get(name, -1)
                if lv < 0 or lv_p not in UNDER[lv]:
                    continue
            nxt = t + 1
            key, at, above = entry[p]
            if nxt < n and kind[nxt] == _OPEN and parent[nxt] == p:
                brace = buf[pos[nxt]] == 123
                if lv == 0:
                    if brace:
                        level[nxt], entry[nxt] = 0, (key, at, 1)
                elif brace:
                    level[nxt], entry[nxt] = lv, (key, at[: lv - 1] + (1,) + at[lv:], lv_p)
                else:
                    level[nxt], entry[nxt] = -2, (key, at, lv_p, lv)
                now = ("open", nxt)
            else:
                text = value_text(t, int(pos[nxt]))
                now = ("text", (key, at, text, lv, lv_p)) if text[:1] == b'"' else ("none", None)
            old = last.get((p, lv, name))
            if old and old[0] == "open":  # of two members of one name the last counts
                level[old[1]], entry[old[1]] = -1, None
            last[(p, lv, name)] = now
        for what, job in last.values():
            if what == "text":
                inner = _unquote(job[2])
                if inner:
                    hidden.append((job[0], job[1], inner, job[3], job[4]))
        for t, e in entry.items():
            if e is None or level[t] < 1:
                continue
            if _dropped(t, parent, level, entry):
                continue
            js = buf[pos[t] : pos[ix.close[t]] + 1].decode("utf-8", "replace") if with_json else None
            out.append((e[0], int(level[t]), e[1], e[2], js))
        work = hidden
    return out


def _dropped(t: int, parent: np.ndarray, level: np.ndarray, entry: dict) -> bool:
    """Whether a node hangs below a member that a later one of the same name replaced."""
    p = int(parent[t])
    while p >= 0:
        if level[p] == -1 or entry.get(p) is None:
            return True
        p = int(parent[p])
    return False


def nested_nodes(df: DataFrame, id_col: str, json_col: str, source_table: str, top: str = "record", with_json: bool = True) -> DataFrame:
    """One row per section, dimension, question and chunk object of a JSON column (NODE_SCHEMA).

    top: "record" for whole evaluations, "chunks" for a list of chunks. Positions count from 1 in
    the list as stored; 0 stands for levels below the node or absent above it. A row's parent is
    the row of kind parent_kind with the same positions down to that kind ("" for a root's child).
    node_json is the object's own text; read members from it with get_json_object or from_json.
    """
    top_level = {"record": 0, "chunks": 4}[top]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, texts = pdf.iloc[:, 0].tolist(), pdf.iloc[:, 1].tolist()
            lo = 0
            while lo < len(ids):  # groups of a few MB keep the index small
                hi, size = lo, 0
                while hi < len(ids) and (hi == lo or size < 4_000_000):
                    size += len(texts[hi]) if texts[hi] else 0
                    hi += 1
                rows = nodes_of([(ids[i], texts[i], top_level) for i in range(lo, hi)], with_json)
                lo = hi
                if rows:
                    at = np.array([r[2] for r in rows], np.int32)
                    yield pd.DataFrame(
                        {
                            "source_table": source_table,
                            "record_id": [r[0] for r in rows],
                            "node_kind": [KINDS[r[1]] for r in rows],
                            "section_pos": at[:, 0],
                            "dimension_pos": at[:, 1],
                            "question_pos": at[:, 2],
                            "chunk_pos": at[:, 3],
                            "parent_kind": [KINDS[r[3]] for r in rows],
                            "node_json": [r[4] for r in rows],
                        }
                    )

    return spread(df.select(F.col(id_col).cast("long"), F.col(json_col))).mapInPandas(run, NODE_SCHEMA)


def _number(*paths: str):
    """The first member that is there as double: numbers as such or as text, with a decimal comma or a per-cent sign."""
    raw = F.trim(_any(*paths))
    return F.regexp_replace(F.regexp_replace(raw, ",", "."), r"\s*%$", "").try_cast("double")


def _any(*paths: str):
    return F.coalesce(*(F.nullif(F.get_json_object("node_json", p), F.lit("")) for p in paths))


def flat_tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """The flat tables sections, dimensions, questions and chunks, each with its key and its parent's."""
    key = ["source_table", "record_id", "section_pos", "dimension_pos", "question_pos", "chunk_pos"]
    of = lambda k: nodes.where(F.col("node_kind") == k)
    weight, score = _number("$.weight", "$.ponderacion").alias("weight"), _number("$.score", "$.puntaje").alias("score")
    meta = _any("$.metadata").alias("metadata")
    return {
        "sections": of("section").select(
            *key[:3], _any("$.section_id", "$.id").alias("section_id"), _any("$.title", "$.titulo", "$.nombre").alias("title"), weight, score, _any("$.status", "$.metadata.status", "$.metadata.segmenter_status").alias("status"), meta
        ),
        "dimensions": of("dimension").select(*key[:4], _any("$.name", "$.nombre").alias("name"), weight, score, _any("$.method", "$.metodo_agregacion").alias("method"), meta),
        "questions": of("question").select(*key[:5], "parent_kind", _any("$.question_id", "$.id").alias("question_id"), _any("$.text", "$.texto").alias("text"), weight, score, _any("$.justification").alias("justification"), meta),
        "chunks": of("chunk").select(*key, _any("$.index").alias("index"), score, _any("$.justification").alias("justification"), _any("$.relevant_text").alias("relevant_text"), meta),
    }


def missing_links(tables: dict[str, DataFrame]) -> DataFrame:
    """(node_kind, rows, orphans): rows of every flat table, and those whose parent is in none."""
    key = ["source_table", "record_id", "section_pos", "dimension_pos", "question_pos"]
    above = {"dimension": ("sections", 3), "question": (None, 0), "chunk": ("questions", 5)}
    out = tables["sections"].agg(F.lit("section").alias("node_kind"), F.count(F.lit(1)).alias("rows"), F.lit(0).cast("long").alias("orphans"))
    for kind, (parent, n) in above.items():
        rows = tables[kind + "s"]
        if kind == "question":  # of a dimension, or of a block itself
            up = tables["dimensions"].select(*key[:4]).unionByName(tables["sections"].select(*key[:3]).withColumn("dimension_pos", F.lit(0)))
            n = 4
        else:
            up = tables[parent].select(*key[:n])
        rows = rows.where("section_pos > 0")  # lists of chunks alone have no parents
        hit = rows.select(*key[:n]).join(up.withColumn("there", F.lit(1)), key[:n], "left")
        out = out.unionByName(hit.agg(F.lit(kind).alias("node_kind"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("there").isNull()).alias("orphans")))
    return out
