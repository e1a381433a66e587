import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from valora.operators import nested

leaf = st.one_of(st.none(), st.integers(-9, 9), st.floats(allow_nan=False, allow_infinity=False), st.text(max_size=12), st.booleans())


def expected(text, top):
    """A plain walk over the parsed JSON."""
    out = set()

    def load(t):
        t = t.lstrip(nested.LEAD)
        try:
            o = json.loads(t)
        except ValueError:
            return None
        return load(o.strip(nested.LEAD)) if isinstance(o, str) else o

    def items(v):
        if isinstance(v, str):
            v = load(v)
        return [v] if isinstance(v, dict) else v if isinstance(v, list) else []

    def walk(o, level, at):
        names = {1: nested.SECTIONS, 2: nested.DIMENSIONS, 3: nested.QUESTIONS, 4: nested.CHUNKS}
        for lv, keys in names.items():
            if level in nested.UNDER[lv]:
                for k in keys:
                    for i, x in enumerate(items(o.get(k)), 1):
                        if isinstance(x, dict):
                            here = (*at[: lv - 1], i, *at[lv:])
                            out.add((nested.KINDS[lv], *here))
                            walk(x, lv, here)

    o = load(text) if text and text.strip() else None
    if top == 4:
        for i, x in enumerate(items(o) if not isinstance(o, str) else [], 1):
            if isinstance(x, dict):
                out.add(("chunk", 0, 0, 0, i))
    elif isinstance(o, dict):
        inner = o.get("evaluation", o)
        inner = load(inner) if isinstance(inner, str) else inner
        if isinstance(inner, dict):
            walk(inner, 0, (0, 0, 0, 0))
    return out


def found(text, top):
    return {(nested.KINDS[lv], *at) for _, lv, at, _, _ in nested.nodes_of([(1, text, top)])}


def objects(level):
    names = {1: "sections", 2: "dimensions", 3: "questions", 4: "chunks"}
    if level == 4:
        return st.dictionaries(st.sampled_from(["index", "score", 'a"b', "tex\\to"]), leaf, max_size=3)
    child = objects(level + 1)
    lists = st.one_of(st.none(), child, st.lists(st.one_of(st.none(), child), max_size=3), st.lists(child, max_size=2).map(json.dumps))
    return st.tuples(st.dictionaries(st.sampled_from(["id", "x{", "]y"]), leaf, max_size=2), lists).map(lambda t: {**t[0], names[level + 1]: t[1]})


@settings(max_examples=150, deadline=None)
@given(objects(0), st.booleans(), st.sampled_from(["", "\ufeff", " \u200b"]), st.booleans())
def test_index_agrees_with_a_parse(o, wrap, lead, indent):
    text = lead + json.dumps({"rows": [], "evaluation": o} if wrap else o, indent=2 if indent else None, ensure_ascii=not wrap)
    assert found(text, 0) == expected(text, 0)


@settings(max_examples=80, deadline=None)
@given(objects(0), st.integers(1, 60))
def test_cut_records_have_no_nodes(o, cut):
    text = json.dumps(o)
    assert found(text[: max(0, len(text) - cut)], 0) == set() or cut == 0


@pytest.mark.parametrize(
    "text,n",
    [(None, 0), ("", 0), ("  ", 0), ("null", 0), ("[]", 0), ('[{"a":1},null,{"b":2}]', 2), ('{"a":1}', 1), ('"[{\\"a\\":1}]"', 1), ('[{"a":1},', 0), ('[{"a":1}] x', 0), ('[1, "x", {}]', 1), ("[[{}]]", 0)],
)
def test_chunk_lists(text, n):
    assert len(found(text, 4)) == n


def test_text_wrapped_in_text_many_times():
    t = '[{"a": 1}]'
    for _ in range(12):
        t = json.dumps(t, ensure_ascii=False).replace("\\\\", "\\\\")
    assert len(found(t, 4)) == 1


@pytest.mark.parametrize("depth", [50, 100_000])
def test_nesting_of_any_depth(depth):
    deep = "[" * depth + "]" * depth
    text = '{"rows": ' + deep + ', "sections": [{"id": 1, "x": ' + '{"y":' * depth + "1" + "}" * depth + ', "questions": [{}]}]}'
    assert found(text, 0) == {("section", 1, 0, 0, 0), ("question", 1, 0, 1, 0)}
    assert found(text[:-3] + "]}", 0) == set()


@settings(max_examples=300, deadline=None)
@given(st.recursive(leaf, lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.text(max_size=4), x, max_size=3)), max_leaves=12), st.integers(0, 40), st.sampled_from(["", ",", "}", "]", '"', ":", "1", " "]))
def test_automaton_agrees_with_the_parser(o, at, put):
    t = json.dumps(o)
    for x in (t, t[:at] + put + t[at:]):
        try:
            json.loads(x)
            ok = True
        except ValueError:
            ok = False
        assert nested.complete(x) == ok, x


def test_links_are_whole(spark):
    df = spark.createDataFrame([(1, '{"sections":[{"weight":1,"dimensions":[{"ponderacion":"0,5","score":"2","metadata":{"a":1},"questions":[{"chunks":{}}]}]},{"questions":[{}]}]}')], "record_id long, raw string")
    flat = nested.flat_tables(nested.nested_nodes(df, "record_id", "raw", "t"))
    d = flat["dimensions"].first()
    assert (d["weight"], d["score"], d["metadata"]) == (0.5, 2.0, '{"a":1}')
    assert {(r["node_kind"], r["rows"], r["orphans"]) for r in nested.missing_links(flat).collect()} == {("section", 2, 0), ("dimension", 1, 0), ("question", 2, 0), ("chunk", 1, 0)}
    assert nested.missing_links({**flat, "dimensions": flat["dimensions"].limit(0)}).where("node_kind = 'question'").first()["orphans"] == 1


def test_batches_and_extra_columns(spark):
    df = spark.createDataFrame([(1, '{"sections":[{"title":"a","weight":"0,5"}]}', "x"), (1, '{"sections":[{"title":"a","weight":"0,5"}]}', "y"), (2, None, "z")], "record_id long, raw string, node_kind string")
    nodes = nested.nested_nodes(df, "record_id", "raw", "t")
    assert nodes.count() == 2
    s = nested.flat_tables(nodes)["sections"].collect()
    assert [r["weight"] for r in s] == [0.5, 0.5] and s[0]["title"] == "a"
    assert nested.nested_nodes(df.limit(0), "record_id", "raw", "t").count() == 0
