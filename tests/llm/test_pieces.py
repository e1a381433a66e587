from compare import assert_same
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from valora.llm import pieces, queries


def check(text, limit, overlap):
    out = pieces.cut(text, limit, overlap)
    covered = bytearray(len(text))
    for s, e, _, _ in out:
        assert 0 <= s <= e <= len(text) and (e - s <= limit or len(out) == 1 and len(text) <= limit)
        covered[s:e] = b"\1" * (e - s)
    assert all(c or text[i].isspace() for i, c in enumerate(covered))
    for (a, b, _, _), (c, d, o, _) in zip(out, out[1:], strict=False):
        assert c > a and d > b and o <= overlap and o == max(0, b - c)
    if len(text) > limit:
        assert any(f for *_, f in out) == any(len(x) > limit for x in text.split())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text("ab .", min_size=1, max_size=40), st.just("\n\n"), st.just(". Una frase"), st.text("x", min_size=20, max_size=90)), max_size=30).map("".join), st.integers(20, 60), st.integers(0, 15))
def test_pieces_cover_within_the_limit(text, limit, overlap):
    check(text, limit, overlap)


def test_bounds():
    for t in ("x" * 1500, "x" * 1501, "x" * 1500 + " y", "a " * 900, " " * 2000, "y " + "x" * 1500 + " z", "y " + "x" * 1501 + " z", "w" * 100 + " " + "x" * 1450 + " " + "z" * 1490):
        check(t, 1500, 150)
    assert pieces.cut("", 10, 2) == [(0, 0, 0, False)]


def test_cut_is_at_the_change_of_topic():
    a = "El presupuesto regional financia carreteras y puentes del distrito vial. " * 9
    b = "La escuela rural capacita docentes y alumnos del ciclo educativo. " * 14
    first = pieces.cut(a + b, 1200, 0)[0]
    assert abs(first[1] - len(a)) <= 2


def test_a_deep_valley_at_a_sentence_beats_a_shallow_paragraph():
    a = "El presupuesto regional financia carreteras y puentes del distrito vial. "
    b = "La escuela rural capacita docentes y alumnos del ciclo educativo. "
    text = a * 4 + a[:-1] + "\n" + a * 4 + b * 16
    assert abs(pieces.cut(text, 1200, 0)[0][1] - 9 * len(a)) <= 2


def test_word_ends_follow_cohesion_too():
    a, b = "presupuesto regional financia carreteras puentes distrito vial " * 9, "escuela rural capacita docentes alumnos ciclo educativo " * 16
    assert abs(pieces.cut(a + b, 1200, 0)[0][1] - len(a)) < 80


def test_checks_count_what_is_wrong(spark):
    df = spark.createDataFrame([("palabra " * 900,), ("x" * 4000,), (None,), ("",), (" " * 2000,), ("y",)], "t string")
    assert tuple(pieces.piece_checks(df, "t").first()) == (5, 3, 0, 0, 0)


def test_rows_metadata_and_sql(spark, data, oracle):
    meta = "struct<id:string,source_type:string,strategy:string,chunk_index:int,chunks_in_source:int,length:int,chunk_overlap:int,page:int,relevance:double,was_truncated:boolean>"
    m = ("s_1", "section", "section", 1, 3, 9, 150, 7, 0.5, True)
    df = spark.createDataFrame([(1, "palabra " * 400, m, 1), (2, "corto", m, 2), (3, None, None, 3), (4, "palabra " * 400, None, 4)], f"id int, t string, m {meta}, pieces int")
    rows = pieces.split_texts(df, "t", "m").orderBy("id", "piece_index").collect()
    long = [r for r in rows if r["id"] == 1]
    assert all(r["m"]["length"] == len(r["t"]) <= 1500 and r["m"]["page"] == 7 and r["m"]["chunks_in_source"] == len(long) and r["m"]["was_truncated"] is False for r in long)
    assert [r["m"]["id"] for r in rows if r["id"] == 2] == ["s_1"] and not [r for r in rows if r["id"] == 3]
    assert_same(queries.p6_found(spark, data).toPandas(), oracle.sql(queries.sql()["p6_found"]).df())
    assert pieces.split_texts(df.limit(0), "t", "m").count() == 0
    assert queries.p6_pieces(spark, data).where(F.length("chunk_text") > 1500).count() == 0
