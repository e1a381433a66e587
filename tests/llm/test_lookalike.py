import random
import unicodedata

import pytest
from compare import assert_same

from valora.llm import lookalike, queries


def pairs(spark, rows):
    df = spark.createDataFrame(rows, "id long, t string, look_m string")  # a clashing extra column
    c = lookalike.classes(df.select("id", "t"), "id", "t", "x")
    from valora.runtime import keep

    return {(r["id_a"], r["id_b"]) for r in lookalike.differing_pairs(keep(c, "t")).collect()}


def test_same_look_and_visible_changes(spark):
    rows = [
        (1, "véase la región", ""), (2, unicodedata.normalize("NFD", "véase la región"), ""), (3, "véase\u00a0la\u2007región", ""), (4, "vé\u200base la regió\u00adn", ""), (5, "ｖéase la región", ""), (6, "véаse lа región", ""),
        (7, "vease la región", ""), (8, "Véase la región", ""), (9, "véase la región.", ""), (10, "véase laregión", ""),
        (11, "área m²", ""), (12, "área m2", ""), (13, "ﬁn", ""), (14, "fin", ""), (15, None, ""), (16, " \u200b", ""), (17, "", ""), (18, "véase la región", ""),
    ]
    same = [1, 2, 3, 4, 5, 6, 18]
    want = {(a, b) for a in same for b in same if a < b} - {(1, 18)} | {(13, 14)}
    assert pairs(spark, rows) == want


def test_random_variants_against_normalisation(spark):
    rng = random.Random(5)
    words = ["acción", "señal", "niño", "avance", "región", "cuadro"]
    rows = []
    for i in range(300):
        t = " ".join(rng.choice(words) for _ in range(2))
        for _ in range(rng.randint(0, 2)):
            t = rng.choice([lambda x: unicodedata.normalize("NFD", x), lambda x: x.replace(" ", "\u00a0"), lambda x: x.replace("a", "а", 1), lambda x: x[:2] + "\u200d" + x[2:], lambda x: x.upper()])(t)
        rows.append((i, t, "x"))
    table = str.maketrans({"\u00a0": " ", "а": "a", "А": "A", "\u200d": None})
    key = {i: unicodedata.normalize("NFC", t.translate(table)) for i, t, _ in rows}
    text = {i: t for i, t, _ in rows}
    want = {(a, b) for a in key for b in key if a < b and key[a] == key[b] and text[a] != text[b]}
    assert pairs(spark, rows) == want


def test_canonical_form_is_equal_within_a_class(spark):
    df = spark.createDataFrame([(1, "acción", 1), (2, unicodedata.normalize("NFD", "acción"), 2), (3, None, 3), (4, "otra", 4)], "id int, t string, look_text int")
    out = {r["id"]: r for r in lookalike.canonicalize(df, "t").collect()}
    assert out[1]["look_text"] == out[2]["look_text"] and out[3]["look_text"] is None and out[4]["look_text"] == "otra"
    assert lookalike.canonicalize(df.select("id", "t").limit(0), "t").count() == 0


def look(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    out = {r["id"]: r["look_text"] for r in lookalike.canonicalize(df, "t").collect()}
    return [out[i] for i in range(len(texts))]


def test_other_scripts_come_out_as_they_are(spark):
    assert look(spark, ["Отчёт о ходе", "СОРТ", "асta final", "el Отчёт а tiempo", "νόμος"]) == ["Отчёт о ходе", "СОРТ", "acta final", "el Отчёт a tiempo", "νόμος"]
    # a Latin text that looks the same comes out for both
    assert look(spark, ["СОР", "COP", "СОР"]) == ["COP"] * 3


def test_styled_forms_and_joiners(spark):
    assert look(spark, ["𝐀cta", "Ⅳ etapa", "ﬁn", "ａｂ", "a\u200db", "می\u200cخواهم", "میخواهم", "m²", "m2"]) == ["Acta", "IV etapa", "fin", "ab", "ab", "می\u200cخواهم", "میخواهم", "m²", "m2"]


def test_tables_pair_up():
    assert all(len(c) == 1 for t in (lookalike.style_table()[0], lookalike.script_table()) for c in t.values())
    assert lookalike.script_table()["ё"] == "ë" and "З" not in lookalike.script_table()


def test_long_members_are_not_broadcast(spark):
    """Members are judged by their bytes: 10 kB texts beyond 64 MB go through a shuffled join."""
    from valora import runtime

    big = spark.range(7000).selectExpr("id AS look_b", "id AS look_h", "repeat('x', 10000) AS look_text")
    assert "broadcast" not in runtime.small_side(runtime.keep(big, "t"))._jdf.queryExecution().logical().toString().lower()
    few = runtime.keep(big.limit(100), "t")
    assert "broadcast" in runtime.small_side(few)._jdf.queryExecution().logical().toString().lower()


def test_classes_count_their_links(spark, monkeypatch):
    rows = [(1, "acción", ""), (2, unicodedata.normalize("NFD", "acción"), ""), (3, "acción", ""), (4, "otra", ""), (5, "ac\u200bción", ""), (6, "otra", ""), (7, None, "")]
    from valora import runtime

    monkeypatch.setattr(runtime, "SALT_ROWS", 1)
    df = spark.createDataFrame(rows, "id long, t string, look_m string")
    out = lookalike.class_members(runtime.keep(lookalike.classes(df, "id", "t", "x"), "t")).collect()
    assert {(r["id"], r["class_id"], r["links"]) for r in out} == {(1, 1, 2), (2, 1, 3), (3, 1, 2), (5, 1, 3)}
    assert pairs(spark, rows) == {(1, 2), (1, 5), (2, 3), (2, 5), (3, 5)}


@pytest.mark.parametrize("name", sorted(queries.sql()))
def test_query_matches_sql(spark, data, oracle, name):
    assert_same(queries.QUERIES[name](spark, data).toPandas(), oracle.sql(queries.sql()[name]).df())
