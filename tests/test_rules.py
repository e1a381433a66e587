"""Golden values of scores, cleaning, chunks, loaders and merges."""

import zipfile

import pytest
from pyspark.sql import functions as F

from valora.functions import scales as S
from valora.functions import text as T
from valora.operators import chunks, export, history, pages, prompts, rollup, rubric, scoring, sections
from valora.sources import loaders


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first()


def test_weighted_mean_rules(spark):
    def wm(rows):
        return spark.createDataFrame(rows, "v double, w double").agg(S.weighted_mean(F.col("v"), F.col("w"))).first()[0]

    assert wm([(1.0, 1.0), (3.0, 3.0)]) == 2.5
    assert wm([(1.0, 0.0), (3.0, 0.0)]) == 2.0
    assert wm([(None, 1.0), (3.0, 2.0)]) == 3.0
    assert wm([(None, 1.0)]) is None
    assert wm([(2.0, None), (4.0, 1.0)]) == 4.0


def test_levels_and_half_steps(spark):
    lv = lambda *xs: F.array(*(F.lit(float(x)) for x in xs))
    r = one(spark, a=S.nearest_level(F.lit(2.5), lv(0, 1, 2, 3, 4)), b=S.nearest_level(F.lit(0.8), lv(0, 0.5, 2)), c=S.half_step(F.lit(0.25)), d=S.half_step(F.lit(0.75)), e=S.half_step(F.lit(4.0)), f=S.half_step(F.lit(None).cast("double")))
    assert tuple(r) == (2.0, 0.5, 0.0, 1.0, 2.0, None)
    r = one(spark, a=S.normalised(F.lit(3.5), F.lit(1.0), F.lit(4.0)), b=S.normalised(F.lit(5.0), F.lit(0.0), F.lit(2.0), 0, 100), c=S.normalised(F.lit(1.2), F.lit(0.0), F.lit(2.0), 0, 20), d=S.normalised(F.lit(1.0), F.lit(1.0), F.lit(1.0)))
    assert r["a"] == pytest.approx(5 / 6) and r["b"] == 100.0 and r["c"] == pytest.approx(12.0) and r["d"] is None


def test_constraints_by_type(spark):
    c = lambda s, t, d: S.constrained(F.lit(s).cast("double"), F.lit(t), F.lit(d).cast("string"))
    r = one(spark, a=c(2.5, "Institucional", "calidad"), b=c(0.75, "institucional", "Estructura"), c=c(4.0, "pn", None), d=c(3.3, "politica", "x"), e=c(None, "institucional", "x"))
    assert tuple(r) == (2.0, 1.0, 2.0, 3.3, None)


def test_rollup_golden(spark):
    rows = [("d", "s1", 0.6, "a", 0.5, "q1", 1.0, 1.0), ("d", "s1", 0.6, "b", 1.0, "q2", 0.6, 2.0), ("d", "s1", 0.6, "b", 1.0, "q3", 0.4, None), ("d", "s2", 0.4, "a", 1.0, "q4", 1.0, 3.0), ("d", "s3", None, "a", None, "q5", None, None)]
    df = spark.createDataFrame(rows, "doc string, section_id string, section_weight double, dimension_name string, dimension_weight double, question_id string, question_weight double, question_score double")
    out = rollup.rollup(df, ["doc"])
    assert out["documents"].first()["document_score"] == pytest.approx(0.6 * (0.5 * 1 + 1 * 2) / 1.5 + 0.4 * 3)
    bd = rollup.criterion_breakdown(df.withColumn("dimension_name", F.lit("Claridad y coherencia")), ["doc"])
    r = rollup.institutional_index(bd, ["doc"]).first()
    assert r["raw_index"] == pytest.approx(0.35 * (1 + 2 + 3) / 12)


def test_index_golden(spark):
    rows = [("d", "estructura", 1.0), ("d", "Claridad y Coherencia", 2.0), ("d", "pertinencia", 3.0)]
    df = spark.createDataFrame(rows, "doc string, dimension_name string, question_score double").withColumns({"section_weight": F.lit(1.0), "dimension_weight": F.lit(1.0)})
    assert rollup.institutional_index(rollup.criterion_breakdown(df, ["doc"]), ["doc"]).first()["raw_index"] == pytest.approx(0.675)


def test_pages_and_cleaning(spark):
    text = "Ministerio de Prueba\nPágina 1 de 3\ncuerpo uno\nFuente: INEI\n\f"
    docs = spark.createDataFrame([(1, "".join(text.replace("1 de", f"{i} de").replace("uno", f"texto {i}") for i in (1, 2, 3)))], "id int, t string")
    p = pages.split_pages(docs, "id", "t")
    assert p.count() == 3
    c = pages.classified_lines(pages.lines_of(p, "id"), p, "id")
    r = pages.cleaning_report(c, "id").first()
    assert r["headers_removed"] >= 3 and r["source_lines_removed"] + r["footers_removed"] >= 3
    assert all("cuerpo" in x["text"] for x in pages.cleaned(c, "id").collect())
    assert pages.split_pages(docs.limit(0), "id", "t").count() == 0
    none = spark.createDataFrame([(1, None), (2, "")], "id int, t string")
    assert pages.split_pages(none, "id", "t").count() == 0


def test_page_numbers(spark):
    t = spark.createDataFrame([("Informe - 2",), ("12 — Informe",), ("Página 2 de 140",), ("Sin",)], "t string")
    assert [r[0] for r in t.select(T.drop_trailing_page_number(F.col("t"))).collect()] == ["Informe", "12 — Informe", "", "Sin"]


def test_ratio():
    assert pages.indel_ratio("", "") == 100.0 and pages.indel_ratio("abc", "abc") == 100.0
    assert pages.indel_ratio("abcd", "abxd") == pytest.approx(75.0)
    assert sections.token_set_ratio("marco del problema", "problema marco del") == 100.0


def test_line_chunks_cover_the_text():
    text = "\n".join(f"línea {i} " + "x" * (i % 90) for i in range(200))
    cs = chunks.merge_lines(text, 500, 80)
    assert all(len(c) <= 500 for c in cs)
    for line in text.split("\n"):
        assert any(line.strip() in c for c in cs)
    assert chunks.merge_lines("", 10, 2) == [] and chunks.merge_lines("x" * 50, 10, 2) == ["x" * 50]
    with pytest.raises(ValueError):
        chunks.check_size(10, 10)


def test_theta_join_equals_the_condition(spark):
    q = spark.createDataFrame([("q1", "A"), ("q2", "b"), ("q3", None), ("q4", " ")], "q string, qs string")
    c = spark.createDataFrame([(1, "a"), (2, "B "), (3, None), (4, "")], "c int, cs string")
    got = {(r["q"], r["c"]) for r in scoring.question_chunk_pairs(q, c, "qs", "cs").collect()}
    n = lambda x: (x or "").strip().lower()
    want = {(a, b) for a, x in [("q1", "A"), ("q2", "b"), ("q3", None), ("q4", " ")] for b, y in [(1, "a"), (2, "B "), (3, None), (4, "")] if not n(x) or not n(y) or n(x) == n(y)}
    assert got == want


def test_remote_scorer_keeps_failures(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "id long, prompt string").coalesce(1)

    def make():
        calls = {"n": 0}

        def score(ps):
            calls["n"] += 1
            if "p3" in ps:
                raise OSError("down")
            return ['{"score": 1}' for _ in ps]

        return score

    out = {r["id"]: r for r in scoring.remote_scores(df, "id", "prompt", make, retries=1, delay=0.0, batch=1).collect()}
    assert len(out) == 5 and out[3]["payload"] is None and out[3]["error"] == "down" and out[3]["attempts"] == 2 and out[0]["error"] is None


def test_remote_scorer_corrects_snaps_and_falls_back(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(6)], "id long, prompt string").coalesce(1)
    levels = (0.0, 0.5, 1.0, 1.5, 2.0)

    def make():
        calls = {"n": 0}

        def score(ps):
            calls["n"] += 1
            if calls["n"] == 1:
                raise scoring.TransientError("busy")  # mended by the inner layer
            if ps[0].startswith("p5"):
                raise PermissionError("bad key")
            if ps[0] == "p1":
                return ["puntaje dos"]  # mended by a correction
            if ps[0].startswith("p2"):
                return ["nunca"]
            if ps[0] == "p3":
                return ['```json\n{"score": "0,74", "x": "ñ"}\n```']
            return ['{"score": 1.0}']

        return score

    out = {r["id"]: r for r in scoring.remote_scores(df, "id", "prompt", make, retries=0, delay=0.0, batch=1, levels=levels, make_fallback=lambda: lambda ps: ['{"score": 2}'] * len(ps), waits=(0.0, 0.0)).collect()}
    assert out[0]["payload"] == out[1]["payload"] == '{"score": 1.0}' and out[1]["attempts"] == 2
    assert out[2]["payload"] is None and "correction" in out[2]["error"]
    assert out[3]["payload"] == '{"score": 0.5, "x": "ñ"}' and out[3]["adjusted_from"] == 0.74
    assert out[5]["payload"] == '{"score": 2}' and "fallback" in out[5]["error"]

    def slow():
        import time

        return lambda ps: (time.sleep(3), ps)[1]

    got = scoring.remote_scores(df.limit(1), "id", "prompt", slow, retries=0, timeout=0.2).first()
    assert got["payload"] is None and "Timeout" in got["error"]
    denied = scoring.remote_scores(df.limit(1), "id", "prompt", lambda: lambda ps: (_ for _ in ()).throw(PermissionError("no")), retries=2, delay=0.0).first()
    assert denied["attempts"] == 1 and "not authorised" in denied["error"]


def test_weights_of_chunks_and_auto_scores(spark):
    w = [r[0] for r in spark.createDataFrame([('{"weight": 2}',), ('{"chunk_metadata": {"peso": "0,5"}}',), ('{"relevance": "x", "peso": 1}',), ("{}",), (None,)], "m string").coalesce(1).select(scoring.metadata_weight(F.col("m"))).collect()]
    assert w == [2.0, 0.5, 1.0, None, None]
    rows = [("Institucional", "Estructura", "S", "x"), ("institucional", "estructura", "s", "Prioridades de la Política Institucional"), ("pn", "estructura", "s", "x"), ("institucional", "estructura narrativa", "s", "x"), (None, None, None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, d string, s string, n string").coalesce(1).select(scoring.auto_scored(F.col("t"), F.col("d"), F.col("s"), F.col("n"))).collect()]
    assert got == [True, False, False, False, False]


def test_evaluation_branches(spark, monkeypatch):
    """Presence, skips, gate, imputation and blocks, each on a report of its own."""
    from valora.plans import pipeline

    rub = [("institucional", "s1", "Uno", 0.6, "estructura", 0.5, "q1", "¿Está la sección uno?", 1.0, 0.0, 4.0), ("institucional", "s1", "Uno", 0.6, "pertinencia", 0.5, "q2", "¿Es pertinente la sección uno?", 1.0, 0.0, 4.0),
           ("institucional", "s2", "Dos", 0.4, "pertinencia", 1.0, "q3", "¿Es pertinente la sección dos?", 1.0, 0.0, 4.0), ("politica_nacional", "b1", "Bloque", 1.0, "d", 0.3, "q4", "¿Es coherente el bloque?", 1.0, 0.0, 2.0)]
    rubric_ = spark.createDataFrame(rub, "tipo_informe string, section_id string, section_title string, section_weight double, dimension_name string, dimension_weight double, question_id string, question_text string, question_weight double, scale_min double, scale_max double")
    good = "El informe presenta la evaluación de los resultados para las regiones con que se midió el avance según la meta. "
    rows = [("a", "institucional", "S1", good, 1.0, False, False), ("a", "institucional", "s2", "  ", 1.0, False, False), ("b", "institucional", "s2", good, None, False, True), ("c", "politica_nacional", "b1", good, 1.0, False, False), ("d", "institucional", "s1", "x" * 13000, 1.0, False, False), (None, "institucional", "s1", good, 1.0, False, False)]
    chunks_ = spark.createDataFrame(rows, "document_id string, tipo_informe string, section_id string, chunk_text string, weight double, was_truncated boolean, failed boolean")
    res = pipeline.question_results(chunks_, rubric_)
    got = {(r["document_id"], r["question_id"]): r for r in res.collect()}
    assert len(got) == 3 * 3 + 1
    assert got["a", "q1"]["question_score"] == 1.0 and got["a", "q1"]["how"] == "presence" and got["a", "q2"]["how"] == "scored"
    assert (got["a", "q3"]["status"], got["a", "q3"]["question_score"], got["a", "q3"]["how"]) == ("empty", 0.0, "skipped")
    assert (got["b", "q1"]["status"], got["b", "q1"]["question_score"]) == ("missing", 0.0) and got["b", "q3"]["question_score"] == 1.0  # imputed
    assert got["c", "q4"]["dimension_name"] is None and got["c", "q4"]["dimension_weight"] == 1.0 and got["c", "q4"]["question_score"] in (0.0, 0.5, 1.0, 1.5, 2.0)
    monkeypatch.setattr(prompts, "GATE", 1.01)
    shut = {(r["document_id"], r["question_id"]): r for r in pipeline.question_results(chunks_, rubric_).collect()}
    assert shut["d", "q2"]["question_score"] is None and shut["d", "q2"]["rejected"] == 1 and shut["d", "q2"]["how"] == "without score" and shut["a", "q1"]["how"] == "presence"
    monkeypatch.undo()
    out = {r["document_id"]: r for r in pipeline.evaluate_reports(res).collect()}
    assert out["c"]["index"] == got["c", "q4"]["question_score"] * 10 and out["a"]["presence"] == 1 and set(out) == {"a", "b", "c", "d"}


def test_metrics_by_type_and_fallbacks(spark):
    rows = [("a", "institucional", "otra", 3.0), ("b", "Politica", "x", 1.2), ("c", "libre", "x", 0.4), ("d", "institucional", "otra", None), ("e", "institucional", "pertinencia", 2.0), ("e", "institucional", "estructura", 1.0)]
    df = spark.createDataFrame([(d, t, "s", 1.0, n, 1.0, 1.0, x) for d, t, n, x in rows], "document_id string, tipo_informe string, section_id string, section_weight double, dimension_name string, dimension_weight double, question_weight double, question_score double")
    m = {r["document_id"]: (r["raw_index"], r["index"]) for r in rollup.metrics(df, ["document_id"], "tipo_informe").collect()}
    assert m["a"] == (3.0, 75.0) and m["b"] == (1.2, 12.0) and m["c"] == (0.4, None) and m["d"] == (None, None) and m["e"] == pytest.approx((0.35, 35.0))
    assert {r["document_id"]: (r["raw_index"], r["index"]) for r in rollup.metrics(df, ["document_id"], "tipo_informe", strict=True).collect()}["a"] == (0.0, 0.0)


def test_prompt_rules_fire(spark):
    body = "El informe presenta la evaluación de los resultados para las regiones con que se midió el avance según la meta. " * 6
    good = f"Rol asignado\nObjetivo\nEscala de valoración: 0 1 2\nInstrucciones de respuesta\nFormato de salida\n{prompts.START}\n{body}\n{prompts.END}"
    cases = {"good": (good, False), "short": (good[:100], False), "marker": (good.replace("avance", prompts.TRUNCATED, 1), False), "unmarked": (good, True), "english": (f"{prompts.START} " + "the report explains this " * 30 + prompts.END, False)}
    df = spark.createDataFrame([(k, p, w) for k, (p, w) in cases.items()], "k string, p string, w boolean")
    lv = F.array(F.lit(0.0), F.lit(2.0))
    q = {r["k"]: r["q"] for r in df.select("k", prompts.native_quality(F.col("p"), F.lit("Escala de valoración"), lv, F.col("w")).alias("q")).collect()}
    assert q["good"] == 1.0 and q["unmarked"] == 0.95 and q["marker"] == 0.95 and q["short"] < 0.7 and q["english"] < 0.65
    js = {r[0]: r[1] for r in spark.createDataFrame([("a", 'x {"score": <n>, "justification": "<t>"} y'), ("b", "nada"), ("c", '{"score": , "justification": 1}'), ("d", None)], "k string, p string").select("k", prompts.json_block_ok("p")).collect()}
    assert js == {"a": True, "b": False, "c": False, "d": None}


def test_merge_keeps_what_is_blank(spark):
    cols = "k string, n double, t string"
    p = spark.createDataFrame([("A", 1.0, "viejo"), ("b", 2.0, "b"), (None, 9.0, "nulo")], cols)
    u = spark.createDataFrame([("a ", None, " "), ("c", 3.0, "c")], cols)
    got = {r["k"]: (r["n"], r["t"]) for r in history.merge_results(p, u, ["k"], ["n"], ["t"]).collect()}
    assert got == {"A": (1.0, "viejo"), "b": (2.0, "b"), "c": (3.0, "c"), None: (9.0, "nulo")}


def test_history_in_order(spark):
    df = spark.createDataFrame([("d", 2, "v2"), ("d", 1, "v1"), ("d", 3, "v1"), ("d", 4, None)], "d string, at int, v string")
    assert history.history(df, ["d"], "at", "v").first()["history"] == ["v1", "v2"]


def test_rubric_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"tipo_informe":"institucional","secciones":[{"id":"s","titulo":"S","ponderacion":0,"peso":0.4,"dimensiones":[{"nombre":"D","ponderacion":1,"preguntas":[{"id":"q","texto":"t","ponderacion":"0,5","niveles":[{"valor":2},{"valor":0}]}]}]}]}')
    (tmp_path / "b.json").write_text('{"tipo_informe":"pn","bloques":[{"id":"b","nombre":"B","ponderacion":0.6,"preguntas":[{"id":"q1","texto":"t","ponderacion":1}]}]}')
    flat = {r["question_id"]: r for r in rubric.flat_rubric(rubric.read_rubrics(spark, str(tmp_path))).collect()}
    assert flat["q"]["section_weight"] == 0.4 and flat["q"]["question_weight"] == 0.5 and flat["q"]["levels"] == [0.0, 2.0]
    assert flat["q1"]["dimension_name"] is None and flat["q1"]["section_title"] == "B"
    (tmp_path / "c.json").write_text('{"tipo_informe":"politica_nacional","escala":{"min":0,"max":2},"bloques":[{"id":"b","titulo":"B","ponderacion":0.5,"tipo":"manual","preguntas":[{"id":"q1","ponderacion":1,"niveles":[{"valor":0,"descripcion":"x"},{"valor":3,"descripcion":"y"},{"valor":3,"descripcion":"z"}]},{"id":"q2","ponderacion":0.5}]}]}')
    (tmp_path / "d.json").write_text('{"tipo_informe": ')
    got = {(r["severity"], r["code"]) for r in rubric.validate(spark, str(tmp_path)).collect()}
    assert {("error", "not_json"), ("warning", "unknown_type"), ("error", "scale_key_missing"), ("error", "weights_of_blocks"), ("error", "weights_of_questions"), ("error", "level_above_scale"), ("warning", "duplicate_level"), ("error", "no_levels"), ("error", "not_manual")} <= got
    assert rubric.found_file(spark, str(tmp_path), "A.JSON").endswith("/a.json")
    with pytest.raises(FileNotFoundError):
        rubric.found_file(spark, str(tmp_path), "z.json")
    assert rubric.stable_hash({"b": 1, "a": 2}) == rubric.stable_hash({"a": 2, "b": 1})


def test_loaders(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("uno\f dos\xff".encode("latin-1"))
    (tmp_path / "b.xyz").write_text("?")
    (tmp_path / "c.docx").write_bytes(b"no zip")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hola</w:t><w:br w:type="page"/></w:r></w:p><w:p><w:r><w:t>Fin</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc/></w:tr></w:tbl></w:body></w:document>')
    docs, bad = loaders.load_documents(spark, str(tmp_path))
    got = {r["path"][-5:]: r for r in docs.collect()}
    assert got["a.txt"]["pages"] == ["uno", " dos"] and got[".docx"]["pages"] == ["Hola", "Fin"] and got[".docx"]["tables"] == [[["x"]]]
    assert bad.count() == 2
    assert loaders.load_summary(docs).count() == 2
    assert {r["metadata"]["path"] for r in loaders.with_metadata(docs, {"path": "p"}).collect()} == {"p"}
    assert loaders.latest_file(spark, str(tmp_path), "*.txt").endswith("a.txt")
    with pytest.raises(FileNotFoundError):
        loaders.latest_file(spark, str(tmp_path), "*.none")
    with pytest.raises(ValueError):
        loaders.register_loader(" ", loaders.load_txt)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("d", "s", "q", 1.0), ("d", "s", "q2", None)], "document_id string, section_id string, question_id string, question_score double")
    for fmt in ("parquet", "csv", "json", "orc"):
        assert spark.read.format(fmt).option("header", True).load(export.write(df, str(tmp_path / fmt), fmt)).count() == 2
    assert open(export.write_single_csv(df, str(tmp_path / "x.csv")), "rb").read().startswith(b"\xef\xbb\xbfdocument_id")
    with pytest.raises(ValueError):
        export.write(df, str(tmp_path / "y"), "doc")
    many = spark.range(950).selectExpr("if(id % 3 = 0, NULL, 'd') AS document_id", "if(id % 5 = 0, NULL, 's') AS section_id", "id AS q", "CAST(NULL AS double) AS score")
    docs = export.payload(many, ["document_id"], many.groupBy("document_id").agg(F.count(F.lit(1)).alias("rows")), {"v": "1"}, most=100).collect()
    assert len(docs) == 7 + 4 and all('"metrics":{"rows":' in r["payload"] and '"extra":{"v":"1"}' in r["payload"] for r in docs)
    back = export.payload_rows(spark.createDataFrame(docs), ["document_id"], "q:bigint,score:double")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, many.collect()), key=str)


def test_plans_stay_native(spark, data):
    from valora.queries import scores

    for name in ("rollup_documents", "prompt_quality", "doc_score_flagship", "criterion_breakdown", "theta_pairs", "cross_flagged", "evaluation_full", "metrics_dispatch"):
        plan = scores.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_no_query_joins_without_a_key(spark, data):
    from valora import queries

    for name in ("segment_text", "chunk_fallback", "section_lookup", "merge_upsert", "export_payload", "clean_report", "export_flat", "quality_summary"):
        plan = queries.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_ocr_errors_stay_with_their_page(spark):
    from valora.sources import ocr

    df = spark.createDataFrame([("d", 0, bytearray(b"ok")), ("d", 1, bytearray(b"bad")), ("d", 2, None)], "document_id string, page_index int, image binary")

    def make():
        def read(b):
            if b == b"bad":
                raise ValueError("ilegible")
            return b.decode()

        return read

    out = {r["page_index"]: (r["ocr_text"], r["error_text"]) for r in ocr.read_pages(df, make).collect()}
    assert out[0] == ("ok", None) and out[1] == (None, "ilegible") and out[2][0] is None and out[2][1]


def test_stride_windows(spark):
    rows = [("",), (None,), ("abc",), ("abcdefghij",), ("ñandú😀xyzñ",), ("a\nb\nc\nd\ne",)]
    df = spark.createDataFrame(rows, "t string")
    for size, overlap in ((4, 0), (4, 1), (4, 3), (100, 10)):
        for (t,), got in zip(rows, [r[0] for r in df.coalesce(1).select(chunks.stride_windows(F.col("t"), size, overlap)).collect()], strict=True):
            assert got == (None if t is None else [t[i : i + size] for i in range(0, len(t), size - overlap)])


def test_registries_and_small_rules(spark, tmp_path):
    from valora.operators import learning, lookups

    scoring.register_scorer("Eco", lambda: lambda ps: ps)
    assert scoring.scorer(" eco ")()(["a"]) == ["a"]
    with pytest.raises(ValueError):
        scoring.scorer("otro")
    e = {"institucional": "i", "politica": "p", "politica_nacional": "pn"}
    df = spark.createDataFrame([("Institucional",), ("POLITICA_NACIONAL",), ("politica x",), ("nueva política",), ("otro",), (None,)], "t string").coalesce(1)
    assert [r[0] for r in df.select(lookups.prioritised(F.col("t"), e, "?")).collect()] == ["i", "pn", "p", "p", "?", "?"]
    r = one(spark, a=T.filled_list(F.array(F.lit(" a "), F.lit(" "), F.lit(None))), b=T.filled_list(F.lit(None).cast("array<string>")), c=T.preview(F.lit("abcdef"), 3), d=T.preview(F.lit("abc"), 3))
    assert tuple(r) == (["a"], [], "abc…", "abc")
    assert export.field_dictionary(df).first()["field"] == "t"
    rows = spark.createDataFrame([(i, "s", "c", f"texto {'bueno' if i % 2 else 'malo'} {i}", float(i % 2) * 4, 10.0, 3.0) for i in range(60)], "row_id long, seccion string, criterio string, texto string, label double, chars double, words double")
    model, scored = learning.train(rows, alphas=(1.0,), folds=2, vocabulary=256)
    learning.save(model, str(tmp_path / "m"))
    a = {r["row_id"]: r["prediction"] for r in learning.predict(learning.load(str(tmp_path / "m")), rows).collect()}
    assert all(a[r["row_id"]] == pytest.approx(r["prediction"]) for r in scored.collect())
    assert learning.error_metrics(scored, "label", "prediction", []).first()["mae"] < 1.0
    assert learning.correlation(scored.withColumn("k", F.lit(1.0)), "label", "k").first()["pearson"] == 0.0
