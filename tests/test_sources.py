"""Sources and sinks: PDF cascade with stand-in readers, workbooks, section schemas, events, merged streams."""

import zipfile

import pytest
from pyspark.sql import functions as F

from valora.operators import export, prompts, sections
from valora.sources import loaders, pdf, schemas, workbook
from valora.streaming import ingest


class Page:
    def __init__(self, text="", words=(), chars=()):
        self.text, self.words, self.chars = text, list(words), list(chars)

    def extract_text(self):
        return self.text

    def extract_words(self):
        return self.words


def test_pdf_cascade():
    R = pdf.Readers
    assert pdf.read(b"", R(quick=lambda d: ["uno"], layout=lambda d: ["UNO"])).pages == ["UNO"]
    assert pdf.read(b"", R(quick=lambda d: ["uno"], layout=lambda d: [" "])).pages == ["uno"]
    scanned = pdf.read(b"", R(quick=lambda d: ["--", ""], layout=lambda d: ["never"], ocr=lambda d: ["leído"]))
    assert scanned.pages == ["leído"] and scanned.was_ocr and not scanned.tables

    def broken(d):
        raise ValueError("roto")

    out = pdf.read(b"", R(quick=broken, layout=lambda d: ["x"], tables=(broken, lambda d: [[["a"]]], lambda d: [[["a", None], ["c", 1]]]), images=lambda d: [(1, 100, 100, b"s"), (2, 300, 100, b"l")]))
    assert out.pages == ["x"] and out.tables == [[["a", ""], ["c", "1"]]] and [i[0] for i in out.images] == [2] and len(out.issues) == 2
    with pytest.raises(RuntimeError):
        pdf.read(b"", R())
    with pytest.raises(RuntimeError):
        pdf.read(b"", R(quick=lambda d: [""]))


def test_pdf_page_fallbacks():
    assert pdf.layout_text(Page("a b")) == "a b" and pdf.layout_text(Page(words=[{"text": "uno"}, {"text": "dos"}])) == "uno dos"
    chars = [{"text": "b", "top": 10.04, "x0": 2}, {"text": "a", "top": 10.0, "x0": 1}, {"text": "c", "top": 20.0, "x0": 0}, {"text": " ", "top": 30.0, "x0": 0}]
    assert pdf.layout_text(Page(chars=chars)) == "ab\nc"
    assert pdf.first_meaningful(lambda: "--", lambda: 1 / 0, lambda: None, lambda: " x1 ") == "x1" and pdf.first_meaningful(lambda: "-") == ""


def test_pdf_files_are_loaded_or_reported(spark, tmp_path, monkeypatch):
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    monkeypatch.setitem(loaders.LOADERS, ".pdf", lambda data: loaders.Loaded(["p"], images=[(1, 200, 200, b"i")], issues=["x", "x"]))
    (tmp_path / "b.txt").write_text("hola")
    (tmp_path / "c.zzz").write_text("?")
    docs, bad = loaders.load_documents(spark, str(tmp_path))
    r = {x["path"][-5:]: x for x in loaders.load_summary(docs).collect()}
    assert (r["a.pdf"]["images"], r["a.pdf"]["issues"], r["b.txt"]["images"]) == (1, 1, 0)
    ev = loaders.load_events(docs, bad).collect()
    assert sorted(e["event"] for e in ev) == ["failed", "started", "started", "started", "succeeded", "succeeded"]
    raw = F.create_map(F.lit("pages"), F.lit("9"), F.lit("autor"), F.lit("A"), F.lit("loader_context"), F.lit("lc"))
    m = loaders.with_metadata(docs, {"tipo": "t"}, raw).where("path LIKE '%a.pdf'").first()
    assert m["metadata"]["pages"] == "1" and m["metadata"]["autor"] == "A" and m["metadata"]["tipo"] == "t" and "loader_context" not in m["metadata"] and m["loader_context"] == "lc"


def test_workbook_round_trip(spark, tmp_path, monkeypatch):
    rows = [("d1", "Sección <1>", 1.5, True, ["a"], None), ("d2", "ñ\x07 & co", None, False, [], "x" * 100), (None, "", -2.0, None, None, "=1+1")]
    df = spark.createDataFrame(rows, "document_id string, section_title string, question_score double, ok boolean, xs array<string>, relevant_text string").coalesce(1)
    head = spark.createDataFrame([("institucional", "m", "t0")], "tipo_informe string, model_name string, timestamp string")
    at = workbook.write_workbook({"preguntas": df, "indice_global": head}, str(tmp_path / "a.xlsx"))
    got = [r["cells"] for r in workbook.read_workbooks(spark, str(tmp_path)).where("sheet = 'preguntas'").orderBy("row_no").collect()]
    assert got[0] == {"document_id": "d1", "section_title": "Sección <1>", "question_score": "1.5", "ok": "true", "xs": '["a"]'}
    assert got[1]["section_title"] == "ñ & co" and len(got[1]["relevant_text"]) == 100 and got[2]["relevant_text"] == "=1+1" and "document_id" not in got[2]
    t = workbook.training_dataset(spark, str(tmp_path)).collect()
    assert len(t) == 3 and t[0]["score"] == 1.5 and {r["tipo_informe"] for r in t} == {"institucional"} and t[0]["timestamp"] == "t0"
    monkeypatch.setattr(workbook, "SHEET_ROWS", 3)
    workbook.write_workbook({"n": spark.range(5).coalesce(1)}, str(tmp_path / "b.xlsx"))
    names = {r["sheet"] for r in workbook.read_workbooks(spark, str(tmp_path / "b.xlsx")).collect()}
    assert names == {"n", "n_2", "n_3"} and workbook.read_workbooks(spark, str(tmp_path / "b.xlsx")).count() == 5
    with pytest.raises(ValueError):
        workbook.write_workbook({"n": spark.createDataFrame([("x" * 40_000,)], "t string")}, str(tmp_path / "c.xlsx"))
    assert zipfile.is_zipfile(at)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "e.xlsx").write_bytes(b"no zip")
    assert "BadZipFile" in workbook.read_workbooks(spark, str(tmp_path / "d")).first()["issue"]


def test_shared_strings_and_gaps():
    import io

    buf = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="s" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="/xl/worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>uno</t></si><si><r><t>d</t></r><r><t>os</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="2"><c r="A2" t="s"><v>1</v></c><c r="AB2"><v>3</v></c></row></sheetData></worksheet>')
    (row,) = workbook.read_sheets(buf.getvalue())
    assert row[:2] == ("s", 2) and row[2][0] == "dos" and row[2][27] == "3" and len(row[2]) == 28


def test_all_forms_of_a_report(spark, tmp_path):
    rows = spark.createDataFrame([("d", "s", "q", 1.0, "m", None, "dim")], "document_id string, section_id string, question_id string, question_score double, metadata_autor string, dimension_id string, dimension_name string")
    m = spark.createDataFrame([("d", 0.5)], "document_id string, index double")
    at = export.write_report(rows, m, str(tmp_path / "r"), ["document_id"])
    assert {r["sheet"] for r in workbook.read_workbooks(spark, at["xlsx"]).collect()} == {"preguntas", "indice_global"}
    assert open(at["csv"], "rb").read(3) == b"\xef\xbb\xbf" and spark.read.json(at["json"]).count() == 1
    assert export.write(rows, str(tmp_path / "w.xlsx"), "xlsx").endswith("w.xlsx")
    export.write_dictionary({"a": rows, "b": m}, str(tmp_path / "dic.xlsx"))
    docs = spark.createDataFrame([("p", [[["a", "b"], ["c", "d"]]])], "path string, tables array<array<array<string>>>")
    assert spark.read.option("header", True).csv(export.write_tables(docs, str(tmp_path / "t"))).count() == 2


def test_section_schema(spark, tmp_path):
    f = tmp_path / "s.json"
    f.write_text('{"__config__": {"default_fuzzy_threshold": 90}, "res": {"title": "Resumen", "aliases": ["Síntesis"], "fuzzy_threshold": 50}, "con": {"title": "Conclusiones", "keywords": ["cierre", "final", "logro"], "keyword_min_ratio": 0.3}}')
    s = schemas.read_schema(spark, str(f))
    assert s.titles["res"] == ["Resumen", "Síntesis"] and s.fuzzy == 90 and s.own_fuzzy == {"res": 50.0} and s.own_keyword_share == {"con": 0.3}
    assert schemas.read_schema(spark, str(f)) is s
    for bad in ("[]", "{", '{"a": {}}', '{"a": {"title": "x", "aliases": "y"}}'):
        with pytest.raises(ValueError):
            schemas.parse_schema(bad)
    lines = spark.createDataFrame([("Resumenes y otros",), ("Conclusionesx y",), ("el cierre",)], "line string")
    got = {r["line"]: r["section_id"] for r in sections.fuzzy_sections(lines, "line", s.titles, s.fuzzy, s.own_fuzzy).collect()}
    assert got == {"resumenes y otros": "res"}
    assert [r[0] for r in lines.coalesce(1).select(sections.keyword_section(F.col("line"), s.keywords, s.keyword_share, s.own_keyword_share)).collect()] == [None, None, "con"]


def test_prompts_by_type_and_scale(spark):
    df = spark.createDataFrame([("q", "s", "d", "un fragmento")], "q string, s string, d string, c string")
    a, b, v = df.select(*(prompts.build_for_type(t, F.col("q"), F.col("s"), F.col("d"), F.col("c")) for t in prompts.BUILDERS), prompts.verbose(F.lit(None).cast("string"), F.lit("pn"), F.col("s"), F.lit(None).cast("string"), F.col("q"), F.lit("id"), F.lit(""), F.lit("{}"), F.lit("Fin."))).first()
    assert "0 a 4" in a and "0.5; 1; 1.5; 2" in b and v.endswith("<sin contenido>\n\nFin.") and "Documento evaluado" in v and "Metadatos" not in v
    with pytest.raises(ValueError):
        prompts.build_for_type("otro", F.col("q"), F.col("s"), F.col("d"), F.col("c"))
    lit = lambda *xs: F.array(*(F.lit(float(x)) for x in xs))
    assert tuple(df.select(prompts.scale_error(lit(0, 3), lit(0, 1, 2)), prompts.scale_error(lit(0, 2), lit(0, 1, 2))).first()) == (True, False)
    assert "{question}" in prompts.template("institucional")["template"]
    assert df.select(prompts.full_quality(F.lit(None).cast("string"), F.lit("x"), lit(0), F.lit(False))).first()[0] == 0.0


def test_deep_metadata_is_flattened(spark):
    deep = '{"a":' * 9 + '{"z":1.50,"l":[1,{"k":2}],"n":null,"t":"ñ","e":{}}' + "}" * 9
    got = {r["path"]: r["value"] for r in export.flat_leaves(spark.createDataFrame([(1, deep), (2, "{"), (3, None), (4, '{"b":{"c":true}}')], "id long, j string"), "id", "j").collect()}
    p = "a." * 9
    assert got["b.c"] == "true" and got[p + "t"] == "ñ" and got[p + "n"] is None and float(got[p + "z"]) == 1.5 and got[p + "l"] == '[1,{"k":2}]' and len(got) == 6


def test_merged_stream_over_several_batches(spark, tmp_path):
    schema = "k string, at int, v int"
    for n in range(4):
        rows = [(f"k{i}", n, n * 10 + i) for i in range(n, n + 3)] + ([(None, n, -n)] if n < 2 else [])
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = ingest.read_files(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, per_trigger=1)
    ingest.merge_stream(src, str(tmp_path / "out"), ["k"], ["at"], str(tmp_path / "cp"), buckets=8).awaitTermination()
    got = {(r["k"], r["v"]) for r in ingest.merged_table(spark, str(tmp_path / "out"), src.schema).collect()}
    want = {}
    for n in range(4):
        for i in range(n, n + 3):
            want[f"k{i}"] = n * 10 + i
    assert got == {*want.items(), (None, -1)}
    assert len(list((tmp_path / "out" / "manifest").iterdir())) <= 2 + 1
    assert ingest.merged_table(spark, str(tmp_path / "none"), src.schema).count() == 0
