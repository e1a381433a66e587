from valora.llm import queries, scans

WORDS = "el informe presenta la evaluación de los resultados para las regiones y la coordinación del presupuesto anual con una política verificable".split()
KEY = ["source_table", "record_id", "page_no", "line_no", "defect"]


def corpus(spark, pages):
    filler = [(1000 + i, f"rel{i}", 0, " ".join(WORDS) + "\n" + "análisis costo-beneficio del ámbito") for i in range(30)]
    return scans.pages_of(spark.createDataFrame([*filler, *pages], "id long, doc string, page int, t string"), "x", "id", "doc", "page", "t")


def defects(spark, pages):
    return {(r["record_id"], r["line_no"], r["defect"]) for r in scans.Scans(corpus(spark, pages)).defects().collect() if r["record_id"] < 1000}


def test_defects_of_lines(spark):
    pages = [
        (1, "d", 0, "Oficina de planeamiento\nel informe presenta la evalua-\nción de los resu1tados\n- 1 -"),
        (2, "d", 1, "Of1cina de planeamiento\nlas regioncs y la coordi¬\n- 2 -"),
        (3, "d", 2, "OFICINA DE PLANEAMIENTO\nnación del análisis costo-\nbeneficio\n- 33 -\ncon una política\n- 3 -"),
        (4, None, 0, None), (5, "d", 3, ""), (6, "e", 0, "2019\nel presupuesto anual"),
    ]
    assert defects(spark, pages) == {
        (1, 1, "running"), (1, 2, "hyphenated"), (1, 3, "misread"), (1, 4, "page_number"),
        (2, 1, "running"), (2, 2, "hyphenated"), (2, 2, "misread"), (2, 3, "page_number"),
        (3, 1, "running"), (3, 6, "page_number"),
    }


def test_broadcast_and_join_agree(spark):
    pages = [(i, "d", i, "la cvaluación de los rcsultados\nla coordinación del presvpuesto") for i in range(3)]
    s = scans.Scans(corpus(spark, pages))
    total = lambda m: sorted(tuple(r) for r in m.where("kind <> 'b'").collect()) + sorted(tuple(r) for r in m.where("kind = 'b'").groupBy("prev", "word").sum("n").collect())
    a, b = total(scans.marks(s.flagged, s.words)), total(scans.marks(s.flagged, s.words, bound=0))
    assert a == b and len([x for x in a if x[0] == "x"]) >= 6


def test_repair_is_the_same_broadcast_and_joined(spark):
    pages = [(i, "d", i, "la cvaluación de los resu1tados y\nla coordinación del pre5upvesto con l3 regioncs") for i in range(3)]
    s = scans.Scans(corpus(spark, pages))
    a = sorted(tuple(r) for r in s.paragraphs().collect())
    assert a == sorted(tuple(r) for r in s.paragraphs(bound=0).collect())
    assert [r[5] for r in a if r[2] < 1000] == ["la evaluación de los resultados y la coordinación del presupuesto con 13 regiones"] * 3


def test_paragraphs_run_over_pages(spark):
    pages = [(1, "d", 0, "Cabeza del informe\nel informe presenta la evalua-\n[1]"), (2, "d", 1, "Cabeza del informe\nción de los rcsultados.\n\nLas regiones y la\ncoordinación\n[2]"), (3, "d", 2, "Cabeza del informe\ndel presupuesto anual.\n[3]")]
    s = scans.Scans(corpus(spark, pages))
    got = [r["text"] for r in s.reports().where("doc = 'd'").orderBy("page_no", "paragraph_no").collect()]
    assert got == ["el informe presenta la evaluación de los resultados.", "Las regiones y la coordinación del presupuesto anual."]


def test_numbers_and_forms():
    assert scans.page_number("- 12 -") == (12, True) and scans.page_number("Página lO de l2") == (10, True) and scans.page_number("37 | 43") == (37, True)
    assert scans.page_number("2019") == (2019, False) and scans.page_number("Plan 2019") is None and scans.page_number("xii") == (12, False)
    assert scans.head_form("Reporte anual 2021    3") == scans.head_form("4    REPORTE ANUAL 2021") == scans.head_form("Repo|te anua1 2021")
    assert scans.fold("interno") == scans.fold("inte|no") == scans.fold("iriterno") and scans.fold("administrativo") == scans.fold("aclrninistrativo")
    assert scans.distance("cvaluación", "evaluación") < 0.3 < 1.0 <= scans.distance("regional", "regionales")
    assert scans.odd_token("obser\\/a") and scans.odd_token("1oca1") and not scans.odd_token("m²") and not scans.odd_token("N.º") and not scans.odd_token("2021")


def test_linked_forms_fold_alike():
    """What a pair rule makes is folded again, whatever stands around it."""
    assert scans.fold("gobierno") == scans.fold("gobierrio") and scans.head_form("Gobierrio Regional") == scans.head_form("Gobierno Regional")
    folded = [(a, b) for a, b in scans.CONFUSIONS if (a, b) not in scans._UNFOLDED]
    assert {("rn", "m"), ("ri", "n"), ("cl", "d"), ("€", "e"), ("|", "r")} <= set(folded)
    around = "aceilmnru"
    for a, b in folded:
        for x in around:
            for y in around:
                assert scans.fold(f"pr{x}{a}{y}is") == scans.fold(f"pr{x}{b}{y}is"), (a, b, x, y)


def test_every_confusion_leads_to_its_word():
    for a, b in scans.CONFUSIONS:
        for x in "aeinrou":
            for y in "aeinrou":
                read, meant = f"pas{x}{a}{y}sol", f"pas{x}{b}{y}sol"
                assert set(scans.keys_of(read)) & set(scans.keys_of(meant)), (read, meant)


def test_head_whose_misreading_folds_in_two_steps(spark):
    pages = [(1, "d", 0, "Gobierno Regional\nel informe presenta"), (2, "d", 1, "Gobierrio Regional\nlas regiones"), (3, "d", 2, "Gobierno Regional\nel presupuesto")]
    assert {(i, 1, "running") for i in (1, 2, 3)} <= defects(spark, pages)


def test_heads_at_any_depth(spark):
    """Five running lines and a long framed number at the top of each page."""
    heads = ["Gobierno Regional", "Gerencia de Planeamiento", "Unidad de Seguimiento", "Informe Anual", "Serie Documentos"]
    pages = [(i, "d", i, "\n".join([*heads, "-" * 60 + f" {i + 1} " + "-" * 60, f"el informe presenta las regiones y {w}", "la coordinación del presupuesto"])) for i, w in enumerate(WORDS[:4])]
    got = defects(spark, pages)
    assert {(i, k, "running") for i in range(4) for k in range(1, 6)} <= got and {(i, 6, "page_number") for i in range(4)} <= got
    assert not [x for x in got if x[1] > 6]


def test_short_words_by_context(spark):
    """`cn` and `ia` are near `en` and `la`; they are misread only where the word before is followed by these."""
    pages = [(i, f"e{i}", 0, "el plan vive en la zona de agua") for i in range(40)] + [(100 + i, f"g{i}", 0, "norma ia vigente") for i in range(2)]
    pages += [(500, "h", 0, "el plan vive cn la zona\nia red"), (501, "i", 0, "ia gestión")]
    assert defects(spark, pages) == {(500, 1, "misread")}


def test_evidence_of_odd_tokens(spark):
    pages = [(1, "d", 0, "los resu1tados de las regi0nes\nde Kw@xzt1 y el informe")]
    s = scans.Scans(corpus(spark, pages))
    assert {(r["line_no"], r["evidence"]) for r in s.misread().where("record_id = 1").collect()} == {(1, "index"), (2, "characters")}


def test_a_misreading_is_no_candidate(spark):
    pages = [(i, f"e{i}", 0, "una gestión adecuada") for i in range(200)] + [(300 + i, f"f{i}", 0, "una gestión aclecuada") for i in range(12)] + [(400, "g", 0, "una gestión aclecuacla")]
    fixes = {r["word"]: r["fix"] for r in scans.Scans(corpus(spark, pages)).fixes.collect()}
    assert fixes["aclecuacla"] == fixes["aclecuada"] == "adecuada"


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, doc string, page int, t string")
    s = scans.Scans(scans.pages_of(df, "x", "id", "doc", "page", "t"))
    assert s.defects().count() == 0 and s.reports().count() == 0


def test_query_runs(spark, data):
    out = queries.p3_found(spark, data)
    assert out.columns == KEY and out.count() == out.distinct().count() > 0
