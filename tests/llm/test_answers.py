import pytest

from valora.llm import answers, profiles, queries

Q = "¿El informe explica si la meta anual supera el plazo previsto?"
CASES = [
    (None, ["empty"]), ("", ["empty"]), (" \u200b\ufeff", ["empty"]), ("-- … _", ["empty"]), ("N/A", ["empty"]), ('{"justification": ""}', ["empty"]), ("<p></p>", ["empty"]), ("Justificación:", ["empty"]),
    ("Cumple parcialmente", []), ("Nivel 2", []), ("La meta anual supera el plazo en la zona. Puntaje: 1,5", []), ("- Cierre del plan: sí\n- Avance: 25,5 %", []),
    ("La meta anual supera el plazo en la", ["truncated"]), ("La meta anual supera el plazo [...]", ["truncated"]), ("La meta supera el plazo (continúa", ["truncated"]), ("Como indica el texto: \"La meta anual", ["truncated"]), ("La zona avanza. El art.", ["truncated"]), ("La meta avanza... El plazo se cumple.", []),
    ("Lo siento, pero no puedo valorar la meta anual.", ["refusal"]), ("Como modelo de lenguaje, prefiero no emitir una valoración. Gracias por su comprensión.", ["refusal"]), ("No es posible verificar el avance de la meta: falta la línea de base y por eso se asigna el nivel mínimo.", []),
    ("Je ne peux pas évaluer ce rapport.", ["refusal", "other_language"]),
    (Q, ["copies_question"]), (f"Respuesta: {Q.upper()} Puntaje: 1", ["copies_question"]), (Q + " La meta anual supera el plazo en la zona costera.", []),
    ("The report explains that the annual goal is met in most of the districts.", ["other_language"]), ("El anexo se titula «The annual goal of the district is met» y lo detalla en la zona.", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_defects(text, want):
    assert sorted(answers.defects(Q, text)) == sorted(want)


def test_null_question():
    assert answers.defects(None, "La meta anual supera el plazo.") == [] and answers.defects("", None) == ["empty"]


def test_tiles_do_not_overlap():
    t = answers.tiles("a b c d e f".split(), "x d e f a b c y".split())
    assert sorted(t) == [(0, 4, 3), (3, 1, 3)]


def test_column_and_extra_columns(spark, data):
    df = spark.createDataFrame([(1, Q, None, "x"), (1, Q, None, "y")], "id int, q string, a string, defect string")
    assert [r["defects"] for r in answers.with_defects(df, "q", "a").collect()] == [["empty"], ["empty"]]
    assert answers.with_defects(df.limit(0), "q", "a").count() == 0
    assert {r["defect"] for r in queries.p5_found(spark, data).select("defect").distinct().collect()} <= set(answers.DEFECTS)


ES = ["El informe describe el avance de las metas del plan y la ejecución del presupuesto en la región.", "La agenda regional fortalece los servicios de agua y la gestión de los residuos en cada distrito."]
EN = ["The report describes the progress of the goals of the plan and the budget of the region.", "The regional agenda strengthens water services and waste management in each district."]
PT = ["O relatório descreve o avanço das metas do plano e a execução do orçamento na região.", "A agenda regional fortalece os serviços de água e a gestão dos resíduos em cada distrito."]


def test_profiles_tell_languages_apart(spark):
    rows = [(t, k) for k, ts in (("es", ES), ("SPA", ES), ("en", EN), ("por", PT)) for t in ts] + [("?", "und"), (None, "es"), ("sin etiqueta", None)]
    known = profiles.train(spark.createDataFrame(rows, "text string, lang string"), "text", "lang")
    assert set(known) == {"es", "en", "pt"}
    assert [profiles.lead(profiles.trigrams(t[0]), known)[0] for t in (ES, EN, PT)] == ["es", "en", "pt"]
    assert profiles.lead(profiles.trigrams("corto"), known) is None
    q = "¿El informe describe el avance de las metas del plan?"
    german = "Der Bericht bewertet die Umsetzung der Maßnahmen im Bezirk und nennt dazu keine weiteren Zahlen oder Fristen."
    assert answers.defects(q, german, known) == ["other_language"] and answers.defects(q, ES[1], known) == []
    assert answers.defects("Does the report describe the goals?", "Presupuesto regional fortalecido, agua gestionada, residuos regionales ejecutados.", known) == ["other_language"]
    assert profiles.train(spark.createDataFrame([], "text string, lang string"), "text", "lang") == {}


def test_refusals_by_productions():
    d = answers.derives
    assert d("Refusal", ("D",)) and d("Refusal", ("F", "D", "F")) and d("Refusal", ("F", "D", "F", "D"))
    assert not d("Refusal", ("F",)) and not d("Refusal", ()) and not d("Refusal", ("D", "C")) and not d("Refusal", ("C", "D"))
    assert [answers.sentence_symbol(x) for x in ("lo siento", "no puedo evaluar este informe", "gracias por su comprension", "el plan cumple sus metas")] == ["F", "D", "F", "C"]
    assert answers.is_refusal("Lo siento. No puedo evaluar este informe. Gracias por su comprensión." + " Gracias." * 500)


def test_copies_of_any_length():
    q = "¿El informe explica con claridad si el programa regional de agua cumple cada una de las metas previstas?"
    assert all(answers.defects(q, " ".join([q] * n)) == ["copies_question"] for n in (1, 2, 3, 40))
    assert answers.defects(q, q * 3 + " El programa cumple con dos metas de cinco.") == []


def test_tags_of_any_length():
    assert answers.is_empty('<div class="' + "x" * 300 + '"> </div>') and answers.is_empty("<p>…</p>")
    assert not answers.is_empty("<el informe presenta los avances del plan regional de agua y saneamiento en todos los distritos>")
