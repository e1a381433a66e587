"""Pages, lines, sections and chunks over scanned pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valora.functions import text as T
from valora.operators import chunks, pages, sections
from valora.queries import fragments as Q
from valora.queries.texts import _lit, _values
from valora.runtime import spread
from valora.sources.tables import table

#: Sections looked for: some with the literal headings below, some with lines of the documents.
SCHEMA = {"resumen": ["Resumen Ejecutivo", "Resumen"], "conclusiones": ["Conclusiones", "Conclusión"], "cuadro": ["Cuadro"], "ademas": ["Asimismo", "Además"]}
KEYWORDS = {"gestion": ["presupuesto", "ejecución", "gestión"], "agua": ["agua", "hídrico", "cuenca", "represa"], "educacion": ["escuela", "docente"]}
HEADINGS = [
    ("-1", "1. Resumen Ejecutivo\nTexto del resumen.\n2. Conclusiones\nTexto final."),
    ("-2", "Resumen: en línea con el plan\nmás texto\nSección 4: Conclusiones\ncierre"),
    ("-3", "CAPITULO II - CONCLUSIONES\ncuerpo\nConclusiones\nsegundo cuerpo"),
    ("-4", "Un texto sin ningún título.\nOtra línea."),
    ("-5", "Resumen\n\nConclusiones."),
]
STATUS = [
    ("r1", False, 0, True, True, True, False, ""), ("r2", False, 0, False, True, True, False, ""), ("r3", True, 0, True, True, True, False, ""), ("r4", True, 0, False, True, True, False, ""),
    ("r5", True, 2, False, True, False, False, ""), ("r6", True, 2, False, True, True, True, "texto"), ("r7", True, 2, True, True, True, True, " "), ("r8", True, 2, False, True, True, True, " "), ("r9", True, 2, False, True, True, False, ""),
]


def _pages(s: SparkSession, d: str) -> DataFrame:
    """One text per report and page: of repeated pages the one with the smallest id. A page without a
    report is one of its own, named by its id."""
    p = table(s, d, "ocr_pages").where("ocr_text IS NOT NULL")
    p = p.withColumn("document_id", F.coalesce("document_id", F.concat(F.lit("#"), F.col("ocr_page_id").cast("string"))))
    one = p.groupBy("document_id", "page_index").agg(F.min_by("ocr_text", "ocr_page_id").alias("text"))
    return one.select("document_id", (F.col("page_index") + 1).alias("page_no"), "text")


def edge_lines(s: SparkSession, d: str) -> DataFrame:
    return pages.edge_lines(_pages(s, d), "document_id")


def repeated_lines(s: SparkSession, d: str) -> DataFrame:
    p = _pages(s, d)
    return pages.repeated_lines(pages.candidates(p, "document_id"), p, "document_id")


def fuzzy_repeated_lines(s: SparkSession, d: str) -> DataFrame:
    p = _pages(s, d)
    return pages.fuzzy_repeated_lines(pages.candidates(p, "document_id"), p, "document_id")


def clean_lines(s: SparkSession, d: str) -> DataFrame:
    p = _pages(s, d)
    return pages.classified_lines(pages.lines_of(p, "document_id"), p, "document_id").where("kind IS NOT NULL").select("document_id", "page_no", "line_no", "kind")


def clean_report(s: SparkSession, d: str) -> DataFrame:
    p = _pages(s, d)
    return pages.cleaning_report(pages.classified_lines(pages.lines_of(p, "document_id"), p, "document_id"), "document_id")


def clean_pages(s: SparkSession, d: str) -> DataFrame:
    p = _pages(s, d)
    return pages.cleaned(pages.classified_lines(pages.lines_of(p, "document_id"), p, "document_id"), "document_id")


def clean_scanned_lines(s: SparkSession, d: str) -> DataFrame:
    """Dropped lines, with heads and feet of scanned reports found by likeness."""
    p = _pages(s, d)
    return pages.classified_lines(pages.lines_of(p, "document_id"), p, "document_id", fuzzy=True).where("kind IS NOT NULL").select("document_id", "page_no", "line_no", "kind")


def ocr_like(s: SparkSession, d: str) -> DataFrame:
    return pages.ocr_like(_pages(s, d), "document_id")


def tagged_pages(s: SparkSession, d: str) -> DataFrame:
    joined = table(s, d, "document_summaries").where("size(pages) > 0").select("summary_id", F.array_join(F.transform("pages", lambda p, i: F.concat(F.lit("=== PAGE "), (i + 1).cast("string"), F.lit(" ===\n"), p)), "\n").alias("t"))
    return pages.split_pages(joined, "summary_id", "t").select("summary_id", "page_no", F.length("text").alias("chars"))


def _docs(s: SparkSession, d: str) -> DataFrame:
    docs = spread(table(s, d, "documents").where("text IS NOT NULL").select("doc_id", "text"))
    return docs.unionByName(_lit(s, HEADINGS).select(F.col("id").cast("long").alias("doc_id"), F.col("t").alias("text")))


def segment_headings(s: SparkSession, d: str) -> DataFrame:
    return sections.heading_hits(_docs(s, d), "doc_id", "text", SCHEMA).select("doc_id", "line_no", F.col("start").cast("long").alias("start"), "section_id", "rest")


def segment_text(s: SparkSession, d: str) -> DataFrame:
    return sections.section_spans(_docs(s, d), "doc_id", "text", SCHEMA)


def keyword_sections(s: SparkSession, d: str) -> DataFrame:
    ls = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return ls.select("doc_id", (F.col("p") + 1).alias("line_no"), sections.keyword_section(F.col("line"), KEYWORDS).alias("section_id")).where("section_id IS NOT NULL")


def fuzzy_sections(s: SparkSession, d: str) -> DataFrame:
    ls = _docs(s, d).select(F.explode(F.split("text", "\n")).alias("line")).unionByName(table(s, d, "rubric_questions").select(F.col("section_title").alias("line")))
    titles = {"sintesis_general": ["Síntesis general"], "marco_problema": ["Marco del problema atendido"], "conclusiones": ["Conclusiones"], "lecciones": ["Lecciones del ciclo"]}
    return sections.fuzzy_sections(ls, "line", titles)


def section_status(s: SparkSession, d: str) -> DataFrame:
    """The status rule over all export rows, each a rubric section in a report, and over the literals."""
    e = table(s, d, "export_rows")
    own = e.select(
        F.col("row_id").cast("string").alias("id"), F.col("document_id").isNotNull().alias("has_sections"), F.when(F.col("section_id").isNull() & F.col("section_title").isNull(), 0).otherwise(1).alias("n"),
        F.coalesce("metadata_skipped", F.lit(False)).alias("flag"), F.coalesce(F.length("chunk_results") > 2, F.lit(False)).alias("chunks"), F.col("section_id").isNotNull().alias("label"),
        F.col("section_title").isNotNull().alias("matched"), F.coalesce("relevant_text", F.lit("")).alias("text"),
    )
    t = own.unionByName(s.createDataFrame(STATUS, "id string, has_sections boolean, n int, flag boolean, chunks boolean, label boolean, matched boolean, text string"))
    c = F.col
    return t.select("id", sections.section_status(c("has_sections"), c("n"), c("flag"), c("chunks"), c("label"), c("matched"), c("text")).alias("status"))


def status_counts(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "export_rows").where("metadata_segmenter_status IS NOT NULL")
    return e.groupBy(T.identifier(F.col("metadata_segmenter_status")).alias("status")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("section_id").alias("sections"))


def status_lists(s: SparkSession, d: str) -> DataFrame:
    """Of every report and status the number and the ids of its sections."""
    e = table(s, d, "export_rows").where("metadata_segmenter_status IS NOT NULL")
    g = e.groupBy("document_id", T.identifier(F.col("metadata_segmenter_status")).alias("status")).agg(F.sort_array(F.collect_set("section_id")).alias("s"))
    return g.select("document_id", "status", F.size("s").cast("long").alias("n"), F.array_join("s", ",").alias("sections"))


def pseudo_chunks(s: SparkSession, d: str) -> DataFrame:
    """Chunks of all documents, chunk 0 for those that have none."""
    docs = table(s, d, "documents").select("doc_id", "text")
    c = chunks.with_pseudo_chunk(docs, "doc_id", "text", chunks.stride_chunks(spread(docs), "doc_id", "text"))
    return c.select("doc_id", "chunk_index", "chunks_in_source", F.length("chunk").alias("chars"))


def chunk_stride(s: SparkSession, d: str) -> DataFrame:
    c = chunks.stride_chunks(spread(table(s, d, "documents").where("text IS NOT NULL").select("doc_id", "text")), "doc_id", "text")
    return c.select("doc_id", "chunk_index", "chunks_in_source", F.length("chunk").alias("chars"), F.md5("chunk").alias("digest"))


def chunk_lines(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.lit("content").alias("source_id"), F.lit(1).alias("ord"), "text")
    return chunks.content_chunks(docs, "doc_id", "content")


def chunk_fallback(s: SparkSession, d: str) -> DataFrame:
    docs = _docs(s, d)
    secs = sections.section_spans(docs, "doc_id", "text", SCHEMA)
    flag = secs.where("section_id = 'sin_clasificar'").select("doc_id", F.lit(True).alias("segmenter_missing"))
    base = docs.join(flag, "doc_id", "left").withColumn("segmenter_missing", F.coalesce("segmenter_missing", F.lit(False)))
    found = secs.where("section_id <> 'sin_clasificar'")
    return chunks.document_chunks(base, "doc_id", found, pages.split_pages(docs, "doc_id", "text", 4000)).drop("chunk")


QUERIES = {f.__name__: f for f in (edge_lines, repeated_lines, fuzzy_repeated_lines, clean_lines, clean_report, clean_pages, clean_scanned_lines, ocr_like, tagged_pages, segment_headings, segment_text, keyword_sections, fuzzy_sections, section_status, status_counts, status_lists, chunk_stride, pseudo_chunks, chunk_lines, chunk_fallback)}


def _title_sql(titles: list[str]) -> str:
    return "(?i)" + sections.PREFIX + "(?:" + "|".join(titles) + ")(\\W|$)"


def sql() -> dict[str, str]:
    page = """p AS (SELECT document_id, page_index + 1 AS page_no, arg_min(ocr_text, ocr_page_id) AS text FROM (SELECT * REPLACE (coalesce(document_id, '#' || ocr_page_id) AS document_id) FROM ocr_pages)
  WHERE ocr_text IS NOT NULL GROUP BY document_id, page_index),
ln AS (SELECT document_id, page_no, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, len(string_split(text, chr(10))) AS n_lines FROM p)"""
    st = Q.strip("line")
    edge = f"""{page},
fl AS (SELECT document_id, page_no, line_no, {st} AS line, row_number() OVER (PARTITION BY document_id, page_no ORDER BY line_no) AS up,
  row_number() OVER (PARTITION BY document_id, page_no ORDER BY line_no DESC) AS down FROM ln WHERE length({st}) > 0),
el AS (SELECT document_id, page_no, line_no, line, 'header' AS zone FROM fl WHERE up <= 3 UNION ALL SELECT document_id, page_no, line_no, line, 'footer' FROM fl WHERE down <= 3)"""
    rep = f"""{edge},
cd AS (SELECT document_id, zone, line FROM el
  UNION ALL SELECT document_id, 'header', {st} FROM ln WHERE line_no <= 5 AND regexp_matches(line, '(?i){pages.CUSTOM_HEADERS}')
  UNION ALL SELECT document_id, 'footer', {st} FROM ln WHERE line_no > n_lines - 5 AND regexp_matches(line, '(?i){pages.CUSTOM_FOOTERS}')),
fm AS (SELECT document_id, zone, CASE WHEN zone = 'header' THEN {Q.edge_form(Q.leading('line'))} ELSE {Q.edge_form(Q.trailing('line'))} END AS form FROM cd),
np AS (SELECT document_id, count(*) AS n_pages FROM p GROUP BY document_id),
rp AS (SELECT document_id, zone, form, count(*) AS n FROM fm JOIN np USING (document_id) GROUP BY document_id, zone, form, n_pages HAVING count(*) >= greatest(3, floor(n_pages * 0.6)))"""
    low = f"lower({st})"
    kinds = f"""{rep},
kd AS (SELECT l.document_id, l.page_no, l.line_no, CASE
  WHEN h.form IS NOT NULL AND l.line_no <= 3 THEN 'header'
  WHEN f.form IS NOT NULL AND l.line_no > l.n_lines - 3 THEN 'footer'
  WHEN (l.line_no <= 3 OR l.line_no > l.n_lines - 3) AND regexp_matches({low}, '{pages.PAGE_NUMBER_LINE}') THEN 'page_number'
  WHEN regexp_matches({low}, '{pages.SOURCE_LINE}') AND length({st}) < 140 THEN 'source'
  WHEN regexp_matches({low}, '{pages.SIGNATURE_LINE}') AND length({st}) < 200 THEN 'signature'
  WHEN regexp_matches({low}, '{pages.SYMBOL_BOX}') OR (length({st}) <= 2 AND NOT regexp_matches({low}, '^[a-zA-Z0-9]')) THEN 'noise' END AS kind
  FROM (SELECT *, {Q.edge_form('line')} AS form FROM ln) l LEFT JOIN (SELECT * FROM rp WHERE zone = 'header') h ON h.document_id = l.document_id AND h.form = l.form
  LEFT JOIN (SELECT * FROM rp WHERE zone = 'footer') f ON f.document_id = l.document_id AND f.form = l.form)"""
    odd = "len(regexp_extract_all(lower(text), '[^\\w\\sáéíóúñüÁÉÍÓÚÑÜ:/(),.\\-]'))"
    docs = f"d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT id::BIGINT, t FROM {_values(HEADINGS)})"
    sec = "CASE " + " ".join(f"WHEN regexp_matches(line, '{_title_sql(t)}') THEN '{k}'" for k, t in SCHEMA.items()) + " END"
    rest = "CASE " + " ".join(f"WHEN section_id = '{k}' THEN regexp_replace(line, '{_title_sql(t)}', '\\1')" for k, t in SCHEMA.items()) + " END"
    residue = "' ' || chr(9) || ':-–—.•·'"
    heads = f"""{docs},
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM d),
l1 AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM l0),
l2 AS (SELECT *, {sec} AS section_id FROM l1 WHERE length(line) > 0),
h AS (SELECT doc_id, line_no, start, section_id, start + length(line) - length(ltrim({rest}, {residue})) AS begin, trim({rest}, {residue}) AS rest FROM l2 WHERE section_id IS NOT NULL)"""
    spans = f"""{heads},
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, section_id ORDER BY (rest = '') DESC, CASE WHEN rest = '' THEN -start ELSE start END) AS rn FROM h) WHERE rn = 1),
n AS (SELECT *, lead(start) OVER (PARTITION BY doc_id ORDER BY start) AS nxt FROM c),
f AS (SELECT n.doc_id, section_id, {Q.strip('substr(text, begin + 1, greatest(coalesce(nxt, length(text)) - begin, 0))')} AS text FROM n JOIN d ON n.doc_id = d.doc_id),
sc AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {i})" for i, k in enumerate(SCHEMA, 1))}) t(section_id, ord))"""
    words = "CASE "
    for k, ws in KEYWORDS.items():
        hits = " + ".join(f"(contains(lower(line), '{w}'))::INT" for w in ws)
        words += f"WHEN ({hits}) > 0 AND ({hits}) / {len(ws)}.0 >= {1.0 if len(ws) <= 2 else 0.5} THEN '{k}' "
    words += "END"
    stat = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x).upper() for x in r) + ")" for r in STATUS)
    # a summary with one page in all is split by size, its mark included
    lone = f"""SELECT summary_id, unnest(range(1, (length(t) + 4999) // 5000 + 1)) AS page_no, length(substr(t, (unnest(range(1, (length(t) + 4999) // 5000 + 1)) - 1) * 5000 + 1, 5000)) AS chars
FROM (SELECT summary_id, array_to_string(list_transform(list_filter(list_transform(pages, lambda x, i: CASE WHEN x IS NOT NULL THEN '=== PAGE ' || i || ' ===' || chr(10) || x END), lambda x: x IS NOT NULL), lambda x: x), chr(10)) AS t, pages FROM document_summaries WHERE len(pages) > 0)
WHERE len(list_filter(pages, lambda x: {Q.strip('x')} <> '')) <= 1"""
    return {
        "edge_lines": f"WITH {edge} SELECT document_id, page_no, zone, line_no, line FROM el",
        "repeated_lines": f"WITH {rep} SELECT document_id, zone, form, n FROM rp",
        "clean_lines": f"WITH {kinds} SELECT document_id, page_no, line_no, kind FROM kd WHERE kind IS NOT NULL",
        "clean_report": f"WITH {kinds} SELECT document_id, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {v}" for k, v in pages.REPORT.items()) + " FROM kd GROUP BY document_id",
        "clean_pages": f"""WITH {kinds}, g AS (SELECT k.document_id, k.page_no, string_agg(l.line, chr(10) ORDER BY l.line_no) AS t FROM kd k JOIN ln l ON l.document_id = k.document_id AND l.page_no = k.page_no AND l.line_no = k.line_no WHERE kind IS NULL GROUP BY k.document_id, k.page_no)
SELECT document_id, page_no, regexp_replace(regexp_replace(regexp_replace(t, '[ \\t]+', ' ', 'g'), ' +(\\n|$)', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS text FROM g""",
        "ocr_like": f"""WITH {page}, f AS (SELECT document_id, {odd} AS odd, (SELECT count(*) FROM (SELECT unnest(string_split(text, chr(10))) AS line) WHERE length({st}) BETWEEN 1 AND 4) AS short FROM p WHERE page_no <= 3)
SELECT document_id, sum(odd)::BIGINT AS odd_chars, sum(short)::BIGINT AS short_lines, sum(odd) > 10 OR sum(short) > 10 AS ocr_like FROM f GROUP BY document_id""",
        "tagged_pages": f"SELECT summary_id, row_number() OVER (PARTITION BY summary_id ORDER BY i) AS page_no, length(p) AS chars FROM (SELECT summary_id, unnest(pages) AS p, generate_subscripts(pages, 1) AS i FROM document_summaries WHERE len(list_filter(pages, lambda x: {Q.strip('x')} <> '')) > 1) WHERE {Q.strip('p')} <> '' UNION ALL {lone}",
        "segment_headings": f"WITH {heads} SELECT doc_id, line_no, start, section_id, rest FROM h",
        "segment_text": f"""WITH {spans}
SELECT k.doc_id, sc.section_id, sc.ord, coalesce(f.text, '') AS text FROM (SELECT DISTINCT doc_id FROM c) k CROSS JOIN sc LEFT JOIN f ON f.doc_id = k.doc_id AND f.section_id = sc.section_id
UNION ALL SELECT doc_id, 'sin_clasificar', 0, {Q.strip('text')} FROM d WHERE doc_id NOT IN (SELECT doc_id FROM c)""",
        "keyword_sections": f"SELECT * FROM (SELECT doc_id, line_no, {words} AS section_id FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)) WHERE section_id IS NOT NULL",
        "section_status": f"""SELECT id, CASE WHEN NOT hs THEN CASE WHEN fl OR NOT ch THEN 'missing' ELSE 'found' END WHEN n = 0 THEN CASE WHEN fl OR NOT ch THEN 'missing' ELSE 'found' END
 WHEN NOT lb THEN 'found' WHEN mt AND {Q.strip('tx')} <> '' THEN 'found' WHEN mt THEN CASE WHEN fl THEN 'missing' ELSE 'empty' END ELSE 'missing' END AS status FROM (
 SELECT row_id::VARCHAR AS id, document_id IS NOT NULL AS hs, CASE WHEN section_id IS NULL AND section_title IS NULL THEN 0 ELSE 1 END AS n, coalesce(metadata_skipped, false) AS fl, coalesce(length(chunk_results) > 2, false) AS ch,
  section_id IS NOT NULL AS lb, section_title IS NOT NULL AS mt, coalesce(relevant_text, '') AS tx FROM export_rows UNION ALL SELECT * FROM (VALUES {stat}) t(id, hs, n, fl, ch, lb, mt, tx))""",
        "status_counts": f"SELECT {Q.identifier('metadata_segmenter_status')} AS status, count(*) AS n, count(DISTINCT section_id) AS sections FROM export_rows WHERE metadata_segmenter_status IS NOT NULL GROUP BY 1",
        "status_lists": f"""SELECT document_id, status, count(section_id) AS n, coalesce(string_agg(section_id, ',' ORDER BY section_id), '') AS sections FROM (SELECT DISTINCT document_id, {Q.identifier('metadata_segmenter_status')} AS status, section_id FROM export_rows WHERE metadata_segmenter_status IS NOT NULL) GROUP BY document_id, status""",
        "pseudo_chunks": """SELECT doc_id, i + 1 AS chunk_index, n AS chunks_in_source, length(substr(text, i * 1350 + 1, 1500)) AS chars FROM (SELECT doc_id, text, (length(text) + 1349) // 1350 AS n, unnest(range(0, (length(text) + 1349) // 1350)) AS i FROM documents WHERE text IS NOT NULL)
UNION ALL SELECT doc_id, 0, 1, length(coalesce(text, '')) FROM documents WHERE coalesce(text, '') = ''""",
        "chunk_stride": """SELECT doc_id, i + 1 AS chunk_index, n AS chunks_in_source, length(substr(text, i * 1350 + 1, 1500)) AS chars, md5(substr(text, i * 1350 + 1, 1500)) AS digest
FROM (SELECT doc_id, text, (length(text) + 1349) // 1350 AS n, unnest(range(0, (length(text) + 1349) // 1350)) AS i FROM documents WHERE text IS NOT NULL)""",
    }
