"""Text scalars over the tables' texts and small literal corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valora.functions import text as T
from valora.operators import export, pages
from valora.queries import fragments as Q
from valora.sources.tables import table

HTML = [("h1", "<p>Informe &amp; anexo</p>"), ("h2", "a&lt;b&gt;c <br/> d"), ("h3", "sin marcas"), ("h4", "<b>uno</b>\n<i>dos</i>&nbsp;tres"), ("h5", "")]
MARKS = [("m1", "uno\n=== PAGE 2 ===\ndos"), ("m2", "== page 3 ==\nalfa  beta"), ("m3", "sin marca")]
NUMBERS = [("n1", "Informe anual - 2"), ("n2", "12 — Informe"), ("n3", "Página 3 de 10"), ("n4", "Memoria Página 2 de 140"), ("n5", "141 - Plan"), ("n6", "Sin número")]


def _lit(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "id string, t string")


def _values(rows: list[tuple[str, str]]) -> str:
    q = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return "(VALUES " + ", ".join(f"({q(a)}, {q(b)})" for a, b in rows) + ") v(id, t)"


def norm_identifier(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "export_rows").select(F.explode(F.array("document_id", "section_id", "dimension_name")).alias("label")).where("label IS NOT NULL").distinct()
    return e.select("label", T.identifier(F.col("label")).alias("form"))


def norm_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "rubric_questions").select("question_id", T.fuzzy_form(F.col("question_text")).alias("form"))


def search_form(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "rubric_questions").select("question_id", T.search_form(F.col("question_text")).alias("form"))


def collapse_ws(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunk_contexts").select("context_id", T.clean_spaces(F.col("chunk_text")).alias("t"))


def collapse_repeats(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "ai_responses").select("response_id", T.collapse_repeats(F.col("justification")).alias("t"))


def _with_literals(s: SparkSession, rows: DataFrame, id_col: str, text_col: str, literals: list[tuple[str, str]]) -> DataFrame:
    return rows.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t")).unionByName(_lit(s, literals))


def html_strip(s: SparkSession, d: str) -> DataFrame:
    """Texts of all documents, and literals, without tags and entities."""
    return _with_literals(s, table(s, d, "documents"), "doc_id", "text", HTML).select("id", T.strip_tags(T.unescape_html("t")).alias("t"))


def page_marker(s: SparkSession, d: str) -> DataFrame:
    """Texts of all documents, and literals, without page marks."""
    return _with_literals(s, table(s, d, "documents"), "doc_id", "text", MARKS).select("id", T.drop_page_marks(F.col("t")).alias("t"))


def page_edge_numbers(s: SparkSession, d: str) -> DataFrame:
    """All lines of the scanned pages, and literals, without page numbers at either end."""
    t = F.col("t")
    lines = table(s, d, "ocr_pages").select("ocr_page_id", F.posexplode(F.split("ocr_text", "\n")).alias("p", "line"))
    lines = lines.select(F.concat_ws(":", "ocr_page_id", F.col("p") + 1).alias("id"), "line")
    return _with_literals(s, lines, "id", "line", NUMBERS).select("id", T.drop_trailing_page_number(t).alias("trailing"), T.drop_leading_page_number(t).alias("leading"), T.edge_form(t).alias("form"))


def line_whitespace(s: SparkSession, d: str) -> DataFrame:
    """Texts of all answers with the white space of their lines collapsed."""
    return table(s, d, "ai_responses").select("response_id", T.line_whitespace(F.col("justification")).alias("t"))


def prompt_safe(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunk_contexts").select("context_id", T.prompt_safe(F.col("chunk_text")).alias("t"))


def truncate_budget(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", T.within_budget(F.col("text"), 1000).alias("t"))


def compact_lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "ocr_pages").select("ocr_page_id", T.compact_lines(F.col("ocr_text")).alias("t"))


def word_features(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "export_rows").where("relevant_text IS NOT NULL").select("row_id", F.length("relevant_text").alias("chars"), T.word_count(F.col("relevant_text")).alias("words"))


def ordered_distinct(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "document_summaries").where("issues IS NOT NULL").select("summary_id", F.array_join(T.ordered_distinct(F.concat("issues", "issues")), "|").alias("issues"))


def sheet_names(s: SparkSession, d: str) -> DataFrame:
    names = table(s, d, "rubric_questions").select(F.concat_ws(": ", "tipo_informe", "section_title").alias("name")).distinct()
    return export.safe_names(names, "name", 20)


def fixed_pages(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(pages.fixed_pages(F.col("text"), 4000)).alias("p", "t"))
    return p.select("doc_id", (F.col("p") + 1).alias("page_no"), F.length("t").alias("chars"), F.md5("t").alias("digest"))


QUERIES = {f.__name__: f for f in (norm_identifier, norm_text, search_form, collapse_ws, collapse_repeats, html_strip, page_marker, page_edge_numbers, line_whitespace, prompt_safe, truncate_budget, compact_lines, word_features, ordered_distinct, sheet_names, fixed_pages)}


def sql() -> dict[str, str]:
    white = Q.WHITE
    punct = ".,;:!?¡¿\"''()[]{}«»“”‘’-–—_/\\"
    ws = lambda x: f"trim(regexp_replace({x}, '{white}+', ' ', 'g'))"
    unescaped = "replace(replace(replace(replace(t, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', chr(160))"
    spaced = r"regexp_replace(regexp_replace(replace(justification, '•', ''), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g')"
    lines = "(SELECT ocr_page_id || ':' || i AS id, list_extract(x, i) AS line FROM (SELECT ocr_page_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT ocr_page_id, string_split(ocr_text, chr(10)) AS x FROM ocr_pages)))"
    over = lambda src, key, col, lits: f"(SELECT {key}::VARCHAR AS id, {col} AS t FROM {src} UNION ALL SELECT id, t FROM {_values(lits)})"
    return {
        "norm_identifier": f"SELECT label, {Q.identifier('label')} AS form FROM (SELECT document_id AS label FROM export_rows UNION SELECT section_id FROM export_rows UNION SELECT dimension_name FROM export_rows) WHERE label IS NOT NULL",
        "norm_text": "SELECT question_id, trim(regexp_replace(regexp_replace(strip_accents(lower(question_text)), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS form FROM rubric_questions",
        "search_form": f"SELECT question_id, trim(regexp_replace(translate(strip_accents(lower(question_text)), '{punct}', ''), '\\s+', ' ', 'g')) AS form FROM rubric_questions",
        "collapse_ws": f"SELECT context_id, {ws('chunk_text')} AS t FROM chunk_contexts",
        "html_strip": f"SELECT id, {ws(f'''regexp_replace({unescaped}, '<[^>]+>', ' ', 'g')''')} AS t FROM {over('documents', 'doc_id', 'text', HTML)}",
        "page_marker": f"SELECT id, {ws('''regexp_replace(replace(t, chr(12), ' '), '(?im)^=+\\s*page\\s*\\d+\\s*=+$', ' ', 'g')''')} AS t FROM {over('documents', 'doc_id', 'text', MARKS)}",
        "page_edge_numbers": f"SELECT id, {Q.trailing('t')} AS trailing, {Q.leading('t')} AS leading, {Q.edge_form('t')} AS form FROM {over(lines, 'id', 'line', NUMBERS)}",
        "collapse_repeats": """SELECT response_id, CASE WHEN justification IS NULL THEN NULL ELSE array_to_string(list_filter(x, lambda c, i: NOT coalesce(i > 1 AND x[i - 1] = c AND CASE WHEN contains('.,;:!?¡¿', c) THEN (i > 2 AND x[i - 2] = c) OR coalesce(x[i + 1] = c, false) ELSE i > 2 AND x[i - 2] = c END, false)), '') END AS t
FROM (SELECT response_id, justification, regexp_extract_all(justification, '(?s).') AS x FROM ai_responses)""",
        "line_whitespace": f"SELECT response_id, {Q.strip(spaced)} AS t FROM ai_responses",
        "prompt_safe": f"""SELECT context_id, {Q.strip(f'''translate(translate(chunk_text, chr(160) || '“”‘’«»', ' ""' || chr(39) || chr(39) || '""'), '{T.ZERO_WIDTH}', '')''')} AS t FROM chunk_contexts""",
        "truncate_budget": "SELECT doc_id, CASE WHEN length(text) > 1000 THEN rtrim(substr(text, 1, 834)) || chr(10) || '[texto truncado]' || chr(10) || ltrim(right(text, 148)) ELSE text END AS t FROM documents",
        "compact_lines": "SELECT ocr_page_id, regexp_replace(regexp_replace(regexp_replace(ocr_text, '[ \\t]+', ' ', 'g'), ' +(\\n|$)', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g') AS t FROM ocr_pages",
        "word_features": f"SELECT row_id, length(relevant_text) AS chars, CASE WHEN length({Q.strip('relevant_text')}) = 0 THEN 0 ELSE len(string_split_regex({Q.strip('relevant_text')}, '\\s+')) END AS words FROM export_rows WHERE relevant_text IS NOT NULL",
        "ordered_distinct": "SELECT summary_id, array_to_string(list_filter(issues, lambda x, i: x IS NOT NULL AND list_position(issues, x) = i), '|') AS issues FROM document_summaries WHERE issues IS NOT NULL",
        "sheet_names": """WITH n AS (SELECT DISTINCT concat_ws(': ', tipo_informe, section_title) AS name FROM rubric_questions),
 b AS (SELECT name, substr(regexp_replace(name, '[\\[\\]:*?/\\\\]', '_', 'g'), 1, 20) AS sheet FROM n),
 r AS (SELECT *, row_number() OVER (PARTITION BY lower(sheet) ORDER BY name) AS k FROM b)
 SELECT name, CASE WHEN k = 1 THEN sheet ELSE substr(sheet, 1, 17) || '_' || k END AS sheet FROM r""",
        "fixed_pages": "SELECT doc_id, i + 1 AS page_no, length(substr(text, i * 4000 + 1, 4000)) AS chars, md5(substr(text, i * 4000 + 1, 4000)) AS digest FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 3999) // 4000)) AS i FROM documents WHERE text IS NOT NULL)",
    }
