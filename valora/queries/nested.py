"""Queries of the core operators and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from valora.operators import nested
from valora.runtime import keep
from valora.sources.tables import table


def _p4_nodes(spark: SparkSession, d: str, with_json: bool) -> DataFrame:
    return nested.nested_nodes(table(spark, d, "evaluation_records"), "record_id", "raw_json", "evaluation_records", "record", with_json).unionByName(
        nested.nested_nodes(table(spark, d, "export_rows"), "row_id", "chunk_results", "export_rows", "chunks", with_json)
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _p4_nodes(spark, d, False).select("source_table", "record_id", "node_kind", "section_pos", "dimension_pos", "question_pos", "chunk_pos")


def _flat(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return nested.flat_tables(_p4_nodes(spark, d, True))


def p4_sections(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of sections."""
    return _flat(spark, d)["sections"].drop("metadata")


def p4_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of dimensions with its links."""
    return _flat(spark, d)["dimensions"].drop("metadata")


def p4_questions(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of questions with its links."""
    return _flat(spark, d)["questions"].drop("metadata")


def p4_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of chunks with its links."""
    return _flat(spark, d)["chunks"]


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the flat tables by kind, and those whose parent is missing."""
    return nested.missing_links(nested.flat_tables(keep(_p4_nodes(spark, d, True), "p4-nodes")))


QUERIES = {"p4_found": p4_found, "p4_sections": p4_sections, "p4_dimensions": p4_dimensions, "p4_questions": p4_questions, "p4_chunks": p4_chunks, "p4_links": p4_links}


def _tree() -> str:
    """All nodes by the SQL engine's own JSON functions: tables s, m, q and c with x, the node."""
    strip = "trim({0}, ' ' || chr(9) || chr(10) || chr(13) || chr(65279) || chr(8203) || chr(8204) || chr(8205) || chr(8288) || chr(173) || chr(8206) || chr(8207) || chr(160))"
    text = lambda t: f"CASE WHEN json_valid({strip.format(t)}) THEN {strip.format(t)}::JSON END"

    def value(x: str) -> str:
        """JSON kept as text counts as its content, twice over."""
        once = f"CASE WHEN json_type({x}) = 'VARCHAR' THEN {text(f'json_extract_string({x}, chr(36))')} ELSE {x} END"
        return f"(SELECT CASE WHEN json_type(w) = 'VARCHAR' THEN {text('json_extract_string(w, chr(36))')} ELSE w END FROM (SELECT {once} AS w))"

    def items(v: str) -> str:
        return f"CASE json_type({v}) WHEN 'ARRAY' THEN json_extract({v}, '$[*]') WHEN 'OBJECT' THEN [{v}] ELSE [] END"

    def level(name: str, source: str, keep_: str, members: tuple[str, ...]) -> str:
        each = " UNION ALL ".join(f"SELECT {keep_}, {value(f'x->{chr(39)}$.{m}{chr(39)}')} AS v FROM {source}" for m in members)
        return f"{name}0 AS ({each}), {name}1 AS (SELECT * EXCLUDE (v), {items('v')} AS xs FROM {name}0), {name} AS (SELECT * FROM (SELECT * EXCLUDE (xs), unnest(xs) AS x, generate_subscripts(xs, 1) AS pos FROM {name}1) WHERE json_type(x) = 'OBJECT')"

    root = f"SELECT record_id, {value(text('raw_json'))} AS x FROM evaluation_records"
    wrapped = " UNION ALL ".join(f"SELECT record_id, {value(f'x->{chr(39)}$.{m}{chr(39)}')} AS x FROM t" for m in nested.WRAPPERS)
    ident = "record_id, source_table"
    return f"""t AS (SELECT * FROM ({root}) WHERE json_type(x) = 'OBJECT'),
o AS (SELECT record_id, 'evaluation_records' AS source_table, x FROM t UNION ALL SELECT record_id, 'evaluation_records', x FROM ({wrapped}) WHERE json_type(x) = 'OBJECT'),
{level('sa', 'o', ident, nested.SECTIONS)}, s AS (SELECT * EXCLUDE (pos), pos AS sp FROM sa),
{level('ma', 's', ident + ', sp', nested.DIMENSIONS)}, m AS (SELECT * EXCLUDE (pos), pos AS mp FROM ma),
u AS (SELECT record_id, source_table, sp, 0 AS mp, 'section' AS parent_kind, x FROM s UNION ALL SELECT record_id, source_table, sp, mp, 'dimension', x FROM m),
{level('qa', 'u', ident + ', sp, mp, parent_kind', nested.QUESTIONS)}, q AS (SELECT * EXCLUDE (pos), pos AS qp FROM qa),
{level('ca', 'q', ident + ', sp, mp, qp', nested.CHUNKS)},
e0 AS (SELECT row_id AS record_id, {value(text('chunk_results'))} AS v FROM export_rows), e1 AS (SELECT record_id, {items('v')} AS xs FROM e0),
c AS (SELECT record_id, source_table, sp, mp, qp, pos AS cp, x FROM ca
  UNION ALL SELECT * FROM (SELECT record_id, 'export_rows', 0, 0, 0, generate_subscripts(xs, 1) AS cp, unnest(xs) AS x FROM e1) WHERE json_type(x) = 'OBJECT')"""


def sql() -> dict[str, str]:
    tree = _tree()

    def member(*paths: str) -> str:
        return "coalesce(" + ", ".join(f"nullif(x->>'$.{p}', '')" for p in paths) + ")"

    def number(*paths: str) -> str:
        return f"try_cast(regexp_replace(replace(trim({member(*paths)}), ',', '.'), '\\s*%$', '') AS DOUBLE)"

    at = "source_table, record_id, sp AS section_pos"
    two = f"{number('weight', 'ponderacion')} AS weight, {number('score', 'puntaje')} AS score"
    return {
        "p4_found": f"""WITH {tree} SELECT source_table, record_id, 'section' AS node_kind, sp AS section_pos, 0 AS dimension_pos, 0 AS question_pos, 0 AS chunk_pos FROM s
UNION ALL SELECT source_table, record_id, 'dimension', sp, mp, 0, 0 FROM m UNION ALL SELECT source_table, record_id, 'question', sp, mp, qp, 0 FROM q UNION ALL SELECT source_table, record_id, 'chunk', sp, mp, qp, cp FROM c""",
        "p4_sections": f"WITH {tree} SELECT {at}, {member('section_id', 'id')} AS section_id, {member('title', 'titulo', 'nombre')} AS title, {two}, {member('status', 'metadata.status', 'metadata.segmenter_status')} AS status FROM s",
        "p4_dimensions": f"WITH {tree} SELECT {at}, mp AS dimension_pos, {member('name', 'nombre')} AS name, {two}, {member('method', 'metodo_agregacion')} AS method FROM m",
        "p4_questions": f"WITH {tree} SELECT {at}, mp AS dimension_pos, qp AS question_pos, parent_kind, {member('question_id', 'id')} AS question_id, {member('text', 'texto')} AS text, {two}, {member('justification')} AS justification FROM q",
        "p4_chunks": f"WITH {tree} SELECT {at}, mp AS dimension_pos, qp AS question_pos, cp AS chunk_pos, {member('index')} AS index, {number('score', 'puntaje')} AS score, {member('justification')} AS justification, {member('relevant_text')} AS relevant_text, {member('metadata')} AS metadata FROM c",
        "p4_links": f"WITH {tree} SELECT 'section' AS node_kind, count(*) AS rows, 0::BIGINT AS orphans FROM s UNION ALL SELECT 'dimension', count(*), 0 FROM m UNION ALL SELECT 'question', count(*), 0 FROM q UNION ALL SELECT 'chunk', count(*), 0 FROM c WHERE sp > 0",
    }
