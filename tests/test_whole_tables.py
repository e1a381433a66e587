"""Queries over whole tables against plain Python: no row of a table is left out."""

import unicodedata

from pyspark.sql import functions as F

from valora import queries
from valora.sources.tables import table


def form(t):
    if t is None:
        return None
    t = unicodedata.normalize("NFD", t.strip(" \t\n\r\x0b\x0c").lower())
    return "".join(c for c in t if not unicodedata.combining(c))


def export(spark, data):
    return table(spark, data, "export_rows").orderBy("row_id").collect()


def test_merge_upsert_keeps_every_key(spark, data):
    rows = export(spark, data)
    newest, first, update = {}, {}, {}
    for r in rows:
        d = form(r["document_id"])
        newest[d] = max(newest.get(d, r["run_ts"]), r["run_ts"])
    for r in rows:
        k = form(r["document_id"]), form(r["question_id"])
        first.setdefault(k, r)
        if r["run_ts"] == newest[k[0]]:
            update.setdefault(k, r)
    want = []
    for k, p in first.items():
        u = update.get(k)
        score = u["question_score"] if u and u["question_score"] is not None else p["question_score"]
        text = u["justification"] if u and u["justification"] and u["justification"].strip() else p["justification"]
        want.append((p["document_id"], p["question_id"], score, text))
    got = [tuple(r) for r in queries.QUERIES["merge_upsert"](spark, data).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_reused_runs_sees_rows_of_one_parity(spark, data, tmp_path):
    even = table(spark, data, "export_rows").where("row_id % 2 = 0")
    even.unionByName(even.withColumn("loaded_at", F.expr("loaded_at + INTERVAL 1 DAY"))).write.parquet(f"{tmp_path}/export_rows.parquet")
    for at in (data, str(tmp_path)):
        loads = {}
        for r in export(spark, at):
            loads.setdefault(r["run_id"], set()).add(r["loaded_at"])
        want = {k for k, v in loads.items() if k is not None and len(v) > 1}
        assert want and {r["run_id"] for r in queries.QUERIES["reused_runs"](spark, at).collect()} == want


def test_text_rules_run_over_their_tables_and_literals(spark, data):
    docs = table(spark, data, "documents").count()
    lines = sum(r["ocr_text"].count("\n") + 1 for r in table(spark, data, "ocr_pages").collect() if r["ocr_text"] is not None)
    answers, rows = table(spark, data, "ai_responses").count(), table(spark, data, "export_rows").count()
    for name, n in (("html_strip", docs + 5), ("page_marker", docs + 3), ("page_edge_numbers", lines + 6), ("imputed_scores", answers + 5), ("section_status", rows + 9), ("scale_shapes", 64 + 4)):
        assert queries.QUERIES[name](spark, data).count() == n, name


def test_no_query_takes_parts_of_its_rows():
    """No row filter by remainder stands in a query or its SQL."""
    import inspect
    import re

    for name, q in queries.QUERIES.items():
        assert not re.search(r"_id % \d|\.limit\(|\.sample\(", inspect.getsource(q) + queries.sql().get(name, "")), name
