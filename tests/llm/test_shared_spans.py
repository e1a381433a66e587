import random

from pyspark.sql import functions as F

from valora import runtime
from valora.llm import queries, shared_spans


def brute(rows, w):
    seen = {}
    for d, t, _ in rows:
        for p in range(len(t or "") - w + 1):
            seen.setdefault(t[p : p + w], set()).add(d)
    out = set()
    for d, t, _ in rows:
        end = None
        for p in range(len(t or "") - w + 1):
            if len(seen[t[p : p + w]]) > 1:
                if end is not None and p <= end:
                    end = p + w
                else:
                    if end is not None:
                        out.add((d, start + 1, end - start))
                    start, end = p, p + w
        if end is not None:
            out.add((d, start + 1, end - start))
    return out


def run(spark, rows, w, r):
    df = spark.createDataFrame(rows, "doc_id long, text string, doc string")
    return {tuple(x) for x in shared_spans.shared_spans(df, "doc_id", "text", w, r).collect()}


def test_spans_equal_brute_force(spark):
    rng = random.Random(11)
    make = lambda n: "".join(rng.choice(["ab ", "cde. ", "f, ", "gh\n", "ijklmnopqrstuvw", "ñ", "x"]) for _ in range(n))
    pool = [make(30) for _ in range(6)]
    rows = []
    for d in range(60):
        t = make(rng.randint(0, 15))
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(pool)
            a = rng.randrange(len(p) // 2)
            t += p[a : a + rng.randint(30, len(p))] + make(rng.randint(0, 5))
        rows.append((d, t, "x"))
    rows += [(100, None, "x"), (101, "", "x"), (102, "z" * 120, "x"), (103, "z" * 90, "x"), (104, "abab" * 40, "x"), (105, rows[5][1], "x"), (106, "solo aquí " * 30, "x")]
    for w, r in ((40, 20), (24, 10)):
        assert run(spark, rows, w, r) == brute(rows, w)


def test_long_texts_in_segments(spark, monkeypatch):
    rng = random.Random(8)
    p = "".join(rng.choice(["ab ", "cde. ", "f, ", "gh\n", "xyz"]) for _ in range(300))
    q = "".join(rng.choice(["ab ", "cde. ", "f, ", "gh\n", "xyz"]) for _ in range(300))
    rows = [(1, p + q, "x"), (2, q[:200] + p[100:500] + q[300:], "x"), (3, p[50:300], "x")]
    pieces = [(x, k, o) for a, b, c in shared_spans.segments([r[1] for r in rows], 40, 130) for x, k, o in zip(a, b, c, strict=True)]
    for k, (_, t, _) in enumerate(rows):
        assert {t[i : i + 40] for i in range(len(t) - 39)} == {x[i : i + 40] for x, kk, _ in pieces if kk == k for i in range(len(x) - 39)}
        assert all(t[o : o + len(x)] == x for x, kk, o in pieces if kk == k)
    monkeypatch.setattr(shared_spans.segments, "__defaults__", (130,))
    assert run(spark, rows, 40, 20) == brute(rows, 40)


def test_hot_passage_in_many_records(spark):
    rng = random.Random(4)
    hot = "Una frase que muchos informes repiten sin cambio alguno en su texto. " * 6
    rows = [(d, f"{rng.random()} " * rng.randint(0, 6) + hot + f" {rng.random()}" * rng.randint(0, 6), "x") for d in range(150)]
    assert run(spark, rows, 300, 150) == brute(rows, 300)


def test_first_record_keeps_the_span(spark):
    p = "Esta es una frase larga que aparece en dos informes distintos del mismo año y entidad. " * 5
    df = spark.createDataFrame([(1, "Inicio propio. " + p, 1), (2, "Otro comienzo. " + p + "Final propio.", 2), (3, None, 3)], "doc_id long, text string, spans int").withColumn("doc", F.lit(0))
    out = {r["doc_id"]: r["kept_text"] for r in shared_spans.without_repeats(df, "doc_id", "text").collect()}
    assert out[1] == "Inicio propio. " + p and "Otro comienzo." in out[2] and "Final propio." in out[2] and "frase larga" not in out[2] and out[3] is None


def brute_runs(rows, w, k):
    """Shared characters of each text by runs of sentences, sentences cut by a plain loop."""
    runs = {}
    for d, t in rows:
        at = [0]
        for i in range(1, len(t)):
            if t[i - 1].isspace() and not t[i].isspace():
                head = t[:i].rstrip()
                if (head and head[-1] in ".!?:;…") or "\n" in t[len(head) : i]:
                    at.append(i)
        cut = [(a, a + len(t[a:b].rstrip())) for a, b in zip(at, [*at[1:], len(t)]) if t[a:b].strip()]
        for i, (a, _) in enumerate(cut):
            e = next((e for _, e in cut[i + k - 1 :] if e - a >= w), None)
            if e:
                runs.setdefault(t[a:e], []).append((d, a, e))
    shared = {d: set() for d, _ in rows}
    for where in runs.values():
        if len({d for d, _, _ in where}) > 1:
            for d, a, e in where:
                shared[d] |= set(range(a, e))
    return {d: len(x) for d, x in shared.items()}


def test_sentence_runs_equal_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    pool = [" ".join(rng.choice("alfa beta gama delta eps".split()) for _ in range(rng.randint(1, 5))) + rng.choice([". ", "?  ", "\n", " \n\n ", ", ", "… "]) for _ in range(12)]
    rows = [(d, rng.choice(["", " ", "\n "]) + "".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for d in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_runs(rows, 60, 2)
    assert {r["doc"]: r["shared_chars"] for r in shared_spans.shared_share(df, "doc_id", "text", 60, 2).collect()} == want and sum(want.values()) > 500
    monkeypatch.setattr(shared_spans, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(runtime, "SALT_ROWS", 2)
    assert {r["doc"]: r["shared_chars"] for r in shared_spans.shared_share(df, "doc_id", "text", 60, 2).collect()} == want


def test_hot_spans_dealt_over_tasks_are_the_same(spark, monkeypatch):
    hot = "Una frase que muchos informes repiten sin cambio alguno en su texto. " * 6
    rows = [(d, f"{d} " * (d % 6) + hot + f" {d}" * (d % 5), "x") for d in range(60)]
    monkeypatch.setattr(shared_spans, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(runtime, "SALT_ROWS", 7)
    assert run(spark, rows, 300, 150) == brute(rows, 300)


def test_share_and_empty(spark, data):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert shared_spans.shared_spans(df, "doc_id", "text").count() == 0
    out = queries.p9_share(spark, data)
    assert out.where("share < 0 OR share > 1").count() == 0
    assert queries.p9_deduplicated(spark, data).count() == out.count()
