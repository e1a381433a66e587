import random

from pyspark.sql import functions as F

from valora.llm import splits

COLS = "row_id long, document_id string, metadata_autor string, metadata_entidad string, metadata_source_path string, question_score double, group_id string"


def brute(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for r in rows:
        ks = [(i, v) for i, v in enumerate(r[1:5]) if v and v != "s/a"]
        for k in ks:
            parent[find(k)] = find(ks[0])
    return {r[0]: find(next((i, v) for i, v in enumerate(r[1:5]) if v and v != "s/a")) if any(v and v != "s/a" for v in r[1:5]) else ("row", r[0]) for r in rows}


def test_groups_equal_union_find(spark):
    rng = random.Random(3)
    v = lambda p, n: rng.choice([None, "s/a", *(f"{p}{rng.randrange(n)}" for _ in range(6))])
    rows = [(i, v("doc", 60), v("aut", 90), v("ent", 90), v("f", 120), float(i % 5), "x") for i in range(150)]
    rows += [(1000 + i, f"chain{i}", f"link{i}", f"link{i + 1}b" if i % 2 else None, f"p{i // 2}", None, "x") for i in range(60)]
    rows += [(2000 + i, f"hot{i}", "El Mismo Autor", None, None, 1.0, "x") for i in range(120)]
    out = splits.grouped(spark.createDataFrame(rows, COLS), "row_id").select("row_id", F.hex("group_id").alias("g")).collect()
    want = brute(rows)
    got = {r["row_id"]: r["g"] for r in out}
    by_want, by_got = {}, {}
    for i in want:
        by_want.setdefault(want[i], set()).add(i)
        by_got.setdefault(got[i], set()).add(i)
    assert sorted(map(sorted, by_want.values())) == sorted(map(sorted, by_got.values()))


def test_spellings_fillers_and_nulls(spark):
    rows = [
        (1, "Informe A", "Ána  Pérez", None, None, 1.0, ""), (2, "informe b", "ANA PEREZ", None, None, 1.0, ""), (3, " INFORME A ", None, None, None, None, ""),
        (4, "Informe C", "s/a", "No consigna", "-", 1.0, ""), (5, "Informe D", "S/A", "no consigna", "-", 1.0, ""), (6, None, None, None, None, 1.0, ""), (7, "Informe E", None, None, "data\\x\\y.pdf", 1.0, ""), (8, None, "Zoe", None, "DATA/x/y.pdf", 1.0, ""), (9, "Informe F", "Zoé", None, None, 1.0, ""),
    ]
    got = {tuple(r) for r in splits.linked_spellings(spark.createDataFrame(rows, COLS), "row_id").collect()}
    assert got == {(" INFORME A ", "Informe A"), (" INFORME A ", "informe b"), ("Informe E", "Informe F")}


def test_shares_and_whole_groups(spark):
    rng = random.Random(9)
    rows = [(i, f"d{int(rng.paretovariate(0.7)) % 400}", None, None, None, float(rng.randrange(5)), "") for i in range(3990)]
    rows += [(3990 + i, None, "s/a", None, "-", None, "") for i in range(10)]  # rows without any key are groups of their own
    out = splits.assign_splits(spark.createDataFrame(rows, COLS).withColumn("split", F.lit("old")), "row_id", "question_score")
    got = out.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg("question_score").alias("m")).collect()
    n = {r["split"]: r["n"] for r in got}
    assert sum(n.values()) == 4000 and abs(n["validation"] / 4000 - 0.1) < 0.03 and abs(n["test"] / 4000 - 0.1) < 0.03
    assert max(r["m"] for r in got) - min(r["m"] for r in got) < 0.4
    assert out.groupBy("group_id").agg(F.countDistinct("split").alias("k")).where("k > 1").count() == 0


def test_checks_see_a_split_group(spark):
    rows = [(i, f"d{i % 50}", None, None, None, float(i % 5), "") for i in range(500)]
    out = splits.assign_splits(spark.createDataFrame(rows, COLS), "row_id", "question_score")
    got = {r["check_name"]: (r["n"], r["bad"]) for r in splits.split_checks(out, "question_score").collect()}
    assert got["document_id"] == (50, 0) and got["rows"] == (500, 0) and got["shares"][1] == got["scores"][1] == 0
    torn = out.withColumn("split", F.when(F.col("row_id") == 7, "test").when(F.col("row_id") == 57, "train").otherwise(F.col("split")))
    assert {r["check_name"]: r["bad"] for r in splits.split_checks(torn, "question_score").collect()}["document_id"] == 1


def test_forest_spans_the_groups(spark):
    rows = [(i, f"d{i % 20}", f"a{i % 7}" if i % 20 < 14 else None, None, None, 1.0, "") for i in range(200)]
    df = spark.createDataFrame(rows, COLS)
    edges = splits.forest(df).collect()
    nodes = {x for r in edges for x in (r["u"], r["v"])}
    groups = splits.grouped(df, "row_id").where("metadata_autor IS NOT NULL").select("group_id").distinct().count()
    assert len(edges) == len(nodes) - groups


def test_hot_groups_dealt_over_tasks(spark, monkeypatch):
    from valora import runtime

    rows = [(i, "Uno" if i % 3 else f"d{i}", None, None, None, float(i % 5), "") for i in range(300)] + [(300 + i, None, None, None, None, 1.0, "") for i in range(20)]
    df = spark.createDataFrame(rows, COLS)
    a = {(r["row_id"], r["split"]) for r in splits.assign_splits(df, "row_id", "question_score").collect()}
    monkeypatch.setattr(runtime, "SALT_ROWS", 20)
    monkeypatch.setattr(splits, "BROADCAST_ROWS", 0)
    assert {(r["row_id"], r["split"]) for r in splits.assign_splits(df, "row_id", "question_score").collect()} == a and len(a) == 320


def test_empty(spark):
    df = spark.createDataFrame([], COLS).drop("group_id")
    assert splits.linked_spellings(df, "row_id").count() == 0
    assert splits.assign_splits(df, "row_id", "question_score").count() == 0
