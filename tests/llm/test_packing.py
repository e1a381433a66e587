import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from valora.llm import packing, queries

pytestmark = pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="no vocabulary file")


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    rng = np.random.default_rng(4)
    t = np.sort(rng.integers(1, 2048, 3000))[::-1]
    b = packing.best_fit(t, 2048, 8, 2.5e6, rule)
    for w, cap in ((t, 2048), (np.ones(len(t)), 8), (t.astype(float) ** 2, 2.5e6)):
        use = np.bincount(b, w)
        # only an item that alone exceeds the cost capacity can't be helped
        heavy = np.zeros(len(use), bool)
        heavy[b[t.astype(float) ** 2 > 2.5e6]] = cap == 2.5e6
        assert (use[~heavy] <= cap + 1e-6).all()
    assert len(packing.best_fit(np.zeros(0, np.int64))) == 0


def test_cost_capacity_binds():
    rng = np.random.default_rng(5)
    t = np.sort(rng.integers(200, 1400, 2000))[::-1]
    held, free = packing.best_fit(t), packing.best_fit(t, cost=float("inf"))
    cost = lambda b: np.bincount(b, t.astype(float) ** 2)
    assert cost(held).max() <= packing.MAX_COST < cost(free).max()
    assert not np.array_equal(held, free)


def test_text_over_the_cost_is_reported_and_its_container_filled(spark):
    counts = spark.createDataFrame([(1, 1900), (2, 100), (3, 48), (4, 1400), (5, 600)], "doc long, tokens long")
    got = {r["doc"]: (r["container_id"], r["over_cost"]) for r in packing.pack(counts).collect()}
    assert got[1][1] and got[1] == got[2] == got[3] and not got[4][1] and got[4][0] != got[5][0]


def test_containers(spark, data):
    out = queries.p7_containers(spark, data).cache()
    f = packing.fill(out)
    assert f.where("tokens > 2048").count() == 0
    docs = spark.read.parquet(f"{data}/documents.parquet").where("length(trim(text)) > 0").count()
    assert out.select("doc_id").distinct().count() == docs
    assert out.groupBy("doc_id", "piece").count().where("count > 1").count() == 0
    assert out.where("piece > 0").join(out.where("piece = 0 AND tokens < 2048"), "doc_id", "left_semi").count() == 0
    total, n = out.agg(F.sum("tokens")).first()[0], f.count()
    assert n <= total / 2048 * 1.02 + 2
    c = packing.checks(out.withColumnRenamed("doc_id", "doc")).first().asDict()
    assert c == {"texts": docs, "over_tokens": 0, "over_documents": 0, "over_cost": 0, "unreported": 0, "uneven": 0, "dense": True}


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (None, "hola", "x"), (4, "hola <|endoftext|>", "x"), (5, "palabra " * 5000, "x"), (6, "palabra " * 5000, "x")], "doc_id long, t string, tokens string")
    out = packing.pack(packing.token_counts(df, "doc_id", "t")).collect()
    assert {r["doc"] for r in out} == {4, 5, 6}
    assert sum(r["tokens"] for r in out if r["doc"] == 5) == sum(r["tokens"] for r in out if r["doc"] == 6) > 4096
    assert packing.pack(packing.token_counts(df.limit(0), "doc_id", "t")).count() == 0
