import random
import re
import unicodedata

import numpy as np

from valora import runtime
from valora.llm import leaks, queries


def words(t):
    t = "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", t)


def test_found_equals_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"pal{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 40)))) for i in range(30)]
    docs = []
    for d in range(200):
        t = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        if d % 2:
            w = items[rng.randrange(30)][1].split()
            k = rng.randint(8, 20)
            s = rng.randrange(max(1, len(w) - k + 1))
            t[len(t) // 2 : len(t) // 2] = [x.upper() + rng.choice(["", ",", "  ", "\n"]) for x in w[s : s + k]]
        docs.append((d, " ".join(t), "x"))
    docs += [(900, None, "x"), (901, "", "x")]
    want = set()
    for i, t in items:
        w = words(t)
        grams = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        for d, x, _ in docs:
            y = words(x or "")
            if any(tuple(y[k : k + 12]) in grams for k in range(len(y) - 11)):
                want.add((d, i))
    dd = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    ii = spark.createDataFrame(items, "item_id long, item_text string")
    out = leaks.leaks(dd, "doc_id", "text", ii, "item_id", "item_text")
    assert {(r["doc"], r["item_id"]) for r in out.where("longest_run >= 12").collect()} == want
    assert leaks.leaks(dd.limit(0), "doc_id", "text", ii, "item_id", "item_text").count() == 0
    assert leaks.leaks(dd, "doc_id", "text", ii.limit(0), "item_id", "item_text").count() == 0


def test_joined_and_salted_give_the_same_as_broadcast(spark, data, monkeypatch):
    a = {tuple(r) for r in queries.p8_alignments(spark, data).collect()}
    monkeypatch.setattr(leaks, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(runtime, "SALT_ROWS", 3)
    monkeypatch.setattr(leaks, "FILTER_BITS", 1 << 12)  # a filter that lets most n-grams through
    assert {tuple(r) for r in queries.p8_alignments(spark, data).collect()} == a and a


def test_words_are_parted_by_any_white_space(spark):
    """Items are bounded by their words whatever stands between them, and a leak crosses line feeds."""
    item = "\n".join(f"palabra{i}" for i in range(20))
    dd = spark.createDataFrame([(1, item.replace("\n", "\u00a0")), (2, "x")], "doc_id long, text string")
    ii = spark.createDataFrame([(7, item), (7, "otro texto del mismo item"), (None, item)], "item_id long, item_text string")
    assert [(r["doc"], r["item_id"], r["longest_run"], r["share"]) for r in leaks.leaks(dd, "doc_id", "text", ii, "item_id", "item_text").collect()] == [(1, 7, 20, 1.0)]


def test_alignment_against_a_plain_table():
    rng = random.Random(7)
    for _ in range(60):
        a = [rng.randrange(4) for _ in range(rng.randint(1, 12))]
        b = [rng.randrange(4) for _ in range(rng.randint(1, 15))]
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (leaks.MATCH if a[i - 1] == b[j - 1] else leaks.MISMATCH), h[i - 1][j] + leaks.GAP, h[i][j - 1] + leaks.GAP)
        run = max((k for i in range(len(a)) for j in range(len(b)) for k in [next((x for x in range(20) if i + x >= len(a) or j + x >= len(b) or a[i + x] != b[j + x]), 0)]), default=0)
        s, m, r, _ = leaks.align(np.array(a), np.array(b))
        assert s == max(max(x) for x in h) and r == run and 0 <= m <= min(len(a), len(b))


def test_edited_copies_score_high():
    rng = random.Random(1)
    item = np.array([rng.randrange(1000) for _ in range(40)])
    edited = np.delete(item.copy(), [7, 19, 31])
    edited[25] = 5000
    s, m, r, _ = leaks.align(item, np.concatenate((np.arange(6000, 6020), edited, np.arange(7000, 7020))))
    assert s >= 0.75 * leaks.MATCH * 40 and m >= 35 and r < 12


def test_edited_copies_are_found(spark):
    """Copies with an edit in every 9 words hold no 12 words of their item, but some of its n-grams."""
    rng = random.Random(3)
    items = [(i, " ".join(f"p{rng.randrange(4000)}" for _ in range(60))) for i in range(20)]
    docs = []
    for i, t in items:
        copy = [f"otra{k}" if k % 9 == i % 9 else w for k, w in enumerate(t.split())]
        docs.append((i, " ".join([*(f"ruido{rng.randrange(500)}" for _ in range(30)), *copy])))
    docs += [(100 + i, t) for i, t in items[:5]]  # whole copies, so that all n-grams of some items are held
    dd, ii = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")
    out = leaks.leaks(dd, "doc_id", "text", ii, "item_id", "item_text").collect()
    assert {(r["doc"], r["item_id"]) for r in out if r["share"] >= 0.5} == {(d, d % 100) for d, _ in docs}
    assert all(r["longest_run"] < 12 for r in out if r["doc"] < 100)
    known = leaks.Codes()
    assert next(r["score"] for r in out if r["doc"] == 7) == leaks.align(known.of(items[7][1].split()), known.of(docs[7][1].split()))[0]


def test_recall_of_edited_copies_against_aligning_all_pairs(spark):
    """Copies with one word in 5 to 30 changed, dropped or added at random: those that an alignment of
    all pairs scores at half of the item or more are the true ones."""
    rng = random.Random(11)
    items = [(i, [f"p{rng.randrange(3000)}" for _ in range(rng.randint(25, 80))]) for i in range(40)]
    docs = []
    for d in range(240):
        w, rate = items[d % 40][1], rng.choice((5, 8, 12, 20, 30))
        copy = []
        for x in w:
            kind = rng.randrange(3) if rng.random() < 1 / rate else None
            copy += [x] if kind is None else [] if kind == 0 else [f"e{rng.randrange(99)}"] if kind == 1 else [x, f"e{rng.randrange(99)}"]
        docs.append((d, [*(f"r{rng.randrange(300)}" for _ in range(20)), *copy, *(f"r{rng.randrange(300)}" for _ in range(20))]))
    known = leaks.Codes()
    coded = [(i, known.of(w)) for i, w in items]
    want = {(d, i) for d, t in docs for i, c in coded if leaks.align(c, known.of(t))[0] >= leaks.MATCH * len(c) / 2}
    dd = spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string")
    ii = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, item_text string")
    got = {(r["doc"], r["item_id"]) for r in leaks.leaks(dd, "doc_id", "text", ii, "item_id", "item_text").where("share >= 0.5").collect()}
    assert got <= want and len(want) > 150 and len(got) >= 0.9 * len(want), (len(got), len(want))
