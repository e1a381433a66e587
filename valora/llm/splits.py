"""Splits that keep related records together (problem 2).

Method: rows link the values of their key columns (report, author, entity, source file). Minimum
edges are contracted in Borůvka rounds; the edges that each round chose, kept as tables, form a
spanning forest, and every value ends with the root of its tree. Roots are grouped into size bands and dealt
to the splits systematically, in the order of their mean score.

Nothing of the graph is ever collected: each round joins edges with labels, and the tables of a
round are written to the shared folder, so lost executors cost no more than a stage. A value that
a third of all rows hold is one node: rows are reduced to distinct key combinations first, with
partial aggregation before the shuffle, and such a group's rows are joined with its root and its
split in several tasks.

Defined results: null, blank and "not stated" values link nothing; a row without any key is a
group of its own (drawn by a hash of its id); repeated rows count as rows but add no link; an
empty table gives empty tables; other columns pass through, those named like an added one are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valora.functions.text import accent_table
from valora.runtime import BROADCAST_ROWS, forget, keep, small_side, spread_join

#: Columns that tie rows together, and the letter that marks their nodes.
KEYS = {"document_id": "d", "metadata_autor": "a", "metadata_entidad": "e", "metadata_source_path": "s"}

# Fillers that stand for "not stated" (compared in link form).
FILLERS = (
    r"(s|n)\s*[/.\\-]?\s*(a|d|n|i|c|e|r)\.?",
    r"(na|nd|sd|ns|nc|nn|null|none|nan|nil|nulo|nula|vacio|vacia|ninguno|ninguna|tbd|xx+)",
    r"no (se )?(consigna|consignado|consignada|especifica|especificado|especificada|indica|indicado|indicada"
    r"|registra|registrado|registrada|disponible|aplica|determinado|determinada|identificado|identificada"
    r"|precisa|precisado|precisada|declara|declarado|declarada|figura|informa|informado|informada|menciona"
    r"|mencionado|mencionada|aplicable|definido|definida|asignado|asignada|conocido|conocida|tiene|hay|existe)( .*)?",
    r"sin (autor|autora|autores|autoria|entidad|institucion|fuente|archivo|ruta|dato|datos|informacion|nombre|titulo"
    r"|registro|registrar|especificar|identificar|asignar|definir|determinar|consignar|documento|responsable|referencia)( .*)?",
    r"(autor|autora|entidad|institucion|fuente|archivo|origen|documento) (desconocid|anonim|no )\w*( .*)?",
    r"(desconocid[oa]|anonim[oa]|pendiente|por (definir|determinar|completar|asignar|confirmar)|a definir|varios"
    r"|unknown|not (stated|available|applicable|specified|known|given)|unspecified|missing|undefined|no data)",
)


#: Bytes of a row of two nodes, whose ids are digests of 16 bytes, with what the row itself takes.
NODE_BYTES = 96


def link_form(value: Column) -> Column:
    """The form in which values are compared: no case, accents, outer or repeated spaces, one slash."""
    src, dst = accent_table()
    marks = "".join(map(chr, range(0x300, 0x370)))  # without a counterpart: dropped
    bare = F.translate(F.lower(value), "\\" + src + marks, "/" + dst)
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def links(form: Column) -> Column:
    """Whether a link form links: it has a letter or digit and is no filler."""
    filler = form.rlike("^[^\\p{L}\\p{N}]*(" + "|".join(FILLERS) + ")[^\\p{L}\\p{N}]*$")
    return form.rlike(r"[\p{L}\p{N}]") & ~filler


def nodes(df: DataFrame, keys: dict[str, str] | None = None) -> DataFrame:
    """df with `node_ids`: the array of its rows' nodes, 16-byte hashes of mark and link form.

    The forms are columns of a first projection, so that each is made once.
    """
    keys = keys or KEYS
    forms = df.withColumns({f"_f_{m}": link_form(F.col(c)) for c, m in keys.items()})
    ids = [F.when(links(F.col(f"_f_{m}")), F.unhex(F.md5(F.concat(F.lit(m + ":"), F.col(f"_f_{m}"))))) for m in keys.values()]
    return forms.withColumn("node_ids", F.array_compact(F.array(*ids))).drop(*(f"_f_{m}" for m in keys.values()))


def row_edges(noded: DataFrame) -> DataFrame:
    """(u, v, w): an edge from a row's first node to each other, heavier for fewer rows behind it.

    w is unique to an edge up to a 128-bit hash, so that minimum edges never close a ring of three.
    """
    e = (
        noded.where(F.size("node_ids") > 1)
        .groupBy("node_ids")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("n", F.get("node_ids", F.lit(0)).alias("a"), F.explode(F.slice("node_ids", 2, 64)).alias("b"))
        .where("a <> b")
        .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "n")
    )
    return e.groupBy("u", "v").agg(F.sum("n").alias("n")).select("u", "v", F.struct((-F.col("n")).alias("n"), "u", "v").alias("w"))


def spanning_forest(edges: DataFrame, max_rounds: int = 64) -> tuple[DataFrame, DataFrame]:
    """(forest, labels) of edges (u, v, w).

    forest: the edges (u, v) that Borůvka's rounds chose; labels: (node, root) of every node that
    has an edge. Raises if max_rounds rounds don't suffice, which 2**max_rounds nodes would need.
    """
    spark = edges.sparkSession
    live = keep(edges.select("u", "v", "w"), "p2-edges")
    forest, labels = None, None
    for _ in range(max_rounds):
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
        least = keep(both.groupBy("u").agg(F.min_by("v", "w").alias("p"), F.min("w").alias("w")), "p2-least")
        n = least.count()  # rows of every table of this round, read off the files' footers
        if n == 0:
            break
        chosen = least.select(F.col("w.u").alias("u"), F.col("w.v").alias("v")).distinct()
        forest = chosen if forest is None else forest.unionByName(chosen)
        # two nodes that chose each other: the smaller is the root
        back = least.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        parent = keep(
            least.join(small_side(back, n, NODE_BYTES), "p", "left").select("u", F.when((F.col("pp") == F.col("u")) & (F.col("u") < F.col("p")), F.col("u")).otherwise(F.col("p")).alias("p")),
            "p2-parent",
        )
        while True:  # pointer jumping, two jumps a job: path lengths are quartered
            up = small_side(parent.select(F.col("u").alias("p"), F.col("p").alias("g")), n, NODE_BYTES)
            twice = parent.join(up, "p").join(up.toDF("g", "g2"), "g")
            nxt = keep(twice.select("u", F.col("g2").alias("p"), (F.col("g2") != F.col("p")).alias("moved")), "p2-jump")
            moved = not nxt.where("moved").isEmpty()
            forget(spark, parent)
            parent = nxt
            if not moved:
                break
        step = parent.select(F.col("u").alias("node"), F.col("p").alias("root"))
        small = small_side(step, n, NODE_BYTES)
        if labels is None:
            labels = step
        else:  # nodes of earlier rounds follow their root; roots without an edge stay
            s = small.select(F.col("node").alias("root"), F.col("root").alias("r"))
            labels = keep(labels.join(s, "root", "left").select("node", F.coalesce("r", "root").alias("root")), "p2-labels")
        a = small.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        b = small.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        nxt = keep(
            live.join(a, "u").join(b, "v").where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"), "w").groupBy("u", "v").agg(F.min("w").alias("w")),
            "p2-edges",
        )
        forget(spark, live)
        live = nxt
    else:
        raise RuntimeError("Borůvka's rounds did not end")
    if labels is None:
        none = live.select(F.col("u").alias("node"), F.col("v").alias("root"))
        return live.select("u", "v"), none
    return forest.distinct(), labels


def grouped(df: DataFrame, id_col: str, keys: dict[str, str] | None = None) -> DataFrame:
    """df with `group_id`: equal for rows that key values link, directly or through others."""
    noded = nodes(df.drop("group_id", "node_ids", "first_node", "root"), keys)
    _, labels = spanning_forest(row_edges(noded))
    alone = F.unhex(F.md5(F.concat(F.lit("row:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))))
    rows = noded.withColumn("first_node", F.coalesce(F.get("node_ids", F.lit(0)), alone))
    lab, n = labels.select(F.col("node").alias("first_node"), "root"), labels.count()
    by = small_side(lab, n, NODE_BYTES)
    out = rows.join(by, "first_node", "left") if n <= BROADCAST_ROWS else spread_join(rows, lab, ["first_node"], [id_col], how="left")
    return out.withColumn("group_id", F.coalesce("root", "first_node")).drop("node_ids", "first_node", "root")


def forest(df: DataFrame, keys: dict[str, str] | None = None) -> DataFrame:
    """(u, v): the edges of the spanning forest over the key values' nodes (digests, in hexadecimal)."""
    edges, _ = spanning_forest(row_edges(nodes(df.select(*(keys or KEYS)), keys)))
    return edges.select(F.hex("u").alias("u"), F.hex("v").alias("v"))


def band_plan(bands: list[tuple[int, int, int]], shares: dict[str, float]) -> dict[int, dict[str, int]]:
    """How many groups of each size band go to each split but the first.

    bands: (band, groups, rows). Going from the largest groups to the smallest, a split gets as many
    groups of a band as bring its rows nearest below its share of all rows seen so far, so that the
    bands of small groups level out what those of large ones could not give.
    """
    got, seen, plan = dict.fromkeys(shares, 0.0), 0, {}
    first = next(iter(shares))
    for band, n, rows in sorted(bands, reverse=True):
        seen += rows
        mean, left, plan[band] = rows / n, n, {}
        for split, share in shares.items():
            if split != first:
                take = min(left, max(0, int((share * seen - got[split]) / mean + 0.5)))
                plan[band][split] = take
                got[split] += take * mean
                left -= take
    return plan


def assign_splits(df: DataFrame, id_col: str, score_col: str, shares: dict[str, float] | None = None, keys: dict[str, str] | None = None) -> DataFrame:
    """df with `group_id` and `split`.

    shares: split name -> share of rows, the first taking what the others leave. Groups of a size
    band (powers of two of their rows) are ranked by mean score; a split takes every k-th rank, so
    each has like scores. Ranks come from range partitions and their counts, not from one sort.
    """
    df = df.drop("split")
    shares = shares or {"train": 0.8, "validation": 0.1, "test": 0.1}
    first, *others = shares
    spark = df.sparkSession
    rows = keep(grouped(df, id_col, keys), "p2-rows")
    groups = rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(score_col), F.lit(-1.0)).alias("score"))
    groups = groups.withColumn("band", F.floor(F.log2("n")).cast("int"))
    ranged = keep(
        groups.repartitionByRange("band", "score", "group_id").sortWithinPartitions("band", "score", "group_id").withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id() % (1 << 33)),
        "p2-ranged",
    )
    # per partition and band (bounded by partitions x 64): groups, rows, and the first position
    stats = ranged.groupBy("part", "band").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("r"), F.min("pos").alias("p0")).collect()
    offset, base = {}, []
    for s in sorted(stats, key=lambda s: (s["band"], s["part"])):
        base.append((s["part"], s["band"], offset.get(s["band"], 0) - s["p0"]))
        offset[s["band"]] = offset.get(s["band"], 0) + s["c"]
    per_band: dict[int, list[int]] = {}
    for s in stats:
        b = per_band.setdefault(s["band"], [0, 0])
        b[0] += s["c"]
        b[1] += s["r"]
    plan = band_plan([(b, n, r) for b, (n, r) in per_band.items()], shares)
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("band", T.IntegerType()), T.StructField("base", T.LongType())])
    at = spark.createDataFrame(base, schema)
    cols = ["band", "groups", *others]
    plan_rows = [(b, per_band[b][0], *(plan[b][o] for o in others)) for b in per_band]
    plan_df = spark.createDataFrame(plan_rows, "band int, groups long, " + ", ".join(f"`{o}` long" for o in others)).toDF(*cols)
    dealt = ranged.join(F.broadcast(at), ["part", "band"]).join(F.broadcast(plan_df), "band")
    # of the G ranks still open, a split takes the k where floor(rank*k/G) steps up; the others close up
    rank, of, split = F.col("pos") + F.col("base"), F.col("groups"), F.lit(None).cast("string")
    for o in others:
        before, after = F.floor(rank * F.col(o) / of), F.floor((rank + 1) * F.col(o) / of)
        split = F.coalesce(split, F.when((of > 0) & (after > before), F.lit(o)))
        rank, of = rank - after, F.greatest(of - F.col(o), F.lit(1))
    return spread_join(rows, dealt.select("group_id", F.coalesce(split, F.lit(first)).alias("split")), ["group_id"], [id_col], groups.select("group_id", "n"))


def split_checks(split: DataFrame, score_col: str, shares: dict[str, float] | None = None, keys: dict[str, str] | None = None, tolerance: float = 0.02, errors: float = 3.0) -> DataFrame:
    """(check_name, n, bad) of assign_splits()' result.

    For every key column the linking values and those over two splits; rows, and those without a
    split; splits, and those off their share by more than `tolerance` or the largest group's half;
    splits, and those whose mean score is off the whole's by more than 0.05 and `errors` standard
    errors of a mean of so many groups.
    """
    shares = shares or {"train": 0.8, "validation": 0.1, "test": 0.1}
    out = []
    for c in keys or KEYS:
        forms = split.select(link_form(F.col(c)).alias("f"), "split").where(links(F.col("f")))
        per = forms.groupBy("f").agg(F.min("split").alias("a"), F.max("split").alias("b"))
        out.append(per.agg(F.lit(c).alias("check_name"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") != F.col("b")).alias("bad")))
    out.append(split.agg(F.lit("rows").alias("check_name"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("split").isNull()).alias("bad")))
    groups = split.groupBy("split", "group_id").agg(F.count(F.lit(1)).alias("k"), F.count(score_col).alias("s"), F.sum(score_col).alias("t"))
    by = groups.groupBy("split").agg(F.sum("k").alias("k"), F.try_divide(F.sum("t"), F.sum("s")).alias("m"), F.count(F.lit(1)).alias("groups"))
    whole = groups.agg(F.sum("k").alias("all"), F.try_divide(F.sum("t"), F.sum("s")).alias("mean"), F.max("k").alias("top"), F.coalesce(F.stddev(F.try_divide("t", "s")), F.lit(0.0)).alias("sd"))
    one = F.lit(1).alias("one")  # tables of one row, laid side by side by an equal key
    by = by.select("*", one).join(F.broadcast(whole.select("*", one)), "one")
    want = F.coalesce(*(F.when(F.col("split") == k, F.lit(v)) for k, v in shares.items()))
    off = F.abs(F.col("k") / F.col("all") - want) > F.greatest(F.lit(tolerance), F.col("top") / F.col("all") / 2)
    out.append(by.agg(F.lit("shares").alias("check_name"), F.lit(len(shares)).cast("long").alias("n"), F.count_if(F.coalesce(off, F.lit(True))).alias("bad")))
    out.append(by.agg(F.lit("scores").alias("check_name"), F.lit(len(shares)).cast("long").alias("n"), F.count_if(F.abs(F.col("m") - F.col("mean")) > 0.05 + errors * F.col("sd") / F.sqrt("groups")).alias("bad")))
    return reduce(DataFrame.unionByName, out)


def linked_spellings(df: DataFrame, id_col: str, keys: dict[str, str] | None = None, doc_col: str = "document_id") -> DataFrame:
    """(document_id_a, document_id_b): of each group, its smallest spelling with every other one.

    The smallest is joined back to its group, whose spellings are never gathered in one place.
    """
    key_cols = [c for c in (keys or KEYS)]
    g = grouped(df.select(id_col, *key_cols), id_col, keys)
    # a spelling that links nothing (blank or filler) belongs to no other
    sp = keep(g.where(links(link_form(F.col(doc_col)))).select("group_id", F.col(doc_col).alias("spelling")).distinct(), "p2-spellings")
    low = sp.groupBy("group_id").agg(F.min("spelling").alias("document_id_a"), F.count(F.lit(1)).alias("n"))
    out = spread_join(sp, low.drop("n"), ["group_id"], ["spelling"], low.select("group_id", "n"))
    return out.where("spelling <> document_id_a").select("document_id_a", F.col("spelling").alias("document_id_b"))
