"""Filling containers of fixed capacity with texts (problem 7).

Method: vector best-fit. An item takes tokens, one document and its attention cost (tokens squared)
of a container; of all open containers that can take it under every capacity, the one with the
least weighted norm of the residuals it would leave (or the largest weighted dot product of item
and residual) gets it. Items come by falling size. By default a container may cost half of what one
full text would, so a long text goes with short ones rather than with one of its kind.

Tokens are counted with the vocabulary file of a public byte-level tokenizer; its path is a
parameter.

Packing is spread over shards of about SHARD_TOKENS tokens, drawn by a hash of the item, so that
every shard sees the same mix of sizes; a shard leaves at most its last few containers partly
filled, so the space lost to sharding stays below about two containers per thousand.

Defined results: null and blank texts are left out; a text over the capacity is cut into ranges of
tokens, whole containers' worth each, whose last rest is packed like an item; a text that costs more
than the cost capacity by itself can't be brought under it without being split: it is kept whole,
its container is reported (`over_cost`) and is filled up under the other capacities; ties are broken by
id; repeated rows are items of their own; rows with a null id are left out; an empty table gives an
empty table; further columns are not read. Texts are counted whole.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valora.runtime import keep, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
CAPACITY = 2048
MAX_DOCUMENTS = 256
#: The attention cost that a container may have: half of a full text's.
MAX_COST = CAPACITY**2 / 2
SHARD_TOKENS = 4_000_000
#: Bytes that a vocabulary file may have to be sent to the executors.
VOCABULARY_BYTES = 32 << 20

# Fixed value: the public byte-level tokenizers' splitting pattern.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(vocabulary: bytes):
    """The tokenizer's function from a text to its tokens, no string being special."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x)}
    return tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def token_counts(df: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc, tokens) of every row with an id and a text that isn't blank."""
    if os.path.getsize(tokenizer) > VOCABULARY_BYTES:
        raise ValueError(f"{tokenizer} has more than {VOCABULARY_BYTES} bytes")
    with open(tokenizer, "rb") as f:
        held = df.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(held.value)
        for pdf in batches:
            text = pdf["text"]
            keep_ = [bool(t) and not t.isspace() for t in text]
            yield pd.DataFrame({"doc": pdf["doc"][keep_], "tokens": np.fromiter((len(encode(t)) for t, k in zip(text, keep_, strict=True) if k), np.int64)})

    src = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    return spread(src).mapInPandas(count, "doc long, tokens long").where("tokens > 0")


def best_fit(tokens: np.ndarray, capacity: int = CAPACITY, documents: int = MAX_DOCUMENTS, cost: float = MAX_COST, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.02, 0.1)) -> np.ndarray:
    """The container number of each item; tokens must fall (or be equal) from one to the next.

    cost: the capacity for the sum of squared tokens. A container opened by an item that exceeds it
    alone is held to the other capacities only. Containers that even the smallest item can't enter
    are closed, so the open ones stay few.
    """
    cap = np.array([capacity, documents, cost], np.float64)
    w = np.array(weights)
    out = np.empty(len(tokens), np.int64)
    res = np.empty((64, 3))  # residuals of the open containers, as shares of the capacities
    name = np.empty(64, np.int64)
    n_open = made = 0
    squares = tokens.astype(np.float64) ** 2
    shares = np.stack([tokens, np.ones(len(tokens)), squares], 1) / cap
    least = shares[-1] if len(tokens) else None
    eps = 1e-12
    for i, item in enumerate(shares):
        r = res[:n_open]
        left = r - item
        at = np.flatnonzero((left > -eps).all(1))
        if len(at):
            left = left[at]
            left[left[:, 2] > 1, 2] = 0.0  # over its cost anyway: that capacity has no residual to weigh
            score = (w * left**2).sum(1) if rule == "norm" else -(w * np.minimum(r[at], 1.0) * item).sum(1)
            j = at[int(score.argmin())]
        else:
            if n_open == len(res):
                res, name = np.concatenate((res, np.empty_like(res))), np.concatenate((name, np.empty_like(name)))
            j, name[n_open], res[n_open] = n_open, made, 1.0
            if item[2] > 1:
                res[j, 2] = np.inf
            n_open, made = n_open + 1, made + 1
        res[j] -= item
        out[i] = name[j]
        if (res[j] < least - eps).any():  # closed: nothing fits any more
            n_open -= 1
            res[j], name[j] = res[n_open], name[n_open]
    return out


PACKED = "container_id string, doc long, piece int, first_token long, tokens long, over_cost boolean"


def pack(counts: DataFrame, capacity: int = CAPACITY, documents: int = MAX_DOCUMENTS, cost: float = MAX_COST, rule: str = "norm", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(container_id, doc, piece, first_token, tokens, over_cost): where every text, or range of its tokens, goes.

    counts: (doc, tokens). piece counts from 0; a text within the capacity has the one piece 0.
    over_cost tells that the container holds a text that exceeds the cost capacity by itself.
    """
    counts = keep(counts, "p7-counts")
    total = counts.agg(F.sum("tokens")).first()[0] or 0
    shards = max(1, -(-int(total) // shard_tokens))
    piece = F.explode(F.sequence(F.lit(0), ((F.col("tokens") - 1) / capacity).cast("int")))
    items = counts.select("doc", "tokens", piece.alias("piece")).select(
        "doc", "piece", (F.col("piece").cast("long") * capacity).alias("first_token"), F.least(F.lit(capacity).cast("long"), F.col("tokens") - F.col("piece").cast("long") * capacity).alias("tokens")
    )
    full = items.where(F.col("tokens") == capacity).select(F.concat(F.lit("f"), F.col("doc"), F.lit("."), F.col("piece")).alias("container_id"), "doc", "piece", "first_token", "tokens", F.lit(float(capacity) ** 2 > cost).alias("over_cost"))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc", "piece"], ascending=[False, True, True], kind="stable")
        bins = best_fit(pdf["tokens"].to_numpy(), capacity, documents, cost, rule)
        heavy = np.zeros(int(bins.max(initial=-1)) + 1, bool)
        heavy[bins[pdf["tokens"].to_numpy().astype(np.float64) ** 2 > cost]] = True
        return pdf.assign(container_id=[f"s{key[0]}.{b}" for b in bins], over_cost=heavy[bins])[["container_id", "doc", "piece", "first_token", "tokens", "over_cost"]]

    rest = items.where(F.col("tokens") < capacity).withColumn("shard", F.pmod(F.xxhash64("doc", "piece"), F.lit(shards)).cast("int"))
    return full.unionByName(rest.groupBy("shard").applyInPandas(one, PACKED))


def fill(packed: DataFrame) -> DataFrame:
    """(container_id, documents, tokens, cost, over_cost) of every container."""
    return packed.groupBy("container_id").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"), F.sum(F.col("tokens").cast("double") ** 2).alias("cost"), F.max("over_cost").alias("over_cost"))


def checks(packed: DataFrame, capacity: int = CAPACITY, documents: int = MAX_DOCUMENTS, cost: float = MAX_COST, least_fill: float = 0.98) -> DataFrame:
    """One row: texts, over_tokens, over_documents, over_cost, unreported, uneven, dense.

    Containers over each capacity (over_cost without those reported, of which `unreported` counts
    those without a text that exceeds it alone), texts whose pieces leave gaps, overlap or are split
    without need (uneven), and whether the containers are filled to `least_fill` (dense; one
    container may stand open).
    """
    one = F.count_if
    c = fill(packed).join(packed.groupBy("container_id").agg(F.max(F.col("tokens").cast("double") ** 2).alias("top")), "container_id")
    c = c.agg(
        one(F.col("tokens") > capacity).alias("over_tokens"), one(F.col("documents") > documents).alias("over_documents"), one((F.col("cost") > cost) & ~F.col("over_cost")).alias("over_cost"),
        one(F.col("over_cost") & (F.col("top") <= cost)).alias("unreported"), (F.coalesce(F.sum("tokens"), F.lit(0)) >= least_fill * capacity * (F.count(F.lit(1)) - 1)).alias("dense"),
    )
    d = packed.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.max("piece").alias("last"), F.countDistinct("piece").alias("k"), F.sum("tokens").alias("t"), F.max(F.col("first_token") + F.col("tokens")).alias("end"))
    d = d.agg(F.count(F.lit(1)).alias("texts"), one(~((F.col("n") == F.col("k")) & (F.col("last") + 1 == F.col("n")) & (F.col("t") == F.col("end")) & (F.col("n") == F.ceil(F.col("t") / capacity)))).alias("uneven"))
    names = ["texts", "over_tokens", "over_documents", "over_cost", "unreported", "uneven", "dense"]
    return d.unionByName(c, True).agg(*(F.max(x).alias(x) for x in names))  # one row each, laid into one
