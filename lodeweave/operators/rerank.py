"""Injected models behind a search: encoders of windows and scorers of pairs, for what a search has pooled alone.

A model is given as a function that makes it. The function goes to the executors, each worker calls it once and keeps what
it gives while tasks of the same name follow, and texts reach it in batches. An encoder has encode(texts) -> vectors, a scorer
score(queries, texts) -> numbers; both may be anything that Python can call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions import text as T
from lodeweave.operators import kept, planner
from lodeweave.operators import ranking as R

#: Passages that an encoder and a scorer look at; words of a window and of its step; texts that a model gets at once.
DENSE_DEPTH, PAIR_DEPTH, WINDOW, STEP, AT_ONCE = 300, 50, 200, 150, 64
#: Models of this worker by name.
_loaded: dict[str, Any] = {}


def model(name: str, make: Callable[[], Any]) -> Any:
    """The worker's model of that name, made by its first task."""
    from lodeweave.operators import rerank  # the module's own table, not the copy that came with a function

    if name not in rerank._loaded:
        rerank._loaded[name] = make()
    return rerank._loaded[name]


def normalised(vectors: Any) -> np.ndarray:
    """Rows of length 1; a row of zeros stays."""
    rows = np.asarray(vectors, dtype=np.float64).reshape(len(vectors), -1)
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1.0)


def dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays of numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def encoded(rows: DataFrame, body: str, make: Callable[[], Any], name: str) -> DataFrame:
    """rows with vec in place of body, of length 1; a null text is encoded as empty."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = model(name, make)
        for batch in batches:
            texts = batch[body].fillna("").tolist()
            vectors = [v for i in range(0, len(texts), AT_ONCE) for v in normalised(own.encode(texts[i : i + AT_ONCE]))]
            yield batch.drop(columns=body).assign(vec=vectors)

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != body)
    return rows.mapInPandas(work, f"{kind}, vec array<double>")


def dense(index: kept.Index, pool: DataFrame, queries: DataFrame, make: Callable[[], Any], k: int, name: str = "encoder", window: int = WINDOW, step: int = STEP) -> DataFrame:
    """(item_id, pid, doc_path, cosine, score, rank): the k best documents of each query's pool by its order and by an encoder, reciprocal ranks fused.

    pool is (item_id, pid, rank) of queries (item_id, text). A document's place in the pool is its best passage's, which stands
    for it; its cosine is the largest over windows of its whole text. A document is encoded once, whatever number of queries pool it. Ties go to
    the better place in the pool.
    """
    if not 0 < step <= window:
        raise ValueError(f"windows of {window} words cannot step by {step}")
    paths = index.passages(pool).select("pid", "doc_path")
    first = Window.partitionBy("item_id", "doc_path").orderBy("rank")
    docs = pool.join(paths, "pid").withColumn("_i", F.row_number().over(first)).filter("_i = 1").select("item_id", "pid", "doc_path", "rank")
    docs = docs.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy("rank"))).drop("rank")
    whole = planner.texts(index, docs.select("doc_path").distinct(), "doc_path").select("doc_path", "content")
    words = F.filter(F.split("content", r"\s+"), lambda w: w != "")
    windows = whole.select("doc_path", F.explode(T.dense_windows(words, window, step)).alias("w")).select("doc_path", F.col("w.content").alias("text"))
    windows = encoded(windows.repartition("doc_path"), "text", make, name)
    asked = encoded(queries.select("item_id", "text"), "text", make, name).withColumnRenamed("vec", "q")
    near = docs.join(asked, "item_id").join(windows, "doc_path").groupBy("item_id", "pid", "doc_path", "place").agg(F.round(F.max(dot(F.col("q"), F.col("vec"))), 9).alias("cosine"))
    near = near.withColumn("by_cosine", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("cosine"), "place")))
    near = near.withColumn("score", F.round(1.0 / (R.RRF_K + F.col("place")) + 1.0 / (R.RRF_K + F.col("by_cosine")), 9))
    return R.top(near, k, "item_id", "place").select("item_id", "pid", "doc_path", "cosine", "score", "rank")


def pairs(index: kept.Index, pool: DataFrame, queries: DataFrame, make: Callable[[], Any], k: int, name: str = "scorer", depth: int = PAIR_DEPTH) -> DataFrame:
    """(item_id, pid, score, rank): the first depth passages of each pool by a scorer of (query, passage), the rest as they were.

    Equal scores keep the pool's order. score is the scorer's for the first depth passages, the pool's for the rest.
    """
    if depth < 1:
        raise ValueError("depth is 1 at least")
    head = pool.filter(F.col("rank") <= depth)
    rows = head.join(index.passages(head).select("pid", "content"), "pid").join(queries.select("item_id", "text"), "item_id").select("item_id", "pid", "rank", "text", "content")
    kind = f"item_id {pool.schema['item_id'].dataType.simpleString()}, pid long, rank int, score double"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = model(name, make)
        for b in batches:
            texts, contents = b["text"].fillna("").tolist(), b["content"].fillna("").tolist()
            scores = [float(s) for i in range(0, len(b), AT_ONCE) for s in own.score(texts[i : i + AT_ONCE], contents[i : i + AT_ONCE])]
            yield b[["item_id", "pid", "rank"]].assign(score=scores)

    scored = rows.mapInPandas(work, kind)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "rank")
    scored = scored.withColumn("rank", F.row_number().over(order))
    rest = pool.filter((F.col("rank") > depth) & (F.col("rank") <= k)).select("item_id", "pid", "score", "rank")
    return scored.filter(F.col("rank") <= k).select("item_id", "pid", "score", "rank").unionByName(rest)
