"""Ranked retrieval for batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions import text as T

K1, B, RRF_K = 1.2, 0.75, 60


def query_terms(queries: DataFrame, key: str = "item_id", body: str = "text") -> DataFrame:
    """(key, term, qtf): a term that a query repeats counts so often."""
    return queries.select(key, F.explode(T.tokens(F.col(body))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("qtf"))


def contribution(k1: float = K1, b: float = B) -> Column:
    tf, dl = F.col("tf").cast("double"), F.col("dl").cast("double")
    return F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.col("avgdl")))


def bm25(terms: DataFrame, post: DataFrame, vocab: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(item_id, doc_id, score): only vocabulary and postings of the queries' terms are joined, and sums are partial before they are shuffled."""
    weighted = terms.join(vocab.select("term", "idf", "avgdl"), "term")
    part = post.join(weighted, "term").withColumn("c", F.col("qtf") * contribution(k1, b))
    return part.groupBy("item_id", "doc_id").agg(F.round(F.sum("c"), 6).alias("score"))


def top(scores: DataFrame, k: int, by: str | list[str] = "item_id", tie: str = "doc_id", score: str = "score") -> DataFrame:
    """The k best of each group with rank from 1; ties to the smaller key."""
    order = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fuse(lists: list[tuple[DataFrame, float]], k: int, by: str = "item_id", key: str = "doc_id") -> DataFrame:
    """Weighted reciprocal rank fusion of (by, key, rank) lists."""
    every = None
    for ranked, weight in lists:
        own = ranked.select(by, key, (F.lit(weight) / (RRF_K + F.col("rank"))).alias("s"))
        every = own if every is None else every.unionByName(own)
    return top(every.groupBy(by, key).agg(F.round(F.sum("s"), 9).alias("score")), k, by, key)
