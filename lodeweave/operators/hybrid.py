"""One ranking from a pool of BM25 results and the signals that vote on it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.operators import ranking as R

RRF_K, ALPHA = 60, 0.1
#: Weights of BM25, facts and links by what a query asks for.
INTENTS = {"kg_first": (0.5, 2.0, 0.5), "bm25_first": (2.0, 0.5, 0.5), "balanced": (1.0, 1.0, 1.0)}
#: Weights of the signals that do not hang on it.
OTHERS = {"structural": 1.0, "recency": 0.3, "link_pop": 0.2}


def _of_intent(place: int):
    return reduce(lambda c, kv: c.when(F.col("intent") == kv[0], kv[1][place]), INTENTS.items(), F).otherwise(INTENTS["balanced"][place])


def hybrid(pool: DataFrame, signals: dict[str, DataFrame], intents: DataFrame, k: int = 10, alpha: float = ALPHA, by: str = "item_id", key: str = "doc_id") -> DataFrame:
    """(by, key, score, rrf, rank): the k best of pool by weighted reciprocal ranks.

    pool (by, key, score, rank) votes with its own order. signals (kg, links, structural, recency, link_pop) are
    tables (by, key, score) of which only positive scores of documents in a query's pool count, best first,
    ties to the smaller key; alpha scales them. score stays the one of BM25. intents (by, intent) may lack a
    query, which then is a balanced one.
    """
    if bad := set(signals) - {"kg", "links", *OTHERS}:
        raise ValueError(f"unknown signals {sorted(bad)}")
    members = pool.select(by, key)
    lists = [pool.select(by, key, "rank", F.lit("bm25").alias("signal"))]
    for name, scores in signals.items():
        voted = scores.filter("score > 0").select(by, key, "score").join(members, [by, key], "left_semi")
        lists.append(R.top(voted, 2**31 - 1, by, key).select(by, key, "rank", F.lit(name).alias("signal")))
    votes = reduce(DataFrame.unionByName, lists).join(intents.select(by, "intent"), by, "left")
    weight = F.when(F.col("signal") == "bm25", _of_intent(0)).when(F.col("signal") == "kg", alpha * _of_intent(1)).when(F.col("signal") == "links", alpha * _of_intent(2))
    for name, own in OTHERS.items():
        weight = weight.when(F.col("signal") == name, alpha * own)
    fused = votes.groupBy(by, key).agg(F.round(F.sum(weight / (RRF_K + F.col("rank"))), 9).alias("rrf"))
    best = R.top(fused, k, by, key, "rrf")
    return best.join(pool.select(by, key, "score"), [by, key])


def popularity(edges: DataFrame, key: str = "doc_path") -> DataFrame:
    """(key, score): inbound links over the most of any document. edges (source, target) hold each link once, as often as it stands."""
    counts = edges.groupBy(F.col("target").alias(key)).agg(F.count(F.lit(1)).alias("inbound"))
    return counts.crossJoin(F.broadcast(counts.agg(F.max("inbound").alias("most")))).select(key, (F.col("inbound") / F.col("most")).alias("score"))  # one row


def merged(results: DataFrame, k: int, variant: str = "variant", by: str = "item_id", key: str = "doc_id") -> DataFrame:
    """(by, key, score, rrf, rank): ranked lists of a query's variants, or of several nodes, in one; score is a document's best."""
    votes = results.groupBy(by, key).agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("rrf"), F.max("score").alias("score"))
    return R.top(votes, k, by, key, "rrf")
