"""Context packing, budgets and evaluation over ordered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def packed(ranked: DataFrame, budget: int, by: str = "item_id", cost: str = "tokens", extra: int = 15) -> DataFrame:
    """The prefix of each ranked list whose running cost stays within budget."""
    order = Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("used", F.sum(F.col(cost) + extra).over(order)).filter(F.col("used") <= budget)


def budget_status(usage: DataFrame, by: str, order: str, tokens: str, critical: float = 4000.0, rounds: int = 5) -> DataFrame:
    """Mean of the last 20 uses and the state of each: critical from that many tokens on, else trend after so many rounds of growth, else warning at over twice the mean (from five uses on), else ok.

    Growth starts anew after a critical use and after one that did not grow.
    """
    so_far = Window.partitionBy(by).orderBy(order)
    mean, n = F.avg(tokens).over(so_far.rowsBetween(-19, 0)), F.row_number().over(so_far)
    before = F.lag(tokens).over(so_far)
    grew = F.coalesce((F.col(tokens) < critical) & (before > 0) & (F.col(tokens) > before), F.lit(False))
    rows = usage.select(by, order, tokens, mean.alias("mean"), n.alias("n"), grew.alias("grew"))
    rows = rows.withColumn("spell", F.sum(F.when(F.col("grew"), 0).otherwise(1)).over(so_far))
    growth = F.sum(F.col("grew").cast("int")).over(Window.partitionBy(by, "spell").orderBy(order))
    status = F.when(F.col(tokens) >= critical, "critical").when(growth >= rounds, "trend").when((F.col("n") >= 5) & (F.col("mean") > 0) & (F.col(tokens) > 2 * F.col("mean")), "warning").otherwise("ok")
    return rows.select(by, order, F.round("mean", 6).alias("mean20"), status.alias("status"))


def quality(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """recall@k, MRR and nDCG@k of ranked lists against graded judgements, averaged over judged queries."""
    judged = qrels.join(run.filter(F.col("rank") <= k), ["item_id", "doc_id"], "left")
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    ideal = Window.partitionBy("item_id").orderBy(F.desc("grade"), "doc_id")
    judged = judged.withColumns({"gain": F.coalesce(gain / F.log2(F.col("rank") + 1), F.lit(0.0)), "best": F.row_number().over(ideal)})
    judged = judged.withColumn("top", F.when(F.col("best") <= k, gain / F.log2(F.col("best") + 1)).otherwise(0.0))
    each = judged.groupBy("item_id").agg((F.count("rank") / F.count(F.lit(1))).alias("recall"), F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("rr"), (F.sum("gain") / F.sum("top")).alias("ndcg"))
    return each.agg(F.count(F.lit(1)).alias("n_queries"), *(F.round(F.avg(c), 6).alias(c) for c in ("recall", "rr", "ndcg")))


def by_type(run: DataFrame, questions: DataFrame, k: int = 10) -> DataFrame:
    """(query_type, n, recall, rr) of ranked paths (query, doc_path, rank) against questions (query, query_type, expected array); a null type is "".

    A path is a hit where it holds an expected one or stands in it. A query counts as found if a hit is among its first k.
    """
    hits = run.join(questions.select("query", "expected"), "query").filter(F.exists("expected", lambda e: F.contains("doc_path", e) | F.contains(e, F.col("doc_path"))))
    first = hits.groupBy("query").agg(F.min("rank").alias("first"))
    each = questions.select("query", F.coalesce("query_type", F.lit("")).alias("query_type")).distinct().join(first, "query", "left")
    found = F.when(F.col("first") <= k, 1.0).otherwise(0.0)
    return each.groupBy("query_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(found), 6).alias("recall"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("rr"))


def interval(values: DataFrame, value: str, by: str, draws: int = 1_000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """(by, mean, low, high): a bootstrap interval of the mean of each group, by Poisson weights that hang on the row, the draw and the seed.

    Weights stand for drawing rows with replacement, and their sums are partial before they move: no group is gathered.
    """
    # a uniform number of 0 to 1 from a hash, through the distribution of Poisson(1)
    tall = values.filter(F.col(value).isNotNull()).withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = (F.xxhash64(F.to_json(F.struct(*values.columns)), "_draw", F.lit(seed)) % 2**40).cast("double") / 2**41 + 0.5
    weight, chance, total = F.lit(0), 0.36787944117144233, 0.0
    for n in range(1, 8):
        total += chance
        weight = F.when(u > total, n).otherwise(weight)
        chance /= n
    sums = tall.withColumn("_w", weight).groupBy(by, "_draw").agg((F.sum(F.col("_w") * F.col(value)) / F.nullif(F.sum("_w"), F.lit(0))).alias("m"))
    tail = (1 - level) / 2
    bounds = sums.groupBy(by).agg(F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high"))
    return values.groupBy(by).agg(F.avg(value).alias("mean")).join(bounds, by)
