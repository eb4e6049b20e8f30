"""Operator 4: exact top-k search by inner product over a pivot-distance index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.llm.ranking import ranked
from lodeweave.session import stored

#: Pivots come from at most this many sampled vectors; an annulus holds this many rows; queries meet it in such groups.
PIVOTS, SAMPLED, RING, GROUP = 48, 4096, 2048, 8192
#: Queries of a group that are multiplied with an annulus at once.
AT_ONCE = 512
SCALE, K = 1024.0, 10


def usable(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """vec_id, x (floor(scale * component) as doubles): rows whose vector and components are not null and finite."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.filter(x.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.col("vec_id").isNotNull())
    return rows.select("vec_id", F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(scale)).cast("double")).alias("x"))


def matrix(column: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows; other lengths are cut or padded with 0, which no inner product sees."""
    if all(len(v) == width for v in column):
        return np.array([np.asarray(v) for v in column], dtype=np.float64).reshape(-1, width)
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : min(width, len(v))] = v[:width]
    return out


def pivots(rows: DataFrame, n: int, width: int, most: float) -> np.ndarray:
    """n centres of a bounded sample, found by farthest points and three passes of means, in the lifted space."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLED).toPandas()
    x = lift(matrix(sample["x"], width), most)
    chosen = [0]
    near = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(x)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    centre = x[chosen]
    for _ in range(3):
        own = distances(x, centre).argmin(1)
        centre = np.stack([x[own == i].mean(0) if (own == i).any() else centre[i] for i in range(len(centre))])
    return centre


def lift(x: np.ndarray, most: float) -> np.ndarray:
    """One more component gives every vector the length most, so that the nearest is the one of largest inner product."""
    return np.hstack([x, np.sqrt(np.maximum(0.0, most * most - (x * x).sum(1)))[:, None]])


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T))


def best(query_ids: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of ids for each row of scores, ties to the smaller id, never the query itself."""
    if not len(ids) or not len(query_ids):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    scores = np.where(ids[None, :] == query_ids[:, None], -np.inf, scores)
    least = np.partition(scores, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k)]
    q, c = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
    order = np.lexsort((ids[c], -scores[q, c], q))
    q, c = q[order], c[order]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < k
    q, c = q[keep], c[keep]
    return pd.DataFrame({"query_id": query_ids[q], "vec_id": ids[c], "score": scores[q, c].astype(np.int64)})


def search(vectors: DataFrame, is_query, k: int = K, scale: float = SCALE, n_pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of every query with all other rows.

    Index: with one more component all vectors lie on a sphere, where a larger inner product is a smaller
    distance. Every row is keyed by its nearest pivot and the distance to it, and each pivot's rows,
    sorted by that distance, are cut into annuli of RING rows. Search: a query first expands the two annuli
    around its own distance in its nearest pivot's list; the k-th best there bounds how far others may
    lie. Then it visits exactly the annuli that the triangle inequality cannot rule out, those with
    d(q, p) - bound <= distance <= d(q, p) + bound. Annuli and queries meet in groups of bounded size.

    Vectors null or with null or non-finite components, and rows without vec_id, take no part. Rows that
    repeat a vec_id are candidates each, but not for a query of that id. An empty table gives an empty
    result; other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors, scale), "vectors")
    facts = rows.agg(F.max(F.size("x")).alias("w"), F.max(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)).alias("m")).first()
    result = "query_id long, vec_id long, score long"
    if facts["w"] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, most = int(facts["w"]), float(np.sqrt(facts["m"]) + 1.0)
    centre = pivots(rows, n_pivots, width, most)

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = distances(lift(matrix(b["x"], width), most), centre)
            own = d.argmin(1)
            yield b.assign(pivot=own, d=d[np.arange(len(b)), own])[["vec_id", "x", "pivot", "d"]]

    index = stored(rows.mapInPandas(key, "vec_id long, x array<double>, pivot long, d double"), "index")
    index = ranked(index, ["pivot"], [F.col("d"), F.col("vec_id")])
    index = stored(index.withColumn("ring", F.floor((F.col("rank") - 1) / RING)).drop("rank"), "rings")
    rings = stored(index.groupBy("pivot", "ring").agg(F.min("d").alias("low"), F.max("d").alias("high")), "bounds")
    queries = rows.filter(is_query(F.col("vec_id"))).withColumnRenamed("vec_id", "query_id").dropDuplicates(["query_id"])

    def far(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = matrix(b["x"], width)
            d = distances(np.hstack([x, np.zeros((len(x), 1))]), centre)
            n = len(centre)
            yield pd.DataFrame({"query_id": np.repeat(b["query_id"].to_numpy(), n), "pivot": np.tile(np.arange(n), len(b)), "dq": d.ravel(), "norm": np.repeat((x * x).sum(1), n)})

    reach = stored(queries.mapInPandas(far, "query_id long, pivot long, dq double, norm double"), "reach")

    def visit(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        x, q, ids, asked = matrix(left["x"], width), matrix(right["q"], width), left["vec_id"].to_numpy(), right["query_id"].to_numpy()
        return pd.concat([best(asked[i : i + AT_ONCE], np.rint(q[i : i + AT_ONCE] @ x.T), ids, k) for i in range(0, len(q), AT_ONCE)])

    def expand(pairs: DataFrame) -> DataFrame:
        """The k best of each (query_id, pivot, ring)."""
        pairs = pairs.join(queries.select("query_id", F.col("x").alias("q")), "query_id").withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups)))
        keys = ["pivot", "ring", "group"]
        each = index.join(pairs.select(*keys).distinct(), ["pivot", "ring"])
        each = each.select(*(F.col(c).alias(f"i_{c}") for c in keys), "vec_id", "x")
        return each.groupBy(*(f"i_{c}" for c in keys)).cogroup(pairs.select(*keys, "query_id", "q").groupBy(*keys)).applyInPandas(visit, result)

    groups = max(1, -(-queries.count() // GROUP))
    first = Window.partitionBy("query_id").orderBy("dq", "pivot")
    nearest = reach.withColumn("n", F.row_number().over(first)).filter("n = 1")
    gap = F.greatest(F.col("low") - F.col("dq"), F.col("dq") - F.col("high"), F.lit(0.0))
    closest = Window.partitionBy("query_id").orderBy("gap", "ring")
    seeds = nearest.join(rings, "pivot").withColumn("gap", gap).withColumn("n", F.row_number().over(closest)).filter("n <= 2")
    seeds = stored(seeds.select("query_id", "pivot", "ring"), "seeds")
    early = stored(expand(seeds), "early")
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = early.withColumn("n", F.row_number().over(top)).filter(F.col("n") == k).select("query_id", "score")
    # |q - x|^2 = |q|^2 + most^2 - 2 q.x; a tie at the k-th score must still be visited, hence the margin
    bound = F.sqrt(F.greatest(F.lit(0.0), F.col("norm") + most * most - 2.0 * F.col("score"))) + 1e-3
    wide = reach.join(kth, "query_id", "left").withColumn("bound", F.when(F.col("score").isNull(), float("inf")).otherwise(bound))
    more = wide.join(rings, "pivot").filter(gap <= F.col("bound")).select("query_id", "pivot", "ring").join(seeds, ["query_id", "pivot", "ring"], "left_anti")
    late = expand(stored(more, "annuli"))
    every = early.unionByName(late).withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k)
    return every.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: F.pmod(i, F.lit(100)) == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
