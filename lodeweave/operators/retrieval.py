"""Second-stage retrieval over ranked lists: feedback expansion, metadata and time signals, link walks, parents, reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions import text as T
from lodeweave.operators import ranking as R

LINK_DECAY, RRF_K = 0.4, 60


def expansion(terms: DataFrame, top: DataFrame, post: DataFrame, fb_terms: int = 20, original: float = 0.5) -> DataFrame:
    """The relevance model RM3 of each query: (item_id, term, weight), weights of a query adding up to 1.

    terms are the queries' own (item_id, term, qtf), top their pseudo-relevant documents (item_id, doc_id, score),
    post all postings of these. A term weighs original times its share of the query, plus the rest times its
    share of the fb_terms best terms by sum of score share * tf / dl.
    """
    of_query = Window.partitionBy("item_id")
    share = top.withColumn("w", F.greatest("score", F.lit(0.0)) / F.nullif(F.sum(F.greatest("score", F.lit(0.0))).over(of_query), F.lit(0.0)))
    model = post.join(share.select("item_id", "doc_id", "w"), "doc_id").groupBy("item_id", "term").agg(F.sum(F.col("w") * F.col("tf") / F.col("dl")).alias("rel"))
    best = R.top(model.withColumn("score", F.round("rel", 12)), fb_terms, "item_id", "term").withColumn("rel", F.col("rel") / F.sum("rel").over(of_query))
    own = terms.withColumn("own", F.col("qtf") / F.sum("qtf").over(of_query)).select("item_id", "term", "own")
    weight = original * F.coalesce("own", F.lit(0.0)) + (1 - original) * F.coalesce("rel", F.lit(0.0))
    return own.join(best.select("item_id", "term", "rel"), ["item_id", "term"], "full").select("item_id", "term", weight.alias("weight")).filter("weight > 0")


def weighted(model: DataFrame, post: DataFrame, vocab: DataFrame) -> DataFrame:
    """(item_id, doc_id, score): BM25 contributions of a model's terms by their weights."""
    own = model.join(vocab.select("term", "idf", "avgdl"), "term")
    return post.join(own, "term").groupBy("item_id", "doc_id").agg(F.round(F.sum(F.col("weight") * R.contribution()), 6).alias("score"))


def structural(query: Column, meta: Column) -> Column:
    """How well a document's front matter meets what a query names: 1 for its date, the share of its tags, 1 for its kind; 0 where nothing is named."""
    low, high = T.date_range(query)
    day = F.substring(F.coalesce(meta["date"], F.lit("")), 1, 10)
    date = F.when(low.isNotNull() & (day != "") & (day >= low) & (day <= high), 1.0).otherwise(0.0)
    kind = F.lower(F.coalesce(meta["type"], meta["category"], F.lit("")))
    asked = T.query_type(query)
    same = F.when((kind != "") & (F.contains(kind, asked) | F.contains(asked, kind)), 1.0).otherwise(0.0)
    return date + T.tag_overlap(meta["tags"], T.query_tags(query)) + F.coalesce(same, F.lit(0.0))


def recency(pool: DataFrame, date: str = "date", by: str = "item_id", key: str = "doc_id") -> DataFrame:
    """(by, key, score): dated documents of each pool by day, the newest 1, then evenly down; ties to the smaller key."""
    dated = pool.withColumn("_day", F.substring(date, 1, 10)).filter("_day <> ''")
    newest = Window.partitionBy(by).orderBy(F.desc("_day"), key)
    place = F.row_number().over(newest) - 1
    return dated.select(by, key, (1.0 - place / F.count(F.lit(1)).over(Window.partitionBy(by))).alias("score"))


def resolved(links: DataFrame, docs: DataFrame) -> DataFrame:
    """links (source, link) with the documents (target) that they name by path or file name, case and ".md" ignored; each pair once."""
    bare = lambda c: F.regexp_replace(F.translate(F.lower(F.trim(c)), "\\", "/"), r"\.md$", "")
    paths = docs.select(F.col("doc_path").alias("target"), bare(F.col("doc_path")).alias("p"))
    names = paths.select("target", F.explode(F.array_distinct(F.array("p", F.substring_index("p", "/", -1)))).alias("key"))
    return links.withColumn("key", bare(F.col("link"))).join(names, "key").select("source", "target").distinct()


def walked(seeds: DataFrame, edges: DataFrame, depth: int = 2, by: str = "item_id") -> DataFrame:
    """(by, doc_path, score, hop): documents within depth links of a query's seeds (by, doc_path, score), each at its first hop.

    A document gets the best score among the ones of the hop before that link to it, times LINK_DECAY^hop.
    """
    seen = seeds.select(by, "doc_path", "score", F.lit(0).alias("hop"))
    for hop in range(1, depth + 1):
        last = seen.filter(F.col("hop") == hop - 1)
        new = last.join(edges.withColumnRenamed("source", "doc_path"), "doc_path").groupBy(by, F.col("target").alias("doc_path")).agg((F.max("score") * LINK_DECAY**hop).alias("score"))
        new = new.join(seen.select(by, "doc_path"), [by, "doc_path"], "left_anti")
        seen = seen.unionByName(new.withColumn("hop", F.lit(hop)))
    return seen.filter("hop > 0")


def time_boost(pool: DataFrame, inside: Column, by: str = "item_id", key: str = "doc_id") -> DataFrame:
    """pool (by, key, rank) fused with its documents inside a query's time windows, by reciprocal ranks; a query without such documents keeps its order."""
    within = Window.partitionBy(by, "_in").orderBy("rank")
    rows = pool.withColumn("_in", F.coalesce(inside, F.lit(False))).withColumn("_place", F.row_number().over(within))
    score = 1.0 / (RRF_K + F.col("rank")) + F.when(F.col("_in"), 1.0 / (RRF_K + F.col("_place"))).otherwise(0.0)
    rows = rows.withColumn("score", F.round(score, 9))
    order = Window.partitionBy(by).orderBy(F.desc("score"), "rank")
    return rows.withColumn("rank", F.row_number().over(order)).drop("_in", "_place")


def parents(chunks: DataFrame, by: str = "item_id", parent: str = "doc_id", child: str = "chunk_id") -> DataFrame:
    """Ranked chunks (by, parent, child, score, rank) grouped under their parents: best score and rank, and the children in order."""
    grouped = chunks.groupBy(by, parent).agg(F.max("score").alias("score"), F.min("rank").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", child))), lambda x: x[child]), ",").alias("children"))
    return grouped.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("first"))).drop("first")


def boosted(score: Column, title: Column, entity: Column, freshness: Column, feedback: Column) -> Column:
    """A score raised by the share of query terms in the title, of entities with facts, by freshness, and by feedback (+0.25 or -0.40)."""
    return F.round(score * (1.0 + 0.30 * title + 0.20 * entity + 0.10 * freshness + feedback), 6)


def overlap(query_terms: Column, title_terms: Column) -> Column:
    """Share of the distinct query terms that a title holds."""
    asked = F.array_distinct(query_terms)
    return F.size(F.array_intersect(asked, title_terms)) / F.greatest(F.size(asked), F.lit(1))
