"""Chunks, postings and vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.functions import text as T
from lodeweave.session import stored


def postings(docs: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(term, key, tf, dl): one row a term and document; documents without a term have none."""
    dealt = docs.select(key, body).repartition(key)  # texts move once, and their words are counted where they are
    each = dealt.select(key, T.tokens(F.col(body)).alias("t")).select(key, F.size("t").alias("dl"), F.explode("t").alias("term"))
    return each.groupBy("term", key, "dl").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(docs: DataFrame, body: str = "text") -> DataFrame:
    """n documents with a term and their mean length: one row."""
    size = docs.select(F.size(T.tokens(F.col(body))).alias("dl")).filter("dl > 0")
    return size.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def vocabulary(post: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, cf, idf), idf at least 1e-6."""
    idf = F.greatest(F.ln((F.col("n_docs") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5))), F.lit(1e-6))
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).crossJoin(F.broadcast(stats)).withColumn("idf", idf)


def chunks(docs: DataFrame, size: int = 400, overlap: int = 50) -> DataFrame:
    """Word windows of documents with their ids."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    each = docs.select("doc_id", F.explode(T.windows(words, size, overlap)).alias("c")).select("doc_id", "c.*")
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    return each.filter(F.length("content") >= 10).withColumn("chunk_id", T.short_hash(path, F.lit(""), F.col("start").cast("string")))


#: Distinct terms of a batch of queries are broadcast up to this many.
TERMS = 200_000


def matched(docs: DataFrame, terms: DataFrame, key: str = "doc_id", body: str = "text") -> tuple[DataFrame, DataFrame]:
    """What a batch of queries needs of docs, from one pass: postings (term, key, tf, dl) of its terms alone, and their vocabulary (term, df, idf, avgdl).

    Tokens of other terms are counted where they are and never shuffled one by one, so what moves is one row
    a document and one for each of its terms that is asked for.
    """
    asked = stored(terms.select("term").distinct().withColumn("asked", F.lit(True)), "terms")
    asked = F.broadcast(asked) if asked.count() <= TERMS else asked
    each = docs.select(key, T.tokens(F.col(body)).alias("t")).select(key, F.size("t").alias("dl"), F.explode("t").alias("term"))
    found = each.join(asked, "term", "left").groupBy(key, "dl", F.when(F.col("asked"), F.col("term")).alias("term")).agg(F.count(F.lit(1)).alias("tf"))
    found = stored(found, "matched")
    stats = found.groupBy(key, "dl").agg(F.lit(1)).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    post = found.filter("term is not null").select("term", key, "dl", "tf")
    return post, vocabulary(post, stats)
