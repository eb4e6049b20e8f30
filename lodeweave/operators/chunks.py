"""Passages of Markdown documents that follow their sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions import markdown as M
from lodeweave.functions import text as T


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def checked(size: int, overlap: int) -> None:
    """Refuses windows that hold nothing or would never move on."""
    if size < 1 or overlap < 0 or overlap >= size:
        raise ValueError(f"windows of {size} words cannot overlap by {overlap}")


def of_documents(docs: DataFrame, size: int = 400, overlap: int = 50, heading_context: bool = False) -> DataFrame:
    """(doc_path, ordinal, section_id, heading, start, content, chunk_id) of documents (doc_path, body).

    A section of at most size words is one passage, a longer one windows; with heading_context each begins with
    the headings above it. Passages under 10 characters are left out. Of equal ids in a document the last
    one stays. A null or empty body has none.
    """
    checked(size, overlap)
    each = docs.select("doc_path", F.posexplode(M.sections(F.coalesce("body", F.lit("")))).alias("ordinal", "s")).select("doc_path", "ordinal", "s.*")
    text = F.col("content") if heading_context else F.col("whole")
    each = each.withColumn("w", _words(text))
    windows = T.windows(F.col("w"), size, overlap)
    whole = F.array(F.struct(F.lit(0).alias("start"), text.alias("content")))
    one = F.when((F.col("heading") != "") & (F.size("w") <= size) & F.lit(not heading_context), whole).otherwise(windows)
    each = each.withColumn("n", F.size(one)).select("doc_path", "ordinal", "heading", "path", "w", "n", F.explode(one).alias("c"))
    prefix = F.array_join("path", " > ")
    content = F.when(F.lit(heading_context) & (prefix != ""), F.concat(prefix, F.lit("\n\n"), F.col("c.content"))).otherwise(F.col("c.content"))
    single = (F.col("heading") != "") & F.when(F.lit(heading_context), F.col("n") == 1).otherwise(F.size("w") <= size)
    key = F.when(single, T.short_hash(F.col("doc_path"), F.lit("section"), F.col("heading"))).otherwise(T.short_hash(F.col("doc_path"), F.col("heading"), F.col("c.start").cast("string")))
    rows = each.select("doc_path", "ordinal", T.short_hash(F.col("doc_path"), F.lit("parent"), F.col("ordinal").cast("string")).alias("section_id"), "heading", F.col("c.start").alias("start"), content.alias("content"), key.alias("chunk_id"))
    last = Window.partitionBy("doc_path", "chunk_id").orderBy(F.desc("ordinal"), F.desc("start"))
    return rows.filter(F.char_length(M.stripped(F.col("content"))) >= 10).withColumn("_i", F.row_number().over(last)).filter("_i = 1").drop("_i")


def joined(chunks: DataFrame, by: str = "doc_path") -> DataFrame:
    """(by, text): word windows (by, start, content) of each document in order, words that an earlier one held dropped."""
    pieces = F.array_sort(F.collect_list(F.struct("start", _words(F.col("content")).alias("w"))))
    begin = F.array().cast("array<string>")
    merge = lambda have, p: F.concat(have, F.slice(p["w"], F.greatest(F.lit(0), F.size(have) - p["start"]) + 1, F.size(p["w"]) + 1))
    return chunks.groupBy(by).agg(pieces.alias("p")).select(by, F.array_join(F.aggregate("p", begin, merge), " ").alias("text"))
