"""Operator 5: document fingerprints by consistent weighted sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm.ranking import ranked
from lodeweave.session import dropped, stored

SAMPLES = 32
_TERM = r"[\x20\x09-\x0D]+"


def _uniform(h: Column, k: int) -> Column:
    """The k-th of a hash's three runs of 21 bits as a number in (0, 1)."""
    return (F.shiftrightunsigned(h, 21 * k).bitwiseAND(F.lit(0x1FFFFF)).cast("double") + 0.5) / 2097152.0


def sample(term: Column, i: int) -> tuple[Column, Column, Column]:
    """ln c, r and b of the i-th consistent weighted sample of a term.

    r and c are Gamma(2, 1) and b is uniform, all hashed from the term and i.
    """
    h1, h2 = (F.xxhash64(term, F.lit(2 * i + j)) for j in range(2))
    return F.ln(-F.ln(_uniform(h2, 0) * _uniform(h2, 1))), -F.ln(_uniform(h1, 0) * _uniform(h1, 1)), _uniform(h1, 2)


def weighed(drawn: tuple[Column, Column, Column], weight: Column) -> Column:
    """ln a of a term of this weight: t = floor(ln w / r + b), ln a = ln c - r (t - b + 1); null without it.

    The term with the least a is the sample, and because a is a continuous function of term and t alone,
    two texts share the sample exactly when their least a agree. That happens with the probability of
    their generalised Jaccard similarity.
    """
    ln_c, r, b = drawn
    t = F.when(weight == 1, 0.0).otherwise(F.floor(F.ln(weight.cast("double")) / r + b).cast("double"))
    return F.when(weight > 0, ln_c - r * (t - b + 1.0))


def terms(text: Column) -> Column:
    """The weighted terms' occurrences: each word with the word before it, as 64-bit hashes."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), _TERM), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    before = F.concat(F.array(F.lit(0).cast("long")), hashed)
    return F.zip_with(hashed, F.slice(before, 1, F.size(hashed)), lambda w, p: F.xxhash64(p, w))


def signatures(texts: DataFrame, keys: list[str], kinds: int, samples: int = SAMPLES, carried: list[str] = ()) -> DataFrame:
    """texts (keys, kind, text, carried numbers) to keys, carried and signature0, signature1, ...: samples doubles for each kind of text of a row.

    Terms weigh as often as they occur; one draw serves all kinds of a row. When texts is already dealt by
    some of the keys, neither aggregation moves a row. A kind without a term has no signature. Of a carried
    number the largest among a row's kinds stays.
    """
    each = texts.select(*keys, "kind", *carried, F.explode_outer(terms(F.col("text"))).alias("term"))
    counts = each.groupBy(*keys, "term").agg(*(F.count_if((F.col("kind") == j) & F.col("term").isNotNull()).alias(f"w{j}") for j in range(kinds)), *(F.max(c).alias(c) for c in carried))
    least = []
    for i in range(samples):
        drawn = sample(F.col("term"), i)
        least += [F.min(weighed(drawn, F.col(f"w{j}"))).alias(f"s{j}_{i}") for j in range(kinds)]
    made = counts.groupBy(*keys).agg(*least, *(F.max(c).alias(c) for c in carried))
    return made.select(*keys, *carried, *(F.when(F.col(f"s{j}_0").isNotNull(), F.array(*(f"s{j}_{i}" for i in range(samples)))).alias(f"signature{j}") for j in range(kinds)))


def as_string(signature: Column) -> Column:
    """Four hexadecimal digits a sample; a text without terms has none."""
    code = F.transform(signature, lambda a: F.lower(F.lpad(F.hex(F.pmod(F.xxhash64(a), F.lit(65536))), 4, "0")))
    return F.coalesce(F.array_join(code, ""), F.lit(""))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of samples on which two fingerprints agree: 1 for two empty ones, 0 for one."""
    at = F.sequence(F.lit(1), F.lit(4 * samples), F.lit(4))
    same = F.aggregate(at, F.lit(0), lambda n, i: n + F.when(F.substr(a, i, F.lit(4)) == F.substr(b, i, F.lit(4)), 1).otherwise(0))
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(same / F.lit(float(samples)))


_KEY, _NEXT = ["k1", "k2"], ["next1", "next2"]


def followed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as one row of numbers each: doc_id, n_chars, k1 and k2 (the row's identity), next1 and next2 (the next row's), last (whether a different row follows).

    The order is by descending doc_id, null ids last, and the first follows the last. Rows that repeat a
    doc_id follow each other by hash; equal rows have one identity. Texts do not move.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.char_length(text).cast("long").alias("n_chars"), F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(text, F.lit(1), "doc_id").alias("k2"), F.lit(0).alias("all"))
    rows = stored(rows, "rows")
    placed = stored(ranked(rows, ["all"], [F.col("doc_id").desc_nulls_last(), F.col("k1"), F.col("k2")]), "order")
    dropped(rows)
    n = placed.count()
    nexts = placed.select(F.when(F.col("rank") == 1, n).otherwise(F.col("rank") - 1).alias("rank"), F.col("k1").alias("next1"), F.col("k2").alias("next2"))
    other = (F.col("k1") != F.col("next1")) | (F.col("k2") != F.col("next2"))
    out = stored(placed.join(nexts, "rank").select("doc_id", "n_chars", *_KEY, *_NEXT, other.alias("last")), "followed")
    dropped(placed)
    return out


def edited(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """Each different pair of a row and the next: k1, k2, last, text and edited, the row's text with its second half replaced.

    Texts move once, to their identity, as do those beginnings of next texts that are asked for, to the
    identity of the row that asks; no row waits for a whole next text.
    """
    text = F.coalesce("text", F.lit(""))
    whole = docs.select(F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(text, F.lit(1), "doc_id").alias("k2"), text.alias("text"))
    # a fixed number of parts: by bytes they would be few, for the work that each byte takes
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = whole.repartition(parts, *_KEY).groupBy(*_KEY).agg(F.any_value("text").alias("text"))  # equal rows are worked on once
    asked = edges.groupBy(*_KEY, *_NEXT, "last").agg(F.floor(F.any_value("n_chars") / 2).cast("int").alias("half"))
    asked = asked.select(F.col("k1").alias("from1"), F.col("k2").alias("from2"), F.col("next1").alias("k1"), F.col("next2").alias("k2"), "last", "half")
    heads = whole.join(asked, _KEY).select(F.col("from1").alias("k1"), F.col("from2").alias("k2"), "last", "half", F.substr("text", F.lit(1), F.col("half")).alias("head"))
    both = whole.join(heads.hint("merge"), _KEY)  # texts are never broadcast, whatever their estimate
    kept = F.substr("text", F.lit(1), F.char_length("text") - F.col("half"))
    return both.select(*_KEY, "last", "text", F.concat(kept, "head").alias("edited"))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each text and its edited text: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by as many of the next document's
    first, or all of them. Words, weights and samples are made and aggregated where a text has moved to,
    and its digest is carried along as four numbers. A null text counts as empty, an empty text has the
    fingerprint "" and is like an empty one only. A single document follows itself. Rows that repeat a
    doc_id each give a row. An empty table gives an empty result; other columns are not looked at.
    """
    docs = docs.select("doc_id", "text")
    edges = followed(docs)
    digest = [f"d{i}" for i in range(4)]
    sha = F.sha2(F.encode("edited", "UTF-8"), 256)
    rows = edited(docs, edges).select(*_KEY, "last", "text", "edited", sha.alias("sha"))
    none = [F.lit(None).cast("long").alias(d) for d in digest]
    parts = [F.conv(F.substring("sha", 16 * i + 1, 16), 16, -10).cast("long").alias(d) for i, d in enumerate(digest)]
    kinds = F.array(F.struct(F.lit(0).alias("kind"), "text", *none), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text"), *parts))
    both = rows.select(*_KEY, "last", F.explode(kinds).alias("t")).select(*_KEY, "last", "t.*")
    made = signatures(both, [*_KEY, "last"], 2, samples, digest)
    sha = F.lower(F.concat(*(F.lpad(F.hex(d), 16, "0") for d in digest)))
    own = stored(made.select(*_KEY, "last", sha.alias("edited_sha256"), as_string(F.col("signature0")).alias("p"), as_string(F.col("signature1")).alias("e")), "signatures")
    nexts = own.groupBy(F.col("k1").alias("next1"), F.col("k2").alias("next2")).agg(F.any_value("p").alias("q"))
    out = edges.join(own, [*_KEY, "last"]).join(nexts, _NEXT)
    return out.select("doc_id", "n_chars", "edited_sha256", F.col("p").alias("fingerprint"), F.col("e").alias("edited_fingerprint"), likeness(F.col("p"), F.col("e"), samples).alias("near_edited"), likeness(F.col("p"), F.col("q"), samples).alias("near_next"))


def op5_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
