"""Operator 8: the n-gram Jaccard join as a blocked sparse matrix product."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lodeweave.llm.batches import map_batches
from lodeweave.llm.components import components
from lodeweave.llm.ranking import ranked
from lodeweave.llm.shingles import mix, shingle_sets, texts_of
from lodeweave.session import stored

#: One in so many documents tells which shingles are frequent, and how many of those the order of columns uses.
SAMPLED, FREQUENT = 16, 200_000
#: Pairs and ids are broadcast up to this many rows, and else shuffled.
BROADCAST_ROWS = 1_000_000
#: Rounds of pivot rows at most, ended where blocks hold this many pairs a row or fewer; then all pairs that no link joins meet.
PIVOTS, PAIRS = 3, 2
#: A set's sketch counts its shingles in so many ranges of their hashes, a byte each.
RANGES = 256
#: Which of the ranges a set has once, and which twice, in longs that the product looks at before it makes a pair.
LEVELS = 2
BITS = [f"bits{i}" for i in range(LEVELS * RANGES // 64)]


def frequent_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """The shingles met most often in a sample of one document in SAMPLED, rarest first; at most FREQUENT.

    They only order the columns of the incidence matrix: any order finds the same links, and this one
    keeps passages that many documents share out of the blocks.
    """

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in texts_of(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(data, offsets, k)[0].view(np.int64))], names=["g"])

    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0).select("text")
    often = map_batches(some, sample, "g long").groupBy("g").count().filter("count >= 3")
    rows = often.orderBy(F.desc("count"), "g").limit(FREQUENT).collect()
    return np.array([r["g"] for r in reversed(rows)], dtype=np.int64).view(np.uint64)


def incidence(docs: DataFrame, k: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """doc_id, n (size of the set), key1 and key2 (the set's identity), prefix (the first columns of its row), sketch, bits.

    Two sets of n and m >= n shingles that link share one of their first n - ceil(percent n / 100) + 1
    columns in any common order of columns.
    """
    by_value = np.sort(frequent)
    place = np.argsort(frequent).astype(np.int64) if len(frequent) else np.zeros(0, np.int64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in texts_of(batch.column(1)):
                made, at = shingle_sets(data, offsets, k)
                n = np.diff(at)
                owner = np.repeat(np.arange(high - low), n)
                with np.errstate(over="ignore"):
                    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(made + np.uint64(s)))]) for s in (1, 2)]
                    keys = [(s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums]
                spread = np.bincount(owner * RANGES + (mix(made) % np.uint64(RANGES)).astype(np.int64), minlength=(high - low) * RANGES)
                sketch = np.minimum(spread, 255).astype(np.uint8).reshape(-1, RANGES)
                bits = np.hstack([np.packbits(sketch > k, axis=1).view(np.int64) for k in range(LEVELS)])
                rank = np.zeros(len(made), np.int64)  # 0: not frequent
                if len(by_value):
                    i = np.minimum(np.searchsorted(by_value, made), len(by_value) - 1)
                    rank = np.where(by_value[i] == made, place[i] + 1, 0)
                # ascending by value within a text already; frequent columns go last
                order = np.arange(len(made))
                if rank.any():
                    order = np.lexsort((made, rank, owner))
                first = n - -(-percent * n // 100) + 1
                keep = np.arange(len(made)) - at[owner] < first[owner]
                kept = made[order][keep]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.minimum(n, first))]).astype(np.int32)), pa.array(kept.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(n.astype(np.int64)), pa.array(keys[0]), pa.array(keys[1]), lists, pa.array([x.tobytes() for x in sketch], pa.binary()), *(pa.array(np.ascontiguousarray(b)) for b in bits.T)], names=["doc_id", "n", "key1", "key2", "prefix", "sketch", *BITS])

    return map_batches(docs.select("doc_id", "text"), rows, "doc_id long, n long, key1 long, key2 long, prefix array<long>, sketch binary, " + ", ".join(f"{b} long" for b in BITS))


def sets_of(rows: DataFrame, k: int, keys: str) -> DataFrame:
    """rows (keys, text) with the text's shingle set instead of it."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in texts_of(batch.column(batch.num_columns - 1)):
                got, at = shingle_sets(data, offsets, k)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(got.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(c.slice(low, high - low) for c in batch.columns[:-1]), lists], names=[*batch.schema.names[:-1], "grams"])

    return map_batches(rows, made, f"{keys}, grams array<long>")


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most BROADCAST_ROWS rows."""
    df = stored(df, "small")
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def least_overlap(n: Column, m: Column, percent: int) -> Column:
    return F.ceil(percent * (n + m) / F.lit(100 + percent))


def apart(a: str, b: str) -> Column:
    """Ranges that a's set has (once, twice) and b's has not: so many of its shingles at least are no shared ones."""
    own = [F.bit_count(F.col(f"{a}_bits")[x].bitwiseAND(F.bitwise_not(F.col(f"{b}_bits")[x]))) for x in BITS]
    return sum(own[1:], own[0])


def promising(pairs: DataFrame, percent: int, every: bool) -> DataFrame:
    """The distinct pairs (a, b) that met in a block, without those that sizes and places of shared columns rule out.

    Before a shared column at most the met columns (those that some other row has too) of the poorer
    beginning can be shared, from it on the columns of the smaller rest: this holds whichever of the pair's
    columns were counted. Where every column was (every), the count of those shared takes the place of the beginning.
    """
    counted = F.count(F.lit(1)) - 1 if every else F.least(F.max("a_met"), F.max("b_met"))
    total = pairs.groupBy("a", "b").agg(counted.alias("earlier"), F.max("a_at").alias("a_at"), F.max("b_at").alias("b_at"), F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"))
    most = F.col("earlier") + F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    return total.filter(most >= least_overlap(F.col("a_n"), F.col("b_n"), percent))


def bounded(sketches: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches allow a link.

    Two sets share in each range at most the smaller count, and at most the smaller of what the bytes
    could not count over all ranges; so no linked pair goes.
    """

    def counts(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, RANGES)

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = counts(batch.column(1)), counts(batch.column(4))
            n, m = (batch.column(i).to_numpy() for i in (2, 5))
            most = np.minimum(a, b).sum(1, dtype=np.int64) + np.minimum(n - a.sum(1, dtype=np.int64), m - b.sum(1, dtype=np.int64))
            keep = pa.array(most * (100 + percent) >= percent * (n + m))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3)], names=["a", "b"]).filter(keep)

    rows = sketches.select("doc_id", "sketch", "n")
    left = rows.join(small(pairs.select(F.col("a").alias("doc_id")).distinct()), "doc_id")
    left = left.select(F.col("doc_id").alias("a"), F.col("sketch").alias("a_sketch"), F.col("n").alias("a_n"))
    right = rows.join(small(pairs.select(F.col("b").alias("doc_id"), "a")), "doc_id").select("a", F.col("doc_id").alias("b"), "sketch", "n")
    return map_batches(left.join(right, "a"), allowed, "a long, b long")


def verified(docs: DataFrame, sketches: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link. Sets move once to the first of their pair, from a map-side lookup."""
    pairs = stored(pairs.select("a", "b").distinct(), "pairs")
    pairs = stored(bounded(sketches, pairs, percent).distinct(), "bounded")
    text = docs.select("doc_id", "text")
    side_a = text.join(small(pairs.select(F.col("a").alias("doc_id")).distinct()), "doc_id")
    side_b = text.join(small(pairs.select(F.col("b").alias("doc_id"), "a")), "doc_id")
    left = sets_of(side_a.select("doc_id", "text"), k, "a long")
    right = sets_of(side_b.select("a", "doc_id", "text"), k, "a long, b long")
    joined = left.withColumnRenamed("grams", "a_grams").join(right, "a")
    common = F.size(F.array_intersect("a_grams", "grams"))
    return joined.filter(common >= least_overlap(F.size("a_grams"), F.size("grams"), percent)).select("a", "b")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: documents linked where 100 * intersection >= percent * union of their shingle sets.

    Documents with equal sets form a class, whose smallest doc_id stands for it. The product of the
    incidence matrix with its transpose is taken over blocks of columns, a class's first columns being
    enough for every link. In each block a pivot row is multiplied with the others first, that of the document
    whose columns are the most shared, so that a group of thousands of copies costs a few pairs per copy,
    and only pairs that no link joins yet are multiplied after; nothing caps the partners. Pairs are bounded by their sizes, by the places of the columns they
    share (and the number of these, once no pivot has taken some out) and by counts over ranges of hashes, and whole sets verify what is left.

    Null and empty texts have n_shingles 0 and are linked with nothing, rows without a doc_id stand for
    themselves with their class's component (null if all its ids are), rows that repeat a doc_id are one
    document: rows of one id and different texts link what each of them links. Ids that are no whole numbers are numbered
    in their order and come back as they were. An empty table gives an empty result; other columns are not looked at.
    """
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        ids = docs.select("doc_id").filter("doc_id is not null").distinct().withColumn("one", F.lit(0))
        ids = stored(ranked(stored(ids, "ids"), ["one"], [F.col("doc_id")]).select("doc_id", F.col("rank").cast("long").alias("no")), "numbers")
        found = jaccard_components(docs.select("doc_id", "text").join(small(ids), "doc_id", "left").select(F.col("no").alias("doc_id"), "text"), k, percent)
        first = ids.select(F.col("doc_id").alias("component"), F.col("no").alias("component_id"))
        found = found.withColumnRenamed("doc_id", "no").join(ids, "no", "left").join(first, "component_id", "left")
        return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = stored(incidence(docs, k, percent, frequent_shingles(docs, k)), "incidence")
    identity = ["n", "key1", "key2"]
    classes = stored(table.filter("n > 0").groupBy(*identity).agg(F.min("doc_id").alias("rep")), "classes")
    rows = table.select("doc_id", *identity, "prefix", *BITS).join(classes.filter("rep is not null").withColumnRenamed("rep", "doc_id"), ["doc_id", *identity], "left_semi").dropDuplicates(["doc_id", *identity])
    kinds = stored(rows.select("doc_id", "n", F.struct(*BITS).alias("bits"), "prefix"), "rows")
    cells = kinds.select("doc_id", F.posexplode("prefix").alias("at", "g"))
    cells = stored(cells, "cells")
    blocks = cells.groupBy("g").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    # a row's cells in columns that another row has too, at most its prefix: how many come before each, and how much they are shared
    shared = cells.join(blocks, "g").groupBy("doc_id").agg(F.sum("rows").alias("central"), F.array_sort(F.collect_list(F.struct("at", "g"))).alias("c"))
    shared = shared.join(kinds.select("doc_id", "n", "bits"), "doc_id")
    cells = shared.select("doc_id", "n", "bits", "central", F.posexplode("c").alias("met", "c")).select("doc_id", "n", "bits", "central", "met", "c.at", "c.g")
    cells = stored(cells, "blocks")
    links, labels, pivots = None, None, 0
    while True:
        marked = cells.withColumn("label", F.col("doc_id")) if labels is None else cells.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
        # blocks in which rows of several components meet
        mixed = marked.groupBy("g").agg(F.count(F.lit(1)).alias("rows"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
        marked = stored(marked.join(mixed.select("g", "rows"), "g"), "mixed")
        most, among = marked.agg(F.sum(F.col("rows") - 1) / 2, F.count(F.lit(1))).first()
        last = pivots == PIVOTS or not among or most <= PAIRS * among
        other = marked.select("g", "central", F.col("doc_id").alias("a"), F.col("n").alias("a_n"), F.col("bits").alias("a_bits"), F.col("at").alias("a_at"), F.col("met").alias("a_met"), F.col("label").alias("a_label"))
        if not last:
            lead = F.max(F.struct("central", F.xxhash64("a").alias("p"), "a", "a_n", "a_bits", "a_at", "a_met", "a_label"))
            other = other.groupBy("g").agg(lead.alias("f")).select("g", "f.*").drop("p")
        pairs = marked.select("g", F.col("doc_id").alias("b"), F.col("n").alias("b_n"), F.col("bits").alias("b_bits"), F.col("at").alias("b_at"), F.col("met").alias("b_met"), "label").join(other.drop("central"), "g")
        pairs = pairs.filter("a < b" if last else "a <> b").filter(F.col("a_label") != F.col("label"))
        pairs = pairs.filter((100 * F.least("a_n", "b_n")) >= percent * F.greatest("a_n", "b_n"))
        most = F.least("a_met", "b_met") + F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
        pairs = pairs.filter(most >= least_overlap(F.col("a_n"), F.col("b_n"), percent))
        pairs = pairs.filter(F.greatest(apart("a", "b") - F.col("a_n"), apart("b", "a") - F.col("b_n")) <= -least_overlap(F.col("a_n"), F.col("b_n"), percent)).drop("a_bits", "b_bits")
        # a pair whose columns pivots led in part was verified with them, so the last round counts every column of those still open
        new = stored(verified(docs, table, promising(pairs, percent, last), k, percent), "links")
        links = new if links is None else stored(links.union(new), "links")
        labels = components(links)
        if last:
            break
        # a pivot has met every row of its block
        done = other.select("g", F.col("a").alias("doc_id"))
        cells = stored(marked.drop("rows", "label").join(done, ["g", "doc_id"], "left_anti"), "central")
        pivots += 1
    found = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(*identity, F.coalesce("label", "rep").alias("label"))
    out = table.drop("prefix", "sketch", *BITS).join(found, identity, "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("label"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=85)


def without_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without near duplicates: of each group the document of smallest id stays.

    Rows without a doc_id stay; of rows that repeat a doc_id one stays.
    """
    groups = stored(jaccard_components(docs, k, percent), "groups")
    gone = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
    kept = docs.join(small(gone.distinct()), F.col("doc_id") == F.col("_gone"), "left_anti")
    if groups.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return kept
    return kept.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.filter("doc_id is null"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * common >= 85 * (x.n + y.n - common)),
r AS (SELECT DISTINCT a AS doc_id, a AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT doc_id, min(other) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""
