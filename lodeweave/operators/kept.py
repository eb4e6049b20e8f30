"""Postings that stay: the passages of a table under an analyzer, in blocks that a search can skip.

Below the index's folder lie `passages` (one row each, numbered in order, in folders of SPAN numbers), `postings` (a row for a
term and a block of BLOCK passages, in folders by a hash of the term, sorted by term and block) and `meta`, which is written
last and makes the index valid. Readers of some terms open the folders of these terms alone, and what a search needs
first, the largest contribution of a block, are columns apart from the lists themselves.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from lodeweave.functions import stem as P
from lodeweave.functions import text as T
from lodeweave.operators import ranking as R
from lodeweave.session import dropped, is_stored, stored

ANALYZERS = ("plain", "porter", "porter+english")
DEFAULT = "porter+english"
#: Passages of a block, folders of terms, and passages of a folder of passages.
BLOCK, BUCKETS, SPAN = 128, 64, 65_536
#: Passages of a task that makes lists, and blocks of a term that are written together.
DEAL, GROUP = 4_096, 2_048
#: Blocks that a search scores first, and blocks of an index from which on it looks at bounds at all.
PROBE, MANY = 8, 512
#: Rows of asked terms, and of blocks or passages that a search keeps to, that are broadcast: each holds a term or two numbers.
SMALL = 200_000
META = "analyzer string, n long, n_docs long, avgdl double, n_terms long, kind string"
#: More than what scores rounded to six digits can lose.
_SLACK = 2e-6


def few(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df, a stored table, to be broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= most else df


def checked(analyzer: str) -> str:
    if analyzer not in ANALYZERS:
        raise ValueError(f"unknown analyzer {analyzer!r}; one of {', '.join(ANALYZERS)}")
    return analyzer


def counted(rows: DataFrame, keys: list[str], body: str, analyzer: str) -> DataFrame:
    """(term, *keys, dl, tf) of texts under an analyzer; dl counts a text's tokens. Texts without a token have no row."""
    each = rows.select(*keys, T.tokens(F.col(body), english=checked(analyzer) == "porter+english").alias("t")).select(*keys, F.size("t").alias("dl"), F.explode("t").alias("term"))
    found = each.groupBy("term", *keys, "dl").agg(F.count(F.lit(1)).alias("tf"))
    if analyzer == "plain":
        return found
    return P.stemmed(found).groupBy("term", *keys, "dl").agg(F.sum("tf").alias("tf"))


def query_terms(queries: DataFrame, analyzer: str, key: str = "item_id", body: str = "text") -> DataFrame:
    """(key, term, qtf): a term that a query repeats counts so often."""
    return counted(queries, [key], body, analyzer).select(key, "term", F.col("tf").alias("qtf"))


def dealt(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows as a stored table in the given order, which names each row, with _at: the place in its part, below the part's number."""
    return stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "dealt")


def numbered(table: DataFrame) -> DataFrame:
    """A dealt table with pid, from 0 in its order: the rows of the parts before, of which there is a number each, are added; no row moves."""
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND(2**33 - 1)
    sizes = table.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return table.withColumn("_part", part).join(F.broadcast(sizes), "_part").withColumn("pid", (F.col("_before") + at).cast("long")).drop("_part", "_before", "_at")


def tasks_of(spark: SparkSession, n: int) -> int:
    """Tasks for work by blocks over n passages: each holds about DEAL of them, however many there are."""
    return max(-(-n // DEAL), min(spark.sparkContext.defaultParallelism, -(-n // BLOCK)), 1)


def impact(tf: Column, dl: Column, avgdl: float, k1: float, b: float) -> Column:
    """What a posting adds to a score, but for idf."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def marked(pids: DataFrame) -> DataFrame:
    """(block, low, high): which passages of a block are among pids (pid), a bit each. A row for a block, however many passages or queries name it."""
    at = (F.col("pid") % BLOCK).cast("int")
    bit = lambda first: F.bit_or(F.when((at >= first) & (at < first + 64), F.call_function("shiftleft", F.lit(1).cast("long"), at - first)).otherwise(0))
    return pids.groupBy(F.floor(F.col("pid") / BLOCK).alias("block")).agg(bit(0).alias("low"), bit(64).alias("high"))


def among(lists: DataFrame, marks: DataFrame) -> DataFrame:
    """lists (term, block, p) with the postings of marked passages alone: they are told where the lists lie, before anything is joined to them."""
    told = lambda x: F.getbit(F.when(x["at"] < 64, F.col("low")).otherwise(F.col("high")), x["at"] % 64) == 1
    own = lists.join(marks, "block").withColumn("p", F.filter("p", told))
    return own.filter(F.size("p") > 0).drop("low", "high")


class Index:
    """A kept index below a folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        meta = spark.read.schema(META).parquet(f"{self.root}/meta").first()
        self.analyzer, self.n, self.n_docs, self.avgdl, self.n_terms, kind = meta
        self._kind = StructType.fromJson(json.loads(kind))

    @classmethod
    def opened(cls, spark: SparkSession, root: str) -> Index | None:
        """The index below root if a whole one is there."""
        try:
            return cls(spark, root)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    @classmethod
    def build(cls, passages: DataFrame, root: str, order: list[str], body: str = "content", analyzer: str = DEFAULT) -> Index:
        """Indexes passages, whose columns stay with them; order names each row, and of equal scores the first in order wins.

        A null body counts as empty. What an earlier run that died has left below root is written over.
        """
        checked(analyzer)
        root, spark = root.rstrip("/"), passages.sparkSession
        table = dealt(passages, order)
        own = numbered(table).withColumn("n_tokens", F.size(T.tokens(F.col(body), english=analyzer == "porter+english")))
        own = own.withColumn("span", F.floor(F.col("pid") / SPAN).cast("int"))
        own.sortWithinPartitions("span", "pid").write.mode("overwrite").partitionBy("span").parquet(f"{root}/passages")
        dropped(table)
        kept = spark.read.schema(own.schema).parquet(f"{root}/passages")
        n, n_docs, avgdl = kept.agg(F.count(F.lit(1)), F.count(F.when(F.col("n_tokens") > 0, 1)), F.avg(F.when(F.col("n_tokens") > 0, F.col("n_tokens")))).first()
        block = F.floor(F.col("pid") / BLOCK)
        # whole blocks meet in a task, so that words are counted and lists made where they are
        texts = kept.select("pid", body, block.alias("block")).repartition(tasks_of(spark, n), "block")
        packed = F.shiftleft(F.col("pid") % BLOCK, 56) + F.shiftleft(F.col("tf").cast("long"), 28) + F.col("dl")  # a number a posting while it moves
        one = counted(texts, ["pid", "block"], body, analyzer).select("term", "block", packed.alias("p"))
        lists = one.groupBy("term", "block").agg(F.array_sort(F.collect_list("p")).alias("p"))  # at most BLOCK postings
        lists = lists.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
        # a term in every passage is shared by many tasks
        lists = lists.repartition("bucket", F.floor(F.col("block") / GROUP)).sortWithinPartitions("bucket", "term", "block")
        low = 2**28 - 1
        lists = lists.withColumn("p", F.transform("p", lambda x: F.struct(F.shiftright(x, 56).cast("int").alias("at"), F.shiftright(x, 28).bitwiseAND(low).cast("int").alias("tf"), x.bitwiseAND(low).cast("int").alias("dl"))))
        each = lambda f: F.transform("p", f)
        lists = lists.select(
            "bucket",
            "term",
            "block",
            F.size("p").alias("n"),
            F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x["tf"]).alias("cf"),
            F.array_max(each(lambda x: impact(x["tf"].cast("double"), x["dl"], avgdl or 1.0, R.K1, R.B))).alias("most"),
            F.array_max(each(lambda x: x["tf"])).alias("top_tf"),
            F.array_min(each(lambda x: x["dl"])).alias("least_dl"),
            "p",
        )
        lists.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/postings")
        n_terms = spark.read.parquet(f"{root}/postings").select("term").distinct().count() if n_docs else 0
        spark.createDataFrame([(analyzer, n, n_docs, avgdl or 0.0, n_terms, own.schema.json())], META).coalesce(1).write.mode("overwrite").parquet(f"{root}/meta")
        return cls(spark, root)

    def reindexed(self, root: str, analyzer: str, body: str = "content") -> Index:
        """The same passages under another analyzer, from their kept texts, below another folder."""
        own = self.passages().drop("n_tokens", "_order").withColumnRenamed("pid", "_order")
        return Index.build(own, root, ["_order"], body, analyzer)

    def passages(self, pids: DataFrame | None = None) -> DataFrame:
        """All passages, or those of pids (pid): only the folders that hold them are opened if they are few."""
        every = self.spark.read.schema(self._kind).parquet(f"{self.root}/passages")
        if pids is None:
            return every.drop("span")
        own = pids.select("pid").distinct().withColumn("span", F.floor(F.col("pid") / SPAN).cast("int"))
        return every.join(own, ["span", "pid"], "left_semi").drop("span")

    def named(self, ranked: DataFrame, columns: list[str], keep: bool = False) -> DataFrame:
        """ranked (pid, ...) with columns of the passages, without pid unless it is to be kept: contents are read when the best are known."""
        known = self.spark.read.schema(self._kind).parquet(f"{self.root}/passages").select("span", "pid", *columns)
        ranked = few(ranked if is_stored(ranked) else stored(ranked, "ranked"))  # few rows go to the passages, whose texts then stay where they are
        return ranked.withColumn("span", F.floor(F.col("pid") / SPAN).cast("int")).join(known, ["span", "pid"]).drop("span", *([] if keep else ["pid"]))

    def lists(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, block, n, cf, most, top_tf, least_dl, p) of all terms, or of terms (term) out of their folders alone."""
        every = self._lists()
        if terms is None:
            return every.drop("bucket")
        asked = terms.select("term").distinct().withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
        asked = asked if is_stored(terms) else stored(asked, "asked")
        buckets = [r[0] for r in asked.select("bucket").distinct().collect()]  # at most BUCKETS
        return every.filter(F.col("bucket").isin(buckets)).join(few(asked), ["bucket", "term"], "left_semi").drop("bucket")

    def _lists(self) -> DataFrame:
        kind = "term string, block long, n int, cf long, most double, top_tf int, least_dl int, p array<struct<at:int,tf:int,dl:int>>, bucket int"
        return self.spark.read.schema(kind).parquet(f"{self.root}/postings") if self.n_terms else self.spark.createDataFrame([], kind)

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, pid, dl, tf)."""
        return unrolled(self.lists(terms)).select("term", "pid", "dl", "tf")

    def vocabulary(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, df, cf, idf, avgdl), from the columns beside the lists; idf at least 1e-6."""
        return self._weighed(self.lists(terms))

    def _weighed(self, lists: DataFrame) -> DataFrame:
        found = lists.groupBy("term").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf"))
        idf = F.greatest(F.ln((F.lit(self.n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
        return found.withColumns({"idf": idf, "avgdl": F.lit(self.avgdl)})

    def search(self, asked: DataFrame, k: int, k1: float = R.K1, b: float = R.B, wanted: DataFrame | None = None, by: str = "item_id", skip: bool | None = None) -> DataFrame:
        """(by, pid, score, rank): each query's k best passages by BM25, ties to the smaller pid.

        asked (by, term, qtf): a term counts qtf times, which need not be whole. wanted (pid) keeps to some passages, before their
        scores are added up; the statistics stay those of all.

        With skip (by default in an index of more than MANY blocks) a block whose terms' largest contributions
        stay under a query's k-th best score so far is not scored: that score comes from the PROBE blocks of the largest bounds. The result is the
        same.
        """
        empty = self.spark.createDataFrame([], asked.select(by).schema.add("pid", "long").add("score", "double").add("rank", "integer"))
        if k < 1 or not self.n_docs:
            return empty
        asked = stored(asked.select(by, "term", "qtf"), "asked")
        lists = self.lists(asked)
        weights = few(stored(asked.join(self._weighed(lists).select("term", "idf"), "term").select(by, "term", (F.col("qtf") * F.col("idf")).alias("w")), "weights"))
        wanted = few(stored(marked(wanted), "wanted")) if wanted is not None else None

        tasks = tasks_of(self.spark, self.n)

        def scored(blocks: DataFrame | None = None, near: DataFrame | None = None) -> DataFrame:
            rows = lists.select("term", "block", "p")
            if near is not None:
                rows = rows.join(near, "block", "left_semi")
            if wanted is not None:
                rows = among(rows, wanted)
            # the lists of a block meet in a task, so that sums are added up there and never move; a task has as many blocks in any index
            rows = rows.repartition(tasks, "block").join(weights, "term")
            if blocks is not None:
                rows = rows.join(blocks, [by, "block"], "left_semi")
            rows = unrolled(rows, "block")
            part = F.col("w") * impact(F.col("tf").cast("double"), F.col("dl"), self.avgdl, k1, b)
            return rows.groupBy(by, "block", "pid").agg(F.round(F.sum(part), 6).alias("score")).drop("block")

        def kept_best(scores: DataFrame) -> DataFrame:
            return stored(R.top(scores, k, by, "pid"), "best")

        if skip is None:
            skip = self.n > MANY * BLOCK
        if not skip:
            return kept_best(scored())
        bounds = self.bounds(lists, weights, k1, b, by)
        if wanted is not None:
            bounds = bounds.join(wanted, "block", "left_semi")
        bounds = stored(bounds, "bounds")
        probe = R.top(bounds, max(PROBE, -(-2 * k // BLOCK)), by, "block", "bound").select(by, "block")
        probe = few(stored(probe, "probe"))
        floor = stored(R.top(scored(probe, probe.select("block").distinct()), k, by, "pid").filter(F.col("rank") == k).select(by, F.col("score").alias("floor")), "floor")
        floor = few(floor)
        live = bounds.join(floor, by, "left").filter(F.col("bound") >= F.coalesce("floor", F.lit(0.0)) - _SLACK).select(by, "block")
        live = stored(live, "live")
        # so many live blocks are as good as all: their pairs would move every list once for each query
        every = scored(F.broadcast(live) if live.count() <= SMALL else None)
        # rows under a floor that k others reach are dropped before any is sorted
        return kept_best(every.join(floor, by, "left").filter(F.col("score") >= F.coalesce("floor", F.lit(0.0))).drop("floor"))

    def contributions(self, asked: DataFrame, pool: DataFrame, by: str = "item_id") -> DataFrame:
        """(by, pid, term, contribution): what each asked term, counted once, adds to the score of the passages of pool (by, pid)."""
        asked = stored(asked.select(by, "term").distinct(), "asked")
        lists = self.lists(asked)
        weights = few(stored(asked.join(self._weighed(lists).select("term", "idf"), "term"), "weights"))
        pool = stored(pool.select(by, "pid").distinct(), "pool")
        # postings of the pool's passages meet the queries that name the passage, not every query of their term
        rows = unrolled(among(lists.select("term", "block", "p"), few(stored(marked(pool), "pooled"))))
        own = F.col("idf") * impact(F.col("tf").cast("double"), F.col("dl"), self.avgdl, R.K1, R.B)
        return rows.join(few(pool), "pid").join(weights, [by, "term"]).select(by, "pid", "term", own.alias("contribution"))

    def bounds(self, lists: DataFrame, weights: DataFrame, k1: float = R.K1, b: float = R.B, by: str = "item_id") -> DataFrame:
        """(by, block, bound): no passage of the block scores more for the query. Reads no list."""
        own = k1 == R.K1 and b == R.B
        most = F.col("most") if own else impact(F.col("top_tf").cast("double"), F.col("least_dl"), self.avgdl, k1, b)
        narrow = lists.select("term", "block", "most") if own else lists.select("term", "block", "top_tf", "least_dl")
        return narrow.join(weights, "term").groupBy(by, "block").agg(F.sum(F.col("w") * most).alias("bound"))


def unrolled(lists: DataFrame, *also: str) -> DataFrame:
    """One row for each posting of lists (block, p, ...): pid, tf, dl in place of block and p, and block if it is named in also."""
    rest = [c for c in lists.columns if c not in ("block", "p", "n", "cf", "most", "top_tf", "least_dl")]
    return lists.select(*rest, "block", F.explode("p").alias("_p")).select(*rest, *also, (F.col("block") * BLOCK + F.col("_p.at")).alias("pid"), F.col("_p.tf").alias("tf"), F.col("_p.dl").alias("dl"))
