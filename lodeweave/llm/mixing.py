"""Operator 1: mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.llm.ranking import ranked
from lodeweave.session import dropped, stored

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Documents are taken in proportion to this power of their size: 0 takes all alike, 1 by size.
POWER = 0.5
#: The decisions are broadcast to the texts up to this many rows, and else both are shuffled.
BROADCAST_ROWS = 1_000_000
#: Numbers of sources, a row each, are broadcast up to this many.
SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Number of [^\x20\x09-\x0D]+ in text; 0 for null."""
    words = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "\u0001")
    return F.length(F.translate(words, " \t\n\x0b\x0c\r", "")).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """Each source's target words; sources has (source, source_size), one row each, null allowed.

    Sources are numbered by code point, null last, and weigh weights in turn. The level at which the
    targets sum to share of all words is found by counting out the sources that stop at most times their
    size until none is left above: each pass sends one row of three numbers to the driver.
    """
    sources = stored(sources.withColumn("k", F.lit(0)), "sources")
    numbered = ranked(sources, ["k"], [F.col("source").asc_nulls_last()])
    pick = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    numbered = stored(numbered.select("source", "source_size", (F.col("rank") - 1).alias("source_no"), pick.cast("double").alias("weight")), "weighed")
    level, n_full = 0.0, -1
    while True:
        full = F.col("weight") * level > most * F.col("source_size")
        got = numbered.agg(
            F.sum("source_size").alias("all"),
            F.coalesce(F.sum(F.when(full, most * F.col("source_size"))), F.lit(0)).alias("stopped"),
            F.sum(F.when(~full, F.col("weight"))).alias("free"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if got["n"] == n_full or not got["free"] or got["all"] is None:
            break
        n_full, level = got["n"], (share * got["all"] - got["stopped"]) / got["free"]
    stop = (most * F.col("source_size")).cast("double")
    return numbered.withColumn("target", F.least(stop, F.col("weight") * F.lit(level)))


def few(sources: DataFrame) -> DataFrame:
    """sources (a row for each), to be broadcast if they are few: rows of a large source stay where they are."""
    sources = stored(sources, "sources")
    return F.broadcast(sources) if sources.count() <= SOURCES else sources


def levels(units: DataFrame, goal: DataFrame, most: int, power: float) -> DataFrame:
    """goal (source, target, ...) with level: words add up to the source's target when a document is taken min(most, level * size^power) times.

    Found by counting out the documents that stop at most until none is left above: passes over one row for
    each size of a source.
    """
    gain = F.pow(F.col("size").cast("double"), F.lit(power))
    sizes = units.filter("size > 0").groupBy("source", "size").agg(F.sum(F.col("size") * F.col("rows")).alias("words"))
    sizes = stored(sizes.withColumn("gain", gain), "sizes")
    goal, before = goal.withColumn("level", F.lit(0.0)), None
    while True:
        now = F.broadcast(goal) if goal.count() <= SOURCES else goal
        full = F.col("gain") * F.col("level") >= most
        own = sizes.join(now.select(F.col("source").alias("_s"), "level"), sizes["source"].eqNullSafe(F.col("_s")))
        own = own.groupBy("source").agg(F.coalesce(F.sum(F.when(full, most * F.col("words"))), F.lit(0)).alias("stopped"), F.sum(F.when(~full, F.col("gain") * F.col("words"))).alias("free"), F.count(F.when(full, 1)).alias("n"))
        own = stored(own.withColumnRenamed("source", "_s"), "stopped")
        n = own.agg(F.sum("n")).first()[0]
        if n == before:
            dropped(sizes, own)
            return goal
        before = n
        level = F.when(F.col("free") > 0, (F.col("target") - F.col("stopped")) / F.col("free")).when(F.col("stopped") > 0, float("inf")).otherwise(0.0)
        goal = stored(goal.join(F.broadcast(own) if own.count() <= SOURCES else own, goal["source"].eqNullSafe(F.col("_s")), "left").withColumn("level", level).drop("_s", "stopped", "free", "n"), "levels")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, power: float = POWER, seed: int = 7) -> DataFrame:
    """How many times the mix takes each document: doc_id, source, size, rows, source_size, target, copies.

    Longer documents are worth more copies: document i is to be taken r_i = min(most, level * size_i^power) times
    on average, where the level makes the words of its source add up to the target. It is taken
    floor(r_i) times for certain. The words left over are a Pareto order sample: document i, with inclusion
    probability p_i = r_i - floor(r_i), gets the ranking value odds(u_i) / odds(p_i) with u_i a uniform
    number hashed from its id, and the smallest values are taken while their words fit. One that overshoots is left out and those that fit are taken
    further down the ranking, until the gap is smaller than every document left out; at last the one that
    brings the words nearest to the target (ties to the smaller ranking value) may overshoot it. So a source ends short
    of its target by less than its smallest untaken document, or over it by less than that gap was, no document is taken more than most times, and reruns agree.

    Repeated rows (same doc_id, source and size) are one unit, with their number in rows: all are taken
    equally often. A null text has size 0, a null source is a source, a null doc_id hashes as "".
    Documents of size 0 are taken floor(target / size of the source) times. An empty table gives an empty result. Other columns
    are not looked at.
    """
    units = docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    units = stored(units, "units")
    totals = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).cast("long").alias("source_size"))
    goal = targets(totals, weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = levels(units, stored(goal.withColumn("rate", rate), "targets"), most, power)
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(str(seed)))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    odds = u / (1.0 - u) / (F.col("p") / (1.0 - F.col("p")))
    known = units["source"].eqNullSafe(goal["source"])
    rows = units.join(goal.hint("broadcast") if goal.count() <= SOURCES else goal, known).drop(goal["source"])
    wanted = F.when(F.col("size") > 0, F.least(F.lit(float(most)), F.col("level") * F.pow(F.col("size").cast("double"), F.lit(power)))).otherwise(F.floor("rate").cast("double"))
    # whole numbers that sums in doubles miss by a little count as whole
    rows = rows.withColumn("r", wanted).withColumn("r", F.when(F.abs(F.col("r") - F.round("r")) < 1e-9, F.round("r")).otherwise(F.col("r")))
    rows = rows.withColumns({"whole": F.floor("r").cast("long"), "p": F.col("r") - F.floor("r")}).drop("r", "rate", "level")
    rows = rows.withColumns({"q": F.when(F.col("p") > 0, odds), "words": F.col("size") * F.col("rows")})
    order = [F.col("q").asc_nulls_last(), F.col("doc_id"), F.col("size")]
    rows = stored(ranked(stored(rows, "odds"), ["source_no"], order, "words"), "order")
    certain = rows.groupBy("source_no").agg((F.first("target") - F.sum(F.col("whole") * F.col("words"))).alias("left"))
    rows = rows.join(few(certain), "source_no").withColumn("taken_now", (F.col("p") > 0) & (F.col("before") + F.col("words") <= F.col("left")))
    more = True
    while more:
        # what is left of each source's target, and the documents outside the sample that it has room for, as they rank
        gap = rows.groupBy("source_no").agg((F.first("left") - F.sum(F.when(F.col("taken_now"), F.col("words")).otherwise(0))).alias("gap"))
        rest = rows.filter(~F.col("taken_now") & (F.col("words") > 0) & (F.col("p") > 0)).join(few(gap), "source_no")
        rest = stored(rest.select("source_no", F.col("rank").alias("place"), "words", "gap").filter("words < 2 * gap"), "rest")
        fitting = rest.filter("words <= gap")
        more = not fitting.isEmpty()
        if more:
            fills = ranked(stored(fitting, "fitting"), ["source_no"], [F.col("place")], "words").filter(F.col("before") + F.col("words") <= F.col("gap"))
        else:  # the one that comes nearest
            nearest = (-F.abs(F.col("gap") - F.col("words"))).alias("near")
            fills = rest.groupBy("source_no").agg((-F.max(F.struct(nearest, (-F.col("place")).alias("r")))["r"]).alias("place"))
        fills = fills.select("source_no", F.col("place").alias("rank"), F.lit(True).alias("fill"))
        rows = rows.join(fills, ["source_no", "rank"], "left").withColumn("taken_now", F.col("taken_now") | F.coalesce("fill", F.lit(False))).drop("fill")
        rows = stored(rows, "filled")
    copies = (F.col("whole") + F.col("taken_now").cast("long")).alias("copies")
    return rows.select("doc_id", "source", "size", "rows", "source_size", "target", copies)


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of docs, each as often as mix() takes it.

    Null texts, sources and ids, repeated rows and empty tables as in mix(); other columns come along.
    """
    own = f"_{uuid.uuid4().hex}"  # no column of docs has such a name
    names = {c: f"{own}_{c}" for c in ("doc_id", "source", "size", "copies", "words", "copy")}
    plan = mix(docs, **how).filter("copies > 0").select(*(F.col(c).alias(names[c]) for c in ("doc_id", "source", "size", "copies")))
    plan = stored(plan, "copies")
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan
    sized = docs.withColumn(names["words"], word_count(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col(names["doc_id"])) & F.col("source").eqNullSafe(F.col(names["source"])) & (F.col(names["words"]) == F.col(names["size"]))
    again = sized.join(plan, same).withColumn(names["copy"], F.explode(F.sequence(F.lit(1), F.col(names["copies"]))))
    return again.select(*(F.col(f"`{c}`") for c in docs.columns))


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return plan.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("rows")))).select("doc_id", "size", "source_size", "target", taken, "source", "copies")


#: The targets alone; whether a document is taken hangs on ranks that the tests hold against a sequential count.
TARGETS_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s AS (
  SELECT source, source_size, CAST([5, 2, 1][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER)] AS DOUBLE) AS w,
         sum(source_size) OVER () AS every FROM s0),
lv AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS level
  UNION ALL
  SELECT i + 1, (SELECT (1.5 * max(every) - coalesce(sum(2 * source_size) FILTER (w * lv.level > 2 * source_size), 0)) / sum(w) FILTER (NOT w * lv.level > 2 * source_size) FROM s)
  FROM lv WHERE i < 40),
t AS (
  SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), w * (SELECT level FROM lv WHERE i = 40)) AS target FROM s)
SELECT d.doc_id, d.size, t.source_size, t.target, d.source FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""
