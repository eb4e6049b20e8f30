"""Temporal triples: as-of match, traversal, paths, contradictions, sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions import text as T
from lodeweave.operators.prefix import running
from lodeweave.session import stored


def in_force(as_of: str) -> Column:
    """Valid at as_of, both ends included; a missing end is open."""
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= as_of)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= as_of))


def match(triples: DataFrame, subject: str = "*", predicate: str = "*", obj: str = "*", as_of: str | None = None) -> DataFrame:
    for name, value in (("subject", subject), ("predicate", predicate), ("object", obj)):
        if value != "*":
            triples = triples.filter(F.col(name) == value)
    return triples.filter(in_force(as_of)) if as_of else triples


def about(triples: DataFrame, entity: str) -> DataFrame:
    """Triples with entity at either end, by a union of two equality filters."""
    return triples.filter(F.col("subject") == entity).unionByName(triples.filter((F.col("object") == entity) & (F.col("subject") != entity)))


def traverse(triples: DataFrame, start: str, depth: int) -> DataFrame:
    """(entity, depth) reached from start along either direction within depth steps, nearest depth."""
    ends = triples.select(F.col("subject").alias("a"), F.col("object").alias("b"))
    ends = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    seen = triples.sparkSession.createDataFrame([(start, 0)], "entity string, depth int")
    for d in range(1, depth + 1):
        new = ends.join(seen.filter(F.col("depth") == d - 1).select(F.col("entity").alias("a")), "a").select(F.col("b").alias("entity")).distinct()
        seen = stored(seen.unionByName(new.join(seen, "entity", "left_anti").withColumn("depth", F.lit(d))), "frontier")
    return seen


def contradictions(triples: DataFrame) -> DataFrame:
    """Pairs of triples of one subject and predicate with different objects whose windows overlap.

    A sweep over the windows' ends: sorted by subject, predicate and time, the windows that begin inside another
    follow its beginning without a gap, up to its end. Each triple meets those alone, by their places in the
    order, so what is made grows with the pairs that overlap, and a subject of many triples is spread like any others.
    Triples without an id, subject, predicate or object contradict nothing.
    """
    low, high = F.coalesce("valid_from", F.lit("0000-01-01")), F.coalesce("valid_to", F.lit("9999-12-31"))
    t = triples.filter("id is not null and subject is not null and predicate is not null and object is not null")
    t = t.select("subject", "predicate", "id", "object", low.alias("low"), high.alias("high"))
    ends = t.withColumn("e", F.explode(F.array(F.struct(F.col("low").alias("at"), F.lit(0).alias("kind")), F.struct(F.col("high").alias("at"), F.lit(1).alias("kind")))))
    ends = ends.select("subject", "predicate", "e.*", "id", "object", "low", "high")
    swept = stored(running(ends, ["subject", "predicate", "at", "kind", "id", "object", "low", "high"], F.col("kind") == 0, "place"), "swept")
    begin = swept.filter("kind = 0").select("subject", "predicate", "id", "object", "low", "high", "place")
    same = ["subject", "predicate", "id", "object", "low", "high"]
    until = swept.filter("kind = 1").groupBy(*same).agg(F.max("place").alias("last"))
    open_ = begin.join(until, same).filter("last > place").withColumn("place", F.explode(F.sequence(F.col("place") + 1, F.col("last"))))
    a = open_.select("place", *(F.col(c).alias(f"{c}_x") for c in same))
    both = a.join(begin, "place").filter("object_x <> object and id_x <> id and low_x <= high")
    first = F.col("id_x") < F.col("id")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return both.select("subject", "predicate", pick("id_x", "id").alias("id_a"), pick("id", "id_x").alias("id_b"), pick("object_x", "object").alias("object_a"), pick("object", "object_x").alias("object_b"))


def alias_pairs(names: DataFrame, least: float = 0.75) -> DataFrame:
    """(a, b, similarity) of all pairs of distinct names (e) with similarity of at least least, a < b.

    Two word sets whose overlap is at least least of the larger share a word among the first n - ceil(least n) + 1
    of each in any common order, here rarest words first; a name inside another has its beginning among
    the other's runs of as many characters. No other pair is looked at, and none of these is left out.
    """
    low = F.trim(F.lower("e"))
    words = F.array_distinct(F.filter(F.split(low, r"\s+"), lambda w: w != ""))
    each = names.select("e", F.size(words).alias("n"), F.explode(words).alias("w"))
    each = each.join(each.groupBy("w").agg(F.count(F.lit(1)).alias("df")), "w")
    place = F.row_number().over(Window.partitionBy("e").orderBy("df", "w"))
    first = each.withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1).select("e", "w")
    pairs = first.select(F.col("e").alias("a"), "w").join(first.select(F.col("e").alias("b"), "w"), "w").filter("a < b").select("a", "b")
    head = names.select(F.col("e").alias("x"), F.substring(low, 1, 3).alias("g")).filter("g <> ''")
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(low)))
    runs = F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(*(F.substr(low, i, F.lit(k)) for k in (1, 2, 3))))))
    inside = names.select(F.col("e").alias("y"), F.explode(runs).alias("g")).join(head, "g").filter(F.contains(F.lower("y"), F.trim(F.lower("x"))) & (F.col("x") != F.col("y")))
    both = pairs.union(inside.select(F.least("x", "y"), F.greatest("x", "y"))).distinct()
    return both.withColumn("similarity", F.round(T.similarity(F.col("a"), F.col("b")), 6)).filter(F.col("similarity") >= least)
