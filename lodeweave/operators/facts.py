"""Facts read from documents, aliases, sources of an entity, and shortest paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions import facts as X
from lodeweave.session import dropped, stored


def resolved(rows: DataFrame, aliases: DataFrame | None, *columns: str) -> DataFrame:
    """rows with the canonical name in place of each alias (alias, canonical), one step; an alias given twice stands for its smallest canonical name."""
    if aliases is None:
        return rows
    for c in columns:
        one = aliases.groupBy(F.col("alias").alias(c)).agg(F.min("canonical").alias("_canonical"))
        rows = rows.join(one, c, "left").withColumn(c, F.coalesce("_canonical", c)).drop("_canonical")
    return rows


def extracted(docs: DataFrame, aliases: DataFrame | None = None, path: str = "doc_path", body: str = "text") -> DataFrame:
    """(subject, predicate, object, source, place, extracted) of all documents: links, tags, then prose, place counting from 0 in a document."""
    every = F.concat(X.marked(F.col(body), F.col(path)), X.prose(F.col(body)))
    rows = docs.select(F.col(path).alias("source"), F.posexplode(every).alias("place", "t")).select("t.*", "source", "place")
    rows = resolved(rows.withColumn("extracted", F.lit(True)), aliases, "subject", "object")
    return rows.select("subject", "predicate", "object", "source", "place", "extracted")


def replaced(triples: DataFrame, fresh: DataFrame) -> DataFrame:
    """triples with the extracted ones of fresh's sources gone and fresh in their place; asserted facts stay."""
    gone = fresh.select("source").distinct().withColumn("extracted", F.lit(True))
    return triples.join(gone, ["source", "extracted"], "left_anti").unionByName(fresh, allowMissingColumns=True)


def forgotten(triples: DataFrame, paths: DataFrame) -> DataFrame:
    """triples without the extracted ones whose source is among paths (doc_path)."""
    return triples.join(paths.select(F.col("doc_path").alias("source"), F.lit(True).alias("extracted")), ["source", "extracted"], "left_anti")


def ends(triples: DataFrame) -> DataFrame:
    """(entity, other, id, source): each triple at its subject, and at its object where that is another."""
    own = triples.select(F.col("subject").alias("entity"), F.col("object").alias("other"), "id", "source")
    return own.unionByName(triples.filter("subject <> object").select(F.col("object").alias("entity"), F.col("subject").alias("other"), "id", "source"))


def source_scores(asked: DataFrame, triples: DataFrame, by: str = "item_id", near: int = 5, within: DataFrame | None = None) -> DataFrame:
    """(by, source, score) of the entities asked for (by, entity), each once a query.

    An entity of n triples gives 1 / (1 + n) to each of its sources, and 0.3 of that to each source of
    the other end of its near first triples (by id). Only triples of asked entities and of their
    neighbours move; an entity with very many triples is counted in parts before it moves. Triples, which may be read from
    texts, are made once. within (source) keeps to some sources; the weights stay those of all.
    """
    every = ends(stored(triples.select("id", "subject", "object", "source"), "triples"))
    names = asked.select("entity").distinct()
    mine = every.join(names, "entity", "left_semi")
    weight = mine.groupBy("entity").agg((1.0 / (1 + F.count(F.lit(1)))).alias("w"))
    first = mine.withColumn("_i", F.row_number().over(Window.partitionBy("entity").orderBy("id"))).filter(F.col("_i") <= near)
    steps = asked.select(by, "entity").distinct().join(weight, "entity")
    direct = steps.select(by, F.col("entity").alias("at"), "w")
    beside = steps.join(first.select("entity", F.col("other").alias("at")), "entity").select(by, "at", (F.col("w") * 0.3).alias("w"))
    reached = direct.unionByName(beside).groupBy(by, "at").agg(F.sum("w").alias("w"))
    known = every.filter("source is not null").select(F.col("entity").alias("at"), "source").join(reached.select("at").distinct(), "at", "left_semi").distinct()
    if within is not None:
        known = known.join(within, "source", "left_semi")
    return reached.join(known, "at").groupBy(by, "source").agg(F.round(F.sum("w"), 9).alias("score"))


def neighbours(asked: DataFrame, triples: DataFrame, most: int = 5, by: str = "item_id") -> DataFrame:
    """(by, terms): up to most other ends of the triples of a query's entities, smallest triple first, to widen the query by."""
    found = asked.select(by, "entity").distinct().join(ends(triples), "entity").groupBy(by, "other").agg(F.min("id").alias("id"))
    found = found.withColumn("_i", F.row_number().over(Window.partitionBy(by).orderBy("id", "other"))).filter(F.col("_i") <= most)
    return found.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "other"))), lambda x: x["other"]), " ").alias("terms"))


def reached(triples: DataFrame, start: str, depth: int = 2, predicates: list[str] | None = None, direction: str = "both") -> DataFrame:
    """(entity, depth) within depth steps of start along triples of predicates (all, if none are named), out, in or both ways.

    A start without triples reaches itself alone.
    """
    if direction not in ("out", "in", "both"):
        raise ValueError(f"direction is out, in or both, not {direction!r}")
    used = triples.filter(F.col("predicate").isin(predicates)) if predicates else triples
    forward = used.select(F.col("subject").alias("a"), F.col("object").alias("b"))
    back = used.select(F.col("object").alias("a"), F.col("subject").alias("b"))
    edges = {"out": forward, "in": back, "both": forward.unionByName(back)}[direction].filter("a <> b").distinct()
    seen = triples.sparkSession.createDataFrame([(start, 0)], "entity string, depth int")
    for d in range(1, depth + 1):
        last = seen.filter(F.col("depth") == d - 1).select(F.col("entity").alias("a"))
        new = edges.join(last, "a").select(F.col("b").alias("entity")).distinct().join(seen, "entity", "left_anti")
        grown = stored(seen.unionByName(new.withColumn("depth", F.lit(d))), "reached")
        dropped(seen)
        seen = grown
    return seen


def of_reached(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """All triples at the reached entities, whatever their predicates: (entity, depth, id, subject, predicate, object)."""
    at = triples.select(F.explode(F.array_distinct(F.array("subject", "object"))).alias("entity"), "id", "subject", "predicate", "object")
    return entities.join(at, "entity")


def paths(triples: DataFrame, start: str, end: str, depth: int = 3, predicates: list[str] | None = None) -> DataFrame:
    """(path, hops): shortest paths of at most depth triples from start to end, subject to object, as arrays of triple ids.

    A node between is reached by one path, the smallest; the last step counts with every triple into end.
    Where start is end there is one path without hops; without a path there is no row.
    """
    spark, kind = triples.sparkSession, "path array<string>, hops int"
    if start == end:
        return spark.createDataFrame([([], 0)], kind)
    used = triples.filter(F.col("predicate").isin(predicates)) if predicates else triples
    edges = used.filter("subject <> object").select(F.col("subject").alias("node"), F.col("object").alias("next"), "id")
    front = spark.createDataFrame([(start, [])], "node string, path array<string>")
    seen = front.select("node")
    for hop in range(1, depth + 1):
        step = edges.join(front, "node").select(F.col("next").alias("node"), F.concat("path", F.array(F.col("id").cast("string"))).alias("path"))
        step = stored(step.join(seen, "node", "left_anti"), "paths")
        found = step.filter(F.col("node") == end)
        if not found.isEmpty():
            return found.select("path", F.lit(hop).alias("hops"))
        front = step.groupBy("node").agg(F.min("path").alias("path"))
        seen = seen.unionByName(front.select("node"))
    return spark.createDataFrame([], kind)


def overlapping(low: Column, high: Column, other_low: Column, other_high: Column) -> Column:
    """Two windows of validity meet; a missing end is open."""
    first, last = F.lit("0000-01-01"), F.lit("9999-12-31")
    return (F.coalesce(low, first) <= F.coalesce(other_high, last)) & (F.coalesce(other_low, first) <= F.coalesce(high, last))
