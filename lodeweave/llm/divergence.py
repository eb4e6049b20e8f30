"""Operator 13: how the sources of a language differ in their words, by systolic rotation of the sources' vectors."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.llm.batches import map_batches, slices
from lodeweave.llm.ranking import ranked
from lodeweave.session import dropped, shared_dir, stored

#: A language keeps terms of so many of its documents; what is added to a count; what shares add up to; terms reported of a source.
LEAST_DOCS, ADDED, WHOLE, TERMS = 30, 5, 1_000_000_000, 50
#: Terms of a slice of a vector, and sources of a cell.
SLICE, CELL = 65_536, 8
#: Rounds that make one job, distinct terms that a task counts before it hands them on, and languages whose totals are broadcast.
ROUNDS, HELD, LANGS = 8, 200_000, 10_000
#: Bytes of UTF-8 in which A-Z are lower-cased and other ASCII but a-z are spaces.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def occurrences(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences of each term in each group and the documents with it.

    Null text, lang and source read as "". Every group has a row of the term "" with 0, also one without
    terms. A repeated row is a document of its own. Tasks count their own terms first, HELD at a time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in every.items():
                n[b""] = docs[b""] = 0
                some = list(n)
                for low in range(0, len(some), 20_000):
                    own = some[low : low + 20_000]
                    term = pa.array(own, pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(own), pa.string()), pa.array([source] * len(own), pa.string()), term, pa.array(list(map(n.__getitem__, own)), pa.int64()), pa.array(list(map(docs.__getitem__, own)), pa.int64())],
                        names=["lang", "source", "term", "n", "docs"],
                    )
            every.clear()

        held = 0
        for batch in batches:
            for part in slices(batch, 2):
                for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist()):
                    n, own = every.setdefault((lang, source), (Counter(), Counter()))
                    terms, before = text.translate(_TERMS).split(), len(n)
                    n.update(terms)
                    own.update(set(terms))
                    held += len(n) - before
                if held >= HELD:
                    yield from handed()
                    held = 0
        yield from handed()

    read = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    some = map_batches(read, count, "lang string, source string, term string, n long, docs long", "occurrences")
    return some.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(WHOLE * (n + ADDED) / (total + ADDED * kept)), exact."""
    whole = lambda c: c.cast("decimal(20,0)")
    return (F.lit(1) + F.call_function("div", whole(n + ADDED) * F.lit(WHOLE).cast("decimal(10,0)"), whole(total + ADDED * kept))).cast("int")


def vectors(docs: DataFrame, least: int, slice_terms: int, cell: int) -> tuple[DataFrame, DataFrame]:
    """The groups' vectors in slices, and the kept terms with their numbers.

    Vectors: lang, slice, cell, cells (of the language), source, width (terms of the slice), absent (share of a
    term that the group lacks), at (places of terms that it has), p, q (their shares in the group and in the
    language). Terms: lang, id, term.
    """
    every = stored(occurrences(docs), "terms")
    kept = every.filter("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least)
    kept = stored(ranked(stored(kept.select("lang", "term", "lang_n"), "kept"), ["lang"], [F.col("term")]).withColumn("id", F.col("rank") - 1).drop("rank"), "numbered")
    langs = stored(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total")), "langs")
    langs = F.broadcast(langs) if langs.count() <= LANGS else langs
    own = every.filter("n > 0").join(kept, ["lang", "term"]).select("lang", "source", "id", "n", "lang_n")
    own = stored(own, "own")
    groups = every.filter("term = ''").select("lang", "source").join(own.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    groups = groups.join(langs, "lang", "left").fillna(0, ["total", "kept", "lang_total"])
    groups = ranked(stored(groups, "groups"), ["lang"], [F.col("source")])
    groups = stored(groups.withColumn("cell", F.floor((F.col("rank") - 1) / cell).cast("int")).drop("rank"), "celled")
    dropped(every)
    cells = groups.groupBy("lang").agg((F.max("cell") + 1).alias("cells"))
    shared = own.join(F.broadcast(groups) if groups.count() <= LANGS else groups, ["lang", "source"])
    shared = shared.select(
        "lang",
        "source",
        F.floor(F.col("id") / slice_terms).cast("int").alias("slice"),
        F.struct((F.col("id") % slice_terms).cast("int").alias("at"), share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q")).alias("one"),
    )
    lists = shared.groupBy("lang", "source", "slice").agg(F.sort_array(F.collect_list("one")).alias("all"))  # at most slice_terms of them
    number = F.greatest(F.lit(1), F.ceil(F.col("kept") / slice_terms)).cast("int")
    each = groups.join(cells, "lang").withColumn("slice", F.explode(F.sequence(F.lit(0), number - 1)))
    width = F.least(F.lit(slice_terms), F.col("kept") - F.col("slice").cast("long") * slice_terms).cast("int")
    absent = F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept"))).otherwise(0)
    each = each.select("lang", "slice", "cell", "cells", "source", width.alias("width"), absent.alias("absent")).join(lists, ["lang", "source", "slice"], "left")
    none = F.array().cast("array<int>")
    return each.select("lang", "slice", "cell", "cells", "source", "width", "absent", *(F.coalesce(F.col(f"all.{c}"), none).alias(c) for c in ("at", "p", "q"))), kept.select("lang", "id", "term")


def dense(cell: pd.DataFrame) -> np.ndarray:
    """The vectors of a cell, a row each, written out."""
    out = np.empty((len(cell), int(cell["width"].iloc[0])), dtype=np.int64)
    for row, absent, at, p in zip(out, cell["absent"], cell["at"], cell["p"]):
        row[:] = absent
        row[at] = p
    return out


def partner(cells: Column, cell: Column, turn: int) -> Column:
    """Whom a cell meets in a turn (from 0) of the tournament of a language's cells; null if it rests or the tournament is over.

    The last of an even number of seats stays; the others meet whose numbers add up to the turn, modulo the
    rest of the seats. With an odd number of cells the last seat is empty.
    """
    seats = cells + cells % 2
    ring = seats - 1
    other = F.pmod(F.lit(turn) - cell, ring)
    other = F.when(cell == ring, F.when(F.lit(turn) % 2 == 0, F.lit(turn) / 2).otherwise((F.lit(turn) + ring) / 2)).when(other == cell, ring).otherwise(other).cast("int")
    return F.when((F.lit(turn) < ring) & (other < cells) & (other != cell), other)


_PAIR = "lang string, source string, item string, value long"


def within(cell: pd.DataFrame, terms: int, slice_terms: int) -> pd.DataFrame:
    """What a cell finds alone: its own pairs, and of each source the terms of this slice that stand out most, kept in a heap."""
    rows, all_p = [], dense(cell)
    lang, low = cell["lang"].iloc[0], int(cell["slice"].iloc[0]) * slice_terms
    for i, (source, at, p, q) in enumerate(zip(cell["source"], cell["at"], cell["p"], cell["q"])):
        for item, value in zip(cell["source"], np.abs(all_p - all_p[i]).sum(1).tolist()):
            if item != source:
                rows.append((lang, source, item, None, value))
        gain = np.asarray(p, dtype=np.int64) - np.asarray(q, dtype=np.int64)
        some = np.flatnonzero(gain > 0)
        for less, place in heapq.nsmallest(terms, zip((-gain[some]).tolist(), np.asarray(at)[some].tolist())):
            rows.append((lang, source, None, low + place, -less))
    return pd.DataFrame(rows, columns=["lang", "source", "item", "id", "value"]).astype({"id": "Int64"})


def meeting(host: pd.DataFrame, guest: pd.DataFrame) -> pd.DataFrame:
    """Both directions of every pair of a host's and a guest's source, over one slice."""
    rows = []
    if len(host) and len(guest):
        lang, here, there = host["lang"].iloc[0], dense(host), dense(guest)
        for source, own in zip(host["source"], here):
            for item, value in zip(guest["source"], np.abs(there - own).sum(1).tolist()):
                rows += [(lang, source, item, value), (lang, item, source, value)]
    return pd.DataFrame(rows, columns=["lang", "source", "item", "value"])


def settled(df: DataFrame, key: list[str]) -> DataFrame:
    """df as a checkpoint that is dealt by key: joins and groups by key move only what they meet."""
    conf = df.sparkSession.conf
    shared_dir(df.sparkSession)  # names the folder of checkpoints where that is unset
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan does not say how its rows are dealt
    try:
        return df.repartition(int(conf.get("spark.sql.shuffle.partitions")), *key).checkpoint()
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def audit(docs: DataFrame, least: int = LEAST_DOCS, terms: int = TERMS, slice_terms: int = SLICE, cell: int = CELL) -> DataFrame:
    """lang, source, part, item, value, rank: how far the sources of a language are from each other, and the terms that set each apart.

    A language keeps the terms of `least` of its documents. Vectors of their shares are cut into slices of
    slice_terms terms; the slices of `cell` sources make a cell, which stays in its partition. In the rounds
    of a tournament half of a language's cells travel to their partners, written as the terms that a source has
    and one share for all others; a meeting gives both directions of its pairs, and values add up over the
    slices. So a task holds two cells' slices, whatever the number of sources and terms, and a cell moves every
    second round. The terms of a source come from heaps of each slice.

    Part "pair": every other source of the language with the sum of differences; part "term": the first
    `terms` by share above the language's. Ties go to the smaller item in UTF-8. Null text, lang and source
    read as "", repeated rows count each, a language without kept terms has pairs of value 0, an empty table gives
    an empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    made, names = vectors(docs, least, slice_terms, cell)
    key = ["lang", "slice", "cell"]
    resident = settled(stored(made, "vectors"), key)
    alone = resident.groupBy(*key).applyInPandas(lambda one: within(one, terms, slice_terms), "lang string, source string, item string, id long, value long")
    alone = stored(alone, "alone")
    most = resident.agg(F.max("cells")).first()[0] or 0
    pairs = [alone.filter("item is not null").select("lang", "source", "item", "value")]
    for first in range(0, most + most % 2 - 1, ROUNDS):
        some = None
        for turn in range(first, min(first + ROUNDS, most + most % 2 - 1)):
            to = partner(F.col("cells"), F.col("cell"), turn)
            guests = resident.withColumn("to", to).filter(F.col("to").isNotNull() & ((F.col("cell") < F.col("to")) == F.lit(turn % 2 == 0)))
            guests = guests.withColumn("cell", F.col("to")).drop("to", "q")
            met = resident.groupBy(*key).cogroup(guests.groupBy(*key)).applyInPandas(lambda _, host, guest: meeting(host, guest), _PAIR)
            some = met if some is None else some.unionByName(met)
        pairs.append(stored(some, "round"))
    every = pairs[0]
    for more in pairs[1:]:
        every = every.unionByName(more)
    pair = every.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "id")
    term = alone.filter("item is null").withColumn("n", F.row_number().over(best)).filter(F.col("n") <= terms)
    term = term.join(names, ["lang", "id"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return pair.unionByName(term).withColumn("rank", F.row_number().over(order))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (
  SELECT r, lang, source, translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT r, lang, source, unnest(w) AS u FROM d)),
kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS kept, sum(lang_n) AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, sum(n) AS total FROM n GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(n.n, 0) AS n,
         1 + (CAST(1000000000 AS HUGEINT) * (coalesce(n.n, 0) + 5)) // (coalesce(gn.total, 0) + 5 * v.kept) AS p,
         1 + (CAST(1000000000 AS HUGEINT) * (kept.lang_n + 5)) // (v.total + 5 * v.kept) AS q
  FROM g JOIN kept ON kept.lang = g.lang JOIN v ON v.lang = g.lang
  LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source
  LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = kept.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) f
    ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
parts AS (
  SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q),
ranks AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranks WHERE part = 'pair' OR rank <= 50
"""
