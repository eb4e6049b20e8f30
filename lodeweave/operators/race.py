"""Signals that race a deadline: each is a Spark job of its own, those that end in time are yielded, the others are cancelled."""

from __future__ import annotations

import queue
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import closing

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.functions import text as T
from lodeweave.operators import facts as K
from lodeweave.operators import graph, hybrid, kept, planner
from lodeweave.operators import retrieval as X
from lodeweave.operators.planner import Corpus, Request

#: Seconds between two cancellations of a signal that goes on to another job.
AGAIN = 0.2


class Race:
    """Iterates over (name, rows) of signals in the order in which they end.

    A signal is a function that plans and returns a table; up to `limit` of its rows, as it orders them, are taken. All run at once, under a job
    tag each, and share the cluster's cores. At `budget` seconds after the start, or when the iteration is left early,
    every job of a signal that is still running is cancelled, again if it goes on to another, until its thread has ended. A
    signal that fails of itself raises here. `seconds` has the time of each that ended, `dropped` the names of the others.
    """

    def __init__(self, spark: SparkSession, signals: dict[str, Callable[[], DataFrame]], budget: float, limit: int = 100):
        self.spark, self.signals, self.budget, self.limit = spark, signals, budget, limit
        self.seconds: dict[str, float] = {}
        self.dropped: list[str] = []
        self._ended: queue.Queue = queue.Queue()

    def _run(self, name: str, tag: str, began: float) -> None:
        self.spark.sparkContext.addJobTag(tag)
        try:
            rows = self.signals[name]().limit(self.limit).collect()
            self._ended.put((name, rows, None, time.monotonic() - began))
        except Exception as e:  # noqa: BLE001  raised again by the reader, unless this race cancelled the signal
            self._ended.put((name, None, e, time.monotonic() - began))
        finally:
            self.spark.sparkContext.removeJobTag(tag)

    def __iter__(self) -> Iterator[tuple[str, list[Row]]]:
        began = time.monotonic()
        running = {}
        for name in self.signals:
            tag = f"race-{uuid.uuid4().hex}"
            thread = InheritableThread(target=self._run, args=(name, tag, began), daemon=True)
            running[name] = (thread, tag)
            thread.start()
        late = dict(running)
        try:
            while late:
                try:
                    name, rows, failure, took = self._ended.get(timeout=max(0.0, began + self.budget - time.monotonic()))
                except queue.Empty:
                    break
                del late[name]
                if failure is not None:
                    raise failure
                self.seconds[name] = took
                yield name, rows
        finally:
            self.dropped = sorted(late)
            for name in late:
                thread, tag = running[name]
                while thread.is_alive():
                    self.spark.sparkContext.cancelJobsWithTag(tag)
                    thread.join(AGAIN)


def unseen(race: Race, key: str, limit: int) -> Iterator[tuple[str, Row]]:
    """(signal, row) of a race in the order of arrival, the first row of each key alone, until there are so many; then the race ends."""
    seen = set()
    with closing(iter(race)) as found:
        for name, rows in found:
            for row in rows:
                if len(seen) == limit:
                    return
                if row[key] not in seen:
                    seen.add(row[key])
                    yield name, row


def signals(corpus: Corpus, text: str, limit: int, request: Request = Request()) -> dict[str, Callable[[], DataFrame]]:
    """The search for a query's words and the signals of a request, each a job that hangs on no other: (score, pid, chunk_id, doc_path, content), best first, at most `limit` rows.

    What a signal says of a document stands for its first passage. Links are walked from the best documents of a search of
    their own. Only the best documents meet passages, and only theirs are read with contents.
    """
    index = corpus.index
    spark = index.spark
    asked = spark.createDataFrame([(0, text)], "item_id long, text string")

    def shown(ranked: DataFrame) -> DataFrame:
        return index.named(ranked.select("pid", "score"), ["chunk_id", "doc_path", "content"], keep=True).orderBy(F.desc("score"), "pid")

    def search(k: int) -> DataFrame:
        return index.search(kept.query_terms(asked, index.analyzer), k)

    def kg() -> DataFrame:
        entities = asked.select("item_id", F.explode(F.slice(T.query_entities(F.col("text")), 1, planner.ENTITIES)).alias("entity"))
        known = corpus.facts.filter(graph.in_force(request.as_of)) if request.as_of else corpus.facts
        return K.source_scores(entities, known).withColumnRenamed("source", "doc_path")

    def links() -> DataFrame:
        best = index.named(search(planner.SEEDS), ["doc_path"]).groupBy("item_id", "doc_path").agg(F.max("score").alias("score"))
        return X.walked(best, corpus.edges)

    def structural() -> DataFrame:
        return corpus.docs.select("doc_path", X.structural(F.lit(text or ""), F.col("meta")).alias("score"))

    def recency() -> DataFrame:
        dated = corpus.docs.select("doc_path", F.substring(F.col("meta")["date"], 1, 10).alias("day")).filter("day <> ''")
        newest = dated.orderBy(F.desc("day"), "doc_path").limit(limit)  # no order of all documents
        place = F.row_number().over(Window.orderBy(F.desc("day"), "doc_path")) - 1
        n = F.broadcast(dated.agg(F.count(F.lit(1)).alias("n")))  # one row
        return newest.withColumn("place", place).crossJoin(n).select("doc_path", (1.0 - F.col("place") / F.col("n")).alias("score"))

    def link_pop() -> DataFrame:
        return hybrid.popularity(corpus.edges)

    def voted(scores: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
        def run() -> DataFrame:
            own = index.passages().select("pid", "doc_path")
            ranked = scores().select("doc_path", F.round("score", 9).alias("score")).filter("score > 0").join(own.select("doc_path").distinct(), "doc_path", "left_semi")
            best = F.broadcast(ranked.orderBy(F.desc("score"), "doc_path").limit(limit))  # of a bounded size
            return shown(own.join(best, "doc_path").groupBy("doc_path", "score").agg(F.min("pid").alias("pid")))

        return run

    every = {"kg": kg, "links": links, "structural": structural, "recency": recency, "link_pop": link_pop}
    return {"bm25": lambda: shown(search(limit)), **{name: voted(every[name]) for name in request.signals}}


def streamed(corpus: Corpus, text: str, limit: int = 5, budget: float = 10.0, request: Request = Request()) -> Iterator[tuple[str, Row]]:
    """(signal, passage) of one query as its signals end, each passage once, by the signal that named it first, until there are `limit`.

    This is no fusion: order and members hang on which signal is faster and may differ from `planner.retrieve`. Signals that are not
    done `budget` seconds after the start, or when the limit is reached, are cancelled.
    """
    return unseen(Race(corpus.index.spark, signals(corpus, text, 2 * limit, request), budget, 2 * limit), "pid", limit)
