"""Hot context: tiers of passages by use, marks of relevance, and labels."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions import facts as X

PINNED, HOT, PROMOTE, HIT, AGE = 10, 50, 0.85, 0.05, 0.02
ENTRY = "chunk_id string, doc_path string, content string, base_score double, hits long, rounds long, tier int"


class Board:
    """Passages of one board: at most PINNED pinned ones and HOT hot ones; what it holds is bounded, however long its history."""

    def __init__(self) -> None:
        self.entries: dict[str, dict] = {}
        self.gone: list[dict] = []

    @staticmethod
    def score(e: dict) -> float:
        return e["base_score"] + HIT * e["hits"] - AGE * e["rounds"]

    def tier(self, n: int) -> list[dict]:
        return [e for e in self.entries.values() if e["tier"] == n]

    def _archive(self, e: dict) -> None:
        self.gone.append({**self.entries.pop(e["chunk_id"]), "tier": 2})

    def _to_hot(self, e: dict) -> None:
        e["tier"] = 1
        self.entries[e["chunk_id"]] = self.entries.pop(e["chunk_id"], e)  # the latest of equal scores goes first
        if len(hot := self.tier(1)) > HOT:
            self._archive(min(reversed(hot), key=self.score))

    def use(self, action: str | None, chunk: str | None, path: str | None, content: str | None, base: float | None) -> None:
        """One use: hit, pin or tick. A null action, and any but a tick without a passage, does nothing; a null score is 0.5."""
        if action == "tick":
            self.tick()
        elif chunk is not None and action == "hit":
            self.hit(chunk, path or "", content or "", 0.5 if base is None or base != base else base)
        elif chunk is not None and action == "pin":
            self.pin(chunk)

    def hit(self, chunk: str, path: str, content: str, base: float) -> None:
        """A use: a new passage becomes hot; one whose score reaches PROMOTE is pinned."""
        e = self.entries.get(chunk)
        if e is None:
            return self._to_hot({"chunk_id": chunk, "doc_path": path, "content": content[:500], "base_score": base, "hits": 1, "rounds": 0, "tier": 1})
        e["hits"] += 1
        if e["tier"] == 1 and self.score(e) >= PROMOTE:
            self.pin(chunk)

    def pin(self, chunk: str) -> None:
        """Pins a passage; of more than PINNED the one of least score becomes hot again."""
        e = self.entries.get(chunk)
        if e is None or e["tier"] == 0:
            return
        e["tier"] = 0
        self.entries[chunk] = self.entries.pop(chunk)
        if len(pinned := self.tier(0)) > PINNED:
            self._to_hot(min(pinned, key=self.score))

    def tick(self) -> None:
        """A round: hot passages age and go when their score is below 0."""
        for e in self.tier(1):
            e["rounds"] += 1
            if self.score(e) < 0:
                self._archive(e)


def boards(uses: DataFrame, board: str = "board", order: str = "at") -> DataFrame:
    """The state of each board after its uses (board, order, action, chunk_id, doc_path, content, base_score), archived passages too.

    action is hit, pin or tick. Uses of a board are sorted by Spark (ties by chunk_id, then action) and streamed through
    one state of at most PINNED + HOT passages; archived ones leave it at once. Null actions and uses of a null passage other than ticks do nothing.
    """
    kind = uses.schema[board].dataType.simpleString()
    wanted = [board, order, "action", "chunk_id", "doc_path", "content", "base_score"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None

        def out(last: bool) -> pd.DataFrame:
            rows = state.gone + (list(state.entries.values()) if last else [])
            state.gone = []
            frame = pd.DataFrame(rows, columns=["chunk_id", "doc_path", "content", "base_score", "hits", "rounds", "tier"])
            frame.insert(0, board, now)
            frame["score"] = frame["base_score"] + HIT * frame["hits"] - AGE * frame["rounds"]
            return frame

        for batch in batches:
            for row in batch.itertuples(index=False):
                name, _, action, chunk, path, content, base = row
                if state is None or name != now:
                    if state is not None:
                        yield out(True)
                    now, state = name, Board()
                state.use(action, chunk, path, content, base)
            if state is not None and state.gone:
                yield out(False)
        if state is not None:
            yield out(True)

    rows = uses.filter(F.col(board).isNotNull()).select(*wanted).repartition(F.col(board)).sortWithinPartitions(board, order, "chunk_id", "action")
    return rows.mapInPandas(walk, f"{board} {kind}, {ENTRY}, score double")


def injected(state: DataFrame, limit: int = 1500, board: str = "board") -> DataFrame:
    """(board, context): pinned passages, then the 20 hottest, as long as their words fit the limit; each tier ends at its first passage that does not."""
    hot = F.col("tier") == 1
    snippet = F.substring("content", 1, F.when(hot, 200).otherwise(300))
    rows = state.filter("tier < 2").select(board, "tier", "chunk_id", "doc_path", "score", snippet.alias("s"))
    words = F.size(F.filter(F.split("s", r"\s+"), lambda w: w != ""))
    order = Window.partitionBy(board, "tier").orderBy(F.desc("score"), "chunk_id")
    rows = rows.withColumns({"cost": words + F.when(hot, 15).otherwise(20), "i": F.row_number().over(order)}).filter(~hot | (F.col("i") <= 20))
    rows = rows.withColumn("used", F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    pinned = F.max(F.when(~hot & (F.col("used") <= limit), F.col("used")))
    rows = rows.withColumn("before", F.coalesce(pinned.over(Window.partitionBy(board)), F.lit(0))).filter(F.col("used") + F.when(hot, F.col("before")).otherwise(0) <= limit)
    line = F.concat(F.when(hot, "[HOT] ").otherwise("[PINNED] "), "doc_path", F.lit(": "), "s")
    lines = F.array_sort(F.collect_list(F.struct("tier", "i", line.alias("line"))))
    return rows.groupBy(board).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("context"))


def latest(marks: DataFrame, order: str = "at") -> DataFrame:
    """(chunk_id, query_hash, relevant): the last mark of each passage and query; a null relevant takes a mark back."""
    last = marks.select("chunk_id", X.query_hash(F.col("query")).alias("query_hash"), F.struct(order, "relevant").alias("m"))
    return last.groupBy("chunk_id", "query_hash").agg(F.max("m")["relevant"].alias("relevant")).filter("relevant is not null")


def adjusted(results: DataFrame, marks: DataFrame) -> DataFrame:
    """results (query, chunk_id, ...) with the adjustment of each: 0.25 where marked relevant, -0.40 where not, else 0."""
    by = F.when(F.col("relevant"), 0.25).when(~F.col("relevant"), -0.40).otherwise(0.0)
    rows = results.withColumn("query_hash", X.query_hash(F.col("query")))
    return rows.join(latest(marks), ["chunk_id", "query_hash"], "left").withColumn("adjustment", by).drop("query_hash", "relevant")


def labelled(notes: DataFrame, order: str = "at") -> DataFrame:
    """(chunk_id, label, note): notes (chunk_id, label, note, removed) as they stand, the last of each passage and label; removed ones are out."""
    last = notes.groupBy("chunk_id", "label").agg(F.max(F.struct(order, "note", F.coalesce("removed", F.lit(False)).alias("removed"))).alias("n"))
    return last.filter("not n.removed").select("chunk_id", "label", "n.note")
