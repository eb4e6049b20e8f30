"""Hot boards as the state of a stream: a board's passages live in the state store and follow its uses, batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodeweave.operators import hot

STATE = "place long, doc_path string, content string, base_score double, hits long, rounds long, tier int"
COLUMNS = ["chunk_id", "doc_path", "content", "base_score", "hits", "rounds", "tier"]


class Keeper(StatefulProcessor):
    """One board a key: its passages are a map state, at most hot.PINNED + hot.HOT of them.

    Uses of a batch are taken in order, ticks among them. What the batch archives comes out with tier 2, and the board
    as it is after the batch with the tiers of its passages; the last batch of a board is its state.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "chunk_id string", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        board, had = hot.Board(), {}
        for (chunk,), value in self.entries.iterator():
            had[chunk] = tuple(value)
        for chunk, (_, *rest) in sorted(had.items(), key=lambda e: e[1][0]):
            board.entries[chunk] = dict(zip(COLUMNS, (chunk, *rest)))
        every = pd.concat(list(rows)).sort_values(["at", "chunk_id", "action"], kind="stable", na_position="first")
        for action, chunk, path, content, base in every[["action", "chunk_id", "doc_path", "content", "base_score"]].itertuples(index=False):
            board.use(action, chunk, path, content, base)
        now = {e["chunk_id"]: (i, *(e[c] for c in COLUMNS[1:])) for i, e in enumerate(board.entries.values())}
        for chunk in had.keys() - now.keys():
            self.entries.removeKey((chunk,))
        for chunk, value in now.items():
            if had.get(chunk) != value:
                self.entries.updateValue((chunk,), value)
        out = pd.DataFrame(board.gone + list(board.entries.values()), columns=COLUMNS)
        out.insert(0, "board", key[0])
        out["score"] = out["base_score"] + hot.HIT * out["hits"] - hot.AGE * out["rounds"]
        yield out

    def close(self) -> None:
        pass


def kept(uses: DataFrame) -> DataFrame:
    """The stream of boards and archived passages of a stream of uses (board string, at, action, chunk_id, doc_path, content, base_score).

    Uses come in order from batch to batch; within one they are sorted. However they are batched, a board ends as hot.boards()
    says of them all. Uses without a board are left out. The session's state store must be RocksDB's.
    """
    rows = uses.filter("board is not null").select("board", "at", "action", "chunk_id", "doc_path", "content", "base_score")
    return rows.groupBy("board").transformWithStateInPandas(Keeper(), f"board string, {hot.ENTRY}, score double", "Update", "None")


def track(uses: DataFrame, boards: str, archive: str, checkpoint: str):
    """Writes archived passages to the folder archive and each batch's boards to the folder boards (partitioned by batch), until all uses that are there are taken.

    A batch that runs again writes over its own folders. latest() reads the boards.
    """

    def sink(batch: DataFrame, number: int) -> None:
        some = batch.persist()
        some.filter("tier = 2").write.mode("overwrite").parquet(f"{archive}/batch={number}")
        some.filter("tier < 2").write.mode("overwrite").parquet(f"{boards}/batch={number}")
        some.unpersist()

    return kept(uses).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark, boards: str) -> DataFrame:
    """Each board as its last batch left it."""
    every = spark.read.parquet(boards)
    last = every.groupBy("board").agg(F.max("batch").alias("batch"))
    return every.join(last, ["board", "batch"]).drop("batch")
