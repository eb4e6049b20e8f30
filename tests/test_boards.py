"""Boards as state of a stream against the walk over all uses at once."""

import random

import pytest

from lodeweave.operators import hot
from lodeweave.streaming import boards

USES = "board string, at long, action string, chunk_id string, doc_path string, content string, base_score double"


@pytest.mark.parametrize("batches", [1, 4])
def test_boards_do_not_hang_on_batches(spark, tmp_path, batches):
    rng, rows = random.Random(batches), []
    rng = random.Random(8)
    for at in range(700):
        action = rng.choice(["hit"] * 8 + ["pin", "tick"])
        chunk = None if action == "tick" else f"c{rng.randrange(70)}"
        rows.append((rng.choice(["a", "b"]), at, action, chunk, "p", f"text {at}", rng.choice([0.1, 0.5, 0.8, None])))
    rows.append((None, 700, "hit", "c1", "p", "x", 0.5))
    for k in range(batches):
        own = rows[k * len(rows) // batches : (k + 1) * len(rows) // batches]
        spark.createDataFrame(own, USES).coalesce(1).write.mode("append").parquet(str(tmp_path / "uses"))
        store = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        try:  # a restart from the checkpoint each time
            stream = spark.readStream.schema(USES).parquet(str(tmp_path / "uses"))
            boards.track(stream, str(tmp_path / "boards"), str(tmp_path / "archive"), str(tmp_path / "check")).awaitTermination()
        finally:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", store)
    want = hot.boards(spark.createDataFrame(rows, USES)).toPandas()
    key = ["board", "chunk_id", "tier", "hits", "rounds", "base_score", "content"]
    same = lambda df: sorted(map(tuple, df[key].values.tolist()))
    assert same(boards.latest(spark, str(tmp_path / "boards")).toPandas()) == same(want[want.tier < 2])
    assert same(spark.read.parquet(str(tmp_path / "archive")).toPandas()) == same(want[want.tier == 2])
