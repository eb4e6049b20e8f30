"""Signals against a deadline, and the passages that they yield."""

import time

import pytest

from lodeweave.operators import kept, planner, race
from lodeweave.plans import catalogue, search
from tests.test_kept import SMALL


def endless(spark):
    return spark.range(10**16, numPartitions=2).selectExpr("max(hash(id)) AS h")


def test_a_slow_signal_is_dropped_and_its_job_ends(spark):
    spark.range(10).count()
    quick = lambda n: lambda: spark.range(n).orderBy("id")
    run = race.Race(spark, {"quick": quick(3), "slow": lambda: endless(spark), "other": quick(200)}, 8.0, limit=5)
    began = time.monotonic()
    got = dict(run)
    assert {k: [r["id"] for r in v] for k, v in got.items()} == {"quick": [0, 1, 2], "other": [0, 1, 2, 3, 4]}
    assert 7.5 < time.monotonic() - began < 40
    assert run.dropped == ["slow"] and set(run.seconds) == {"quick", "other"}
    for _ in range(50):
        if not spark.sparkContext.statusTracker().getActiveJobsIds():
            break
        time.sleep(0.2)
    assert list(spark.sparkContext.statusTracker().getActiveJobsIds()) == []
    assert not spark.sparkContext.getJobTags() and spark.range(4).count() == 4  # the reader's own jobs are not touched


def test_leaving_early_cancels_and_failures_are_raised(spark):
    run = race.Race(spark, {"quick": lambda: spark.range(9).orderBy("id"), "slow": lambda: endless(spark)}, 600.0)
    got = list(race.unseen(run, "id", 4))
    assert [(n, r["id"]) for n, r in got] == [("quick", i) for i in range(4)]
    assert run.dropped == ["slow"]
    with pytest.raises(Exception, match="no_such_column"):
        list(race.Race(spark, {"bad": lambda: spark.range(3).select("no_such_column"), "slow": lambda: endless(spark)}, 600.0))
    assert list(race.Race(spark, {}, 1.0)) == []


def test_passages_arrive_once_by_signal(spark):
    corpus = search.corpus(catalogue.Tables(spark, SMALL), "porter+english")
    text = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first()["text"]
    found = {name: [r["pid"] for r in make().collect()] for name, make in race.signals(corpus, text, 6).items()}
    terms = kept.query_terms(spark.createDataFrame([(0, text)], "item_id long, text string"), "porter+english")
    assert found["bm25"] == [r["pid"] for r in corpus.index.search(terms, 6).orderBy("rank").collect()]
    assert set(found) == {"bm25", *planner.SIGNALS} and all(len(v) <= 6 for v in found.values())
    assert sum(1 for v in found.values() if v) >= 3
    got = list(race.streamed(corpus, text, 3, 600.0))
    assert len(got) == 3 == len({r["pid"] for _, r in got})
    assert all(r["content"] and r["pid"] in found[name] for name, r in got)
    assert len(list(race.streamed(corpus, None, 200, 600.0, planner.Request(signals=("recency", "link_pop"))))) == len({*race_pids(corpus)})  # all that either names


def race_pids(corpus):
    for make in race.signals(corpus, None, 400, planner.Request(signals=("recency", "link_pop"))).values():
        yield from (r["pid"] for r in make().collect())
