"""What a search moves and holds does not hang on how many queries share a term or how large the index is."""

import re

import pytest
from pyspark.sql import functions as F

from lodeweave.operators import kept
from lodeweave.plans import catalogue
from lodeweave.plans import search as _  # noqa: F401  registers all queries
from tests.test_kept import SMALL, read_plan


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    words = F.concat_ws(" ", F.lit("common"), *(F.concat(F.lit("w"), (F.xxhash64("id", F.lit(i)) % 200).cast("string")) for i in range(6)))
    rows = spark.range(9_000).select("id", words.alias("content"))
    return kept.Index.build(rows, str(tmp_path_factory.mktemp("i") / "i"), ["id"], analyzer="plain")


@pytest.fixture(scope="module")
def terms(spark):
    return kept.query_terms(spark.createDataFrame([(i, f"common w{i} w-{i}") for i in range(12)], "item_id long, text string"), "plain")


def dealt(monkeypatch, call):
    """Plans of what call stores, by name."""
    plans, plain = [], kept.stored
    monkeypatch.setattr(kept, "stored", lambda df, name="step": plans.append((name, read_plan(df))) or plain(df, name))
    call()
    return plans


def test_tasks_of_a_search_grow_with_the_index(spark, index, terms, monkeypatch):
    monkeypatch.setattr(kept, "DEAL", 512)
    for skip in (False, True):
        plans = dealt(monkeypatch, lambda: index.search(terms, 5, skip=skip))
        tasks = [int(n) for name, p in plans if name in ("best", "floor") for n in re.findall(r"hashpartitioning\(block#\d+L?, (\d+)\), REPARTITION_BY_NUM", p)]
        assert tasks and set(tasks) == {18}  # 9,000 passages in parts of 512


def test_the_probe_moves_its_blocks_alone(index, terms, monkeypatch):
    plans = dict(dealt(monkeypatch, lambda: index.search(terms, 5, skip=True)))
    below = plans["floor"].split("REPARTITION_BY_NUM", 1)[1]  # what is done before lists move
    assert re.search(r"Join \[block#\d+L?\], \[block#\d+L?\], LeftSemi", below)


def test_wanted_passages_are_told_before_queries_meet_lists(spark, index, terms, monkeypatch):
    want = spark.range(0, 9_000, 5).select(F.col("id").alias("pid")).union(spark.range(60, 70).select("id"))
    plans = dict(dealt(monkeypatch, lambda: index.search(terms, 7, wanted=want, skip=False)))
    assert "getbit" in plans["best"] and not re.search(r"Join \[pid#\d+L?\]", plans["best"])
    ids = {r[0] for r in want.collect()}
    every = sorted(map(tuple, index.search(terms, 10**6).collect()))
    got = sorted(map(tuple, index.search(terms, 7, wanted=want).collect()))
    by_query = {}
    for item, pid, score, _ in sorted(every, key=lambda r: r[3]):
        if pid in ids:
            by_query.setdefault(item, []).append((pid, score))
    assert got == sorted((item, pid, score, n) for item, rows in by_query.items() for n, (pid, score) in enumerate(rows[:7], 1))
    assert index.search(terms, 7, wanted=want.filter("pid < 0")).count() == 0


def test_contributions_join_queries_by_passage(spark, index, terms):
    pool = index.search(terms, 20).select("item_id", "pid")
    found = index.contributions(terms, pool.union(pool))
    joins = re.findall(r"Join \[(\w+)#\d+L?\], \[term#\d+\], Inner", read_plan(found))
    assert "term" not in joins  # no list meets all queries of its term
    post = index.postings(terms).join(index.vocabulary(terms).select("term", "idf"), "term")
    own = F.col("idf") * kept.impact(F.col("tf").cast("double"), F.col("dl"), index.avgdl, 1.2, 0.75)
    want = pool.join(terms.select("item_id", "term"), "item_id").join(post, ["term", "pid"]).select("item_id", "pid", "term", own)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() > 200


@pytest.mark.parametrize("places", [[], [0], [63, 64], [127], list(range(128)), [200, 5, 5]])
def test_marks_of_any_place(spark, places):
    lists = spark.createDataFrame([("t", b, [(i, 1, 9) for i in range(128)]) for b in range(2)], "term string, block long, p array<struct<at:int,tf:int,dl:int>>")
    marks = kept.marked(spark.createDataFrame([(p,) for p in places], "pid long"))
    assert sorted(r["pid"] for r in kept.unrolled(kept.among(lists, marks)).collect()) == sorted(set(places))


def test_parents_are_named_by_the_index(spark):
    assert not any("documents.parquet" in f for f in catalogue.QUERIES["parent_groups"](spark, SMALL).inputFiles())


def test_texts_with_a_needle_are_sought_in_tasks_by_blocks(spark, monkeypatch):
    plans = dealt(monkeypatch, lambda: catalogue.grep_baseline(catalogue.Tables(spark, SMALL)))
    assert any(name == "ranked" and re.search(r"hashpartitioning\(block#\d+L?, \d+\), REPARTITION_BY_NUM", p) for name, p in plans)
