"""What a plan of signals, filters and feedback reads from texts, it reads once."""

import pytest
from pyspark.sql import functions as F

from lodeweave.operators import facts, kept, planner
from lodeweave.plans import catalogue, search
from tests.test_kept import SMALL, read_plan


@pytest.fixture(scope="module")
def corpus(spark):
    return search.corpus(catalogue.Tables(spark, SMALL))


@pytest.fixture(scope="module")
def queries(spark):
    return search.pointed(catalogue.Tables(spark, SMALL)).filter("item_id < 6")


def made(monkeypatch, module, call):
    """(name, plan) of what call stores in a module."""
    plans, plain = [], module.stored
    monkeypatch.setattr(module, "stored", lambda df, name="step": plans.append((name, read_plan(df))) or plain(df, name))
    call()
    return plans


def test_front_matter_is_read_once_for_all_conditions(corpus, queries, monkeypatch):
    spec = {"type": ["spec", "note"], "date_from": "2026-02", "tags_any": ["t1"]}
    plans = made(monkeypatch, planner, lambda: planner.retrieve(corpus, queries, planner.Request(filters=spec)))
    assert [name for name, _ in plans].count("front") == 1


def test_feedback_searches_twice(corpus, queries, monkeypatch):
    asked, plain = [], kept.Index.search
    monkeypatch.setattr(kept.Index, "search", lambda self, terms, k, **how: asked.append(k) or plain(self, terms, k, **how))
    terms = kept.query_terms(queries, corpus.index.analyzer)
    got = planner.expanded(corpus.index, terms, 5, depth=7, fb_docs=9)
    assert asked == [9, 7]
    own = planner.model(corpus.index, terms, fb_docs=9)
    pool = plain(corpus.index, terms, 7).select("item_id", "pid").union(plain(corpus.index, own.withColumn("qtf", F.lit(1)), 7).select("item_id", "pid")).distinct()
    parts = corpus.index.contributions(own, pool).join(own, ["item_id", "term"])
    best = parts.groupBy("item_id", "pid").agg(F.round(F.sum(F.col("weight") * F.col("contribution")), 6).alias("score"))
    want = planner.R.top(best.filter("score > 0"), 5, "item_id", "pid")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect())) and got.count() > 0


def test_signals_read_facts_links_and_front_matter_once(corpus, queries, monkeypatch):
    of_facts = []
    plain = facts.stored
    monkeypatch.setattr(facts, "stored", lambda df, name="step": of_facts.append(name) or plain(df, name))
    plans = made(monkeypatch, planner, lambda: planner.retrieve(corpus, queries, planner.Request(k=10, mode="hybrid")))
    names = [name for name, _ in plans]
    assert of_facts == ["triples"] and names.count("edges") == 1 and names.count("meta") == 1
    meta = dict(plans)["meta"]
    assert "BroadcastHashJoin" in meta and "SortMergeJoin" not in meta  # texts do not move


def test_sources_within_a_pool_keep_their_scores(spark):
    rows = [(f"t{i}", f"e{i % 4}", f"o{i % 3}", f"s{i % 5}") for i in range(40)]
    triples = spark.createDataFrame(rows, "id string, subject string, object string, source string")
    asked = spark.createDataFrame([(1, "e1"), (1, "e2"), (2, "o0"), (3, "none")], "item_id long, entity string")
    every = {tuple(r) for r in facts.source_scores(asked, triples).collect()}
    some = {tuple(r) for r in facts.source_scores(asked, triples, within=spark.createDataFrame([("s1",), ("s4",)], "source string")).collect()}
    assert some == {r for r in every if r[1] in ("s1", "s4")} and 0 < len(some) < len(every)
