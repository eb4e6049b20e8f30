"""Products of all pairs: neither copies of a side nor the pairs found are moved or written."""

import random

import pytest
from pyspark.sql import functions as F

from lodeweave.operators import kept, similar
from lodeweave.session import stored


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(7)
    texts = [" ".join(f"w{int(rng.paretovariate(0.5)) % 90}" for _ in range(rng.randint(0, 30))) for _ in range(60)]
    rows = [(f"d{k:03d}", t) for k, t in enumerate(texts + texts[:20] + ["", None])]
    return kept.Index.build(spark.createDataFrame(rows, "doc_id string, content string"), str(tmp_path_factory.mktemp("s") / "x"), ["doc_id"], analyzer="plain")


def test_sides_meet_where_they_are_stored(spark, index, monkeypatch):
    monkeypatch.setattr(similar, "SIDE", 9)
    most = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(most)
    spark.conf.set(most, "-1")  # as where sides are large
    try:
        every = similar.vectors(index, "doc_id")
        all_pairs = similar.products(every, None, 0.05)
        some = similar.products(stored(every.filter("pid < 11"), "some"), every, 0.05)
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (all_pairs, some)]
        one, two = ([tuple(r) for r in df.collect()] for df in (all_pairs, some))
    finally:
        spark.conf.set(most, was)
    assert all("CartesianProduct" in plan and "Exchange" not in plan for plan in plans)
    weight, norm = {}, {}
    for r in similar.weights(index).withColumn("name", F.format_string("d%03d", "pid")).collect():
        weight.setdefault(r["name"], {})[r["term"]] = r["w"]
    for k, v in weight.items():
        norm[k] = sum(w * w for w in v.values()) ** 0.5
    cosine = lambda a, b: sum(w * weight[b].get(t, 0) for t, w in weight[a].items()) / norm[a] / norm[b]
    want = {(a, b): c for a in weight for b in weight if a != b and (c := round(cosine(a, b), 4)) >= 0.05}
    assert len(one) == len({r[:2] for r in one}) and {r[:2] for r in one} == {k for k in want if k[0] < k[1]}
    assert len(two) == len({r[:2] for r in two}) and {r[:2] for r in two} == {k for k in want if k[0] < "d011"}
    assert all(abs(s - want[a, b]) < 1e-9 for a, b, s in one + two) and want["d000", "d060"] == 1


def test_a_side_holds_copies_of_any_number_in_parts(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(similar, "SIDE", 10)
    docs = spark.range(45).select(F.col("id").alias("doc_id"), F.lit("red green green").alias("content"))
    every = similar.vectors(kept.Index.build(docs, str(tmp_path / "c"), ["doc_id"], analyzer="plain"))
    sides = similar._sides(every, 1, "x")
    assert sorted(r[0] for r in sides.select(F.size("x_pids")).collect()) == [5, 10, 10, 10, 10]
    found = similar.products(every, None, 0.5)
    assert found.count() == 45 * 44 // 2 and found.filter("similarity <> 1").isEmpty()


def test_queries_of_all_pairs_end_in_the_products(spark):
    from lodeweave.plans import catalogue
    from lodeweave.plans import search as _  # noqa: F401

    for name in ("doc_similarity", "related_docs"):
        found = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
        files = found.inputFiles()
        assert files and all("/sides-" in f for f in files), name
