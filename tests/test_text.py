"""Text rules, filters and states on small and awkward rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from lodeweave.functions import markdown as M
from lodeweave.functions import text as T
from lodeweave.functions.stem import stem, stemmed
from lodeweave.operators import filters, state
from lodeweave.operators import retrieval as X


def test_stems(spark):
    known = "caresses:caress ponies:poni cats:cat agreed:agre plastered:plaster motoring:motor hopping:hop falling:fall filing:file happy:happi sky:sky relational:relat conditional:condit vietnamization:vietnam hopefulness:hope triplicate:triplic electrical:electr adjustment:adjust adoption:adopt rate:rate controll:control roll:roll probate:probat cease:ceas possibly:possibl archaeology:archaeolog be:be x86:x86"
    assert {p.split(":")[0]: stem(p.split(":")[0]) for p in known.split()} == dict(p.split(":") for p in known.split())
    rows = spark.createDataFrame([(1, "cats"), (2, "cat"), (2, None)], "doc_id long, term string")
    assert sorted(map(tuple, stemmed(rows).select("doc_id", "term").collect())) == [(1, "cat"), (2, "cat")]


def test_front_matter_and_sections(spark):
    texts = ["---\na: 1\nb: x: y\na: 2\nnone\n---\n\nBody\n", "---\nno end", "", None, "# One\n#nohead\n## Two\ntext\n# Three", "\n\n# Only"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("f", M.front_matter(F.col("t")))
    rows = df.select("i", "f.meta", "f.body", M.sections(F.col("f.body")).alias("s")).orderBy("i").collect()
    assert rows[0]["meta"] == {"a": "2", "b": "x: y"} and rows[0]["body"] == "Body"
    assert rows[1]["meta"] == {} and rows[1]["body"] == "---\nno end" and rows[2]["s"] == rows[3]["s"] == []
    assert [(s["heading"], s["path"], s["content"]) for s in rows[4]["s"]] == [("One", ["One"], "#nohead"), ("Two", ["One", "Two"], "text"), ("Three", ["Three"], "")]
    assert [s["heading"] for s in rows[5]["s"]] == ["Only"]


@pytest.mark.parametrize("phrase, want", [("two weeks ago", [("2023-05-10", "2023-05-22")]), ("3 days ago", [("2023-05-26", "2023-05-28")]), ("last Tuesday", [("2023-05-22", "2023-05-24")]), ("Yesterday", [("2023-05-28", "2023-05-30")]), ("last weekend", [("2023-05-26", "2023-05-29")]), ("last week", [("2023-05-19", "2023-05-27")]), ("last month", [("2023-04-15", "2023-05-15")]), ("two years ago", []), ("past 2 weeks", []), ("", [])])
def test_time_windows(spark, phrase, want):
    day = F.lit(datetime.date(2023, 5, 30))
    got = spark.range(1).select(T.time_windows(F.lit(phrase), day).alias("w")).first()["w"]
    assert [(str(w["low"]), str(w["high"])) for w in got] == want


def test_filters(spark):
    docs = [("a/x.md", {"type": "Spec", "tags": "[Ops, #b]", "date": "2026-03-04", "n": "2", "flag": "Yes"}), ("b/y.md", {"date": "2026-04", "n": "10", "supersedes": "a/x.md"}), ("a\\z.md", {}), ("q.md", {"n": "abc", "tags": ""})]
    df = spark.createDataFrame(docs, "doc_path string, meta map<string,string>")
    got = lambda spec: sorted(r[0] for r in filters.filtered(df, spec).collect())
    assert got({"path": "a/*"}) == ["a/x.md", "a\\z.md"] and got({"path": "[!ab]*"}) == ["q.md"]
    assert got({"tags": ["OPS", "b"]}) == ["a/x.md"] == got({"tags_any": "#b"}) == got({"type": ["spec"]})
    assert got({"date_to": "2026-04"}) == ["a/x.md", "b/y.md"] and got({"date_from": "2026-03-05"}) == ["b/y.md"]
    assert got({"meta": {"n": {"gt": 2}}}) == ["b/y.md", "q.md"] and got({"meta": {"n": {"nin": [2, "abc"]}}}) == ["b/y.md"]
    assert got({"meta": {"n": {"exists": False}}}) == ["a\\z.md"] and got({"meta": {"flag": "yes"}}) == ["a/x.md"]
    assert got({"as_of": "2026-03-31"}) == ["a/x.md", "a\\z.md", "q.md"] and got({"as_of": "2026-05-01"}) == ["a\\z.md", "b/y.md", "q.md"]
    for bad in ({"colour": 1}, {"meta": {"n": {"like": 1}}}, {"as_of": "soon"}):
        with pytest.raises(ValueError):
            filters.condition(bad)


def test_links_and_walks(spark):
    docs = spark.createDataFrame([("N/A.md",), ("b.md",), ("c.md",)], "doc_path string")
    links = spark.createDataFrame([("N/A.md", " B "), ("b.md", "C.md"), ("b.md", "c"), ("c.md", "gone"), ("c.md", "n\\a")], "source string, link string")
    edges = X.resolved(links, docs)
    assert sorted(map(tuple, edges.collect())) == [("N/A.md", "b.md"), ("b.md", "c.md"), ("c.md", "N/A.md")]
    seeds = spark.createDataFrame([(1, "N/A.md", 1.0)], "item_id int, doc_path string, score double")
    assert sorted((r["doc_path"], round(r["score"], 6), r["hop"]) for r in X.walked(seeds, edges).collect()) == [("b.md", 0.4, 1), ("c.md", 0.064, 2)]


def test_budget_states(spark):
    uses = [100, 110, 120, 130, 140, 150, 4000, 10, 20, 500, None]
    df = spark.createDataFrame([(1, i, None if u is None else float(u)) for i, u in enumerate(uses)], "u int, i int, tokens double")
    got = [r["status"] for r in state.budget_status(df, "u", "i", "tokens").orderBy("i").collect()]
    assert got == ["ok"] * 5 + ["trend", "critical", "ok", "ok", "ok", "ok"]
