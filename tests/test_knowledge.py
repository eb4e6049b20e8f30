"""Facts, fused ranking, passages, the kept index, its stream and hot context on small and awkward rows."""

import random

import pytest
from pyspark.sql import functions as F

from lodeweave.functions import facts as N
from lodeweave.operators import chunks, hot, hybrid, state
from lodeweave.operators import facts as K
from lodeweave.operators.store import Store
from lodeweave.sources import vault
from lodeweave.streaming import watch

TRIPLE = "id string, subject string, predicate string, object string, source string"


def test_prose_facts(spark):
    texts = ["Ada Lovelace works for Acme Corp. It is a test. Bob uses the Delta Engine!", None, "", "x " * 41 + "Ada uses Delta.", "Ada uses Delta. " * 70, "Cy is 42. He is the King."]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", N.prose(F.col("t")).alias("f")).orderBy("i")
    got = [[tuple(x) for x in r["f"]] for r in df.collect()]
    assert got[0] == [("Ada Lovelace", "works_at", "Acme Corp"), ("Bob", "uses", "Delta Engine")]
    assert got[1] == got[2] == got[3] == got[5] == [] and got[4] == [("Ada", "uses", "Delta")] * 60


def test_facts_of_documents_replace_their_own(spark):
    aliases = spark.createDataFrame([("AL", "Ada")], "alias string, canonical string")
    docs = spark.createDataFrame([("a.md", "[[AL|she]] #t. AL leads Core.", 1), (None, None, 2)], "doc_path string, text string, place int").select("doc_path", "text")
    fresh = K.extracted(docs, aliases)
    assert [tuple(r)[:3] for r in fresh.orderBy("place").collect()] == [("Ada", "mentioned_in", "a.md"), ("a.md", "tagged_as", "t"), ("Ada", "leads", "Core")]
    had = spark.createDataFrame([("x", "is", "y", "a.md", 0, True), ("m", "is", "n", "a.md", 0, False)], fresh.schema.simpleString()[7:-1].replace(":", " "))
    assert sorted(r["subject"] for r in K.replaced(had, fresh).collect()) == ["Ada", "Ada", "a.md", "m"]
    assert [r["subject"] for r in K.forgotten(had, docs).collect()] == ["m"]


def test_paths_and_reach(spark):
    rows = [("1", "a", "p", "b", "s"), ("2", "a", "q", "c", "s"), ("3", "b", "p", "d", "s"), ("4", "c", "p", "d", None), ("5", "d", "p", "a", "s"), ("6", "b", "q", "d", "s"), ("7", "a", "p", "a", "s")]
    t = spark.createDataFrame(rows, TRIPLE)
    got = lambda *a: sorted(r["path"] for r in K.paths(t, *a).collect())
    assert got("a", "d") == [["1", "3"], ["1", "6"], ["2", "4"]] and got("a", "a") == [[]] and got("a", "zz") == [] == got("a", "d", 1)
    assert got("a", "d", 3, ["p"]) == [["1", "3"]]
    reach = lambda *a: dict(map(tuple, K.reached(t, *a).collect()))
    assert reach("a", 1, None, "out") == {"a": 0, "b": 1, "c": 1} and reach("a", 1, None, "in") == {"a": 0, "d": 1} and reach("b", 2, ["q"], "both") == {"b": 0, "d": 1}
    assert reach("none") == {"none": 0}
    with pytest.raises(ValueError):
        K.reached(t, "a", 1, None, "up")
    asked = spark.createDataFrame([(1, "c"), (1, "c"), (2, "none")], "item_id int, entity string")
    # c has two triples: a third to its source s; the others, a and d, give 0.3 of that to s each
    assert [(r["item_id"], r["source"], round(r["score"], 6)) for r in K.source_scores(asked, t).collect()] == [(1, "s", round((1 + 0.6) / 3, 6))]
    assert K.neighbours(asked, t).collect()[0]["terms"] == "a d"


def test_hybrid_against_a_plain_count(spark):
    pool = spark.createDataFrame([(1, d, 10.0 - d, d + 1) for d in range(5)] + [(2, 9, 1.0, 1)], "item_id int, doc_id int, score double, rank int")
    signals = {"kg": [(1, 4, 2.0), (1, 3, 2.0), (1, 77, 9.0)], "structural": [(1, 2, 1.0), (1, 1, 0.0)], "recency": []}
    frames = {k: spark.createDataFrame(v, "item_id int, doc_id int, score double") for k, v in signals.items()}
    intents = spark.createDataFrame([(1, "kg_first"), (2, None)], "item_id int, intent string")
    want = {d: 0.5 / (61 + d) for d in range(5)}
    want[3] += 0.2 / 61
    want[4] += 0.2 / 62
    want[2] += 0.1 / 61
    got = hybrid.hybrid(pool, frames, intents).filter("item_id = 1").orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == sorted(want, key=lambda d: (-round(want[d], 9), d)) and all(abs(r["rrf"] - want[r["doc_id"]]) < 1e-8 for r in got)
    assert hybrid.hybrid(pool, {}, intents.limit(0)).count() == 6
    with pytest.raises(ValueError):
        hybrid.hybrid(pool, {"stars": pool}, intents)


def test_section_passages(spark):
    long = " ".join(f"w{i}" for i in range(900))
    docs = [("a.md", "# Title\n" + long), ("b.md", "# Same\nfirst of two\n# Same\nsecond of two"), ("c.md", None), ("d.md", "short"), ("e.md", long)]
    df = spark.createDataFrame(docs, "doc_path string, body string")
    got = {}
    for r in chunks.of_documents(df).orderBy("doc_path", "ordinal", "start").collect():
        got.setdefault(r["doc_path"], []).append((r["start"], r["content"].split()[-1]))
    assert [s for s, _ in got["a.md"]] == [s for s, _ in got["e.md"]] == [0, 350, 700] and set(got) == {"a.md", "b.md", "e.md"}
    assert len(got["b.md"]) == 1 and "second" in chunks.of_documents(df).filter("doc_path = 'b.md'").first()["content"]
    assert chunks.of_documents(df, heading_context=True).filter("doc_path = 'a.md'").first()["content"].startswith("Title\n\nw")
    whole = chunks.joined(chunks.of_documents(df.filter("doc_path = 'e.md'")))
    assert whole.first()["text"] == long
    with pytest.raises(ValueError):
        chunks.of_documents(df, 10, 10)


def test_store_and_stream(spark, tmp_path):
    folder = tmp_path / "vault"
    (folder / ".git").mkdir(parents=True)
    (folder / "sub").mkdir()
    (folder / ".git" / "no.md").write_text("# hidden file of a tool")
    (folder / "a.md").write_text("---\ntype: note\n---\n# one\nAda leads Core today.")
    (folder / "sub" / "b.md").write_bytes(b"# Two\nbad \xff byte and [[One]] link")
    store = Store(spark, str(tmp_path / "index"))
    assert store.table("chunks").count() == 0 and store.last_batch() == 0
    watch.follow(vault.arriving(spark, str(folder)), store, str(tmp_path / "check")).awaitTermination()
    docs = vault.documents(spark, str(folder))
    assert sorted(r[0] for r in store.table("documents").select("doc_path").collect()) == ["a.md", "sub/b.md"]
    assert store.add(docs) == 0 and store.add(docs, force=True) == 2 and store.table("chunks").count() == 2
    assert "�" in store.table("documents").filter("doc_path = 'sub/b.md'").first()["text"]
    store.assert_facts(spark.createDataFrame([(" Ada ", "knows", "Bob", "a.md")], "subject string, predicate string, object string, source string"))
    facts = lambda: sorted(tuple(r)[:3] for r in store.table("facts").collect())
    assert facts() == [("Ada", "knows", "Bob"), ("Ada", "leads", "Core today"), ("One", "mentioned_in", "sub/b.md")]
    (folder / "a.md").write_text("# One\nNothing left of that.")
    (folder / "sub" / "b.md").unlink()
    (folder / "c.md").write_text(" ")
    (folder / "none.md").write_text("")
    now = vault.documents(spark, str(folder))
    assert dict(map(tuple, store.difference(now).collect())) == {"a.md": "changed", "sub/b.md": "deleted", "c.md": "new"}
    assert store.sync(now) == (2, 1) and facts() == [("Ada", "knows", "Bob")]
    assert [r["state"] for r in store.difference(now).collect()] == ["unchanged"] * 2
    # a run that died before its commit does not count
    ghost = store.table("chunks").withColumns({"content": F.lit("ghost"), "batch": F.lit(99), "run": F.lit("ghost")})
    store._append("chunks", ghost)
    small = store.compact(str(tmp_path / "small"))
    for s in (store, small):
        assert [r["doc_path"] for r in s.table("chunks").collect()] == ["a.md"] and s.table("postings").filter("term = 'nothing'").count() == 1
        assert s.table("facts").count() == 1
    assert store.forget(now) == 2 and store.table("documents").count() == 0


def test_benchmarks_questions_and_graphs(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id": "a/1 x", "title": "T", "text": "body"}\n\n{"_id": "b", "text": "only"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q2", "text": "two"}\n{"_id": "q1", "text": "one"}\n{"_id": "q3", "text": "none"}\n')
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\ta/1 x\t2\nq2\tb\t1\nq3\tb\t0\nq2\tgone\t1\n")
    corpus, asked, qrels = vault.benchmark(spark, str(tmp_path))
    assert dict(map(tuple, corpus.collect())) == {"a/1 x": "T\n\nbody", "b": "only"} and sorted(r[0] for r in asked.collect()) == ["q1", "q2"]
    assert sorted(map(tuple, qrels.collect())) == [("q1", "a/1 x", 2), ("q2", "b", 1)] and vault.benchmark(spark, str(tmp_path), "test", 1)[2].count() == 1
    (tmp_path / "qa.json").write_text('[{"query": "x", "expected_docs": ["a", "b"]}, {"query": "y", "expected_doc": "c"}, {"query": "z"}]')
    rows = vault.questions(spark, str(tmp_path / "qa.json"))
    assert {r["query"]: r["expected"] for r in rows.collect()} == {"x": ["a", "b"], "y": ["c"], "z": []}
    run = spark.createDataFrame([("x", "n", 1), ("x", "dir/b.md", 2), ("y", "d", 1)], "query string, doc_path string, rank int")
    assert [tuple(r) for r in state.by_type(run, rows).collect()] == [("", 3, round(1 / 3, 6), round(0.5 / 3, 6))]
    t = spark.createDataFrame([("1", 'a"<', "p", "b\\", None), ("2", "b\\", "p", "c", "s")], TRIPLE)
    lines = lambda form, n=300: [r["line"] for r in vault.graph_lines(t, form, n).orderBy("part", "id").collect()]
    assert lines("dot", 1) == ["digraph facts {", '  "a\\"<" -> "b\\\\" [label="p"];', "}"] and '"source":null' in lines("jsonl")[0] and len(lines("jsonl")) == 2
    assert any("a&quot;&lt;" in x for x in lines("graphml"))
    vault.write_graph(t, str(tmp_path / "g"), "graphml")
    with pytest.raises(ValueError):
        vault.graph_lines(t, "xls")


def test_hot_boards(spark):
    uses = [("u", i, "hit", f"c{i:02d}", "d", "word " * 200, 0.1 + i / 1000) for i in range(60)] + [("u", 100 + i, "hit", "c59", None, None, None) for i in range(14)] + [("u", 200, "tick", None, None, None, None), ("u", 201, "pin", "zz", "", "", 0.5), ("u", 202, None, "c59", "", "", 0.5), (None, 1, "hit", "x", "", "", 0.5)]
    uses += [("v", 1, "hit", "k", "d", "t", -0.05), ("v", 2, "tick", None, None, None, None), ("v", 3, "hit", "k", "d", "t", 0.5)]
    uses += [("w", i, "pin" if i % 2 else "hit", f"p{i // 2:02d}", "d", "t", 0.5 + i / 100) for i in range(24)]
    random.Random(1).shuffle(uses)
    kind = "board string, at int, action string, chunk_id string, doc_path string, content string, base_score double"
    df = spark.createDataFrame(uses, kind)
    got = hot.boards(df)
    rows = {(r["board"], r["chunk_id"], r["tier"]): r for r in got.collect()}
    # 50 of 60 stay hot, the weakest ten go to the archive; the one of 15 uses is pinned
    assert sum(k[0] == "u" and k[2] == 2 for k in rows) == 10 and ("u", "c00", 2) in rows and ("u", "c09", 2) in rows and rows[("u", "c59", 0)]["hits"] == 15
    assert rows[("u", "c58", 1)]["rounds"] == 1 and rows[("u", "c59", 0)]["rounds"] == 0 and len(rows[("u", "c58", 1)]["content"]) == 500
    assert ("v", "k", 2) in rows and rows[("v", "k", 1)]["hits"] == 1  # archived below 0, then new again
    assert sum(k[0] == "w" and k[2] == 0 for k in rows) == 10 and sum(k[0] == "w" and k[2] == 1 for k in rows) == 2
    context = {r["board"]: r["context"] for r in hot.injected(got, 150).collect()}
    assert context["u"].startswith("[PINNED] d: word") and context["u"].count("[HOT]") == 1 and context["v"] == "[HOT] d: t"
    assert hot.boards(df.limit(0)).count() == 0


def test_marks_and_labels(spark):
    marks = spark.createDataFrame([("c", " Q ", 1, True), ("c", "q", 2, False), ("d", "q", 1, True), ("d", "q", 3, None)], "chunk_id string, query string, at int, relevant boolean")
    asked = spark.createDataFrame([("Q", "c"), ("q", "d"), ("other", "c"), (None, "c")], "query string, chunk_id string")
    assert sorted((r["query"] or "", r["chunk_id"], r["adjustment"]) for r in hot.adjusted(asked, marks).collect()) == [("", "c", 0.0), ("Q", "c", -0.4), ("other", "c", 0.0), ("q", "d", 0.0)]
    notes = spark.createDataFrame([("c", "x", 1, "n1", None), ("c", "x", 2, "n2", False), ("c", "y", 1, None, None), ("c", "y", 2, None, True)], "chunk_id string, label string, at int, note string, removed boolean")
    assert [tuple(r) for r in hot.labelled(notes).collect()] == [("c", "x", "n2")]


def test_small_rules_and_intervals(spark):
    r = spark.range(1).select(N.asks_advice(F.lit("any TIPS?")).alias("a"), N.asks_advice(F.lit(None).cast("string")).alias("b"), N.confidence(F.lit(None).cast("double")).alias("c"), N.confidence(F.lit(0.004)).alias("d"), N.confidence(F.lit(0.005)).alias("e")).first()
    assert tuple(r) == (True, False, "empty", "low", "ok")
    values = spark.createDataFrame([(1, i, float(i % 2)) for i in range(400)] + [(2, 0, None)], "g int, i int, v double")
    got = {r["g"]: r for r in state.interval(values, "v", "g", draws=200).collect()}
    # the mean of 400 coins has a deviation of 0.025
    assert set(got) == {1} and got[1]["mean"] == 0.5 and 0.43 < got[1]["low"] < 0.47 and 0.53 < got[1]["high"] < 0.57
