"""The kept index against plain counts: analyzers, skipped blocks, pruned reads, restarts."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodeweave.functions import stem, text
from lodeweave.operators import chunks, kept, planner
from lodeweave.operators.store import Store
from lodeweave.plans import catalogue, search
from tests.compare import SF

SMALL = "/root/testdata/sf0.001"


def plain(body, analyzer):
    own = [w for w in re.split(r"[\W]+", (body or "").lower()) if len(w) > 1 and w not in text.STOPWORDS]
    if analyzer == "porter+english":
        own = [w for w in own if w not in text.ENGLISH]
    return own if analyzer == "plain" else [stem.stem(w) for w in own]


def ranking(passages, queries, analyzer, k):
    """BM25 over all passages (key, body), one after the other."""
    own = {key: Counter(plain(body, analyzer)) for key, body in passages}
    size = {key: sum(c.values()) for key, c in own.items()}
    some = [n for n in size.values() if n]
    avg, df = sum(some) / len(some), Counter(w for c in own.values() for w in c)
    out = {}
    for item, body in queries:
        scores = defaultdict(float)
        for w, qtf in Counter(plain(body, analyzer)).items():
            idf = max(math.log((len(some) - df[w] + 0.5) / (df[w] + 0.5)), 1e-6) if df[w] else 0
            for key, c in own.items():
                if c[w]:
                    scores[key] += qtf * idf * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size[key] / avg))
        out[item] = sorted(((-round(s, 6), key) for key, s in scores.items()))[:k]
    return out


def read_plan(df):
    """The scans of df as they are planned."""
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("analyzer", kept.ANALYZERS)
def test_ranking_of_every_analyzer(spark, tmp_path, analyzer):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("doc_id < 90").select("doc_id", F.col("text").alias("content"))
    docs = docs.union(spark.createDataFrame([(500, None), (501, ""), (502, "Running runners ran, relational hopping of the caresses"), (503, "the and")], "doc_id long, content string"))
    index = kept.Index.build(docs, str(tmp_path / "i"), ["doc_id"], analyzer=analyzer)
    queries = [(1, "runs relate hopes"), (2, docs.filter("doc_id = 3").first()["content"][:200]), (3, ""), (4, "running running caress")]
    terms = kept.query_terms(spark.createDataFrame(queries, "item_id long, text string"), analyzer)
    want = ranking([tuple(r) for r in docs.collect()], queries, analyzer, 7)
    for skip in (False, True):
        got = defaultdict(list)
        for r in index.named(index.search(terms, 7, skip=skip), ["doc_id"]).orderBy("item_id", "rank").collect():
            got[r["item_id"]].append((-r["score"], r["doc_id"]))
        for item, rows in want.items():
            assert [k for _, k in got[item]] == [k for _, k in rows] and all(abs(a - b) < 2e-6 for (a, _), (b, _) in zip(got[item], rows))


def test_blocks_are_skipped_and_reads_shrink(spark, tmp_path):
    words = F.concat_ws(" ", F.lit("common"), *(F.concat(F.lit("w"), (F.xxhash64("id", F.lit(i)) % 900).cast("string")) for i in range(12)), F.when(F.col("id") % 997 == 5, F.repeat(F.lit("rare "), 6)))
    index = kept.Index.build(spark.range(40_000).select("id", words.alias("content")), str(tmp_path / "i"), ["id"], analyzer="plain")
    queries = spark.createDataFrame([(1, "rare common"), (2, "common w17 w-300")], "item_id long, text string")
    terms = kept.query_terms(queries, "plain")
    whole, some = (sorted(map(tuple, index.search(terms, 10, skip=skip).collect())) for skip in (False, True))
    assert whole == some and len(some) == 20
    weights = terms.join(index.vocabulary(terms), "term").select("item_id", "term", (F.col("qtf") * F.col("idf")).alias("w"))
    bounds = index.bounds(index.lists(terms), weights).filter("item_id = 1")
    tenth = [r[2] for r in whole if r[0] == 1][-1]
    floor = sorted(r[2] for r in whole if r[0] == 1)[0]
    assert tenth >= 0 and bounds.filter(F.col("bound") >= floor).count() < 0.2 * bounds.count()
    one = spark.createDataFrame([("rare",)], "term string")
    found = re.search(r"PartitionFilters: \[[^\]]*\(bucket#\d+ = (\d+)\)", read_plan(index.lists(one)))  # one folder of BUCKETS is opened
    assert found and 0 <= int(found[1]) < kept.BUCKETS
    narrow = re.findall(r"ReadSchema: struct<(.*?)>\n", read_plan(index.bounds(index.lists(terms), weights)))
    assert any("most:double" in x for x in narrow) and not any("array" in x and "most" in x for x in narrow)
    many = index.passages(spark.createDataFrame([(7,)], "pid long"))
    assert many.collect()[0]["id"] == 7
    wanted = spark.range(0, 40_000, 3).select(F.col("id").alias("pid"))
    kept_in = [sorted(map(tuple, index.search(terms, 10, wanted=wanted, skip=skip).collect())) for skip in (False, True)]
    assert kept_in[0] == kept_in[1] and all(r[1] % 3 == 0 for r in kept_in[0])


def test_queries_read_the_index_and_not_the_documents(spark):
    catalogue.QUERIES["bm25_batch"](spark, SMALL).count()
    read = catalogue.QUERIES["bm25_batch"](spark, SMALL).inputFiles()
    assert not any("documents.parquet" in f for f in read) and any("/passages/" in f for f in read) and any("/postings/" in f for f in read)


def test_another_analyzer_from_kept_texts(spark, tmp_path):
    rows = spark.createDataFrame([("b", "nation nations"), ("a", "national")], "name string, content string")
    index = kept.Index.build(rows, str(tmp_path / "i"), ["name"], analyzer="plain")
    other = index.reindexed(str(tmp_path / "j"), "porter")
    assert index.n_terms == 3 and {r["term"] for r in other.vocabulary().collect()} == {"nation"}
    assert [r["name"] for r in other.passages().orderBy("pid").collect()] == ["a", "b"] and other.analyzer == "porter"
    with pytest.raises(ValueError):
        index.reindexed(str(tmp_path / "k"), "snowball")


def test_broken_and_empty_indexes(spark, tmp_path):
    assert kept.Index.opened(spark, str(tmp_path / "none")) is None
    rows = spark.createDataFrame([], "name string, content string")
    index = kept.Index.build(rows, str(tmp_path / "e"), ["name"])
    terms = spark.createDataFrame([(1, "word", 1)], "item_id long, term string, qtf long")
    assert index.search(terms, 5).count() == 0 and index.vocabulary().count() == 0
    full = kept.Index.build(spark.createDataFrame([("x", "word")], "name string, content string"), str(tmp_path / "e"), ["name"])
    assert full.search(terms, 0).count() == 0 and full.search(terms, 5).count() == 1


def test_store_keeps_an_index_for_each_commit(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), size=20, overlap=5)
    docs = [("a.md", "# Head\nThe national parks of the nation are wide.", "1"), ("b.md", "Nothing about it in this long note.", "2")]
    store.add(spark.createDataFrame(docs, "doc_path string, text string, checksum string"))
    queries = spark.createDataFrame([(1, "nations")], "item_id long, text string")
    assert store.analyzer() == "porter+english" and [r["doc_path"] for r in store.search(queries).collect()] == ["a.md"]
    assert store.reindex("plain").analyzer == "plain" and store.search(queries).count() == 0
    store.reindex("porter+english")
    store.add(spark.createDataFrame([("b.md", "Now of nations too, at some length.", "3")], "doc_path string, text string, checksum string"))
    assert {r["doc_path"] for r in store.search(queries).collect()} == {"a.md", "b.md"}
    assert [r["place"] for r in store.chunks_of(spark.createDataFrame([("a.md",)], "doc_path string")).collect()] == [1]


# the planner


@pytest.fixture(scope="module")
def corpus(spark):
    return search.corpus(catalogue.Tables(spark, SMALL), "porter+english")


def test_filters_choose_before_scores(spark, corpus):
    queries = spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text")
    spec = {"type": "note", "date_from": "2026-03"}
    got = planner.retrieve(corpus, queries, planner.Request(filters=spec)).collect()
    every = corpus.index.search(kept.query_terms(queries, "porter+english"), 10**6)
    from lodeweave.operators import filters

    passing = {r["doc_path"] for r in filters.filtered(corpus.docs, spec).collect()}
    want = defaultdict(list)
    for r in corpus.index.named(every, ["chunk_id", "doc_path"]).orderBy("item_id", "rank").collect():
        if r["doc_path"] in passing and len(want[r["item_id"]]) < 5:
            want[r["item_id"]].append(r["chunk_id"])
    assert {i: [r["chunk_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["item_id"] == i] for i in want} == dict(want)
    assert all(r["content"] and r["provenance"] == "bm25" for r in got)


def test_every_mode_with_every_option(spark, corpus):
    queries = spark.createDataFrame([(1, "that therble eresan spec Q2 2026"), (2, "zzzz"), (3, None)], "item_id long, text string")
    for request in (planner.Request(mode="hybrid", expansion="rm3"), planner.Request(mode="hybrid", signals=("kg", "recency"), as_of="2026-05-01", parent="doc"), planner.Request(reference="2026-05-01", k=3), planner.Request(parent="section", filters={"type": "spec"})):
        got = planner.retrieve(corpus, queries, request).collect()
        assert got and {r["item_id"] for r in got} == {1}
        assert sorted(r["rank"] for r in got) == list(range(1, len(got) + 1)) and len(got) <= request.k
    for bad in (dict(mode="dense"), dict(expansion="x"), dict(parent="page"), dict(signals=("moon",))):
        with pytest.raises(ValueError):
            planner.Request(**bad)


def test_time_moves_dated_documents_up(spark, corpus):
    queries = spark.createDataFrame([(1, "that therble eresan two weeks ago")], "item_id long, text string")
    plain_run, timed = (planner.retrieve(corpus, queries, planner.Request(k=40, reference=day)).collect() for day in (None, "2026-04-26"))
    near = lambda rows: [r["rank"] for r in rows if r["doc_path"] in april]
    april = {r["doc_path"] for r in corpus.docs.filter("meta['date'] like '2026-04%'").collect()}
    assert sum(near(timed)) / max(1, len(near(timed))) <= sum(near(plain_run)) / max(1, len(near(plain_run)))


def test_parents_hold_their_passages(spark, corpus):
    queries = spark.createDataFrame([(1, "that therble eresan")], "item_id long, text string")
    own = {r["chunk_id"]: r for r in corpus.index.passages().collect()}
    for parent in ("section", "doc"):
        for r in planner.retrieve(corpus, queries, planner.Request(parent=parent)).collect():
            for child in r["children"].split(","):
                words = own[child]["content"].split()
                assert " ".join(words) in " ".join(r["content"].split())
            spans = [tuple(map(int, x.split(":"))) for x in r["spans"].split(",")]
            assert [r["content"][a:b] for a, b in spans] == [own[c]["content"] for c in r["children"].split(",")]
            covered = [tuple(map(int, x.split(":"))) for x in r["covered"].split(",")]
            assert {i for a, b in spans for i in range(a, b)} == {i for a, b in covered for i in range(a, b)} and all(x[1] < y[0] for x, y in zip(covered, covered[1:]))


def windows_of(text, size, overlap, lines):
    """One window after the other, over the words' places."""
    at = [m.span() for m in re.finditer(r"[^ \t\n\x0b\f\r]+", text or "")]
    breaks = [i for i in range(1, len(at)) if "\n" in text[at[i - 1][1] : at[i][0]]]
    out, start = [], 0
    while start < len(at):
        end = min(start + size, len(at))
        if lines and end < len(at):
            end = max([b for b in breaks if start + max(1, size // 2) <= b <= end], default=end)
        out.append((start, end, at[start][0], at[end - 1][1]))
        if lines and end == len(at):
            break
        start = max(start + 1, end - overlap) if lines else start + max(1, size - overlap)
    return out


def test_windows_that_end_at_line_breaks(spark):
    rng = __import__("random").Random(2)
    texts = ["".join(rng.choice(["w", "ab ", "é𝒳 ", "\n", " \n\n ", "c"]) for _ in range(rng.randrange(300))) for _ in range(60)]
    texts += [None, "", "  \n ", "one", "no break " * 40, "\n".join("abc"), "line of words\n" * 6000]
    docs = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    for size, overlap in ((10, 3), (4, 3), (1, 0), (400, 50)):
        for lines in (False, True):
            if size < 100 and lines:
                some = docs.filter("length(text) < 5000 or text is null")
            else:
                some = docs if size > 100 else docs.filter("length(text) < 5000 or text is null")
            for r in some.select("i", text_windows(size, overlap, lines)).collect():
                assert [tuple(w) for w in r["w"]] == windows_of(texts[r["i"]], size, overlap, lines)


def text_windows(size, overlap, lines):
    return text.bounded_windows(F.col("text"), size, overlap, lines).alias("w")
