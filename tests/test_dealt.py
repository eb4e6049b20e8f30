"""The kept index at larger tables: rows are numbered where they lie, and lists are made where whole blocks meet."""

from pyspark.sql import functions as F

from lodeweave.operators import kept, resampled, similar
from lodeweave.session import stored


def _texts(spark, n):
    words = F.concat_ws(" ", F.lit("common"), F.concat(F.lit("w"), (F.col("id") % 97).cast("string")), F.concat(F.lit("w"), (F.col("id") % 97).cast("string")), F.concat(F.lit("only"), F.col("id").cast("string")))
    return spark.range(n).select((F.lit(n) - F.col("id")).alias("doc_id"), words.alias("content"))


def test_lists_are_made_by_many_tasks_and_rows_keep_their_order(spark, tmp_path):
    joined = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(joined, "false")  # else a table this small is one part
    try:
        index = kept.Index.build(_texts(spark, 3000), str(tmp_path / "i"), ["doc_id"], analyzer="plain")
    finally:
        spark.conf.unset(joined)
    assert [r[0] for r in index.passages().orderBy("pid").select("doc_id").collect()] == list(range(1, 3001))
    assert [r[0] for r in index.passages().orderBy("pid").select("pid").collect()] == list(range(3000))
    # one span, and yet its texts are not one task's: several tasks wrote its files
    span = spark.read.parquet(str(tmp_path / "i" / "passages")).select(F.input_file_name().alias("f")).distinct()
    assert span.count() > 1
    found = index.postings().groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("dl").alias("dl"))
    got = {r["term"]: (r["df"], r["cf"], r["dl"]) for r in found.filter("term in ('common', 'w5', 'only77')").collect()}
    assert got == {"common": (3000, 3000, 4), "w5": (31, 62, 4), "only77": (1, 1, 4)}
    assert index.lists().groupBy("term", "block").count().filter("count > 1").isEmpty()


def test_products_of_sides_are_those_of_all_pairs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(similar, "SIDE", 7)
    monkeypatch.setattr(similar, "STRIP", 3)
    texts = spark.range(40).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.concat(F.lit(c), (F.col("id") % m).cast("string")) for c, m in (("aa", 2), ("bb", 5), ("cc", 11), ("dd", 40)))).alias("content"))
    index = kept.Index.build(texts, str(tmp_path / "i"), ["doc_id"], analyzer="plain")
    rows = {}
    for r in similar.weights(index).collect():
        rows.setdefault(r["pid"], {})[r["term"]] = r["w"]
    norm = {p: sum(w * w for w in v.values()) ** 0.5 for p, v in rows.items()}
    cosine = lambda a, b: round(sum(w * rows[b].get(t, 0) for t, w in rows[a].items()) / norm[a] / norm[b], 4)
    want = {(a, b): c for a in rows for b in rows if a < b and (c := cosine(a, b)) >= 0.05}
    every = similar.vectors(index)
    got = [tuple(r) for r in similar.products(every, None, 0.05).collect()]
    assert len(got) == len(want) and all(abs(want[a, b] - s) < 1e-9 for a, b, s in got)
    some = stored(every.filter("pid % 10 = 0"), "some")
    got = {(r["a"], r["b"]) for r in similar.products(some, every, 0.05).collect()}
    assert got == {(a, b) for p in want for a, b in (p, p[::-1]) if a % 10 == 0}


def test_texts_stay_where_they_are_when_few_are_named(spark, tmp_path):
    index = kept.Index.build(_texts(spark, 300), str(tmp_path / "i"), ["doc_id"], analyzer="plain")
    asked = kept.query_terms(spark.createDataFrame([(1, "common w5 only77")], "item_id long, text string"), "plain")
    most = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(most)
    spark.conf.set(most, "-1")  # as where the passages are large
    try:
        named = index.named(index.search(asked, 4), ["doc_id", "content"])
        plan = named._jdf.queryExecution().executedPlan().toString()
        got = {r["rank"]: r["doc_id"] for r in named.collect()}
    finally:
        spark.conf.set(most, was)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert got == {1: 4, 2: 101, 3: 198, 4: 295}


def test_samples_score_alike_in_any_number_of_columns(spark, tmp_path, monkeypatch):
    index = kept.Index.build(_texts(spark, 400), str(tmp_path / "i"), ["doc_id"], analyzer="plain")
    asked = kept.query_terms(spark.createDataFrame([(1, "common w5 only77"), (2, "w9")], "item_id long, text string"), "plain")
    systems = {"long": (1.2, 0.75), "flat": (1.2, 0.0)}
    found = lambda: {tuple(r) for r in resampled.runs(index, asked, systems, 3, 0.5, 2).select("sample", "system", "item_id", "pid", "score", "rank").collect()}
    wide = found()
    monkeypatch.setattr(resampled, "COLUMNS", 2)  # a sample at a time
    assert found() == wide and {r[0] for r in wide} == {0, 1, 2} and max(r[5] for r in wide) == 2
