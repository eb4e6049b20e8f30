"""Tables that operators once failed on or lost text of."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodeweave.llm import chat, html_text, licenses, mixing, ngram_join
from lodeweave.session import stored

LONG = " ".join(f"word{i}" for i in range(60))


def test_mixing_with_columns_of_its_own_names(spark):
    rows = [(1, "one two", "a", 7, "x", "y", "z", 3, 4), (2, "three", "b", 7, "x", "y", "z", 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies long, _id string, _source string, _copy string, _size long, _words long")
    got = mixing.mixed(docs)
    assert got.columns == docs.columns and {r["copies"] for r in got.collect()} == {7}


@pytest.mark.parametrize("attribute", ["title=don't", "title=can't data-a='x > y'", "title = \"it's\"", "alt=5\"", "a=b'c d='>'"])
def test_quotes_in_attributes(attribute):
    page = f"<body><p {attribute}>First of it.</p><p>Second one.</p><p {attribute}>Third.</p></body>"
    assert [b[0] for b in html_text.blocks(page)] == ["First of it.", "Second one.", "Third."]


def test_pages_of_odd_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (3, "v", "<p>" + "lang " * 60000), (4, "w", "<p class=\"x")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    schema_only = spark.createDataFrame([], docs.schema)
    docs.write.mode("overwrite").parquet(f"{(folder := corpus_folder(spark))}/pages.parquet")
    got = html_text.op3_block_labeller(spark, folder).collect()
    assert sorted(r["page_id"] for r in got) == [1, 1, 2, 3, 4] and all(r["text"] == "" and r["n_chars"] == 0 for r in got if r["page_id"] < 3)
    schema_only.write.mode("overwrite").parquet(f"{folder}/pages.parquet")
    assert html_text.op3_block_labeller(spark, folder).count() == 0


def corpus_folder(spark):
    from lodeweave.session import kept_root

    return kept_root(spark, "odd-tables")


def test_licenses_of_repeated_rows_and_long_texts(spark):
    text = "Licensed under CC BY 4.0. " + LONG
    rows = [(1, text, "c"), (1, text, "c"), (1, "all rights reserved", "c"), (None, None, "c"), (None, None, "c"), (2, "", "c"), (3, "x", "c"), (4, "word " * 200_000 + "all rights reserved", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, copies string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_base"], r["base_labels"]) for r in licenses.scan(docs).collect())
    n = len(text.replace(".", " ").split())
    assert got == sorted([(1, n, 1, "cc-by"), (1, n, 1, "cc-by"), (1, 3, 1, "reserved"), (0, 0, 0, ""), (0, 0, 0, ""), (2, 0, 0, ""), (3, 1, 0, ""), (4, 200_003, 1, "reserved")])


def test_licenses_by_a_plain_count_of_places(spark):
    """Labels beyond the base's: every template with most of its 2-grams in a passage of fitting length stands, and no other."""
    rows, want = [], {}
    for i, (phrase, label) in enumerate(licenses.TEMPLATES.items()):
        own = phrase.split()
        rows += [(2 * i, f"{LONG} {phrase.upper()} {LONG}"), (2 * i + 1, f"{LONG} {' '.join(own[: max(1, len(own) // 3)])} {LONG}")]
        want[2 * i] = label
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, label in want.items():
        assert label in got[i]["labels"].split(",") and got[i]["score"] == 1.0
        assert any(s["start"] == 60 and s["end"] == 60 + len(list(licenses.TEMPLATES)[i // 2].split()) for s in got[i]["spans"])


def test_ids_that_are_text(spark):
    turns = spark.createDataFrame([("c-1", 0, "a", "hello"), ("c-1", 1, "b", "there"), (None, 0, "a", "alone")], "conv_id string, turn long, role string, text string")
    assert {r["conv_id"] for r in chat.rotate(turns).collect()} == {"c-1", None}
    rows = [("d-2", LONG), ("d-1", LONG + " more"), ("d-3", "quite another text of some few words"), (None, LONG), ("d-4", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs).collect()}
    assert got == {"d-1": "d-1", "d-2": "d-1", "d-3": "d-3", "d-4": "d-4", None: "d-1"}
    assert sorted(r["doc_id"] or "" for r in ngram_join.without_copies(docs).collect()) == ["", "d-1", "d-3", "d-4"]


def test_pipeline_over_ids_that_are_text_and_clashing_columns(spark):
    rows = [(f"d{i}", f"{LONG} {i}" if i % 3 else f"text {i} " * 9, "en", "s", 1, "c", "c", "c") for i in range(12)] + [(None, None, None, None, 0, "c", "c", "c")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string, n_chars long, copies string, label string, rank string")
    folder = corpus_folder(spark)
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder), name)
    assert docs.select(F.count_distinct("doc_id")).first()[0] >= 5
