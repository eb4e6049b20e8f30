"""Operators 11 to 13 against plain versions, on awkward rows and on many small blocks."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeweave.llm import crf, divergence, language, variants
from tests.compare import SF, connection, rows

DOCS = "doc_id long, text string, lang string, source string, n string, rank string, cell string, word string, block string, p string, id string, words string"
CLASH = ("x",) * 8
ODD = [(1, None, None, None), (2, "", "", "a"), (3, "one", "en", "a"), (4, "der lange text " * 9000, "de", "b"), (None, "no id here at all", "en", None), (6, "same text twice", "en", "a"), (6, "same text twice", "en", "a"), (7, "12 34 ²", "fr", "c"), (8, " \n\t ", "fr", "c"), (9, "abc123", "fr", "é")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *CLASH) for r in ODD], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# language


@pytest.fixture(scope="module")
def model(spark):
    return language.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.op11_language_tags(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert list(got.held_out) == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() >= 0.98


def test_marginals_are_those_of_whole_texts(model):
    own, texts = language.Labeller(model), ["Der lange und the thing of that. " * 40, "la que. " * 3, "x", "", "Nicht auf and then. " * 700]
    row, text = own.rows(texts)
    first = np.r_[True, text[1:] != text[:-1]]
    for piece in (language.PIECE, 128):
        language.PIECE, before = piece, language.PIECE
        got = np.concatenate([g for _, g in own.marginals(row, first)])
        language.PIECE = before
        for i in range(len(texts)):
            e = np.log(own.table[row[text == i]])[None]
            if e.size:
                want, _, _ = crf.forward_backward(e, np.log(model.move), np.log(model.start), np.array([e.shape[1]]))
                assert np.abs(want[0] - got[text == i]).max() < 1e-6


def test_stretches_of_switched_text(spark, model):
    docs = {lang: spark.read.parquet(f"{SF}/documents.parquet").filter((F.col("lang") == lang) & language.held_out(F.col("doc_id")) & (F.length("text") > 600)).orderBy("doc_id").first()["text"] for lang in ("de", "en")}
    parts = {lang: " ".join(re.findall(r"[^\W\d_]+", t)[-40:]) for lang, t in docs.items()}
    text = f"{parts['de']} {parts['en']} {parts['de']}"
    found = language.Labeller(model).runs(text)
    right = sum(b - a for a, b, lang in found if lang == "en" and a >= len(parts["de"]) - 20 and b <= len(parts["de"]) + len(parts["en"]) + 20)
    assert right > 0.8 * len(parts["en"])


def test_languages_of_odd_rows(spark, odd, none, model):
    got = {(r["doc_id"], r["n_words"]): r for r in language.predict(odd, model, with_runs=True).collect()}
    assert language.predict(odd, model).count() == len(ODD)
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 and got[k]["runs"] == "" for k in ((1, 0), (2, 0), (7, 0), (8, 0)))
    assert got[4, 27000]["lang_pred"] == "de" and got[4, 27000]["score"] > 0.9 and got[9, 1]["lang_pred"] in model.langs
    assert language.predict(none, model).count() == 0
    blank = language.fit(none)
    assert blank.langs == [] and {r["lang_pred"] for r in language.predict(odd, blank).collect()} == {"und"}
    one = language.fit(odd.filter("lang = 'de'").withColumn("doc_id", F.lit(4)))
    assert one.langs == ["de"] and {(r["lang_pred"], r["score"]) for r in language.predict(odd, one).filter("n_words > 0").collect()} == {("de", 1.0)}


# spelling variants


def near(words):
    """All words at one edit, by their texts with a letter taken out."""
    lost, out = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            lost[w[:i] + w[i + 1 :]].add((w, i))
    for short, some in lost.items():
        for w, i in some:
            out[w] |= {v for v, j in some if j == i and v != w} | ({short} if short in words else set())
            if short in words:
                out[short].add(w)
    return out


def counted(docs, every=199):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def test_variants_over_a_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    n = counted(docs)
    got = {r["word"]: r for r in variants.op12_spelling_variants(spark, SF).collect()}
    assert {w: r["n"] for w, r in got.items()} == n
    others, form = near(n), {}
    for w in n:
        best = min(others[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    for w, r in got.items():
        root = w
        while form[root]:
            root = form[root]
        assert (r["form"], r["form_n"], r["n_near"], r["root"]) == (form[w], n.get(form[w]), len(others[w]), root)


def test_near_words_in_many_blocks_with_copies(spark):
    rng = np.random.default_rng(1)
    some = {"".join(rng.choice(list("abÿ×é"), rng.integers(1, 9))) for _ in range(2500)} | {"a" * k for k in range(1, 40)} | {"", "𝒳y", "𝒳"} - {""}
    made = variants.near_words(spark.createDataFrame([(w, 1) for w in some], "word string, n long"), block=60, visitors=90)
    pairs = [(r["word"], r["near"]) for r in made.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a, own in near(some).items() for b in own}


def test_roots_follow_forms_to_the_last(spark):
    n = {"abcdef": 5, "abcdeg": 25, "abcdegh": 125, "abcxegh": 625, "abcxegi": 625 * 5, "zzzzzz": 7}
    got = {r["word"]: (r["root"], r["form"]) for r in variants.group(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert got["abcdef"] == ("abcxegi", "abcdeg") and got["abcxegi"] == ("abcxegi", None) and got["zzzzzz"] == ("zzzzzz", None)
    tied = {r["word"]: r["form"] for r in variants.group(spark.createDataFrame([("aaaaaa", 1), ("aaaaab", 9), ("aaaaaaa", 9), ("aaaaaB", 8)], "word string, n long")).collect()}
    assert tied["aaaaaa"] == "aaaaaaa" and tied["aaaaaB"] == "aaaaab" if tied["aaaaaB"] else tied["aaaaaa"] == "aaaaaaa"


def test_variants_of_odd_rows(spark, odd, none):
    want = counted([(r[0], r[1]) for r in ODD], every=3)
    assert {r["word"]: r["n"] for r in variants.words(odd, every=3).collect()} == want
    assert variants.group(variants.words(none)).count() == 0 and variants.near_words(variants.words(none)).count() == 0
    long = "ab" * 40000
    wide = spark.createDataFrame([(long, 9), (long + "c", 1), (long[:-1], 3)], "word string, n long")
    assert {(r["word"] == long, r["n_near"]) for r in variants.group(wide).collect()} == {(True, 2), (False, 1)}


# source divergence


def audited(docs, least, terms):
    n, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in docs:
        lang, source = lang or "", source or ""
        own = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        n[lang, source].update(own)
        df[lang].update(set(own))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, k in df[lang].items() if k >= least)
        total = sum(n[lang, s][t] for s in sources for t in kept)
        q = {t: 1 + 10**9 * (sum(n[lang, s][t] for s in sources) + 5) // (total + 5 * len(kept)) for t in kept}
        p = {s: {t: 1 + 10**9 * (n[lang, s][t] + 5) // (sum(n[lang, s][u] for u in kept) + 5 * len(kept)) for t in kept} for s in sources}
        for s in sources:
            pair = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            term = sorted((q[t] - p[s][t], t.encode()) for t in kept if n[lang, s][t] and p[s][t] > q[t])[:terms]
            out += [(lang, s, part, x.decode(), -v, k) for part, some in (("pair", pair), ("term", term)) for k, (v, x) in enumerate(some, 1)]
    return sorted(out)


def own_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("size", [dict(), dict(slice_terms=7, cell=1), dict(slice_terms=3, cell=2)])
def test_audit_in_slices_and_rounds(spark, size):
    rng, words = np.random.default_rng(4), ["Über", "the", "of", "a b", "x"] + [f"w{c}" for c in "abcdefghij"]
    docs = [(i, " ".join(rng.choice(words, 12)), ["de", "en", None][i % 3], f"s{int(rng.integers(9))}" if i % 7 else None) for i in range(150)]
    docs += [(900, None, "en", "bare"), (901, "only once", "xx", "a"), (902, "", "xx", "b")]
    made = divergence.audit(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), least=3, terms=4, **size)
    assert own_rows(made) == audited(docs, 3, 4)


def test_every_pair_of_cells_meets_once(spark):
    for cells in range(1, 9):
        met = Counter()
        for turn in range(cells + cells % 2 - 1):
            own = spark.range(cells).select(F.col("id").cast("int").alias("c"), divergence.partner(F.lit(cells), F.col("id").cast("int"), turn).alias("to")).collect()
            to = {r["c"]: r["to"] for r in own if r["to"] is not None}
            assert all(to[b] == a for a, b in to.items())
            met.update(frozenset(x) for x in to.items())
        assert len(met) == cells * (cells - 1) // 2 and set(met.values()) <= {2}


def test_shares_are_exact_for_large_counts(spark):
    n, total, kept = 987_654_321_987_654_321, 1_234_567_890_123_456_789, 77_777
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(kept)).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * kept)


def test_audit_of_odd_rows(spark, odd, none):
    assert own_rows(divergence.audit(odd, least=1)) == audited(ODD, 1, 50) and divergence.audit(none).count() == 0


def test_audit_moves_no_resident_cell(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made, _ = divergence.vectors(docs, 30, 1000, 4)
    resident = divergence.settled(made, ["lang", "slice", "cell"])
    met = resident.groupBy("lang", "slice", "cell").cogroup(resident.filter("cell = 1").withColumn("cell", F.lit(0)).groupBy("lang", "slice", "cell")).applyInPandas(lambda _, a, b: divergence.meeting(a, b), "lang string, source string, item string, value long")
    assert met._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_audit_equals_its_sql(spark):
    got = rows(divergence.op13_source_divergence(spark, SF).toPandas())
    assert got == rows(connection().sql(divergence.ORACLE).df())
