"""From requests to passages: one plan of a kept index, filters, signals, feedback, time and parents."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions import text as T
from lodeweave.operators import facts as K
from lodeweave.operators import filters as M
from lodeweave.operators import graph, hybrid, kept
from lodeweave.operators import ranking as R
from lodeweave.operators import retrieval as X
from lodeweave.session import stored

MODES, EXPANSIONS, PARENTS = ("bm25", "hybrid"), (None, "rm3"), (None, "section", "doc")
SIGNALS = ("kg", "links", "structural", "recency", "link_pop")
#: Passages that signals may move, and that time may; passages that expansion looks at; documents whose links are walked.
DEPTH, TIME_DEPTH, RM3_DEPTH, SEEDS = 100, 300, 200, 3
#: Passages that a model is made of.
FB_DOCS = 10
#: Entities of a query that facts are looked up for.
ENTITIES = 8


@dataclass
class Corpus:
    """What a request may draw on: an index of passages (doc_path, chunk_id, section_id, heading, content, ...), documents
    (doc_path, meta, body), facts (id, subject, predicate, object, source, ...), links (source, target)."""

    index: kept.Index
    docs: DataFrame
    facts: DataFrame
    edges: DataFrame


@dataclass(frozen=True)
class Request:
    """How every query of a batch is to be answered."""

    k: int = 5
    mode: str = "bm25"
    signals: tuple[str, ...] = SIGNALS
    filters: dict | None = None
    expansion: str | None = None
    parent: str | None = None
    reference: str | None = None
    as_of: str | None = None
    alpha: float = hybrid.ALPHA
    rm3: dict = field(default_factory=dict)

    def __post_init__(self):
        for name, value, known in (("mode", self.mode, MODES), ("expansion", self.expansion, EXPANSIONS), ("parent", self.parent, PARENTS)):
            if value not in known:
                raise ValueError(f"unknown {name} {value!r}; one of {known}")
        if bad := set(self.signals) - set(SIGNALS):
            raise ValueError(f"unknown signals {sorted(bad)}")


def model(index: kept.Index, terms: DataFrame, wanted: DataFrame | None = None, fb_docs: int = FB_DOCS, fb_terms: int = 20, original: float = 0.5, found: DataFrame | None = None) -> DataFrame:
    """(item_id, term, weight): the relevance model of each query from its fb_docs best passages, whose texts alone are analysed.

    found is a search for at least so many that was made before.
    """
    found = index.search(terms, fb_docs, wanted=wanted) if found is None else found.filter(F.col("rank") <= fb_docs)
    best = found.withColumnRenamed("pid", "doc_id")
    texts = index.passages(best.select(F.col("doc_id").alias("pid")))
    post = kept.counted(texts, ["pid"], "content", index.analyzer).withColumnRenamed("pid", "doc_id")
    return X.expansion(terms, best, post, fb_terms, original)


def expanded(index: kept.Index, terms: DataFrame, k: int, wanted: DataFrame | None = None, depth: int = RM3_DEPTH, **how) -> DataFrame:
    """(item_id, pid, score, rank): the second search of RM3. The best passages of the query and those of the model's terms are weighed by the model."""
    depth = max(depth, k)
    found = index.search(terms, max(depth, how.get("fb_docs", FB_DOCS)), wanted=wanted)  # the best of it are the model's
    own = stored(model(index, terms, wanted, **how, found=found), "model")
    pool = found.filter(F.col("rank") <= depth).select("item_id", "pid")
    more = index.search(own.withColumn("qtf", F.lit(1)), depth, wanted=wanted).select("item_id", "pid")
    parts = index.contributions(own, pool.union(more).distinct()).join(own, ["item_id", "term"])
    scores = parts.groupBy("item_id", "pid").agg(F.round(F.sum(F.col("weight") * F.col("contribution")), 6).alias("score")).filter("score > 0")
    return R.top(scores, k, "item_id", "pid")


def signals(corpus: Corpus, pool: DataFrame, queries: DataFrame, names: tuple[str, ...], as_of: str | None) -> dict[str, DataFrame]:
    """(item_id, pid, score) of each signal: what it says of a document goes to the document's best passage of the pool."""
    first = Window.partitionBy("item_id", "doc_path").orderBy("rank")
    docs = stored(pool.withColumn("_i", F.row_number().over(first)).filter("_i = 1").select("item_id", "doc_path", "pid"), "docs")
    paths = kept.few(stored(docs.select("doc_path").distinct(), "paths"))  # the texts of others stay where they are
    vote = lambda scores: scores.join(docs, ["item_id", "doc_path"]).select("item_id", "pid", F.round("score", 9).alias("score"))  # noqa: E731  sums of weights in any order are equal
    out = {}
    if "kg" in names:
        asked = queries.select("item_id", F.explode(F.slice(T.query_entities(F.col("text")), 1, ENTITIES)).alias("entity"))
        known = corpus.facts.filter(graph.in_force(as_of)) if as_of else corpus.facts
        out["kg"] = vote(K.source_scores(asked, known, within=paths.withColumnRenamed("doc_path", "source")).withColumnRenamed("source", "doc_path"))
    edges = stored(corpus.edges, "edges") if {"links", "link_pop"} & set(names) else None
    if "links" in names:
        seeds = pool.filter(F.col("rank") <= SEEDS).groupBy("item_id", "doc_path").agg(F.max("score").alias("score"))
        out["links"] = vote(X.walked(seeds, edges).select("item_id", "doc_path", "score"))
    if {"structural", "recency"} & set(names):
        # front matter of the pool's documents alone
        meta = docs.join(stored(corpus.docs.select("doc_path", "meta").join(paths, "doc_path", "left_semi"), "meta"), "doc_path")
        if "structural" in names:
            scored = meta.join(queries.select("item_id", "text"), "item_id")
            out["structural"] = scored.select("item_id", "pid", X.structural(F.col("text"), F.col("meta")).alias("score"))
        if "recency" in names:
            out["recency"] = X.recency(meta.select("item_id", "pid", F.col("meta")["date"].alias("date")), key="pid")
    if "link_pop" in names:
        out["link_pop"] = vote(docs.select("item_id", "doc_path").join(hybrid.popularity(edges), "doc_path"))
    return out


def ranked(corpus: Corpus, queries: DataFrame, request: Request, k: int, wanted: DataFrame | None) -> DataFrame:
    """(item_id, pid, score, rank) of the k best passages."""
    terms = kept.query_terms(queries, corpus.index.analyzer)

    def first(n: int) -> DataFrame:
        if request.expansion:
            return expanded(corpus.index, terms, n, wanted, **request.rm3)
        return corpus.index.search(terms, n, wanted=wanted)

    if request.mode == "bm25":
        return first(k)
    pool = first(max(k, DEPTH))
    pool = stored(pool, "pool")
    placed = stored(corpus.index.named(pool, ["doc_path"], keep=True), "placed")
    votes = signals(corpus, placed, queries, request.signals, request.as_of)
    intents = queries.select("item_id", T.intent(F.col("text")).alias("intent"))
    return hybrid.hybrid(pool, votes, intents, k, request.alpha, key="pid").select("item_id", "pid", "score", "rank")


def inside(text: Column, date: Column, reference: str) -> Column:
    """Whether a date lies in a time window that a query names."""
    return F.exists(T.time_windows(text, F.lit(reference).cast("date")), lambda w: (date >= w["low"]) & (date <= w["high"]))


def retrieve(corpus: Corpus, queries: DataFrame, request: Request = Request()) -> DataFrame:
    """(item_id, rank, score, provenance, chunk_id, doc_path, content, children, spans, covered) of each query (item_id, text).

    Filters choose passages before any score is added up, so pools hold passing ones alone and need no deepening. In mode hybrid the pool's order and
    the signals are fused; a document's signal votes for its best passage of the pool. With a reference date passages of documents
    dated in the windows that a query names go up. With a parent the ranked passages are grouped under their section or
    document: its best score, the children in order, where each stands in the parent's text (low:high, code points), and the union
    of these. Contents are read for the passages that are returned.
    A query without a term that the corpus knows has no row.
    """
    index = corpus.index
    wanted = None
    if request.filters:
        front = stored(corpus.docs.select("doc_path", "meta"), "front")  # read once from a text, however many conditions ask for it
        passing = M.filtered(front, request.filters).select("doc_path")
        wanted = index.passages().select("pid", "doc_path").join(passing, "doc_path", "left_semi").select("pid")
    deep = max(request.k, TIME_DEPTH) if request.reference else max(4 * request.k, 20) if request.parent else request.k
    found = ranked(corpus, queries, request, deep, wanted)
    if request.reference:
        paths = index.passages().select("pid", "doc_path")
        dated = found.join(paths, "pid").join(corpus.docs.select("doc_path", F.col("meta")["date"].alias("date")), "doc_path", "left").join(queries.select("item_id", "text"), "item_id")
        within = F.coalesce(inside(F.col("text"), T.document_date(F.col("date")), request.reference), F.lit(False))
        found = X.time_boost(dated.select("item_id", "pid", "score", "rank", within.alias("_inside")), F.col("_inside"), key="pid")
    label = request.mode + ("+rm3" if request.expansion else "")
    if not request.parent:
        shown = index.named(found.filter(F.col("rank") <= request.k), ["chunk_id", "doc_path", "content"])
        return shown.select("item_id", "rank", "score", F.lit(label).alias("provenance"), "chunk_id", "doc_path", "content", *(F.lit(None).cast("string").alias(c) for c in ("children", "spans", "covered")))
    placed = index.named(found, ["chunk_id", "doc_path", "section_id", "ordinal", "start", "content"])
    key = "section_id" if request.parent == "section" else "doc_path"
    best = placed.groupBy("item_id", key).agg(F.max("score").alias("score"), F.min("rank").alias("first"))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("first"))).filter(F.col("rank") <= request.k).drop("first")
    rows = placed.drop("score").withColumnRenamed("rank", "place").join(best, ["item_id", key])
    over = stored(texts(index, best.select(key).distinct(), key), "parents")
    sections = over.select(F.col(key), F.explode("sections").alias("s")).select(key, "s.ordinal", "s.offset", "s.content")
    rows = rows.withColumn("size", F.char_length("content")).drop("content").join(sections, [key, "ordinal"])
    low = F.col("offset") + F.when(F.col("start") > 0, F.char_length(F.array_join(F.slice(F.split("content", " "), 1, F.col("start")), " ")) + 1).otherwise(0)
    one = F.struct("place", "chunk_id", low.cast("int").alias("low"), (low + F.col("size")).cast("int").alias("high"))
    rows = rows.groupBy("item_id", key, "score", "rank").agg(F.array_sort(F.collect_list(one)).alias("c"))
    shown = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat(x["low"].cast("string"), F.lit(":"), x["high"].cast("string"))), ",")
    merged = T.merged_spans(F.transform("c", lambda x: F.struct(x["low"].alias("low"), x["high"].alias("high"))))
    rows = rows.join(over.drop("sections"), key)
    children = F.array_join(F.transform("c", lambda x: x["chunk_id"]), ",").alias("children")
    return rows.select("item_id", "rank", "score", F.lit(label + "+parent").alias("provenance"), F.col(key).alias("chunk_id"), "doc_path", "content", children, shown(F.col("c")).alias("spans"), shown(merged).alias("covered"))


def texts(index: kept.Index, keys: DataFrame, key: str) -> DataFrame:
    """(key, doc_path, content, sections): the texts of sections or documents, their passages in order with what windows share dropped, and where each section (ordinal, offset, content) begins."""
    own = index.passages().join(keys, key, "left_semi")
    words = F.filter(F.split("content", r"\s+"), lambda w: w != "")
    pieces = F.array_sort(F.collect_list(F.struct("ordinal", "start", words.alias("w"), "content")))
    section = own.groupBy(*dict.fromkeys([key, "doc_path", "ordinal"])).agg(pieces.alias("p"))
    begin = F.array().cast("array<string>")
    merge = lambda have, p: F.concat(have, F.slice(p["w"], F.greatest(F.lit(0), F.size(have) - p["start"]) + 1, F.size(p["w"]) + 1))
    whole = F.when(F.size("p") == 1, F.element_at("p", 1)["content"]).otherwise(F.array_join(F.aggregate("p", begin, merge), " "))
    each = section.select(*dict.fromkeys([key, "doc_path", "ordinal"]), whole.alias("content"))
    whole = each.groupBy(*dict.fromkeys([key, "doc_path"])).agg(F.array_sort(F.collect_list(F.struct("ordinal", "content"))).alias("s"))
    before = lambda i: F.aggregate(F.slice("s", 1, i), F.lit(0), lambda n, x: n + F.char_length(x["content"]) + 2)
    sections = F.transform("s", lambda x, i: F.struct(x["ordinal"].alias("ordinal"), before(i).alias("offset"), x["content"].alias("content")))
    return whole.select(*dict.fromkeys([key, "doc_path"]), F.array_join(F.transform("s", lambda x: x["content"]), "\n\n").alias("content"), sections.alias("sections"))
