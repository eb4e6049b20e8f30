"""Every named query of the retrieval engine with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.functions import text as T
from lodeweave.operators import graph as G
from lodeweave.operators import index as I
from lodeweave.operators import kept as K
from lodeweave.operators import ranking as R
from lodeweave.operators import state as S
from lodeweave.operators.prefix import running
from lodeweave.session import fingerprint, kept_root, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of Tables under its name, with its SQL."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


# --- SQL fragments ---
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


def tok(col: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(coalesce({col}, '')), '[^\p{{L}}\p{{N}}_]+'), lambda t: length(t) > 1 AND NOT list_contains({_STOP}, t))"


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')"
_POST = f"""p0 AS (SELECT doc_id, {tok('text')} AS t FROM documents), p1 AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM p0),
post AS (SELECT term, doc_id, dl, count(*) AS tf FROM p1 GROUP BY ALL),
st AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM p0 WHERE len(t) > 0),
vocab AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, greatest(ln((any_value(n_docs) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)), 1e-6::DOUBLE) AS idf, any_value(avgdl) AS avgdl FROM post, st GROUP BY term)"""
_TERMS = f"qt AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({tok('text')}) AS term FROM benchmark) GROUP BY ALL)"


def scores_sql(name: str, k1: float) -> str:
    return f"{name} AS (SELECT item_id, doc_id, round(sum(qtf * (idf * tf * ({k1}::DOUBLE + 1) / (tf + {k1}::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))), 6) AS score FROM post JOIN qt USING (term) JOIN vocab USING (term) GROUP BY ALL)"


def top_sql(source: str, k: int, by: str = "item_id", tie: str = "doc_id") -> str:
    return f"SELECT *, CAST(row_number() OVER (PARTITION BY {by} ORDER BY score DESC, {tie}) AS INTEGER) AS rank FROM {source} QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY score DESC, {tie}) <= {k}"


_OPEN: dict[tuple[SparkSession, str], K.Index] = {}


def kept(t: Tables, name: str, passages: Callable[[], DataFrame], order: list[str], analyzer: str) -> K.Index:
    """The index of that name over the folder's documents as they are now: built by the first query that asks, read by all that follow."""
    root = kept_root(t.spark, f"{name}-{analyzer}-{fingerprint(t.spark, f'{t.folder}/documents.parquet')}")
    if (t.spark, root) not in _OPEN:
        _OPEN[t.spark, root] = K.Index.opened(t.spark, root) or K.Index.build(passages(), root, order, analyzer=analyzer)
    return _OPEN[t.spark, root]


def documents(t: Tables) -> K.Index:
    """Whole documents under the plain analyzer."""
    return kept(t, "documents", lambda: t.documents.withColumnRenamed("text", "content"), ["doc_id"], "plain")


def best(t: Tables, k: int, k1: float = R.K1, wanted: DataFrame | None = None) -> DataFrame:
    """(item_id, doc_id, score, rank): the k best documents of each item of the benchmark."""
    index = documents(t)
    return index.named(index.search(K.query_terms(t.benchmark, index.analyzer), k, k1, wanted=wanted), ["doc_id"])


# --- text ---
@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tok('text')}) AS term FROM documents) GROUP BY ALL")
def tokenize_counts(t):
    return I.postings(t.documents).select("doc_id", "term", "tf")


@query(f"SELECT doc_id, len({_WORDS}) AS n_words, len({tok('text')}) AS n_tokens FROM documents")
def stopword_filter(t):
    return t.documents.select("doc_id", T.n_words(F.col("text")).cast("long").alias("n_words"), F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query(f"SELECT doc_id, CAST(floor(len({_WORDS}) * 1.3::DOUBLE) AS BIGINT) AS tokens FROM documents")
def token_estimate(t):
    return t.documents.select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


def _distinct(lists: str) -> str:
    return f"list_filter({lists}, lambda x, i: list_position({lists}, x) = i)"


@query("WITH e AS (SELECT doc_id, list_concat(regexp_extract_all(text, '\"([^\"]{3,40})\"', 1), list_filter(regexp_split_to_array(coalesce(text, ''), '[^\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{2,}'))) AS l FROM documents) SELECT doc_id, array_to_string(" + _distinct("l") + "[1:20], '|') AS entities FROM e")
def surface_entities(t):
    return t.documents.select("doc_id", F.array_join(T.surface_entities(F.col("text")), "|").alias("entities"))


@query("""SELECT page_id, len(l) AS n_links, array_to_string(l, ' ') AS links FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages)""")
def page_links(t):
    found = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return t.pages.select("page_id", F.size(found).cast("long").alias("n_links"), F.array_join(found, " ").alias("links"))


@query(f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, len(w), 350)) AS start FROM w),
x AS (SELECT doc_id, CAST(start AS INTEGER) AS start, array_to_string(w[start + 1:start + 400], ' ') AS content FROM c)
SELECT doc_id, start, length(content) AS n_chars, substr(sha256('d' || doc_id || '::' || start), 1, 16) AS chunk_id FROM x WHERE length(content) >= 10""")
def chunk_windows(t):
    return I.chunks(t.documents).select("doc_id", "start", F.char_length("content").cast("long").alias("n_chars"), "chunk_id")


_CUES = lambda cues: " + ".join(f"CAST(regexp_matches(lower(text), '{c}') AS INTEGER)" for c in cues)


@query(f"SELECT doc_id, CASE WHEN g > l THEN 'kg_first' WHEN l > g THEN 'bm25_first' ELSE 'balanced' END AS intent FROM (SELECT doc_id, {_CUES(T.GRAPH_CUES)} AS g, {_CUES(T.LEXICAL_CUES)} AS l FROM documents)")
def classify_intent(t):
    return t.documents.select("doc_id", T.intent(F.col("text")).alias("intent"))


# --- statistics ---
@query(f"WITH {_POST} SELECT n_docs, round(avgdl, 6) AS avgdl FROM st")
def corpus_stats(t):
    return I.corpus_stats(t.documents).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {_POST} SELECT term, df, cf, round(idf, 6) AS idf FROM vocab")
def vocab_df_idf(t):
    return documents(t).vocabulary().select("term", "df", "cf", F.round("idf", 6).alias("idf"))


@query(f"WITH {_POST} SELECT term, df, cf FROM vocab ORDER BY df DESC, cf DESC, term LIMIT 50")
def top_terms(t):
    return documents(t).vocabulary().select("term", "df", "cf").orderBy(F.desc("df"), F.desc("cf"), "term").limit(50)


@query(f"WITH {_POST} SELECT doc_id, term, tf, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS INTEGER) AS rank FROM post QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) <= 5")
def inspect_doc_terms(t):
    ranked = R.top(I.postings(t.documents), 5, "doc_id", "term", "tf")
    return ranked.select("doc_id", "term", "tf", "rank")


@query(f"WITH {_POST} SELECT doc_id, round(tf / dl, 6) AS weight FROM post WHERE term = 'der'")
def posting_list(t):
    index = documents(t)
    found = index.postings(t.spark.createDataFrame([("der",)], "term string"))
    return index.named(found, ["doc_id"]).select("doc_id", F.round(F.col("tf") / F.col("dl"), 6).alias("weight"))


# --- ranking ---
@query(f"WITH {_POST}, {_TERMS}, {scores_sql('s', 1.2)} {top_sql('s', 10)}")
def bm25_batch(t):
    return best(t, 10)


@query(f"WITH {_POST}, {_TERMS}, {scores_sql('s', 1.2)} SELECT doc_id, score FROM s WHERE item_id = 0 ORDER BY score DESC, doc_id LIMIT 20")
def bm25_topk(t):
    index = documents(t)
    found = index.search(K.query_terms(t.benchmark.filter("item_id = 0"), index.analyzer), 20)
    return index.named(found, ["doc_id"]).select("doc_id", "score").orderBy(F.desc("score"), "doc_id")


@query(f"WITH {_POST}, {_TERMS}, {scores_sql('s', 1.5)} {top_sql('s', 10)}")
def rank_bm25_okapi(t):
    return best(t, 10, 1.5)


_LISTS = f"{_POST}, {_TERMS}, {scores_sql('s', 1.2)}, {scores_sql('o', 1.5)}, a AS ({top_sql('s', 100)}), b AS ({top_sql('o', 100)})"


@query(f"WITH {_LISTS}, f AS (SELECT item_id, doc_id, round(sum(s), 9) AS score FROM (SELECT item_id, doc_id, 1.0::DOUBLE / (60 + rank) AS s FROM a UNION ALL SELECT item_id, doc_id, 0.3::DOUBLE / (60 + rank) FROM b) GROUP BY ALL) {top_sql('f', 10)}")
def rrf_weighted(t):
    return R.fuse([(best(t, 100), 1.0), (best(t, 100, 1.5), 0.3)], 10)


#: Words of a needle that a text must have before it is read.
RARE = 8


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def grep_baseline(t):
    index = documents(t)
    items = t.benchmark.select("item_id", F.col("text").alias("needle")).filter("needle is not null")
    # words inside a needle, between its ends, are words of every text that has it; texts with all of the rarest of them are looked at
    parts = F.split(F.lower("needle"), r"[^\p{L}\p{N}_]+")
    inner = F.array_intersect(F.slice(parts, 2, F.greatest(F.lit(0), F.size(parts) - 2)), T.tokens(F.col("needle")))
    inner = F.filter(inner, lambda w: ~w.rlike("[σς]"))  # whose lower case hangs on what follows
    words = stored(items.select("item_id", F.explode(inner).alias("term")), "words")
    known = words.join(index.vocabulary(words).select("term", "df"), "term", "left").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term"))).alias("r"))
    rarest = stored(known.select("item_id", F.size(F.slice("r", 1, RARE)).alias("need"), F.explode(F.slice("r", 1, RARE)["term"]).alias("term")), "rarest")
    asked = stored(rarest.select("term").distinct(), "asked")
    # a text with a needle has all of these words; the lists of a block meet in a task, and only ids move
    held = K.unrolled(index.lists(asked).select("term", "block", "p").repartition(K.tasks_of(t.spark, index.n), "block").join(K.few(rarest), "term"), "block")
    held = held.groupBy("item_id", "need", "block", "pid").agg(F.count(F.lit(1)).alias("have")).filter("have = need").select("item_id", "pid")
    found = index.named(held, ["doc_id", "content"]).join(K.few(stored(items, "items")), "item_id").filter(F.contains("content", "needle")).select("item_id", "doc_id")
    bare = stored(items.join(words.select("item_id").distinct(), "item_id", "left_anti"), "bare")
    if bare.isEmpty():
        return found
    return found.unionByName(t.documents.join(K.few(bare), F.contains("text", "needle")).select("item_id", "doc_id"))


@query(f"WITH {_POST}, {_TERMS}, {scores_sql('s', 1.2)}, f AS (SELECT s.* FROM s JOIN documents USING (doc_id) WHERE lang = 'en' AND source IN ('src0', 'src1', 'src2')) {top_sql('f', 5)}")
def filtered_bm25(t):
    wanted = documents(t).passages().filter("lang = 'en' AND source IN ('src0', 'src1', 'src2')")
    return best(t, 5, wanted=wanted)


@query(f"""WITH {_POST}, {_TERMS}, {scores_sql('s', 1.2)}, a AS ({top_sql('s', 20)}),
w AS (SELECT a.*, CAST(floor(len({_WORDS}) * 1.3::DOUBLE) AS BIGINT) AS tokens FROM a JOIN documents USING (doc_id)),
u AS (SELECT *, CAST(sum(tokens + 15) OVER (PARTITION BY item_id ORDER BY rank) AS BIGINT) AS used FROM w)
SELECT item_id, doc_id, rank, used FROM u WHERE used <= 2000""")
def pack_context(t):
    index = documents(t)
    found = index.named(index.search(K.query_terms(t.benchmark, index.analyzer), 20), ["doc_id", "content"])
    return S.packed(found.withColumn("tokens", T.token_estimate(F.col("content"))), 2000).select("item_id", "doc_id", "rank", "used")


_QRELS = "q AS (SELECT item_id, doc_id, 1 AS grade FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query(f"""WITH {_POST}, {_TERMS}, {scores_sql('s', 1.2)}, a AS ({top_sql('s', 10)}), {_QRELS},
j AS (SELECT q.item_id, q.grade, a.rank, row_number() OVER (PARTITION BY q.item_id ORDER BY grade DESC, q.doc_id) AS best FROM q LEFT JOIN a ON a.item_id = q.item_id AND a.doc_id = q.doc_id),
e AS (SELECT item_id, count(rank) / count(*)::DOUBLE AS recall, coalesce(1.0::DOUBLE / min(rank), 0) AS rr, sum(coalesce(1 / log2(rank + 1), 0)) / sum(CASE WHEN best <= 10 THEN 1 / log2(best + 1) ELSE 0 END) AS ndcg FROM j GROUP BY item_id)
SELECT count(*) AS n_queries, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS rr, round(avg(ndcg), 6) AS ndcg FROM e""")
def eval_quality(t):
    return S.quality(bm25_batch(t), grep_baseline(t).withColumn("grade", F.lit(1)), 10)


# --- knowledge graph ---
_TRIPLES = """tr AS (
  SELECT 'c' || c_custkey AS id, c_name AS subject, 'located_in' AS predicate, n_name AS object, CAST(NULL AS VARCHAR) AS valid_from, CAST(NULL AS VARCHAR) AS valid_to FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 's' || s_suppkey, s_name, 'located_in', n_name, NULL, NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'part_of', r_name, NULL, NULL FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'o' || o_orderkey, c_name, 'last_order', 'order-' || o_orderkey, strftime(o_orderdate, '%Y-%m-%d'),
    strftime(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), '%Y-%m-%d') FROM orders JOIN customer ON o_custkey = c_custkey)"""


def triples(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")

    def rows(df, mark, key, subject, predicate, obj, low=none, high=none):
        return df.select(F.concat(F.lit(mark), F.col(key).cast("string")).alias("id"), F.col(subject).alias("subject"), F.lit(predicate).alias("predicate"), obj.alias("object"), low.alias("valid_from"), high.alias("valid_to"))

    customers = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    suppliers = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey"))
    nations = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    orders = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    after = F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    orders = orders.withColumn("after", after)
    every = rows(customers, "c", "c_custkey", "c_name", "located_in", F.col("n_name"))
    every = every.unionByName(rows(suppliers, "s", "s_suppkey", "s_name", "located_in", F.col("n_name")))
    every = every.unionByName(rows(nations, "n", "n_nationkey", "n_name", "part_of", F.col("r_name")))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return every.unionByName(rows(orders, "o", "o_orderkey", "c_name", "last_order", F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")), day("o_orderdate"), day("after")))


_AS_OF = "(valid_from IS NULL OR valid_from <= '1997-06-30') AND (valid_to IS NULL OR valid_to >= '1997-06-30')"


@query(f"WITH {_TRIPLES} SELECT id, subject, object FROM tr WHERE predicate = 'last_order' AND {_AS_OF}")
def kg_match(t):
    return G.match(triples(t), predicate="last_order", as_of="1997-06-30").select("id", "subject", "object")


@query(f"WITH {_TRIPLES} SELECT id, subject, predicate, object FROM tr WHERE (subject = (SELECT min(n_name) FROM nation) OR object = (SELECT min(n_name) FROM nation)) AND {_AS_OF}")
def kg_query_entity_asof(t):
    name = t.nation.agg(F.min("n_name")).first()[0]
    return G.about(triples(t), name).filter(G.in_force("1997-06-30")).select("id", "subject", "predicate", "object")


@query(f"WITH {_TRIPLES} SELECT subject AS entity FROM tr UNION SELECT object FROM tr")
def kg_entities(t):
    every = triples(t)
    return every.select(F.col("subject").alias("entity")).union(every.select("object")).distinct()


@query(f"WITH {_TRIPLES} SELECT object, count(*) AS n, min(id) AS first_id FROM tr WHERE predicate = 'located_in' GROUP BY object")
def kg_sources(t):
    return G.match(triples(t), predicate="located_in").groupBy("object").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query(f"WITH {_TRIPLES} SELECT subject, object, valid_from, CAST(row_number() OVER (PARTITION BY subject ORDER BY coalesce(valid_from, '9999-99-99'), id) AS INTEGER) AS place FROM tr WHERE predicate = 'last_order'")
def kg_timeline(t):
    order = Window.partitionBy("subject").orderBy(F.coalesce("valid_from", F.lit("9999-99-99")), "id")
    return G.match(triples(t), predicate="last_order").withColumn("place", F.row_number().over(order)).select("subject", "object", "valid_from", "place")


@query(f"WITH {_TRIPLES}, x AS (SELECT *, coalesce(valid_from, '0000-01-01') AS low, coalesce(valid_to, '9999-12-31') AS high FROM tr) SELECT a.subject, a.predicate, a.id AS id_a, b.id AS id_b, a.object AS object_a, b.object AS object_b FROM x a JOIN x b ON a.subject = b.subject AND a.predicate = b.predicate AND a.id < b.id AND a.object <> b.object AND a.low <= b.high AND b.low <= a.high")
def kg_contradictions(t):
    return G.contradictions(triples(t))


@query(f"""WITH RECURSIVE {_TRIPLES}, e AS (SELECT DISTINCT subject AS a, object AS b FROM tr WHERE predicate <> 'last_order' UNION SELECT object, subject FROM tr WHERE predicate <> 'last_order'),
r AS (SELECT min(r_name) AS entity, 0 AS depth FROM region UNION SELECT e.b, r.depth + 1 FROM r JOIN e ON e.a = r.entity WHERE r.depth < 2)
SELECT entity, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY entity""")
def kg_traverse(t):
    start = t.region.agg(F.min("r_name")).first()[0]
    return G.traverse(triples(t).filter("predicate <> 'last_order'"), start, 2)


# --- documents, state and events ---
@query("""WITH n AS (SELECT doc_id + 5 AS doc_id, md5(coalesce(text, '')) AS h FROM documents), o AS (SELECT doc_id, md5(coalesce(text, '')) AS h FROM documents)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS state FROM o FULL OUTER JOIN n ON o.doc_id = n.doc_id""")
def corpus_diff(t):
    had = t.documents.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    has = t.documents.select((F.col("doc_id") + 5).alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("g"))
    state = F.when(F.col("h").isNull(), "new").when(F.col("g").isNull(), "deleted").when(F.col("h") == F.col("g"), "unchanged").otherwise("changed")
    return had.join(has, "doc_id", "full_outer").select("doc_id", state.alias("state"))


@query("""WITH l AS (SELECT unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS target FROM pages), c AS (SELECT target, count(*) AS inbound FROM l GROUP BY target)
SELECT target, inbound, round(inbound / max(inbound) OVER ()::DOUBLE, 6) AS popularity FROM c""")
def link_popularity(t):
    found = t.pages.select(F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("target"))
    counts = found.groupBy("target").agg(F.count(F.lit(1)).alias("inbound"))
    return counts.crossJoin(F.broadcast(counts.agg(F.max("inbound").alias("most")))).select("target", "inbound", F.round(F.col("inbound") / F.col("most"), 6).alias("popularity"))


@query("SELECT o_orderkey, round(exp(-ln(2) / 30 * greatest(0, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02'))), 6) AS freshness FROM orders")
def recency_decay(t):
    age = F.greatest(F.lit(0), F.datediff(F.lit("1998-08-02").cast("date"), F.col("o_orderdate").cast("date")))
    return t.orders.select("o_orderkey", F.round(F.exp(-F.ln(F.lit(2.0)) / 30 * age), 6).alias("freshness"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean_value FROM events GROUP BY event_type")
def annotation_stats(t):
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("SELECT user_id, count(*) AS hits, round(max(value) + 0.05 * count(*) - 0.02 * (max(event_id) - min(event_id)), 6) AS score FROM events GROUP BY user_id")
def bulletin_scores(t):
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("hits"), F.round(F.max("value") + F.count(F.lit(1)) * F.lit(0.05) - (F.max("event_id") - F.min("event_id")) * F.lit(0.02), 6).alias("score"))


@query("SELECT event_type, v[1 + CAST(floor(n * 0.5) AS BIGINT)] AS p50, v[1 + CAST(floor(n * 0.95) AS BIGINT)] AS p95 FROM (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY event_type)")
def latency_percentiles(t):
    # equal values are counted before they move; ranks of a kind's values are places in one order of all
    values = stored(t.events.filter("value is not null").groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("rows")), "values")
    n = values.groupBy("event_type").agg(F.sum("rows").alias("n"))
    before = n.select(F.col("event_type").alias("_t"), (F.sum("n").over(Window.orderBy("event_type")) - F.col("n")).alias("before"))  # a row for each kind
    each = values.select("event_type", "value", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy"))
    placed = running(each, ["event_type", "value", "copy"], F.lit(True), "i").join(F.broadcast(n), "event_type").join(F.broadcast(before), F.col("event_type") == F.col("_t"))
    at = lambda q: F.max(F.when(F.col("i") - F.col("before") == F.floor(F.col("n") * q) + 1, F.col("value")))
    return placed.groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


@query("SELECT doc_id, lang, source FROM documents WHERE regexp_full_match(source || '/' || lang || '/d' || doc_id || '.md', 'src1.*/e./d.*\\.md') AND lang IN ('en', 'es') AND source <> 'src1'")
def filter_path_glob(t):
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md")))
    return t.documents.filter(path.rlike(r"^src1.*/e./d.*\.md$") & F.col("lang").isin("en", "es") & (F.col("source") != "src1")).select("doc_id", "lang", "source")


@query("WITH a AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS c FROM embeddings) SELECT label, round(max(c), 6) AS best FROM a GROUP BY label")
def dense_doc_scores(t):
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    one = F.broadcast(t.embeddings.filter("vec_id = 0").select(F.col("embedding").alias("q")))  # one row
    scored = t.embeddings.crossJoin(one).withColumn("c", dot(F.col("embedding"), F.col("q")) / F.sqrt(dot(F.col("embedding"), F.col("embedding")) * dot(F.col("q"), F.col("q"))))
    return scored.groupBy("label").agg(F.round(F.max("c"), 6).alias("best"))
