"""Named queries over facts, fused signals, sections, hot context and evaluation, with SQL written from the rules themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeweave.functions import text as T
from lodeweave.operators import chunks as C
from lodeweave.operators import facts as K
from lodeweave.operators import hot, hybrid
from lodeweave.operators import ranking as R
from lodeweave.operators import retrieval as X
from lodeweave.operators import state as S
from lodeweave.plans.catalogue import _CUES, _TRIPLES, ORACLES, best, query, top_sql, triples
from lodeweave.plans.retrieval import _TOP, _VAULT, vault
from lodeweave.session import stored
from lodeweave.sources import vault as V
from lodeweave.streaming import watch

# --- facts of texts ---
_SAYS = (("is_a", "is the"), ("is", "is"), ("works_at", "works for"), ("leads", "led the"), ("owns", "owned"), ("created", "built the"), ("reports_to", "reports to"), ("part_of", "is part of"), ("replaced", "replaced"), ("uses", "uses"), ("depends_on", "depends on the"), ("responsible_for", "is responsible for"), ("managed_by", "is run by"), ("introduced", "introduced"))
_NAMES, _THINGS = ("Ada", "Bob Stone", "Cy Van Dam"), ("Acme Works", "Delta", "Echo base", "River Plant", "Oslo")


def _listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(f"""WITH x AS (SELECT c_custkey AS k, 'c/' || c_custkey || '.md' AS source, {_listed(_NAMES)}[1 + c_custkey % 3] AS s, {_listed(p for p, _ in _SAYS)}[1 + c_custkey % 14] AS p, {_listed(_THINGS)}[1 + c_custkey % 5] AS o FROM customer)
SELECT s AS subject, p AS predicate, o AS object, source, 2 AS place FROM x UNION ALL SELECT 'Plan', 'mentioned_in', source, source, 0 FROM x UNION ALL SELECT source, 'tagged_as', 'ops/a-' || k % 4, source, 1 FROM x""")
def extract_facts(t):
    """Facts of an invented note for each customer."""
    k = F.col("c_custkey")
    one = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    said = F.concat(F.lit("# Note\nSee [[Plan|the plan]] and #ops/a-"), (k % 4).cast("string"), F.lit(". It is a test. "), one(_NAMES), F.lit(" "), one([w for _, w in _SAYS]), F.lit(" "), one(_THINGS), F.lit(" ; , which lasts! They is the Rest. Is "), F.repeat(F.lit("long "), 40), F.lit("Ada uses Delta."))
    docs = t.customer.select(F.concat(F.lit("c/"), k.cast("string"), F.lit(".md")).alias("doc_path"), F.regexp_replace(said, " ; , which lasts!", ". ").alias("text"))
    return K.extracted(docs).select("subject", "predicate", "object", "source", "place")


def sourced(t):
    """Facts with a table as their source."""
    return triples(t).withColumn("source", F.substring("id", 1, 1))


_ENDS = f"""{_TRIPLES}, en AS (SELECT subject AS entity, object AS other, id, substr(id, 1, 1) AS source FROM tr UNION ALL SELECT object, subject, id, substr(id, 1, 1) FROM tr WHERE subject <> object),
ask AS (SELECT DISTINCT r_regionkey AS item_id, r_name AS entity FROM region UNION SELECT n_regionkey, n_name FROM nation WHERE n_nationkey % 3 = 0)"""


def _asked(t):
    nations = t.nation.filter("n_nationkey % 3 = 0").select("n_regionkey", "n_name")
    return t.region.select(F.col("r_regionkey").alias("item_id"), F.col("r_name").alias("entity")).union(nations)


@query(f"""WITH {_ENDS}, w AS (SELECT entity, 1 / (1 + count(*))::DOUBLE AS w FROM en GROUP BY entity), f AS (SELECT entity, other FROM en QUALIFY row_number() OVER (PARTITION BY entity ORDER BY id) <= 5),
src AS (SELECT DISTINCT entity AS place, source FROM en), r AS (SELECT item_id, entity AS place, w FROM ask JOIN w USING (entity) UNION ALL SELECT item_id, other, 0.3::DOUBLE * w FROM ask JOIN w USING (entity) JOIN f USING (entity))
SELECT item_id, source, round(sum(w), 6) AS score FROM r JOIN src USING (place) GROUP BY ALL""")
def entity_source_scores(t):
    found = K.source_scores(_asked(t), sourced(t))
    return found.select("item_id", "source", F.round("score", 6).alias("score"))


@query(f"""WITH {_ENDS}, m AS (SELECT item_id, other, min(id) AS id FROM ask JOIN en USING (entity) GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY id, other) AS i FROM m)
SELECT item_id, string_agg(other, ' ' ORDER BY i) AS terms FROM f WHERE i <= 5 GROUP BY item_id""")
def expand_by_neighbours(t):
    return K.neighbours(_asked(t), sourced(t))


@query(f"""WITH {_TRIPLES}, c AS (SELECT c_name AS a, r_name AS z FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey QUALIFY row_number() OVER (ORDER BY c_custkey) = 1)
SELECT x.id || ',' || y.id AS path, 2 AS hops FROM c JOIN tr x ON x.subject = a JOIN tr y ON y.subject = x.object AND y.object = z""")
def graph_paths(t):
    """Shortest paths from the first customer to its region."""
    row = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).orderBy("c_custkey").select("c_name", "r_name").first()
    found = K.paths(triples(t), row["c_name"], row["r_name"])
    return found.select(F.array_join("path", ",").alias("path"), "hops")


@query(f"""WITH {_TRIPLES}, c AS (SELECT min(n_name) AS n FROM nation), r AS (SELECT n AS entity, 0 AS depth FROM c UNION ALL SELECT object, 1 FROM tr, c WHERE subject = n AND predicate = 'part_of')
SELECT r.entity, depth, id FROM r JOIN tr ON tr.subject = r.entity OR tr.object = r.entity""")
def graph_reach_out(t):
    """All facts of the first nation and of what it is part of."""
    start = t.nation.agg(F.min("n_name")).first()[0]
    every = triples(t)
    return K.of_reached(every, K.reached(every, start, 2, ["part_of"], "out")).select("entity", "depth", "id")


@query(f"""WITH {_TRIPLES} SELECT '    <edge id="e' || id || '" source="' || replace(replace(subject, '&', '&amp;'), '<', '&lt;') || '" target="' || replace(replace(object, '&', '&amp;'), '<', '&lt;') || '"><data key="label">' || predicate || '</data><data key="source_doc">' || substr(id, 1, 1) || '</data></edge>' AS line FROM tr
UNION ALL SELECT '    <node id="' || replace(replace(n, '&', '&amp;'), '<', '&lt;') || '"/>' FROM (SELECT subject AS n FROM tr UNION SELECT object FROM tr)""")
def graph_markup(t):
    return V.graph_lines(sourced(t), "graphml").filter("part IN (1, 2)").select("line")


# --- passages ---
_SECTIONS = ORACLES["split_sections"].split(f"WITH {_VAULT}, ", 1)[1]


_PASSAGES = f"""WITH {_VAULT}, {_SECTIONS.rsplit('SELECT doc_id, n AS section', 1)[0].rstrip()}, z AS (SELECT doc_id, n AS section{_SECTIONS.rsplit('SELECT doc_id, n AS section', 1)[1]}),
w AS (SELECT z.doc_id, doc_path, section, heading, regexp_replace(heading || chr(10) || chr(10) || content, '^\\s+|\\s+$', '', 'g') AS whole FROM z JOIN vault USING (doc_id)),
ws AS (SELECT *, list_filter(regexp_split_to_array(whole, '\\s+'), lambda x: x <> '') AS wl FROM w),
wn AS (SELECT doc_id, doc_path, section, heading, 0 AS start, whole AS content, 'section:' || heading AS key FROM ws WHERE heading <> '' AND len(wl) <= 400
  UNION ALL SELECT doc_id, doc_path, section, heading, start, array_to_string(wl[start + 1:start + 400], ' '), heading || ':' || start FROM (SELECT *, unnest(range(0, len(wl), 350)) AS start FROM ws WHERE NOT (heading <> '' AND len(wl) <= 400))),
k AS (SELECT *, substr(sha256(doc_path || ':' || key), 1, 16) AS chunk_id FROM wn WHERE length(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) >= 10),
ps AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY doc_path, chunk_id ORDER BY section DESC, start DESC) = 1)"""


@query(f"{_PASSAGES} SELECT doc_path, section AS ordinal, chunk_id, length(content) AS n_chars FROM ps")
def section_chunks(t):
    found = C.of_documents(vault(t))
    return found.select("doc_path", "ordinal", "chunk_id", F.char_length("content").cast("long").alias("n_chars"))


@query(r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> ''), ' ') AS text FROM documents WHERE len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')) > 0")
def rejoined_windows(t):
    """Overlapping windows of whole texts, put together again."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    each = t.documents.select("doc_id", F.explode(T.windows(words, 400, 50)).alias("c")).select("doc_id", "c.start", "c.content")
    return C.joined(each, "doc_id")


# --- fused signals ---
@query(f"""WITH {_VAULT}, {_TOP}, a AS ({top_sql('s', 100)}),
i AS (SELECT item_id, CASE WHEN g > l THEN 'kg_first' WHEN l > g THEN 'bm25_first' ELSE 'balanced' END AS intent FROM (SELECT item_id, {_CUES(T.GRAPH_CUES)} AS g, {_CUES(T.LEXICAL_CUES)} AS l FROM benchmark)),
kd AS (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents WHERE source IS NOT NULL),
kg AS (SELECT item_id, doc_id, 1 / (1 + n)::DOUBLE * CASE WHEN r <= 5 THEN 1.3::DOUBLE ELSE 1 END AS score FROM kd JOIN benchmark ON source = 'src' || item_id % 5),
ed AS (SELECT d.doc_id AS x, e.doc_id AS y FROM documents d JOIN documents e ON e.doc_id = d.doc_id + 1 UNION SELECT d.doc_id, e.doc_id FROM documents d JOIN documents e ON e.doc_id = d.doc_id - 1 AND e.lang = d.lang),
h0 AS (SELECT item_id, doc_id, score FROM a WHERE rank <= 3), h1 AS (SELECT item_id, y AS doc_id, max(score) * 0.4::DOUBLE AS score FROM h0 JOIN ed ON x = doc_id GROUP BY ALL HAVING (item_id, y) NOT IN (SELECT (item_id, doc_id) FROM h0)),
h2 AS (SELECT item_id, y AS doc_id, max(score) * (0.4::DOUBLE * 0.4::DOUBLE) AS score FROM h1 JOIN ed ON x = doc_id GROUP BY ALL HAVING (item_id, y) NOT IN (SELECT (item_id, doc_id) FROM h0 UNION ALL SELECT (item_id, doc_id) FROM h1)),
pop AS (SELECT y AS doc_id, count(*)::DOUBLE AS score FROM ed GROUP BY y),
rec AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY 1 + doc_id % 9 DESC, doc_id % 10 DESC, doc_id) AS rank FROM a),
sig AS (SELECT item_id, doc_id, score, 'kg' AS signal FROM kg UNION ALL SELECT *, 'links' FROM h1 UNION ALL SELECT *, 'links' FROM h2 UNION ALL SELECT item_id, doc_id, pop.score, 'link_pop' FROM a JOIN pop USING (doc_id)),
rk AS (SELECT sig.item_id, sig.doc_id, signal, row_number() OVER (PARTITION BY sig.item_id, signal ORDER BY sig.score DESC, sig.doc_id) AS rank FROM sig JOIN a ON a.item_id = sig.item_id AND a.doc_id = sig.doc_id
  UNION ALL SELECT item_id, doc_id, 'recency', rank FROM rec UNION ALL SELECT item_id, doc_id, 'bm25', rank FROM a),
v AS (SELECT rk.*, CASE signal WHEN 'bm25' THEN CASE intent WHEN 'kg_first' THEN 0.5 WHEN 'bm25_first' THEN 2.0 ELSE 1.0 END WHEN 'kg' THEN 0.1 * CASE intent WHEN 'kg_first' THEN 2.0 WHEN 'bm25_first' THEN 0.5 ELSE 1.0 END
  WHEN 'links' THEN 0.1 * CASE intent WHEN 'balanced' THEN 1.0 ELSE 0.5 END WHEN 'recency' THEN 0.03 ELSE 0.02 END::DOUBLE AS w FROM rk JOIN i USING (item_id)),
fu AS (SELECT item_id, doc_id, round(sum(w / (60 + rank)), 9) AS rrf FROM v GROUP BY ALL)
SELECT fu.item_id, fu.doc_id, a.score, rrf, CAST(row_number() OVER (PARTITION BY fu.item_id ORDER BY rrf DESC, fu.doc_id) AS INTEGER) AS rank FROM fu JOIN a USING (item_id, doc_id) QUALIFY row_number() OVER (PARTITION BY fu.item_id ORDER BY rrf DESC, fu.doc_id) <= 10""")
def hybrid_rank(t):
    """BM25's 100 best of each query, ranked again with facts, links, dates and inbound links."""
    docs = vault(t).select("doc_id", "doc_path", "meta", "body")
    paths = docs.select("doc_id", "doc_path")
    pool = best(t, 100)
    known = t.documents.filter("source is not null").join(paths, "doc_id")
    held = known.select(F.col("source").alias("subject"), F.col("doc_path").alias("object"), F.col("doc_id").alias("id"), F.col("doc_path").alias("source"))
    asked = t.benchmark.select("item_id", F.concat(F.lit("src"), (F.col("item_id") % 5).cast("string")).alias("entity"))
    kg = K.source_scores(asked, held).join(paths.withColumnRenamed("doc_path", "source"), "source")
    edges = stored(X.resolved(docs.select(F.col("doc_path").alias("source"), F.explode(T.links(F.col("body"))).alias("link")), paths), "edges")
    walked = X.walked(pool.filter("rank <= 3").join(paths, "doc_id").select("item_id", "doc_path", "score"), edges).join(paths, "doc_path")
    inbound = hybrid.popularity(edges).join(paths, "doc_path").select("doc_id", F.col("score").alias("p"))
    dated = pool.join(docs.select("doc_id", F.col("meta")["date"].alias("date")), "doc_id")
    signals = {"kg": kg, "links": walked, "recency": X.recency(dated), "link_pop": pool.join(inbound, "doc_id").select("item_id", "doc_id", F.col("p").alias("score"))}
    return hybrid.hybrid(pool, signals, t.benchmark.select("item_id", T.intent(F.col("text")).alias("intent")))


# --- state ---
@query("""SELECT user_id AS board, event_type AS chunk_id, count(*) AS hits, CASE WHEN count(*) >= 7 THEN 0 ELSE 1 END AS tier, round(0.5 + 0.05 * count(*), 6)::DOUBLE AS score FROM events GROUP BY ALL""")
def hot_boards(t):
    """A board for each user, a passage for each type of event; with 7 hits a passage of base 0.5 is pinned."""
    uses = t.events.select(F.col("user_id").alias("board"), F.col("event_id").alias("at"), F.lit("hit").alias("action"), F.col("event_type").alias("chunk_id"), F.lit("").alias("doc_path"), F.lit("").alias("content"), F.lit(0.5).alias("base_score"))
    return hot.boards(uses).select("board", "chunk_id", "hits", "tier", F.round("score", 6).alias("score"))


@query("""WITH m AS (SELECT user_id % 50 AS u, event_type, value > 50 AS yes FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 50, event_type ORDER BY event_id DESC) = 1)
SELECT u || '-Q ' AS query, event_type AS chunk_id, CASE WHEN yes THEN 0.25 WHEN NOT yes THEN -0.4 ELSE 0 END::DOUBLE AS adjustment FROM m""")
def feedback_adjustments(t):
    """The last mark of a passage for a query counts, whatever the query's case and outer blanks."""
    name = (F.col("user_id") % 50).cast("string")
    marks = t.events.select(F.concat(F.lit(" "), name, F.lit("-q")).alias("query"), F.col("event_type").alias("chunk_id"), F.col("event_id").alias("at"), (F.col("value") > 50).alias("relevant"))
    asked = t.events.select(F.concat(name, F.lit("-Q ")).alias("query"), F.col("event_type").alias("chunk_id")).distinct()
    return hot.adjusted(asked, marks).select("query", "chunk_id", "adjustment")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def usage_windows(t):
    return watch.usage(t.events)


# --- evaluation ---
@query(f"""WITH {_TOP}, a AS ({top_sql('s', 10)}), q AS (SELECT item_id, 't' || item_id % 3 AS query_type, 'd' || item_id AS e FROM benchmark),
h AS (SELECT q.item_id, min(rank) AS first FROM q JOIN a ON a.item_id = q.item_id AND (contains('d' || doc_id, e) OR contains(e, 'd' || doc_id)) GROUP BY 1)
SELECT query_type, count(*) AS n, round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS recall, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS rr FROM q LEFT JOIN h USING (item_id) GROUP BY 1""")
def eval_by_type(t):
    path = lambda c: F.concat(F.lit("d"), F.col(c).cast("string"))
    run = best(t, 10).select(F.col("item_id").alias("query"), path("doc_id").alias("doc_path"), "rank")
    asked = t.benchmark.select(F.col("item_id").alias("query"), F.concat(F.lit("t"), (F.col("item_id") % 3).cast("string")).alias("query_type"), F.array(path("item_id")).alias("expected"))
    return S.by_type(run, asked)
